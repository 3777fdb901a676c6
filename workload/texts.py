"""Extraction, cleaning, redaction and salvage over whole texts derived from documents, benchmark, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitaspark.functions import text as X
from vitaspark.functions.lexicon import API_SKILL_TERMS, BATCH_SKILL_TERMS
from vitaspark.operators import extract as E
from vitaspark.operators import salvage as SV
from vitaspark.plans.sizing import spread

from . import oracle as O
from .registry import query, table
from .roles import SKILLS, N_SKILLS, TITLES, jobs, JOBS_SQL, pick
from .records import RESPONSE

NL = "chr(10)"
D = "CAST(doc_id AS STRING)"
NAMES = "Asha Rao;Maria Lopez;John Smith;Wei Chen;Omar Haddad;Lena Fischer;Noor Khan"
CITIES = "Pune, Maharashtra;Kolkata, West Bengal;Indore, Madhya;Springfield, Illinois"
STATEMENTS = "Having 4+ years of experience in data;Total experience: 7.5 years;over 3 years of experience;6 years and 3 months of experience;No figures here;Worked directly with customers;Experience: 9 yrs"
JOBLINES = (
    "Senior Data Engineer at Acme Corp, 2015 - 2019;Project Manager, managed team of 9 at Globex Inc;Java Developer 2012 - present;"
    "Worked with Initech, as Analyst;Full-Stack Developer for Hooli Technologies;Network Specialist"
)
STUDIES = "B.Tech from Delhi University 2014;Master of Science, Institute of Physics, 1999;MBA Harvard College;no degree;Ph.D. at Stanford University 2005"
CERTS = "AWS Certified Developer;Best performer award 2019;PMP;Diploma in Testing;CGPA 9"
_SK = lambda e: pick(SKILLS, N_SKILLS, e)

# A résumé around every document: a head that varies with the key, then the whole document text.
RESUME = f"""CASE WHEN doc_id % 5 = 4 THEN 'RESUME' ELSE {pick(NAMES, 7, 'doc_id')} END || {NL}
 || CASE doc_id % 4 WHEN 0 THEN 'Address: ' || CAST(1 + doc_id % 99 AS STRING) || ' Park Street, Main Road, ' || {pick(CITIES, 4, 'doc_id')} || ' ' || CAST(400000 + doc_id % 9999 AS STRING) || {NL}
   WHEN 1 THEN 'Flat ' || CAST(doc_id % 50 AS STRING) || ', ' || {pick(CITIES, 4, 'doc_id')} || ' 70010' || CAST(doc_id % 9 AS STRING) || {NL} WHEN 2 THEN 'Location: ' || {pick(CITIES, 4, 'doc_id')} || {NL} ELSE '' END
 || CASE doc_id % 3 WHEN 0 THEN 'Email: maria.lopez' || {D} || '@mail.example.com' || {NL} WHEN 1 THEN 'contact: asha 200@site' || CAST(doc_id % 7 AS STRING) || '.org' || {NL} ELSE '' END
 || CASE doc_id % 4 WHEN 0 THEN 'Phone: +91 98' || CAST(10000000 + doc_id AS STRING) || {NL} WHEN 1 THEN 'mobile: 555123' || CAST(1000 + doc_id % 9000 AS STRING) || {NL} WHEN 2 THEN 'Tel: (022) 555-1234' || {NL} ELSE '' END
 || CASE doc_id % 3 WHEN 0 THEN 'linkedin.com/in/user' || {D} || {NL} WHEN 1 THEN 'https://www.linkedin.com/in/p-' || {D} || '/' || {NL} ELSE '' END
 || CASE WHEN doc_id % 2 = 0 THEN 'SUMMARY' || {NL} ELSE '' END || {pick(STATEMENTS, 7, 'doc_id')} || '.' || {NL} || {NL}
 || 'Skills: ' || {_SK('doc_id * 7')} || ', ' || {_SK('doc_id * 3 + 1')} || ', ' || {_SK('doc_id * 11 + 4')} || {NL} || {NL}
 || 'EXPERIENCE' || {NL} || {pick(JOBLINES, 6, 'doc_id')} || {NL} || {NL} || 'EDUCATION' || {NL} || {pick(STUDIES, 5, 'doc_id')} || {NL} || {NL}
 || CASE WHEN doc_id % 2 = 0 THEN 'CERTIFICATIONS' || {NL} || {pick(CERTS, 5, 'doc_id')} || {NL} || {pick(CERTS, 5, 'doc_id + 1')} || {NL} || {NL} ELSE '' END || text"""
RES = f"WITH r AS (SELECT doc_id AS resume_id, source, {RESUME} AS text FROM documents)"

# A job text per benchmark item: labelled, plain or with statements, then the item's own text.
JD = f"""CASE item_id % 4 WHEN 0 THEN 'Job Title: ' || {pick(TITLES, 10, 'item_id')} || {NL} WHEN 1 THEN {pick(TITLES, 10, 'item_id')} || {NL} WHEN 2 THEN {NL} || '## Role' || {NL} ELSE '' END
 || 'Required Skills: ' || {_SK('item_id * 3')} || ', ' || {_SK('item_id * 5 + 1')} || ', Go' || {NL} || {NL}
 || CASE item_id % 5 WHEN 0 THEN CAST(1 + item_id % 9 AS STRING) || '+ years of experience needed' WHEN 1 THEN '3-5 years experience' WHEN 2 THEN '1-2 years of hands-on experience' WHEN 3 THEN 'Experience: 6 years' ELSE 'looking for: a person' END || {NL} || text"""
JDS = f"WITH j AS (SELECT item_id AS jd_id, {JD} AS text FROM benchmark)"


def resumes(spark, sf):
    return spread(table(spark, sf, "documents").selectExpr("doc_id AS resume_id", "source", f"{RESUME} AS text"))


def job_texts(spark, sf):
    return table(spark, sf, "benchmark").selectExpr("item_id AS jd_id", f"{JD} AS text").transform(spread)


def bars(c, name):
    return F.array_join(c, "|").alias(name)


def _list(terms) -> str:
    return "[" + ", ".join(O.q(t) for t in terms) + "]"


def _escape(t: str) -> str:
    return "".join("\\" + c if c in ".+*?()[]{}|^$" else c for c in t)


def _word_sql(terms, low: bool = True) -> str:
    """Terms standing as words: surrounded by non-word characters or the ends."""
    pats = "[" + ", ".join(O.q(f"(^|[^\\p{{L}}\\p{{N}}_]){_escape(t.lower())}($|[^\\p{{L}}\\p{{N}}_])") for t in terms) + "]"
    return f"list_transform(list_filter(list_zip({_list(terms)}, {pats}), lambda z: CASE WHEN contains(lower(text), lower(z[1])) THEN regexp_matches(lower(text), z[2]) ELSE false END), lambda z: z[1])"


X1_SQL = f"array_to_string(list_filter({_list(dict.fromkeys(BATCH_SKILL_TERMS))}, lambda t: contains(lower(text), t)), '|')"


@query("x1", f"{RES} SELECT resume_id, {X1_SQL} AS skills FROM r")
def x1(spark, sf):
    return resumes(spark, sf).select("resume_id", bars(E.job_skills(F.col("text")), "skills"))


@query("x1_api", f"{JDS} SELECT jd_id, array_to_string(list_filter({_list(API_SKILL_TERMS)}, lambda t: contains(lower(text), t)), '|') AS skills FROM j")
def x1_api(spark, sf):
    return job_texts(spark, sf).select("jd_id", bars(E.job_skills(F.col("text"), "api"), "skills"))


def _title(e: str) -> str:
    return f"array_to_string(list_transform(string_split({e}, '-'), lambda p: array_to_string(list_transform(string_split(p, ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ')), '-')"


@query("x2", f"{RES} SELECT resume_id, array_to_string(list_sort(list_transform({_word_sql(E.POST_SKILLS)}, lambda s: {_title('s')})), '|') AS skills FROM r")
def x2(spark, sf):
    return resumes(spark, sf).select("resume_id", bars(E.post_skills(F.col("text")), "skills"))


@query("x3", f"{RES} SELECT resume_id, array_to_string({_word_sql(E.FALLBACK_SKILLS)}, '|') AS skills FROM r")
def x3(spark, sf):
    return resumes(spark, sf).select("resume_id", bars(E.fallback_skills(F.col("text")), "skills"))


_STRIP = lambda e: f"regexp_replace({e}, '^\\s+|\\s+$', '', 'g')"
X4_SQL = f"""CASE WHEN len({_word_sql(E.LEGACY_SKILLS)}) > 0 THEN {_word_sql(E.LEGACY_SKILLS)} ELSE list_filter(list_transform(string_split_regex(
  regexp_extract(text, '(?is)(?:technical skills|skills|expertise|proficiencies)[:\\s]+(.*?)(?:\\n\\n|\\n[A-Z])', 1), '[,;•|]'), lambda s: {_STRIP('s')}), lambda s: length(s) > 2 AND length(s) < 30) END"""


@query("x4", f"{RES} SELECT resume_id, array_to_string({X4_SQL}, '|') AS skills FROM r")
def x4(spark, sf):
    return resumes(spark, sf).select("resume_id", bars(E.legacy_skills(F.col("text")), "skills"))


@query("x5", f"{JDS} SELECT jd_id, coalesce(TRY_CAST(nullif(regexp_extract(text, '(?i)(\\d+)(?:\\s*[-+]?\\s*\\d*)?\\s+years?\\s+(?:of\\s+)?experience', 1), '') AS DOUBLE), 0.0) AS years FROM j")
def x5(spark, sf):
    return job_texts(spark, sf).select("jd_id", E.required_years(F.col("text")).alias("years"))


@query("x6", f"{JDS} SELECT jd_id, coalesce(nullif(regexp_extract(text, '\\A([^.:\\n]{{5,100}})', 1), ''), 'Not specified') AS title, coalesce(nullif(regexp_extract(regexp_replace(text, '(?i)\\A\\s*(?:job title|title|position|role)\\s*:\\s*', ''), '\\A([^.:\\n]{{5,100}})', 1), ''), 'Not specified') AS labelled_title FROM j")
def x6(spark, sf):
    t = F.col("text")
    return job_texts(spark, sf).select("jd_id", E.job_title(t).alias("title"), E.job_title(t, True).alias("labelled_title"))


def _rx(p: str) -> str:
    return O.q(p.replace("\\z", "$"))


def _x7() -> str:
    lists = ", ".join(
        f"CASE WHEN len(list_filter(list_transform(string_split_regex(regexp_extract(text, {_rx(p)}, 1), '[,;•\\n]'), lambda s: trim(s)), lambda s: length(s) > 2 AND length(s) < 50)) > 0 THEN "
        f"list_filter(list_transform(string_split_regex(regexp_extract(text, {_rx(p)}, 1), '[,;•\\n]'), lambda s: trim(s)), lambda s: length(s) > 2 AND length(s) < 50) END" for p in E.QUERY_SKILLS
    )
    years = ", ".join(f"TRY_CAST(nullif(regexp_extract(regexp_extract(text, {_rx(p)}, 1), '(\\d+)', 1), '') AS INT)" for p in E.QUERY_YEARS)
    titles = ", ".join(f"CASE WHEN length(trim(regexp_extract(text, {_rx(p)}, 1))) > 5 AND length(trim(regexp_extract(text, {_rx(p)}, 1))) < 100 THEN trim(regexp_extract(text, {_rx(p)}, 1)) END" for p in E.QUERY_TITLES)
    return f"""SELECT jd_id, coalesce(array_to_string(coalesce({lists}), '|'), '') AS skills,
      coalesce({years}, 0) AS total_experience, coalesce({titles}, '') AS title FROM j"""


@query("x7", f"{JDS} {_x7()}")
def x7(spark, sf):
    q = job_texts(spark, sf).select("jd_id", E.query_structure(F.col("text")).alias("q"))
    return q.select("jd_id", bars(F.col("q.skills"), "skills"), F.col("q.total_experience").alias("total_experience"), bars(F.col("q.positions"), "title"))


@query("x9", f"{RES} SELECT resume_id, array_to_string(regexp_extract_all(text, '[\\w\\.-]+@[\\w\\.-]+\\.\\w+'), ', ') AS emails FROM r")
def x9(spark, sf):
    return resumes(spark, sf).select("resume_id", E.all_emails(F.col("text")).alias("emails"))


X10_SQL = f"""f AS (SELECT resume_id, {pick(NAMES, 7, 'resume_id')} AS who, list_concat(regexp_extract_all(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}}'),
  list_transform(regexp_extract_all(text, '[A-Za-z0-9._%+-]+\\s+\\d+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}'), lambda e: regexp_replace(e, '\\s+', ''))) AS found FROM r)"""


@query("x10", f"""{RES}, {X10_SQL} SELECT resume_id, coalesce(list_filter(found, lambda e: len(list_filter(string_split(lower(who), ' '), lambda p: length(p) > 2 AND contains(lower(split_part(e, '@', 1)), p))) > 0)[1], found[1]) AS email FROM f""")
def x10(spark, sf):
    r = resumes(spark, sf).withColumn("who", F.expr(pick(NAMES, 7, "resume_id")))
    return r.select("resume_id", E.best_email(F.col("text"), F.col("who")).alias("email"))


@query("x11", f"{RES} SELECT resume_id, array_to_string(regexp_extract_all(text, '[\\+\\(]?[0-9][0-9\\-\\(\\) ]{{8,}}[0-9]'), ', ') AS phones FROM r")
def x11(spark, sf):
    return resumes(spark, sf).select("resume_id", E.all_phones(F.col("text")).alias("phones"))


def _x12() -> str:
    parts = [f"regexp_extract_all(text, {O.q(p)}, {g})" for p, g in E.PHONE_FORMS]
    flat = f"flatten([{', '.join(parts)}])"
    clean = "trim(regexp_replace(regexp_replace(p, '[^\\d\\+\\-\\(\\)\\s\\.]', '', 'g'), '[\\s\\-\\.]+', ' ', 'g'))"
    return f"v AS (SELECT resume_id, list_filter(list_transform({flat}, lambda p: {clean}), lambda p: regexp_matches(p, '\\+?\\d{{6,}}')) AS ok FROM r)"


@query("x12", f"{RES}, {_x12()} SELECT resume_id, coalesce(list_filter(ok, lambda p: starts_with(p, '+'))[1], ok[1]) AS phone FROM v")
def x12(spark, sf):
    return resumes(spark, sf).select("resume_id", E.best_phone(F.col("text")).alias("phone"))


@query("x13", f"""{RES} SELECT resume_id, coalesce({', '.join(f"trim(list_filter(regexp_extract_all(text, {O.q(p)}, 1), lambda m: length(m) > 15)[1])" for p in E.ADDRESS_FORMS)},
  list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(translate(s, chr(9) || chr(13), '  '))), lambda s: length(s) > 20 AND contains(s, ',') AND regexp_matches(s, '\\d{{5,6}}') AND NOT regexp_matches(lower(s), 'experience|job|position|skill|qualification'))[1]) AS address FROM r""")
def x13(spark, sf):
    return resumes(spark, sf).select("resume_id", E.address(F.col("text")).alias("address"))


@query("x14")
def x14(spark, sf):
    return resumes(spark, sf).select("resume_id", E.careful_address(F.col("text")).alias("address"))


LINE_SQL = "ln AS (SELECT resume_id, unnest(range(1, len(l) + 1)) AS pos, unnest(l) AS line FROM (SELECT resume_id, string_split(text, chr(10)) AS l FROM r))"


def _lines_df(spark, sf):
    return resumes(spark, sf).select("resume_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("pos", (F.col("pos") + 1).cast("bigint"))


_FLAG = lambda p: f"CAST(regexp_matches(line, {O.q(p)}) AS INT)"
X15_SQL = f"""{_FLAG(chr(92) + 'd')} + {_FLAG('(?i)(?:street|road|lane|avenue|block|sector|district|area|colony|apartments|flats|towers)')} * 2 + {_FLAG(chr(92) + 'b' + chr(92) + 'd{5,7}' + chr(92) + 'b')} * 3
  + CAST(contains(line, ',') AS INT) - {_FLAG('(?i)' + chr(92) + 'b(?:develop|create|implement|work|using|design)' + chr(92) + 'b')} * 2 - {_FLAG('(?i)' + chr(92) + 'b(?:software|hardware|data|cloud|API|system|framework|database)' + chr(92) + 'b')} * 2"""


@query("x15", f"{RES}, {LINE_SQL} SELECT resume_id, pos, {X15_SQL} AS points, length(line) >= 5 AND ({X15_SQL}) >= 2 AS is_address FROM ln")
def x15(spark, sf):
    line = F.col("line")
    return _lines_df(spark, sf).select("resume_id", "pos", E.address_points(line).alias("points"), E.looks_like_address(line).alias("is_address"))


def _or(words) -> str:
    return " OR ".join(f"contains(t, {O.q(w)})" for w in words)


X16_SQL = f"""CASE WHEN coalesce(line, '') = '' THEN false WHEN regexp_matches(t, '\\b\\d{{5,6}}\\b') AND regexp_matches(t, '\\b(?:street|road|avenue|lane|apartment|district|city|state)\\b') THEN false
  WHEN t IN ({', '.join(O.q(v) for v in E.NO_ADDRESS_VALUES)}) THEN true WHEN {' OR '.join(f'regexp_matches(t, {O.q(p)})' for p in E.STATEMENT_CUES)} THEN true
  WHEN {' + '.join(f'CAST(contains(t, {O.q(w)}) AS INT)' for w in E.ROLE_TERMS)} >= 2 THEN true WHEN {' OR '.join(f'regexp_matches(t, {O.q(p)})' for p in E.EXPERIENCE_CUES)} THEN true
  WHEN {_or(E.TECH_WORDS)} THEN true WHEN {_or(E.ADDRESS_CUES)} THEN false WHEN regexp_matches(t, '\\b\\d{{5,7}}\\b') THEN false ELSE true END"""


@query("x16", f"{RES}, {LINE_SQL} SELECT resume_id, pos, {X16_SQL} AS is_job FROM (SELECT *, lower(trim(line)) AS t FROM ln)")
def x16(spark, sf):
    return _lines_df(spark, sf).select("resume_id", "pos", E.is_job_text(F.col("line")).alias("is_job"))


@query("x17")
def x17(spark, sf):
    return resumes(spark, sf).select("resume_id", E.person_name(F.col("text")).alias("name"))


@query("x18", f"""{RES} SELECT resume_id, CASE WHEN ends_with(u, '/') THEN u ELSE u || '/' END AS url FROM (SELECT resume_id, CASE WHEN regexp_matches(f, '\\Ahttps?://') THEN f WHEN contains(f, 'linkedin.com') THEN 'https://www.' || f
  ELSE 'https://www.linkedin.com/in/' || f END AS u FROM (SELECT resume_id, coalesce({', '.join(f"nullif(regexp_extract(text, {O.q(p)}, {g}), '')" for p, g in E.LINKEDIN_FORMS)}) AS f FROM r))""")
def x18(spark, sf):
    return resumes(spark, sf).select("resume_id", E.linkedin_url(F.col("text")).alias("url"))


def _years_sql(t: str) -> str:
    one = []
    for p in E.YEARS_FORMS:
        y = f"TRY_CAST(nullif(regexp_extract({t}, {O.q('(?i)' + p)}, 1), '') AS DOUBLE)"
        if p.count("(\\d+") > 1:
            y = f"({y} + coalesce(TRY_CAST(nullif(regexp_extract({t}, {O.q('(?i)' + p)}, 2), '') AS DOUBLE) / 12, 0.0))"
        one.append(y)
    return f"coalesce({', '.join(one)})"


@query("x19", f"{RES} SELECT resume_id, round(coalesce({_years_sql('lower(text[1:500])')}, {_years_sql('text')}), 4) AS years FROM r")
def x19(spark, sf):
    t = F.col("text")
    return resumes(spark, sf).select("resume_id", F.round(F.coalesce(E.stated_years(F.lower(F.substring(t, 1, 500))), E.stated_years(t)), 4).alias("years"))


@query("x19_full")
def x19_full(spark, sf):
    return resumes(spark, sf).select("resume_id", F.round(E.experience_years(F.col("text"), 2025), 4).alias("years"))


SPAN = r"(?i)((?:19|20)\d{2})\s*(?:-|to|–)\s*((?:19|20)\d{2}|present|current|now)"
X20_SQL = f"""CASE WHEN trim(text) = '' THEN 0.0 WHEN len(regexp_extract_all(text, '(?i)(\\d+)\\+?\\s*(?:years|yrs)', 1)) > 0 THEN list_max(list_transform(regexp_extract_all(text, '(?i)(\\d+)\\+?\\s*(?:years|yrs)', 1), lambda y: CAST(y AS DOUBLE)))
  WHEN len(a) > 0 THEN coalesce(list_sum(list_filter(list_transform(list_zip(a, b), lambda z: coalesce(TRY_CAST(z[2] AS INT), 2025) - CAST(z[1] AS INT)), lambda d: d BETWEEN 0 AND 50)), 0)
  WHEN regexp_matches(text, {O.q(E.SENIOR)}) THEN 5.0 WHEN regexp_matches(text, {O.q(E.SEASONED)}) THEN 3.0 ELSE 1.0 END"""


@query("x20", f"{RES} SELECT resume_id, CAST({X20_SQL} AS DOUBLE) AS years FROM (SELECT *, regexp_extract_all(text, {O.q(SPAN)}, 1) AS a, regexp_extract_all(text, {O.q(SPAN)}, 2) AS b FROM r)")
def x20(spark, sf):
    return resumes(spark, sf).select("resume_id", E.years_from_positions(F.col("text"), 2025).alias("years"))


PII_PARTS = f"""pp AS (SELECT resume_id, text, {pick(NAMES, 7, 'resume_id')} AS n, 'maria.lopez' || CAST(resume_id AS STRING) || '@mail.example.com' AS e, '+91 98' || CAST(10000000 + resume_id AS STRING) AS ph,
  'linkedin.com/in/user' || CAST(resume_id AS STRING) AS li, CAST(1 + resume_id % 99 AS STRING) || ' Park Street, Main Road, Pune' AS ad FROM r)"""


def _redacted(spark, sf):
    r = resumes(spark, sf).withColumns({
        "n": F.expr(pick(NAMES, 7, "resume_id")), "e": F.expr("'maria.lopez' || CAST(resume_id AS STRING) || '@mail.example.com'"),
        "ph": F.expr("'+91 98' || CAST(10000000 + resume_id AS STRING)"), "li": F.expr("'linkedin.com/in/user' || CAST(resume_id AS STRING)"),
        "ad": F.expr("CAST(1 + resume_id % 99 AS STRING) || ' Park Street, Main Road, Pune'"),
    })
    return r.select("resume_id", X.redact(*[F.col(c) for c in ("text", "n", "e", "ph", "li", "ad")]).alias("redacted"))


# Steps of the redaction as chained CTEs, one personal value each.
def _redact_ctes() -> str:
    items = ["n", "split_part(n, ' ', 1)", "split_part(n, ' ', 2)", "e", "ph", "li", "ad", "trim(split_part(ad, ',', 1))", "trim(split_part(ad, ',', 2))", "trim(split_part(ad, ',', 3))"]
    ctes, prev = [], "pp"
    for i, item in enumerate(items):
        ctes.append(f"s{i} AS (SELECT * REPLACE (CASE WHEN length({item}) > 3 THEN replace(text, {item}, '[REDACTED]') ELSE text END AS text) FROM {prev})")
        prev = f"s{i}"
    return ", ".join(ctes)


@query("x21", f"{RES}, {PII_PARTS}, {_redact_ctes()} SELECT resume_id, md5(text) AS redacted_md5, (length(text) - length(replace(text, '[REDACTED]', ''))) // 10 AS hits FROM s9")
def x21(spark, sf):
    r = _redacted(spark, sf)
    hits = ((F.length("redacted") - F.length(F.replace("redacted", F.lit("[REDACTED]"), F.lit("")))) / 10).cast("bigint")
    return r.select("resume_id", F.md5("redacted").alias("redacted_md5"), hits.alias("hits"))


@query("n31", f"{RES}, {PII_PARTS}, {_redact_ctes()} SELECT resume_id, md5('SKILLS: ' || n || chr(10) || chr(10) || '# ORIGINAL RESUME TEXT' || chr(10) || text) AS combined_md5 FROM s9")
def n31(spark, sf):
    from vitaspark.plans.ingest import combined_text

    r = _redacted(spark, sf).withColumn("standard", F.concat(F.lit("SKILLS: "), F.expr(pick(NAMES, 7, "resume_id"))))
    return r.select("resume_id", F.md5(combined_text(F.col("standard"), F.col("redacted"))).alias("combined_md5"))


@query("x22")
def x22(spark, sf):
    return resumes(spark, sf).select("resume_id", bars(E.positions(F.col("text")), "positions"))


@query("x23")
def x23(spark, sf):
    return resumes(spark, sf).select("resume_id", E.summary(F.col("text")).alias("summary"))


@query("x24", f"""{RES}, w AS ({' UNION ALL '.join(f'''SELECT resume_id, {i} AS form, text, unnest(range(1, len(regexp_extract_all(text, {O.q(p)})) + 1)) AS k, regexp_extract_all(text, {O.q(p)}) AS m, string_split_regex(text, {O.q(p)}) AS b FROM r''' for i, p in enumerate(E.DEGREE_FORMS))}),
  spots AS (SELECT resume_id, form, k, m[k] AS degree, text, list_sum(list_transform(b[1:k], lambda s: length(s))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda s: length(s))), 0) AS p FROM w),
  win AS (SELECT *, substr(text, CAST(greatest(p - 100, 0) + 1 AS BIGINT), CAST(p + length(degree) + 150 - greatest(p - 100, 0) AS BIGINT)) AS c FROM spots)
  SELECT resume_id, form, k, degree, coalesce(nullif(regexp_extract(c, {O.q(E.INSTITUTION)}), ''), 'Unknown Institution') AS institution, TRY_CAST(nullif(regexp_extract(c, '20[0-2]\\d|19[8-9]\\d'), '') AS INT) AS year FROM win""")
def x24(spark, sf):
    mentions = resumes(spark, sf).select("resume_id", F.explode(E.windowed_education(F.col("text"))).alias("x"))
    return mentions.select("resume_id", "x.form", "x.k", "x.degree", "x.institution", "x.year")


@query("x25")
def x25(spark, sf):
    e = F.transform(E.full_education(F.col("text")), lambda x: F.concat_ws("~", x["degree"], x["school"], x["year"]))
    return resumes(spark, sf).select("resume_id", bars(e, "education"))


X26_SQL = f"""flatten([{', '.join(f'regexp_extract_all(text, {O.q(p)}, 1)' for p in E.COMPANY_FORMS)}])"""


@query("x26", f"""{RES}, c AS (SELECT resume_id, list_filter(list_transform({X26_SQL}, lambda s: {_STRIP('s')}), lambda s: length(s) > 2 AND length(s) < 40) AS l FROM r)
  SELECT resume_id, array_to_string(list_filter(list_filter(l, lambda s, i: list_position(l, s) = i), lambda s: len(list_filter({_list(E.NOT_COMPANIES)}, lambda t: contains(lower(s), t) OR contains(t, lower(s)))) = 0), '|') AS companies FROM c""")
def x26(spark, sf):
    return resumes(spark, sf).select("resume_id", bars(E.company_names(F.col("text")), "companies"))


@query("x27")
def x27(spark, sf):
    return resumes(spark, sf).select("resume_id", bars(E.certifications(F.col("text")), "certifications"))


X28_SQL = f"""CASE WHEN length(text) < 500 THEN 3 ELSE 0 END + CASE WHEN length(text) - length(replace(text, chr(10), '')) < 10 THEN 2 ELSE 0 END
  + CASE WHEN length(regexp_replace(text, '[\\p{{C}}\\p{{Zl}}\\p{{Zp}}\\x{{00a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]', '', 'g')) / CAST(greatest(length(text), 1) AS DOUBLE) < 0.9 THEN 2 ELSE 0 END
  + CASE WHEN {' + '.join(f"CAST(contains(lower(text), {O.q(w)}) AS INT)" for w in X.QUALITY_WORDS)} < 3 THEN 2 ELSE 0 END
  + CASE WHEN regexp_matches(text, '[\\w\\.-]+@[\\w\\.-]+\\.\\w+') THEN 0 ELSE 1 END + CASE WHEN regexp_matches(text, '[\\+\\(]?[0-9][0-9\\-\\(\\) ]{{8,}}[0-9]') THEN 0 ELSE 1 END"""


@query("x28", f"SELECT doc_id, {X28_SQL} AS issues FROM documents")
def x28(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.quality_issues(F.col("text")).alias("issues"))


@query("x29", """SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, ' {2,}', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '[ \\t\\r\\f]+\\n', chr(10), 'g'), '\\n[ \\t\\r\\f]+', chr(10), 'g')) AS clean_md5 FROM pages""")
def x29(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(X.clean_resume(F.col("html"))).alias("clean_md5"))


@query("x29_converted")
def x29_converted(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(X.clean_converted(F.col("text"))).alias("clean_md5"))


_NP = "[\\p{C}\\p{Zl}\\p{Zp}\\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{202f}\\x{205f}\\x{3000}]"


@query("x30", f"""SELECT doc_id, md5(CASE WHEN length(c) > 30000 THEN c[1:30000] || {NL} || {NL} || '[... Text truncated due to length ...]' || {NL} ELSE c END) AS clean_md5 FROM (
  SELECT doc_id, replace(replace(array_to_string(list_transform(string_split(regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '([.!?])\\s+', '\\1' || {NL}, 'g'), {NL}), lambda l: regexp_replace(l, '{_NP}', '', 'g')), {NL}), {NL} || {NL}, {NL}), {NL}, {NL} || {NL}) AS c FROM documents)""")
def x30(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(X.clean_for_model(F.col("text"))).alias("clean_md5"))


_KIND = "CASE " + " ".join(f"WHEN regexp_matches(l, {O.q('(?i)(?:' + p + ')')}) THEN {O.q(k)}" for k, p in E.SECTION_WORDS.items()) + " END"


@query("x31", f"""{RES}, {LINE_SQL}, h AS (SELECT resume_id, pos, l, CASE WHEN length(l) BETWEEN 1 AND 49 THEN {_KIND} END AS kind FROM (SELECT resume_id, pos, trim(translate(line, chr(9) || chr(13), '  ')) AS l FROM ln)),
  g AS (SELECT *, sum(CASE WHEN kind IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY resume_id ORDER BY pos) AS s FROM h)
  SELECT resume_id, CAST(s AS BIGINT) AS section, any_value(l) FILTER (kind IS NOT NULL) AS header, any_value(kind) AS kind,
    md5(regexp_replace(coalesce(string_agg(l, chr(10) ORDER BY pos) FILTER (kind IS NULL), ''), '^\\s+|\\s+$', '', 'g')) AS content_md5 FROM g WHERE s > 0 GROUP BY resume_id, s""")
def x31(spark, sf):
    s = resumes(spark, sf).select("resume_id", F.posexplode(E.sections(F.col("text"))).alias("section", "s"))
    return s.select("resume_id", (F.col("section") + 1).cast("bigint").alias("section"), "s.header", "s.kind", F.md5("s.content").alias("content_md5"))


@query("x31_text")
def x31_text(spark, sf):
    return resumes(spark, sf).select("resume_id", F.md5(E.sectioned(F.col("text"))).alias("text_md5"))


@query("x32")
def x32(spark, sf):
    lead = F.concat(F.lit("RESUME FOR: "), F.col("resume_id").cast("string"), F.lit("\n\n"))
    return resumes(spark, sf).select("resume_id", F.md5(E.priority_text(F.col("text"), lead)).alias("text_md5"))


@query("x33", f"""SELECT doc_id, md5(CASE WHEN length(text) > 20000 THEN text[1:20000] ELSE text END) AS t20000, md5(CASE WHEN length(text) > 5000 THEN text[1:5000] ELSE text END) AS t5000,
  md5(array_to_string(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')[1:512], ' ')) AS words, CAST(floor((8000 - length(lang || source) / 4.0) * 4) AS INT) AS budget FROM documents""")
def x33(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", F.md5(X.cut(t, 20000)).alias("t20000"), F.md5(X.cut(t, 5000)).alias("t5000"), F.md5(X.first_words(t)).alias("words"),
        X.budget_chars(F.length(F.concat("lang", "source"))).alias("budget"),
    )


# Stored responses in the states they come in: fenced, with prose, trailing commas, cut off, or no JSON.
BROKEN = f"""CASE c_custkey % 6 WHEN 0 THEN 'Here you are:' || {NL} || '```json' || {NL} || resp || {NL} || '```' WHEN 1 THEN resp WHEN 2 THEN 'Result: ' || '{{"a":1,"b":"' || c_name || '","c":{{"d":[1,2,]}},}} and {{"z":1}}'
  WHEN 3 THEN '{{"full_name": "' || c_name || '", "email": "x@y.z", "years": 5, "skills": ["a","b"], "summary": "cut o' WHEN 4 THEN 'no json for ' || c_name ELSE '{{"only":1}}' END"""


def broken(spark, sf):
    return spread(table(spark, sf, "customer").selectExpr("c_custkey", "c_name", f"{RESPONSE} AS resp")).selectExpr("c_custkey", f"{BROKEN} AS response")


BROKEN_SQL = f"WITH b AS (SELECT c_custkey, c_name, resp, {BROKEN} AS response FROM (SELECT *, {RESPONSE} AS resp FROM customer))"


@query("x34", f"""{BROKEN_SQL} SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN CASE WHEN json_valid(resp) THEN 'fenced' ELSE m END WHEN 1 THEN CASE WHEN json_valid(resp) THEN 'whole' ELSE m END
  WHEN 2 THEN 'braces' WHEN 3 THEN 'fields' WHEN 4 THEN 'none' ELSE 'braces' END AS method FROM (SELECT *, CASE WHEN len(regexp_extract_all(response, '\\{{[^{{}}]*(?:\\{{[^{{}}]*\\}}[^{{}}]*)*\\}}')) > 0 THEN 'braces' ELSE 'fields' END AS m FROM b)
  WHERE c_custkey % 6 > 1 OR json_valid(resp)""")
def x34(spark, sf):
    done = SV.salvage_responses(broken(spark, sf))
    # the oracle only knows the state of responses it built well-formed
    good = F.try_parse_json("resp").isNotNull()
    known = table(spark, sf, "customer").selectExpr("c_custkey", f"{RESPONSE} AS resp").transform(spread).filter((F.col("c_custkey") % 6 > 1) | good).select("c_custkey")
    return done.join(known, "c_custkey", "left_semi").select("c_custkey", "method")


@query("x34_json")
def x34_json(spark, sf):
    return SV.salvage_responses(broken(spark, sf)).select("c_custkey", "method", SV.n_keys(F.col("json")).alias("keys"))


LISTS = f"CASE WHEN o_orderkey % 3 = 0 THEN 'Skills: [\"' || o_orderstatus || '\", \"' || o_orderpriority || '\"] done' WHEN o_orderkey % 3 = 1 THEN 'I found \"' || o_orderpriority || '\" and \"x\"' ELSE '[\"a\", \"' || o_orderstatus || '\"' END"


@query("x35", f"""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_orderstatus || '|' || o_orderpriority WHEN 1 THEN o_orderpriority || '|x' ELSE 'a|' || o_orderstatus END AS skills FROM orders""")
def x35(spark, sf):
    return table(spark, sf, "orders").selectExpr("o_orderkey", f"{LISTS} AS t").select("o_orderkey", bars(SV.string_array(F.col("t")), "skills"))


@query("x36", f"WITH {JOBS_SQL}, s AS (SELECT jd_id, unnest(required_skills) AS skill FROM jobs) SELECT jd_id, skill, {O.norm('skill')} AS canonical FROM s")
def x36(spark, sf):
    from vitaspark.functions.skills import normalize_skill

    return jobs(spark, sf).select("jd_id", F.explode("required_skills").alias("skill")).withColumn("canonical", normalize_skill(F.col("skill")))


@query("x37", f"WITH {JOBS_SQL}, s AS (SELECT jd_id, unnest(required_skills) AS skill FROM jobs) SELECT jd_id, skill, {O.norm('skill', 'api')} AS canonical FROM s")
def x37(spark, sf):
    from vitaspark.functions.skills import normalize_skill

    return jobs(spark, sf).select("jd_id", F.explode("required_skills").alias("skill")).withColumn("canonical", normalize_skill(F.col("skill"), "api"))


@query("x38", """SELECT doc_id, length(trim(text)) < 200 AS failed, CASE WHEN length(trim(text)) < 200 THEN 'Pat' END AS name, CASE WHEN length(trim(text)) < 200 THEN CAST(doc_id % 20 AS DOUBLE) + CAST(doc_id % 12 AS DOUBLE) / 12 END AS years FROM documents""")
def x38(spark, sf):
    from vitaspark.plans.ingest import minimal_records

    docs = table(spark, sf, "documents").withColumn("filename", F.expr("'Naukri_Pat[' || CAST(doc_id % 20 AS STRING) || 'y_' || CAST(doc_id % 12 AS STRING) || 'm].pdf'"))
    out = minimal_records(docs)
    return out.select("doc_id", F.col("extraction_error").isNotNull().alias("failed"), F.col("file_name_person").alias("name"), F.col("file_years").alias("years"))


@query("x_rates")
def x_rates(spark, sf):
    """Field hit rates per source of the contact job."""
    done = E.extract_contacts(resumes(spark, sf))
    return E.hit_rates(done, ["full_name", "email", "phone_number", "address", "linkedin"], "source")
