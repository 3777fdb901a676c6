"""Normalised records from model responses that are derived from the customer table."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitaspark.operators import normalize as N

from vitaspark.plans.sizing import spread

from . import oracle as O
from .registry import query, table
from .roles import JOBS_SQL, N_SKILLS, SKILLS, jobs, pick

# A stored response per customer; portable SQL. Field shapes vary with the key as they do in stored responses.
_ONE = pick(SKILLS, N_SKILLS, "c_custkey * 7")
_TWO = pick(SKILLS, N_SKILLS, "c_custkey * 11 + 3")
_K = "CAST(c_custkey AS STRING)"
RESPONSE = f"""'{{"resume_id":"' || {_K} || '","full_name":"' || CASE c_custkey % 11 WHEN 0 THEN 'Unknown' WHEN 1 THEN '' ELSE c_name END
 || '","name":' || CASE c_custkey % 3 WHEN 0 THEN 'null' ELSE '"N ' || {_K} || '"' END
 || ',"email":' || CASE c_custkey % 6 WHEN 0 THEN 'null' ELSE '"User' || CAST(c_custkey % 700 AS STRING) || '@Mail.example.com"' END
 || ',"phone_number":' || CASE c_custkey % 5 WHEN 0 THEN '""' ELSE '"+91 98' || CAST(10000000 + c_custkey % 900 AS STRING) || '"' END
 || CASE c_custkey % 4 WHEN 0 THEN ',"linkedin":"linkedin.com/in/u' || {_K} || '"' WHEN 1 THEN ',"linkedin_url":"https://www.linkedin.com/in/v' || {_K} || '"' ELSE '' END
 || ',"summary":' || CASE c_custkey % 4 WHEN 0 THEN '{{"text":"Lead ' || c_mktsegment || '"}}' WHEN 1 THEN '""' ELSE '"Works in ' || c_mktsegment || '"' END
 || ',"total_experience":' || CASE c_custkey % 5 WHEN 0 THEN '"' || CAST(c_nationkey AS STRING) || ' years"' WHEN 1 THEN CAST(c_nationkey AS STRING) || '.5' WHEN 2 THEN 'null' WHEN 3 THEN '"several"' ELSE '"about 7.25 yrs"' END
 || ',"skills":' || CASE c_custkey % 5 WHEN 0 THEN '["Python","python","R","SQL","' || {_ONE} || '","' || {_TWO} || '"]' WHEN 1 THEN '"Java, JAVA , C, Spark , ' || {_ONE} || '"'
   WHEN 2 THEN '{{"values":["Go","go","' || {_ONE} || '"]}}' WHEN 3 THEN 'null' ELSE '["' || {_TWO} || '","Docker","","docker"]' END
 || ',"positions":' || CASE c_custkey % 3 WHEN 0 THEN '["Data Engineer","data engineer","QA"]' WHEN 1 THEN '"Manager, Analyst"' ELSE '[]' END
 || CASE c_custkey % 2 WHEN 0 THEN ',"certifications":["AWS","PMP"]' ELSE '' END
 || ',"companies":' || CASE c_custkey % 4 WHEN 0 THEN '[{{"name":"Acme","role":"Dev","description":"built","duration":"Jan 2020 - Dec 2022","technologies":["a","b"]}},{{"name":"ACME","duration":"2010"}},{{"name":"Globex' || CAST(c_custkey % 7 AS STRING) || '","role":"QA","duration":"05/2015-06/2018","technologies":"x, y"}}]'
   WHEN 1 THEN '[{{"name":"Initech","duration":"March 2011 to Foo 2014 then Present"}},{{"role":"nameless"}},"text",{{"name":"Umbrella' || CAST(c_custkey % 9 AS STRING) || '","duration":"2020 - Present","description":"ran it"}}]' WHEN 2 THEN '[]' ELSE 'null' END
 || ',"education":' || CASE c_custkey % 3 WHEN 0 THEN '[{{"degree":"B.Tech","institution":"State","year":"2010-2014"}},{{"degree":"me","institution":"Unknown Institution"}},{{"degree":"B.Tech","institution":"State","year":2012}},{{"institution":"X"}}]'
   WHEN 1 THEN '[{{"degree":"MBA","institution":"School ' || CAST(c_custkey % 8 AS STRING) || '","year":' || CAST(1990 + c_nationkey AS STRING) || '}},{{"degree":"BSc","institution":"","year":"n/a"}}]' ELSE '"none"' END
 || ',"projects":' || CASE c_custkey % 4 WHEN 0 THEN '[{{"name":"P' || {_K} || '","description":"d","role":"r","metrics":"10%","technologies":"t1, t2","duration_months":"6 months"}},"x"]' WHEN 1 THEN '[{{"name":"Q","duration_months":12,"technologies":["u"]}}]' ELSE '[]' END
 || ',"achievements":' || CASE c_custkey % 3 WHEN 0 THEN '[{{"type":"award","description":"Best ' || c_mktsegment || '","metrics":"1st"}},7]' ELSE '[]' END
 || ',"processing_time":1.5,"file_type":"' || CASE c_custkey % 2 WHEN 0 THEN 'pdf' ELSE 'docx' END || '","original_filename":"Naukri_Pat' || CASE c_custkey % 3 WHEN 0 THEN '[' || CAST(c_nationkey AS STRING) || 'y_3m].pdf' ELSE '.pdf' END || '"'
 || CASE c_custkey % 13 WHEN 12 THEN ',,' ELSE '' END || '}}'"""


def responses(spark, sf):
    # the spread keeps this long derivation out of the projections that read it
    return table(spark, sf, "customer").selectExpr("c_custkey", f"{RESPONSE} AS response").transform(spread)


def records(spark, sf):
    out = N.normalize_responses(responses(spark, sf), keep=["c_custkey"])
    return out.withColumn("resume_id", F.col("c_custkey").cast("string"))


def _dedup(items: str, key: str) -> str:
    """First of each key in list order, by list position."""
    keys = f"list_transform({items}, lambda e: {key.format('e')})"
    return f"list_filter({items}, lambda e, i: list_position({keys}, {key.format('e')}) = i)"


_S = lambda f: f"json_extract_string(j, '$.{f}')"


def _list_sql(f: str) -> str:
    items = f"""CASE json_type(j, '$.{f}') WHEN 'ARRAY' THEN CAST(json_extract(j, '$.{f}') AS VARCHAR[])
      WHEN 'OBJECT' THEN CAST(json_extract(j, '$.{f}.values') AS VARCHAR[])
      WHEN 'VARCHAR' THEN list_transform(string_split({_S(f)}, ','), lambda s: trim(s)) ELSE [] END"""
    return _dedup(f"list_filter({items}, lambda s: length(s) > 1)", "lower({})")


def _tech(e: str) -> str:
    return f"""CASE json_type({e}, '$.technologies') WHEN 'ARRAY' THEN CAST(json_extract({e}, '$.technologies') AS VARCHAR[])
      WHEN 'VARCHAR' THEN list_transform(string_split(json_extract_string({e}, '$.technologies'), ','), lambda s: trim(s)) ELSE [] END"""


def _duration(d: str) -> str:
    m = f"regexp_extract_all({d}, '(\\w+)\\s+(\\d{{4}})', 1)"
    y = f"regexp_extract_all({d}, '(\\w+)\\s+(\\d{{4}})', 2)"
    months = "MAP {'jan':'01','feb':'02','mar':'03','apr':'04','may':'05','jun':'06','jul':'07','aug':'08','sep':'09','oct':'10','nov':'11','dec':'12'}"
    month = lambda w, default: f"coalesce({months}[lower({w})[1:3]], '{default}')"
    return f"""CASE WHEN regexp_matches({d}, '^\\d{{2}}/\\d{{4}}-\\d{{2}}/\\d{{4}}') THEN {d} WHEN len({m}) >= 2 THEN
      {month(m + '[1]', '01')} || '/' || {y}[1] || '-' || {month(m + '[-1]', '12')} || '/' || {y}[-1] ELSE {d} END"""


def _objs(f: str) -> str:
    return f"""list_filter(CASE WHEN json_type(j, '$.{f}') = 'ARRAY' THEN CAST(json_extract(j, '$.{f}') AS JSON[]) ELSE [] END, lambda e: json_type(e) = 'OBJECT')"""


def _str(e: str, f: str) -> str:
    return f"json_extract_string({e}, '$.{f}')"


NORM_SQL = f"""resp AS (SELECT c_custkey, {RESPONSE} AS response FROM customer),
js AS (SELECT c_custkey, CASE WHEN json_valid(response) THEN CAST(response AS JSON) END AS j FROM resp),
co AS (SELECT c_custkey, list_transform({_objs('companies')}, lambda e: {{'name': {_str('e', 'name')}, 'role': {_str('e', 'role')}, 'description': {_str('e', 'description')},
    'duration': {_duration(_str('e', 'duration'))}, 'technologies': {_tech('e')}}}) AS c FROM js),
co2 AS (SELECT c_custkey, {_dedup("list_filter(c, lambda e: coalesce(e.name, '') <> '')", "lower({}.name)")} AS c FROM co),
co3 AS (SELECT c_custkey, list(e ORDER BY coalesce(TRY_CAST(nullif(regexp_extract(e.duration, '(\\d{{4}})', 1), '') AS INT), 0) DESC, i) AS companies
  FROM (SELECT c_custkey, unnest(c) AS e, unnest(range(1, len(c) + 1)) AS i FROM co2) GROUP BY c_custkey),
nrm AS (SELECT js.c_custkey, CAST(js.c_custkey AS VARCHAR) AS resume_id,
  coalesce(CASE WHEN {_S('full_name')} NOT IN ('Unknown', 'unknown', 'N/A', 'Not Available', 'Not Provided', '') THEN {_S('full_name')} END, nullif({_S('name')}, '')) AS name,
  {_S('email')} AS email, {_S('phone_number')} AS phone_number, {_S('address')} AS address,
  coalesce(nullif({_S('linkedin')}, ''), nullif({_S('linkedin_url')}, '')) AS linkedin_url,
  CASE WHEN json_type(j, '$.summary') = 'OBJECT' THEN {_S('summary.text')} ELSE {_S('summary')} END AS summary,
  CAST(coalesce(TRY_CAST({_S('total_experience')} AS DOUBLE), TRY_CAST(nullif(regexp_extract({_S('total_experience')}, '(\\d+\\.?\\d*)', 1), '') AS DOUBLE), 0.0) AS DOUBLE) AS total_experience,
  {_list_sql('skills')} AS skills, {_list_sql('positions')} AS positions, {_list_sql('certifications')} AS certifications, {_list_sql('industries')} AS industries,
  coalesce(co3.companies, []) AS companies,
  {_dedup(f"list_filter(list_transform({_objs('education')}, lambda e: {{'degree': {_str('e', 'degree')}, 'institution': {_str('e', 'institution')}, 'year': CASE WHEN json_type(e, '$.year') IS NOT NULL THEN coalesce(TRY_CAST({_str('e', 'year')} AS INT), TRY_CAST(nullif(regexp_extract({_str('e', 'year')}, '(\\d{{4}})', 1), '') AS INT), 0) END}}), lambda e: coalesce(e.degree, '') <> '' AND NOT (e.degree IN ('me', 'Me', 'be', 'Be') AND coalesce(e.institution, '') = 'Unknown Institution'))", "{0}.degree || '-' || coalesce({0}.institution, '')")} AS education,
  list_transform({_objs('projects')}, lambda e: {{'name': {_str('e', 'name')}, 'description': {_str('e', 'description')}, 'role': {_str('e', 'role')}, 'metrics': {_str('e', 'metrics')}, 'technologies': {_tech('e')},
    'duration_months': coalesce(TRY_CAST(nullif(regexp_extract({_str('e', 'duration_months')}, '(\\d+)', 1), '') AS INT), 0)}}) AS projects,
  list_transform({_objs('achievements')}, lambda e: {{'type': {_str('e', 'type')}, 'description': {_str('e', 'description')}, 'metrics': {_str('e', 'metrics')}}}) AS achievements,
  {_S('file_type')} AS file_type, {_S('original_filename')} AS original_filename, TRY_CAST({_S('processing_time')} AS DOUBLE) AS processing_time
  FROM js LEFT JOIN co3 USING (c_custkey))"""
W = f"WITH {NORM_SQL}"
NL_SQL = "chr(10)"


def bars(name: str):
    return F.array_join(name, "|").alias(name)


def _rows(column: str, *fields: str):
    """An array of structs as text, one part per element."""
    part = lambda x: F.concat_ws("~", *[F.coalesce(x[f].cast("string"), F.lit("-")) if f != "technologies" else F.array_join(x[f], "+") for f in fields])
    return F.array_join(F.transform(column, part), "|").alias(column)


def _rows_sql(column: str, *fields: str) -> str:
    part = " || '~' || ".join(f"array_to_string(x.{f}, '+')" if f == "technologies" else f"coalesce(CAST(x.{f} AS VARCHAR), '-')" for f in fields)
    return f"array_to_string(list_transform({column}, lambda x: {part}), '|') AS {column}"


@query("n1", f"{W} SELECT resume_id, name, email, total_experience, len(skills) AS n_skills, len(companies) AS n_companies, len(education) AS n_education FROM nrm")
def n1(spark, sf):
    size = lambda c: F.size(c).cast("bigint").alias("n_" + c)
    return records(spark, sf).select("resume_id", "name", "email", "total_experience", size("skills"), size("companies"), size("education"))


@query("n2", f"{W} SELECT resume_id, name, linkedin_url FROM nrm")
def n2(spark, sf):
    return records(spark, sf).select("resume_id", "name", "linkedin_url")


@query("n3", f"{W} SELECT resume_id, total_experience FROM nrm")
def n3(spark, sf):
    return records(spark, sf).select("resume_id", "total_experience")


@query("n4", f"{W} SELECT resume_id, array_to_string(skills, '|') AS skills, array_to_string(positions, '|') AS positions, array_to_string(certifications, '|') AS certifications FROM nrm")
def n4(spark, sf):
    return records(spark, sf).select("resume_id", bars("skills"), bars("positions"), bars("certifications"))


COMPANY = ("name", "role", "description", "duration", "technologies")


@query("n5", f"{W} SELECT resume_id, {_rows_sql('companies', *COMPANY)} FROM nrm")
def n5(spark, sf):
    return records(spark, sf).select("resume_id", _rows("companies", *COMPANY))


@query("n6", f"{W} SELECT c_custkey, i AS pos, {_duration('d')} AS duration FROM (SELECT c_custkey, unnest(list_transform({_objs('companies')}, lambda e: {_str('e', 'duration')})) AS d, unnest(range(0, len({_objs('companies')}))) AS i FROM js)")
def n6(spark, sf):
    v = F.try_parse_json("response")
    found = responses(spark, sf).select("c_custkey", F.posexplode(N._objects(v, "companies")).alias("pos", "e"))
    return found.select("c_custkey", F.col("pos").cast("bigint").alias("pos"), N.standard_duration(N.read(F.col("e"), "duration")).alias("duration"))


@query("n7", f"{W} SELECT resume_id, {_rows_sql('companies', 'name', 'duration')} FROM nrm")
def n7(spark, sf):
    return records(spark, sf).select("resume_id", _rows("companies", "name", "duration"))


@query("n8", f"{W} SELECT resume_id, {_rows_sql('education', 'degree', 'institution', 'year')} FROM nrm")
def n8(spark, sf):
    return records(spark, sf).select("resume_id", _rows("education", "degree", "institution", "year"))


@query("n9", f"{W} SELECT resume_id, {_rows_sql('achievements', 'type', 'description', 'metrics')} FROM nrm")
def n9(spark, sf):
    return records(spark, sf).select("resume_id", _rows("achievements", "type", "description", "metrics"))


PROJECT = ("name", "description", "role", "metrics", "technologies", "duration_months")


@query("n10", f"{W} SELECT resume_id, {_rows_sql('projects', *PROJECT)} FROM nrm")
def n10(spark, sf):
    return records(spark, sf).select("resume_id", _rows("projects", *PROJECT))


@query("n11", f"{W} SELECT resume_id, file_type, original_filename, processing_time FROM nrm")
def n11(spark, sf):
    return records(spark, sf).select("resume_id", "file_type", "original_filename", F.col("processing_time").cast("double").alias("processing_time"))


@query("n12", f"""{W} SELECT resume_id, coalesce(summary, '') AS summary, array_to_string(list_transform(skills, lambda s: lower(s)), '|') AS skills, {_rows_sql('companies', 'name')},
  len(list_filter(projects, lambda p: coalesce(p.name, '') <> '' OR coalesce(p.description, '') <> '')) AS n_projects FROM nrm""")
def n12(spark, sf):
    docs = N.index_document(records(spark, sf))
    return docs.select("resume_id", "summary", bars("skills"), _rows("companies", "name"), F.size("projects").cast("bigint").alias("n_projects"))


@query("n14", f"{W} SELECT resume_id, summary, total_experience, array_to_string(skills, '|') AS skills, {_rows_sql('education', 'degree')} FROM nrm")
def n14(spark, sf):
    return N.without_pii(records(spark, sf)).select("resume_id", "summary", "total_experience", bars("skills"), _rows("education", "degree"))


@query("n15", f"""{W} SELECT resume_id, coalesce(nullif(name, ''), 'Not provided') AS name, coalesce(nullif(phone_number, ''), 'Not provided') AS phone_number,
  CAST(CAST(total_experience AS DECIMAL(20,4)) AS VARCHAR) AS total_experience,
  CASE WHEN len(positions) > 0 THEN array_to_string(positions, '|') ELSE 'Not provided' END AS positions FROM nrm""")
def n15(spark, sf):
    out = N.for_export(records(spark, sf))
    return out.select("resume_id", "name", "phone_number", F.col("total_experience").cast("string").alias("total_experience"), bars("positions"))


@query("n16", f"""{W} SELECT resume_id, array_to_string(list_filter(list_transform(companies, lambda c: c.name), lambda s: coalesce(s, '') <> ''), '|') AS company_names,
  array_to_string(list_filter(list_transform(companies, lambda c: c.role), lambda s: coalesce(s, '') <> ''), '|') AS roles,
  array_to_string(list_filter(list_transform(education, lambda c: c.institution), lambda s: coalesce(s, '') <> ''), '|') AS institutions,
  array_to_string(list_filter(list_transform(education, lambda c: c.degree), lambda s: coalesce(s, '') <> ''), '|') AS degrees FROM nrm""")
def n16(spark, sf):
    return N.parallel_arrays(records(spark, sf)).select("resume_id", bars("company_names"), bars("roles"), bars("institutions"), bars("degrees"))


@query("n17", """SELECT c_custkey, coalesce(CASE WHEN c_custkey % 4 <> 0 THEN c_name END, 'Not provided') AS name, coalesce(CASE WHEN c_custkey % 3 <> 0 THEN '+1 ' || c_custkey END, 'Not provided') AS phone_number,
  coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END, 0.0) AS total_years_experience, 'Not provided' AS email FROM customer""")
def n17(spark, sf):
    old = table(spark, sf, "customer").selectExpr(
        "c_custkey", "CASE WHEN c_custkey % 4 <> 0 THEN c_name END AS full_name",
        "CASE WHEN c_custkey % 3 <> 0 THEN '+1 ' || CAST(c_custkey AS STRING) END AS phone",
        "CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END AS total_experience",
    )
    return N.rename_legacy(old).select("c_custkey", "name", "phone_number", "total_years_experience", "email")


@query("n18", """SELECT o_custkey, o_orderkey, o_orderstatus || '|' || o_orderpriority || '|' || CAST(o_orderkey % 7 AS VARCHAR) AS skills FROM orders""")
def n18(spark, sf):
    groups = F.create_map(
        F.lit("status"), F.array("o_orderstatus"), F.lit("other"), F.array(F.col("o_orderpriority"), (F.col("o_orderkey") % 7).cast("string"))
    )
    return table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.array_join(N.flatten_skill_groups(groups), "|").alias("skills"))


@query("n19", f"{W} SELECT resume_id, array_to_string(skills, ', ') AS skills, array_to_string(positions, '|') AS position_titles, total_experience AS years_experience FROM nrm")
def n19(spark, sf):
    return N.search_metadata(records(spark, sf)).select("resume_id", "skills", bars("position_titles"), "years_experience")


@query("n20", f"{W} SELECT resume_id, name AS contact_name, linkedin_url AS contact_linkedin, len(companies) AS experience, array_to_string(skills, '|') AS skills, original_filename AS source_file FROM nrm")
def n20(spark, sf):
    return N.nested_export(records(spark, sf)).select(
        "resume_id", F.col("contact.name").alias("contact_name"), F.col("contact.linkedin").alias("contact_linkedin"),
        F.size("experience").cast("bigint").alias("experience"), F.array_join("skills.name", "|").alias("skills"), F.col("metadata.source_file").alias("source_file"),
    )


@query("n21", f"""{W}, t AS (SELECT *, array_to_string(list_transform(companies, lambda c: c.name)[1:2], ', ') AS w, array_to_string(positions[1:2], ', ') AS p,
    CASE WHEN len(skills) > 0 THEN array_to_string(skills[1:5], ', ') ELSE 'various skills' END AS h FROM nrm)
  SELECT resume_id, CASE WHEN coalesce(summary, '') NOT IN ('', 'Not provided') THEN summary
    WHEN w <> '' AND p <> '' THEN 'Professional with ' || total_experience || ' years of experience as ' || p || ' at ' || w || ', specializing in ' || h || '.'
    WHEN p <> '' THEN 'Professional with ' || total_experience || ' years of experience as ' || p || ', with expertise in ' || h || '.'
    WHEN w <> '' THEN 'Professional with ' || total_experience || ' years of experience at ' || w || ', with skills in ' || h || '.'
    ELSE 'Professional with expertise in ' || h || ' looking to leverage technical skills in a challenging role.' END AS summary,
    NOT (coalesce(summary, '') NOT IN ('', 'Not provided') AND len(skills) > 0 AND len(positions) > 0 AND len(industries) > 0) AS synthetic FROM t""")
def n21(spark, sf):
    return N.fill_mandatory(records(spark, sf)).select("resume_id", "summary", "synthetic")


_MISS = """list_filter([CASE WHEN coalesce(name, '') = '' THEN 'name' END, CASE WHEN coalesce(email, '') = '' THEN 'email' END, CASE WHEN coalesce(phone_number, '') = '' THEN 'phone_number' END,
  CASE WHEN coalesce(linkedin_url, '') = '' THEN 'linkedin_url' END, CASE WHEN coalesce(summary, '') = '' THEN 'summary' END, CASE WHEN len(companies) = 0 THEN 'companies' END,
  CASE WHEN len(skills) = 0 THEN 'skills' END, CASE WHEN len(education) = 0 THEN 'education' END, CASE WHEN total_experience = 0 THEN 'total_years_experience' END], lambda s: s IS NOT NULL)"""


@query("n22", f"{W} SELECT resume_id, CASE WHEN len({_MISS}) = 0 THEN 'None' ELSE array_to_string({_MISS}, ', ') END AS missing_fields, NOT list_has_any({_MISS}, ['name','email','phone_number','linkedin_url','companies','education','skills']) AS is_valid FROM nrm")
def n22(spark, sf):
    return N.completeness(records(spark, sf)).select("resume_id", "missing_fields", "is_valid")


@query("m5", f"{W} SELECT resume_id, array_to_string({_MISS}, ', ') AS missing_fields FROM nrm WHERE list_has_any({_MISS}, ['name','email','phone_number','linkedin_url','companies','education','skills'])")
def m5(spark, sf):
    return N.completeness(records(spark, sf)).filter(~F.col("is_valid")).select("resume_id", "missing_fields")


@query("n23", f"{W} SELECT resume_id, nullif(regexp_extract(original_filename, 'Naukri_([A-Za-z]+)\\[(\\d+)y_(\\d+)m\\]', 1), '') AS name, CAST(nullif(regexp_extract(original_filename, 'Naukri_([A-Za-z]+)\\[(\\d+)y_(\\d+)m\\]', 2), '') AS DOUBLE) + 3.0 / 12 AS years FROM nrm")
def n23(spark, sf):
    name, years = N.filename_metadata(F.col("original_filename"))
    return records(spark, sf).select("resume_id", name.alias("name"), years.alias("years"))


@query("n24", "SELECT page_id, CASE WHEN contains(f, '_') THEN split_part(f, '_', 1) ELSE regexp_replace(f, '\\.[^.]*$', '') END AS name FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN split_part(url, '/', 3) || '_cv.pdf' ELSE split_part(url, '/', 3) || '.pdf' END AS f FROM pages)")
def n24(spark, sf):
    host = F.split_part("url", F.lit("/"), F.lit(3))
    name = F.when(F.col("page_id") % 2 == 0, F.concat(host, F.lit("_cv.pdf"))).otherwise(F.concat(host, F.lit(".pdf")))
    return table(spark, sf, "pages").select("page_id", N.name_from_filename(name).alias("name"))


@query("m3", f"""{W} SELECT resume_id, coalesce(nullif(name, ''), CASE WHEN contains(original_filename, '_') THEN split_part(original_filename, '_', 1) ELSE regexp_replace(original_filename, '\\.[^.]*$', '') END) AS name FROM nrm""")
def m3(spark, sf):
    return records(spark, sf).select("resume_id", F.coalesce(N.blank_to_null(F.col("name")), N.name_from_filename(F.col("original_filename"))).alias("name"))


@query("n25", f"""WITH {JOBS_SQL} SELECT jd_id, 'Job Title: ' || job_title || {NL_SQL} || {NL_SQL} || 'Required Skills:' || {NL_SQL} || array_to_string(list_transform(required_skills, lambda s: '- ' || trim(s)), {NL_SQL})
  || {NL_SQL} || {NL_SQL} || 'Experience: ' || required_experience || '+ years' || {NL_SQL} || {NL_SQL} || 'Responsibilities:' || {NL_SQL} || '- ' || trim(split_part(text, '.', 1))
  || {NL_SQL} || {NL_SQL} || 'Qualifications:' || {NL_SQL} || array_to_string(list_transform(nice_to_have_skills, lambda s: '- ' || trim(s)), {NL_SQL}) || {NL_SQL} || {NL_SQL} || 'Additional Information:' || {NL_SQL} || coalesce(industry, '') || {NL_SQL} AS text FROM jobs""")
def n25(spark, sf):
    j = jobs(spark, sf).select(
        "jd_id", F.col("job_title").alias("title"), F.col("required_skills").alias("skills"), F.col("required_experience").alias("experience"),
        F.array(F.split_part("text", F.lit("."), F.lit(1))).alias("responsibilities"), F.col("nice_to_have_skills").alias("qualifications"),
        F.col("industry").alias("additional_info"),
    )
    return j.select("jd_id", N.job_text().alias("text"))


@query("n26", f"""WITH {JOBS_SQL} SELECT jd_id, CASE WHEN jd_id % 3 = 0 THEN 'Model Title' ELSE job_title END AS job_title, CASE WHEN jd_id % 2 = 0 THEN 4.5 ELSE required_experience END AS required_experience,
  CASE WHEN jd_id % 4 = 0 THEN 'Rust' ELSE array_to_string(required_skills, '|') END AS required_skills FROM jobs""")
def n26(spark, sf):
    info = jobs(spark, sf).select("jd_id", "job_title", "required_experience", "required_skills")
    model = info.selectExpr(
        "jd_id", "CASE WHEN jd_id % 3 = 0 THEN 'Model Title' ELSE '' END AS job_title", "CASE WHEN jd_id % 2 = 0 THEN 4.5D ELSE 0D END AS required_experience",
        "CASE WHEN jd_id % 4 = 0 THEN array('Rust') ELSE array() END AS required_skills",
    )
    return N.merge_job_info(info, model).withColumn("required_skills", F.array_join("required_skills", "|"))


NL = NL_SQL
STUDY = "array_to_string(list_filter(list_transform(education, lambda e: concat_ws(' from ', nullif(e.degree, ''), nullif(e.institution, ''))), lambda s: s <> ''), ', ')"
STANDARD = f"""{NL} || 'SKILLS: ' || array_to_string(skills, ', ') || {NL} || 'EXPERIENCE: ' || total_experience || ' years' || {NL} || 'POSITIONS: ' || array_to_string(positions, ', ')
  || {NL} || 'EDUCATION: ' || {STUDY} || {NL} || 'TECHNOLOGIES: ' || array_to_string(flatten(list_transform(companies, lambda c: c.technologies)), ', ') || {NL} || 'SUMMARY: ' || coalesce(summary, '') || {NL}"""


@query("n27", f"{W} SELECT resume_id, {STANDARD} AS text FROM nrm")
def n27(spark, sf):
    r = records(spark, sf)
    return r.select("resume_id", N.standard_text(r).alias("text"))


@query("n28", f"""WITH {JOBS_SQL} SELECT jd_id, 'Skills: ' || array_to_string(required_skills, ', ') || {NL} || 'Experience: ' || required_experience || ' years' || {NL} || 'Position: ' || job_title || {NL} || 'Summary: ' || text AS text FROM jobs""")
def n28(spark, sf):
    j = jobs(spark, sf).withColumnRenamed("text", "summary")
    return j.select("jd_id", N.short_text(j).alias("text"))


def _val(c: str, default: str = "Not specified") -> str:
    return f"coalesce(nullif({c}, ''), '{default}')"


@query("n29", f"""{W} SELECT resume_id, concat_ws({NL}, '# PROFESSIONAL PROFILE', {NL} || '## PROFESSIONAL SUMMARY', {_val('summary', 'No summary available')}, {NL} || '## EXPERIENCE OVERVIEW',
  'Total Experience: ' || total_experience || ' years', CASE WHEN len(positions) > 0 THEN 'Positions Held: ' || array_to_string(positions, ', ') END, {NL} || '## TECHNICAL COMPETENCIES',
  CASE WHEN len(skills) > 0 THEN 'Skills: ' || array_to_string(skills, ', ') END, CASE WHEN len(certifications) > 0 THEN 'Certifications: ' || array_to_string(certifications, ', ') END,
  CASE WHEN len(industries) > 0 THEN 'Industries: ' || array_to_string(industries, ', ') END, {NL} || '## PROFESSIONAL EXPERIENCE DETAILS',
  CASE WHEN len(companies) > 0 THEN array_to_string(list_transform(companies, lambda c: {NL} || '### ' || {_val('c.name')} || {NL} || 'Duration: ' || {_val('c.duration')} || {NL} || 'Role: ' || {_val('c.role')} || {NL} || 'Technologies: ' || array_to_string(c.technologies, ', ') || {NL} || 'Key Contributions: ' || {_val('c.description')}), {NL}) END,
  CASE WHEN len(projects) > 0 THEN {NL} || '## KEY PROJECTS' END,
  CASE WHEN len(projects) > 0 THEN array_to_string(list_transform(projects, lambda p: {NL} || '### ' || {_val('p.name')} || {NL} || 'Duration: ' || p.duration_months || ' months' || {NL} || 'Role: ' || {_val('p.role')} || {NL} || 'Technologies: ' || array_to_string(p.technologies, ', ') || {NL} || 'Achievement: ' || {_val('p.metrics')} || {NL} || 'Description: ' || {_val('p.description')}), {NL}) END,
  {NL} || '## EDUCATION & ACHIEVEMENTS',
  CASE WHEN len(education) > 0 THEN array_to_string(list_transform(education, lambda e: {NL} || '- ' || {_val('e.degree')} || ' from ' || {_val('e.institution')} || ' (' || CASE WHEN coalesce(e.year, 0) <> 0 THEN CAST(e.year AS VARCHAR) ELSE 'Year not specified' END || ')'), {NL}) END,
  CASE WHEN len(achievements) > 0 THEN {NL} || '### Notable Achievements:' END,
  CASE WHEN len(achievements) > 0 THEN array_to_string(list_transform(achievements, lambda a: '- ' || {_val('a.description')} || ' [' || {_val('a.type')} || '] (' || {_val('a.metrics')} || ')'), {NL}) END) AS text FROM nrm""")
def n29(spark, sf):
    return records(spark, sf).select("resume_id", N.sectioned_text().alias("text"))


@query("n30", f"""{W} SELECT resume_id, array_to_string(list_concat(list_concat(list_concat(list_concat(
    list_filter([CASE WHEN coalesce(name, '') <> '' THEN 'Name: ' || name END, CASE WHEN coalesce(summary, '') <> '' THEN 'Summary: ' || summary END], lambda s: s IS NOT NULL),
    list_transform(range(1, least(len(positions), len(companies)) + 1), lambda i: 'Experience: ' || positions[i] || ' at ' || companies[i].name)),
    list_transform(education, lambda e: 'Education: ' || e.degree || ' from ' || coalesce(e.institution, '') || ' ' || CASE WHEN coalesce(e.year, 0) <> 0 THEN '(' || e.year || ')' ELSE '' END)),
    list_transform(projects, lambda p: 'Project: ' || coalesce(p.name, '') || ': ' || coalesce(p.description, ''))),
    CASE WHEN len(certifications) > 0 THEN ['Certifications: ' || array_to_string(certifications, ', ')] ELSE [] END), {NL}) AS text FROM nrm""")
def n30(spark, sf):
    return records(spark, sf).select("resume_id", N.paired_text().alias("text"))


@query("n32", f"WITH {JOBS_SQL} SELECT jd_id, {O.FOCUSED} AS query_text FROM jobs")
def n32(spark, sf):
    from vitaspark.plans.match import focused_query

    return jobs(spark, sf).select("jd_id", focused_query().alias("query_text"))


@query("n33", f"""{W} SELECT resume_id, 'Skills: ' || array_to_string(skills[1:10], ', ') || CASE WHEN len(skills) > 10 THEN ' and ' || (len(skills) - 10) || ' more' ELSE '' END || {NL} || 'Experience: ' || total_experience || ' years' || {NL}
  || 'Positions: ' || array_to_string(positions, ', ') || {NL} || 'Education: ' || array_to_string(list_filter(list_transform(education, lambda e: coalesce(e.degree, '') || ' from ' || coalesce(e.institution, '')), lambda s: s <> ' from '), '; ') AS text FROM nrm""")
def n33(spark, sf):
    r = records(spark, sf)
    return r.select("resume_id", N.narrative(r).alias("text"))


@query("n34", "SELECT doc_id, md5(text) AS text_md5, md5(regexp_replace(lower(trim(text)), '\\s+', ' ', 'g')) AS folded_md5, md5(text || ':10:hybrid') AS query_md5, count(*) OVER (PARTITION BY text) AS copies FROM documents")
def n34(spark, sf):
    docs = N.work_keys(table(spark, sf, "documents"))
    copies = docs.groupBy("text_md5").agg(F.count("*").alias("copies"))
    from vitaspark.plans.sizing import lookup

    return lookup(docs, copies, "text_md5").select("doc_id", "text_md5", "folded_md5", "query_md5", "copies")


@query("f8", f"{W} SELECT resume_id FROM nrm WHERE coalesce(nullif(email, ''), nullif(phone_number, '')) IS NOT NULL")
def f8(spark, sf):
    from vitaspark.operators.identity import has_contact

    return records(spark, sf).filter(has_contact()).select("resume_id")


@query("o2", f"{W} SELECT resume_id, array_to_string(list_transform(companies, lambda c: c.name), '|') AS ordered FROM nrm")
def o2(spark, sf):
    return records(spark, sf).select("resume_id", F.array_join(F.transform(N.latest_first(F.col("companies")), lambda c: c["name"]), "|").alias("ordered"))


@query("s4", f"{W} SELECT resume_id, array_to_string({_dedup('list_concat(skills, list_transform(skills, lambda s: upper(s)))', 'lower({})')}, '|') AS skills FROM nrm")
def s4(spark, sf):
    from vitaspark.functions.arrays import first_wins

    doubled = F.concat("skills", F.transform("skills", F.upper))
    return records(spark, sf).select("resume_id", F.array_join(first_wins(doubled), "|").alias("skills"))
