"""Pieces of DuckDB SQL the oracles share. Written from the operator's meaning, not from the Spark plan."""

from __future__ import annotations

from vitaspark.functions.lexicon import API_ALIASES, BATCH_ALIASES

from .roles import CANDIDATES_SQL, JOBS_SQL

NON_ASCII = "êßñéèíçäöüó"  # letters of the supplied texts; DuckDB counts edits in bytes
TOKENS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def tokens(expr: str) -> str:
    return TOKENS.format(expr)


def strip_marks(expr: str) -> str:
    return f"translate(lower(trim({expr})), '-/.(),', '  ')"


def _map(entries: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in entries.items()) + "}"


def _plain(name: str) -> str:
    return name.replace(".", "").replace("-", " ").replace("/", " ")


BATCH_SQL_MAP = _map({_plain(k): v for k, v in BATCH_ALIASES.items()})
API_SQL_MAP = _map(API_ALIASES)


def norm(expr: str, profile: str = "batch") -> str:
    if profile == "api":
        return f"coalesce({API_SQL_MAP}[lower(trim({expr}))], lower(trim({expr})))"
    clean = strip_marks(expr)
    return f"coalesce({BATCH_SQL_MAP}[{clean}], {clean})"


def norm_list(expr: str, profile: str = "batch") -> str:
    return f"list_transform({expr}, lambda sk: {norm('sk', profile)})"


def words(expr: str) -> str:
    return f"list_distinct(list_filter(string_split_regex({expr}, '\\s+'), lambda wd: wd <> ''))"


def skill_score(jd: str, res: str) -> str:
    """Match score of two normalised lists."""
    common = f"len(list_intersect({words('w')}, {words('h')}))"
    weight = f"""CASE WHEN length(w) < 4 OR length(h) < 4 THEN 0.0 WHEN contains(h, w) THEN 0.75 WHEN contains(w, h) THEN 0.5
      WHEN contains(w, ' ') AND contains(h, ' ') AND ({common} >= 2 OR ({common} = 1 AND len({words('w')}) <= 2)) THEN 0.5 ELSE 0.0 END"""
    exact = f"len(list_filter({jd}, lambda x: list_contains({res}, x)))"
    partial = f"""coalesce(list_sum(list_transform(list_filter({jd}, lambda x: NOT list_contains({res}, x)),
      lambda w: coalesce(list_filter(list_transform({res}, lambda h: {weight}), lambda v: v > 0)[1], 0.0))), 0.0)"""
    total = f"(({exact} + {partial}) * 100.0 / len({jd}))"
    return f"""CASE WHEN len({jd}) > 0 AND len({res}) > 0 THEN
      {rnd(f"CASE WHEN {exact} >= len({jd}) * 0.7 THEN least({total} * 1.15, 100.0) ELSE {total} END", 2)} ELSE 0.0 END"""


def rnd(expr: str, digits: int) -> str:
    """Round half to even on the double, as the engine does."""
    return f"(round_even(CAST({expr} AS DOUBLE) * CAST({10**digits} AS DOUBLE), 0) / CAST({10**digits} AS DOUBLE))"


def exp_score(have: str, need: str) -> str:
    return f"CASE WHEN {have} >= {need} THEN 100.0 WHEN {need} > 0 THEN {rnd(f"{have} / {need} * 100.0", 2)} ELSE 0.0 END"


def guarded_exp(have: str, need: str) -> str:
    return f"CASE WHEN {need} > 0 THEN {exp_score(have, need)} ELSE 0.0 END"


def position_score(title: str, positions: str) -> str:
    eq = f"len(list_filter({positions}, lambda p: lower(p) = lower({title}))) > 0"
    inside = f"len(list_filter({positions}, lambda p: contains(lower(p), lower({title})) OR contains(lower({title}), lower(p)))) > 0"
    return f"CAST(CASE WHEN coalesce({title}, '') = '' THEN 0.0 WHEN {eq} THEN 100.0 WHEN {inside} THEN 70.0 ELSE 0.0 END AS DOUBLE)"


POOL = "greatest(3 * {k}, 30)"

# Cosine of every job and candidate that has a vector, and the pool per job.
COSINE_SQL = """sims AS (
  SELECT j.jd_id, c.resume_id, j.max_results,
    round_even(list_dot_product(j.embedding, c.embedding)
      / (sqrt(list_dot_product(j.embedding, j.embedding)) * sqrt(list_dot_product(c.embedding, c.embedding))) * 1e12, 0) / 1e12 AS cosine
  FROM jobs j, cand c WHERE j.embedding IS NOT NULL AND c.embedding IS NOT NULL),
vpool AS (SELECT jd_id, resume_id, CAST(cosine AS DOUBLE) AS cosine FROM (
    SELECT *, row_number() OVER (PARTITION BY jd_id ORDER BY cosine DESC, resume_id) AS rn FROM sims)
  WHERE rn <= greatest(3 * max_results, 30))"""


def logistic(percent: str, r: float) -> str:
    return f"least({rnd(f'100.0 / (1.0 + exp(-(({percent}) / 100.0 - 0.5) * {r}))', 2)}, 100.0)"


def minmax(score: str) -> str:
    w = "OVER (PARTITION BY jd_id)"
    return f"(({score}) - min({score}) {w}) / greatest(max({score}) {w} - min({score}) {w}, 0.0001) * 100.0"


def signed_minmax(score: str) -> str:
    return f"CASE WHEN {score} < 0 THEN (1.0 - abs({score}) / (abs(min({score}) OVER (PARTITION BY jd_id)) + 0.0001)) * 100.0 ELSE {minmax(score)} END"


FOCUSED = """CASE WHEN (CASE WHEN job_title <> '' THEN 1 ELSE 0 END) + (CASE WHEN len(required_skills) > 0 THEN 1 ELSE 0 END)
   + (CASE WHEN len(nice_to_have_skills) > 0 THEN 1 ELSE 0 END) + (CASE WHEN seniority_level IS NOT NULL THEN 1 ELSE 0 END)
   + (CASE WHEN industry IS NOT NULL THEN 1 ELSE 0 END) >= 3
  THEN concat_ws(chr(10), CASE WHEN job_title <> '' THEN 'Job Title: ' || job_title END,
    CASE WHEN len(required_skills) > 0 THEN 'Required Skills: ' || array_to_string(required_skills, ', ') END,
    CASE WHEN len(nice_to_have_skills) > 0 THEN 'Nice-to-have Skills: ' || array_to_string(nice_to_have_skills, ', ') END,
    'Seniority Level: ' || seniority_level, 'Industry: ' || industry)
  ELSE text END"""

BM25 = "ln(1.0 + (s.n_docs - f.df + 0.5) / (f.df + 0.5)) * t.tf * 2.2 / (t.tf + 1.2 * (0.25 + 0.75 * t.len / s.avg_len))"


def text_ctes(query_expr: str, fields: list[str], fuzzy: bool) -> str:
    """qt, ft, tf, df, stats, near terms and per-field scores `fs(jd_id, resume_id, field, exact, near)`."""
    as_text = {"skills": "array_to_string(skills, ' ')", "positions": "array_to_string(positions, ' ')"}
    parts = " UNION ALL ".join(
        f"SELECT resume_id, '{f}' AS field, {tokens(as_text.get(f, f))} AS toks FROM cand" for f in fields
    )
    letters, plain = NON_ASCII, "ABCDEFGHIJK"
    fold = f"translate({{0}}, '{letters}', '{plain}')"
    allowed = "CASE WHEN length(q.term) < 4 THEN 0 WHEN length(q.term) < 7 THEN 1 ELSE 2 END"
    if fuzzy:
        pairs = f"""pairs AS (SELECT q.term AS wanted, v.term, 0 AS edits FROM qv q JOIN vocab v ON q.term = v.term UNION ALL
  SELECT wanted, term, edits FROM (SELECT q.term AS wanted, v.term, {allowed} AS allowed,
      levenshtein({fold.format('q.term')}, {fold.format('v.term')}) AS edits
    FROM qv q JOIN vocab v ON abs(length(q.term) - length(v.term)) <= {allowed} AND length(q.term) >= 4 AND q.term <> v.term)
  WHERE edits <= allowed)"""
    else:
        pairs = "pairs AS (SELECT term AS wanted, term, 0 AS edits FROM qv)"
    return f"""ft AS MATERIALIZED (SELECT * FROM ({parts}) WHERE len(toks) > 0),
qt AS (SELECT jd_id, term, count(*) AS qtf FROM (SELECT jd_id, unnest({tokens(query_expr)}) AS term FROM jobs) GROUP BY ALL),
qv AS (SELECT DISTINCT term FROM qt),
tf AS MATERIALIZED (SELECT resume_id, field, len, term, count(*) AS tf FROM (SELECT resume_id, field, len(toks) AS len, unnest(toks) AS term FROM ft) GROUP BY ALL),
vocab AS MATERIALIZED (SELECT DISTINCT term FROM tf),
stats AS (SELECT field, count(*) AS n_docs, avg(len(toks)) AS avg_len FROM ft GROUP BY field),
df AS (SELECT field, term, count(*) AS df FROM tf GROUP BY ALL),
{pairs},
expanded AS (SELECT jd_id, p.term, sum(CASE WHEN edits = 0 THEN qtf ELSE 0 END) AS exact,
    sum(qtf * (1.0 - CAST(edits AS DOUBLE) / least(length(wanted), length(p.term)))) AS near
  FROM qt JOIN pairs p ON qt.term = p.wanted GROUP BY ALL),
fs AS (SELECT e.jd_id, t.resume_id, t.field, sum({BM25} * e.exact) AS exact, sum({BM25} * e.near) AS near
  FROM tf t JOIN expanded e ON t.term = e.term JOIN df f ON f.term = t.term AND f.field = t.field JOIN stats s ON s.field = t.field
  GROUP BY ALL)"""


def boost_case(boosts: dict[str, float], value: str) -> str:
    whens = " ".join(f"WHEN '{f}' THEN {b}" for f, b in boosts.items())
    return f"(CASE field {whens} ELSE 0.0 END) * {value}"


def settle(expr: str) -> str:
    return f"CAST(round_even(({expr}) * 1e9, 0) / 1e9 AS DOUBLE)"


BASE = f"WITH {CANDIDATES_SQL},\n{JOBS_SQL}"
