"""Vectors, pools, scores, reranks, sets and gap analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitaspark.functions import scores as S
from vitaspark.functions import skills as K
from vitaspark.functions import vectors as V
from vitaspark.functions.lexicon import ALTERNATE_BOOSTS, HYBRID_BEST_FIELDS, TEXT_BEST_FIELDS, TEXT_EXACT_BOOSTS
from vitaspark.operators import lexical as L
from vitaspark.operators import ranking as R
from vitaspark.operators.vector_search import cosine_top_k, top_per_job
from vitaspark.plans import match as M

from . import oracle as O
from .registry import query, table
from .roles import DIM, candidates, jobs

PAIR_COLS = ["jd_id", "resume_id"]


def joined(name: str):
    return F.array_join(name, "|").alias(name)


def _pairs(spark, sf):
    """Pool of nearest candidates with job and candidate columns."""
    j, c = jobs(spark, sf), candidates(spark, sf)
    return R.with_details(M.vector_pool(j, c, DIM), j, c)


# The same pool in SQL: p(jd_id, resume_id, cosine, search_score, job and candidate columns).
POOL_SQL = f"""{O.BASE},
{O.COSINE_SQL},
scored AS (SELECT *, {O.logistic(O.signed_minmax('cosine'), 15.0)} AS search_score FROM vpool),
p AS (SELECT s.*, j.job_title, j.required_experience, j.required_skills, j.max_results, j.min_experience,
    c.skills, c.positions, c.total_experience FROM scored s JOIN jobs j USING (jd_id) JOIN cand c USING (resume_id))"""


def comp_sql(profile: str = "batch", guarded: bool = True, source: str = "p") -> str:
    exp = (O.guarded_exp if guarded else O.exp_score)("total_experience", "required_experience")
    return f"""n AS (SELECT *, {O.norm_list('required_skills', profile)} AS wn, {O.norm_list('skills', profile)} AS hn FROM {source}),
comp AS (SELECT *, {O.skill_score('wn', 'hn')} AS skill_score, {exp} AS exp_score,
    {O.position_score('job_title', 'positions')} AS position_score FROM n)"""


@query("v1", f"""{O.BASE} SELECT jd_id, resume_id, coalesce(round(cosine, 4), 0.0) AS cosine FROM (
  SELECT j.jd_id, c.resume_id, list_dot_product(j.embedding, c.embedding)
    / (sqrt(list_dot_product(j.embedding, j.embedding)) * sqrt(list_dot_product(c.embedding, c.embedding))) AS cosine
  FROM cand c JOIN jobs j ON j.jd_id = c.resume_id % (SELECT count(*) FROM jobs))""")
def v1(spark, sf):
    """Every candidate against one job."""
    j = jobs(spark, sf).select("jd_id", F.col("embedding").alias("jv"))
    c = candidates(spark, sf).select("resume_id", (F.col("resume_id") % j.count()).alias("jd_id"), "embedding")
    pair = c.join(j, "jd_id")
    return pair.select("jd_id", "resume_id", F.round(V.cosine(F.col("jv"), F.col("embedding")), 4).alias("cosine"))


@query("v2")
def v2(spark, sf):
    out = V.embed_hashed(table(spark, sf, "documents").select("doc_id", "text"), "text", dim=256)
    return out.select("doc_id", F.size("embedding").alias("dim"), F.round(V.norm(V.as_doubles(F.col("embedding"))), 3).alias("length"))


@query("v3", """SELECT vec_id, round(list_sum(list_transform(u, lambda x: x * x)), 4) AS squared, round(u[1], 4) AS first FROM (
  SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u
  FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings))""")
def v3(spark, sf):
    u = table(spark, sf, "embeddings").select("vec_id", V.unit(F.col("embedding")).alias("u"))
    return u.select("vec_id", F.round(V.dot(F.col("u"), F.col("u")), 4).alias("squared"), F.round(F.get("u", F.lit(0)), 4).alias("first"))


@query("v4", """SELECT vec_id, CASE WHEN want IN (256, 512, 1024, 1536) THEN want ELSE 1024 END AS dim
  FROM (SELECT vec_id, CAST(256 * (1 + label) AS INT) AS want FROM embeddings)""")
def v4(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", V.guarded_dim((F.col("label") + 1) * 256).alias("dim"))


@query("n13", """SELECT vec_id, len(v) AS dim, round(list_sum(v), 3) AS total FROM (SELECT vec_id,
    CASE WHEN keep < 64 THEN CAST(embedding[1:keep] AS DOUBLE[]) ELSE list_concat(CAST(embedding AS DOUBLE[]), list_transform(range(keep - 64), lambda i: 0.0)) END AS v
  FROM (SELECT vec_id, embedding, CAST(60 + label AS INT) AS keep FROM embeddings))""")
def n13(spark, sf):
    e = table(spark, sf, "embeddings")
    # fit to a length that differs per label: shorter rows are cut, longer ones padded
    fitted = F.when(F.lit(False), F.col("embedding"))
    for label in range(10):
        fitted = F.when(F.col("label") == label, V.fit_length(F.col("embedding"), 60 + label)).otherwise(fitted)
    return e.select("vec_id", fitted.alias("v")).select(
        "vec_id", F.size("v").cast("bigint").alias("dim"),
        F.round(F.aggregate(V.as_doubles(F.col("v")), F.lit(0.0), lambda a, x: a + x), 3).alias("total"),
    )


@query("j1", f"{O.BASE},\n{O.COSINE_SQL} SELECT jd_id, resume_id, round(cosine, 4) AS cosine, rn AS rank FROM (SELECT *, row_number() OVER (PARTITION BY jd_id ORDER BY cosine DESC, resume_id) rn FROM sims) WHERE rn <= 20")
def j1(spark, sf):
    top = cosine_top_k(jobs(spark, sf), candidates(spark, sf), 20, dim=DIM)
    return top.select("jd_id", "resume_id", F.round("cosine", 4).alias("cosine"), F.col("rank").cast("bigint").alias("rank"))


@query("w4", f"{O.BASE},\n{O.COSINE_SQL} SELECT jd_id, resume_id, round(cosine, 4) AS cosine FROM vpool")
def w4(spark, sf):
    j = jobs(spark, sf)
    top = cosine_top_k(j, candidates(spark, sf), R.largest_pool(j), dim=DIM).drop("rank")
    return R.candidate_pool(top, j, "cosine").withColumn("cosine", F.round("cosine", 4))


def _vpool(spark, sf):
    j = jobs(spark, sf)
    return R.candidate_pool(cosine_top_k(j, candidates(spark, sf), R.largest_pool(j), dim=DIM).drop("rank"), j, "cosine")


@query("w1", f"{O.BASE},\n{O.COSINE_SQL} SELECT jd_id, resume_id, round({O.minmax('cosine')}, 4) AS percent FROM vpool")
def w1(spark, sf):
    return _vpool(spark, sf).select(*PAIR_COLS, F.round(S.minmax_percent(F.col("cosine"), "jd_id"), 4).alias("percent"))


@query("w1n", f"{O.BASE},\n{O.COSINE_SQL}, sh AS (SELECT jd_id, resume_id, cosine - 0.3 AS s FROM vpool) SELECT jd_id, resume_id, round({O.signed_minmax('s')}, 4) AS percent FROM sh")
def w1n(spark, sf):
    p = _vpool(spark, sf).withColumn("s", F.col("cosine") - 0.3)
    return p.select(*PAIR_COLS, F.round(S.signed_minmax_percent(F.col("s"), "jd_id"), 4).alias("percent"))


@query("w2", f"{O.BASE},\n{O.COSINE_SQL} SELECT jd_id, resume_id, least({O.rnd('cosine / max(cosine) OVER (PARTITION BY jd_id) * 100.0', 2)}, 100.0) AS percent FROM vpool")
def w2(spark, sf):
    return _vpool(spark, sf).select(*PAIR_COLS, S.max_percent(F.col("cosine"), "jd_id").alias("percent"))


@query("w3", f"{POOL_SQL} SELECT jd_id, resume_id, search_score, {O.logistic(O.minmax('cosine'), 12.0)} AS hybrid_curve FROM scored")
def w3(spark, sf):
    p = R.normalized(_vpool(spark, sf), "vector", "cosine")
    return R.normalized(p, "hybrid", "cosine", "hybrid_curve").select(*PAIR_COLS, "search_score", "hybrid_curve")


@query("w5", f"{POOL_SQL}, {comp_sql()}, rr AS (SELECT *, least({O.rnd('search_score * 0.40 + skill_score * 0.30 + position_score * 0.10 + exp_score * 0.20', 2)}, 100.0) AS rerank_score FROM comp) SELECT jd_id, resume_id, rerank_score, rn AS rank_position FROM (SELECT *, row_number() OVER (PARTITION BY jd_id ORDER BY rerank_score DESC, resume_id) AS rn FROM rr) WHERE rn <= 5")
def w5(spark, sf):
    done = R.final_order(R.rerank(R.components(_pairs(spark, sf)), "vector"), 5)
    return done.select(*PAIR_COLS, "rerank_score", F.col("rank_position").cast("bigint").alias("rank_position"))


@query("r1", f"{POOL_SQL}, {comp_sql()} SELECT jd_id, resume_id, skill_score FROM comp")
def r1(spark, sf):
    return R.components(_pairs(spark, sf)).select(*PAIR_COLS, "skill_score")


@query("r2", f"{POOL_SQL} SELECT jd_id, resume_id, {O.exp_score('total_experience', 'required_experience')} AS exp_score FROM p")
def r2(spark, sf):
    return _pairs(spark, sf).select(*PAIR_COLS, S.experience_score(F.col("total_experience"), F.col("required_experience")).alias("exp_score"))


@query("r2g", f"{POOL_SQL} SELECT jd_id, resume_id, {O.guarded_exp('total_experience', 'required_experience')} AS exp_score FROM p")
def r2g(spark, sf):
    return _pairs(spark, sf).select(*PAIR_COLS, S.guarded_experience_score(F.col("total_experience"), F.col("required_experience")).alias("exp_score"))


def cov_sql(source: str) -> str:
    """matching, missing, partial pairs and coverage of rows with wn / hn (api profile)."""
    return f"""sets AS (SELECT *,
    list_filter(list_transform(range(1, len(skills) + 1), lambda i: CASE WHEN list_contains(wn, hn[i]) THEN skills[i] END), lambda s: s IS NOT NULL) AS matching,
    list_filter(list_transform(range(1, len(required_skills) + 1), lambda i: CASE WHEN NOT list_contains(hn, wn[i]) THEN required_skills[i] END), lambda s: s IS NOT NULL) AS missing
  FROM {source}),
pp AS (SELECT jd_id, resume_id, count(*) AS n_partial, string_agg(req || '~' || res, '|' ORDER BY i, k) AS partial_pairs FROM (
    SELECT jd_id, resume_id, i, k, required_skills[i] AS req, skills[k] AS res, wn[i] AS w, hn[k] AS h, matching FROM (
      SELECT *, unnest(range(1, len(skills) + 1)) AS k FROM (SELECT *, unnest(range(1, len(required_skills) + 1)) AS i FROM sets)))
  WHERE NOT list_contains(matching, res) AND length(w) > 2 AND length(h) > 2 AND (contains(h, w) OR contains(w, h)) GROUP BY ALL),
cov AS (SELECT s.*, coalesce(n_partial, 0) AS n_partial, coalesce(partial_pairs, '') AS partial_pairs,
    least(100.0, {O.rnd('(len(matching) + coalesce(n_partial, 0) * 0.5) / CAST(len(required_skills) AS DOUBLE) * 100.0', 1)}) AS skill_coverage
  FROM sets s LEFT JOIN pp USING (jd_id, resume_id))"""


@query("r3", f"{POOL_SQL}, {comp_sql('api')}, {cov_sql('comp')} SELECT jd_id, resume_id, partial_pairs, skill_coverage FROM cov")
def r3(spark, sf):
    out = R.coverage(R.components(_pairs(spark, sf), "api"))
    text = F.array_join(F.transform("partial_matches", lambda p: F.concat(p["required"], F.lit("~"), p["resume"])), "|")
    return out.select(*PAIR_COLS, text.alias("partial_pairs"), "skill_coverage")


@query("r4", f"{POOL_SQL} SELECT jd_id, resume_id, {O.position_score('job_title', 'positions')} AS position_score FROM p")
def r4(spark, sf):
    return _pairs(spark, sf).select(*PAIR_COLS, S.position_score(F.col("job_title"), F.col("positions")).alias("position_score"))


@query("r5", f"{POOL_SQL}, {comp_sql()} SELECT jd_id, resume_id, least({O.rnd('search_score * 0.40 + skill_score * 0.30 + position_score * 0.10 + exp_score * 0.20', 2)}, 100.0) AS rerank_score FROM comp")
def r5(spark, sf):
    return R.rerank(R.components(_pairs(spark, sf)), "vector").select(*PAIR_COLS, "rerank_score")


@query("r6", f"{POOL_SQL}, {comp_sql('api')} SELECT jd_id, resume_id, least({O.rnd('search_score * 0.55 + skill_score * 0.25 + position_score * 0.10 + exp_score * 0.10', 2)}, 100.0) AS rerank_score FROM comp")
def r6(spark, sf):
    return R.rerank(R.components(_pairs(spark, sf), "api"), "hybrid").select(*PAIR_COLS, "rerank_score")


@query("r7", f"""{POOL_SQL}, {comp_sql(guarded=False)} SELECT jd_id, resume_id, skill_score, exp_score,
  least({O.rnd('(search_score * 0.40 + skill_score * 0.30 + position_score * 0.0 + exp_score * 0.30) * (CASE WHEN total_experience >= required_experience THEN 1.0 ELSE 0.7 END)', 2)}, 100.0) AS combined_score,
  total_experience >= required_experience AS meets_min_experience,
  array_to_string(list_filter(required_skills, lambda s: list_contains(list_transform(skills, lambda h: lower(h)), lower(s))), '|') AS matched_skills,
  array_to_string(list_filter(required_skills, lambda s: NOT list_contains(list_transform(skills, lambda h: lower(h)), lower(s))), '|') AS missing_skills FROM comp""")
def r7(spark, sf):
    out = R.overall_ranking(_pairs(spark, sf))
    return out.select(*PAIR_COLS, "skill_score", "exp_score", "combined_score", "meets_min_experience", joined("matched_skills"), joined("missing_skills"))


@query("r8", f"{POOL_SQL}, {comp_sql(guarded=False)} SELECT jd_id, resume_id, least({O.rnd('least(cosine * 1200.0, 100.0) * 0.60 + skill_score * 0.25 + position_score * 0.0 + exp_score * 0.15', 2)}, 100.0) AS debug_score FROM comp")
def r8(spark, sf):
    pairs = R.components(_pairs(spark, sf), guarded=False)
    pairs = pairs.withColumn("debug_search", F.least(F.col("raw_score") * 1200.0, F.lit(100.0)))
    return R.rerank(pairs, "debug", "debug_search", "debug_score").select(*PAIR_COLS, "debug_score")


def analysis_sql(overall: str) -> str:
    nl = "chr(10)"
    has = "'Has ' || total_experience || ' years of experience, '"
    exp = f"""CASE WHEN exp_score >= 90 THEN {has} || 'exceeding the required ' || required_experience || ' years'
      WHEN exp_score >= 70 THEN 'Meets the experience requirement of ' || required_experience || ' years'
      ELSE {has} || 'below the required ' || required_experience || ' years' END"""
    skill = f"""CASE WHEN skill_coverage >= 90 THEN 'Possesses nearly all required skills (' || skill_coverage || '% coverage)'
      WHEN skill_coverage >= 70 THEN 'Has good coverage of required skills (' || skill_coverage || '%)'
      ELSE 'Missing several key skills (' || {O.rnd('100.0 - skill_coverage', 1)} || '% gap)' END"""
    return f"""'Overall Match: ' || format('{{:.1f}}', {O.rnd(overall, 1)}) || '%' || {nl} || {nl}
    || CASE WHEN exp_score >= 70 OR skill_coverage >= 70 OR position_score >= 80 THEN 'Key strengths:' || {nl}
      || CASE WHEN exp_score >= 70 THEN '• ' || ({exp}) || {nl} ELSE '' END
      || CASE WHEN skill_coverage >= 70 THEN '• ' || ({skill}) || {nl} ELSE '' END
      || CASE WHEN position_score >= 80 THEN '• Has directly relevant job titles matching the position' || {nl} ELSE '' END || {nl} ELSE '' END
    || CASE WHEN exp_score < 70 OR skill_coverage < 70 THEN 'Areas for consideration:' || {nl}
      || CASE WHEN exp_score < 70 THEN '• ' || ({exp}) || {nl} ELSE '' END
      || CASE WHEN skill_coverage < 70 THEN '• ' || ({skill}) || {nl} ELSE '' END || {nl} ELSE '' END
    || CASE WHEN len(missing) > 0 THEN 'Missing skills: ' || array_to_string(missing[1:5], ', ')
      || CASE WHEN len(missing) > 5 THEN ' and ' || (len(missing) - 5) || ' more' ELSE '' END ELSE '' END"""


@query("r9", f"{POOL_SQL}, {comp_sql('api')}, {cov_sql('comp')} SELECT jd_id, resume_id, {analysis_sql('search_score')} AS analysis FROM cov")
def r9(spark, sf):
    out = R.coverage(R.components(_pairs(spark, sf), "api"))
    text = S.candidate_analysis(*[F.col(c) for c in ("search_score", "exp_score", "total_experience", "required_experience", "skill_coverage", "position_score", "missing")])
    return out.select(*PAIR_COLS, text.alias("analysis"))


@query("r10", f"{POOL_SQL} SELECT jd_id, resume_id, {O.rnd('total_experience - required_experience', 1)} AS difference FROM p")
def r10(spark, sf):
    return _pairs(spark, sf).select(*PAIR_COLS, S.experience_difference(F.col("total_experience"), F.col("required_experience")).alias("difference"))


@query("r14", f"""{POOL_SQL}, {comp_sql()}, rr AS (SELECT *, least({O.rnd('search_score * 0.40 + skill_score * 0.30 + position_score * 0.10 + exp_score * 0.20', 2)}, 100.0) AS rerank_score FROM comp)
  SELECT jd_id, resume_id, search_score, skill_score, exp_score, position_score, rerank_score, rn AS rank_position
  FROM (SELECT *, row_number() OVER (PARTITION BY jd_id ORDER BY rerank_score DESC, resume_id) AS rn FROM rr) WHERE rn <= max_results""")
def r14(spark, sf):
    out = M.vector_search(jobs(spark, sf), candidates(spark, sf), DIM)
    return out.select(*PAIR_COLS, "search_score", "skill_score", "exp_score", "position_score", "rerank_score", F.col("rank_position").cast("bigint").alias("rank_position"))


@query("g1", f"""{POOL_SQL}, {comp_sql('api')}, {cov_sql('comp')}, m AS (SELECT jd_id, unnest(missing) AS skill FROM cov)
  SELECT jd_id, skill, count(*) AS missing_count, {O.rnd('count(*) * 100.0 / any_value(t.n)', 1)} AS missing_percent
  FROM m JOIN (SELECT jd_id, count(*) AS n FROM cov GROUP BY jd_id) t USING (jd_id) GROUP BY jd_id, skill""")
def g1(spark, sf):
    return R.skill_gaps(R.coverage(R.components(_pairs(spark, sf), "api")))


@query("s1", f"""{POOL_SQL} SELECT jd_id, resume_id,
  array_to_string(list_filter(required_skills, lambda s: list_contains(list_transform(skills, lambda h: lower(h)), lower(s))), '|') AS matched,
  array_to_string(list_filter(required_skills, lambda s: NOT list_contains(list_transform(skills, lambda h: lower(h)), lower(s))), '|') AS missing FROM p""")
def s1(spark, sf):
    w, h = F.col("required_skills"), F.col("skills")
    return _pairs(spark, sf).select(*PAIR_COLS, F.array_join(K.matched_by_case(w, h), "|").alias("matched"), F.array_join(K.missing_by_case(w, h), "|").alias("missing"))


@query("s2", f"{POOL_SQL}, {comp_sql('api')}, {cov_sql('comp')} SELECT jd_id, resume_id, array_to_string(matching, '|') AS matching, array_to_string(missing, '|') AS missing FROM cov")
def s2(spark, sf):
    return R.coverage(R.components(_pairs(spark, sf), "api")).select(*PAIR_COLS, joined("matching"), joined("missing"))


@query("s3", f"{POOL_SQL} SELECT jd_id, resume_id, len(list_intersect({O.words('lower(required_skills[1])')}, {O.words('lower(skills[1])')})) AS common FROM p")
def s3(spark, sf):
    first = F.lower(F.get("required_skills", F.lit(0)))
    return _pairs(spark, sf).select(*PAIR_COLS, K.word_overlap(first, F.lower(F.get("skills", F.lit(0)))).cast("bigint").alias("common"))


@query("g9", f"""{POOL_SQL}, {comp_sql()} SELECT jd_id, resume_id, len(list_filter(wn, lambda x: list_contains(hn, x))) AS exact,
  round(len(list_filter(wn, lambda x: list_contains(hn, x))) / CAST(len(wn) AS DOUBLE), 4) AS ratio FROM comp""")
def g9(spark, sf):
    pairs = R.components(_pairs(spark, sf))
    n = K.exact_count(F.col("wanted_norm"), F.col("held_norm"))
    return pairs.select(*PAIR_COLS, n.cast("bigint").alias("exact"), F.round(n / F.size("wanted_norm"), 4).alias("ratio"))


@query("g11", f"{O.BASE},\n{O.COSINE_SQL} SELECT jd_id, round(min(cosine), 4) AS low, round(max(cosine), 4) AS high, round(greatest(max(cosine) - min(cosine), 0.0001), 4) AS span FROM vpool GROUP BY jd_id")
def g11(spark, sf):
    low, high = F.min("cosine"), F.max("cosine")
    return _vpool(spark, sf).groupBy("jd_id").agg(
        F.round(low, 4).alias("low"), F.round(high, 4).alias("high"), F.round(F.greatest(high - low, F.lit(0.0001)), 4).alias("span")
    )


# ---- filters -------------------------------------------------------------------------------

@query("f1", f"{POOL_SQL} SELECT jd_id, resume_id, search_score FROM p WHERE total_experience >= min_experience + 4")
def f1(spark, sf):
    return _pairs(spark, sf).filter(F.col("total_experience") >= F.col("min_experience") + 4).select(*PAIR_COLS, "search_score")


@query("f1_prefilter", f"""{O.BASE},
{O.COSINE_SQL}, fits AS (SELECT s.jd_id, s.resume_id, s.cosine, j.max_results, row_number() OVER (PARTITION BY s.jd_id ORDER BY s.cosine DESC, s.resume_id) AS nth
  FROM sims s JOIN jobs j USING (jd_id) JOIN cand c USING (resume_id) WHERE c.total_experience >= greatest(j.required_experience, j.min_experience)),
  fpool AS (SELECT * FROM fits WHERE nth <= greatest(3 * max_results, 30))
SELECT jd_id, resume_id, round(cosine, 4) AS cosine, {O.logistic(O.signed_minmax('cosine'), 15.0)} AS search_score FROM fpool""")
def f1_prefilter(spark, sf):
    asked = jobs(spark, sf).withColumn("required_experience", F.greatest("required_experience", "min_experience"))
    pool = M.vector_pool(asked, candidates(spark, sf), DIM, prefilter=True)
    return pool.select(*PAIR_COLS, F.round("raw_score", 4).alias("cosine"), "search_score")


@query("f2", f"{O.BASE} SELECT jd_id, greatest(required_experience, min_experience) AS effective FROM jobs")
def f2(spark, sf):
    return jobs(spark, sf).select("jd_id", F.greatest("required_experience", "min_experience").alias("effective"))


@query("f3", "SELECT conv_id, turn, length(trim(coalesce(text, ''))) >= 10 AS accepted FROM conversations")
def f3(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", M.acceptable_job(F.col("text")).alias("accepted"))


@query("f3_rejects", """SELECT page_id, CASE WHEN length(trim(path)) = 0 THEN 'empty job description' ELSE 'job description under 10 characters' END AS error
  FROM (SELECT page_id, coalesce(regexp_extract(url, '^[a-z]+://[^/]*/?(.*)$', 1), '') AS path FROM pages) WHERE length(trim(path)) < 10""")
def f3_rejects(spark, sf):
    """Paths of the pages stand for job texts, as some are shorter than a job text may be."""
    paths = table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://[^/]*/?(.*)$", 1).alias("path"))
    return M.split_jobs(paths, "path")[1].select("page_id", "error")


@query("f4", "SELECT o_orderkey, least(greatest(coalesce(CAST(o_totalprice / 3000 AS INT) - 10, 30), 1), 100) AS k FROM (SELECT o_orderkey, floor(o_totalprice / 3000) * 3000 AS o_totalprice FROM orders)")
def f4(spark, sf):
    want = F.floor(F.col("o_totalprice") / 3000).cast("int") - 10
    return table(spark, sf, "orders").select("o_orderkey", S.clamp_results(want, most=100).alias("k"))


@query("f5", f"{O.BASE} SELECT jd_id, least(greatest(3 * (max_results + jd_id % 30), 30), 100) AS pool FROM jobs")
def f5(spark, sf):
    return jobs(spark, sf).select("jd_id", S.pool_size(F.col("max_results") + F.col("jd_id") % 30, most=100).alias("pool"))


@query("f6", f"{O.BASE} SELECT jd_id, array_to_string(list_filter((required_skills || CASE WHEN job_title <> '' THEN [job_title] ELSE [] END)[1:10], lambda t: length(t) >= 3), '|') AS terms FROM jobs")
def f6(spark, sf):
    return jobs(spark, sf).select("jd_id", F.array_join(L.key_terms(F.col("required_skills"), F.col("job_title")), "|").alias("terms"))


@query("f7", "SELECT doc_id, embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS usable FROM documents LEFT JOIN embeddings ON vec_id = doc_id")
def f7(spark, sf):
    return candidates(spark, sf).select(F.col("resume_id").alias("doc_id"), V.is_usable(F.col("embedding")).alias("usable"))


@query("f11", f"{POOL_SQL} SELECT jd_id, resume_id FROM (SELECT *, row_number() OVER (PARTITION BY jd_id ORDER BY search_score DESC, resume_id) AS rn FROM p) WHERE rn <= 25")
def f11(spark, sf):
    return top_per_job(_pairs(spark, sf), 25, "search_score").select(*PAIR_COLS)


# ---- text retrieval --------------------------------------------------------------------------

TEXT_FIELDS = sorted(set(TEXT_EXACT_BOOSTS) | set(TEXT_BEST_FIELDS))
TEXT_RAW = f"""{O.BASE}, {O.text_ctes('text', TEXT_FIELDS, True)},
raw AS (SELECT jd_id, resume_id, {O.settle(f"sum({O.boost_case(TEXT_EXACT_BOOSTS, 'exact')}) + max({O.boost_case(TEXT_BEST_FIELDS, 'near')}) + (sum({O.boost_case(TEXT_BEST_FIELDS, 'near')}) - max({O.boost_case(TEXT_BEST_FIELDS, 'near')})) * 0.3")} AS raw_score FROM fs GROUP BY ALL)"""


@query("g10", f"""{O.BASE}, {O.text_ctes('text', TEXT_FIELDS, False)} SELECT field, n_docs, round(avg_len, 4) AS avg_len, terms, postings FROM stats
  JOIN (SELECT field, count(*) AS terms, CAST(sum(df) AS BIGINT) AS postings FROM df GROUP BY field) USING (field)""")
def g10(spark, sf):
    c = candidates(spark, sf)
    terms = L.stable(L.dictionary(c, TEXT_FIELDS))
    df = L.term_frequencies(terms).groupBy("field").agg(F.count("*").alias("terms"), F.sum("df").alias("postings"))
    stats = L.corpus_stats(terms).withColumn("avg_len", F.round("avg_len", 4))
    return stats.join(F.broadcast(df), "field")


@query("j2", f"{O.BASE}, {O.text_ctes('text', ['positions', 'skills', 'summary'], False)} SELECT jd_id, resume_id, field, round(exact, 4) AS score FROM fs")
def j2(spark, sf):
    j, c, fields = jobs(spark, sf), candidates(spark, sf), ["positions", "skills", "summary"]
    weights = L.stable(L.term_weights(L.query_terms(j, F.col("text")), c, fields, fuzzy=False))
    return L.field_scores(L.text_evidence(c, fields), weights).select(*PAIR_COLS, "field", F.round("exact", 4).alias("score"))


@query("j3", f"{O.BASE}, {O.text_ctes('text', ['summary'], True)} SELECT wanted, term, CAST(edits AS INT) AS edits FROM pairs")
def j3(spark, sf):
    c = L.field_tokens(candidates(spark, sf), ["summary"])
    wanted = L.query_terms(jobs(spark, sf), F.col("text")).select("term").distinct()
    return L.fuzzy_pairs(wanted, c.select(F.explode(F.array_distinct("toks")).alias("term")).distinct())


@query("r11", f"""{TEXT_RAW} SELECT jd_id, resume_id, round(raw_score, 4) AS raw_score, least({O.rnd('raw_score / max(raw_score) OVER (PARTITION BY jd_id) * 100.0', 2)}, 100.0) AS score
  FROM (SELECT *, row_number() OVER (PARTITION BY jd_id ORDER BY raw_score DESC, resume_id) AS rn FROM raw) JOIN jobs USING (jd_id) WHERE rn <= max_results""")
def r11(spark, sf):
    return M.text_search(jobs(spark, sf), candidates(spark, sf)).select(*PAIR_COLS, F.round("raw_score", 4).alias("raw_score"), "score")


HYBRID_FIELDS = sorted(HYBRID_BEST_FIELDS)


def hybrid_sql(query_expr: str, title: bool) -> str:
    near = O.boost_case(HYBRID_BEST_FIELDS, "near")
    with_title = "CASE WHEN job_title <> '' THEN [job_title] ELSE [] END" if title else "[]"
    return f"""{O.BASE}, {O.COSINE_SQL}, {O.text_ctes(query_expr, HYBRID_FIELDS, True)},
kt AS (SELECT jd_id, unnest(range(1, len(terms) + 1)) AS pos, unnest(terms) AS term FROM (
    SELECT jd_id, list_filter((required_skills || {with_title})[1:10], lambda t: length(t) >= 3) AS terms FROM jobs)),
ph AS (SELECT jd_id, resume_id, count(*) AS phrases FROM (SELECT DISTINCT kt.jd_id, kt.pos, s.resume_id
    FROM (SELECT jd_id, pos, ' ' || array_to_string({O.tokens('term')}, ' ') || ' ' AS phrase FROM kt) kt
    JOIN (SELECT resume_id, ' ' || array_to_string({O.tokens('sk')}, ' ') || ' ' AS toks FROM (SELECT resume_id, unnest(skills) AS sk FROM cand)) s
    ON contains(s.toks, kt.phrase) AND length(kt.phrase) > 2) GROUP BY ALL),
parts AS (SELECT jd_id, resume_id, max({near}) + (sum({near}) - max({near})) * 0.3 AS s FROM fs GROUP BY ALL
  UNION ALL SELECT jd_id, resume_id, 3.0 * cosine FROM vpool UNION ALL SELECT jd_id, resume_id, 1.5 * phrases FROM ph),
raw AS (SELECT jd_id, resume_id, {O.settle('sum(s)')} AS raw_score FROM parts GROUP BY ALL),
hpool AS (SELECT jd_id, resume_id, raw_score FROM (SELECT *, row_number() OVER (PARTITION BY jd_id ORDER BY raw_score DESC, resume_id) AS rn FROM raw)
  JOIN jobs USING (jd_id) WHERE rn <= greatest(3 * max_results, 30)),
hs AS (SELECT *, {O.logistic(O.minmax('raw_score'), 12.0)} AS search_score FROM hpool)"""


@query("r12", f"{hybrid_sql(O.FOCUSED, True)} SELECT jd_id, resume_id, round(raw_score, 4) AS raw_score, search_score FROM hs")
def r12(spark, sf):
    out = M.hybrid_pool(jobs(spark, sf), candidates(spark, sf), DIM)
    return out.select(*PAIR_COLS, F.round("raw_score", 4).alias("raw_score"), "search_score")


@query("r13", f"""{O.BASE}, {O.COSINE_SQL}, {O.text_ctes('text', sorted(ALTERNATE_BOOSTS), False)},
  parts AS (SELECT jd_id, resume_id, 0.5 * {O.boost_case(ALTERNATE_BOOSTS, 'exact')} AS s FROM fs UNION ALL SELECT jd_id, resume_id, 0.5 * cosine FROM vpool),
  raw AS (SELECT jd_id, resume_id, {O.settle('sum(s)')} AS raw_score FROM parts GROUP BY ALL)
  SELECT jd_id, resume_id, round(raw_score, 4) AS raw_score FROM (SELECT *, row_number() OVER (PARTITION BY jd_id ORDER BY raw_score DESC, resume_id) AS rn FROM raw)
  JOIN jobs USING (jd_id) WHERE rn <= max_results""")
def r13(spark, sf):
    return M.alternate_search(jobs(spark, sf), candidates(spark, sf), DIM).withColumn("raw_score", F.round("raw_score", 4))


@query("r15", f"""{hybrid_sql('text', False)} SELECT jd_id, resume_id, round(raw_score, 4) AS raw_score, search_score AS score
  FROM (SELECT *, row_number() OVER (PARTITION BY jd_id ORDER BY raw_score DESC, resume_id) AS rn FROM hs) JOIN jobs USING (jd_id) WHERE rn <= max_results""")
def r15(spark, sf):
    return M.batch_search(jobs(spark, sf), candidates(spark, sf), DIM, query=F.col("text")).withColumn("raw_score", F.round("raw_score", 4))


MATCH_SQL = f"""{hybrid_sql(O.FOCUSED, True)},
fit AS (SELECT h.*, j.job_title, greatest(j.required_experience, j.min_experience) AS required_experience, j.required_skills, j.max_results,
    c.skills, c.positions, c.total_experience FROM hs h JOIN jobs j USING (jd_id) JOIN cand c USING (resume_id)
  WHERE c.total_experience >= greatest(j.required_experience, j.min_experience)),
{comp_sql('api', source='fit')},
rr AS (SELECT *, least({O.rnd('search_score * 0.55 + skill_score * 0.25 + position_score * 0.10 + exp_score * 0.10', 2)}, 100.0) AS rerank_score FROM comp),
fin AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY jd_id ORDER BY rerank_score DESC, resume_id) AS rank_position FROM rr) WHERE rank_position <= max_results),
{cov_sql('fin')}"""


@query("r16", f"""{MATCH_SQL} SELECT jd_id, resume_id, search_score, skill_score, exp_score, position_score, rerank_score, rank_position,
  array_to_string(matching, '|') AS matching, array_to_string(missing, '|') AS missing, skill_coverage,
  {O.rnd('total_experience - required_experience', 1)} AS experience_difference, {analysis_sql('rerank_score')} AS analysis FROM cov""")
def r16(spark, sf):
    out = M.match(jobs(spark, sf), candidates(spark, sf), DIM)
    return out.select(
        *PAIR_COLS, "search_score", "skill_score", "exp_score", "position_score", "rerank_score",
        F.col("rank_position").cast("bigint").alias("rank_position"), joined("matching"), joined("missing"),
        "skill_coverage", "experience_difference", "analysis",
    )
