"""Files, reports, streams, end-to-end ingest and scoring variants."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vitaspark.functions import skills as K
from vitaspark.operators import lexical as L
from vitaspark.operators import optional as P
from vitaspark.operators import ranking as R
from vitaspark.plans import ingest as G
from vitaspark.plans import match as M
from vitaspark.session import ensure_checkpoint_dir
from vitaspark.sources import files as FS
from vitaspark.streaming import jobs as ST

from . import oracle as O
from .ranking import MATCH_SQL, POOL_SQL, _pairs, comp_sql, cov_sql
from .records import NORM_SQL, responses
from .registry import query, table
from .roles import DIM, JOBS_SQL, candidates, jobs


def scratch(spark) -> str:
    """A new folder under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/work-{uuid.uuid4().hex}"


# ---- files -----------------------------------------------------------------------------------


def _page_files(spark, sf) -> str:
    path = scratch(spark)
    pages = table(spark, sf, "pages").select(F.col("html").alias("value"), (F.col("page_id") % 10).alias("folder"))
    pages.repartition(4, "folder").write.partitionBy("folder").text(path)
    return path


@query("io1")
def io1(spark, sf):
    return FS.list_documents(spark, sf, ["parquet"]).select("file_name", "file_type")


@query("io2")
def io2(spark, sf):
    return FS.list_documents(spark, sf, ["parquet"]).select("file_name", "file_type", "size", "last_modified")


@query("io4", "SELECT CAST(sum(length(html) + 1) AS BIGINT) AS chars, CAST(sum(length(html) - length(replace(html, chr(10), '')) + 1) AS BIGINT) AS lines FROM pages")
def io4(spark, sf):
    texts = FS.read_texts(spark, _page_files(spark, sf))
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    return texts.agg(F.sum(F.length("text")).alias("chars"), F.sum(lines).cast("bigint").alias("lines"))


@query("io5", "SELECT item_id, md5(text || chr(10)) AS text_md5 FROM benchmark")
def io5(spark, sf):
    path = scratch(spark)
    table(spark, sf, "benchmark").withColumnRenamed("text", "value").repartition("item_id").write.partitionBy("item_id").text(path)
    read = FS.read_jobs(spark, path)
    return read.select(F.regexp_extract("path", r"item_id=(\d+)", 1).cast("bigint").alias("item_id"), F.md5("text").alias("text_md5"))


@query("io6", f"WITH {NORM_SQL} SELECT resume_id, name, len(skills) AS n_skills FROM nrm JOIN js USING (c_custkey)")
def io6(spark, sf):
    from vitaspark.operators.normalize import normalize_responses

    path = scratch(spark)
    good = responses(spark, sf).withColumn("v", F.try_parse_json("response"))
    good.select(F.col("c_custkey").cast("string").alias("resume_id"), F.lit("m").alias("model_id"), F.col("v").alias("llm_output")).write.json(path)
    read = FS.read_responses(spark, path, one_per_line=True).withColumnRenamed("resume_id", "row_id")
    found = normalize_responses(read, "llm_output", keep=["row_id"])
    return found.select(F.col("row_id").alias("resume_id"), "name", F.size("skills").cast("bigint").alias("n_skills"))


@query("io7", "SELECT page_id, 'processed/' || regexp_replace(k, '^raw/', '') AS key FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'raw/' ELSE '' END || url AS k FROM pages)")
def io7(spark, sf):
    raw = F.concat(F.when(F.col("page_id") % 2 == 0, "raw/").otherwise(""), F.col("url"))
    return table(spark, sf, "pages").select("page_id", FS.processed_key(raw).alias("key"))


@query("io8", "SELECT page_id, 'errors/' || regexp_extract(r, '^(.*/)[^/]*$', 1) || regexp_replace(split_part(r, '/', -1), '\\.[^.]*$', '') || '_error.json' AS key FROM (SELECT page_id, split_part(url, '?', 1) || '.pdf' AS r FROM pages)")
def io8(spark, sf):
    raw = F.concat(F.lit("raw/"), F.split_part("url", F.lit("?"), F.lit(1)), F.lit(".pdf"))
    return table(spark, sf, "pages").select("page_id", FS.error_key(raw).alias("key"))


@query("io9", "SELECT CASE WHEN event_type <> 'error' THEN 'success' ELSE 'failed' END AS status, count(*) AS n FROM events GROUP BY 1")
def io9(spark, sf):
    path = scratch(spark)
    FS.route_outcomes(table(spark, sf, "events"), F.expr("event_type <> 'error'"), path)
    return spark.read.parquet(path).groupBy("status").agg(F.count("*").alias("n"))


# ---- reports ---------------------------------------------------------------------------------


def _ranked(spark, sf):
    return M.vector_search(jobs(spark, sf), candidates(spark, sf), DIM).select("jd_id", "resume_id", "rerank_score", "rank_position")


REPORT_SQL = f"""{POOL_SQL}, {comp_sql()}, rr AS (SELECT *, least({O.rnd('search_score * 0.40 + skill_score * 0.30 + position_score * 0.10 + exp_score * 0.20', 2)}, 100.0) AS rerank_score FROM comp),
  fin AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY jd_id ORDER BY rerank_score DESC, resume_id) AS rn FROM rr) WHERE rn <= max_results),
  rep AS (SELECT jd_id, count(*) AS n, string_agg(resume_id || ':' || rn, '|' ORDER BY rn) AS results FROM fin GROUP BY jd_id)"""


@query("io18", f"{REPORT_SQL} SELECT j.jd_id, replace(lower(j.job_title), ' ', '-')[1:30] AS slug, coalesce(n, 0) AS total_results, coalesce(results, '') AS results FROM jobs j LEFT JOIN rep USING (jd_id)")
def io18(spark, sf):
    path = scratch(spark)
    FS.write_reports(FS.job_reports(_ranked(spark, sf), jobs(spark, sf)), path)
    read = spark.read.schema(
        "jd_id BIGINT, total_results BIGINT, results ARRAY<STRUCT<rank_position: BIGINT, resume_id: BIGINT>>, slug STRING"
    ).json(path)
    items = F.transform("results", lambda r: F.concat(r["resume_id"].cast("string"), F.lit(":"), r["rank_position"].cast("string")))
    empty = F.coalesce(F.nullif("slug", F.lit("__HIVE_DEFAULT_PARTITION__")), F.lit(""))
    return read.select("jd_id", empty.alias("slug"), "total_results", F.coalesce(F.array_join(items, "|"), F.lit("")).alias("results"))


@query("g12", f"{REPORT_SQL} SELECT jd_id, n AS total_results, round(top, 2) AS best FROM rep JOIN (SELECT jd_id, max(rerank_score) AS top FROM fin GROUP BY 1) USING (jd_id)")
def g12(spark, sf):
    return _ranked(spark, sf).groupBy("jd_id").agg(F.count("*").alias("total_results"), F.round(F.max("rerank_score"), 2).alias("best"))


@query("io19", f"""{POOL_SQL}, {comp_sql('api')}, {cov_sql('comp')} SELECT jd_id, resume_id, search_score AS overall, skill_coverage AS coverage, len(matching) AS n_matching, len(missing) AS n_missing, total_experience AS years FROM cov""")
def io19(spark, sf):
    from vitaspark.functions.scores import experience_difference

    pairs = R.coverage(R.components(_pairs(spark, sf), "api")).withColumns({
        "rerank_score": F.col("search_score"), "cosine": F.col("raw_score"),
        "experience_difference": experience_difference(F.col("total_experience"), F.col("required_experience")),
    })
    body = F.to_json(FS.response_body(pairs))
    read = F.from_json(body, "scores STRUCT<overall: DOUBLE, skill_coverage: DOUBLE>, skills STRUCT<matching: ARRAY<STRING>, missing: ARRAY<STRING>>, experience STRUCT<years: DOUBLE>")
    out = pairs.select("jd_id", "resume_id", read.alias("b"))
    return out.select(
        "jd_id", "resume_id", F.col("b.scores.overall").alias("overall"), F.col("b.scores.skill_coverage").alias("coverage"),
        F.size("b.skills.matching").cast("bigint").alias("n_matching"), F.size("b.skills.missing").cast("bigint").alias("n_missing"), F.col("b.experience.years").alias("years"),
    )


@query("f9", f"""{O.BASE}, {O.text_ctes('text', ['positions', 'skills'], False)}, s AS (SELECT jd_id, resume_id, count(DISTINCT field) AS clauses FROM fs GROUP BY ALL) SELECT * FROM s WHERE clauses >= 1""")
def f9(spark, sf):
    j, c, fields = jobs(spark, sf), candidates(spark, sf), ["positions", "skills"]
    weights = L.stable(L.term_weights(L.query_terms(j, F.col("text")), c, fields, fuzzy=False))
    scores = L.pair_scores(L.text_evidence(c, fields), weights, dict.fromkeys(fields, 1.0), {})
    return scores.withColumnRenamed("fields", "clauses").filter("clauses >= 1").select("jd_id", "resume_id", "clauses")


@query("j13", f"""{POOL_SQL}, {comp_sql()}, e AS (SELECT jd_id, resume_id, w, unnest(hn) AS h FROM (SELECT jd_id, resume_id, unnest(wn) AS w, hn FROM comp))
  SELECT jd_id, resume_id, w AS wanted, h AS held, CASE WHEN w = h THEN 'exact' ELSE 'partial' END AS kind FROM e WHERE w = h OR (length(w) >= 4 AND length(h) >= 4 AND (contains(h, w) OR contains(w, h)))""")
def j13(spark, sf):
    # both lists sit in the pool row already, so pairing happens inside the row after the pool cut
    pairs = R.components(_pairs(spark, sf)).select("jd_id", "resume_id", F.explode("wanted_norm").alias("wanted"), "held_norm")
    each = pairs.select("jd_id", "resume_id", "wanted", F.explode("held_norm").alias("held"))
    kind = F.when(F.col("wanted") == F.col("held"), "exact").when(K.partial_weight(F.col("wanted"), F.col("held")).isin(0.75, 0.5) & (
        F.contains(F.col("held"), F.col("wanted")) | F.contains(F.col("wanted"), F.col("held"))), "partial")
    return each.withColumn("kind", kind).filter("kind IS NOT NULL")


# ---- streams and ingest ----------------------------------------------------------------------


def _landing(spark, df, files: int) -> tuple[str, str]:
    root = scratch(spark)
    df.repartition(files).write.parquet(f"{root}/in")
    return root, f"{root}/in"


def _batch_rows(spark, sf):
    return responses(spark, sf).select(
        F.col("c_custkey").cast("string").alias("resume_id"), F.col("response").alias("text"),
        F.concat(F.lit("Naukri_Pat["), (F.col("c_custkey") % 20).cast("string"), F.lit("y_3m].pdf")).alias("filename"), "response",
    )


@query("m4")
def m4(spark, sf):
    """One full ingest batch into empty tables; its summary."""
    return G.ingest_batch(spark, _batch_rows(spark, sf), scratch(spark), stamp=1)


@query("st1")
def st1(spark, sf):
    root, path = _landing(spark, _batch_rows(spark, sf), 2)
    source = ST.new_files(spark, path, spark.read.parquet(path).schema, per_batch=1)
    ST.ingest_stream(source, f"{root}/tables")
    return G.increment_table(spark, f"{root}/tables", "pii").read().select("resume_id", "name", "email", "created_dt", "updated_dt")


@query("st2", "SELECT md5(text) AS content_key, length(any_value(text)) AS chars FROM documents GROUP BY 1")
def st2(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    # three batches, of as many files as the documents have partitions, so no task writes or reads a third of them
    files = -(-docs.rdd.getNumPartitions() // 3)
    root, path = _landing(spark, docs, 3 * files)
    ST.distinct_stream(ST.new_files(spark, path, "doc_id BIGINT, text STRING", per_batch=files), F.md5("text"), root)
    return ST.distinct_records(spark, root).select("content_key", F.length("text").cast("bigint").alias("chars"))


@query("st3", f"{O.BASE},\n{O.COSINE_SQL} SELECT jd_id, resume_id, round(cosine, 4) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY jd_id ORDER BY cosine DESC, resume_id) rn FROM sims) WHERE rn <= 20")
def st3(spark, sf):
    people = table(spark, sf, "documents").select(F.col("doc_id").alias("resume_id"))
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("resume_id"), "embedding").join(people, "resume_id", "left_semi")
    root, path = _landing(spark, vectors, 3)
    ST.score_stream(ST.new_files(spark, path, vectors.schema, per_batch=1), jobs(spark, sf), DIM, 20, root)
    return ST.standing_pool(spark, root, 20).select("jd_id", "resume_id", F.round("cosine", 4).alias("cosine"))


@query("st4", "SELECT user_id % 3 AS store, count(*) AS total, count(*) FILTER (event_type <> 'error') AS succeeded, count(*) FILTER (event_type = 'error') AS failed, round(count(*) FILTER (event_type <> 'error') * 100.0 / count(*), 1) AS success_rate FROM events GROUP BY 1")
def st4(spark, sf):
    log = table(spark, sf, "events").select((F.col("user_id") % 3).alias("store"), "event_type")
    root, path = _landing(spark, log, 4)
    ST.metrics_stream(ST.new_files(spark, path, log.schema, per_batch=2), F.expr("event_type <> 'error'"), "store", root)
    return ST.running_metrics(spark, root, "store")


# ---- variants --------------------------------------------------------------------------------

HAVE, NEED = "total_experience", "required_experience"


@query("k1", f"{POOL_SQL} SELECT jd_id, resume_id, round(CASE WHEN required_experience <= 0 THEN 100.0 WHEN total_experience >= required_experience THEN 80 + least(20, (total_experience - required_experience) * 5) ELSE total_experience / required_experience * 70 END, 4) AS score FROM p")
def k1(spark, sf):
    return _pairs(spark, sf).select("jd_id", "resume_id", F.round(P.experience_curve(F.col(HAVE), F.col(NEED)), 4).alias("score"))


@query("k2", """WITH o AS (SELECT o_custkey, list({'e': CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE year(o_orderdate) END, 'd': lower(o_orderpriority || ' ' || o_orderstatus)} ORDER BY o_orderkey) AS ps FROM orders GROUP BY 1),
  s AS (SELECT o_custkey, list_transform(ps, lambda p: p.d) AS d, list_transform(ps, lambda p: coalesce(p.e, 9999)) AS e FROM o),
  r AS (SELECT o_custkey, list(d ORDER BY e DESC, i) AS d FROM (SELECT o_custkey, unnest(d) AS d, unnest(e) AS e, unnest(range(1, len(d) + 1)) AS i FROM s) GROUP BY 1),
  m AS (SELECT o_custkey, len(d) AS n, len(list_filter(['urgent', 'high', 'f'], lambda k: contains(d[1], k))) / 3.0 AS a, len(list_filter(['urgent', 'high', 'f'], lambda k: contains(coalesce(d[2], ''), k))) / 3.0 AS b FROM r)
  SELECT o_custkey, CAST(CASE WHEN a >= 0.7 THEN 100 WHEN a >= 0.3 THEN 80 WHEN n > 1 AND b >= 0.5 THEN 60 ELSE 40 END AS DOUBLE) AS score FROM m""")
def k2(spark, sf):
    end = F.when(F.col("o_orderkey") % 4 != 0, F.year("o_orderdate"))
    history = table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct(
        "o_orderkey", end.alias("end"), F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("description")
    ))).alias("ps"))
    return history.select("o_custkey", P.recency_score(F.col("ps"), F.array(F.lit("Urgent"), F.lit("High"), F.lit("F"))).alias("score"))


@query("k3", f"{POOL_SQL}, {comp_sql()} SELECT jd_id, resume_id, least({O.rnd('search_score * 0.50 + skill_score * 0.25 + position_score * 0.10 + exp_score * 0.15', 2)}, 100.0) AS score FROM comp")
def k3(spark, sf):
    return R.rerank(R.components(_pairs(spark, sf)), "documented", out="score").select("jd_id", "resume_id", "score")


@query("k4", f"{POOL_SQL} SELECT jd_id, resume_id FROM p WHERE total_experience >= 2 AND search_score >= 1 AND list_contains(list_transform(skills, lambda s: lower(s)), lower(required_skills[1]))")
def k4(spark, sf):
    mandatory = F.slice("required_skills", 1, 1)
    return _pairs(spark, sf).filter((F.col(HAVE) >= 2) & (F.col("search_score") >= 1) & P.holds_all(F.col("skills"), mandatory)).select("jd_id", "resume_id")


@query("k5", f"{O.BASE},\n{O.COSINE_SQL} SELECT jd_id, resume_id, round(CASE WHEN max(cosine) OVER w = min(cosine) OVER w THEN 50.0 ELSE (cosine - min(cosine) OVER w) / (max(cosine) OVER w - min(cosine) OVER w) * 100 END, 4) AS score FROM vpool WINDOW w AS (PARTITION BY jd_id)")
def k5(spark, sf):
    from vitaspark.functions.scores import flat_minmax_percent

    from .ranking import _vpool

    return _vpool(spark, sf).select("jd_id", "resume_id", F.round(flat_minmax_percent(F.col("cosine"), "jd_id"), 4).alias("score"))


@query("k6", f"""WITH {JOBS_SQL}, s AS (SELECT DISTINCT jd_id, lower(text) AS t, lower(sk) AS w FROM (SELECT jd_id, text, unnest(required_skills) AS sk FROM jobs)),
  c AS (SELECT jd_id, w, instr(t, w) AS p, (length(t) - length(replace(t, w, ''))) / CAST(length(w) AS DOUBLE) AS n, length(t) AS l FROM s)
  SELECT jd_id, w AS skill, CASE WHEN p > 0 THEN {O.rnd('(1.0 - (p - 1) / CAST(greatest(l, 1) AS DOUBLE)) * 0.5 + least(n, 5.0) / 5.0 * 0.5', 4)} ELSE 0.0 END AS importance FROM c""")
def k6(spark, sf):
    s = jobs(spark, sf).select("jd_id", "text", F.explode("required_skills").alias("s")).select("jd_id", "text", F.lower("s").alias("skill")).distinct()
    return s.select("jd_id", "skill", P.skill_importance(F.col("text"), F.col("skill")).alias("importance"))


@query("k6_context", f"""WITH s AS (SELECT item_id, text AS t, {O.tokens('text')} AS ws FROM benchmark), k AS (SELECT DISTINCT item_id, t, ws, unnest(ws) AS w FROM s),
  pos AS (SELECT item_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM s), cue AS (SELECT * FROM pos WHERE w IN ('the', 'with', 'of', 'in')),
  near AS (SELECT p.item_id, p.w, p.i, arg_max(c.w, c.i) AS c FROM pos p LEFT JOIN cue c ON c.item_id = p.item_id AND c.i < p.i AND c.i >= p.i - 10 GROUP BY ALL),
  ctx AS (SELECT item_id, w, max(CASE WHEN c IN ('the', 'with') THEN 1.0 WHEN c IN ('of', 'in') THEN 0.3 ELSE 0.6 END) AS context FROM near GROUP BY ALL),
  e AS (SELECT item_id, w, instr(lower(t), w) AS p, (length(t) - length(replace(lower(t), w, ''))) / CAST(length(w) AS DOUBLE) AS n, length(t) AS l FROM k)
  SELECT item_id, w AS skill, {O.rnd(f"({O.rnd('(1.0 - (p - 1) / CAST(greatest(l, 1) AS DOUBLE)) * 0.5 + least(n, 5.0) / 5.0 * 0.5', 4)}) * 0.7 + CAST(context AS DOUBLE) * 0.3", 4)} AS importance FROM e JOIN ctx USING (item_id, w)""")
def k6_context(spark, sf):
    """Every word of an item as a skill; frequent words of the texts stand for cue words."""
    from vitaspark.functions.text import tokens

    words = table(spark, sf, "benchmark").select("item_id", "text", F.explode(F.array_distinct(tokens(F.col("text")))).alias("skill"))
    return words.select("item_id", "skill", P.importance_in_context(F.col("text"), F.col("skill"), ["the", "with"], ["of", "in"]).alias("importance"))


@query("k7", f"""SELECT o_custkey, {O.rnd("sum(CASE o_orderstatus WHEN 'F' THEN CAST(100 AS DOUBLE) WHEN 'O' THEN 50.0 ELSE 10.0 END * (1 + o_orderkey % 5)) / CAST(sum(1 + o_orderkey % 5) AS DOUBLE)", 4)} AS quality FROM orders GROUP BY 1""")
def k7(spark, sf):
    relevance = F.when(F.col("o_orderstatus") == "F", 100.0).when(F.col("o_orderstatus") == "O", 50.0).otherwise(10.0)
    return P.quality_by_key(table(spark, sf, "orders"), "o_custkey", relevance, (F.col("o_orderkey") % 5 + 1).cast("double"))


@query("k8", f"""{POOL_SQL}, q AS (SELECT jd_id, avg(CASE WHEN len(positions) > 1 THEN 1.0 ELSE 0.0 END) AS quality FROM p GROUP BY 1)
  SELECT jd_id, round(quality, 4) AS quality, round(CASE WHEN quality < 0.5 THEN 0.30 - (0.5 - quality) * 0.30 ELSE 0.30 END, 4) AS skill_weight FROM q""")
def k8(spark, sf):
    q = _pairs(spark, sf).groupBy("jd_id").agg(F.avg((F.size("positions") > 1).cast("double")).alias("quality"))
    return q.select("jd_id", F.round("quality", 4).alias("quality"), F.round(P.shifted_weights(F.lit(0.30), F.col("quality")), 4).alias("skill_weight"))


@query("k8_pool", f"""{POOL_SQL}, q AS (SELECT *, {O.rnd("avg((CASE WHEN len(positions) > 1 THEN 1.0 ELSE 0.0 END + CASE WHEN total_experience > 5 THEN 1.0 ELSE 0.0 END) / 2.0) OVER (PARTITION BY jd_id)", 4)} AS quality FROM p)
  SELECT jd_id, resume_id, quality, CASE WHEN quality < 0.5 THEN 50.0 ELSE search_score END AS score FROM q""")
def k8_pool(spark, sf):
    pairs = _pairs(spark, sf).withColumns({"a": F.when(F.size("positions") > 1, 1), "b": F.when(F.col("total_experience") > 5, 1)})
    return P.quality_weighted(pairs, ["a", "b"], F.col("search_score"), F.lit(50.0)).select("jd_id", "resume_id", "quality", "score")


@query("k9", f"""{O.BASE}, {O.COSINE_SQL}, {O.text_ctes('text', ['skills', 'summary'], False)},
  traw AS (SELECT jd_id, resume_id, {O.settle("sum(exact)")} AS raw_score FROM fs GROUP BY ALL),
  tpool AS (SELECT jd_id, resume_id, raw_score FROM (SELECT *, row_number() OVER (PARTITION BY jd_id ORDER BY raw_score DESC, resume_id) AS rn FROM traw) JOIN jobs USING (jd_id) WHERE rn <= greatest(3 * max_results, 30)),
  a AS (SELECT jd_id, resume_id, {O.minmax('cosine')} AS s FROM vpool), b AS (SELECT jd_id, resume_id, least({O.rnd('raw_score / max(raw_score) OVER (PARTITION BY jd_id) * 100.0', 2)}, 100.0) AS s FROM tpool)
  SELECT jd_id, resume_id, {O.rnd('coalesce(a.s, 0.0) * 0.7 + coalesce(b.s, 0.0) * CAST(0.3 AS DOUBLE)', 2)} AS score FROM a FULL OUTER JOIN b USING (jd_id, resume_id)""")
def k9(spark, sf):
    from vitaspark.functions.scores import max_percent, minmax_percent

    from .ranking import _vpool

    j, c = jobs(spark, sf), candidates(spark, sf)
    near = _vpool(spark, sf).select("jd_id", "resume_id", minmax_percent(F.col("cosine"), "jd_id").alias("score"))
    raw = L.text_scores(j, F.col("text"), c, exact_boosts={"skills": 1.0, "summary": 1.0}, best_fields={}, fuzzy=False, k=R.largest_pool(j))
    text = R.candidate_pool(raw, j).select("jd_id", "resume_id", max_percent(F.col("raw_score"), "jd_id").alias("score"))
    return P.blend(near, text)


@query("k10", f"{POOL_SQL}, {comp_sql()}, t AS (SELECT unnest(['balanced', 'search']) AS name, unnest([0.25, 0.7]) AS a, unnest([0.25, 0.1]) AS b, unnest([0.25, 0.1]) AS c, unnest([0.25, 0.1]) AS d) SELECT jd_id, resume_id, name, {O.rnd('search_score * a + skill_score * b + position_score * c + exp_score * d', 2)} AS total FROM comp, t")
def k10(spark, sf):
    sets = spark.createDataFrame([("balanced", 0.25, 0.25, 0.25, 0.25), ("search", 0.7, 0.1, 0.1, 0.1)], "name STRING, w_search DOUBLE, w_skill DOUBLE, w_position DOUBLE, w_experience DOUBLE")
    return P.weight_grid(R.components(_pairs(spark, sf)), sets).withColumn("total", R.S.rounded(F.col("total"), 2))


@query("k10_overlap", f"""{POOL_SQL}, {comp_sql()}, a AS (SELECT jd_id, resume_id FROM (SELECT *, row_number() OVER (PARTITION BY jd_id ORDER BY search_score DESC, resume_id) AS rn FROM comp) WHERE rn <= 5),
  b AS (SELECT jd_id, resume_id, 1 AS hit FROM (SELECT *, row_number() OVER (PARTITION BY jd_id ORDER BY skill_score DESC, resume_id) AS rn FROM comp) WHERE rn <= 5)
  SELECT jd_id, {O.rnd('count(hit) / CAST(count(*) AS DOUBLE)', 4)} AS overlap FROM a LEFT JOIN b USING (jd_id, resume_id) GROUP BY jd_id""")
def k10_overlap(spark, sf):
    scored = R.components(_pairs(spark, sf))
    return P.overlap_at_k(R.final_order(scored, 5, "search_score"), R.final_order(scored, 5, "skill_score"))


@query("k11", f"{POOL_SQL} SELECT jd_id, resume_id, CASE WHEN search_score >= 80 THEN 'excellent' WHEN search_score >= 60 THEN 'good' WHEN search_score >= 40 THEN 'moderate' ELSE 'poor' END AS band FROM p")
def k11(spark, sf):
    return _pairs(spark, sf).select("jd_id", "resume_id", P.score_band(F.col("search_score")).alias("band"))


@query("k12", f"{O.BASE},\n{O.COSINE_SQL} SELECT resume_id, jobs, jd_id FROM vpool JOIN (SELECT resume_id, count(DISTINCT jd_id) AS jobs FROM vpool GROUP BY resume_id HAVING count(DISTINCT jd_id) >= 2) USING (resume_id)")
def k12(spark, sf):
    from .ranking import _vpool

    return P.multi_job_candidates(L.stable(_vpool(spark, sf)))


@query("k12_pools", f"""{O.BASE}, s AS (SELECT DISTINCT resume_id, lower(sk) AS skill FROM (SELECT resume_id, unnest(skills) AS sk FROM cand)),
  w AS (SELECT DISTINCT jd_id, lower(sk) AS skill FROM (SELECT jd_id, unnest(required_skills) AS sk FROM jobs)), n AS (SELECT jd_id, count(*) AS wanted FROM w GROUP BY 1),
  h AS (SELECT jd_id, resume_id, count(*) AS held FROM w JOIN s USING (skill) GROUP BY ALL)
  SELECT jd_id, wanted, count(resume_id) FILTER (held = wanted) AS holders, count(resume_id) AS with_any FROM n LEFT JOIN h USING (jd_id) GROUP BY ALL""")
def k12_pools(spark, sf):
    pools = P.skill_pools(candidates(spark, sf), "resume_id", "skills")
    return P.pool_sizes(jobs(spark, sf), pools, "jd_id", "required_skills")


@query("k13", """WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM documents), c AS (SELECT doc_id, w, unnest(range(0, greatest(CAST(ceil(len(w) / 512.0) AS BIGINT), 1))) AS chunk FROM w)
  SELECT doc_id, CAST(chunk AS INT) AS chunk, md5(array_to_string(w[chunk * 512 + 1:chunk * 512 + 512], ' ')) AS chunk_md5 FROM c""")
def k13(spark, sf):
    return P.chunk_tokens(table(spark, sf, "documents").select("doc_id", "text"), "text").select("doc_id", "chunk", F.md5("chunk_text").alias("chunk_md5"))


@query("k14", """SELECT vec_id, CAST(list_sum(list_transform(v, lambda x: round_even(x / list_max(list_transform(v, lambda y: abs(y))) * 127, 0))) AS BIGINT) AS total FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)""")
def k14(spark, sf):
    q = table(spark, sf, "embeddings").select("vec_id", P.quantize(F.col("embedding")).alias("q"))
    return q.select("vec_id", F.aggregate("q", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


@query("k14_pca")
def k14_pca(spark, sf):
    out = P.project_vectors(table(spark, sf, "embeddings").select("vec_id", "embedding"), "embedding", 8)
    return out.select("vec_id", F.size("projected").alias("dim"))


@query("k15", f"{POOL_SQL} SELECT jd_id, resume_id, round(CASE WHEN total_experience >= required_experience + 3 THEN 100.0 WHEN total_experience >= required_experience THEN 80 + (total_experience - required_experience) / 3.0 * 20 ELSE total_experience / required_experience * 80 END, 4) AS score FROM p")
def k15(spark, sf):
    return _pairs(spark, sf).select("jd_id", "resume_id", F.round(P.preferred_experience(F.col(HAVE), F.col(NEED), F.col(NEED) + 3), 4).alias("score"))


@query("k16", "SELECT d.doc_id, coalesce(CAST(quality AS DOUBLE) * 100, 50.0) AS score FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def k16(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", (F.col("quality").cast("double") * 100).alias("q"))
    return table(spark, sf, "documents").select("doc_id").join(labels, "doc_id", "left").select("doc_id", P.or_default(F.col("q")).alias("score"))


@query("k17")
def k17(spark, sf):
    feedback = R.components(_pairs(spark, sf)).join(
        table(spark, sf, "labels").select(F.col("doc_id").alias("resume_id"), F.col("quality").cast("double").alias("label")), "resume_id"
    )
    model = P.fit_weights(feedback, ["search_score", "skill_score", "exp_score", "position_score"])
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(R.components(_pairs(spark, sf)))
    return scored.select("jd_id", "resume_id", F.round(vector_to_array("probability")[1], 4).alias("chance"))


@query("k18", f"""{O.BASE}, s AS (SELECT DISTINCT resume_id, lower(sk) AS skill FROM (SELECT resume_id, unnest(skills) AS sk FROM cand)), g AS (SELECT DISTINCT lower(sk) AS skill FROM (SELECT unnest(required_skills) AS sk FROM jobs)),
  c AS (SELECT a.skill, b.skill AS related, count(*) AS together FROM s a JOIN g USING (skill) JOIN s b ON a.resume_id = b.resume_id AND a.skill <> b.skill GROUP BY ALL)
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY skill ORDER BY together DESC, related) AS rank FROM c) WHERE rank <= 3""")
def k18(spark, sf):
    held = candidates(spark, sf).select("resume_id", F.explode("skills").alias("s")).select("resume_id", F.lower("s").alias("skill")).distinct()
    wanted = jobs(spark, sf).select(F.explode("required_skills").alias("s")).select(F.lower("s").alias("skill")).distinct()
    return P.related_skills(held, wanted).withColumn("rank", F.col("rank").cast("bigint"))


@query("u1", "SELECT page_id, upper(regexp_extract(url, '//([^/:]+)', 1)) AS host FROM pages")
def u1(spark, sf):
    from vitaspark.operators.extract import pattern_ladder

    host = pattern_ladder(F.col("url"), [(r"ftp://([^/]+)", 1), (r"//([^/:]+)", 1)], F.upper)
    return table(spark, sf, "pages").select("page_id", host.alias("host"))


@query("u2", "SELECT doc_id, md5(text) AS text_md5, 256 AS dim FROM documents")
def u2(spark, sf):
    """Vectors by the pluggable provider, made once per distinct text and joined back."""
    from vitaspark.functions.vectors import embed_hashed
    from vitaspark.operators.normalize import distinct_work
    from vitaspark.plans.sizing import lookup

    docs = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("text_md5"), "text")
    vectors = embed_hashed(distinct_work(docs), "text", dim=256).select("text_md5", F.size("embedding").alias("dim"))
    return lookup(docs.drop("text"), vectors, "text_md5").select("doc_id", "text_md5", "dim")


@query("u4", f"WITH d AS (SELECT DISTINCT unnest({O.tokens('text')}) AS term FROM benchmark), t AS (SELECT doc_id, unnest(list_distinct({O.tokens('text')})) AS term FROM documents) SELECT doc_id, term FROM t JOIN d USING (term)")
def u4(spark, sf):
    """A dictionary that comes as a table instead of the fixed lists."""
    from vitaspark.functions.text import tokens

    terms = table(spark, sf, "benchmark").select(F.explode(tokens(F.col("text"))).alias("term")).distinct()
    found = table(spark, sf, "documents").select("doc_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    return found.join(terms, "term", "left_semi").select("doc_id", "term")


@query("u3", f"""{POOL_SQL}, {comp_sql()} SELECT jd_id, resume_id, profile, {O.rnd('search_score * a + skill_score * b + position_score * c + exp_score * d', 2)} AS score FROM comp,
  (VALUES ('vector', 0.40, 0.30, 0.10, 0.20), ('hybrid', 0.55, 0.25, 0.10, 0.10), ('documented', 0.50, 0.25, 0.10, 0.15)) AS w(profile, a, b, c, d)""")
def u3(spark, sf):
    scored = R.components(_pairs(spark, sf))
    parts = [F.struct(F.lit(n).alias("profile"), R.S.weighted_score(n, *[F.col(c) for c in ("search_score", "skill_score", "position_score", "exp_score")]).alias("score")) for n in ("vector", "hybrid", "documented")]
    return scored.select("jd_id", "resume_id", F.inline(F.array(*parts)))


@query("g1_match", f"""{MATCH_SQL}, m AS (SELECT jd_id, unnest(missing) AS skill FROM cov)
  SELECT jd_id, skill, count(*) AS missing_count, {O.rnd('count(*) * 100.0 / any_value(t.n)', 1)} AS missing_percent FROM m JOIN (SELECT jd_id, count(*) AS n FROM cov GROUP BY jd_id) t USING (jd_id) GROUP BY jd_id, skill""")
def g1_match(spark, sf):
    return R.skill_gaps(L.stable(M.match(jobs(spark, sf), candidates(spark, sf), DIM).select("jd_id", "missing")))
