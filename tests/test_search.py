"""Vector and text retrieval against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitaspark.operators import lexical as L
from vitaspark.operators.vector_search import cosine_top_k
from vitaspark.plans import match as M


def vectors(spark, n, dim, name, seed):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, dim)]) for i in range(n)]
    rows += [(n, None), (n + 1, [0.0] * dim), (n + 2, rows[0][1])]
    return rows, spark.createDataFrame(rows, f"{name} BIGINT, embedding ARRAY<FLOAT>")


def test_top_k_both_ways(spark):
    jobs_rows, jobs = vectors(spark, 7, 6, "jd_id", 1)
    item_rows, items = vectors(spark, 60, 6, "resume_id", 2)
    expected = {}
    for j, a in jobs_rows:
        if not a or not any(a):
            continue
        sims = []
        for r, b in item_rows:
            if b and any(b):
                c = np.dot(a, b) / math.sqrt(np.dot(a, a) * np.dot(b, b))
                sims.append((-round(float(c), 9), r))
        expected[j] = [r for _, r in sorted(sims)[:5]]
    for kwargs in ({}, {"max_job_cells": 12}):
        got = {}
        for row in cosine_top_k(jobs, items.repartition(3), 5, dim=6, **kwargs).orderBy("jd_id", "rank").collect():
            got.setdefault(row["jd_id"], []).append(row["resume_id"])
        assert got == expected


def test_floor_applies_before_the_cut(spark):
    rng = np.random.default_rng(7)
    jobs = [(j, [float(x) for x in rng.integers(-3, 4, 6)], need) for j, need in enumerate([0.0, 3.0, 9.0, 50.0, None])]
    items = [(i, [float(x) for x in rng.integers(-3, 4, 6)], None if i % 11 == 0 else float(i % 12)) for i in range(200)]
    got = {}
    top = cosine_top_k(
        spark.createDataFrame(jobs, "jd_id BIGINT, embedding ARRAY<FLOAT>, need DOUBLE"),
        spark.createDataFrame(items, "resume_id BIGINT, embedding ARRAY<FLOAT>, years DOUBLE").repartition(3), 5, dim=6, least=("need", "years"),
    )
    for row in top.orderBy("jd_id", "rank").collect():
        got.setdefault(row["jd_id"], []).append(row["resume_id"])
    want = {}
    for j, a, need in jobs:
        sims = [
            (-round(float(np.dot(a, b) / math.sqrt(np.dot(a, a) * np.dot(b, b))), 9), i)
            for i, b, years in items if any(a) and any(b) and years is not None and need is not None and years >= need
        ]
        if sims:
            want[j] = [i for _, i in sorted(sims)[:5]]
    assert got == want and {0, 1, 2} <= set(want) and 3 not in want


def test_prefiltered_pools_hold_the_fitting_pairs(spark):
    import __spark_entry__  # noqa: F401
    from workload.roles import DIM, candidates, jobs

    sf = "/root/testdata/sf0.001"
    few = jobs(spark, sf).filter("jd_id % 4 = 1").withColumn("max_results", F.lit(100))
    docs = candidates(spark, sf).cache()
    # the pool of 300 holds every candidate, so both orders of cut and filter must agree
    assert docs.count() <= 300
    whole = M.hybrid_pool(few, docs, DIM).join(docs.select("resume_id", "total_experience"), "resume_id").join(few.select("jd_id", "required_experience"), "jd_id")
    pick = ["jd_id", "resume_id", F.round("raw_score", 6)]
    got = {tuple(r) for r in M.hybrid_pool(few, docs, DIM, prefilter=True).select(*pick).collect()}
    assert got == {tuple(r) for r in whole.filter("total_experience >= required_experience").select(*pick).collect()} and got


def test_rejected_jobs(spark):
    rows = [(1, "a long enough text"), (2, "  short  "), (3, ""), (4, None), (5, "          "), (6, "ten chars!")]
    kept, left = M.split_jobs(spark.createDataFrame(rows, "jd_id BIGINT, text STRING"))
    assert sorted(r["jd_id"] for r in kept.collect()) == [1, 6]
    assert sorted((r["jd_id"], r["error"].split()[0]) for r in left.collect()) == [(2, "job"), (3, "empty"), (4, "empty"), (5, "empty")]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for k, y in enumerate(b, 1):
            prev, row[k] = row[k], min(row[k] + 1, row[k - 1] + 1, prev + (x != y))
    return row[-1]


def test_fuzzy_pairs_lose_nothing(spark):
    rng = np.random.default_rng(5)
    words = {"".join(rng.choice(list("abcé"), size=rng.integers(2, 10))) for _ in range(500)}
    wanted = sorted(words)[::4]
    allowed = lambda w: 0 if len(w) < 4 else 1 if len(w) < 7 else 2
    expected = {(w, t, edits(w, t)) for w in wanted for t in words if edits(w, t) <= allowed(w)}
    frame = lambda ws: spark.createDataFrame([(w,) for w in ws], "term STRING")
    got = {tuple(r) for r in L.fuzzy_pairs(frame(wanted), frame(sorted(words))).collect()}
    assert got == expected and len(expected) > len(wanted)


def docs(spark):
    rows = [
        (1, ["Python", "Apache Spark"], ["Data Engineer"], "builds data pipelines", 5.0, [1.0, 0.0]),
        (2, ["Java"], ["Developer"], "java services", 2.0, [0.0, 1.0]),
        (3, ["Pythn"], ["Data Engineer"], "data", 8.0, None),
    ]
    return spark.createDataFrame(
        rows, "resume_id BIGINT, skills ARRAY<STRING>, positions ARRAY<STRING>, summary STRING, total_experience DOUBLE, embedding ARRAY<FLOAT>"
    ).withColumns({c: F.lit(None).cast("string") for c in ("projects_description", "companies_description", "education_degree")})


def jobs(spark):
    rows = [(10, "python data pipelines", "Data Engineer", 3.0, ["Python", "Apache Spark"], [1.0, 0.0]), (11, "zzz", "", 0.0, ["qqq"], None)]
    return spark.createDataFrame(
        rows, "jd_id BIGINT, text STRING, job_title STRING, required_experience DOUBLE, required_skills ARRAY<STRING>, embedding ARRAY<FLOAT>"
    ).withColumns({
        "nice_to_have_skills": F.array().cast("array<string>"), "seniority_level": F.lit(None).cast("string"),
        "industry": F.lit(None).cast("string"), "max_results": F.lit(10), "min_experience": F.lit(0.0),
    })


def test_text_search_ranks_and_is_fuzzy(spark):
    rows = M.text_search(jobs(spark), docs(spark)).orderBy(F.desc("raw_score")).collect()
    assert [r["resume_id"] for r in rows if r["jd_id"] == 10] == [1, 3]
    assert rows[0]["score"] == 100.0


def test_match_end_to_end(spark):
    rows = M.match(jobs(spark), docs(spark), 2).collect()
    first = min((r for r in rows if r["jd_id"] == 10), key=lambda r: r["rank_position"])
    assert first["resume_id"] == 1 and first["missing"] == [] and first["skill_score"] == 100.0
    assert all(r["total_experience"] >= r["required_experience"] for r in rows)
    assert all(0 <= r["rerank_score"] <= 100 for r in rows)
    assert first["analysis"].startswith("Overall Match: ")


def test_fallback_only_for_unserved_jobs(spark):
    a = spark.createDataFrame([(1, 5)], "jd_id INT, resume_id INT")
    b = spark.createDataFrame([(1, 6), (2, 7)], "jd_id INT, resume_id INT")
    assert sorted(tuple(r) for r in M.with_fallback(a, b).collect()) == [(1, 5), (2, 7)]


def test_top_per_job_with_many_partitions(spark):
    from vitaspark.operators.vector_search import top_per_job

    df = spark.range(2000).select((F.col("id") % 3).alias("jd_id"), F.col("id").alias("resume_id"), (F.col("id") * 7 % 50).alias("s"))
    plain = sorted(tuple(r) for r in top_per_job(df, 10, "s").collect())
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "256")
    try:
        assert sorted(tuple(r) for r in top_per_job(df, 10, "s").collect()) == plain
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_limits_above_a_hundred_are_kept(spark):
    from vitaspark.operators.ranking import candidate_pool, final_order
    from vitaspark.sources.files import job_reports

    scored = spark.range(300).selectExpr("1L AS jd_id", "id AS resume_id", "cast(id % 97 AS double) AS raw_score")
    jobs = spark.createDataFrame([(1, "t", 0.0, ["x"], 250), (2, "u", 0.0, ["x"], 5)], "jd_id long, job_title string, required_experience double, required_skills array<string>, max_results int")
    assert candidate_pool(scored, jobs).count() == 300
    assert final_order(scored.join(jobs.select("jd_id", "max_results"), "jd_id"), F.col("max_results"), "raw_score").count() == 250
    ranked = final_order(scored, 300, "raw_score")
    parts = {(r.jd_id, r.part): r for r in job_reports(ranked, jobs).collect()}
    assert sorted(parts) == [(1, 1), (1, 2), (1, 3), (2, 1)]
    assert {r.total_results for r in parts.values()} == {300, 0}
    assert [r.rank_position for p in (1, 2, 3) for r in parts[1, p].results] == list(range(1, 301))


def test_vectors_left_out_are_named(spark):
    from vitaspark.operators.vector_search import vector_rejects

    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, None), (4, [0.0, 0.0])], "resume_id long, embedding array<float>")
    assert {r.resume_id: r.error for r in vector_rejects(rows, 2).collect()} == {2: "length 1", 3: "no vector", 4: "zero vector"}


@pytest.mark.parametrize("k", [1, 3, 40])
def test_best_scores_hold_the_best_of_all_pairs(spark, k):
    import hashlib
    import random

    from vitaspark.functions.lexicon import TEXT_BEST_FIELDS, TEXT_EXACT_BOOSTS
    from vitaspark.operators import lexical as L
    from vitaspark.operators.vector_search import top_per_job

    rng = random.Random(k)
    fields = sorted(set(TEXT_EXACT_BOOSTS) | set(TEXT_BEST_FIELDS))
    common, rare = [f"word{i}" for i in range(6)], [hashlib.md5(str(i).encode()).hexdigest()[:10] for i in range(600)]
    text = lambda: " ".join(common + rng.choices(common, k=4) + rng.sample(rare, 2))
    docs = spark.createDataFrame([(f"r{i:03d}", *[text() for _ in fields]) for i in range(150)], ["resume_id", *fields])
    jobs = spark.createDataFrame([(i, text(), k) for i in range(5)], "jd_id long, text string, k int")
    ask = lambda **more: L.text_scores(jobs, F.col("text"), docs, exact_boosts=TEXT_EXACT_BOOSTS, best_fields=TEXT_BEST_FIELDS, **more)
    limits = jobs.select("jd_id", "k")
    best = lambda scored: sorted(tuple(r) for r in top_per_job(scored.join(limits, "jd_id"), F.col("k"), "raw_score").select("jd_id", "resume_id", F.round("raw_score", 6), "rank").collect())
    everything, pruned = ask(), ask(limits=limits)
    assert best(pruned) == best(everything)
    assert pruned.count() <= everything.count()
    if k == 1:
        assert pruned.count() < everything.count() / 2  # pairs that can't win are never scored
