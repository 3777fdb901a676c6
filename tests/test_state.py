"""Streaming state, pools as bitmaps and bounded pair counts against brute force."""

import uuid
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from vitaspark.operators import optional as P
from vitaspark.session import ensure_checkpoint_dir
from vitaspark.streaming import jobs as ST


def fresh(spark):
    return f"{ensure_checkpoint_dir(spark)}/state-{uuid.uuid4().hex}"


def land(spark, root, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{root}/in")


def test_one_record_per_key_over_batches(spark):
    root, schema = fresh(spark), "doc_id BIGINT, text STRING"
    batches = [[(1, "a"), (2, "b"), (3, "a")], [(4, "b"), (5, "c"), (6, None), (7, "")], [(8, "a"), (9, None), (10, "d")], [(1, "a"), (2, "b")]]
    seen, written = {}, []
    for rows in batches:
        land(spark, root, rows, schema)
        ST.distinct_stream(ST.new_files(spark, f"{root}/in", schema, per_batch=1), F.md5("text"), root)
        for _, text in rows:
            seen.setdefault(text, {i for i, t in rows if t == text})
        kept = ST.distinct_records(spark, root).collect()
        assert Counter(r["text"] for r in kept) == Counter(list(seen))
        assert all(r["doc_id"] in seen[r["text"]] for r in kept)
        written.append(len(kept))
    assert written == [2, 5, 6, 6]
    # nothing new: the stream goes on from its place and writes no record again
    ST.distinct_stream(ST.new_files(spark, f"{root}/in", schema, per_batch=1), F.md5("text"), root)
    assert ST.distinct_records(spark, root).count() == 6


def test_totals_after_each_batch(spark):
    root, schema = fresh(spark), "store STRING, ok BOOLEAN"
    batches = [[("x", True), ("x", False), ("y", True)], [("y", False)], [("z", True), ("x", True), (None, False)]]
    log, wanted = [], []
    for rows in batches:
        land(spark, root, rows, schema)
        ST.metrics_stream(ST.new_files(spark, f"{root}/in", schema, per_batch=1), F.col("ok"), "store", root)
        log += rows
        total, good = Counter(s for s, _ in log), Counter(s for s, ok in log if ok)
        wanted.append({(s, n, good[s], n - good[s], round(good[s] * 100.0 / n, 1)) for s, n in total.items()})
    pick = ("store", "total", "succeeded", "failed", "success_rate")
    for number, want in enumerate(wanted):
        assert {tuple(r) for r in ST.running_metrics(spark, root, "store", number).select(*pick).collect()} == want
    assert {tuple(r) for r in ST.running_metrics(spark, root, "store").select(*pick).collect()} == wanted[-1]


def test_pools_are_whole(spark):
    rng = np.random.default_rng(11)
    names = ["Python", "SQL", "Go", "Rust", "C++"]
    people = [(int(i) * 7919, [s for s in names if rng.random() < 0.5] + ["python"] * int(rng.integers(2))) for i in range(400)]
    people += [(None, ["SQL"]), (5, None), (6, []), (7, [None, "sql"])]
    wishes = [(1, ["python", "SQL"]), (2, ["Go", "go", None]), (3, ["Python", "Cobol"]), (4, []), (5, None), (6, names)]
    got = P.pool_sizes(
        spark.createDataFrame(wishes, "jd_id BIGINT, w ARRAY<STRING>"),
        P.skill_pools(spark.createDataFrame(people, "resume_id BIGINT, skills ARRAY<STRING>"), "resume_id", "skills"), "jd_id", "w",
    )
    want = set()
    for jd, asked in wishes:
        need = {s.lower() for s in asked or [] if s}
        held = [{s.lower() for s in skills or [] if s} for i, skills in people if i is not None]
        want.add((jd, len(need), sum(bool(need) and need <= h for h in held), sum(bool(need & h) for h in held)))
    assert {tuple(r) for r in got.collect()} == want


def test_related_skills_build_fewer_pairs(spark):
    rng = np.random.default_rng(12)
    rows = set()
    for person in range(300):
        rows |= {(person, f"s{int(v)}") for v in np.minimum(rng.zipf(1.3, 12), 400)}
    gaps = sorted({s for _, s in rows})[::3] + ["nobody"]
    held = {}
    for person, skill in rows:
        held.setdefault(person, set()).add(skill)
    together = Counter((a, b) for skills in held.values() for a in skills for b in skills if a != b and a in set(gaps))
    want = set()
    for gap in gaps:
        best = sorted(((-n, b) for (a, b), n in together.items() if a == gap))[:3]
        want |= {(gap, b, -n, rank) for rank, (n, b) in enumerate(best, 1)}
    skills = spark.createDataFrame(sorted(rows), "resume_id BIGINT, skill STRING")
    missing = spark.createDataFrame([(g,) for g in gaps], "skill STRING")
    got = {(r["skill"], r["related"], r["together"], r["rank"]) for r in P.related_skills(skills, missing).collect()}
    assert got == want
    built = P.related_pairs(skills, missing).count()
    assert built < 0.8 * sum(together.values())


def test_wording_around_a_skill(spark):
    text = "Required skills: Python, Spring Boot and SQL. Nice to have: Go. We also use boot camps, spring water and much else besides these, Rust"
    rows = [(text, s) for s in ["Python", "spring boot", "SQL", "Go", "Rust", "boot spring", "Cobol", ""]] + [(None, "Go"), ("", "Go"), (text, None)]
    df = spark.createDataFrame(rows, "text STRING, skill STRING")
    got = {(r["skill"], r["text"] == text): r["c"] for r in df.select("*", P.mention_context(F.col("text"), F.col("skill"), ["required", "must"], ["nice", "plus"]).alias("c")).collect()}
    assert [got[s, True] for s in ["Python", "spring boot", "SQL", "Go", "Rust", "boot spring", "Cobol", ""]] == [1.0, 1.0, 1.0, 0.3, 0.6, None, None, None]
    assert got["Go", False] is None and got[None, True] is None
    out = df.select(P.importance_in_context(F.col("text"), F.col("skill"), ["required"], ["nice"]).alias("v")).collect()
    assert out[0]["v"] > out[3]["v"] > 0 and out[6]["v"] == out[7]["v"] == 0
