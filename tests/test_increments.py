"""Tables of deltas, incremental ingest and pools, and counts that add up, against whole recounts."""

import uuid

import numpy as np
from pyspark.sql import functions as F

from vitaspark.operators import lexical as L
from vitaspark.plans import ingest as P
from vitaspark.session import ensure_checkpoint_dir
from vitaspark.sources import stores as S
from vitaspark.sources.buckets import BUCKET, BucketTable
from vitaspark.streaming import jobs as ST


def fresh(spark):
    return f"{ensure_checkpoint_dir(spark)}/inc-{uuid.uuid4().hex}"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


SCHEMA = "resume_id BIGINT, name STRING, created BIGINT"


def test_deltas_equal_a_dictionary(spark):
    rng = np.random.default_rng(5)
    table, want, past = BucketTable(spark, fresh(spark), created="created", buckets=8), {}, []
    assert table.read() is None
    for version in range(6):
        ids = [None if i == 40 else int(i) for i in rng.choice(41, 9, replace=False)] if version else []
        gone = [int(i) for i in rng.choice(40, 4, replace=False)]
        fresh_rows = [(i, f"{version}-{i}", version) for i in ids]
        table.write(spark.createDataFrame(fresh_rows, SCHEMA), version, spark.createDataFrame([(i,) for i in gone], "resume_id BIGINT"))
        first = dict(past[-1][1]) if past else {}
        for i in gone:
            if i not in ids:
                want.pop(i, None)
        for i, name, v in fresh_rows:
            first.setdefault(i, v)
            want[i] = name
        past.append((dict(want), first))
        assert rows(table.read()) == sorted(((i, n, first[i]) for i, n in want.items()), key=repr)
        if version == 3:
            table.compact()
            assert rows(table.read()) == sorted(((i, n, first.get(i)) for i, n in want.items()), key=repr)
            past[-1] = (past[-1][0], {i: first[i] for i in want})
    table.write(spark.createDataFrame([(0, "again", 99)], SCHEMA), 2)  # a batch run again changes nothing, also behind a base
    assert {r["resume_id"]: r["name"] for r in table.read().collect()} == want
    assert {r["resume_id"]: r["name"] for r in table.read(before=5).collect()} == past[4][0]
    some = spark.createDataFrame([(3,), (7,), (None,), (999,)], "resume_id BIGINT")
    assert {r["resume_id"]: r["name"] for r in table.read(keys=some).collect()} == {i: want[i] for i in (3, 7, None) if i in want}


def test_a_lookup_reads_its_buckets_only(spark):
    """The scan for three keys is filtered by bucket in the plan, at three sizes of the store."""
    for size in (640, 2560, 10240):
        table = BucketTable(spark, fresh(spark))
        table.write(spark.range(size).select(F.col("id").alias("resume_id"), F.lit("x").alias("name")), 0)
        wanted = spark.createDataFrame([(1,), (2,), (3,)], "resume_id BIGINT")
        raw = table.read(keys=wanted)
        plan = raw._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters" in plan and BUCKET in plan.split("PartitionFilters")[1]
        buckets = {r[0] for r in wanted.select(table._bucket(["resume_id"])).collect()}
        assert len(buckets) <= 3 and raw.count() == 3


def test_writes_of_a_batch_do_not_follow_the_store(spark):
    """The bytes a batch adds are the same over stores of three sizes."""
    added = []
    for size in (100, 1000, 10000):
        root = fresh(spark)
        table = BucketTable(spark, root, created="created")
        table.write(spark.range(size).selectExpr("id AS resume_id", "concat('n', id) AS name", "0L AS created"), 0)
        table.write(spark.range(7).selectExpr("id AS resume_id", "'new' AS name", "1L AS created"), 1)
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/deltas/v=1")
        added.append(path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength())
        assert table.read().filter("name = 'new' AND created = 0").count() == 7
    assert added[0] == added[1] == added[2]


ANSWER = '{"full_name":"%s","email":%s,"phone_number":%s,"skills":%s,"companies":[],"education":[],"summary":"s"}'


def _answers(batch):
    out = []
    for i, name, mail, phone, skills in batch:
        quoted = [f'"{v}"' if v else "null" for v in (mail, phone)]
        text = "no answer" if name is None else ANSWER % (name, *quoted, "[" + ", ".join(f'"{s}"' for s in skills) + "]")
        out.append((i, "text of " + i, f"{i}.pdf", text))
    return out


def test_increments_equal_whole_versions(spark):
    batches = [
        [("r1", "Asha Rao", "a@x.org", "9876543211", ["Python", "Go"]), ("r2", "Ben Ode", "b@x.org", None, ["SQL"]), ("r3", None, None, None, []), ("r4", "Cy Dee", None, None, ["C"])],
        [("r5", "Asha Rao", "A@x.org", "9876543299", ["Rust"]), ("r3", "Dan Eff", "d@x.org", None, ["Go"]), ("r6", None, None, None, [])],
        # r1 changed its phone above, so the old number no longer leads to it; b's record comes without skills
        [("r7", "Eve Foe", "e@x.org", "9876543211", ["Ada"]), ("r8", "Ben Ode", "b@x.org", None, []), ("r6", None, None, None, [])],
    ]
    whole, parts = fresh(spark), fresh(spark)
    schema = "resume_id STRING, text STRING, filename STRING, response STRING"
    for version, batch in enumerate(batches):
        df = spark.createDataFrame(_answers(batch), schema)
        a = P.ingest_batch(spark, df, whole, stamp=version, version=version).first()
        b = P.ingest_increment(spark, df, parts, stamp=version, version=version).first()
        assert a == b
        if version == 1:
            P.ingest_increment(spark, df, parts, stamp=77, version=version)
            P.compact(spark, parts)
        for name in ("pii", "documents", "index", "errors"):
            old = S.SnapshotTable(spark, f"{whole}/{name}").read()
            new = P.increment_table(spark, parts, name).read()
            assert rows(old) == rows(new.select(*old.columns)), (version, name)
        for name, new in P.children_of(spark, parts).items():
            old = S.SnapshotTable(spark, f"{whole}/{name}").read()
            assert rows(old) == rows(new.select(*old.columns)), (version, name)
    ids = {r["resume_id"] for r in P.increment_table(spark, parts, "pii").read().collect()}
    assert ids == {"r1", "r2", "r3", "r7"}


def test_pool_of_batches_is_the_pool_of_all(spark):
    rng = np.random.default_rng(6)
    root, schema, k = fresh(spark), "resume_id BIGINT, embedding ARRAY<FLOAT>", 4
    jobs = spark.createDataFrame([(j, rng.normal(size=8).tolist()) for j in range(5)], "jd_id BIGINT, embedding ARRAY<FLOAT>")
    seen = []
    for number in range(4):
        batch = [(number * 100 + i, rng.normal(size=8).tolist()) for i in range(30)] + [(number * 100 + 50, None), (number * 100 + 51, [0.0] * 8)]
        seen += batch
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
        ST.score_stream(ST.new_files(spark, f"{root}/in", schema, per_batch=1), jobs, 8, k, root)
        want = ST.cosine_top_k(jobs, spark.createDataFrame(seen, schema), k, dim=8).drop("rank")
        assert rows(ST.standing_pool(spark, root, k)) == rows(want)
        if number == 2:
            ST.compact_pool(spark, root, k)
            assert rows(ST.standing_pool(spark, root, k)) == rows(want)
    one = spark.createDataFrame([(2,)], "jd_id BIGINT")
    assert rows(ST.standing_pool(spark, root, k, one)) == rows(want.filter("jd_id = 2"))


WORDS = "spark sql go rust data lake stream job team lead".split()


def _people(rng, start, n):
    return [(start + i, [str(w) for w in rng.choice(WORDS, int(rng.integers(4)))], " ".join(rng.choice(WORDS, int(rng.integers(9)))) or None) for i in range(n)]


def test_counts_add_up(spark):
    rng = np.random.default_rng(7)
    root, schema, fields = fresh(spark), "resume_id BIGINT, skills ARRAY<STRING>, summary STRING", ["skills", "summary"]
    jobs = spark.createDataFrame([(1, "spark sql spark"), (2, "lead of a data team"), (3, "cobol"), (4, None)], "jd_id BIGINT, text STRING")
    boosts, best = {"skills": 2.0, "summary": 1.0}, {"summary": 0.5}
    seen, pool = [], {}
    for number in range(3):
        batch = _people(rng, number * 100, 20 + 15 * number)
        seen += batch
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
        source = ST.new_files(spark, f"{root}/in", schema, per_batch=1)
        ST.score_text_stream(source, jobs, F.col("text"), 1000, root, exact_boosts=boosts, best_fields=best)
        everyone = spark.createDataFrame(seen, schema)
        assert rows(ST.running_dictionary(spark, root)) == rows(L.dictionary(everyone, fields).select("field", "term", "df", "tokens"))
        # the new candidates' scores are those that a search over everyone gives them
        whole = L.text_scores(jobs, F.col("text"), everyone, exact_boosts=boosts, best_fields=best, fuzzy=False)
        pool |= {(r["jd_id"], r["resume_id"]): r["raw_score"] for r in whole.filter(F.col("resume_id") >= number * 100).collect()}
        assert {(r["jd_id"], r["resume_id"]): r["raw_score"] for r in ST.text_pool(spark, root, 1000).collect()} == pool
    best_two = {(j, i) for j in (1, 2) for _, i in sorted((-s, i) for (jj, i), s in pool.items() if jj == j)[:2]}
    assert {(r["jd_id"], r["resume_id"]) for r in ST.text_pool(spark, root, 2).collect()} == best_two
    assert rows(ST.running_dictionary(spark, root, 0)) == rows(L.dictionary(spark.createDataFrame(seen[:20], schema), fields).select("field", "term", "df", "tokens"))


def test_statistics_alone(spark):
    rng = np.random.default_rng(8)
    root, schema = fresh(spark), "resume_id BIGINT, skills ARRAY<STRING>, summary STRING"
    people = _people(rng, 0, 40)
    spark.createDataFrame(people, schema).repartition(3).write.parquet(f"{root}/in")
    ST.statistics_stream(ST.new_files(spark, f"{root}/in", schema, per_batch=1), ["summary"], root)
    want = L.dictionary(spark.createDataFrame(people, schema), ["summary"]).select("field", "term", "df", "tokens")
    assert rows(ST.running_dictionary(spark, root)) == rows(want)
