"""Identity, snapshots, upserts and ingest."""

import uuid

import numpy as np
from pyspark.sql import functions as F

from vitaspark.operators import identity as I
from vitaspark.operators import metrics as G
from vitaspark.plans import ingest as P
from vitaspark.plans import sizing
from vitaspark.session import ensure_checkpoint_dir
from vitaspark.sources import files as FS
from vitaspark.sources import stores as ST


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_components_match_union_find(spark):
    rng = np.random.default_rng(3)
    people = [(i, f"U{rng.integers(60)}@x.org" if rng.random() < 0.7 else None, f"555-{rng.integers(100000, 100060)}") for i in range(150)]
    people += [(1000 + i, f"chain{i // 2}@x.org", f"777{100000 + (i + 1) // 2}") for i in range(40)]
    parent = {p[0]: p[0] for p in people}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    seen = {}
    for i, mail, phone in people:
        for key in ([mail.lower()] if mail else []) + ["".join(c for c in phone if c.isdigit())]:
            if key in seen:
                a, b = find(seen[key]), find(i)
                parent[max(a, b)] = min(a, b)
            seen[key] = i
    df = spark.createDataFrame(people, "resume_id BIGINT, email STRING, phone_number STRING")
    assert rows(I.components(df)) == sorted((p[0], find(p[0])) for p in people)


def test_lookup_splits_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(sizing, "BROADCAST_ROWS", 3)
    big = spark.range(100).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7).alias("k"))
    keyed = spark.createDataFrame([(i, f"v{i}") for i in range(6)], "k BIGINT, v STRING")
    got = sizing.lookup(big, keyed, "k", hot_rows=20)
    assert rows(got.select("id", "k", "v")) == rows(big.join(keyed, "k", "left").select("id", "k", "v"))


def test_tables_too_large_to_count_are_not_broadcast(spark, monkeypatch):
    people = [(f"{i:02}", f"u{i % 5}@x.org") for i in range(20)] + [("x", None), (None, "u9@x.org")]
    df = spark.createDataFrame(people, "resume_id STRING, email STRING").withColumns({"phone_number": F.lit(None).cast("string"), "updated_dt": F.lit(1)})
    plans, cut = [], I.stable

    def kept(table):
        plans.append(table._jdf.queryExecution().optimizedPlan().toString())
        return cut(table)

    monkeypatch.setattr(sizing, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(ST, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(I, "stable", kept)
    adopted = I.adopt_ids(df, df.limit(0))
    assert {(r.resume_id, r.final_id) for r in adopted.collect()} == {(f"{i:02}", f"{i % 5:02}") for i in range(20)} | {("x", "x"), (None, None)}
    # Spark's estimates, by which these few rows would be broadcast, decide about no join of rows
    plans += [t._jdf.queryExecution().optimizedPlan().toString() for t in (adopted, ST.delete(df, df), ST.fetch_many(df, df))]
    joins = [line for plan in plans for line in plan.splitlines() if "Join " in line]
    assert len(joins) > 10 and not [line for line in joins if "strategy=" not in line and "LeftSemi" not in line], joins
    assert all("strategy=merge" in plan for plan in plans[-2:])


OLD = [(1, "a", "x", 1), (2, "b", None, 1), (3, "c", "z", 1)]
NEW = [(2, "B", "n", 9), (4, "d", None, 9), (3, None, None, 9)]
SCHEMA = "resume_id BIGINT, name STRING, email STRING, created_dt BIGINT"


def test_upsert_both_ways(spark, monkeypatch):
    old, new = spark.createDataFrame(OLD, SCHEMA), spark.createDataFrame(NEW, SCHEMA)
    full = {(1, "a", "x", 1), (2, "B", "n", 1), (3, None, None, 1), (4, "d", None, 9)}
    part = {(1, "a", "x", 1), (2, "B", "n", 1), (3, "c", "z", 1), (4, "d", None, 9)}
    for limit in (1000, 0):
        monkeypatch.setattr(ST, "BROADCAST_ROWS", limit)
        assert {tuple(r) for r in ST.upsert(old, new).collect()} == full
        assert {tuple(r) for r in ST.upsert(old, new, partial=True).collect()} == part
    again = ST.upsert(ST.upsert(old, new), new)
    assert {tuple(r) for r in again.collect()} == full


def test_cleanup_keeps_one_of_each_group(spark):
    people = [(1, "a@x.org", "1234567"), (2, "A@x.org", "7654321"), (3, "c@x.org", "765-4321"), (9, None, None)]
    contacts = spark.createDataFrame(people, "resume_id BIGINT, email STRING, phone_number STRING")
    index = spark.createDataFrame([(1,), (2,), (3,), (5,)], "resume_id BIGINT")
    assert rows(I.cleanup_plan(index, contacts)) == [(2, "email"), (5, "orphan")]


def test_snapshot_versions(spark):
    root = f"{ensure_checkpoint_dir(spark)}/snap-{uuid.uuid4().hex}"
    table = ST.SnapshotTable(spark, root)
    assert table.read() is None
    assert table.write(spark.range(3)) == 0 and table.write(spark.range(5)) == 1
    assert table.read().count() == 5 and table.read(0).count() == 3
    table.write(spark.range(9), 1)  # a version that exists stays as it is
    assert table.read().count() == 5


def test_row_numbers_are_whole(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 37 % 1009).alias("v"))
    got = [r["row_number"] for r in G.global_row_number(df, "v").orderBy("v").collect()]
    assert got == list(range(1, 1001))


def test_ingest_batch_is_idempotent(spark):
    root = f"{ensure_checkpoint_dir(spark)}/ingest-{uuid.uuid4().hex}"
    response = '{"full_name":"Asha Rao","email":"%s","phone_number":"98765432%s","skills":["Python"],"companies":[],"summary":"s"}'
    batch = [
        ("r1", "Asha Rao writes", "Naukri_Asha[4y_6m].pdf", response % ("a@x.org", "1")),
        ("r2", "text two", "b.pdf", response % ("A@x.org", "2")), ("r3", "text three", "c.pdf", "no answer"),
    ]
    df = spark.createDataFrame(batch, "resume_id STRING, text STRING, filename STRING, response STRING")
    summary = P.ingest_batch(spark, df, root, stamp=1, version=0).first()
    assert (summary["total"], summary["succeeded"], summary["failed"]) == (3, 2, 1)
    first = rows(ST.SnapshotTable(spark, f"{root}/pii").read().select("resume_id", "email", "created_dt"))
    assert [r[0] for r in first] == ["r1"]  # both rows share an e-mail
    P.ingest_batch(spark, df, root, stamp=2, version=0)
    assert rows(ST.SnapshotTable(spark, f"{root}/pii").read().select("resume_id", "email", "created_dt")) == first
    later = spark.createDataFrame([("r9", "t", "d.pdf", response % ("zz@x.org", "3"))], df.schema)
    P.ingest_batch(spark, later, root, stamp=3, version=1)
    known = ST.SnapshotTable(spark, f"{root}/pii").read()
    assert known.count() == 2 and known.filter("created_dt = 3").count() == 1
    text = ST.SnapshotTable(spark, f"{root}/index").read().filter("resume_id = 'r1'").first()
    assert "resume_embedding" not in text and "email" not in text


def test_invalid_utf8_and_keys(spark, tmp_path):
    (tmp_path / "a.TXT").write_bytes(b"caf\xe9 ok")
    (tmp_path / "b.bin").write_bytes(b"zz")
    got = FS.read_texts(spark, str(tmp_path)).collect()
    assert len(got) == 1 and got[0]["text"].endswith(" ok")
    assert FS.list_documents(spark, str(tmp_path)).count() == 1
    keys = spark.createDataFrame([("raw/x/y.pdf",), ("other/raw/z.doc",)], "k STRING")
    assert rows(keys.select(FS.processed_key(F.col("k")), FS.error_key(F.col("k")))) == [
        ("processed/other/raw/z.doc", "errors/other/raw/z_error.json"), ("processed/x/y.pdf", "errors/x/y_error.json")
    ]
