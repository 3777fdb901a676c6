"""Exact duplicates by an extendible-hash index on shared files."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitaspark.llm.common import LOWER, UPPER, as_bytes, folded, saved, slots

#: The finest directory: 2**16 slots, whose counts fit the driver many times over.
DEEPEST = 16
#: Bytes of text a task gathers before it hands its combined rows on.
HELD = 16 << 20

_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())


def directory(load: np.ndarray, capacity: int) -> tuple[int, np.ndarray]:
    """(global depth, bucket of each of its slots) of an extendible hash table.

    ``load`` is the text volume under each of the finest slots. Insertion is
    replayed on these sums: one bucket at depth 0; an overfull bucket is split
    on its next bit, and the directory doubles when that bucket is as deep as
    the directory. Buckets at the finest depth stay as they are.
    """
    finest = len(load).bit_length() - 1
    sums = np.concatenate([[0], np.cumsum(load)])
    depth, leaves, pending = 0, [], [(0, 0)]
    while pending:
        local, prefix = pending.pop()
        width = 1 << (finest - local)
        if sums[(prefix + 1) * width] - sums[prefix * width] > capacity and local < finest:
            depth = max(depth, local + 1)
            pending += [(local + 1, 2 * prefix + 1), (local + 1, 2 * prefix)]
        else:
            leaves.append((local, prefix))
    spans = [1 << (depth - local) for local, _ in leaves]
    return depth, np.repeat(np.arange(len(leaves)), spans)


def _load(keys: DataFrame) -> np.ndarray:
    """Text volume per finest slot, each distinct key once: at most 2**16 sums reach the driver."""
    sums = (
        keys.groupBy("key").agg(F.max("size").alias("size"))
        .groupBy(F.shiftrightunsigned("key", 64 - DEEPEST).cast("int").alias("slot")).agg(F.sum("size").alias("size"))
    )
    load = np.zeros(1 << DEEPEST, np.int64)
    for row in sums.collect():
        load[row["slot"]] = row["size"]
    return load


def _combine(batches: Iterator[pd.DataFrame], depth: int, slots_of: np.ndarray) -> Iterator[pd.DataFrame]:
    """Merge equal texts inside a task, so a hot text leaves it as a row per flush."""
    held: dict[tuple[int, bytes], list] = {}
    size = 0
    for batch in batches:
        for key, doc_id, text in zip(batch["key"].tolist(), batch["id"], as_bytes(batch["text"]), strict=True):
            text = text.translate(_FOLD)
            entry = held.get((key, text))
            if entry is None:
                held[key, text] = [doc_id, 1]
                size += len(text) + 100
            else:
                entry[0] = doc_id if entry[0] is pd.NA or (doc_id is not pd.NA and doc_id > entry[0]) else entry[0]
                entry[1] += 1
        if size > HELD:
            yield _combined(held, depth, slots_of)
            held, size = {}, 0
    if held:
        yield _combined(held, depth, slots_of)


def _combined(held: dict, depth: int, slots_of: np.ndarray) -> pd.DataFrame:
    keys = np.array([k for k, _ in held], np.int64)
    slot = (keys.view(np.uint64) >> np.uint64(64 - depth)).astype(np.int64) if depth else np.zeros(len(keys), np.int64)
    return pd.DataFrame({
        "bucket": slots_of[slot], "key": keys, "text": [t for _, t in held],
        "top": pd.array([e[0] for e in held.values()], "Int64"), "n": [e[1] for e in held.values()],
    })


def _chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come in key order; equal keys form a chain whose entries are told apart by their bytes."""
    key, chain, bucket, done = None, {}, 0, []
    for batch in batches:
        for b, k, text, top, n in zip(batch["bucket"], batch["key"], batch["text"], batch["top"], batch["n"], strict=True):
            if k != key:
                done += _closed(bucket, key, chain)
                key, bucket, chain = k, b, {}
            entry = chain.setdefault(text, [top, 0])
            entry[0] = top if pd.isna(entry[0]) or (not pd.isna(top) and top > entry[0]) else entry[0]
            entry[1] += n
        if len(done) > 10_000:
            yield _frame(done)
            done = []
    yield _frame(done + _closed(bucket, key, chain))


def _closed(bucket: int, key: int, chain: dict) -> list[tuple]:
    return [(bucket, key, hashlib.sha256(text).digest(), top, n) for text, (top, n) in chain.items()]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["bucket", "key", "digest", "keep_id", "group_size"])
    return frame.astype({"keep_id": "Int64"})


def build_index(docs: DataFrame, capacity: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index: (bucket, key, digest, keep_id, group_size), a row per distinct text.

    ``capacity`` is the text volume of a bucket; by default a quarter of a
    shuffle partition's share. An owner task takes whole buckets, that is key
    ranges, sorts them by key and compares bytes along each chain. Copies are
    merged before they travel, so no owner meets all rows of one text.
    """
    spark = docs.sparkSession
    text = folded(text_col)
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text).alias("key"))
    load = _load(docs.select(F.xxhash64(text).alias("key"), (F.octet_length(F.coalesce(text_col, F.lit(""))) + 1).alias("size")))
    depth, slots_of = directory(load, capacity or max(1, int(load.sum()) // (4 * slots(spark))))

    def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _combine((b.assign(id=b["id"].astype("Int64")) for b in batches), depth, slots_of)

    entries = keyed.mapInPandas(combine, "bucket int, key long, text binary, top long, n long")
    owned = entries.repartition(slots(spark), "bucket").sortWithinPartitions("bucket", "key")
    return saved(owned.mapInPandas(_chain, "bucket int, key long, digest binary, keep_id long, group_size long"), "index")


def exact_duplicates(docs: DataFrame, capacity: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): a row per document.

    Texts are equal when identical after lower-casing A-Z; null counts as
    empty. The row with the largest id stays; a null id loses to any other, and
    where the largest id repeats each of its rows is kept. Empty input gives an
    empty result, extra columns are ignored.
    """
    index = build_index(docs, capacity, id_col, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(folded(text_col)).alias("key"), F.unhex(F.sha2(folded(text_col), 256)).alias("digest"))
    copies = index.filter("group_size > 1").select("key", "digest", "keep_id", "group_size")
    return (
        rows.join(copies, ["key", "digest"], "left")
        .select(
            "doc_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.lower(F.hex("digest")).alias("text_sha256"),
        )
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
        .select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    )


SQL = """
select doc_id, max(doc_id) over (partition by n) as keep_id, count(*) over (partition by n) as group_size,
  doc_id = max(doc_id) over (partition by n) as kept, sha256(n) as text_sha256
from (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as n from documents)
"""
