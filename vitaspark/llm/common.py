"""Shared helpers: tables in the shared folder, text columns and word hashes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitaspark.session import ensure_checkpoint_dir

#: Separators of words once A-Z is lower-cased: every ASCII character that is no digit and no letter.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_WORD = np.zeros(256, bool)
_WORD[ord("0"):ord("9") + 1] = _WORD[ord("a"):ord("z") + 1] = _WORD[128:] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A"):ord("Z") + 1] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes of text hashed at a time; bounds the memory of a Python worker.
BLOCK = 1 << 20


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder named by ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark)}/llm/{label}-{uuid.uuid4().hex}"


#: Bytes of an Arrow batch that goes to a Python worker.
BATCH_BYTES = 8 << 20


def modest(spark: SparkSession) -> SparkSession:
    """Let the session hand texts to Python in batches of ``BATCH_BYTES``: rows vary from a word to megabytes, so a count of rows bounds nothing."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.

    Once the table is written, the shuffle files behind it serve nobody and are
    dropped at the end of the job.
    """
    spark, path, drop = df.sparkSession, shared_path(df.sparkSession, label), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(drop, "false")
    modest(spark).conf.set(drop, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(drop, before)
    return spark.read.schema(df.schema).parquet(path)


def slots(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def folded(col: Column | str) -> Column:
    """The text with A-Z lower-cased and nothing else; null becomes empty."""
    return F.translate(F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")), UPPER, LOWER)


def id_crc(doc_id: Column | str) -> Column:
    """crc32 of the id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id) if isinstance(doc_id, str) else doc_id, F.lit(None)).cast("string").cast("binary"))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiply-xorshift steps)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK + 4096)
        _powers[:] = [
            np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, base, np.uint64)])) for base in (_BASE, _INVERSE)
        ]
    return _powers[0][:n], _powers[1][:n]


class Words:
    """Words of a run of bytes: starts, ends, prefix hashes and the folded bytes."""

    def __init__(self, raw: bytes):
        self.bytes = _FOLD[np.frombuffer(raw, np.uint8)]
        inside = np.concatenate([[False], _WORD[self.bytes], [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = edges[::2], edges[1::2]
        up, self.down = powers(len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((self.bytes.astype(np.uint64) + np.uint64(1)) * up[:-1], out=self.sums[1:])

    def hashes(self, longest: int | None = None) -> np.ndarray:
        """A 64-bit hash per word, or of its first ``longest`` bytes."""
        ends = self.ends if longest is None else np.minimum(self.ends, self.starts + longest)
        return mix((self.sums[ends] - self.sums[self.starts]) * self.down[self.starts])


def blocks(texts: list[bytes]) -> Iterator[tuple[bytes, np.ndarray, int]]:
    """Texts joined in blocks of about ``BLOCK`` bytes: (bytes, end offset of each text, index of the first text).

    A text longer than a block is its own block.
    """
    first, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > BLOCK:
            yield _joined(texts, first, i)
            first, size = i, 0
        size += len(text) + 1
    if first < len(texts):
        yield _joined(texts, first, len(texts))


def _joined(texts: list[bytes], first: int, last: int) -> tuple[bytes, np.ndarray, int]:
    part = texts[first:last]
    return b"\n".join(part), np.cumsum([len(t) + 1 for t in part]), first


def pieces(text: bytes) -> Iterator[bytes]:
    """A long text cut at separators into pieces of about ``BLOCK`` bytes; no word is split."""
    start = 0
    while len(text) - start > BLOCK:
        stop = start + BLOCK
        while stop < len(text) and _WORD[_FOLD[text[stop]]]:
            stop += 1
        yield text[start:stop]
        start = stop
    yield text[start:]


def word_hashes(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per block of texts: (hash of each word, index of its text in the list)."""
    for raw, ends, first in blocks(texts):
        if len(ends) == 1 and len(raw) > BLOCK:
            found = np.concatenate([Words(p).hashes() for p in pieces(raw)])
            yield found, np.full(len(found), first)
        else:
            words = Words(raw)
            yield words.hashes(), first + np.searchsorted(ends, words.starts, "right")


def as_bytes(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow or pandas string column, null as empty."""
    return [b"" if t is None or t != t else t.encode() for t in column]
