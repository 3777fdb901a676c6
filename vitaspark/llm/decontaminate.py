"""Benchmark passages in documents, found by Wu-Manber multi-pattern search."""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitaspark.llm.common import as_bytes

WINDOW = 13
#: Benchmark text searched for at a time; larger benchmarks take several passes over a batch.
TABLE_BYTES = 8 << 20

_TO_SPACE = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Words after lower-casing A-Z: runs of ASCII digits, letters and all other characters from U+0080 on."""
    return text.lower().translate(_TO_SPACE).split()


def windows(items: list[tuple[object, bytes]], size: int = WINDOW) -> dict[bytes, list]:
    """Each window, written " w1 w2 ... ", with the items that hold it. A shorter item is one window; one without words has none."""
    found: dict[bytes, list] = defaultdict(list)
    for item, text in items:
        words = words_of(text)
        for i in range(max(1, len(words) - size + 1) if words else 0):
            holders = found[b" " + b" ".join(words[i:i + size]) + b" "]
            if item not in holders:
                holders.append(item)
    return dict(found)


class WuManber:
    """Search tables over byte strings of at least ``shortest`` bytes.

    For each block of ``block`` bytes the shift table holds how far the search
    may jump when that block ends at the current place; blocks in no string
    allow the full distance. A shift of 0 leads to the bucket of strings whose
    first ``shortest`` bytes end in this block; each is compared directly.
    """

    def __init__(self, strings: list[bytes]):
        self.shortest = min(map(len, strings))
        # block size by the authors' rule, log of twice the total length, at about 3 bits a byte of text
        rule = math.ceil(math.log2(2 * sum(map(len, strings)) + 2) / 3)
        self.block = max(1, min(self.shortest, max(2, rule)))
        self.shift: dict[bytes, int] = {}
        self.bucket: dict[bytes, list[bytes]] = defaultdict(list)
        for s in strings:
            for end in range(self.block, self.shortest + 1):
                part, jump = s[end - self.block:end], self.shortest - end
                if jump < self.shift.get(part, self.shortest):
                    self.shift[part] = jump
            self.bucket[s[self.shortest - self.block:self.shortest]].append(s)

    def search(self, text: bytes) -> Iterator[tuple[int, bytes]]:
        """(place, string) of every occurrence."""
        block, shortest = self.block, self.shortest
        far, shift, bucket = shortest - block + 1, self.shift.get, self.bucket
        at, size = shortest, len(text)
        while at <= size:
            part = text[at - block:at]
            jump = shift(part, far)
            if jump:
                at += jump
                continue
            start = at - shortest
            for s in bucket[part]:
                if text.startswith(s, start):
                    yield start, s
            at += 1


class Searcher:
    """Wu-Manber tables by classes of length, so that a short string does not shorten the jumps of long ones."""

    def __init__(self, items: list[tuple[object, bytes]], size: int = WINDOW):
        self.holders = windows(items, size)
        classes: dict[int, list[bytes]] = defaultdict(list)
        for s in self.holders:
            classes[min(len(s).bit_length(), 7)].append(s)
        self.tables = [WuManber(strings) for strings in classes.values()]

    def spans(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged (first, past the last) word spans inside occurrences, and the items concerned."""
        text = b" " + b" ".join(words) + b" "
        hits = sorted((start, s) for table in self.tables for start, s in table.search(text))
        spans: list[list[int]] = []
        items: set = set()
        seen, index = 0, 0
        for start, s in hits:
            index += text.count(b" ", seen, start)
            seen = start
            stop = index + s.count(b" ") - 1
            if spans and index <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], stop)
            else:
                spans.append([index, stop])
            items.update(self.holders[s])
        return [tuple(x) for x in spans], items


def _parts(benchmark: DataFrame, table_bytes: int) -> Iterator[list[tuple[object, bytes]]]:
    """The benchmark in parts of about ``table_bytes``, fetched a partition at a time."""
    part, size = [], 0
    for row in benchmark.toLocalIterator():
        text = (row["text"] or "").encode()
        part.append((row["item"], text))
        size += len(text)
        if size >= table_bytes:
            yield part
            part, size = [], 0
    if part:
        yield part


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, stop in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], stop))
        else:
            out.append((first, stop))
    return out


def benchmark_spans(
    docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, table_bytes: int = TABLE_BYTES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_words, spans, items), a row per document: :func:`finder` over the table."""
    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), finder(benchmark, size, table_bytes)(F.col(text_col)).alias("found"))
    return found.select("doc_id", "found.*")


def finder(benchmark: DataFrame, size: int = WINDOW, table_bytes: int = TABLE_BYTES) -> Callable[[Column], Column]:
    """A column function of the text: struct of n_words, word spans inside benchmark windows and the items they come from.

    No shuffle, other columns stay where they are. Each part of the benchmark is one broadcast
    of bounded size and one pass over the batch in hand. Null and empty texts
    have no words; benchmark items that are null, empty or repeated by id add
    nothing or their own windows. Items are given as text; all items of a null id
    are one null item, at the end.
    """
    spark = benchmark.sparkSession
    named = benchmark.select(F.col("item_id").cast("string").alias("item"), "text")
    parts = [spark.sparkContext.broadcast(p) for p in _parts(named, table_bytes)]

    @F.pandas_udf("n_words long, spans array<struct<first:int,stop:int>>, items array<string>")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tables = [Searcher(p.value, size) for p in parts] if len(parts) == 1 else None
        for batch in batches:
            words = [words_of(t) for t in as_bytes(batch)]
            spans: list[list] = [[] for _ in words]
            items: list[set] = [set() for _ in words]
            for table in tables or (Searcher(p.value, size) for p in parts):
                for i, w in enumerate(words):
                    found, held = table.spans(w)
                    spans[i] += found
                    items[i] |= held
            yield pd.DataFrame({
                "n_words": [len(w) for w in words],
                "spans": [[{"first": a, "stop": b} for a, b in _merged(s)] for s in spans], "items": [sorted(x - {None}) + [None] * (None in x) for x in items],
            })

    return scan


def words_hit(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["first"])


def contaminated(n_words: Column, n_hit: Column, share: int = 20) -> Column:
    return (n_hit > 0) & (share * n_hit >= n_words)


def contamination(docs: DataFrame, benchmark: DataFrame, share: int = 20, **options) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated (a hit word at least in every ``share``)."""
    found = benchmark_spans(docs, benchmark, **options)
    hit = words_hit(F.col("spans"))
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated(F.col("n_words"), hit, share).alias("contaminated"),
    )


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


SQL = r"""
with dw as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
bw as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark),
bs as (select item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) as i from bw where len(w) > 0),
bg as (select distinct item_id, array_to_string(w[i:i + 12], ' ') as g, len(w[i:i + 12]) as n from bs),
sizes as (select distinct n from bg),
ds as (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from dw, sizes where len(w) >= n),
dg as (select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as g from ds),
hits as (select dg.doc_id, dg.i, dg.n, bg.item_id from dg join bg using (g, n)),
words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hits) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(t, ',' order by t) as joined from (select distinct doc_id, cast(item_id as varchar) as t from hits) group by doc_id)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(joined, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from dw left join words using (doc_id) left join items using (doc_id)
"""
