"""Text quality by perplexity under an interpolated modified Kneser-Ney model of trusted text."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitaspark.llm.common import BLOCK, as_bytes, blocks, saved

#: Symbols of an n-gram, the last one predicted from those before it.
ORDER = 4
#: Byte classes: 6 bits each, so n-grams fit 24 bits.
BITS = 6
SYMBOLS = 1 << BITS
#: Bits of a symbol of any alphabet; an n-gram is two pairs of symbols while it is in a task.
WIDE = 21
#: Quantile of the trusted texts of a language up to which perplexity is fine, and the step of the log scale.
QUANTILE, STEP = 0.995, 0.001
#: Bytes of text whose distinct n-grams are looked up together.
ASK_BYTES = 8 << 20
#: Distinct n-grams that a task holds before it hands them on.
HELD = 1 << 20

#: Punctuation with a class of its own; the rest of ASCII punctuation shares one.
PUNCTUATION = ".,;:!?'\"()-_/|*#%&$@+=<>"


def _classes() -> np.ndarray:
    """Class by byte. 0 marks the ends of a text and is no byte's class."""
    table = np.ones(256, np.int32)  # 1: other ASCII punctuation and control characters
    for i, c in enumerate("abcdefghijklmnopqrstuvwxyz"):
        table[ord(c)] = 2 + i
        table[ord(c.upper())] = 28
    table[ord("0"):ord("9") + 1] = 29
    table[ord(" ")], table[ord("\n")] = 30, 31
    for i, c in enumerate(PUNCTUATION):
        table[ord(c)] = 32 + i
    table[0x80:0xC0] = 56 + np.arange(64) // 16  # continuation bytes, by 16
    table[0xC0:0xE0], table[0xE0:] = 60, 61
    table[0xC3] = 62
    return table


CLASS = _classes()


class Classes:
    """Classes of UTF-8 bytes; an n-gram is a long. So coarse that a model can be written out as one table, to check it."""

    symbols, code = SYMBOLS, "long"

    @staticmethod
    def read(raw: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return CLASS[np.frombuffer(raw, np.uint8)], ends

    @staticmethod
    def packed(high: np.ndarray, low: np.ndarray) -> pa.Array:
        a, b, c, d = _symbols(high, low)
        return pa.array(a << 3 * BITS | b << 2 * BITS | c << BITS | d, pa.int64())

    @staticmethod
    def unpacked(codes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        codes = codes.to_numpy()
        a, b, c, d = (codes >> BITS * i & SYMBOLS - 1 for i in (3, 2, 1, 0))
        return a << WIDE | b, c << WIDE | d

    @staticmethod
    def context(code: str) -> Column:
        return F.shiftright(code, BITS)

    @staticmethod
    def tail(code: str, order: int) -> Column:
        return F.col(code).bitwiseAND((1 << (BITS * order)) - 1)


class Characters:
    """Unicode characters, none of which share a symbol; so the tables of n-grams grow with the text.

    An n-gram is its characters in UTF-8, an end as byte 0 and the character of that code as C0 80.
    """

    symbols, code = 0x110000 - 0x800 + 1, "binary"  # no surrogates, but the end

    @staticmethod
    def read(raw: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begun = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
        return np.frombuffer(raw.decode().encode("utf-32-le"), np.int32) + 1, begun[ends - 1]

    @staticmethod
    def packed(high: np.ndarray, low: np.ndarray) -> pa.Array:
        symbol = np.stack(_symbols(high, low), axis=1).reshape(-1)
        c = np.maximum(symbol - 1, 0)
        size = np.where(symbol == 1, 2, 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF))
        raw = np.empty((len(c), 4), np.uint8)
        raw[:, 0] = np.array([0, 0, 0xC0, 0xE0, 0xF0])[size] | c >> 6 * (size - 1)
        for i in range(1, 4):
            raw[:, i] = 0x80 | c >> 6 * np.maximum(size - 1 - i, 0) & 0x3F
        ends = np.concatenate([[0], np.cumsum(size)[ORDER - 1::ORDER]]).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(high), [None, pa.py_buffer(ends), pa.py_buffer(raw[np.arange(4) < size[:, None]])])

    @staticmethod
    def unpacked(codes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        raw = np.frombuffer(b"".join(codes.to_pylist()) + bytes(3), np.uint8).astype(np.int64)
        at = np.flatnonzero((raw[:-3] & 0xC0) != 0x80)
        lead = raw[at]
        size = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
        c = lead & np.array([0, 0x7F, 0x1F, 0x0F, 0x07])[size]
        for i in range(1, 4):
            c = np.where(size > i, c << 6 | raw[at + i] & 0x3F, c)
        s = np.where(lead == 0, 0, c + 1).reshape(-1, ORDER)
        return s[:, 0] << WIDE | s[:, 1], s[:, 2] << WIDE | s[:, 3]

    @staticmethod
    def context(code: str) -> Column:
        return F.expr(f"""substring({code}, 1, length({code}) - CASE WHEN substring({code}, -1, 1) < X'80' THEN 1
            WHEN substring({code}, -2, 1) >= X'C0' THEN 2 WHEN substring({code}, -3, 1) >= X'C0' THEN 3 ELSE 4 END)""")

    @staticmethod
    def tail(code: str, order: int) -> Column:
        """What follows the first symbol; ``code`` has one symbol more than ``order``."""
        return F.expr(f"""substring({code}, 2 + CASE WHEN substring({code}, 1, 1) < X'80' THEN 0
            WHEN substring({code}, 1, 1) < X'E0' THEN 1 WHEN substring({code}, 1, 1) < X'F0' THEN 2 ELSE 3 END)""")


Alphabet = type[Classes] | type[Characters]


def _symbols(high: np.ndarray, low: np.ndarray) -> list[np.ndarray]:
    return [x for pair in (high, low) for x in (pair >> WIDE, pair & ((1 << WIDE) - 1))]


def ngrams(texts: list[bytes], alphabet: Alphabet) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per run of places: (first pair, last pair) of each distinct n-gram, then for each place the index of its n-gram and of its text.

    A text is padded with ends, one behind it is predicted. A run has at most ``BLOCK`` places, also of a longer text.
    """
    for raw, ends, first in blocks(texts):
        symbols, ends = alphabet.read(raw + b"\n", ends)
        padded = np.zeros(len(symbols) + (ORDER - 1) * len(ends), np.int32)
        for start in range(0, len(symbols), BLOCK):
            place = np.arange(start, min(start + BLOCK, len(symbols)))
            padded[place + (ORDER - 1) * (np.searchsorted(ends, place, "right") + 1)] = symbols[place]
        padded[ends - 1 + (ORDER - 1) * np.arange(1, len(ends) + 1)] = 0  # the joint behind each text is its end
        for start in range(0, len(symbols), BLOCK):
            place = np.arange(start, min(start + BLOCK, len(symbols)))
            doc = np.searchsorted(ends, place, "right")
            at = place + (ORDER - 1) * (doc + 1)
            part = padded[at[0] - (ORDER - 1):at[-1] + 1].astype(np.int64)
            at -= at[0]
            pair, pairs = pd.factorize(part[:-1] << WIDE | part[1:])
            gram, grams = pd.factorize(pair[at] * len(pairs) + pair[at + 2])
            yield pairs[grams // len(pairs)], pairs[grams % len(pairs)], gram, first + doc


Counted = tuple[np.ndarray, np.ndarray, np.ndarray]


def _summed(parts: list[Counted]) -> Counted:
    high, low, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    pair, pairs = pd.factorize(np.concatenate([high, low]))
    gram, grams = pd.factorize(pair[:len(high)] * len(pairs) + pair[len(high):])
    high, low, n = pairs[grams // len(pairs)], pairs[grams % len(pairs)], np.bincount(gram, n, len(grams)).astype(np.int64)
    order = np.lexsort((low, high))  # alike neighbours take less room in files
    return high[order], low[order], n[order]


def _counted(texts: Iterator[list[bytes]], alphabet: Alphabet) -> Iterator[Counted]:
    """N-grams of all texts with their counts, summed while a task can hold them; one may come again after that."""
    held, rows = [], 0
    for some in texts:
        for high, low, gram, _ in ngrams([t for t in some if t], alphabet):
            held.append((high, low, np.bincount(gram, minlength=len(high))))
            rows += len(high)
            if rows > HELD:
                held = [_summed(held)]
                rows = len(held[0][0])
                if rows > HELD // 2:
                    yield held.pop()
                    rows = 0
    if held:
        yield _summed(held)


def count_ngrams(docs: DataFrame, text_col: str = "text", alphabet: Alphabet = Classes) -> DataFrame:
    """(code, n): n-grams of all texts, counted in tasks first. Empty texts have none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for high, low, n in _counted((as_bytes(b["text"].to_pylist()) for b in batches), alphabet):
            yield pa.RecordBatch.from_pydict({"code": alphabet.packed(high, low), "n": n})

    return docs.select(F.col(text_col).alias("text")).mapInArrow(count, f"code {alphabet.code}, n long").groupBy("code").agg(F.sum("n").alias("n"))


def discounts(counts: DataFrame) -> list[float]:
    """D1, D2, D3+ of an order from its counts of counts, by the authors' estimates; halves where a count of counts is 0."""
    row = counts.agg(*[F.count_if(F.col("n") == i).alias(f"n{i}") for i in range(1, 5)]).first()
    n1, n2, n3, n4 = (row[f"n{i}"] for i in range(1, 5))
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    out = []
    for i, (low, high) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
        out.append(min(max(i - (i + 1) * y * high / low, 0.0), float(i)) if low and high else min(0.5 * i, i - 0.5))
    return out


def _discounted(n: Column, d: list[float]) -> Column:
    return F.when(n == 1, d[0]).when(n == 2, d[1]).when(n >= 3, d[2]).otherwise(0.0)


def orders(counts: DataFrame, alphabet: Alphabet = Classes) -> list[DataFrame]:
    """Per order from 1 on (code, n): raw counts for the highest, numbers of distinct predecessors below it."""
    tables = [counts]
    for order in range(ORDER - 1, 0, -1):
        tables.insert(0, tables[0].groupBy(alphabet.tail("code", order).alias("code")).agg(F.count("*").alias("n")))
    return tables


def shares(table: DataFrame, d: list[float], alphabet: Alphabet = Classes) -> tuple[DataFrame, DataFrame]:
    """Of one order: (code, own), the discounted share of each n-gram, and (context, weight), what a context leaves to the order below.

    Counts meet the sums of their contexts in a join on the context, sharded by it.
    """
    table = table.withColumn("context", alphabet.context("code"))
    n = F.col("n")
    sums = table.groupBy("context").agg(F.sum("n").alias("total"), F.sum(_discounted(n, d)).alias("rest"))
    own = table.join(sums, "context").select("code", (F.greatest(n - _discounted(n, d), F.lit(0.0)) / F.col("total")).alias("own"))
    return own, sums.select("context", (F.col("rest") / F.col("total")).alias("weight"))


class Model:
    """Per order a table (code, own) of shares and a table (context, weight) of what a context leaves to the order below."""

    def __init__(self, parts: list[tuple[DataFrame, DataFrame]], alphabet: Alphabet = Classes):
        self.parts, self.alphabet = parts, alphabet

    def surprise(self) -> np.ndarray:
        """-ln p of every n-gram of the top order, unseen ones included; 64 MB on the driver, to check models of byte classes. Scoring doesn't use it."""
        p = np.full(1, 1 / SYMBOLS, np.float32)
        for order, (own, left) in enumerate(self.parts, 1):
            o, w = own.toPandas(), left.toPandas()
            weight = np.ones(SYMBOLS ** (order - 1), np.float32)
            weight[w["context"].to_numpy(np.int64)] = w["weight"]
            # a context's lower n-grams are those of the context without its first symbol
            p = (weight.reshape(-1, len(p) // SYMBOLS or 1)[:, :, None] * p.reshape(-1, min(len(p), SYMBOLS))).reshape(-1)
            p = np.repeat(p, SYMBOLS) if order == 1 else p
            p[o["code"].to_numpy(np.int64)] += o["own"].to_numpy(np.float32)
        return _surprise(p)


def _surprise(p: np.ndarray) -> np.ndarray:
    return -np.log(np.maximum(p, np.float32(1e-30)))


def fit(trusted: DataFrame, text_col: str = "text", alphabet: Alphabet = Classes) -> Model:
    """Count, join and discount every order over all trusted texts. The finished tables stay in the shared folder."""
    parts = []
    for table in orders(saved(count_ngrams(trusted, text_col, alphabet), "ngrams"), alphabet):
        own, left = shares(table, discounts(table), alphabet)
        parts.append((
            saved(own.select("code", F.col("own").cast("float").alias("own")), "shares"),
            saved(left.select("context", F.col("weight").cast("float").alias("weight")), "weights"),
        ))
    return Model(parts, alphabet)


def probabilities(codes: DataFrame, model: Model) -> DataFrame:
    """(code, p) of each distinct ``code`` of the top order, seen or not.

    From the lowest order up, the n-grams asked for meet the shares by code,
    the weights by context and the order below by what is left without the
    first symbol; all of them are joins of sharded tables.
    """
    alphabet, asked = model.alphabet, [codes.select("code").distinct()]
    for order in range(ORDER - 1, 0, -1):
        asked.insert(0, asked[0].select(alphabet.tail("code", order).alias("code")).distinct())
    below = None
    for order, (grams, (own, left)) in enumerate(zip(asked, model.parts, strict=True), 1):
        rows = grams.withColumns({"context": alphabet.context("code"), "rest": alphabet.tail("code", order - 1)})
        rows = rows.join(left.hint("merge"), "context", "left").join(own.hint("merge"), "code", "left")
        if below is None:
            rows = rows.withColumn("below", F.lit(1 / alphabet.symbols).cast("float"))
        else:
            rows = rows.join(below.select(F.col("code").alias("rest"), F.col("p").alias("below")).hint("merge"), "rest")
        none, whole = F.lit(0.0).cast("float"), F.lit(1.0).cast("float")
        below = rows.select("code", (F.coalesce("weight", whole) * F.col("below") + F.coalesce("own", none)).alias("p"))
    return below


class _Surprises:
    """-ln p by n-gram, of those that a block asked for."""

    def __init__(self, told: list[Counted]):
        high, low, surprise = (np.concatenate(x) for x in zip(*told, strict=True))
        self.pairs = np.unique(np.concatenate([high, low]))
        keys = self._keys(high, low)
        order = np.argsort(keys)
        self.keys, self.surprise = keys[order], surprise[order]

    def _keys(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.pairs, high) * len(self.pairs) + np.searchsorted(self.pairs, low)

    def of(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        return self.surprise[np.searchsorted(self.keys, self._keys(high, low))]


def _asked(batches: Iterator[pa.RecordBatch], alphabet: Alphabet) -> Iterator[pa.RecordBatch]:
    """(block, code): the distinct n-grams of a block of texts, which is a partition."""
    block = 0

    def texts() -> Iterator[list[bytes]]:
        nonlocal block
        for batch in batches:
            if batch.num_rows:
                block = batch["block"][0].as_py()
                yield as_bytes(batch["text"].to_pylist())

    for high, low, _ in _counted(texts(), alphabet):
        yield pa.RecordBatch.from_pydict({"block": np.full(len(high), block, np.int64), "code": alphabet.packed(high, low)})


def _scored(batches: Iterator[pa.RecordBatch], alphabet: Alphabet) -> Iterator[pa.RecordBatch]:
    """Log probabilities of the places of each text of a block, summed by text; the n-grams come before the texts."""
    told, surprises = [], None
    for batch in batches:
        found, part = batch.filter(batch["code"].is_valid()), batch.filter(batch["code"].is_null())
        if found.num_rows:
            told.append((*alphabet.unpacked(found["code"]), _surprise(found["p"].to_numpy())))
        if not part.num_rows:
            continue
        texts = as_bytes(part["text"].to_pylist())
        total, n = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        filled = np.flatnonzero([len(t) > 0 for t in texts])
        if len(filled) and surprises is None:
            surprises = _Surprises(told)
            told.clear()
        for high, low, gram, doc in ngrams([texts[i] for i in filled], alphabet):
            total[filled] += np.bincount(doc, surprises.of(high, low)[gram], len(filled))
            n[filled] += np.bincount(doc, minlength=len(filled))
        perplexity = pa.array(np.exp(total / np.maximum(n, 1)), mask=n == 0)
        yield pa.RecordBatch.from_pydict({"doc_id": part["doc_id"], "lang": part["lang"], "n_symbols": np.maximum(n - 1, 0), "perplexity": perplexity})


def perplexities(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` rows as (doc_id, lang, n_symbols, perplexity); null for a text without symbols.

    Texts are dealt into blocks of about ``ASK_BYTES`` by a hash of id and text.
    A block asks once for each of its distinct n-grams; what it asks meets the
    tables of the model in :func:`probabilities` and comes back to the block.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col(text_col).alias("text"))
    alphabet = model.alphabet

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _asked(batches, alphabet)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _scored(batches, alphabet)

    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = math.ceil(size / ASK_BYTES) or 1
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)))
    asked = saved(rows.select("block", "text").repartitionById(n, F.col("block").cast("int")).mapInArrow(ask, f"block long, code {alphabet.code}"), "asked")
    found = saved(probabilities(asked, model), "probabilities")
    # one plan at every size, as for the trusted texts
    answers = asked.join(found.hint("merge"), "code").select("block", "code", "p")
    met = rows.unionByName(answers, allowMissingColumns=True).repartitionById(n, F.col("block").cast("int"))
    return met.sortWithinPartitions(F.col("code").isNull()).mapInArrow(score, "doc_id long, lang string, n_symbols long, perplexity double")


def thresholds(scored: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(lang, threshold): least step of log-perplexity that a share ``quantile`` of the language's texts stays under.

    Histograms by language, of as many rows as there are steps, stand for the texts.
    """
    bins = scored.filter("perplexity is not null").groupBy("lang", F.ceil(F.log("perplexity") / STEP).alias("bin")).agg(F.count("*").alias("n"))
    order = Window.partitionBy("lang").orderBy("bin")
    share = F.sum("n").over(order) / F.sum("n").over(Window.partitionBy("lang"))
    return bins.withColumn("share", share).filter(F.col("share") >= quantile).groupBy("lang").agg(F.exp(F.min("bin") * F.lit(STEP)).alias("threshold"))


def quality(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(doc_id, lang, n_symbols, perplexity, threshold, kept): a row per document.

    The model is one of characters (:class:`Characters`), and ``n_symbols``
    counts them. Trusted text is every document labelled of quality 1. A text is kept if its
    perplexity is at most the quantile of the trusted texts of its language; a
    language without trusted text takes the quantile of all of them. Null and
    empty texts have no perplexity and aren't kept; without any trusted text
    the model is uniform and every other text is kept.
    """
    trusted_ids = labels.groupBy("doc_id").agg(F.max("quality").alias("quality")).filter("quality = 1").select("doc_id")
    # one plan at every size: texts meet the ids in a shuffle, and don't wait for ids to outgrow a broadcast
    trusted = docs.select("doc_id", "text").join(trusted_ids.hint("merge"), "doc_id", "left_semi")
    model = fit(trusted, alphabet=Characters)
    scored = saved(perplexities(docs, model), "perplexity")
    good = scored.join(trusted_ids, "doc_id", "left_semi")
    by_lang = thresholds(good, quantile)
    overall = thresholds(good.withColumn("lang", F.lit("")), quantile).first()
    rest = float(overall["threshold"]) if overall else float("inf")
    return (
        scored.join(by_lang.withColumnRenamed("lang", "of"), F.col("lang").eqNullSafe(F.col("of")), "left")
        .withColumn("threshold", F.coalesce("threshold", F.lit(rest)))
        .withColumn("kept", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False)))
        .select("doc_id", "lang", "n_symbols", "perplexity", "threshold", "kept")
    )
