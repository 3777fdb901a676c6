"""Weighted MinHash by darts, and near-duplicate classes from banded signatures."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitaspark.llm.common import BLOCK, as_bytes, mix, saved, word_hashes
from vitaspark.llm.graph import connected

SHINGLE, SIMILARITY = 5, 0.8
#: 32 bands of 6: a pair of similarity 0.8 misses every band with probability (1 - 0.8**6)**32 = 6e-5.
BANDS, ROWS = 32, 6

#: Members of a bucket up to which pairs of different classes are joined; larger ones are compared in chunks.
SMALL = 16
#: Ways in which hubs are drawn; bands take turns.
DRAWS = 8
#: Members and bytes of text a chunk of a larger bucket has on average at most.
CHUNK, CHUNK_BYTES = 1024, 2 << 20
#: Cells of element, strip and slab that darts are thrown over at a time; a short text takes as many as a long one, so bytes don't bound them.
CELLS = 1 << 19

_FINE = 6  # ranks below 1 are cut in slabs [0, 2**-6), [2**-6, 2**-5), ... and above in slabs of height 1
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_FACTORS = mix(np.arange(1, 17, dtype=np.uint64)) | np.uint64(1)


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _slab(index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower edge and height of rank slabs."""
    i = index.astype(np.float64)
    low = np.where(index == 0, 0.0, np.where(index <= _FINE, 2.0 ** (np.minimum(i, _FINE) - 1 - _FINE), i - _FINE))
    return low, np.where(index == 0, 2.0**-_FINE, np.where(index <= _FINE, low, 1.0))


def _slabs_below(bound: np.ndarray) -> np.ndarray:
    """How many slabs begin below each rank bound."""
    fine = np.ceil(np.log2(np.maximum(bound, 2.0**-_FINE)) + _FINE) + 1
    return np.where(bound <= 1, fine, _FINE + np.ceil(bound)).astype(np.int64)


def _bounds(total: np.ndarray, k: int, factor: float = 1.0) -> np.ndarray:
    """Ranks up to which sets of these total weights throw their darts."""
    return np.divide(factor * k * (np.log(k) + 2), total, out=np.zeros(len(total)), where=total > 0)


def darts(element: np.ndarray, weight: np.ndarray, owner: np.ndarray, owners: int, k: int, factor: float = 1.0) -> np.ndarray:
    """Signatures (owners x k) of weighted sets given as (element, weight, owner) rows.

    Darts are a fixed random point process over element x weight x rank. A set
    sees those under its weights. Each dart names a coordinate; the dart of the
    lowest rank stays there. Two sets agree in a coordinate with probability
    equal to their weighted Jaccard similarity. About k ln k darts are thrown in
    total, whatever the set's size; sets with an open coordinate throw to twice
    the rank again. Weights must be positive, work grows with their sum. Sets
    without elements keep zeros.
    """
    out = np.zeros((owners, k), np.uint64)
    total = np.bincount(owner, weight, owners)
    bound = _bounds(total, k, factor)
    strips = np.ceil(weight).astype(np.int64)
    row = np.repeat(np.arange(len(element)), strips)
    strip = np.arange(len(row)) - np.repeat(np.cumsum(strips) - strips, strips)
    base = mix(element[row] + (strip.astype(np.uint64) + np.uint64(1)) * _GOLD)
    count = _slabs_below(bound)[owner[row]]
    cell_row = np.repeat(np.arange(len(row)), count)
    slab = np.arange(len(cell_row)) - np.repeat(np.cumsum(count) - count, count)
    seed = mix(base[cell_row] ^ ((slab.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)))
    # Poisson counts by inversion; most cells hold no dart and drop out at once
    u = _unit(seed)
    hit = np.flatnonzero(u >= np.exp(-_slab(slab)[1]))
    u, slab, cell_row, seed = u[hit], slab[hit], cell_row[hit], seed[hit]
    low, height = _slab(slab)
    term = np.exp(-height)
    reached, number, live = term.copy(), np.zeros(len(u), np.int64), np.arange(len(u))
    while len(live):
        number[live] += 1
        term[live] *= height[live] / number[live]
        reached[live] += term[live]
        live = live[(u[live] >= reached[live]) & (number[live] < 64)]
    dart_cell = np.repeat(np.arange(len(u)), number)
    nth = np.arange(len(dart_cell)) - np.repeat(np.cumsum(number) - number, number)
    dart = mix(seed[dart_cell] + (nth.astype(np.uint64) + np.uint64(1)) * _GOLD)
    rank = low[dart_cell] + height[dart_cell] * _unit(dart)
    in_row = cell_row[dart_cell]
    under = strip[in_row] + _unit(mix(dart ^ _GOLD)) < weight[row[in_row]]
    whose = owner[row[in_row]]
    keep = np.flatnonzero(under & (rank < bound[whose]))
    dart, rank, whose = dart[keep], rank[keep], whose[keep]
    place = whose * k + (mix(dart + np.uint64(77)) % np.uint64(k)).astype(np.int64)
    order = np.lexsort((rank, place))
    place, dart = place[order], dart[order]
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else place
    out.reshape(-1)[place[first]] = dart[first]
    filled = np.bincount(place[first] // k, minlength=owners)
    again = np.flatnonzero((filled < k) & (total > 0))
    if len(again):
        number_of = np.full(owners, -1)
        number_of[again] = np.arange(len(again))
        mine = number_of[owner] >= 0
        out[again] = darts(element[mine], weight[mine], number_of[owner[mine]], len(again), k, 2 * factor)
    return out


def signatures(element: np.ndarray, weight: np.ndarray, owner: np.ndarray, owners: int, k: int) -> np.ndarray:
    """:func:`darts` for rows sorted by owner, over as many sets at a time as take about ``CELLS`` cells."""
    strips = np.bincount(owner, np.ceil(weight), owners)
    cells = np.cumsum(strips * _slabs_below(_bounds(np.bincount(owner, weight, owners), k)))
    part = (cells // CELLS).astype(np.int64)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [owners]])
    rows = np.searchsorted(owner, cuts)
    return np.concatenate([
        darts(element[i:j], weight[i:j], owner[i:j] - low, high - low, k)
        for i, j, low, high in zip(rows, rows[1:], cuts, cuts[1:], strict=False)
    ])


def shingle_counts(texts: list[bytes], size: int = SHINGLE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per block of texts: (shingle hash, count, index of the text), sorted by text and hash.

    A text of fewer words than ``size`` has one shingle of all its words; one
    without words has none. ``size`` is 16 at most.
    """
    for words, doc in word_hashes(texts):
        n = len(words)
        if not n:
            continue
        length = np.bincount(doc - doc[0])
        end = np.cumsum(length)[doc - doc[0]]
        value = np.zeros(n, np.uint64)
        for j in range(size):
            at = np.minimum(np.arange(n) + j, n - 1)
            value += np.where(np.arange(n) + j < end, words[at] * _FACTORS[j], np.uint64(0))
        first = np.concatenate([[True], doc[1:] != doc[:-1]])
        whole = (np.arange(n) + size <= end) | first
        value, doc = mix(value[whole]), doc[whole]
        order = np.lexsort((value, doc))
        value, doc = value[order], doc[order]
        new = np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])]))
        yield value[new], np.diff(np.append(new, len(value))), doc[new]


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.zeros((len(signature), bands), np.uint64)
    for j in range(rows):
        keys = mix(keys * np.uint64(0xC6BC279692B5C323) + signature[:, j * bands:(j + 1) * bands] + np.uint64(j + 1))
    return keys + np.arange(bands, dtype=np.uint64)


_TO_SPACE = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def low_bits(signature: np.ndarray, words: int) -> np.ndarray:
    """One bit of each coordinate, in 64-bit words; two sets of similarity J agree in a share of (1 + J) / 2 of them."""
    bits = np.zeros((len(signature), words * 64), np.uint8)
    bits[:, :signature.shape[1]] = (mix(signature + np.uint64(13)) >> np.uint64(63)).astype(np.uint8)
    return np.packbits(bits, axis=1).view(np.uint64)


def fingerprint(text: bytes) -> bytes | None:
    """128 bits naming the sequence of words; none without words."""
    words = text.lower().translate(_TO_SPACE).split()  # bytes.lower() folds A-Z only
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest() if words else None


def sketches(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, print, keys, s0, s1, ...): fingerprint of the words, band keys and one bit per coordinate of the signature, a row per document."""
    words = -(-bands * rows // 64)

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = as_bytes(batch["text"])
            keys, bits = np.zeros((len(texts), bands), np.uint64), np.zeros((len(texts), words), np.uint64)
            for element, count, doc in shingle_counts(texts, size):
                low, high = doc[0], doc[-1] + 1
                signature = signatures(element, count.astype(float), doc - low, high - low, bands * rows)
                keys[low:high], bits[low:high] = band_keys(signature, bands, rows), low_bits(signature, words)
            prints = [fingerprint(t) for t in texts]
            yield pd.DataFrame({
                "id": batch["id"], "print": prints,
                "keys": [k if p is not None else None for k, p in zip(keys.view(np.int64), prints, strict=True)],
                **{f"s{i}": bits[:, i].view(np.int64) for i in range(words)},
            })

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInPandas(
        sketch, "id long, print binary, keys array<long>" + "".join(f", s{i} long" for i in range(words))
    )


def similarities(a: list[bytes], b: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """Sum of least over sum of largest shingle counts, pair by pair; 0 where neither text has a word."""
    out, first, held = np.zeros(len(a)), 0, 0
    for i in range(len(a)):
        held += len(a[i]) + len(b[i])
        if held >= BLOCK or i == len(a) - 1:
            part = slice(first, i + 1)
            found = [x for side in (a[part], b[part]) for x in shingle_counts(side, size)]
            if found:
                element, count, pair = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.lexsort((element, pair))
                element, count, pair = element[order], count[order], pair[order]
                both = np.flatnonzero((element[1:] == element[:-1]) & (pair[1:] == pair[:-1]))
                n = i + 1 - first
                low = np.bincount(pair[both], np.minimum(count[both], count[both + 1]), n)
                union = np.bincount(pair, count, n) - low
                out[part] = np.divide(low, union, out=np.zeros(n), where=union > 0)
            first, held = i + 1, 0
    return out


def texts_of(prints: DataFrame, docs: DataFrame, marks: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(print, text): the whole text of one document for each fingerprint asked for."""
    one = marks.join(prints, "print", "left_semi").groupBy("print").agg(F.min("id").alias("id"))

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            same = [fingerprint(t) == p for t, p in zip(as_bytes(batch["text"]), batch["print"], strict=True)]
            yield batch.loc[same, ["print", "text"]]

    found = (
        docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
        .join(one, F.col("doc").eqNullSafe(F.col("id"))).select("print", "text").mapInPandas(own, "print binary, text string")
    )
    return found


def verified(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """(a, b, similarity) of fingerprint pairs, from whole texts."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = similarities(as_bytes(batch["text_a"]), as_bytes(batch["text_b"]), size)
            yield pd.DataFrame({"a": batch["a"], "b": batch["b"], "similarity": values})

    return (
        pairs.join(texts.select(F.col("print").alias("a"), F.col("text").alias("text_a")), "a")
        .join(texts.select(F.col("print").alias("b"), F.col("text").alias("text_b")), "b")
        .select("a", "b", "text_a", "text_b").mapInPandas(compare, "a binary, b binary, similarity double")
    )


def alike(coordinates: int, similarity: float, a: str, b: str) -> Column:
    """Whether the bits of two signatures leave room for the similarity: six deviations below the share expected of it are too few."""
    most = most_differing(coordinates, similarity)
    words = -(-coordinates // 64)
    return sum((F.bit_count(F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))) for i in range(1, words)), F.bit_count(F.col(f"{a}.s0").bitwiseXOR(F.col(f"{b}.s0")))) <= F.lit(most)


def near_links(docs: DataFrame, marks: DataFrame, similarity: float, coordinates: int, id_col: str, text_col: str, size: int) -> tuple[DataFrame, DataFrame]:
    """(links, labels): verified pairs (a, b) of fingerprints and the class label of each linked fingerprint.

    In each bucket all members are compared with one hub. Bands share ``DRAWS``
    draws, so members of a large group meet several hubs, but a group that meets
    in every band has at most that many links a member. Then the buckets that
    still hold several classes are settled: all pairs of different classes are
    compared, unless the triangle inequality over their distances to the hub
    excludes them. Up to ``SMALL`` members the pairs are rows; larger buckets
    are compared in chunks, see :func:`_chunked`, where only links become rows.
    Only pairs whose signature bits leave room for a link are measured on their
    texts.
    """
    words = [f"s{i}" for i in range(-(-coordinates // 64))]
    bits = saved(marks.filter("print is not null").groupBy("print").agg(*[F.max(w).alias(w) for w in words], F.max("keys").alias("keys")), "bits")
    members = marks.filter("print is not null").select(F.posexplode("keys").alias("band", "bucket"), "print")
    members = saved(members.select("bucket", "print", F.xxhash64("print", F.col("band") % DRAWS).alias("draw")).distinct(), "buckets")
    drawn = members.groupBy("bucket").agg(F.min("draw").alias("least"), F.count("*").alias("members")).filter("members > 1")
    shared = saved(members.join(drawn, "bucket"), "shared")
    first = shared.filter("draw = least").select("bucket", F.col("print").alias("hub"))
    spokes = saved(shared.join(first, "bucket").select("bucket", "print", "hub", "members"), "spokes")

    sketch = bits.select("print", F.struct(*words).alias("s"))
    hub_pairs = spokes.filter("print <> hub").select(F.greatest("print", "hub").alias("a"), F.least("print", "hub").alias("b")).distinct()
    near = saved(
        hub_pairs.join(sketch.toDF("a", "x"), "a").join(sketch.toDF("b", "y"), "b").filter(alike(coordinates, similarity, "x", "y")).select("a", "b"), "near"
    )
    texts = saved(texts_of(spokes.select("print").distinct(), docs, marks, id_col, text_col), "texts")
    measured = saved(verified(near, texts, size).distinct(), "measured")
    links = measured.filter(F.col("similarity") >= similarity).select("a", "b")
    spokes = spokes.withColumns({"a": F.greatest("print", "hub"), "b": F.least("print", "hub")}).join(measured, ["a", "b"], "left")
    own = F.when(F.col("print") == F.col("hub"), 1.0).otherwise(F.col("similarity"))
    spokes = saved(spokes.select("bucket", "print", "hub", "members", own.alias("near")), "measured-spokes")
    ties = saved(_ties(spokes.filter((F.col("print") != F.col("hub")) & (F.col("near") >= similarity))), "ties")
    labels = connected(ties)

    rows = spokes.join(labels.withColumnRenamed("node", "print"), "print", "left").select(
        "bucket", "print", "members", F.coalesce("label", "print").alias("label"), "near"
    )
    mixed = rows.groupBy("bucket", "label").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.count("*").alias("classes"), F.sum("n").alias("n"))
    rows = saved(rows.join(mixed.filter("classes > 1 and n > 2").select("bucket"), "bucket", "left_semi").join(sketch, "print"), "open")
    few, many = rows.filter(F.col("members") <= SMALL), rows.filter(F.col("members") > SMALL)
    left = few.select("bucket", F.col("print").alias("a"), F.col("label").alias("label_a"), F.col("near").alias("near_a"), F.col("s").alias("x"))
    right = few.select("bucket", F.col("print").alias("b"), F.col("label").alias("label_b"), F.col("near").alias("near_b"), F.col("s").alias("y"))
    # a distance that wasn't measured excludes nothing
    reach = F.coalesce(F.abs(F.col("near_a") - F.col("near_b")) <= 1 - similarity + 1e-9, F.lit(True))
    more = left.join(right, "bucket").filter((F.col("label_a") != F.col("label_b")) & reach & alike(coordinates, similarity, "x", "y"))
    more = more.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().join(measured.select("a", "b"), ["a", "b"], "left_anti")
    fresh = verified(more, texts, size).distinct().filter(F.col("similarity") >= similarity).select("a", "b")
    fresh = saved(fresh.unionByName(_chunked(many, bits.select("print", "keys"), texts, similarity, coordinates, size)), "fresh")
    if fresh.isEmpty():
        return links, labels
    return links.unionByName(fresh), connected(ties.unionByName(fresh))


def _ties(spokes: DataFrame) -> DataFrame:
    """Pairs (a, b) that connect what linked (print, hub) rows connect: each member with its least hub, and that hub with the member's others.

    A member has a hub per draw, and the members of a group share their hubs,
    so a group of n members keeps about n pairs instead of ``DRAWS`` times n.
    """
    hubs = spokes.groupBy("print").agg(F.array_sort(F.collect_set("hub")).alias("hubs"))
    least = F.get("hubs", F.lit(0))
    own = hubs.select(F.col("print").alias("a"), least.alias("b"))
    others = hubs.select(F.explode(F.slice("hubs", F.lit(2), F.size("hubs"))).alias("a"), least.alias("b")).distinct()
    return own.unionByName(others)


def most_differing(coordinates: int, similarity: float) -> float:
    """Differing bits of two signatures that leave room for the similarity: six deviations above those expected of it."""
    p = (1 + similarity) / 2
    return coordinates * (1 - p) + 6 * math.sqrt(coordinates * p * (1 - p))


def _chunked(rows: DataFrame, keys: DataFrame, texts: DataFrame, similarity: float, coordinates: int, size: int) -> DataFrame:
    """Links (a, b) between members of different classes of large buckets, all pairs measured on their texts.

    A bucket is dealt into chunks of bounded size and every two chunks meet in
    one group, so no task holds a bucket and no pair becomes a row unless it is
    a link. Members of several buckets are compared in the first they share.
    """
    full = rows.join(keys, "print").join(texts, "print")
    volume = rows.join(texts.select("print", F.octet_length("text").alias("bytes")), "print").groupBy("bucket").agg(
        F.ceil(F.greatest(F.count("*") / CHUNK, F.sum("bytes") / CHUNK_BYTES)).cast("int").alias("chunks")
    )
    mine = F.pmod(F.xxhash64("print", "bucket"), F.col("chunks")).cast("int")
    met = full.join(volume, "bucket").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    met = met.select(
        "bucket", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "print", "label", "near", "s.*", "keys", "text"
    )
    bits, most, reach = [f"s{i}" for i in range(-(-coordinates // 64))], most_differing(coordinates, similarity), 1 - similarity + 1e-9

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        keys, sketch = np.stack(group["keys"].to_list()), group[bits].to_numpy(np.int64).view(np.uint64)
        near, label = group["near"].to_numpy(np.float64), pd.factorize(group["label"])[0]
        band = int(np.flatnonzero(keys[0] == group["bucket"].iloc[0])[0])
        within, mine = group["i"].iloc[0] == group["j"].iloc[0], group["mine"].to_numpy()
        first = np.arange(len(group)) if within else np.flatnonzero(mine == group["i"].iloc[0])
        partners = {}
        for a in first:
            b = np.arange(a + 1, len(group)) if within else np.flatnonzero(mine != mine[a])
            b = b[(label[b] != label[a]) & ~(np.abs(near[b] - near[a]) > reach)]
            b = b[np.bitwise_count(sketch[b] ^ sketch[a]).sum(axis=1) <= most]
            b = b[(keys[b, :band] != keys[a, :band]).all(axis=1)]
            if len(b):
                partners[a] = b
        found = _links(as_bytes(group["text"]), partners, similarity, size)
        prints = group["print"].to_list()
        pairs = [(max(prints[a], prints[b]), min(prints[a], prints[b])) for a, b in found]
        return pd.DataFrame({"a": [p[0] for p in pairs], "b": [p[1] for p in pairs]})

    return met.groupBy("bucket", "i", "j").applyInPandas(compare, "a binary, b binary").distinct()


def _links(texts: list[bytes], partners: dict[int, np.ndarray], similarity: float, size: int) -> list[tuple[int, int]]:
    """Pairs of ``partners`` (text: others) that reach the similarity, as :func:`similarities` measures it."""
    if not partners:
        return []
    element, count, doc = (np.concatenate(x) for x in zip(*shingle_counts(texts, size), strict=True))
    element = np.unique(element, return_inverse=True)[1]
    total = np.bincount(doc, count, len(texts))
    ends = np.cumsum(np.bincount(doc, minlength=len(texts)))
    begins = np.concatenate([[0], ends[:-1]])
    own, out = np.zeros(int(element.max()) + 1, count.dtype), []
    for a, others in partners.items():
        part = slice(begins[a], ends[a])
        own[element[part]] = count[part]
        length = ends[others] - begins[others]
        at = np.repeat(begins[others] - np.cumsum(length) + length, length) + np.arange(length.sum())
        low = np.bincount(np.repeat(np.arange(len(others)), length), np.minimum(own[element[at]], count[at]), len(others))
        own[element[part]] = 0
        out += [(int(a), int(b)) for b in others[low / (total[a] + total[others] - low) >= similarity]]
    return out


def near_duplicates(
    docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, class_id, class_size, kept): near-duplicate classes, a row per document.

    Weights are counts of word shingles; documents whose weighted Jaccard
    similarity reaches ``similarity`` are linked and classes are the connected
    parts. ``class_id`` is the largest id of the class, whose row stays.
    Documents with the same words are one node, so copies make no pairs. A
    document without words (null and empty included) is a class of its own, a
    null id too unless its words link it. Repeated ids count as rows; where the
    largest id repeats, each of its rows is kept.
    """
    return near_classes(docs, similarity, bands, rows, size, id_col, text_col).drop("print")


def near_classes(
    docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of :func:`near_duplicates` with ``print``, the fingerprint of their words."""
    marks = saved(sketches(docs, bands, rows, size, id_col, text_col), "sketches")
    _, labels = near_links(docs, marks, similarity, bands * rows, id_col, text_col, size)
    by_print = (
        marks.filter("print is not null").groupBy("print").agg(F.max("id").alias("top"), F.count("*").alias("n"))
        .join(labels.withColumnRenamed("node", "print"), "print", "left").withColumn("label", F.coalesce("label", "print"))
    )
    by_print = saved(by_print, "classes")
    by_class = by_print.groupBy("label").agg(F.max("top").alias("class_id"), F.sum("n").alias("class_size"))
    found = by_print.join(by_class, "label").filter("class_size > 1").select("print", "class_id", "class_size")
    return (
        marks.select("id", "print").join(found, "print", "left")
        .select(
            F.col("id").alias("doc_id"), F.when(F.col("class_size").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
            F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), "print",
        )
        .withColumn("kept", F.col("class_size").eqNullSafe(F.lit(1)) | F.col("doc_id").eqNullSafe(F.col("class_id")))
    )
