"""Removal of repeated passages: suffix automata of reference shards give matching statistics of the passages that may repeat.

A window of words is a repeat if its words also start earlier in the corpus.
Every window names one of its word runs by least hash (its anchor), so equal
windows name the same anchor, and neighbouring windows mostly share theirs:
such a run of windows is a passage. An anchor that occurs once can't be part of
a repeat. Passages with other anchors become the reference: the distinct ones,
each with its first place. They are dealt into shards by anchor; a task builds
the suffix automaton of a shard, in order of the places, and reads from it for
each place how long the match with anything earlier is. Matches of a window's
length and more are repeats. No passage has to meet another shard, since a
window occurs only in passages of its own anchor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitaspark.llm.common import as_bytes, mix, powers, saved

WINDOW = 20
#: Words whose hash may be an anchor; a window of 20 holds 13 such runs.
ANCHOR = 8
#: Words of reference text in a shard on average: a task holds one automaton of this size.
SHARD_WORDS = 200_000
#: Distinct passages of one anchor that stay together; of more, each window is dealt by its own words.
CROWD = 500
#: Bytes of text hashed at a time.
BLOCK = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Automaton:
    """Suffix automaton over words that grows by passages, and tells of each added word how far back its match reaches.

    After a word is added, the longest end of the passage so far that occurred
    before is known from the automaton itself: it is the whole passage where
    the state was there already, else what the suffix link of the new state
    spans. So building and reading matching statistics are one pass.
    """

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, link: int, onward: dict[int, int]) -> int:
        self.next.append(onward)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """The state for the shorter strings of q that p leads to."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, words: list[int]) -> list[int]:
        """Add a passage; per word, the length of the longest end at it that occurred earlier, in this passage or before."""
        link, length, onward = self.link, self.length, self.next
        last, out = 0, []
        for n, word in enumerate(words, 1):
            q = onward[last].get(word)
            if q is not None:
                last = self._split(last, word, q)
                out.append(n if length[last] == n else length[last])
                continue
            new = self._state(n, 0, {})
            p = last
            while p >= 0 and word not in onward[p]:
                onward[p][word] = new
                p = link[p]
            link[new] = self._split(p, word, onward[p][word]) if p >= 0 else 0
            last = new
            out.append(length[link[new]])
        return out


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of UTF-8 bytes: runs of anything but space and \\t to \\r."""
    inside = np.concatenate([[False], ~_SPACE[raw], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, over pieces of the bytes that are cut between words."""
    out, first = np.zeros(len(starts), np.uint64), 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + BLOCK, "right")))
        begin, stop = int(starts[first]), int(ends[last - 1])
        up, down = powers(stop - begin + 1)
        sums = np.zeros(stop - begin + 1, np.uint64)
        np.cumsum((raw[begin:stop].astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
        a, b = starts[first:last] - begin, ends[first:last] - begin
        out[first:last] = mix((sums[b] - sums[a]) * down[a])
        first = last
    return out


def anchors(hashes: np.ndarray, doc: np.ndarray, window: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, number of windows) of the passages of texts laid end to end; ``doc`` numbers the text of each word.

    A window's anchor is the least hash of its runs of ``size`` words, the
    leftmost of equal ones, so it depends on the window's words only. Windows
    in a row that share the place of their anchor form a passage; no window
    reaches over the end of a text.
    """
    n = len(hashes) - window + 1
    inside = np.flatnonzero(doc[:max(n, 0)] == doc[len(doc) - n:]) if n > 0 else np.zeros(0, np.int64)
    if not len(inside):
        return np.zeros(0, np.uint64), inside, inside
    grams = np.zeros(len(hashes) - size + 1, np.uint64)
    for j in range(size):
        grams = mix(grams + _STEP) + hashes[j:j + len(grams)]
    grams = mix(grams)
    # the least of each span of grams, by doubling: a span is covered by two of the largest power of two within it
    span = window - size + 1
    place, width = np.arange(len(grams)), 1
    while 2 * width <= span:
        left, right = place[:-width], place[width:]
        place = np.where(grams[right] < grams[left], right, left)
        width *= 2
    left, right = place[inside], place[inside + span - width]
    least = np.where(grams[right] < grams[left], right, left)
    first = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (doc[inside[1:]] != doc[inside[:-1]])]))
    return grams[least[first]], inside[first], np.diff(np.append(first, len(inside)))


_KEY = ["no_id", "doc", "mark"]


def _order(doc: Column, mark: Column) -> list[Column]:
    """Place of a document in the corpus: by id, rows without one last, rows of one id by the digest of their text."""
    return [doc.isNull().alias("no_id"), F.coalesce(doc, F.lit(0)).alias("doc"), mark.alias("mark")]


_FIRST = "doc_id long, mark long, n_words long, kept_sha256 string, anchor array<long>, start array<int>, windows array<int>"


def _blocks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``BLOCK`` bytes together."""
    first, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > BLOCK:
            yield first, i
            first, held = i, 0
        held += len(text) + 1
    if texts:
        yield first, len(texts)


def _first_pass(window: int, size: int):
    """Per document: what it comes to if nothing is removed, and its passages."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = as_bytes(batch["text"])
            for low, high in _blocks(texts):
                part = texts[low:high]
                raw = np.frombuffer(b"\n".join(part), np.uint8)
                starts, ends = word_spans(raw)
                doc = np.searchsorted(np.cumsum([len(t) + 1 for t in part]), starts, "right")
                anchor, first, windows = anchors(word_hashes(raw, starts, ends), doc, window, size)
                words = np.bincount(doc, minlength=len(part))
                begin = np.cumsum(words) - words
                cuts = np.searchsorted(doc[first], np.arange(1, len(part)))
                start = (first - begin[doc[first]]).astype(np.int32)
                yield pd.DataFrame({
                    "doc_id": batch["doc_id"].iloc[low:high].array, "mark": batch["mark"].iloc[low:high].array, "n_words": words,
                    "kept_sha256": [hashlib.sha256(b" ".join(t.split())).hexdigest() for t in part],
                    "anchor": np.split(anchor.view(np.int64), cuts), "start": np.split(start, cuts), "windows": np.split(windows.astype(np.int32), cuts),
                })

    return run


_PASSAGE = "no_id boolean, doc long, mark long, anchor long, start int, windows int, digest binary, words string"


def _passages(window: int):
    """The words of each passage asked for, from whole texts."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts: list[bytes] = []
            for text, start, windows in zip(as_bytes(batch["text"]), batch["start"], batch["windows"], strict=True):
                words = text.split()
                joined = b" ".join(words)
                at = np.cumsum([0] + [len(w) + 1 for w in words])
                parts += [joined[a:b] for a, b in zip(at[start].tolist(), (at[start + windows + window - 1] - 1).tolist(), strict=True)]
            each = [len(x) for x in batch["start"]]
            yield pd.DataFrame({
                **{c: batch[c].to_numpy().repeat(each) for c in _KEY}, **{c: np.concatenate(batch[c].to_list()) for c in ("anchor", "start", "windows")},
                "digest": [hashlib.blake2b(p, digest_size=16).digest() for p in parts], "words": [p.decode() for p in parts],
            })

    return run


def _singles(window: int):
    """Each window of a passage as a passage of its own."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for no_id, doc, mark, start, text in zip(batch["no_id"], batch["doc"], batch["mark"], batch["start"], batch["words"], strict=True):
                words = text.encode().split(b" ")
                for j in range(len(words) - window + 1):
                    part = b" ".join(words[j:j + window])
                    rows.append((no_id, doc, mark, 0, start + j, 1, hashlib.blake2b(part, digest_size=16).digest(), part.decode()))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _PASSAGE.split(", ")])

    return run


def _matched(window: int):
    """Windows of a shard's passages that a passage with an earlier place holds, or the same passage further left.

    Rows come by shard and place. One automaton at a time; words are numbered as they are met.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, automaton, numbers = None, None, {}
        for batch in batches:
            rows = []
            for of, no_id, doc, mark, start, text in zip(batch["shard"], batch["no_id"], batch["doc"], batch["mark"], batch["start"], batch["words"], strict=True):
                if of != shard:
                    shard, automaton, numbers = of, Automaton(), {}
                words = [numbers.setdefault(w, len(numbers)) for w in text.split(" ")]
                rows += [(no_id, doc, mark, start + end - window + 1, 1) for end, n in enumerate(automaton.add(words)) if n >= window]
            yield pd.DataFrame(rows, columns=["no_id", "doc", "mark", "start", "windows"])

    return run


def _firsts(passages: DataFrame) -> DataFrame:
    """Distinct passages with their first place; copies combine before they travel."""
    place = F.struct("no_id", "doc", "mark", "start")
    return passages.groupBy("digest").agg(F.min(place).alias("p"), F.min("anchor").alias("anchor"), F.max("windows").alias("windows"), F.min("words").alias("words")).select(
        "digest", "p.*", "anchor", "windows", "words"
    )


_SPAN = ["no_id", "doc", "mark", "start", "windows"]


def repeats(docs: DataFrame, window: int = WINDOW, size: int = ANCHOR, crowd: int = CROWD, shard_words: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(first pass with ``copy``, texts with possible repeats, repeated windows as runs) for rows (doc_id, mark, text).

    ``mark`` names a text. Of rows with one text only the first place goes on:
    all windows of the others repeat, which ``copy`` says.
    """
    first = saved(docs.mapInPandas(_first_pass(window, size), _FIRST), "substrings")
    placed = first.select(*_order(F.col("doc_id"), F.col("mark")), "doc_id", "n_words", "kept_sha256")
    top = placed.groupBy("mark").agg(F.min(F.struct("no_id", "doc")).alias("top"))
    rows = saved(placed.join(top, "mark").select(*_KEY, "doc_id", "n_words", "kept_sha256", (F.struct("no_id", "doc") != F.col("top")).alias("copy")), "rows")

    runs = first.select("mark", F.explode(F.arrays_zip("anchor", "start", "windows")).alias("x")).select("mark", "x.*")
    # an anchor that occurs at one place of one text, in however many copies of it, repeats nothing
    where = F.xxhash64("mark", "start")
    often = runs.groupBy("anchor").agg(F.min(where).alias("low"), F.max(where).alias("high")).filter("low <> high").select("anchor")
    often = saved(often, "often")  # a table of its own, so that Spark can split the join below where an anchor is hot
    asked = runs.join(often, "anchor").groupBy("mark").agg(F.collect_set(F.struct("anchor", "start", "windows")).alias("asked"))
    asked = rows.filter("not copy").select(*_KEY).distinct().join(asked, "mark")
    texts = docs.select(*_order(F.col("doc_id"), F.col("mark")), "text").join(asked, _KEY).dropDuplicates(_KEY)
    texts = saved(texts.select(*_KEY, "text", *[F.col(f"asked.{c}").alias(c) for c in ("anchor", "start", "windows")]), "candidates")
    passages = texts.mapInPandas(_passages(window), _PASSAGE)
    kinds = saved(_firsts(passages), "kinds")
    at = ["digest", "no_id", "doc", "mark", "start"]
    # places come from a second pass over the texts, which costs less than a table of all passages with their words
    later = passages.select("digest", *_SPAN).join(kinds.select("digest", *[F.col(c).alias(f"f_{c}") for c in at[1:]]), "digest").filter(
        " or ".join(f"{c} <> f_{c}" for c in at[1:])
    ).select(*_SPAN)
    crowded = kinds.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > crowd).select("anchor")
    alone = kinds.join(crowded, "anchor", "left_anti")
    parts = saved(kinds.join(crowded, "anchor", "left_semi").select(*[c.split()[0] for c in _PASSAGE.split(", ")]).mapInPandas(_singles(window), _PASSAGE), "singles")
    singles = _firsts(parts)
    late = parts.select("digest", *_SPAN).join(singles.select("digest", *[F.col(c).alias(f"f_{c}") for c in at[1:]]), "digest").filter(
        " or ".join(f"{c} <> f_{c}" for c in at[1:])
    ).select(*_SPAN)
    reference = alone.withColumn("key", F.xxhash64("anchor")).unionByName(singles.withColumn("key", F.xxhash64("digest")))
    volume = kinds.agg(F.sum(F.col("windows") + window)).first()[0] or 0
    shards = max(1, -(-int(volume) // shard_words))
    dealt = reference.withColumn("shard", F.pmod("key", F.lit(shards)).cast("int")).repartition(shards, "shard").sortWithinPartitions("shard", "no_id", "doc", "mark", "start")
    matched = dealt.select("shard", "no_id", "doc", "mark", "start", "words").mapInPandas(_matched(window), "no_id boolean, doc long, mark long, start int, windows int")
    return rows, texts, matched.unionByName(later).unionByName(late)


def _cover(n: int, start: np.ndarray, windows: np.ndarray, window: int) -> np.ndarray:
    """Which of n words lie in one of the windows."""
    edge = np.bincount(start, minlength=n + 1) - np.bincount(start + windows + window - 1, minlength=n + 1)
    return np.cumsum(edge[:-1]) > 0


def _removed(window: int, show: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, start, windows in zip(as_bytes(batch["text"]), batch["start"], batch["windows"], strict=True):
                words = text.split()
                gone = _cover(len(words), start, windows, window)
                kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
                cut = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))).reshape(-1, 2).tolist()
                rows.append((int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode() if show else None, cut if show else None))
            frame = pd.DataFrame(rows, columns=["n_removed", "left_sha256", "kept", "spans"]).assign(**{c: batch[c].array for c in _KEY})
            yield frame if show else frame.drop(columns=["kept", "spans"])

    return run


def dedup_substrings(
    docs: DataFrame, window: int = WINDOW, size: int = ANCHOR, show: bool = False, crowd: int = CROWD, shard_words: int = SHARD_WORDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256): a row per document, without its words that lie in repeated windows of ``window`` words.

    A window repeats if the same words also start in a document of smaller id,
    or further left in the same one; windows are judged on the input. ``show``
    adds ``kept``, the words left joined by one space, and ``spans``, the
    removed word ranges, and then lists changed documents only. Null and empty
    texts have no words. Rows without an id come after all others; rows of one
    id, null included, are ordered by a hash of their text, and equal rows
    share a place, so they don't repeat each other. Extra columns are ignored.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("mark"), F.col(text_col).alias("text"))
    rows, texts, found = repeats(own, window, size, crowd, shard_words)
    spans = saved(found.groupBy(*_KEY).agg(F.collect_set(F.struct("start", "windows")).alias("spans")), "spans")
    runs = spans.select(*_KEY, "spans.start", "spans.windows")
    changed = texts.select(*_KEY, "text").join(runs, _KEY).mapInPandas(
        _removed(window, show), "no_id boolean, doc long, mark long, n_removed long, left_sha256 string" + (", kept string, spans array<array<int>>" if show else "")
    )
    whole = F.col("copy") & (F.col("n_words") >= window)
    columns = [
        "doc_id", "n_words", F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("left_sha256", "kept_sha256")).alias("kept_sha256"),
    ]
    if show:
        columns += [F.when(whole, F.lit("")).otherwise(F.col("kept")).alias("kept"), F.when(whole, F.array(F.array(F.lit(0), F.col("n_words").cast("int")))).otherwise(F.col("spans")).alias("spans")]
    result = rows.join(changed, _KEY, "left").select(*columns)
    return result.filter("n_removed > 0") if show else result


SQL = r"""
with w as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
p as (
  select doc_id, unnest(range(1, len(words) + 1)) as pos, unnest(words) as word, len(words) as n, words from w),
s as (
  select doc_id, pos, word, case when pos + 19 <= n then sha256(array_to_string(words[pos:pos + 19], ' ')) end as k from p),
r as (
  select doc_id, pos, word, k is not null and row_number() over (partition by k order by doc_id, pos) > 1 as again from s),
c as (
  select doc_id, pos, word, max(case when again then pos end) over (partition by doc_id order by pos rows between 19 preceding and current row) is not null as gone from r)
select w.doc_id, len(w.words) as n_words, count(c.pos) filter (where c.gone) as n_removed,
  sha256(coalesce(string_agg(c.word, ' ' order by c.pos) filter (where not c.gone), '')) as kept_sha256
from w left join c on w.doc_id = c.doc_id
group by w.doc_id, w.words
"""
