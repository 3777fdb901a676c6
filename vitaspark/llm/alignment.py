"""Alignment of two tokenizers' tokens over the same bytes, and corpus-wide counts of the token pairs that overlap.

A text is cut into segments at places where both tokenizers begin a new
pre-token: in front of a space that follows a character which is no white
space. Tokens never cross such a place, so segments align by themselves, and a
block of documents aligns each distinct segment once.

A document longer than a chunk is spread over tasks. What a task knows of a
byte range is a fragment: an open prefix before its first certain cut, closed
text between cuts, an open suffix after the last. Fragments compose
associatively, so neighbours are joined level by level in a tree; text that
gets closed on the way is aligned where it is closed, and only the open ends
move up.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitaspark.llm.bpe import byte_alphabet
from vitaspark.llm.common import as_bytes, saved
from vitaspark.llm.token_counts import MARK

#: Bytes of a document one task takes; longer documents are spread.
CHUNK = 1 << 16
#: Text of the documents whose pairs are counted together before they leave a task.
BLOCK_BYTES = 4 << 20
#: Fragments joined at a time on the way up the tree.
FAN = 16

#: Python counts some control characters as white space that others don't, and once U+180E was white space: no cut behind any of them.
_CUT = re.compile("(?<=[^\\s\\u180e]) ")
_DOUBT = re.compile("[\\s\\u180e] ")


class Fragment(NamedTuple):
    """What is known of the text from byte ``at`` on: ``suffix`` is None where no cut was found, then all of it is ``prefix``."""

    prefix: str
    at: int
    closed: tuple[tuple[int, str], ...]
    suffix: str | None
    suffix_at: int


def fragment(text: str, at: int) -> Fragment:
    found = _CUT.search(text)
    if found is None:
        return Fragment(text, at, (), None, at)
    first = found.start()
    last = text.rfind(" ")
    while not _CUT.match(text, last):
        last = text.rfind(" ", 0, last)
    begin = at + len(text[:first].encode())
    middle = text[first:last]
    return Fragment(text[:first], at, ((begin, middle),) if middle else (), text[last:], begin + len(middle.encode()))


def compose(x: Fragment, y: Fragment) -> Fragment:
    """The fragment of two neighbouring ranges."""
    if x.suffix is not None and y.suffix is not None:
        return Fragment(x.prefix, x.at, (*x.closed, (x.suffix_at, x.suffix + y.prefix), *y.closed), y.suffix, y.suffix_at)
    if x.suffix is not None:
        end = fragment(x.suffix + y.prefix, x.suffix_at)
        if end.suffix is None:
            return Fragment(x.prefix, x.at, x.closed, end.prefix, x.suffix_at)
        return Fragment(x.prefix, x.at, (*x.closed, (end.at, end.prefix), *end.closed), end.suffix, end.suffix_at)
    start = fragment(x.prefix + y.prefix, x.at)
    if y.suffix is None:
        return start
    if start.suffix is None:
        return Fragment(start.prefix, x.at, y.closed, y.suffix, y.suffix_at)
    return Fragment(start.prefix, x.at, (*start.closed, (start.suffix_at, start.suffix), *y.closed), y.suffix, y.suffix_at)


def ended(x: Fragment) -> list[tuple[int, str]]:
    """All texts of the fragment of a whole document, in order: nothing is open at its ends."""
    return [(x.at, x.prefix), *x.closed, *([(x.suffix_at, x.suffix)] if x.suffix is not None else [])]


def segments(text: str) -> list[str]:
    """The segments of a text that begins with a space, without the space each begins with."""
    if _DOUBT.search(text):
        return [s[1:] for s in re.split("(?<=[^\\s\\u180e])(?= )", text)]
    return text[1:].split(" ")


class Pair:
    """Two tokenizers and the bytes of their tokens: a byte-level one from a file's text and a piece model from a file's bytes."""

    def __init__(self, spec: str, model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        known = json.loads(spec)
        kind = known.get("pre_tokenizer") or {}
        if known.get("normalizer") is not None or kind.get("type") != "ByteLevel" or not kind.get("use_regex", True):
            raise ValueError("the first vocabulary must be byte-level, with its usual split and no normalizer")
        self.a = Tokenizer.from_str(spec)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        alphabet = byte_alphabet()
        special = {t["id"] for t in known["added_tokens"]}
        self.bytes_a = {i: s.encode() if i in special else bytes(alphabet[c] for c in s) for s, i in self.a.get_vocab().items()}
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = {i: self.b.id_to_piece(i) for i in range(self.b.get_piece_size())}
        if any(MARK in p.lstrip(MARK) for p in pieces.values()):
            raise ValueError("a piece holds a space inside: texts can't be cut in front of spaces")
        self.bytes_b = {i: bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in pieces.items()}
        self.space = self.b.piece_to_id(MARK)

        self.len_a, self.len_b = (np.array([len(of.get(i, b"")) for i in range(max(of) + 1)], np.int64) for of in (self.bytes_a, self.bytes_b))
        width = len(str(max(*self.bytes_a, *self.bytes_b))) + 1
        self.inner, self.bar, self.end = (np.array([f"{i}{c}" for i in range(max(len(self.len_a), len(self.len_b)))], f"S{width}") for c in ",|;")
        self.shown = np.char.str_len(self.inner)

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids of both for texts that begin with a space each."""
        first = self.a.encode_batch_fast(texts, add_special_tokens=False)
        second = self.b.encode([t[1:] for t in texts], num_threads=1)
        return [(a.ids, b if len(t) > 1 else [self.space]) for t, a, b in zip(texts, first, second, strict=True)]

    def exact(self, raw: bytes, a: list[int], b: list[int]) -> bool:
        """Whether the bytes of both lists of tokens are ``raw``."""
        return b"".join([self.bytes_a[i] for i in a]) == raw and b"".join([self.bytes_b[i] for i in b]) == raw


#: Segments encoded in one call are joined to texts of about this many characters.
JOINED = 1 << 14


class Segments:
    """Distinct segments, aligned: per segment ``worth`` (A tokens, B tokens, groups, links), ``bad``, ``groups`` as text and links as
    ``pair[begin:begin + links]``, which are indexes into ``a`` and ``b``.

    Segments that end without white space keep their tokens when joined, so
    they are encoded as long texts. All places are byte offsets in the joined
    text: a token lies between two ends of its own tokenizer, a group ends where
    both have an end, and each stretch between neighbouring ends of either is
    one overlap of an A and a B token.
    """

    def __init__(self, parts: list[str], pair: Pair):
        n = len(parts)
        joined, loose, size = [[]], [], 0
        for i, p in enumerate(parts):
            if not p or _DOUBT.match(p[-1] + " "):
                loose.append([i])
                continue
            joined[-1].append(i)
            size += len(p) + 1
            if size > JOINED:
                joined.append([])
                size = 0
        items, good = [x for x in joined if x] + loose, []
        again = []
        for item, tokens, raw in self._encoded(items, parts, pair):
            if pair.exact(raw, *tokens):
                good.append((item, tokens))
            else:
                again += [[i] for i in item]
        self.bad = np.zeros(n, bool)
        for item, tokens, raw in self._encoded(again, parts, pair):
            if pair.exact(raw, *tokens):
                good.append((item, tokens))
            else:
                self.bad[item[0]] = True
        order = np.array([i for item, _ in good for i in item], np.int64)
        a = np.array([i for _, (x, _) in good for i in x], np.int64)
        b = np.array([i for _, (_, x) in good for i in x], np.int64)
        end = np.cumsum([len(parts[i].encode()) + 1 for i in order.tolist()])
        end_a, end_b = np.cumsum(pair.len_a[a]), np.cumsum(pair.len_b[b])
        both = np.intersect1d(end_a, end_b, assume_unique=True)
        either = np.union1d(end_a, end_b)
        part = lambda ends: np.searchsorted(end, ends)
        sizes = np.stack([np.bincount(part(x), minlength=len(order)) for x in (end_a, end_b, both, either)])
        self.worth = np.zeros((4, n), np.int64)
        self.worth[:, order] = sizes
        code = a[np.searchsorted(end_a, either)] << 32 | b[np.searchsorted(end_b, either)]
        known, self.pair = np.unique(code, return_inverse=True)
        self.a, self.b = known >> 32, known & 0xFFFFFFFF
        self.begin = np.zeros(n, np.int64)
        self.begin[order] = np.cumsum(sizes[3]) - sizes[3]
        # text of the groups: A tokens of a group stand before its B tokens
        group_a, group_b = np.searchsorted(both, end_a), np.searchsorted(both, end_b)
        place_a = np.arange(len(a)) + np.searchsorted(group_b, group_a)
        place_b = np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")
        cells = np.zeros(len(a) + len(b), pair.inner.dtype)
        cells[place_a] = np.where(both[group_a] == end_a, pair.bar[a], pair.inner[a])
        cells[place_b] = np.where(both[group_b] == end_b, pair.end[b], pair.inner[b])
        text = cells.tobytes().replace(b"\0", b"")
        stop = np.cumsum(np.bincount(part(end_a), pair.shown[a], len(order)) + np.bincount(part(end_b), pair.shown[b], len(order))).astype(np.int64).tolist()
        self.groups, at = [b""] * n, 0
        for i, to in zip(order.tolist(), stop, strict=True):
            self.groups[i] = text[at:to]
            at = to

    @staticmethod
    def _encoded(items: list[list[int]], parts: list[str], pair: Pair) -> Iterator[tuple[list[int], tuple[list[int], list[int]], bytes]]:
        texts = [" " + " ".join([parts[i] for i in item]) for item in items]
        if texts:
            yield from ((item, tokens, t.encode()) for item, tokens, t in zip(items, pair.encode(texts), texts, strict=True))


class Counted(NamedTuple):
    """Per text: numbers of A tokens, B tokens, groups, links (rows of ``sums``), whether its bytes differ, and the groups as text; distinct
    pairs of each text as (text, pair, times) sorted by text, pair being an index into ``a`` and ``b``."""

    sums: np.ndarray
    bad: np.ndarray
    groups: list[bytes]
    text: np.ndarray
    pair: np.ndarray
    times: np.ndarray
    a: np.ndarray
    b: np.ndarray


def count(texts: list[str], pair: Pair) -> Counted:
    """Align texts that begin with a space each; an empty text has no tokens."""
    numbers: dict[str, int] = {}
    rows = []
    for t in texts:
        rows.append([numbers.setdefault(p, len(numbers)) for p in segments(t)] if t else [])
    known = Segments(list(numbers), pair)
    del numbers
    n, kinds = len(texts), len(known.groups)
    text = np.repeat(np.arange(n), [len(r) for r in rows])
    part = np.fromiter(chain.from_iterable(rows), np.int64, len(text))
    bad = np.bincount(text, known.bad[part], n) > 0
    sums = np.stack([np.where(bad, 0, np.bincount(text, w[part], n).astype(np.int64)) for w in known.worth])
    groups = [b"" if bad[i] else b"".join([known.groups[p] for p in row])[:-1] for i, row in enumerate(rows)]
    del rows
    good = ~bad[text]
    key, times = np.unique(text[good] * kinds + part[good], return_counts=True)
    text, part = key // max(1, kinds), key % max(1, kinds)
    length = known.worth[3][part]
    where = np.repeat(known.begin[part] - np.cumsum(length) + length, length) + np.arange(length.sum())
    pairs = max(1, len(known.a))
    key, inverse = np.unique(np.repeat(text, length) * pairs + known.pair[where], return_inverse=True)
    times = np.bincount(inverse, np.repeat(times, length), len(key)).astype(np.int64)
    text, kind = key // pairs, key % pairs
    held, kind = np.unique(kind, return_inverse=True)
    return Counted(sums, bad, groups, text, kind, times, known.a[held], known.b[held])


_loaded: dict[str, Pair] = {}


def _pair(files) -> Pair:
    """The two tokenizers, once a worker."""
    spec, model = files.value
    key = hashlib.md5(spec.encode() + model).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Pair(spec, model)
    return _loaded[key]


_SUMS = ["n_a", "n_b", "n_groups", "n_links"]
_SPREAD = (
    "kind string, block string, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, "
    "pair array<int>, times array<int>, a array<int>, b array<int>, docs array<int>, nth int, parts int, at long, text string"
)
_OPEN = "block string, nth int, prefix string, prefix_at long, suffix string, suffix_at long"
_STEP = _SPREAD + ", prefix string, prefix_at long, suffix string, suffix_at long"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _frame(rows: dict, columns: list[str]) -> pd.DataFrame:
    """A frame of the wide row kind; columns that are not given stay null."""
    size = len(next(iter(rows.values())))
    return pd.DataFrame({c: pd.Series(rows.get(c, [None] * size), dtype=object) for c in columns})


def _lists(found: Counted, n: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    ends = np.searchsorted(found.text, np.arange(n + 1))
    spans = [slice(ends[i], ends[i + 1]) for i in range(n)]
    return [found.pair[s].astype(np.int32) for s in spans], [found.times[s].astype(np.int32) for s in spans]


def _digest(groups: bytes) -> str:
    return hashlib.sha256(groups).hexdigest() if groups else ""


def _block(ids: list, texts: list[str], tokenizers: Pair, keep: bool) -> Iterator[pd.DataFrame]:
    """Document rows of a block and one row of its distinct pairs with the documents that hold each."""
    found = count(texts, tokenizers)
    pair, times = _lists(found, len(texts))
    name, n = uuid.uuid4().hex, len(texts)
    yield _frame({
        "kind": ["doc"] * n, "block": [name] * n, "doc_id": pd.array(ids, "Int64"), **dict(zip(_SUMS, found.sums, strict=True)),
        "groups_sha256": [_digest(g) for g in found.groups], **({"groups": [g.decode() for g in found.groups]} if keep else {}), "pair": pair, "times": times,
    }, _names(_SPREAD))
    if not len(found.a):
        return
    held = np.bincount(found.pair, minlength=len(found.a))
    row = {"kind": ["pairs"], "block": [name], **{c: [v.astype(np.int32)] for c, v in (("a", found.a), ("b", found.b), ("docs", held))}}
    yield _frame(row, _names(_SPREAD))


def _chunks(doc_id, raw: bytes, size: int) -> pd.DataFrame:
    """A long document as byte ranges, moved to the beginnings of characters."""
    cuts = list(range(0, len(raw), size))
    for i in range(1, len(cuts)):
        while raw[cuts[i]] & 0xC0 == 0x80:
            cuts[i] -= 1
    cuts = sorted(set(cuts))
    ends, n, name = [*cuts[1:], len(raw)], len(cuts), uuid.uuid4().hex
    return _frame({
        "kind": ["chunk"] * n, "block": [name] * n, "doc_id": pd.array([doc_id] * n, "Int64"), "nth": list(range(n)), "parts": [n] * n, "at": cuts,
        "text": [raw[a:b].decode() for a, b in zip(cuts, ends, strict=True)],
    }, _names(_SPREAD))


def _first_pass(files, chunk: int, block_bytes: int, keep: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pair = _pair(files)
        ids, texts, held = [], [], 0
        for batch in batches:
            for doc_id, raw in zip(batch["doc_id"].astype("Int64"), as_bytes(batch["text"]), strict=True):
                if len(raw) >= chunk:
                    yield _chunks(doc_id, b" " + raw, chunk)
                    continue
                ids.append(doc_id)
                texts.append(" " + raw.decode() if raw else "")
                held += len(raw)
                if held >= block_bytes:
                    yield from _block(ids, texts, pair, keep)
                    ids, texts, held = [], [], 0
        if ids:
            yield from _block(ids, texts, pair, keep)

    return run


def _closed_frame(name: list[str], texts: list[tuple[int, str]], tokenizers: Pair) -> pd.DataFrame:
    """Aligned rows of closed texts (byte offset, text) of the documents ``name``."""
    found = count([t for _, t in texts], tokenizers)
    pair, times = _lists(found, len(texts))
    n = len(texts)
    return _frame({
        "kind": ["closed"] * n, "block": name, **dict(zip(_SUMS, found.sums, strict=True)), "groups": [g.decode() for g in found.groups], "at": [at for at, _ in texts],
        "a": [found.a[p].astype(np.int32) for p in pair], "b": [found.b[p].astype(np.int32) for p in pair], "times": times, "parts": found.bad.astype(np.int32),
    }, _names(_STEP))


def _open_frame(name: str, nth: int, x: Fragment) -> pd.DataFrame:
    return _frame({
        "kind": ["open"], "block": [name], "nth": [nth], "prefix": [x.prefix], "prefix_at": [x.at], "suffix": [x.suffix], "suffix_at": [x.suffix_at],
    }, _names(_STEP))


def _leaves(files):
    """Chunks to fragments; closed text is aligned at once."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pair = _pair(files)
        for batch in batches:
            for name, nth, at, text in zip(batch["block"], batch["nth"], batch["at"], batch["text"], strict=True):
                x = fragment(text, int(at))
                yield _open_frame(name, nth, x)
                if x.closed:
                    yield _closed_frame([name], list(x.closed), pair)

    return run


def _joined(files, last: bool):
    """Neighbouring fragments composed, in order; at the last level the ends close too."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("nth")
        name, total = group["block"].iloc[0], None
        for prefix, at, suffix, suffix_at in zip(group["prefix"], group["prefix_at"], group["suffix"], group["suffix_at"], strict=True):
            x = Fragment(prefix, int(at), (), None if suffix is None or suffix != suffix else suffix, int(suffix_at))
            total = x if total is None else compose(total, x)
        texts = ended(total) if last else list(total.closed)
        out = [] if last else [_open_frame(name, int(group["nth"].iloc[0]) // FAN, total)]
        if texts:
            out.append(_closed_frame([name] * len(texts), texts, _pair(files)))
        return pd.concat(out, ignore_index=True)

    return run


def _reduced(chunks: DataFrame, files) -> DataFrame:
    """Closed rows of all long documents: leaves, then levels of the tree until each document is one fragment."""
    most = chunks.agg(F.max("parts")).first()[0]
    leaves = saved(chunks.select("block", "nth", "at", "text").repartition("block", "nth").mapInPandas(_leaves(files), _STEP), "fragments")
    closed, opened = [leaves.filter("kind = 'closed'")], leaves.filter("kind = 'open'")
    while True:
        last = most <= FAN
        grouped = opened.select(*_names(_OPEN)).groupBy("block", F.floor(F.col("nth") / FAN).cast("int").alias("part"))
        level = saved(grouped.applyInPandas(_joined(files, last), _STEP), "fragments")
        closed.append(level.filter("kind = 'closed'"))
        if last:
            break
        opened, most = level.filter("kind = 'open'"), -(-most // FAN)
    out = closed[0]
    for more in closed[1:]:
        out = out.unionByName(more)
    return out


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Digest of each document's groups; rows come by document and place, pieces are hashed as they pass."""
    name, digest = None, None
    for batch in batches:
        done = []
        for block, groups in zip(batch["block"], batch["groups"], strict=True):
            if block != name:
                if name is not None:
                    done.append((name, digest.hexdigest()))
                name, digest = block, hashlib.sha256()
            else:
                digest.update(b";")
            digest.update(groups.encode())
        yield pd.DataFrame(done, columns=["block", "groups_sha256"])
    if name is not None:
        yield pd.DataFrame([(name, digest.hexdigest())], columns=["block", "groups_sha256"])


class Aligned(NamedTuple):
    """``documents``: a row per document; ``links``: (a, b, docs, best), in how many documents two ids overlap and whether that is A's highest count."""

    documents: DataFrame
    links: DataFrame


def align(
    docs: DataFrame, path_a: str, path_b: str, groups: bool = False, chunk: int = CHUNK, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text"
) -> Aligned:
    """Align the tokens of a byte-level vocabulary (``path_a``, space + text) and of a piece model (``path_b``, text) of whole documents.

    ``documents`` has doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256 and with ``groups`` the text ``a1,a2|b1;a3|b2,b3`` that the
    digest is of. Null and empty texts and texts that either tokenizer's bytes
    don't give back have zeros and ''. Every row counts as a document, repeated
    and null ids too; other columns are left out.

    Pairs are counted per block of documents before they travel. A block then
    asks for the counts of its own pairs only, so neither the pair table nor
    the counts of the corpus meet in one place.
    """
    with open(path_a, encoding="utf-8") as a, open(path_b, "rb") as b:
        files = docs.sparkSession.sparkContext.broadcast((a.read(), b.read()))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    first = saved(rows.mapInPandas(_first_pass(files, chunk, block_bytes, groups), _SPREAD), "alignment")
    short, chunks = first.filter("kind = 'doc'"), first.filter("kind = 'chunk'")
    asked = first.filter("kind = 'pairs'").select("block", F.posexplode(F.arrays_zip("a", "b", "docs")).alias("i", "x")).select("block", "i", "x.a", "x.b", "x.docs")
    seen, spread = asked.select("a", "b", "docs"), not chunks.isEmpty()
    if spread:
        closed = _reduced(chunks, files)
        of = chunks.filter("nth = 0").select("block", "doc_id")
        totals = closed.groupBy("block").agg(*[F.sum(c).alias(c) for c in _SUMS], F.max("parts").alias("bad"))
        ordered = closed.select("block", "at", "groups").repartition("block").sortWithinPartitions("block", "at").select("block", "groups")
        totals = totals.join(ordered.mapInPandas(_hashed, "block string, groups_sha256 string"), "block").join(of, "block")
        if groups:
            texts = closed.groupBy("block").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "groups"))), lambda x: x["groups"]), ";").alias("groups"))
            totals = totals.join(texts, "block")
        totals = saved(totals, "long")
        held = closed.select("block", F.explode(F.arrays_zip("a", "b", "times")).alias("x")).groupBy("block", "x.a", "x.b").agg(F.sum("x.times").alias("times"))
        held = saved(held.join(totals.filter("bad = 0").select("block"), "block", "left_semi"), "long-pairs")
        seen = seen.unionByName(held.select("a", "b", F.lit(1).alias("docs")))
    links = seen.groupBy("a", "b").agg(F.sum("docs").alias("docs"))
    links = saved(links, "links")
    highest = links.groupBy("a").agg(F.max("docs").alias("most"))
    links = links.join(highest, "a").select("a", "b", "docs", (F.col("docs") == F.col("most")).alias("best"))
    answers = asked.drop("docs").join(links, ["a", "b"]).select(F.col("block").alias("asker"), "i", "docs", "best")
    shown = ["doc_id", *_SUMS, "n_best", "count_sum", "groups_sha256", *(["groups"] if groups else [])]

    def settle(mine: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        docs_of, best_of = np.zeros(len(given), np.int64), np.zeros(len(given), np.int64)
        docs_of[given["i"]], best_of[given["i"]] = given["docs"], given["best"]
        best = [int(best_of[p] @ t) for p, t in zip(mine["pair"], mine["times"], strict=True)]
        total = [int(docs_of[p] @ t) for p, t in zip(mine["pair"], mine["times"], strict=True)]
        # plain objects: a group's strings may lie in several Arrow chunks, which a result can't
        return mine.assign(n_best=best, count_sum=total)[shown].astype({c: object for c in ("groups_sha256", "groups") if c in shown})

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string" + (", groups string" if groups else "")
    mine = short.select("block", "doc_id", *_SUMS, "groups_sha256", "pair", "times", *(["groups"] if groups else []))
    found = mine.groupBy("block").cogroup(answers.groupBy("asker")).applyInPandas(settle, schema)
    if spread:
        scored = held.join(links, ["a", "b"]).groupBy("block").agg(
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum")
        )
        good = F.col("bad") == 0
        long_docs = totals.join(scored, "block", "left").select(
            "doc_id", *[F.when(good, F.col(c)).otherwise(0).alias(c) for c in _SUMS], F.coalesce("n_best", F.lit(0)).alias("n_best"),
            F.coalesce("count_sum", F.lit(0)).alias("count_sum"), F.when(good, F.col("groups_sha256")).otherwise("").alias("groups_sha256"),
            *([F.when(good, F.col("groups")).otherwise("").alias("groups")] if groups else []),
        )
        found = found.unionByName(long_docs)
    return Aligned(found, links)
