"""Byte-pair encoding and decoding of whole texts, and the merge loop shared with token counts."""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Callable, Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitaspark.llm.common import as_bytes

#: The usual split of byte-level BPE vocabularies (fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct pre-tokens a worker remembers; bounds memory, not results.
REMEMBERED = 400_000


def merge(symbols: list, rank: Callable[[object, object], int | None]) -> list:
    """Merge neighbours in order of rank, leftmost first, until no pair has one.

    Symbols form a doubly linked list; candidates wait in a priority queue. A
    candidate whose symbols have changed since is stale and skipped.
    """
    n = len(symbols)
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    queue = []
    for i in range(n - 1):
        r = rank(symbols[i], symbols[i + 1])
        if r is not None:
            queue.append((r, i, symbols[i], symbols[i + 1]))
    heapq.heapify(queue)
    while queue:
        _, i, a, b = heapq.heappop(queue)
        j = right[i]
        if symbols[i] is None or j >= n or symbols[i] != a or symbols[j] != b:
            continue
        symbols[i], symbols[j] = a + b, None
        right[i] = k = right[j]
        if k < n:
            left[k] = i
            r = rank(symbols[i], symbols[k])
            if r is not None:
                heapq.heappush(queue, (r, i, symbols[i], symbols[k]))
        h = left[i]
        if h >= 0:
            r = rank(symbols[h], symbols[i])
            if r is not None:
                heapq.heappush(queue, (r, h, symbols[h], symbols[i]))
    return [s for s in symbols if s is not None]


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in plain}
    table.update({chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))})
    return table


class ByteBPE:
    """A byte-level BPE vocabulary read from a tokenizer file."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        alphabet = byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        self.ids = {raw(s): i for s, i in data["model"]["vocab"].items()}
        self.strings = {i: s for s, i in self.ids.items()}
        self.ranks = {}
        for i, pair in enumerate(data["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[raw(a), raw(b)] = i
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.strings.update({i: s.encode() for s, i in self.special.items()})
        longest_first = sorted(self.special, key=len, reverse=True)
        self.at_special = regex.compile("|".join(map(regex.escape, longest_first))) if longest_first else None
        self.split = regex.compile(SPLIT)
        self.known: dict[str, tuple[int, ...]] = {}

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        found = self.known.get(piece)
        if found is None:
            ranks = self.ranks
            parts = merge([bytes((b,)) for b in piece.encode()], lambda a, b: ranks.get((a, b)))
            found = tuple(self.ids[p] for p in parts)
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[piece] = found
        return found

    def pieces(self, text: str) -> Iterator[tuple[str, bool]]:
        """(piece, is special) in order; special strings inside a text are cut out first."""
        at = 0
        for m in self.at_special.finditer(text) if self.at_special else ():
            for p in self.split.findall(text[at:m.start()]):
                yield p, False
            yield m[0], True
            at = m.end()
        for p in self.split.findall(text[at:] if at else text):
            yield p, False

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        if self.at_special is None or not self.at_special.search(text):
            known = self.known
            for piece in self.split.findall(text):
                out += known.get(piece) or self.encode_piece(piece)
            return out
        for piece, special in self.pieces(text):
            if special:
                out.append(self.special[piece])
            else:
                out += self.encode_piece(piece)
        return out

    def decode(self, ids: list[int]) -> str:
        strings = self.strings
        return b"".join([strings[i] for i in ids]).decode("utf-8", "replace")


_loaded: dict[str, ByteBPE] = {}


def _vocabulary(spec: str) -> ByteBPE:
    """One parsed vocabulary a worker."""
    key = hashlib.md5(spec.encode()).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = ByteBPE(spec)
    return _loaded[key]


def _spec(docs: DataFrame, path: str):
    with open(path, encoding="utf-8") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): token ids of each whole text; null and empty texts have none.

    ``path`` is a vocabulary file on the driver, whose content is broadcast (a
    few MB, whatever the corpus). No shuffle; a row per document, repeated and
    null ids included.
    """
    spec = _spec(docs, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = _vocabulary(spec.value)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": [bpe.encode(t.decode()) for t in as_bytes(batch["text"])]})
        bpe.known.clear()  # the worker may serve other stages next

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids): vocabulary strings joined, broken UTF-8 as U+FFFD. A null list gives an empty text."""
    spec = _spec(encoded, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = _vocabulary(spec.value)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": [bpe.decode([] if x is None else x) for x in batch["ids"]]})

    return encoded.select("doc_id", "ids").mapInPandas(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256, from :func:`encode` and decoding in the same pass."""
    spec = _spec(docs, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = _vocabulary(spec.value)
        for batch in batches:
            rows = []
            for text in as_bytes(batch["text"]):
                ids = bpe.encode(text.decode())
                rows.append((
                    len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(bpe.decode(ids).encode()).hexdigest()
                ))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"]).assign(doc_id=batch["doc_id"].array)
        bpe.known.clear()  # the worker may serve other stages next

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
