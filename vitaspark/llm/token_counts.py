"""Token counts of whole texts under a sentencepiece BPE model, most words by a whole-token shortcut."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitaspark.llm.bpe import merge
from vitaspark.llm.common import as_bytes

LIMIT = 4096
#: Distinct merged pre-tokens a worker remembers; bounds memory, not results.
REMEMBERED = 400_000
MARK = "▁"  # stands for a space in the vocabulary


class Vocabulary:
    """Scores of the pieces that merges may form, and what follows from them.

    Proof of the shortcut, done once per vocabulary: no piece holds the space
    mark behind another character, and some characters stand in no piece of two
    or more characters; so merges never cross the beginning of a run of marks
    or touch such a character, and the pre-tokens cut there are encoded apart.
    A vocabulary string that merges back into itself alone is one token wherever
    it is a pre-token; those strings are ``whole``.
    """

    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece holds a space inside: pre-tokens can't be cut at spaces")
        joined = {c for p in pieces if len(p) > 1 for c in p}
        self.alone = "".join(chr(c) for c in range(128) if chr(c) not in joined and chr(c) != " ")
        self.whole = {p for p in pieces if self.merged(p) == 1}

    def split(self) -> re.Pattern:
        cut = re.escape(self.alone)
        return re.compile(f"{MARK}+[^{MARK}{cut}]*|[^{MARK}{cut}]+" + (f"|[{cut}]" if cut else ""))

    def merged(self, token: str) -> int:
        """Tokens of a pre-token by merging; a character without a piece falls back to its bytes."""
        pieces = self.pieces

        def rank(a: str, b: str) -> float | None:
            score = pieces.get(a + b)
            return None if score is None else -score

        return sum(1 if p in pieces else len(p.encode()) for p in merge(list(token), rank))


class Counter(dict):
    """Tokens by pre-token: 1 for whole tokens, the rest merged when first met."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__(dict.fromkeys(vocabulary.whole, 1))
        self.vocabulary, self.base = vocabulary, len(vocabulary.whole)
        self.split = vocabulary.split()

    def __missing__(self, token: str) -> int:
        n = self.vocabulary.merged(token)
        if len(self) - self.base >= REMEMBERED:
            self.clear()
            self.update(dict.fromkeys(self.vocabulary.whole, 1))
        self[token] = n
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        marked = MARK + text.replace(" ", MARK)
        found = self.split.findall(marked) if len(marked) < 1 << 22 else (m[0] for m in self.split.finditer(marked))
        return sum(map(self.__getitem__, found))


def load_pieces(path: str) -> dict[str, float]:
    """Pieces and scores of a sentencepiece BPE model without text rewriting, on the driver."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    if model.encode(" a  b ", out_type=str) and model.normalize(" ﬁ  Ａ ") != f"{MARK}{MARK}ﬁ{MARK}{MARK}Ａ{MARK}":
        raise ValueError("the model rewrites texts; only its dummy prefix and space marks are supported")
    return {
        model.id_to_piece(i): model.get_score(i)
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    }


_loaded: dict[int, Counter] = {}


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit.

    ``path`` names the model on the driver; its pieces are broadcast, whose
    size is that of the vocabulary. No shuffle, a row per document; null counts
    as empty, which has no tokens.
    """
    pieces = docs.sparkSession.sparkContext.broadcast(load_pieces(path))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = hash(frozenset(pieces.value.items()))
        if key not in _loaded:
            _loaded.clear()
            _loaded[key] = Counter(Vocabulary(pieces.value))
        counter = _loaded[key]
        for batch in batches:
            texts = as_bytes(batch["text"])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_bytes": [len(t) for t in texts], "n_tokens": [counter.count(t.decode()) for t in texts]})

    counted = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(
        run, "doc_id long, n_bytes long, n_tokens long"
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
