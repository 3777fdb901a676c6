"""Alignment against the two libraries on whole texts, and the algebra of fragments."""

import hashlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("public_tokenizers")
import public_tokenizers

from vitaspark.llm import alignment as al
from vitaspark.llm.bpe import byte_alphabet

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def plainly(texts, libraries):
    """Rows without the id, from both libraries over whole texts and all overlapping pairs."""
    a, b = libraries
    alphabet = byte_alphabet()
    per_text, held = [], Counter()
    for text in texts:
        enc, ids_b = a.encode(" " + (text or ""), add_special_tokens=False), b.encode(text or "")
        bytes_a = [bytes(alphabet[c] for c in t) for t in enc.tokens]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in ids_b)]
        if not text or b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            per_text.append(None)
            continue

        def spans(parts):
            end, out = 0, []
            for p in parts:
                out.append((end, end + len(p)))
                end += len(p)
            return out

        at_a, at_b = spans(bytes_a), spans(bytes_b)
        cuts = sorted({e for _, e in at_a} & {e for _, e in at_b})
        groups, begin = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for i, (s, _) in zip(ids, at, strict=True) if begin <= s < cut) for ids, at in ((enc.ids, at_a), (ids_b, at_b))))
            begin = cut
        links = [(x, y) for x, (s, e) in zip(enc.ids, at_a, strict=True) for y, (u, v) in zip(ids_b, at_b, strict=True) if s < v and u < e]
        held.update(set(links))
        per_text.append((len(enc.ids), len(ids_b), len(cuts), links, ";".join(groups)))
    most = {}
    for (x, _), n in held.items():
        most[x] = max(most.get(x, 0), n)
    rows = []
    for found in per_text:
        if found is None:
            rows.append((0, 0, 0, 0, 0, 0, "", ""))
            continue
        n_a, n_b, n_groups, links, groups = found
        best, total = sum(held[x] == most[x[0]] for x in links), sum(held[x] for x in links)
        rows.append((n_a, n_b, n_groups, len(links), best, total, hashlib.sha256(groups.encode()).hexdigest(), groups))
    return rows, held


TEXTS = [
    "Hello world, hello tokenizers!", "Hello world, hello tokenizers!", None, "", " ", "  ", "a ", " a", "a  b   c\n d\n\n e \t f", "don't  stop 12 345,678",
    "Straße ÉTÉ 漢字かな交じり文 🙂🙃 family 👨‍👩‍👧", "under▁score", "▁", "<s> </s> <unk> <|endoftext|> <0x41>", "\x00\x01 zero \x1c x \x85 y", "x" * 300, "no-break space 　 wide ᠎  old   line",
    "Ａfullwidth ﬁligature é combining", "1 2  3   4    5", "word " * 50, "trailing newline\n", "\n\nleading", "CamelCaseWordsAndMore_under_score", "﻿bom �",
]


def rows_of(df):
    return sorted(repr(tuple(r)) for r in df.collect())


@pytest.mark.parametrize("chunk", [1 << 16, 7, 24])
def test_like_the_libraries(documents, shared, libraries, chunk):
    long = " ".join(f"sentence {i} of a longer text, {i * 37 % 1000}" for i in range(40)) + "y" * 90 + " end  \n x"
    texts = [*TEXTS, long, long[::-1]]
    ids = [None if i % 9 == 4 else i // 2 for i in range(len(texts))]
    found = al.align(documents(list(zip(ids, texts, strict=True))), A, B, groups=True, chunk=chunk, block_bytes=500)
    want, held = plainly(texts, libraries)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"]
    assert rows_of(found.documents.select(columns)) == sorted(repr((i, *w)) for i, w in zip(ids, want, strict=True))
    links = {(r.a, r.b): r.docs for r in found.links.collect()}
    assert links == dict(held)


def test_empty_table_and_only_odd_texts(documents, shared):
    assert al.align(documents([(1, "a")]).filter("doc_id < 0"), A, B).documents.count() == 0
    found = al.align(documents([(1, None), (None, ""), (2, "▁"), (2, "▁")]), A, B)
    assert sorted(repr(tuple(r)) for r in found.documents.collect()) == sorted(repr((i, 0, 0, 0, 0, 0, 0, "")) for i in (1, None, 2, 2))
    assert found.links.count() == 0


def test_a_very_long_text(documents, shared, libraries):
    text = "the quick brown fox, jumps over 12 lazy dogs and cats; " * 8_000
    found = al.align(documents([(1, text), (2, "the quick dog")]), A, B).documents.collect()
    a, b = libraries
    by_id = {r.doc_id: r for r in found}
    assert by_id[1].n_a == len(a.encode(" " + text, add_special_tokens=False).ids) and by_id[1].n_b == len(b.encode(text))
    assert by_id[1].groups_sha256 and by_id[2].n_links >= 3


words = st.text(alphabet="ab c d\n é漢᠎\x1c", max_size=40)


@settings(max_examples=300, deadline=None)
@given(st.lists(words.filter(bool), min_size=1, max_size=6), st.data())
def test_fragments_compose_in_any_order(parts, data):
    at, leaves = 0, []
    for p in parts:
        leaves.append(al.fragment(p, at))
        at += len(p.encode())
    left = leaves[0]
    for x in leaves[1:]:
        left = al.compose(left, x)
    while len(leaves) > 1:
        i = data.draw(st.integers(0, len(leaves) - 2))
        leaves[i:i + 2] = [al.compose(leaves[i], leaves[i + 1])]
    text = "".join(parts)
    for x in (left, leaves[0]):
        pieces = al.ended(x)
        assert "".join(p for _, p in pieces) == text
        assert [a for a, _ in pieces] == [len(text.encode()[:a].decode().encode()) for a, _ in pieces]
        cuts = lambda ps: [s for _, p in ps for s in al.segments(" " + p)]
        whole = al.ended(al.fragment(text, 0))
        assert (x.prefix, x.suffix) == (al.fragment(text, 0).prefix, al.fragment(text, 0).suffix)
        assert "".join(p for _, p in whole) == text and cuts(pieces)[0] == cuts(whole)[0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([" ", "  ", "\n", "\t", "a", "the", "don't", "é", "漢字", "🙂", "12", "!?", "\x00", "\x1c", "᠎", " ", "　", "ﬁ", "<s>"]), max_size=25))
def test_segments_encode_like_whole_texts(libraries, pieces):
    text = "".join(pieces)
    if not text:
        return
    a, b = libraries
    with open(A, encoding="utf-8") as f, open(B, "rb") as g:
        pair = _pair(f.read(), g.read())
    ids_a, ids_b = [], []
    for x, y in pair.encode([" " + p for p in al.segments(" " + text)]):
        ids_a += x
        ids_b += y
    assert ids_a == a.encode(" " + text, add_special_tokens=False).ids
    assert ids_b == b.encode(text)


_PAIRS = {}


def _pair(spec, model):
    if not _PAIRS:
        _PAIRS[0] = al.Pair(spec, model)
    return _PAIRS[0]
