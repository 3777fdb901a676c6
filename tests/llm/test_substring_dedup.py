"""Removal of repeated passages against brute force, and the suffix automaton against its definition."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vitaspark.llm import substring_dedup as sd


def plainly(rows, window=20):
    """{(doc_id, text): (n_words, kept words)} by comparing every window with all earlier ones. Rows of one id must have one text."""
    first = {}
    order = sorted({r for r in rows}, key=lambda r: (r[0] is None, r[0] or 0))
    out = {}
    for doc_id, text in order:
        words = [w for w in _split(text or "")]
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            key = tuple(words[i:i + window])
            if key in first:
                gone[i:i + window] = [True] * window
            else:
                first[key] = (doc_id, i)
        out[doc_id, text] = (len(words), [w for w, g in zip(words, gone, strict=True) if not g])
    return out


def _split(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text)


def check(found, rows, window=20):
    want = plainly(rows, window)
    expected = sorted(repr((i, want[i, t][0], want[i, t][0] - len(want[i, t][1]), hashlib.sha256(" ".join(want[i, t][1]).encode()).hexdigest())) for i, t in rows)
    assert sorted(repr(tuple(r)) for r in found.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()) == expected
    return want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=14), max_size=6))
def test_automaton_tells_the_longest_earlier_match(passages):
    automaton, seen = sd.Automaton(), set()
    for words in passages:
        got = automaton.add(words)
        for end in range(1, len(words) + 1):
            assert got[end - 1] == max((end - i for i in range(end) if tuple(words[i:end]) in seen), default=0)
            seen.update(tuple(words[i:end]) for i in range(end))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=30), max_size=5), st.integers(1, 4), st.integers(0, 12))
def test_anchors_depend_on_windows_only(texts, size, more):
    window = size + more
    words = [w for t in texts for w in t]
    doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    anchor, first, windows = sd.anchors(sd.mix(np.array(words, np.uint64) + np.uint64(5)), doc, window, size)
    begins = np.cumsum([0] + [len(t) for t in texts])
    covered, of = [], {}
    for a, f, k in zip(anchor.tolist(), first.tolist(), windows.tolist(), strict=True):
        for i in range(f, f + k):
            covered.append(i)
            assert of.setdefault(tuple(words[i:i + window]), a) == a
    assert covered == [b + i for b, t in zip(begins, texts) for i in range(len(t) - window + 1)]


def test_word_hashes_over_pieces(monkeypatch):
    monkeypatch.setattr(sd, "BLOCK", 7)
    raw = np.frombuffer("a bb  ccc a dddddddddddddddddd bb\n é x".encode(), np.uint8)
    starts, ends = sd.word_spans(raw)
    hashes = sd.word_hashes(raw, starts, ends)
    words = [bytes(raw[a:b]) for a, b in zip(starts, ends, strict=True)]
    assert words == bytes(raw).split()
    assert len(set(hashes.tolist())) == len(set(words)) and hashes[0] == hashes[3] and hashes[1] == hashes[5]


def corpus(seed, n=120):
    rng = random.Random(seed)
    word = lambda: rng.choice(["alpha", "beta", "gamma", "delta", "é", "漢字", "x", "12", "zeta.", "Eta"])
    passages = [" ".join(word() for _ in range(rng.choice([19, 20, 21, 35, 60]))) for _ in range(8)]
    common = " ".join(f"w{i}" for i in range(24))
    rows = []
    for i in range(n):
        parts = [" ".join(f"{word()}{rng.randrange(50)}" for _ in range(rng.randrange(0, 60)))]
        for _ in range(rng.randrange(0, 3)):
            parts += [rng.choice(passages), " ".join(f"{word()}{rng.randrange(9)}" for _ in range(rng.randrange(0, 12)))]
        if i % 3 == 0:
            parts.insert(rng.randrange(len(parts) + 1), common)
        rows.append((i, rng.choice([" ", "  ", "\n", "\t "]).join(parts)))
    return rows


@pytest.mark.parametrize("crowd, shard_words", [(sd.CROWD, sd.SHARD_WORDS), (2, 300)])
def test_like_brute_force(documents, shared, crowd, shard_words):
    rows = corpus(7)
    rows += [(200 + i, rows[i][1]) for i in range(40)] + [(300, "ab " * 500), (301, "ab ab ba " * 30), (302, " ".join(map(str, range(19)))), (303, " ".join(map(str, range(20)))), (304, " ".join(map(str, range(20))))]
    want = check(sd.dedup_substrings(documents(rows), crowd=crowd, shard_words=shard_words), rows)
    shown = {r.doc_id: r for r in sd.dedup_substrings(documents(rows), show=True, crowd=crowd, shard_words=shard_words).collect()}
    for (i, t), (n, kept) in want.items():
        if n != len(kept):
            assert shown[i].kept == " ".join(kept)
            words = _split(t)
            assert sum(b - a for a, b in shown[i].spans) == n - len(kept)
            assert [w for j, w in enumerate(words) if not any(a <= j < b for a, b in shown[i].spans)] == kept
        else:
            assert i not in shown


def test_odd_rows(documents, shared):
    text = " ".join(f"word{i}" for i in range(30))
    rows = [(5, text), (5, text), (None, text), (None, text), (1, None), (2, ""), (3, " \n "), (4, "one two"), (6, "prefix " + text), (7, "x" * 100_000), (8, "long words in a row " * 20_000)]
    found = sd.dedup_substrings(documents(rows))
    check(found, rows)
    assert {(r.doc_id, r.n_removed) for r in found.collect()} >= {(5, 0), (None, 30), (6, 30), (8, 99_995)}


def test_empty_table(documents, shared):
    assert sd.dedup_substrings(documents([(1, "a")]).filter("doc_id < 0")).count() == 0


@settings(max_examples=4, deadline=None)
@given(st.lists(st.text(alphabet="ab \n", max_size=40), min_size=1, max_size=8))
def test_short_windows(shared, texts):
    rows = list(enumerate(texts))
    df = shared.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit(1))
    check(sd.dedup_substrings(df, window=4, size=2), rows, 4)


def test_same_as_sql(shared):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    rows = corpus(3, 60) + [(500, None), (501, ""), (502, "a b")]
    con.executemany("insert into documents values (?, ?)", rows)
    want = con.execute(sd.SQL).fetchall()
    got = sd.dedup_substrings(shared.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got)
