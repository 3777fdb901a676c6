"""Methods against brute force, the tokenizer libraries and held-out labels."""

import hashlib
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from vitaspark.llm import bpe, dart_minhash, decontaminate, exact_dedup, license_scan, quality, sharding, token_counts, toxicity
from vitaspark.llm.common import word_hashes
from vitaspark.llm.graph import connected

SF = "/root/testdata/sf0.001"
supplied = pytest.mark.skipif(not os.path.isdir(SF), reason="supplied tables are not here")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, size=5):
    w = WORD.findall(lower(text))
    return Counter(tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))) if w else Counter()


def similarity(a, b):
    low = sum((a & b).values())
    both = sum(a.values()) + sum(b.values()) - low
    return low / both if both else 0.0


def classes(rows, least=0.8):
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if similarity(sets[i], sets[j]) >= least:
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        groups[find(i)].append(d)
    return {d: max(g) for g in groups.values() for d in g}


def test_word_hashes_follow_words():
    texts = ["Ab cd AB", "", "é-É x1", "cd", "a" * 50]
    by_word, got = defaultdict(set), []
    for found, doc in word_hashes([t.encode() for t in texts]):
        got += list(zip(doc.tolist(), found.tolist(), strict=True))
    want = [(i, w) for i, t in enumerate(texts) for w in WORD.findall(lower(t))]
    assert [d for d, _ in got] == [d for d, _ in want]
    for (_, h), (_, w) in zip(got, want, strict=True):
        by_word[w].add(h)
    assert all(len(v) == 1 for v in by_word.values()) and len({h for v in by_word.values() for h in v}) == len(by_word)


def test_darts_estimate_weighted_jaccard():
    rng = np.random.default_rng(3)
    k, n = 1024, 60
    element = np.arange(1, n + 1, dtype=np.uint64)
    a, b = rng.integers(1, 6, n).astype(float), rng.integers(1, 6, n) * rng.choice([0.5, 1.0, 1.5], n)
    signature = dart_minhash.darts(np.tile(element, 2), np.concatenate([a, b]), np.repeat([0, 1], n), 2, k)
    assert (signature != 0).all()
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((signature[0] == signature[1]).mean() - want) < 4 * np.sqrt(want * (1 - want) / k)
    alone = dart_minhash.darts(element, a, np.zeros(n, int), 1, k)
    assert (alone[0] == signature[0]).all()  # a signature doesn't depend on its neighbours


def edited(words, k, rng):
    out = list(words)
    for i in rng.sample(range(len(out)), k):
        out[i] = f"new{rng.random()}"
    return " ".join(out)


def test_near_duplicates_by_brute_force(documents, shared):
    rng = random.Random(5)
    rows, vocabulary = [], [f"w{i}" for i in range(400)]
    for g in range(12):
        base = rng.choices(vocabulary, k=150)
        rows += [(len(rows) + i, edited(base, rng.choice([0, 1, 2, 3, 4, 6, 9]), rng)) for i in range(8)]
    chain = rng.choices(vocabulary, k=120)
    for _ in range(6):  # neighbours are similar, ends are not
        rows.append((len(rows), " ".join(chain)))
        chain = chain[4:] + rng.choices(vocabulary, k=4)
    rows += [(len(rows) + i, "again and again the same line. " * n) for i, n in enumerate((20, 21, 40))]
    got = {r.doc_id: r.class_id for r in dart_minhash.near_duplicates(documents(rows)).collect()}
    assert got == classes(rows)


def test_near_duplicates_in_a_large_family(documents, shared, monkeypatch):
    """Texts about 0.7 alike share large buckets; pairs of 0.8 to 0.85 among them are all found, within and across chunks."""
    draw = random.Random(17)
    word = lambda: "".join(draw.choices("abcdefghijklmnop", k=7))
    frame, texts = [word() for _ in range(140)], []
    for _ in range(200):
        common, own = [word() for _ in range(14)], [[word() for _ in range(14)] for _ in range(2)]
        texts += [" ".join(frame + common + o) for o in own]
    raw = [t.encode() for t in texts]
    pairs = [(i, j) for i in range(len(raw)) for j in range(i)]
    alike = dart_minhash.similarities([raw[i] for i, _ in pairs], [raw[j] for _, j in pairs])
    links = [(i, j) for (i, j), value in zip(pairs, alike, strict=True) if value >= 0.8]
    assert len(links) == 200 and np.median(alike) > 0.65
    wanted = {i: i for i in range(len(texts))} | {j: i for i, j in links}
    monkeypatch.setattr(dart_minhash, "CHUNK", 100, raising=False)
    got = {r.doc_id: r.class_id for r in dart_minhash.near_duplicates(documents(list(enumerate(texts))), bands=12, rows=1).collect()}
    assert got == wanted


def test_cross_links_in_a_bucket_are_found(documents, shared):
    """One band of one row: hubs alone would miss links that the second pass finds."""
    rng = random.Random(8)
    base = rng.choices([f"v{i}" for i in range(300)], k=200)
    far = edited(base[:100], 0, rng).split() + rng.choices([f"z{i}" for i in range(300)], k=100)
    rows = [(i, edited(base, 2, rng)) for i in range(6)] + [(10 + i, edited(far, 2, rng)) for i in range(6)]
    got = {r.doc_id: r.class_id for r in dart_minhash.near_duplicates(documents(rows), bands=60, rows=1).collect()}
    assert got == classes(rows)


def test_darts_of_many_short_texts_take_bounded_memory():
    """Short texts take as many cells as long ones: thrown at once, these took over 500 MB."""
    import tracemalloc

    texts = [f"w{i}".encode() for i in range(6000)] + [" ".join(f"x{i}" for i in range(3000)).encode(), b"a b c"]
    (element, count, doc), = dart_minhash.shingle_counts(texts)
    tracemalloc.start()
    got = dart_minhash.signatures(element, count.astype(float), doc, len(texts), 192)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100e6
    for low, high in ((0, 40), (5990, len(texts))):
        part = slice(*np.searchsorted(doc, (low, high)))
        assert (got[low:high] == dart_minhash.darts(element[part], count[part].astype(float), doc[part] - low, high - low, 192)).all()


def test_ties_connect_what_hub_links_connect(documents, shared, monkeypatch):
    """A family meets in every bucket with several hubs; about one pair a member goes to the search for components."""
    rng, seen = random.Random(31), []
    base = rng.choices([f"v{i}" for i in range(500)], k=300)
    rows = [(i, edited(base, 1, rng)) for i in range(60)]
    real = dart_minhash.connected
    monkeypatch.setattr(dart_minhash, "connected", lambda links: seen.append(links.count()) or real(links))
    got = {r.doc_id: r.class_id for r in dart_minhash.near_duplicates(documents(rows)).collect()}
    assert got == classes(rows) and seen and max(seen) < 2 * 60


def test_stages_drop_rows_and_not_ids(documents, shared):
    """A copy is dropped though its id, or null id, also names a text that stays."""
    import corpus_pipeline

    rows = [(7, "a a"), (9, "A a"), (7, "b"), (None, "a a"), (None, "c")]
    assert {(r.doc_id, r.text) for r in corpus_pipeline.distinct(shared, documents(rows), "").collect()} == {(9, "A a"), (7, "b"), (None, "c")}
    base = " ".join(f"w{i}" for i in range(120))
    rows = [(7, base), (9, base + " end"), (7, "b"), (None, base + " last"), (None, "c"), (None, None)]
    kept = {(9, base + " end"), (7, "b"), (None, "c"), (None, None)}
    assert {(r.doc_id, r.text) for r in corpus_pipeline.dissimilar(shared, documents(rows), "").collect()} == kept


def test_connected(shared):
    links = shared.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (102, 101)], "a long, b long")
    got = {r.node: r.label for r in connected(links).collect()}
    assert got == {**dict.fromkeys(range(31), 0), 100: 100, 101: 100, 102: 100}


@given(st.lists(st.integers(0, 50), min_size=1, max_size=64), st.integers(1, 200))
@settings(max_examples=60, deadline=None)
def test_directory(load, capacity):
    load = np.array(load + [0] * (64 - len(load)))
    depth, slots = exact_dedup.directory(load, capacity)
    assert len(slots) == 1 << depth
    fine = np.repeat(slots, 64 >> depth)
    for bucket in np.unique(slots):
        inside = np.flatnonzero(fine == bucket)
        assert (np.diff(inside) == 1).all() and len(inside) & (len(inside) - 1) == 0
        assert load[inside].sum() <= capacity or len(inside) == 1


def test_exact_duplicates_split_and_chain(documents, shared):
    rng = random.Random(2)
    rows = [(i, f"Text {rng.randrange(60)}") for i in range(400)]
    groups = defaultdict(list)
    for d, t in rows:
        groups[lower(t)].append(d)
    for capacity in (None, 1, 40):
        got = {r.doc_id: r for r in exact_dedup.exact_duplicates(documents(rows), capacity).collect()}
        for t, ids in groups.items():
            for d in ids:
                assert (got[d].keep_id, got[d].group_size, got[d].kept) == (max(ids), len(ids), d == max(ids))
                assert got[d].text_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_chain_compares_bytes():
    import pandas as pd

    batch = pd.DataFrame({"bucket": [0] * 4, "key": [7, 7, 7, 8], "text": [b"a", b"b", b"a", b"a"], "top": pd.array([1, 2, 3, 4], "Int64"), "n": [1, 1, 2, 1]})
    rows = [tuple(r) for f in exact_dedup._chain(iter([batch])) for r in f[["key", "keep_id", "group_size"]].itertuples(index=False)]
    assert rows == [(7, 3, 3), (7, 2, 1), (8, 4, 1)]


def brute_hits(text, items, size=13):
    w = WORD.findall(lower(text))
    hit, held = set(), set()
    for item, t in items:
        iw = WORD.findall(lower(t))
        for i in range(max(1, len(iw) - size + 1) if iw else 0):
            win = iw[i:i + size]
            for j in range(len(w) - len(win) + 1):
                if w[j:j + len(win)] == win:
                    hit |= set(range(j, j + len(win)))
                    held.add(str(item))
    return len(w), len(hit), len(held), decontaminate.items_digest(list(held))


@pytest.mark.parametrize("table_bytes", [1 << 20, 60])
def test_decontamination_by_brute_force(documents, shared, table_bytes):
    rng = random.Random(4)
    vocabulary = ["a", "b", "ab", "ba", "é", "the", "of", "x1"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 5, 12, 13, 14, 30])))) for i in range(25)]
    rows = []
    for i in range(60):
        words = rng.choices(vocabulary + [f"u{j}" for j in range(20)], k=rng.choice([0, 1, 20, 80]))
        for _, t in rng.sample(items, 2):
            if rng.random() < 0.6:
                words += t.upper().split() if rng.random() < 0.3 else t.split()
        rows.append((i, ", ".join(words)))
    bench = shared.createDataFrame(items, "item_id long, text string").repartition(3)
    for r in decontaminate.contamination(documents(rows), bench, table_bytes=table_bytes).collect():
        want = brute_hits(dict(rows)[r.doc_id], items)
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == want
        assert r.contaminated == (want[1] > 0 and 20 * want[1] >= want[0])


def test_passages_without_an_item_id_as_in_sql(documents, shared):
    import duckdb

    rows = [(1, "u one two three"), (2, "u four five v"), (3, "one two three, four five"), (4, "six"), (5, None)]
    bench = shared.createDataFrame([(7, "one two three"), (None, "four five"), (None, "three four"), (None, None)], "item_id long, text string")
    got = sorted(tuple(r) for r in decontaminate.contamination(documents(rows), bench).collect())
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar); create table benchmark (item_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    con.executemany("insert into benchmark values (?, ?)", [tuple(r) for r in bench.collect()])
    assert got == sorted(con.execute(decontaminate.SQL).fetchall())
    assert [r[2] for r in got] == [3, 2, 5, 0, 0]


@given(st.lists(st.text("ab", min_size=1, max_size=6), min_size=1, max_size=8), st.text("ab", max_size=60))
@settings(max_examples=200, deadline=None)
def test_wu_manber(strings, text):
    strings, text = sorted({s.encode() for s in strings}), text.encode()
    got = sorted(decontaminate.WuManber(strings).search(text))
    assert got == sorted((i, s) for s in strings for i in range(len(text) - len(s) + 1) if text.startswith(s, i))


MIXED = st.text(st.one_of(st.characters(codec="utf-8", exclude_characters="\x00"), st.sampled_from(" \n\tthe'sA1é漢"))) | st.sampled_from(["a<|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x", "don't  stop\n\n "])


@pytest.fixture(scope="module")
def codec():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return bpe.ByteBPE(f.read())


@given(text=MIXED)
@settings(max_examples=400, deadline=None)
def test_encode_as_library(codec, text):
    from tokenizers import Tokenizer

    library = _library.setdefault("byte", None) or _library.setdefault("b", Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
    ids = codec.encode(text)
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert codec.decode(ids) == text == library.decode(ids, skip_special_tokens=False)


_library: dict = {}


@given(text=MIXED)
@settings(max_examples=400, deadline=None)
def test_counts_as_library(text):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    if "piece" not in _library:
        _library["piece"] = sentencepiece.SentencePieceProcessor(model_file=path), token_counts.Counter(token_counts.Vocabulary(token_counts.load_pieces(path)))
    library, counter = _library["piece"]
    assert counter.count(text) == len(library.encode(text))


def test_encode_decode_tables(documents, shared):
    rows = [(1, "Hello, wörld <|endoftext|>!"), (2, None), (3, "")]
    path = public_tokenizers.path("byte_bpe_50k.json")
    ids = bpe.encode(documents(rows), path)
    assert {r.doc_id: r.text for r in bpe.decode(ids, path).collect()} == {1: rows[0][1], 2: "", 3: ""}


def test_merge_skips_stale_candidates():
    ranks = {("a", "b"): 0, ("b", "c"): 1, ("ab", "c"): 2, ("abc", "abc"): 3}
    assert bpe.merge(list("abcabcab"), lambda a, b: ranks.get((a, b))) == ["abcabc", "ab"]


def test_kneser_ney_sums_to_one(documents, shared):
    model = quality.fit(documents([(1, "the cat sat on the mat"), (2, "a cat and a dog"), (3, "Über 12 cats!")]))
    p = np.exp(-quality.Model(model.parts).surprise().astype(float)).reshape(-1, quality.SYMBOLS)
    assert np.allclose(p.sum(axis=1), 1, atol=1e-4)


def brute_kn(texts):
    """Interpolated modified Kneser-Ney by its definition, over class tuples."""
    grams = Counter()
    for t in texts:
        c = [0] * 3 + [int(x) for x in quality.CLASS[np.frombuffer(t.encode(), np.uint8)]] + [0]
        grams.update(tuple(c[i:i + 4]) for i in range(len(c) - 3))
    tables = {4: grams}
    for n in (3, 2, 1):
        tables[n] = Counter(g[1:] for g in tables[n + 1])

    def discount(n):
        nn = [sum(1 for v in tables[n].values() if v == i) for i in range(5)]
        y = nn[1] / (nn[1] + 2 * nn[2]) if nn[1] else 0.5
        d = [0.0]
        for i in (1, 2, 3):
            d.append(min(max(i - (i + 1) * y * nn[i + 1] / nn[i], 0.0), i) if nn[i] and nn[i + 1] else min(0.5 * i, i - 0.5))
        return lambda c: d[min(c, 3)]

    ds = {n: discount(n) for n in tables}

    def p(g):
        n = len(g)
        if n == 0:
            return 1 / quality.SYMBOLS
        inside = {k: v for k, v in tables[n].items() if k[:-1] == g[:-1]}
        total = sum(inside.values())
        if not total:
            return p(g[1:])
        rest = sum(ds[n](v) for v in inside.values())
        c = tables[n].get(g, 0)
        return max(c - ds[n](c), 0) / total + rest / total * p(g[1:])

    return p


def test_perplexity_by_brute_force(documents, shared):
    rows = [(1, "the cat sat"), (2, "a cat and the dog"), (3, "zz 9!")]
    p = brute_kn([t for _, t in rows[:2]])
    model = quality.fit(documents(rows[:2]))
    for r in quality.perplexities(documents(rows), model).collect():
        c = [0] * 3 + [int(x) for x in quality.CLASS[np.frombuffer(dict(rows)[r.doc_id].encode(), np.uint8)]] + [0]
        want = np.exp(-np.mean([np.log(p(tuple(c[i:i + 4]))) for i in range(len(c) - 3)]))
        assert abs(r.perplexity - want) < 1e-3 * want


def test_perplexity_comes_from_sharded_joins(documents, shared, monkeypatch):
    draw = random.Random(6)
    texts = ["".join(draw.choice("abc dÉ9Ж\n") for _ in range(draw.randrange(1, 120))) for _ in range(40)] + ["zq" * 300, "", None]
    rows = [*enumerate(texts), (None, texts[0]), (None, None), (7, texts[7])]
    docs, trusted = documents(rows), documents(rows[:20])

    def refuse(*_, **__):
        raise AssertionError("the model leaves its shards")

    with monkeypatch.context() as m:
        m.setattr(quality, "ASK_BYTES", 500, raising=False)  # many blocks
        m.setattr(type(docs), "toPandas", refuse)
        m.setattr(type(shared.sparkContext), "broadcast", refuse)
        model = quality.fit(trusted)
        found = [(r.doc_id, r.n_symbols, r.perplexity) for r in quality.perplexities(docs, model).collect()]
    surprise = model.surprise().astype(float)

    def perplexity(text):
        c = [0] * 3 + [int(x) for x in quality.CLASS[np.frombuffer(text.encode(), np.uint8)]] + [0]
        return np.exp(np.mean([surprise[a << 18 | b << 12 | d << 6 | e] for a, b, d, e in zip(c, c[1:], c[2:], c[3:])]))

    want = [(i, len((t or "").encode()), perplexity(t) if t else None) for i, t in rows]
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    for a, b in zip(sorted(found, key=order), sorted(want, key=order), strict=True):
        assert a[:2] == b[:2] and (a[2] is None if b[2] is None else abs(a[2] - b[2]) < 1e-9 * b[2])


def test_joined_probabilities_equal_the_dense_table(documents, shared):
    model = quality.fit(documents([(1, "the cat sat on the mat"), (2, "a cat and a dog"), (3, "Über 12 cats!")]))
    codes = shared.range(0, 1 << 24, 1009).withColumnRenamed("id", "code").union(model.parts[-1][0].select("code"))
    got = quality.probabilities(codes, model).toPandas()
    assert len(got) == got["code"].nunique() == codes.distinct().count()
    assert np.array_equal(quality._surprise(got["p"].to_numpy()), model.surprise()[got["code"].to_numpy()])
    nothing = quality.fit(documents([(1, None), (2, "")]))
    assert [round(r.perplexity, 4) for r in quality.perplexities(documents([(1, "any text")]), nothing).collect()] == [quality.SYMBOLS]


def test_quality_tells_characters_apart(documents, shared):
    good = ["THE CAT SAT ON THE MAT", "ДОМ И САД", "今日は良い天気です"]
    bad = ["XQZ JKW VZX QJ KVW ZQX", "ЖЭЩ Ъ ФЫЮ", "鬱蠍は鮭い麒麟です"]  # the same classes of bytes
    rows = [(10 * i + j, t, f"l{i}") for i, t in enumerate(good) for j in range(3)] + [(90 + i, t, f"l{i}") for i, t in enumerate(bad)]
    labels = shared.createDataFrame([(10 * i + j, 1) for i in range(3) for j in range(3)], "doc_id long, quality int")
    docs = shared.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in quality.quality(docs, labels).collect()}
    assert len(found) == len(rows)
    for i, t in enumerate(bad):
        assert [len(t)] * 2 == [found[90 + i].n_symbols, found[10 * i].n_symbols]
        assert found[90 + i].perplexity > 2 * found[10 * i].perplexity
        assert found[10 * i].kept and not found[90 + i].kept


def test_perplexity_of_characters_by_brute_force(documents, shared, monkeypatch):
    texts = ["the Cat sat\non", "a cAt and the dog", "x", "", None, "zz 9!" * 9, "Жг 漢字🙂\0"]
    rows = [*enumerate(texts), (None, texts[0])]
    trusted = [*texts[:2], texts[6]]
    model = quality.fit(documents(list(enumerate(trusted))), alphabet=quality.Characters)
    with monkeypatch.context() as m:
        m.setattr(quality, "ASK_BYTES", 20)  # many blocks
        found = quality.perplexities(documents(rows), model).collect()
    # byte 128 and up stand for the characters beyond ASCII
    beyond = {c: chr(128 + i) for i, c in enumerate("Жг漢字🙂")}
    spelled = lambda t: "".join(beyond.get(c, c) for c in t)

    class Latin(str):
        def encode(self):
            return super().encode("latin-1")

    monkeypatch.setattr(quality, "CLASS", np.arange(1, 257))
    monkeypatch.setattr(quality, "SYMBOLS", quality.Characters.symbols)
    p, by_id = brute_kn([Latin(spelled(t)) for t in trusted]), dict(rows)
    assert len(found) == len(rows)
    for r in found:
        text = by_id[r.doc_id] or ""
        c = [0] * 3 + [ord(x) + 1 for x in spelled(text)] + [0]
        want = np.exp(-np.mean([np.log(p(tuple(c[i:i + 4]))) for i in range(len(c) - 3)]))
        assert r.n_symbols == len(text)
        assert r.perplexity is None if not text else abs(r.perplexity - want) < 1e-3 * want


def test_counts_handed_on_in_parts_add_up(documents, shared, monkeypatch):
    draw = random.Random(8)
    texts = ["".join(draw.choice("abcdeЖ漢 ") for _ in range(draw.randrange(1, 300))) for _ in range(20)]
    want = Counter()
    for t in texts:
        c = [0] * 3 + [ord(x) + 1 for x in t] + [0]
        want.update(tuple(c[i:i + 4]) for i in range(len(c) - 3))
    monkeypatch.setattr(quality, "BLOCK", 64)
    monkeypatch.setattr(quality, "HELD", 50)
    got, parts = Counter(), 0
    for high, low, n in quality._counted(([t.encode()] for t in texts), quality.Characters):
        parts += 1
        for gram, k in zip(np.stack(quality._symbols(high, low), axis=1).tolist(), n.tolist()):
            got[tuple(gram)] += k
        back = quality.Characters.unpacked(quality.Characters.packed(high, low))
        assert np.array_equal(back[0], high) and np.array_equal(back[1], low)
    assert got == want and parts > 1


def test_shards_match_the_mixture(documents, shared):
    rows = [(i, "x" * (i % 7), "en", "big" if i % 3 else f"s{i % 5}") for i in range(1000)]
    got = sharding.shard(documents(rows)).collect()
    sizes, sources = Counter(r.shard for r in got), Counter((r.shard, r.source) for r in got)
    assert set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in {r[3] for r in rows}:
        per = [sources[i, s] for i in range(24)]
        share = sum(per) / 24
        assert all(abs(n - share) <= 1 + len({r[3] for r in rows}) / 2 for n in per)
    for i in range(24):
        assert sorted(r.slot for r in got if r.shard == i) == list(range(sizes[i]))


def test_license_places(documents, shared):
    notice = "This work is licensed under the GNU General Public License, version 3."
    rows = [
        (1, "Intro. " + notice + " text between these " * 20 + notice), (2, "Released   under the\nMIT-License"), (3, "released under the mit"),
        (4, "this work is licensed under the great gnu general public license version 3"), (5, "Licensed under the Apache License Version 2.0. " * 3),
    ]
    got = defaultdict(list)
    for r in license_scan.license_matches(documents(rows), license_scan.template_table(shared)).collect():
        got[r.doc_id, r.license].append((r.first_word, r.containment))
    assert sorted(got[1, "GPL-3.0"]) == [(1, 1.0), (73, 1.0)]
    assert got[2, "MIT"] == [(0, 1.0)] and (3, "MIT") not in got
    assert got[4, "GPL-3.0"][0][1] == 0.8 and len(got[5, "Apache-2.0"]) == 3


@supplied
def test_toxicity_held_out(shared):
    sf = "/root/testdata/sf0.01"
    docs, labels = (shared.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    found = toxicity.toxicity(docs, labels)
    rows = found.join(labels, "doc_id").filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    english = [r for r in rows if r.lang == "en"]
    assert sum(r.predicted == r.toxic for r in english) / len(english) > 0.95
    assert sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.9
    assert not [r for r in rows if r.predicted and not r.toxic]


def test_pu_fit_learns_from_unlabelled():
    rng = np.random.default_rng(1)
    vocabulary = np.arange(1, 4, dtype=np.uint64)
    toxic = lambda: np.array([1, 3] if rng.random() < 0.5 else [1], np.uint64)
    clean = lambda: np.array([3] if rng.random() < 0.5 else [], np.uint64)
    rows = [(toxic(), True) for _ in range(100)] + [(toxic() if rng.random() < 0.2 else clean(), False) for _ in range(500)]
    w, b = toxicity.fit(rows, vocabulary, 0.2, 1)
    assert w[0] + b > 0 > w[2] + b and b < 0
