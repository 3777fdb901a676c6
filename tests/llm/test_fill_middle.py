"""Fill-in-the-middle rewriting against its definition, round trips and odd rows."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vitaspark.llm import fill_middle as fim

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plainly(text, doc_id):
    """(n, form, prefix, middle, output) as defined, on strings."""
    units = UNITS.findall(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


pieces = st.text(alphabet="ab <>SPM\t\n\x0b\x1c é漢🙂\x00", max_size=60)


@settings(max_examples=400, deadline=None)
@given(pieces, st.integers(0, 10_000))
def test_like_its_definition_and_back(text, doc_id):
    made = fim.rewrite(text.encode(), doc_id)
    assert (made.n, made.form, made.prefix_chars, made.middle_chars, made.output.decode()) == plainly(text, doc_id)
    assert fim.restore(made.output, made.form) == text.encode()


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=50), st.data())
def test_rotation_exchanges_blocks(raw, data):
    a, b, c = sorted(data.draw(st.integers(0, len(raw))) for _ in range(3))
    buffer = bytearray(raw)
    fim.rotate(buffer, a, b, c)
    assert bytes(buffer) == raw[:a] + raw[b:c] + raw[a:b] + raw[c:]


def test_blocks_longer_than_a_piece():
    raw = bytes(i % 251 for i in range(500_000))
    buffer = bytearray(raw)
    fim.rotate(buffer, 3, 200_001, 499_990)
    assert bytes(buffer) == raw[:3] + raw[200_001:499_990] + raw[3:200_001] + raw[499_990:]


LONG = "word and more \t words é " * 40_000
ROWS = [
    (1, "one two  three\n"), (1, "one two  three\n"), (2, None), (3, ""), (None, "a b c d e f g"), (None, None), (4, "has <S> inside"),
    (5, "   "), (6, LONG), (7, "x" * 100_000), (-8, "negative id here"), *[(i, f"some words of row {i} – and 漢字 🙂") for i in range(20, 120)],
]


def test_odd_rows(documents, shared):
    made = fim.fill_middle(documents(ROWS)).collect()
    want = [(i, *plainly(t or "", i)) for i, t in ROWS]
    key = lambda r: repr(tuple(r))
    assert sorted((tuple(r) for r in made), key=key) == sorted(want, key=key)
    assert {r.form for r in made} == {"plain", "psm", "spm"}
    back = fim.restored(fim.fill_middle(documents(ROWS))).collect()
    assert sorted(map(key, back)) == sorted(repr((i, t or "")) for i, t in ROWS)


def test_digests(documents, shared):
    found = {r.doc_id: r for r in fim.digests(documents(ROWS)).collect()}
    assert len(found) == len({i for i, _ in ROWS})
    for i, t in ROWS:
        if i is not None:
            n, form, p, m, output = plainly(t or "", i)
            r = found[i]
            assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, p, m)
            assert r.output_sha256 == hashlib.sha256(output.encode()).hexdigest()
            assert r.restored_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_empty_table(documents, shared):
    none = documents([(1, "a")]).filter("doc_id < 0")
    assert fim.fill_middle(none).count() == 0 and fim.digests(none).count() == 0 and fim.restored(fim.fill_middle(none)).count() == 0


def test_lost_sentinel_is_reported():
    with pytest.raises(ValueError):
        fim.restore(b"<P>a<S>b", "psm")
    assert fim.restore(b"<P>a<S>b", "plain") == b"<P>a<S>b"


def test_same_as_sql(shared):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    rows = [r for r in ROWS if r[0] != 6]
    con.executemany("insert into documents values (?, ?)", rows)
    want = con.execute(fim.SQL).fetchall()
    got = fim.digests(shared.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1))).collect()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got)
