"""Nulls, empty and very long texts, ties, repeated rows and empty tables, for every operator."""

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
import public_tokenizers

from vitaspark.llm import bpe, dart_minhash, decontaminate, exact_dedup, license_scan, quality, sharding, token_counts, toxicity, url_filter

LONG = "the quick brown fox jumps over lazy dogs and cats " * 30_000
ROWS = [
    (1, "one two three four five six seven"), (2, "one two three four five six seven"), (2, "one two three four five six seven"),
    (None, "One two three four five six SEVEN"), (None, None), (3, None, None, None), (4, ""), (5, "!!! ..."), (6, LONG), (7, "x" * 5000), (8, "Straße ÉTÉ 漢字 🙂"),
]


def run(name, docs, spark):
    labels = spark.sql("select * from values (1L, 1, 1), (1L, 1, 1), (4L, 0, 0), (6L, 1, 0), (null, 1, 1) t(doc_id, quality, toxic)")
    bench = spark.sql("select * from values (1L, 'one two three'), (1L, 'one two three'), (null, 'x'), (2L, null), (3L, '!!') t(item_id, text)")
    return {
        "shard": lambda: sharding.by_rows(docs),
        "license": lambda: license_scan.licenses(docs, license_scan.template_table(spark)),
        "tokens": lambda: token_counts.token_counts(docs, public_tokenizers.path("piece_bpe_32k.model")),
        "codec": lambda: bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json")),
        "quality": lambda: quality.quality(docs, labels),
        "bench": lambda: decontaminate.contamination(docs, bench),
        "exact": lambda: exact_dedup.exact_duplicates(docs),
        "near": lambda: dart_minhash.near_duplicates(docs),
        "toxic": lambda: toxicity.toxicity(docs, labels),
    }[name]()


PER_ROW = ["shard", "tokens", "codec", "quality", "bench", "exact", "near", "toxic"]


@pytest.mark.parametrize("name", [*PER_ROW, "license"])
def test_odd_rows(documents, shared, name):
    found = run(name, documents(ROWS), shared).collect()
    if name in PER_ROW:
        assert len(found) == len(ROWS)
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in found) == sorted((r[0] is None, r[0] or 0) for r in ROWS)
    by_id = {r.doc_id: r for r in found}
    if name == "exact":
        assert by_id[1].keep_id == 2 and by_id[1].group_size == 4 and not by_id[1].kept and by_id[2].kept
        assert by_id[4].keep_id == 4 and by_id[4].group_size == 3  # null is empty; of 3, 4 and a null id the largest stays
    if name == "near":
        assert by_id[1].class_id == 2 and by_id[1].class_size == 4
        assert by_id[4].kept and by_id[5].kept and by_id[3].class_size == 1
    if name == "bench":
        assert by_id[1].n_items == 1 and by_id[1].n_hit == 3 and by_id[1].contaminated
        assert (by_id[4].n_words, by_id[4].n_hit, by_id[4].contaminated) == (0, 0, False)
    if name == "tokens":
        assert by_id[4].n_tokens == 0 and by_id[6].over_limit
    if name == "shard":
        assert sorted(r.shard for r in found) == [i * 24 // len(ROWS) for i in range(len(ROWS))] and {r.slot for r in found} == {0}
    if name == "quality":
        assert by_id[4].perplexity is None and not by_id[4].kept and by_id[1].perplexity > 0
    if name == "license":
        assert not found


@pytest.mark.parametrize("name", [*PER_ROW, "license"])
def test_empty_table(documents, shared, name):
    assert run(name, documents([(1, "a")]).filter("doc_id < 0"), shared).count() == 0


def test_urls(shared):
    urls = [
        "https://www.Example.com/en/a?x", "https://sub.example.com/en/", "https://example.com/en", "http://other.com", "http://other.com/", "ftp://a.net/fr/x#y",
        "http://a.net/FR/", "no scheme", "", None, "http://notexample.com/en/", "http://net/es/", "http://" + "a." * 200 + "net/es/" + "b/" * 500, "http://a.net/es/", "http://a.net/es/",
    ]
    pages = shared.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").withColumns({"rule": F.lit("clash"), "suffix": F.lit("clash"), "digest": F.lit("clash")})
    rows = {r.page_id: r for r in url_filter.judge(pages, shared.sql(f"select * from {url_filter.RULES}")).collect()}
    assert len(rows) == len(urls)
    assert [rows[i].rule for i in range(len(urls))] == [
        "www.example.com/en/", "example.com/en/", "com/", None, "com/", "net/fr/", None, None, None, None, "com/", "net/es/", "net/es/", "net/es/", "net/es/",
    ]
    assert [rows[i].verdict for i in (0, 1, 3, 5, 9)] == ["allow", "block", "allow", "block", "allow"]
    assert url_filter.judge(pages.filter("page_id < 0"), shared.sql(f"select * from {url_filter.RULES}")).count() == 0
    assert url_filter.judge(pages, shared.sql(f"select * from {url_filter.RULES}").limit(0)).filter("rule is not null").count() == 0


def test_url_rules_end_inside_a_part(shared):
    pages = shared.createDataFrame([(1, "http://a.b.org/docs/en-us/x"), (2, "http://b.org/docs/fr"), (3, "http://b.org")], "page_id long, url string")
    rules = shared.createDataFrame([("b.org", "/docs/en", "block"), ("b.org", "", "allow"), ("a.b.org", "/docs/en-u", "allow")], "host string, path string, verdict string")
    assert {r.page_id: r.rule for r in url_filter.judge(pages, rules).collect()} == {1: "a.b.org/docs/en-u", 2: "b.org", 3: "b.org"}
