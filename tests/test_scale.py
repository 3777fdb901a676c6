"""Work that must not repeat per expression, gather in one task or grow with all pairs; with the same rows."""

from pyspark.sql import functions as F

from vitaspark.operators import normalize as N
from vitaspark.operators.salvage import salvage_responses


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_incomplete_records_parse_a_response_once_and_after_the_spread(spark):
    rows = spark.createDataFrame([(1, '{"name":"A","skills":["Go","SQL"]}'), (2, None), (3, "no json")], "id LONG, response STRING").repartition(4, "id")
    found = N.completeness(N.normalize_responses(rows, keep=["id"])).filter(~F.col("is_valid")).select("id", "missing_fields")
    plan = _plan(found)
    assert plan.count("parse_json") == 1 or plan.count("parseJson") == 1
    assert plan.index("Filter") < plan.index("Repartition")
    assert dict(found.collect())[1].startswith("email, phone_number")
    assert found.count() == 3


def test_salvaged_responses_are_repaired_once(spark):
    rows = spark.createDataFrame([(1, '{"a":1,"b":2,"c":3,"d":4}'), (2, "none")], "id LONG, response STRING").repartition(4, "id")
    lost = salvage_responses(rows).filter("method = 'none'")
    plan = _plan(lost)
    assert plan.index("Filter") < plan.index("Repartition")
    assert [r["id"] for r in lost.collect()] == [2]


def _worth(rows, weights, boosts, best):
    """The scores of evidence rows by hand."""
    from collections import Counter, defaultdict

    from vitaspark.functions.lexicon import BM25_B, BM25_K1, TIE_BREAKER

    tf, value = Counter(), {}
    for doc, field, n, terms, v in rows:
        for t in terms:
            tf[doc, field, t, n] += 1
            if v is not None:
                value[doc, field, t, n] = max(v, value.get((doc, field, t, n), v))
    sums = defaultdict(lambda: [0.0, 0.0])
    for (doc, field, t, n), c in tf.items():
        for job, f, term, idf, avg, exact, near in weights:
            if (f, term) == (field, t):
                w = value.get((doc, field, t, n), idf * c * (BM25_K1 + 1) / (c + BM25_K1 * (1 - BM25_B + BM25_B * n / avg)))
                sums[doc, job, field][0] += w * exact
                sums[doc, job, field][1] += w * near
    parts = defaultdict(list)
    for (doc, job, field), (exact, near) in sums.items():
        parts[doc, job].append((boosts.get(field, 0.0) * exact, best.get(field, 0.0) * near))
    whole = {}
    for pair, found in parts.items():
        top = max(n for _, n in found)
        whole[pair] = (sum(e for e, _ in found) + top + (sum(n for _, n in found) - top) * TIE_BREAKER, len(found))
    return sums, whole


def test_pairs_are_scored_in_arrays_as_by_hand(spark, monkeypatch):
    import random

    from vitaspark.operators import lexical as L

    draw = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    rows = [(draw.choice([None, *range(25)]), f, n, [draw.choice(words) for _ in range(n)], None) for f in ("a", "b") for n in [draw.randint(1, 40) for _ in range(40)]]
    rows += [(draw.randrange(25), "vector", 1, [str(j)], draw.uniform(-1, 1)) for j in range(6) for _ in range(3)]
    weights = [(j, f, w, draw.random() + 0.1, 9.0, draw.random(), draw.random()) for f in ("a", "b") for w in words[:20] for j in range(6) if draw.random() < 0.4]
    shared = {(f, w): idf for _, f, w, idf, *_ in weights}
    weights = [(j, f, w, shared[f, w], a, e, n) for j, f, w, _, a, e, n in weights] + [(j, "vector", str(j), 1.0, 1.0, 1.0, 0.0) for j in range(6)]
    boosts, best = {"vector": 3.0, "a": 0.5}, {"a": 2.0, "b": 1.0}
    sums, whole = _worth(rows, weights, boosts, best)
    evidence = spark.createDataFrame(rows, "resume_id LONG, field STRING, len INT, terms ARRAY<STRING>, value DOUBLE")
    table = spark.createDataFrame(weights, "jd_id LONG, field STRING, term STRING, idf DOUBLE, avg_len DOUBLE, exact DOUBLE, near DOUBLE")
    for weights_held, tokens, products in ((4_000_000, 1_000_000, 2_000_000), (40, 30, 25)):
        monkeypatch.setattr(L, "MAX_WEIGHTS", weights_held)
        monkeypatch.setattr(L, "MAX_TOKENS", tokens)
        monkeypatch.setattr(L, "MAX_PRODUCTS", products)
        fields = {(r["resume_id"], r["jd_id"], r["field"]): (r["exact"], r["near"]) for r in L.field_scores(evidence, table).collect()}
        assert fields.keys() == sums.keys()
        assert all(abs(x - y) < 1e-9 for p in sums for x, y in zip(sums[p], fields[p]))
        pairs = L.pair_scores(evidence, table, boosts, best)
        got = {(r["resume_id"], r["jd_id"]): (r["raw_score"], r["fields"]) for r in pairs.collect()}
        assert got.keys() == whole.keys()
        assert all(abs(got[p][0] - whole[p][0]) < 2e-9 and got[p][1] == whole[p][1] for p in whole)
        cut = {(r["resume_id"], r["jd_id"]): r["raw_score"] for r in L.pair_scores(evidence, table, boosts, best, k=3).collect()}
        assert len(cut) < len(whole)
        for j in range(6):
            scores = sorted(((-got[p][0], p[0]) for p in got if p[1] == j and p[0] is not None))[:3]
            assert all(cut[d, j] == -s for s, d in scores)
        # pairs are neither shuffled nor aggregated
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        assert "Aggregate" not in plan and "hashpartitioning(resume_id" in plan
