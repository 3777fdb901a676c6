"""Toxicity by non-negative positive-unlabelled learning."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitaspark.llm.common import BLOCK, Words, as_bytes, blocks, id_crc, mix, pieces, saved

#: Bounds of the fitting sample, of the features kept and the classifiers averaged.
POSITIVES, UNLABELLED, FEATURES, MEMBERS = 6_000, 18_000, 4_096, 3
#: Leading bytes of a word that count as features beside the whole word.
PREFIXES = (4, 5, 6, 7)
#: A feature is kept if it stands in this many toxic sample documents and differs from chance by so many deviations.
SUPPORT, DEVIATIONS = 5, 5.0
#: Score from which a document counts as toxic.
LEAST = 0.5
EPOCHS, RATE, DECAY = 300, 0.05, 1e-4


def features(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per block: (feature hash, index of the text), a row per word and per prefix of a longer word."""
    for raw, ends, first in blocks(texts):
        whole = len(ends) > 1 or len(raw) <= BLOCK
        for part in [raw] if whole else pieces(raw):
            words = Words(part)
            doc = first + (np.searchsorted(ends, words.starts, "right") if whole else np.zeros(len(words.starts), np.int64))
            size = words.ends - words.starts
            found, whose = [words.hashes()], [doc]
            for n in PREFIXES:
                longer = size > n
                found.append(mix(words.hashes(n)[longer] + np.uint64(n)))
                whose.append(doc[longer])
            yield np.concatenate(found), np.concatenate(whose)


def _distinct(texts: list[bytes]) -> list[np.ndarray]:
    out = [[] for _ in texts]
    for found, doc in features(texts):
        order = np.argsort(doc, kind="stable")
        at = np.flatnonzero(np.diff(doc[order])) + 1
        for part, i in zip(np.split(found[order], at), doc[order][np.concatenate([[0], at])] if len(doc) else [], strict=False):
            out[i].append(np.unique(part))
    return [np.unique(np.concatenate(x)) if x else np.zeros(0, np.uint64) for x in out]


def sample(docs: DataFrame, labels: DataFrame, positives: int, unlabelled: int, folds: int, held: int) -> tuple[DataFrame, float]:
    """(text, positive) rows for fitting, and the class prior.

    Rows of the held-out fold never enter. The prior is the toxic share of the
    labelled rows. Both samples are drawn by a hash of the id, about
    ``positives`` and ``unlabelled`` rows at most. Unlabelled text is drawn from
    all documents, so it follows the population, labelled rows unmarked among it.
    """
    known = labels.filter(id_crc("doc_id") % folds != held).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, toxic = known.agg(F.count("toxic"), F.sum("toxic")).first()
    prior = (toxic or 0) / n if n else 0.0
    rest = docs.filter(id_crc("doc_id") % folds != held).select("doc_id", "text")
    spread = (F.crc32(F.concat(F.lit("draw:"), F.col("doc_id").cast("string")).cast("binary")) / F.lit(2.0**32))
    chosen_pos = known.filter("toxic = 1").filter(spread < F.lit(positives / max(toxic or 0, 1))).select("doc_id")
    free = rest.filter(spread < F.lit(unlabelled / max(rest.count(), 1))).withColumn("positive", F.lit(False))
    # about ``positives`` ids at most, so they travel and no text does
    pos = rest.join(F.broadcast(chosen_pos), "doc_id", "left_semi").withColumn("positive", F.lit(True))
    return pos.unionByName(free), prior


def fit(rows: list[tuple[np.ndarray, bool]], vocabulary: np.ndarray, prior: float, seed: int) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear classifier under the non-negative PU risk.

    Risk: prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))
    with the logistic loss. Where the second part falls below zero the step goes
    against it instead, which keeps the fit from memorising the positives.
    """
    rng = np.random.default_rng(seed)
    take = rng.random(len(rows)) < 0.8
    x = [np.searchsorted(vocabulary, f) for (f, _), t in zip(rows, take, strict=True) if t]
    y = np.array([p for (_, p), t in zip(rows, take, strict=True) if t], bool)
    doc = np.repeat(np.arange(len(x)), [len(i) for i in x])
    col = np.concatenate(x) if x else np.zeros(0, np.int64)
    n, d = len(x), len(vocabulary)
    w, b = np.zeros(d), 0.0
    m, v = np.zeros(d + 1), np.zeros(d + 1)
    pos, unl = y / max(y.sum(), 1), ~y / max((~y).sum(), 1)
    for step in range(1, EPOCHS + 1):
        z = np.bincount(doc, w[col], n) + b
        up, down = 1 / (1 + np.exp(-np.clip(z, -50, 50))), 1 / (1 + np.exp(np.clip(z, -50, 50)))
        loss_minus = np.logaddexp(0, z)
        negative = (unl * loss_minus).sum() - prior * (pos * loss_minus).sum()
        slope_plus, slope_minus = -prior * pos * down, (unl - prior * pos) * up
        g = slope_plus + slope_minus if negative >= 0 else -slope_minus
        grad = np.append(np.bincount(col, g[doc], d) + DECAY * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, b


class Model:
    """Feature hashes in order, a weight row per member, and biases. At most FEATURES x MEMBERS numbers."""

    def __init__(self, vocabulary: np.ndarray, weights: np.ndarray, biases: np.ndarray):
        self.vocabulary, self.weights, self.biases = vocabulary, weights, biases
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(vocabulary >> np.uint64(44)).astype(np.int64)] = True

    def scores(self, texts: list[bytes]) -> np.ndarray:
        hits = []
        for found, doc in features(texts):
            near = np.flatnonzero(self.seen[(found >> np.uint64(44)).astype(np.int64)])
            found, doc = found[near], doc[near]
            at = np.minimum(np.searchsorted(self.vocabulary, found), max(len(self.vocabulary) - 1, 0))
            same = self.vocabulary[at] == found if len(self.vocabulary) else np.zeros(len(found), bool)
            hits.append(np.unique(doc[same] * (len(self.vocabulary) + 1) + at[same]))
        cells = np.unique(np.concatenate(hits)) if hits else np.zeros(0, np.int64)
        doc, col = cells // (len(self.vocabulary) + 1), cells % (len(self.vocabulary) + 1)
        z = np.stack([np.bincount(doc, w[col], len(texts)) + b for w, b in zip(self.weights, self.biases, strict=True)])
        return (1 / (1 + np.exp(-np.clip(z, -50, 50)))).mean(axis=0)


def train(
    docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, keep: int = FEATURES,
    members: int = MEMBERS, folds: int = 5, held: int = 0,
) -> Model:
    """Fit the classifiers, one task each, on a bounded sample of whole texts.

    Without a confirmed toxic row, or without features, every score is the prior.
    """
    rows, prior = sample(docs, labels.select("doc_id", "toxic"), positives, unlabelled, folds, held)

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"positive": batch["positive"], "features": [f.view(np.int64) for f in _distinct(as_bytes(batch["text"]))]})

    found = saved(rows.select("text", "positive").mapInPandas(extract, "positive boolean, features array<long>"), "toxic-sample")
    n_pos, n_free = found.agg(F.count_if("positive"), F.count_if(~F.col("positive"))).first()
    flat = [np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))]
    if not n_pos or not n_free:
        return Model(np.zeros(0, np.uint64), np.zeros((1, 1)), np.array(flat))
    p, u = F.col("p") / F.lit(n_pos), F.col("u") / F.lit(n_free)
    share = (F.col("p") + F.col("u")) / F.lit(n_pos + n_free)
    deviation = (p - u) / F.sqrt(share * (1 - share) * F.lit(1 / n_pos + 1 / n_free) + F.lit(1e-12))
    table = (
        found.select("positive", F.explode("features").alias("feature"))
        .groupBy("feature").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("u"))
        .filter((F.col("p") >= SUPPORT) & (deviation > DEVIATIONS))
        .orderBy(deviation.desc(), "feature").limit(keep).select("feature")
    )
    vocabulary = np.sort(np.array([r["feature"] for r in table.collect()], np.int64).view(np.uint64))
    if not len(vocabulary):
        return Model(vocabulary, np.zeros((1, 1)), np.array(flat))
    known = vocabulary.view(np.int64)

    def member(group: pd.DataFrame) -> pd.DataFrame:
        inside = [np.intersect1d(np.asarray(f, np.int64).view(np.uint64), vocabulary) for f in group["features"]]
        seed = int(group["member"].iloc[0])
        w, b = fit(list(zip(inside, group["positive"], strict=True)), vocabulary, prior, seed)
        return pd.DataFrame({"member": [seed], "weights": [w], "bias": [b]})

    narrow = F.filter("features", lambda f: f.isin([int(k) for k in known]))
    fitted = (
        found.select("positive", narrow.alias("features"), F.explode(F.sequence(F.lit(1), F.lit(members))).alias("member"))
        .groupBy("member").applyInPandas(member, "member int, weights array<double>, bias double").orderBy("member").collect()
    )
    return Model(vocabulary, np.array([r["weights"] for r in fitted]), np.array([r["bias"] for r in fitted]))


def scorer(spark: SparkSession, model: Model) -> Callable[[str], Column]:
    """A column function of the text: the mean score of the classifiers, 0 to 1. Other columns stay where they are."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for text in texts:
            yield pd.Series(shared.value.scores(as_bytes(text)))

    return score


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, **bounds: int) -> DataFrame:
    """(doc_id, held_out, score, predicted): a row per document.

    Only text is an input of a score. Null and empty texts get the score of a
    text without features. A null id counts as the empty text in the fold rule.
    """
    score = scorer(docs.sparkSession, train(docs, labels, folds=folds, held=held, **bounds))
    held_out = F.coalesce(id_crc("doc_id"), F.lit(0)) % folds == held
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), score("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= LEAST).cast("int"))
