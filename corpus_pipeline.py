"""The corpus pipeline: toxicity, exact copies, near copies, benchmark passages, encoding."""

from __future__ import annotations

import pandas as pd
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitaspark.llm import bpe, common, dart_minhash, decontaminate, exact_dedup, toxicity


def _without(docs: DataFrame, verdicts: DataFrame, mark: str, own: Column) -> DataFrame:
    """Documents but the rows not kept; a row is known by id and ``mark``, which ``own`` computes from the text. The side that travels is the rows to drop."""
    dropped = verdicts.filter("not kept").select(F.col("doc_id").alias("__id"), F.col(mark).alias("__mark")).distinct()
    marked = docs.withColumn("__own", own)
    return marked.join(dropped, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__mark")), "left_anti").drop("__own")


def _print(text: str) -> Column:
    """Fingerprint of the words. Built on each call: a typed function needs a session, which importing this module must not."""

    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series([dart_minhash.fingerprint(t) for t in common.as_bytes(texts)], dtype=object)

    return F.pandas_udf(prints, T.BinaryType())(F.col(text))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents predicted as toxic."""
    common.modest(spark)
    score = toxicity.scorer(spark, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return docs.withColumn("__score", score("text")).filter(F.col("__score") < toxicity.LEAST).drop("__score")


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the largest doc_id of each group of equal texts."""
    common.modest(spark)
    return _without(docs, exact_dedup.exact_duplicates(docs), "text_sha256", F.sha2(common.folded("text"), 256))


def dissimilar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the largest doc_id of each near-duplicate class."""
    common.modest(spark)
    return _without(docs, dart_minhash.near_classes(docs), "print", _print("text"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold benchmark passages."""
    common.modest(spark)
    find = decontaminate.finder(spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    found = docs.withColumn("__found", find(F.col("text")))
    foul = decontaminate.contaminated(F.col("__found.n_words"), decontaminate.words_hit(F.col("__found.spans")))
    return found.filter(~foul).drop("__found")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the decoded text, a row per document left."""
    common.modest(spark)
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", clean),
    ("exact_dedup", distinct),
    ("near_dedup", dissimilar),
    ("decontamination", decontaminated),
    ("bpe_encoding", encoded),
]

#: The first stage learns from labels, which SQL can't express; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a Parquet table in the shared folder, reread by the next stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
