"""Vector columns: repair, length, similarity, hashed text vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lexicon import EMBEDDING_DIM, EMBEDDING_DIMS


def as_doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(F.zip_with(left, right, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x * x))


def cosine(left: Column, right: Column) -> Column:
    """Cosine similarity, 0.0 when a vector is missing or all zero."""
    left, right = as_doubles(left), as_doubles(right)
    length = norm(left) * norm(right)
    return F.when(length > 0, dot(left, right) / length).otherwise(F.lit(0.0))


def unit(vector: Column) -> Column:
    vector = as_doubles(vector)
    size = norm(vector)
    return F.when(size > 0, F.transform(vector, lambda x: x / size)).otherwise(vector)


def is_usable(vector: Column) -> Column:
    """A vector that exists and is not all zero."""
    return F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def fit_length(vector: Column, dim: int = EMBEDDING_DIM) -> Column:
    """Cut a long vector, pad a short one with zeros."""
    size = F.size(vector)
    padded = F.concat(vector, F.array_repeat(F.lit(0.0).cast("float"), F.greatest(dim - size, F.lit(0))))
    return F.slice(padded, 1, dim)


def guarded_dim(requested: Column) -> Column:
    return F.when(requested.isin(*EMBEDDING_DIMS), requested).otherwise(F.lit(EMBEDDING_DIM))


def embed_hashed(df: DataFrame, text_col: str, out_col: str = "embedding", dim: int = EMBEDDING_DIM) -> DataFrame:
    """Default text-to-vector provider: unit-length feature hashing of word tokens.

    A model-backed provider takes its place by having the same signature. Only
    distinct texts need one; see :func:`vitaspark.operators.normalize.distinct_work`.
    """
    from pyspark.ml.feature import HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    from .text import tokens

    tmp = "__tok"
    with_tokens = df.withColumn(tmp, tokens(F.col(text_col)))
    counted = HashingTF(inputCol=tmp, outputCol="__tf", numFeatures=dim).transform(with_tokens)
    scaled = Normalizer(inputCol="__tf", outputCol="__unit", p=2.0).transform(counted)
    return scaled.withColumn(out_col, vector_to_array("__unit", "float32")).drop(tmp, "__tf", "__unit")
