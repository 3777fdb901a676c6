"""Exact cosine top-k of many candidates for many jobs."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import is_usable

# The task functions travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Numbers a task may hold for the jobs of one pass: their vectors, and their best scores so far.
MAX_JOB_CELLS = 8_000_000
# Jobs and candidates compared at a time: a block of 1,024 x 4,096 cosines is 32 MB.
JOB_TILE, ITEM_TILE = 1_024, 4_096


def top_per_job(scored: DataFrame, limit: Column | int, score: str, job: str = "jd_id", item: str = "resume_id") -> DataFrame:
    """Best rows per job, up to a number or a column of the rows.

    A number lets Spark cut each partition before the shuffle. With many
    shuffle partitions a job would still receive that many cut pieces in one
    task, so the cut is first made per job and hash of the item.
    """
    best = [F.col(score).desc(), F.col(item)]
    salts = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 64
    if salts > 1:
        part = Window.partitionBy(job, F.pmod(F.xxhash64(item), F.lit(salts))).orderBy(*best)
        scored = scored.withColumn("__r", F.row_number().over(part)).filter(F.col("__r") <= limit).drop("__r")
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(job).orderBy(*best))).filter(F.col("rank") <= limit)


def _unit_rows(flat: np.ndarray, dim: int) -> np.ndarray:
    rows = flat.reshape(-1, dim).astype(np.float64)
    length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


def _similarities(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """All cosines of two unit-row blocks. Digits that depend on the block layout are cut, so copies tie."""
    return np.rint(left @ right.T * 1e12) / 1e12


def _merged(scores: np.ndarray, ids: np.ndarray, new: np.ndarray, new_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """k best per row of the held and the new scores, ties by id, exactly as the final window ranks.

    Held rows are padded with -inf. A row's k-th score is its threshold; what
    reaches it, ties included, is sorted and cut.
    """
    both = np.concatenate([scores, new], axis=1)
    which = np.concatenate([ids, np.broadcast_to(new_ids, new.shape)], axis=1)
    least = np.partition(both, both.shape[1] - k, axis=1)[:, both.shape[1] - k]
    row, col = np.nonzero((both >= least[:, None]) & (both > -np.inf))
    value, item = both[row, col], which[row, col]
    order = np.lexsort((item, -value, row))
    row, value, item = row[order], value[order], item[order]
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    keep = nth < k
    out, out_ids = np.full_like(scores, -np.inf), ids.copy()
    out[row[keep], nth[keep]], out_ids[row[keep], nth[keep]] = value[keep], item[keep]
    return out, out_ids


def _schema(jobs: DataFrame, items: DataFrame) -> T.StructType:
    return T.StructType([
        T.StructField("jd_id", jobs.schema["jd_id"].dataType),
        T.StructField("resume_id", items.schema["resume_id"].dataType),
        T.StructField("cosine", T.DoubleType()),
    ])


def _pass_scores(jobs: DataFrame, items: DataFrame, k: int, bounded: bool) -> DataFrame:
    """Partial top-k per task for the jobs of one pass, whose number was checked.

    A task holds the jobs' vectors, k scores and ids per job, and one block of
    cosines, whatever the number of candidates.
    """
    table = jobs.toArrow()
    job_ids = table.column("jd_id").to_pylist()
    vectors = table.column("embedding").combine_chunks()
    dim = len(vectors[0]) if len(vectors) else 0
    shared = items.sparkSession.sparkContext.broadcast(
        _unit_rows(vectors.flatten().to_numpy(zero_copy_only=False), dim) if dim else None
    )
    # jobs with a floor see only the items that reach it; NULL reaches nothing
    floors = table.column("floor").to_numpy().astype(float) if bounded else None
    schema = _schema(jobs, items)
    names = [f.name for f in schema]
    job_type = table.schema.field("jd_id").type

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = shared.value
        if matrix is None:
            return
        best, which, id_type = np.full((len(matrix), k), -np.inf), None, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            id_array = batch.column("resume_id")
            id_type, ids = id_array.type, id_array.to_numpy(zero_copy_only=False)
            which = np.full((len(matrix), k), ids[0], ids.dtype) if which is None else which
            rows = _unit_rows(batch.column("embedding").flatten().to_numpy(zero_copy_only=False), matrix.shape[1])
            reach = batch.column("reach").to_numpy(zero_copy_only=False).astype(float) if bounded else None
            for at in range(0, len(rows), ITEM_TILE):
                item = slice(at, at + ITEM_TILE)
                for first in range(0, len(matrix), JOB_TILE):
                    job = slice(first, first + JOB_TILE)
                    cosines = _similarities(matrix[job], rows[item])
                    if bounded:
                        cosines = np.where(reach[item][None, :] >= floors[job][:, None], cosines, -np.inf)
                    best[job], which[job] = _merged(best[job], which[job], cosines, ids[item], k)
        if which is None:
            return
        for first in range(0, len(matrix), JOB_TILE):
            held = best[first:first + JOB_TILE]
            row, col = np.nonzero(held > -np.inf)
            yield pa.RecordBatch.from_arrays(
                [pa.array([job_ids[first + r] for r in row], job_type), pa.array(which[first:first + JOB_TILE][row, col], id_type), pa.array(held[row, col])],
                names=names,
            )

    return items.mapInArrow(score, schema)


def vector_rejects(rows: DataFrame, dim: int, key: str = "resume_id") -> DataFrame:
    """(key, error) of rows that a vector search leaves out: no vector, an all-zero one or one of another length."""
    wrong = (
        F.when(F.col("embedding").isNull(), "no vector").when(F.size("embedding") != dim, F.concat(F.lit("length "), F.size("embedding").cast("string")))
        .when(~is_usable(F.col("embedding")), "zero vector")
    )
    return rows.select(key, wrong.alias("error")).filter("error is not null")


def cosine_top_k(
    jobs: DataFrame, items: DataFrame, k: int, *, dim: int, max_job_cells: int = MAX_JOB_CELLS, least: tuple[str, str] | None = None
) -> DataFrame:
    """(jd_id, resume_id, cosine, rank) of the k nearest candidates per job.

    ``jobs`` and ``items`` carry ``embedding`` of length ``dim``; rows that
    :func:`vector_rejects` names take no part. Candidates are never shuffled or
    copied: jobs travel to them as one matrix, in as many passes over the
    candidates as its bounded size needs. ``least``: a job column and an item
    column; items below the job's value are left out before the k best are taken.
    """
    usable = is_usable(F.col("embedding")) & (F.size("embedding") == dim)
    bounds = [[F.col(name).cast("double").alias(alias)] for name, alias in zip(least, ("floor", "reach"))] if least else [[], []]
    jobs = jobs.filter(usable).select("jd_id", "embedding", *bounds[0])
    items = items.filter(usable).select("resume_id", "embedding", *bounds[1])
    passes = -(-jobs.count() // max(1, max_job_cells // max(dim, k)))
    part = F.pmod(F.xxhash64("jd_id"), F.lit(max(passes, 1)))
    partial = reduce(DataFrame.unionByName, [_pass_scores(jobs.filter(part == p), items, k, least is not None) for p in range(max(passes, 1))])
    return top_per_job(partial, k, "cosine")
