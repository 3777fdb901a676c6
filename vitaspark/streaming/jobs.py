"""Incremental jobs. Every batch writes under its own id, so a replayed batch changes nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lexical import (
    counted_weights, dictionary, merge_dictionaries, pair_scores, query_terms, stable, text_evidence,
)
from ..operators.metrics import ingest_summary
from ..operators.vector_search import cosine_top_k, top_per_job
from ..plans.ingest import ingest_increment
from ..sources.buckets import BucketTable

FILES_PER_BATCH = 25


def run_available(source: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Work through what is there in micro-batches, then stop. ``mode``: what a stateful source hands on per batch."""
    query = (
        source.writeStream.outputMode(mode).foreachBatch(each)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def _batch_folder(root: str) -> Callable[[DataFrame, int], None]:
    """Write each batch to a folder of its own; a batch that is run again replaces just that folder."""
    def each(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/batch={batch_id}")

    return each


def new_files(spark: SparkSession, path: str, schema, fmt: str = "parquet", per_batch: int = FILES_PER_BATCH) -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", per_batch).load(path)


def ingest_stream(source: DataFrame, root: str) -> None:
    """Stored responses into the contact, document, index, child and error tables, one delta per batch
    (:func:`ingest_increment`); ``increment_table(spark, root, name).read()`` gives a table."""
    def each(batch: DataFrame, batch_id: int) -> None:
        ingest_increment(batch.sparkSession, batch, root, stamp=batch_id, version=batch_id)

    run_available(source, each, f"{root}/_stream")


def distinct_stream(source: DataFrame, key: Column, root: str) -> None:
    """Exactly one record per content key over all batches.

    The keys seen are Spark's keyed streaming state, so a batch's work follows its own rows and not
    what was kept before; no stored record is read or written again. The record kept comes from the
    first batch that holds the key (any one of that batch's rows with it); a NULL key is a key like others.
    """
    firsts = source.withColumn("content_key", key).dropDuplicates(["content_key"])
    run_available(firsts, _batch_folder(f"{root}/distinct"), f"{root}/_stream")


def distinct_records(spark: SparkSession, root: str) -> DataFrame:
    """What :func:`distinct_stream` kept so far."""
    return spark.read.parquet(f"{root}/distinct").drop("batch")


def _pool_table(spark: SparkSession, root: str) -> BucketTable:
    return BucketTable(spark, f"{root}/pool", ["jd_id", "resume_id"], by=["jd_id"])


def score_stream(source: DataFrame, jobs: DataFrame, dim: int, k: int, root: str) -> None:
    """Score new candidates against standing jobs. A batch writes its own best k per job and reads no pool:
    the best k of all batches' best are the best k of everything seen. A candidate's last score counts."""
    def each(batch: DataFrame, batch_id: int) -> None:
        _pool_table(batch.sparkSession, root).write(cosine_top_k(jobs, batch, k, dim=dim).drop("rank"), batch_id)

    run_available(source, each, f"{root}/_stream")


def standing_pool(spark: SparkSession, root: str, k: int, jobs: DataFrame | None = None) -> DataFrame:
    """(jd_id, resume_id, cosine): best k per job of all batches, of the given jobs only where ``jobs`` is set."""
    return top_per_job(_pool_table(spark, root).read(keys=jobs), k, "cosine").drop("rank")


def compact_pool(spark: SparkSession, root: str, k: int) -> None:
    """Merge the batches' pools into one of k rows per job."""
    _pool_table(spark, root).compact(lambda rows: top_per_job(rows, k, "cosine").drop("rank"))


def statistics_stream(source: DataFrame, fields: list[str], root: str, key: str = "resume_id") -> None:
    """Term counts and lengths of each batch, written once; they add up, so no batch counts the corpus again."""
    def each(batch: DataFrame, batch_id: int) -> None:
        dictionary(batch, fields, key=key).write.mode("overwrite").parquet(f"{root}/terms/batch={batch_id}")

    run_available(source, each, f"{root}/_stream")


def running_dictionary(spark: SparkSession, root: str, batch: int | None = None) -> DataFrame:
    """:func:`dictionary` of everything up to ``batch``, by default of all batches."""
    log = spark.read.parquet(f"{root}/terms")
    return merge_dictionaries(log if batch is None else log.filter(F.col("batch") <= batch))


def score_text_stream(
    source: DataFrame, jobs: DataFrame, query: Column, k: int, root: str, *, exact_boosts: dict[str, float], best_fields: dict[str, float], key: str = "resume_id",
) -> None:
    """Score new candidates by text: each batch first adds its counts, then is scored under the counts of all candidates
    so far. Scores of earlier batches stay as they were written, as counts that changed since would move them all."""
    fields = sorted(set(exact_boosts) | set(best_fields))

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        dictionary(batch, fields, key=key).write.mode("overwrite").parquet(f"{root}/terms/batch={batch_id}")
        weights = stable(counted_weights(query_terms(jobs, query), running_dictionary(spark, root, batch_id), fuzzy=False))
        scores = pair_scores(text_evidence(batch, fields, key), weights, exact_boosts, best_fields, key, k).drop("fields")
        BucketTable(spark, f"{root}/text", ["jd_id", key], by=["jd_id"]).write(top_per_job(scores, k, "raw_score", item=key).drop("rank"), batch_id)

    run_available(source, each, f"{root}/_stream")


def text_pool(spark: SparkSession, root: str, k: int, key: str = "resume_id") -> DataFrame:
    """(jd_id, resume_id, raw_score): best k per job of what :func:`score_text_stream` wrote."""
    return top_per_job(BucketTable(spark, f"{root}/text", ["jd_id", key], by=["jd_id"]).read(), k, "raw_score", item=key).drop("rank")


def metrics_stream(source: DataFrame, ok: Column, store: str, root: str) -> None:
    """Running totals per store as a stateful aggregation; a batch hands on the totals of the stores it touched."""
    totals = ingest_summary(source, ok, store).drop("success_rate")
    run_available(totals, _batch_folder(f"{root}/metrics"), f"{root}/_stream", "update")


def running_metrics(spark: SparkSession, root: str, store: str, batch: int | None = None) -> DataFrame:
    """Totals per store after ``batch``, by default after the last one."""
    log = spark.read.parquet(f"{root}/metrics")
    if batch is not None:
        log = log.filter(F.col("batch") <= batch)
    counts = ("total", "succeeded", "failed")
    last = log.groupBy(store).agg(F.max_by(F.struct(*counts), "batch").alias("r")).select(store, "r.*")
    return last.withColumn("success_rate", F.round(F.col("succeeded") * 100.0 / F.col("total"), 1))
