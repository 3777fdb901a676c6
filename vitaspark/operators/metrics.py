"""Ingest summaries, batches and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lexical import stable

ROW_BITS = 33  # low bits of monotonically_increasing_id count rows of a partition


def rate(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.when(whole > 0, F.round(part * 100.0 / whole, digits)).otherwise(F.lit(0.0))


def ingest_summary(log: DataFrame, ok: Column, *keys: str) -> DataFrame:
    """total, succeeded, failed and success_rate, over all or per key (store)."""
    total, good = F.count("*"), F.count_if(ok)
    aggs = [
        total.alias("total"), good.alias("succeeded"), (total - good).alias("failed"), rate(good, total).alias("success_rate"),
    ]
    return log.groupBy(*keys).agg(*aggs) if keys else log.agg(*aggs)


def first_and_more(df: DataFrame, group: str, item: str, order: str, n: int = 5) -> DataFrame:
    """First n items per group and how many more there are. The row limit is
    applied before the shuffle, so a hot group never gathers in one task."""
    w = Window.partitionBy(group).orderBy(order)
    head = (
        df.select(group, item, order, F.row_number().over(w).alias("rn")).filter(F.col("rn") <= n)
        .groupBy(group).agg(F.array_sort(F.collect_list(F.struct("rn", item))).alias("h"))
    )
    totals = df.groupBy(group).agg(F.count("*").alias("total"))
    more = F.when(F.col("total") > n, F.concat(F.lit(" and "), (F.col("total") - n).cast("string"), F.lit(" more"))).otherwise("")
    return totals.join(head, group).select(group, "total", F.concat(F.array_join(F.transform("h", lambda x: x[item].cast("string")), ", "), more).alias("shown"))


def throughput(log: DataFrame, seconds: str, *keys: str) -> DataFrame:
    total = F.sum(seconds)
    return log.groupBy(*keys).agg(
        F.round(F.avg(seconds), 2).alias("avg_seconds"), F.round(F.when(total > 0, F.count("*") / total), 2).alias("per_second"),
    )


def global_row_number(df: DataFrame, order: str, out: str = "row_number") -> DataFrame:
    """Row numbers from 1 over the whole table without gathering it in one task:
    range partitions are sorted apart and offset by the sizes before them."""
    ordered = df.repartitionByRange(order).sortWithinPartitions(order).withColumn("__m", F.monotonically_increasing_id())
    ordered = stable(ordered)
    part = F.shiftrightunsigned("__m", ROW_BITS)
    sizes = ordered.groupBy(part.alias("__p")).agg(F.count("*").alias("n"))
    # one row per partition
    before = sizes.withColumn("offset", F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = ordered.withColumn("__p", part).join(F.broadcast(before.select("__p", "offset")), "__p")
    low = F.col("__m").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return numbered.withColumn(out, F.col("offset") + low + 1).drop("__m", "__p", "offset")


def batches(df: DataFrame, order: str, size: int = 25) -> DataFrame:
    """Batch number per row, ``size`` rows each."""
    return global_row_number(df, order).withColumn("batch", F.floor((F.col("row_number") - 1) / size)).drop("row_number")
