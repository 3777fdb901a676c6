"""Size checks before a broadcast, and hot-key handling for joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows a side may hold to be sent to every executor.
BROADCAST_ROWS = 500_000


def within(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` holds at most ``max_rows`` rows; reads no more than that plus one."""
    return df.limit(max_rows + 1).count() <= max_rows


def counted_join(df: DataFrame, max_rows: int | None = None) -> str:
    """Join hint for ``df`` and tables of no more rows: ``broadcast`` when its count allows it, else ``merge``.

    Spark's own choice goes by estimates, which a checkpoint keeps from the plan before it. Behind the parsing of
    responses they are a few hundred times too small, so without a hint tables of any size reach the driver.
    """
    return "broadcast" if within(df, BROADCAST_ROWS if max_rows is None else max_rows) else "merge"


def checked_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast when its counted size allows it, else as it was.

    Without the mark the join is a shuffle join that AQE may still change or
    split once it sees real sizes.
    """
    return F.broadcast(df) if within(df, max_rows) else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give rows of fewer scan partitions than task slots to all slots, by hash of the
    keys (first column by default). Larger inputs stay as they are."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < slots:
        return df.repartition(slots, *(keys or df.columns[:1]))
    return df


def lookup(
    big: DataFrame, keyed: DataFrame, key: str, *, how: str = "left", hot_rows: int = 1_000_000, max_hot: int = 10_000
) -> DataFrame:
    """Join ``big`` to ``keyed`` (one row per key) where keys of ``big`` may be hot.

    Keys above ``hot_rows`` rows are few (at most ``rows / hot_rows``); their
    lookup rows are broadcast and the rest takes a shuffle join, so no single
    task receives all rows of one key. Rows that don't fit ``BROADCAST_ROWS``
    are never broadcast, whatever Spark estimates.
    """
    if within(keyed, BROADCAST_ROWS):
        return big.join(F.broadcast(keyed), key, how)
    hot = (
        big.filter(F.col(key).isNotNull()).groupBy(key).count()
        .filter(F.col("count") > hot_rows).select(key)
    )
    hot_keyed = keyed.join(hot, key, "left_semi")
    if not within(hot_keyed, max_hot):
        return big.join(keyed.hint("merge"), key, how)
    tagged = big.join(F.broadcast(hot_keyed.select(key).withColumn("__hot", F.lit(True))), key, "left")
    cold = tagged.filter(F.col("__hot").isNull()).drop("__hot").join(keyed.hint("merge"), key, how)
    heavy = tagged.filter(F.col("__hot")).drop("__hot").join(F.broadcast(hot_keyed), key, how)
    return cold.unionByName(heavy)
