"""Shards that each match the source mixture. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitaspark.llm.common import saved, slots

SHARDS, SEED = 24, "mix-1"


def _offsets(counts: DataFrame, part: list[str], bucket: str) -> DataFrame:
    """Rows before each bucket, from counts by bucket."""
    before = Window.partitionBy(*part).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))


def shard(docs: DataFrame, shards: int = SHARDS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, text_crc32, shard, slot): proportional stratified interleaving, a row per document.

    Rows of a source are ranked in seeded random order; rank r of n gets the
    fraction (2r + 1) / 2n. All rows are ordered by fraction and the order is
    cut into shards whose row counts differ by one at most; each shard then
    holds its share of every source. Slots number a shard's rows from 0.

    Neither ranking is done in one task: rows are dealt into ranges of the
    random key (in a source) and of the fraction (overall), ranked there, and
    shifted by the count of the ranges before. Ranges follow the number of
    shuffle partitions, the result doesn't. A null source is a source, null
    texts are empty, null ids and repeated rows are rows like any other; rows
    equal in id, source and text change places without effect.
    """
    spark = docs.sparkSession
    ranges = 4 * slots(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    crc = F.crc32(text.cast("binary"))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")), crc.cast("string")).cast("binary"))
    rows = saved(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
            (F.octet_length(text) + 8).cast("long").alias("size"), crc.alias("text_crc32"), key.alias("key"),
        ),
        "shard-rows",
    )
    total = rows.count()
    per_range = max(1, -(-total // ranges))
    # ranges of the key in a source: as many as its rows fill
    sources = rows.groupBy(F.col("source").alias("s")).agg(F.count("*").alias("rows")).withColumn("buckets", F.ceil(F.col("rows") / F.lit(per_range)))
    share = F.conv(F.substring("key", 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    placed = saved(
        rows.join(sources, F.col("source").eqNullSafe(F.col("s")))
        .select("doc_id", "source", "size", "text_crc32", "key", "rows", F.floor(share * F.col("buckets")).alias("bucket")),
        "shard-placed",
    )
    counts = _offsets(placed.groupBy("source", "bucket").agg(F.count("*").alias("n")), ["source"], "bucket").select(F.col("source").alias("s"), F.col("bucket").alias("b"), "before")
    within = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "text_crc32", "size")
    rank = F.col("before") + F.row_number().over(within) - 1
    ranked = (
        placed.join(counts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
        .withColumn("rank", rank).withColumn("fraction", (2 * F.col("rank") + 1) / (2.0 * F.col("rows")))
    )
    dealt = saved(
        ranked.select("doc_id", "source", "size", "text_crc32", "key", "fraction", F.floor(F.col("fraction") * ranges).alias("range")), "shard-dealt"
    )
    starts = _offsets(dealt.groupBy("range").agg(F.count("*").alias("n")), [], "range").select("range", F.col("before").alias("start"))
    order = Window.partitionBy("range").orderBy("fraction", "source", "key", "doc_id", "text_crc32", "size")
    position = dealt.join(starts, "range").withColumn("position", F.col("start") + F.row_number().over(order) - 1)
    of_shard = F.expr(f"position * {shards} div {max(total, 1)}")
    return position.withColumn("shard", of_shard.cast("int")).select(
        "doc_id", "source", "size", "text_crc32", "shard",
        (F.col("position") - F.expr(f"(cast(shard as bigint) * {total} + {shards - 1}) div {shards}")).alias("slot"),
    )


def by_rows(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The law "rows": counts at most one apart, order by :func:`shard`."""
    return shard(docs, shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source"
    )


SQL = f"""
with recursive steps(i, k, c) as (
  select i, 0, i from range(256) t(i)
  union all select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from steps where k < 8),
crc_table as (select list(c order by i) as t from steps where k = 8),
sums as (
  select doc_id, source, strlen(coalesce(text, '')) + 8 as size,
    xor(list_reduce(list_prepend(4294967295::bigint, list_transform(list_filter(string_split(regexp_replace(hex(encode(coalesce(text, ''))), '(..)', '\\1,', 'g'), ','), lambda x: x <> ''),
      lambda x: ('0x' || x)::bigint)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295::bigint) as text_crc32
  from documents, crc_table),
keyed as (select *, md5('{SEED}:' || coalesce(doc_id::varchar, '') || ':' || text_crc32::varchar) as key from sums),
ranked as (
  select *, row_number() over (partition by source order by key, doc_id, text_crc32, size) - 1 as r, count(*) over (partition by source) as n, count(*) over () as total from keyed),
placed as (select *, row_number() over (order by (2 * r + 1) / (2.0::double * n), source nulls first, key, doc_id nulls first, text_crc32, size) - 1 as position from ranked)
select doc_id, size, text_crc32, 'rows' as law, (position * {SHARDS} // total)::int as shard,
  position - ((position * {SHARDS} // total) * total + {SHARDS - 1}) // {SHARDS} as slot, null::int as grown_shard, source
from placed
"""
