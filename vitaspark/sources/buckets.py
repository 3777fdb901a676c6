"""Keyed tables that grow by deltas, merged when they are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .stores import SnapshotTable

# More suit larger batches: a delta has a file per bucket at most. A table keeps the number it began with.
BUCKETS = 16

DELTA, BUCKET, GONE, FIRST = "__delta", "__bucket", "__gone", "__first"


class BucketTable:
    """A parquet table of keyed rows, kept as one small delta per batch.

    A delta ``v=<batch>`` holds only the rows its batch writes, in folders by hash of ``by`` (the key by default).
    It counts once its job committed, and a delta that exists is left alone, so a batch that is run again changes
    nothing. Reading takes the last row of each key. Given keys, it reads the buckets of those keys alone.
    What a batch writes follows its own rows; what a lookup reads is whole buckets, which grow with the table, so it saves
    reading only for batches with fewer keys than buckets.

    A batch must hold a key once at most, and all batches have the columns of the first, which may be empty. A NULL key is a
    key like others; ``created`` keeps the value a key came with first.
    """

    def __init__(
        self, spark: SparkSession, root: str, key: str | list[str] = "resume_id", *, by: list[str] | None = None,
        created: str | None = None, buckets: int = BUCKETS,
    ):
        self.spark, self.root = spark, root.rstrip("/")
        self.key = [key] if isinstance(key, str) else list(key)
        self.by, self.created, self.buckets = by or self.key, created, buckets
        self.deltas = SnapshotTable(spark, f"{self.root}/deltas")
        self.bases = SnapshotTable(spark, f"{self.root}/bases")
        self.shape = SnapshotTable(spark, f"{self.root}/shape")

    def _bucket(self, names: list[str]) -> Column:
        return F.pmod(F.xxhash64(*[F.col(n) for n in names]), F.lit(self.buckets)).cast("int")

    def versions(self) -> list[int]:
        return sorted(set(self.deltas.versions()) | set(self.bases.versions()))

    def next_version(self) -> int:
        done = self.versions()
        return done[-1] + 1 if done else 0

    def write(self, rows: DataFrame, version: int, gone: DataFrame | None = None) -> None:
        """Add a batch: ``rows`` replace those of their keys, keys of ``gone`` that ``rows`` lack are deleted."""
        if version in self.deltas.versions() or version <= max(self.bases.versions(), default=-1):
            return
        marked = rows.withColumn(GONE, F.lit(False))
        if gone is not None:
            # one row per key, by an aggregate: a key that is written and deleted stays
            rest = [c for c in rows.columns if c not in self.key]
            both = marked.unionByName(gone.select(*self.key).withColumn(GONE, F.lit(True)), allowMissingColumns=True)
            marked = both.groupBy(*self.key).agg(F.min_by(F.struct(*rest, GONE), GONE).alias("r")).select(*self.key, "r.*")
        if self.created:
            marked = marked.withColumn(FIRST, F.col(self.created))
        marked = marked.withColumn(DELTA, F.lit(version).cast("bigint"))
        if not self.shape.versions():
            # an empty batch leaves no file that would name its columns
            self.shape.write(self.spark.createDataFrame([], marked.schema), 0)
        self._save(marked, self.deltas, version)

    def _save(self, rows: DataFrame, target: SnapshotTable, version: int) -> None:
        placed = rows.withColumn(BUCKET, self._bucket(self.by)).repartition(BUCKET)
        placed.write.mode("overwrite").partitionBy(BUCKET).parquet(f"{target.root}/v={version}")

    def _raw(self, before: int | None, keys: DataFrame | None) -> DataFrame | None:
        shape = self.shape.read()
        if shape is None:
            return None
        bases = [v for v in self.bases.versions() if before is None or v < before]
        start = bases[-1] if bases else -1
        new = [f"v={v}" for v in self.deltas.versions() if v > start and (before is None or v < before)]
        schema = shape.schema.add(BUCKET, "integer")
        rows = self.spark.createDataFrame([], schema)
        for table, names in ((self.bases, [f"v={start}"] if bases else []), (self.deltas, new)):
            if names:
                read = self.spark.read.schema(schema).option("basePath", table.root)
                rows = rows.unionByName(read.parquet(*[f"{table.root}/{name}" for name in names]).select(*schema.names))
        if keys is None:
            return rows
        wanted = keys.select(*self.by).distinct()
        # at most ``buckets`` numbers; they become a partition filter, so other buckets are not listed for reading
        numbers = [r[0] for r in wanted.select(self._bucket(self.by)).distinct().collect()]
        same = [F.col(name).eqNullSafe(F.col(f"__{name}")) for name in self.by]
        renamed = wanted.select(*[F.col(name).alias(f"__{name}") for name in self.by])
        return rows.filter(F.col(BUCKET).isin(numbers)).join(renamed, same, "left_semi")

    def _merged(self, raw: DataFrame) -> DataFrame:
        rest = [c for c in raw.columns if c not in (*self.key, BUCKET, FIRST)]
        kept = [F.max_by(F.struct(*rest), DELTA).alias("r")]
        if self.created:
            kept.append(F.min_by(FIRST, F.when(~F.col(GONE), F.col(DELTA))).alias(FIRST))
        merged = raw.groupBy(*self.key).agg(*kept).select(*self.key, "r.*", *([FIRST] if self.created else []))
        merged = merged.filter(~F.col(GONE))
        return merged.withColumn(self.created, F.col(FIRST)) if self.created else merged

    def read(self, before: int | None = None, keys: DataFrame | None = None) -> DataFrame | None:
        """The rows as they are, or as they were ``before`` a version; with ``keys`` (columns ``by``) only the rows of those."""
        raw = self._raw(before, keys)
        return None if raw is None else self._merged(raw).drop(DELTA, GONE, FIRST)

    def compact(self, keep=None) -> None:
        """Merge everything up to the last version into one base; ``keep`` may cut the rows further.

        Older deltas stay on disk for readers at work; :meth:`read` no longer looks at them.
        """
        done = self.versions()
        if not done or done[-1] in self.bases.versions():
            return
        rows = self._merged(self._raw(None, None))
        self._save(keep(rows) if keep else rows, self.bases, done[-1])
