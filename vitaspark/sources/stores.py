"""Versioned tables: snapshots, upserts, child rows, partial updates, deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.sizing import BROADCAST_ROWS, counted_join, within


class SnapshotTable:
    """A parquet table kept as whole versions ``v=<n>``.

    A version counts once its job committed (``_SUCCESS``), so readers never
    see half a write and the version being read is never overwritten. Writing
    a version that exists is skipped, which makes a retried batch harmless.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, name: str) -> bool:
        return self._fs().exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}"))

    def versions(self) -> list[int]:
        if not self._exists(""):
            return []
        listed = self._fs().listStatus(self.spark._jvm.org.apache.hadoop.fs.Path(self.root))
        names = [s.getPath().getName() for s in listed]
        numbers = sorted(int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit())
        return [n for n in numbers if self._exists(f"v={n}/_SUCCESS")]

    def read(self, version: int | None = None) -> DataFrame | None:
        done = self.versions()
        if not done:
            return None
        return self.spark.read.parquet(f"{self.root}/v={done[-1] if version is None else version}")

    def write(self, df: DataFrame, version: int | None = None) -> int:
        done = self.versions()
        target = (done[-1] + 1 if done else 0) if version is None else version
        if target not in done:
            df.write.mode("overwrite").parquet(f"{self.root}/v={target}")
        return target


def latest(df: DataFrame, key: str = "resume_id", ts: str = "updated_dt") -> DataFrame:
    """Last written row per key; an aggregate, so copies of a hot key combine before the shuffle."""
    others = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(ts, *others)).alias("r")).select(key, "r.*")


def _value(name: str, has_new: Column, partial: bool) -> Column:
    new, old = F.col(f"n.{name}"), F.col(f"o.{name}")
    return F.coalesce(new, old) if partial else F.when(has_new, new).otherwise(old)


def upsert(old: DataFrame, new: DataFrame, key: str = "resume_id", created: str | None = "created_dt", partial: bool = False) -> DataFrame:
    """Old rows replaced or extended by new ones, ``created`` of known keys kept.

    ``partial=True`` only overwrites with values that are not null. When the
    keys of ``new`` are few, untouched old rows pass through one scan without a
    shuffle; otherwise both sides meet in one full outer join.
    """
    columns = old.columns
    if within(new.select(key), BROADCAST_ROWS):
        keys = F.broadcast(new.select(key))
        kept = old.join(keys, key, "left_anti")
        touched = old.join(keys, key, "left_semi")
        merged = new.alias("n").join(touched.alias("o"), F.col(f"n.{key}") == F.col(f"o.{key}"), "left")
    else:
        kept = None
        merged = old.alias("o").join(new.alias("n"), F.col(f"n.{key}") == F.col(f"o.{key}"), "full_outer")
    has_new = F.col(f"n.{key}").isNotNull()
    out = []
    for name in columns:
        if name == key:
            value = F.coalesce(F.col(f"n.{key}"), F.col(f"o.{key}"))
        elif name == created:
            value = F.coalesce(F.col(f"o.{created}"), F.col(f"n.{created}"))
        elif name not in new.columns:
            value = F.col(f"o.{name}")
        else:
            value = _value(name, has_new, partial)
        out.append(value.alias(name))
    rows = merged.select(*out)
    return rows if kept is None else kept.select(*columns).unionByName(rows)


def replace_children(children: DataFrame, updated: DataFrame, fresh: DataFrame, key: str = "resume_id") -> DataFrame:
    """Child rows of updated parents replaced by ``fresh``."""
    return delete(children, updated.select(key).distinct(), key).unionByName(fresh)


def delete(table: DataFrame, ids: DataFrame, key: str = "resume_id") -> DataFrame:
    doomed = ids.select(key)
    return table.join(doomed.hint(counted_join(doomed, BROADCAST_ROWS)), key, "left_anti")


def existing(ids: DataFrame, table: DataFrame, key: str = "resume_id") -> DataFrame:
    return ids.join(table.select(key), key, "left_semi")


def fetch(table: DataFrame, resume_id, key: str = "resume_id") -> DataFrame:
    """Point lookup; the equality reaches the parquet scan."""
    return table.filter(F.col(key) == resume_id)


def fetch_many(table: DataFrame, ids: DataFrame, key: str = "resume_id") -> DataFrame:
    wanted = ids.select(key).distinct()
    return table.join(wanted.hint(counted_join(wanted, BROADCAST_ROWS)), key, "left_semi")


def child_rows(records: DataFrame) -> dict[str, DataFrame]:
    """Education, experience and skill rows of records."""
    return {
        "education": records.select("resume_id", F.inline("education")),
        "experience": records.select("resume_id", F.explode("companies").alias("c")).select(
            "resume_id", F.col("c.name").alias("company_name"), "c.role", "c.duration", "c.description"
        ),
        "skills": records.select("resume_id", F.explode("skills").alias("skill_name")),
    }


def details(ids: DataFrame, pii: DataFrame, data: DataFrame, key: str = "resume_id") -> DataFrame:
    """Id with its contact and structured data; a missing side gives NULL."""
    left = pii.select(key, F.struct(*[c for c in pii.columns if c != key]).alias("pii"))
    right = data.select(key, F.struct(*[c for c in data.columns if c != key]).alias("data"))
    return ids.join(left, key, "left").join(right, key, "left")
