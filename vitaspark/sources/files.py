"""File listings, text reading, job folders, key mapping and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Document types of the two listings.
DOCUMENT_TYPES = ["pdf", "docx", "doc", "txt", "rtf"]
METADATA_TYPES = ["pdf", "docx", "doc", "rtf"]
JOB_TYPES = ["txt", "md", "json"]


def file_type(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, r"\."), -1))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _named(types: list[str]) -> str:
    """A glob for file names with one of the extensions in any case; other files are not opened."""
    either = ["".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in t) for t in types]
    return "*.{" + ",".join(either) + "}"


def _files(spark: SparkSession, prefix: str, types: list[str]) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", _named(types)).load(prefix)


def list_documents(spark: SparkSession, prefix: str, types: list[str] | None = None) -> DataFrame:
    """Files under a prefix with an accepted extension in any case; contents are not read."""
    listed = _files(spark, prefix, types or DOCUMENT_TYPES).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("last_modified"))
    return listed.withColumns({"file_name": file_name(F.col("path")), "file_type": file_type(F.col("path"))})


def read_texts(spark: SparkSession, prefix: str, types: list[str] | None = None) -> DataFrame:
    """Whole files as text; invalid UTF-8 becomes the replacement character."""
    return _files(spark, prefix, types or ["txt"]).select(
        "path", file_name(F.col("path")).alias("filename"), file_type(F.col("path")).alias("file_type"),
        F.make_valid_utf8(F.col("content").cast("string")).alias("text"),
    )


def read_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """All job files of a folder as one table, one row per file."""
    texts = read_texts(spark, folder, JOB_TYPES)
    return texts.select(F.regexp_replace("filename", r"\.[^.]*$", "").alias("jd_id"), "path", "text")


RESPONSE_SCHEMA = (
    "resume_id STRING, s3_key STRING, original_filename STRING, file_type STRING, llm_output STRING, timestamp STRING, "
    "model_id STRING, processing_time DOUBLE, _corrupt_record STRING"
)


def read_responses(spark: SparkSession, folder: str, one_per_line: bool = False) -> DataFrame:
    """Stored response envelopes, one per file or one per line; ``llm_output`` stays
    text and broken envelopes keep their content in ``_corrupt_record``."""
    reader = spark.read.schema(RESPONSE_SCHEMA).option("mode", "PERMISSIVE")
    return reader.option("multiLine", str(not one_per_line).lower()).json(folder)


def processed_key(raw: Column) -> Column:
    return F.concat(F.lit("processed/"), F.regexp_replace(raw, r"\Araw/", ""))


def error_key(raw: Column) -> Column:
    """``errors/<dir>/<stem>_error.json`` of a raw key."""
    rest = F.regexp_replace(raw, r"\Araw/", "")
    folder = F.regexp_extract(rest, r"\A(.*/)[^/]*\z", 1)
    stem = F.regexp_replace(file_name(rest), r"\.[^.]*\z", "")
    return F.concat(F.lit("errors/"), folder, stem, F.lit("_error.json"))


def route_outcomes(df: DataFrame, ok: Column, path: str) -> None:
    """Write rows under ``status=success`` or ``status=failed``; inputs are left alone."""
    df.withColumn("status", F.when(ok, "success").otherwise("failed")).write.mode("overwrite").partitionBy("status").parquet(path)


def slug(title: Column) -> Column:
    """Lower case, blanks to hyphens, first 30 characters."""
    return F.substring(F.replace(F.lower(title), F.lit(" "), F.lit("-")), 1, 30)


def job_reports(results: DataFrame, jobs: DataFrame, method: str = "hybrid", page: int = 100) -> DataFrame:
    """Report rows of every job, all results in numbered parts of ``page``, so that no list is unbounded.

    A job without results has one empty part 1; ``total_results`` counts all parts.
    """
    detail = [c for c in results.columns if c not in ("jd_id", "rank_position")]
    part = (F.floor((F.col("rank_position") - 1) / page) + 1).cast("int")
    parts = results.groupBy("jd_id", part.alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("rank_position", *detail))).alias("results")
    )
    totals = results.groupBy("jd_id").agg(F.count("*").alias("total_results"))
    return jobs.join(totals, "jd_id", "left").join(parts, "jd_id", "left").withColumn("part", F.coalesce("part", F.lit(1))).select(
        "jd_id", slug(F.col("job_title")).alias("slug"), F.lit(method).alias("search_method"), "job_title", "required_experience",
        "required_skills", F.coalesce("total_results", F.lit(0)).cast("bigint").alias("total_results"), "part", "results",
    )


def write_reports(reports: DataFrame, path: str) -> None:
    reports.write.mode("overwrite").partitionBy("slug").json(path)


def response_body(results: DataFrame) -> Column:
    """Nested result of one candidate as it is answered."""
    return F.struct(
        "resume_id",
        F.struct(
            F.col("rerank_score").alias("overall"), F.col("skill_score").alias("skill_match"), F.col("exp_score").alias("experience_match"),
            F.col("position_score").alias("position_match"), F.coalesce("cosine", F.lit(0.0)).alias("semantic_match"), "skill_coverage",
        ).alias("scores"),
        F.struct(F.col("skills").alias("all"), "matching", "missing", "partial_matches").alias("skills"),
        F.struct(
            F.col("total_experience").alias("years"), F.col("required_experience").alias("required"),
            F.col("experience_difference").alias("difference"),
        ).alias("experience"),
        "positions",
    )
