"""Candidate pools, normalised scores, reranking and skill gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import skills as K
from ..functions.lexicon import STEEPNESS
from .vector_search import top_per_job

CANDIDATE_COLUMNS = ["resume_id", "skills", "positions", "total_experience"]
JOB_COLUMNS = ["jd_id", "job_title", "required_experience", "required_skills"]


def candidate_pool(scored: DataFrame, jobs: DataFrame, score: str = "raw_score") -> DataFrame:
    """Best ``max(3k, 30)`` per job; jobs carry their k as ``max_results``."""
    sizes = jobs.select("jd_id", S.pool_size(S.clamp_results(F.col("max_results"))).alias("pool_size"))
    return top_per_job(scored.join(sizes, "jd_id"), F.col("pool_size"), score).drop("pool_size", "rank")


def largest_pool(jobs: DataFrame) -> int:
    """The largest pool any job asks for: one number over the job table."""
    return jobs.agg(F.max(S.pool_size(S.clamp_results(F.col("max_results"))))).first()[0] or 1


def normalized(pool: DataFrame, mode: str, score: str = "raw_score", out: str = "search_score") -> DataFrame:
    """Min-max within the pool, then the logistic curve of the mode."""
    percent = S.signed_minmax_percent(F.col(score), "jd_id") if mode == "vector" else S.minmax_percent(F.col(score), "jd_id")
    return pool.withColumn("__percent", percent).withColumn(
        out, S.logistic_percent(F.col("__percent"), STEEPNESS[mode])
    ).drop("__percent")


def with_details(pool: DataFrame, jobs: DataFrame, docs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Attach candidate and job columns; the sides that travel are chosen by their size at run time."""
    picked = docs.select(*(columns or CANDIDATE_COLUMNS))
    wanted = [c for c in [*JOB_COLUMNS, "max_results", "min_experience"] if c in jobs.columns]
    return picked.join(pool, "resume_id").join(jobs.select(*wanted), "jd_id")


def components(pairs: DataFrame, profile: str = "batch", guarded: bool = True) -> DataFrame:
    """Add skill_score, exp_score, position_score and the normalised skill arrays."""
    exp = S.guarded_experience_score if guarded else S.experience_score
    return (
        pairs.withColumn("wanted_norm", K.normalize_skills(F.col("required_skills"), profile))
        .withColumn("held_norm", K.normalize_skills(F.col("skills"), profile))
        .withColumn("skill_score", K.skill_match_score(F.col("wanted_norm"), F.col("held_norm")))
        .withColumn("exp_score", exp(F.col("total_experience"), F.col("required_experience")))
        .withColumn("position_score", S.position_score(F.col("job_title"), F.col("positions")))
    )


def rerank(pairs: DataFrame, profile: str, search: str = "search_score", out: str = "rerank_score") -> DataFrame:
    meets = F.col("total_experience") >= F.col("required_experience")
    return pairs.withColumn(
        out,
        S.weighted_score(
            profile, F.col(search), F.col("skill_score"), F.col("position_score"), F.col("exp_score"), meets
        ),
    )


def final_order(pairs: DataFrame, k: Column | int, score: str = "rerank_score") -> DataFrame:
    """First k per job with ``rank_position`` from 1."""
    return top_per_job(pairs, k, score).withColumnRenamed("rank", "rank_position")


def coverage(pairs: DataFrame) -> DataFrame:
    """Matching, missing and partially matching skills with the coverage percent."""
    wanted, wanted_norm = F.col("required_skills"), F.col("wanted_norm")
    held, held_norm = F.col("skills"), F.col("held_norm")
    return (
        pairs.withColumn("matching", K.matching_skills(held, held_norm, wanted_norm))
        .withColumn("missing", K.missing_skills(wanted, wanted_norm, held_norm))
        .withColumn("partial_matches", K.partial_pairs(wanted, wanted_norm, held, held_norm))
        .withColumn("skill_coverage", K.coverage_percent(F.size("matching"), F.size("partial_matches"), F.size(wanted)))
    )


def skill_gaps(results: DataFrame) -> DataFrame:
    """(jd_id, skill, missing_count, missing_percent), most missed first."""
    totals = results.groupBy("jd_id").agg(F.count("*").alias("candidates"))
    counts = (
        results.select("jd_id", F.explode("missing").alias("skill")).groupBy("jd_id", "skill")
        .agg(F.count("*").alias("missing_count"))
    )
    return counts.join(totals, "jd_id").select(
        "jd_id", "skill", "missing_count",
        S.rounded(F.col("missing_count") * 100.0 / F.col("candidates"), 1).alias("missing_percent"),
    )


def overall_ranking(pairs: DataFrame) -> DataFrame:
    """Overall profile: search, skills and experience with a penalty below the minimum."""
    search = F.least(F.greatest(F.col("search_score"), F.lit(0.0)), F.lit(100.0))
    scored = components(pairs, guarded=False).withColumn("search_score", search)
    return (
        rerank(scored, "overall", out="combined_score")
        .withColumn("meets_min_experience", F.col("total_experience") >= F.col("required_experience"))
        .withColumn("matched_skills", K.matched_by_case(F.col("required_skills"), F.col("skills")))
        .withColumn("missing_skills", K.missing_by_case(F.col("required_skills"), F.col("skills")))
    )

