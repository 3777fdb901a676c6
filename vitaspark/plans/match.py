"""Search and match plans for a table of jobs against a table of candidates.

``jobs``: jd_id, text, job_title, required_experience, required_skills,
nice_to_have_skills, seniority_level, industry, max_results, min_experience,
embedding. ``docs``: resume_id, skills, positions, summary,
projects_description, companies_description, education_degree,
total_experience, embedding.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions.vectors import is_usable
from ..functions.lexicon import (
    ALTERNATE_BOOSTS, HYBRID_BEST_FIELDS, PHRASE_BOOST, TEXT_BEST_FIELDS, TEXT_EXACT_BOOSTS, VECTOR_BOOST,
)
from ..operators import lexical as L
from ..operators import ranking as R
from ..operators.vector_search import cosine_top_k, top_per_job


def focused_query() -> Column:
    """Labelled job fields when at least three are known, else the job text."""

    def labelled(label: str, value: Column) -> Column:
        return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(label + ": "), value))

    parts = F.array_compact(F.array(
        labelled("Job Title", F.col("job_title")),
        labelled("Required Skills", F.array_join("required_skills", ", ")),
        labelled("Nice-to-have Skills", F.array_join("nice_to_have_skills", ", ")),
        labelled("Seniority Level", F.col("seniority_level")),
        labelled("Industry", F.col("industry")),
    ))
    return F.when(F.size(parts) >= 3, F.array_join(parts, "\n")).otherwise(F.col("text"))


#: Columns that a prefiltered search compares: what the job needs and what the candidate has.
LEAST = ("required_experience", "total_experience")


def _eligible(scored: DataFrame, jobs: DataFrame, docs: DataFrame) -> DataFrame:
    """Scored pairs whose candidate has the experience the job needs."""
    need, have = jobs.select("jd_id", LEAST[0]), docs.select("resume_id", LEAST[1])
    return _fitting(scored.join(have, "resume_id").join(need, "jd_id")).drop(*LEAST)


def text_search(jobs: DataFrame, docs: DataFrame, query: Column | None = None, prefilter: bool = False) -> DataFrame:
    """(jd_id, resume_id, raw_score, score): weighted text search, best ``max_results`` per job."""
    scored = L.text_scores(
        jobs, F.col("text") if query is None else query, docs,
        exact_boosts=TEXT_EXACT_BOOSTS, best_fields=TEXT_BEST_FIELDS, k=None if prefilter else _most_results(jobs),
    )
    if prefilter:
        scored = _eligible(scored, jobs, docs)
    return _cut(scored, jobs).withColumn("score", S.max_percent(F.col("raw_score"), "jd_id"))


def _most_results(jobs: DataFrame) -> int:
    """The most results any job asks for: one number over the job table."""
    return jobs.agg(F.max(S.clamp_results(F.col("max_results")))).first()[0] or 1


def _cut(scored: DataFrame, jobs: DataFrame, score: str = "raw_score") -> DataFrame:
    limits = jobs.select("jd_id", S.clamp_results(F.col("max_results")).alias("k"))
    return top_per_job(scored.join(limits, "jd_id"), F.col("k"), score).drop("rank", "k")


def vector_pool(jobs: DataFrame, docs: DataFrame, dim: int, prefilter: bool = False) -> DataFrame:
    """Pool of nearest candidates with ``search_score``; ``prefilter`` only takes candidates with the experience needed."""
    nearest = cosine_top_k(jobs, docs, R.largest_pool(jobs), dim=dim, least=LEAST if prefilter else None).drop("rank").withColumnRenamed("cosine", "raw_score")
    return R.normalized(R.candidate_pool(nearest, jobs), "vector")


def hybrid_pool(jobs: DataFrame, docs: DataFrame, dim: int, query: Column | None = None, with_title: bool = True, prefilter: bool = False) -> DataFrame:
    """Pool by vector, best-fields text and skill phrases with ``search_score`` and ``cosine``."""
    nearest = R.candidate_pool(cosine_top_k(jobs, docs, R.largest_pool(jobs), dim=dim, least=LEAST if prefilter else None).drop("rank"), jobs, "cosine")
    nearest = L.stable(nearest)
    terms = L.key_terms(F.col("required_skills"), F.col("job_title") if with_title else None)
    scored = L.hybrid_scores(
        jobs, focused_query() if query is None else query, terms, docs, nearest,
        best_fields=HYBRID_BEST_FIELDS, vector_boost=VECTOR_BOOST, phrase_boost=PHRASE_BOOST, k=None if prefilter else R.largest_pool(jobs),
    )
    if prefilter:
        scored = _eligible(scored, jobs, docs)
    pool = R.normalized(R.candidate_pool(scored, jobs), "hybrid")
    return pool.join(nearest, ["jd_id", "resume_id"], "left")


def vector_search(jobs: DataFrame, docs: DataFrame, dim: int, prefilter: bool = False) -> DataFrame:
    """Vector search end to end: pool, normalise, rerank, k best. Jobs without a usable vector take text search.

    ``prefilter`` leaves candidates below the job's required experience out before any cut.
    """
    usable = is_usable(F.col("embedding")) & (F.size("embedding") == dim)
    pool = vector_pool(jobs, docs, dim, prefilter)
    blind = L.stable(jobs.filter(~F.coalesce(usable, F.lit(False))))
    if not blind.isEmpty():
        pool = pool.unionByName(text_search(blind, docs, prefilter=prefilter).select("jd_id", "resume_id", "raw_score", F.col("score").alias("search_score")))
    pairs = R.components(R.with_details(pool, jobs, docs))
    return R.final_order(R.rerank(pairs, "vector"), S.clamp_results(F.col("max_results")))


def hybrid_search(jobs: DataFrame, docs: DataFrame, dim: int, prefilter: bool = False) -> DataFrame:
    """Request-profile hybrid search: minimum experience after the pool cut, rerank, k best.

    ``prefilter`` applies the minimum before the pool cut, so a strict minimum still gives full lists.
    """
    jobs = _asked(jobs)
    fit = _fitting(R.with_details(hybrid_pool(jobs, docs, dim, prefilter=prefilter), jobs, docs))
    return R.final_order(R.rerank(R.components(fit, "api"), "hybrid"), S.clamp_results(F.col("max_results")))


def alternate_search(jobs: DataFrame, docs: DataFrame, dim: int, share: float = 0.5) -> DataFrame:
    """Older weight set: field-weighted text and vector hits summed half and half, not normalised."""
    nearest = R.candidate_pool(cosine_top_k(jobs, docs, R.largest_pool(jobs), dim=dim).drop("rank"), jobs, "cosine")
    weights = L.stable(
        L.term_weights(L.query_terms(jobs, F.col("text")), docs, sorted(ALTERNATE_BOOSTS), fuzzy=False)
        .unionByName(L.vector_weights(jobs))
    )
    evidence = L.text_evidence(docs, sorted(ALTERNATE_BOOSTS)).unionByName(L.vector_evidence(nearest))
    boosts = {f: b * share for f, b in ALTERNATE_BOOSTS.items()} | {"vector": 1 - share}
    return _cut(L.pair_scores(evidence, weights, boosts, {}, k=_most_results(jobs)).drop("fields"), jobs)


def with_fallback(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """Rows of ``fallback`` only for jobs that ``primary`` leaves without any."""
    served = primary.select("jd_id").distinct()
    return primary.unionByName(fallback.join(served, "jd_id", "left_anti"))


def acceptable_job(text: Column) -> Column:
    """A job text long enough to search with."""
    return F.length(F.trim(F.coalesce(text, F.lit("")))) >= 10


def split_jobs(jobs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Jobs to search with, and the others with an ``error`` that says why they are left out."""
    long_enough = acceptable_job(F.col(text))
    blank = F.length(F.trim(F.coalesce(text, F.lit("")))) == 0
    reason = F.when(blank, "empty job description").otherwise("job description under 10 characters")
    return jobs.filter(long_enough), jobs.filter(~long_enough).withColumn("error", reason)


def batch_search(jobs: DataFrame, docs: DataFrame, dim: int, query: Column | None = None) -> DataFrame:
    """Batch profile: hybrid without rerank; jobs without hits take text search."""
    usable = L.stable(hybrid_pool(jobs, docs, dim, query, with_title=False).select("jd_id", "resume_id", "raw_score", "search_score"))
    primary = _cut(usable, jobs).withColumnRenamed("search_score", "score")
    unserved = L.stable(jobs.join(usable.select("jd_id").distinct(), "jd_id", "left_anti"))
    if unserved.isEmpty():
        return primary
    return with_fallback(primary, text_search(unserved, docs))


def _asked(jobs: DataFrame) -> DataFrame:
    """Jobs whose required experience is at least the minimum asked for."""
    return jobs.withColumn(
        "required_experience", F.greatest(F.col("required_experience"), F.coalesce(F.col("min_experience"), F.lit(0.0)))
    )


def _fitting(pairs: DataFrame) -> DataFrame:
    return pairs.filter(F.col("total_experience") >= F.col("required_experience"))


def match(jobs: DataFrame, docs: DataFrame, dim: int, analyze_count: int | None = 25, fallback: bool = True, prefilter: bool = False) -> DataFrame:
    """The match service for a whole table of jobs: search, coverage and templated analysis.

    Jobs that the hybrid search leaves without any result take the vector search.

    ``analyze_count`` limits who gets an analysis text, ``None`` analyses every result; no row is lost.
    ``prefilter`` takes the minimum experience before the pool cut instead of after it.
    """
    found = hybrid_search(jobs, docs, dim, prefilter)
    if fallback:
        found = L.stable(found)
        unserved = L.stable(jobs.join(found.select("jd_id").distinct(), "jd_id", "left_anti"))
        if not unserved.isEmpty():
            found = found.unionByName(_fitting(vector_search(_asked(unserved), docs, dim, prefilter)), allowMissingColumns=True)
    result = R.coverage(found)
    text = S.candidate_analysis(
        F.col("rerank_score"), F.col("exp_score"), F.col("total_experience"), F.col("required_experience"),
        F.col("skill_coverage"), F.col("position_score"), F.col("missing"),
    )
    if analyze_count is not None:
        text = F.when(F.col("rank_position") <= analyze_count, text)
    return result.withColumn("analysis", text).withColumn(
        "experience_difference", S.experience_difference(F.col("total_experience"), F.col("required_experience"))
    )
