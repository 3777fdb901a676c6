"""Scoring variants, comparisons and reports that extend the core profiles."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import let
from ..functions.scores import rounded
from ..functions.text import tokens


def compare_rankings(first: DataFrame, second: DataFrame) -> DataFrame:
    """(jd_id, resume_id, side): who is in the first ranking, the second, or both."""
    keys = ["jd_id", "resume_id"]
    a = first.select(*keys).withColumn("a", F.lit(True))
    b = second.select(*keys).withColumn("b", F.lit(True))
    side = F.when(F.col("b").isNull(), "first").when(F.col("a").isNull(), "second").otherwise("both")
    return a.join(b, keys, "full_outer").select(*keys, side.alias("side"))


def overlap_at_k(first: DataFrame, second: DataFrame) -> DataFrame:
    """Share of the first ranking that the second also holds, per job."""
    sides = compare_rankings(first, second).filter("side <> 'second'")
    return sides.groupBy("jd_id").agg(rounded(F.count_if(F.col("side") == "both") / F.count("*"), 4).alias("overlap"))


def blend(vector: DataFrame, text: DataFrame, vector_share: float = 0.7, text_share: float = 0.3) -> DataFrame:
    """Two result lists (jd_id, resume_id, score 0..100) as one, a missing score counts 0.

    Both sides are result lists of at most 100 rows per job, so the join is small.
    """
    keys = ["jd_id", "resume_id"]
    a = vector.select(*keys, F.col("score").alias("__a"))
    b = text.select(*keys, F.col("score").alias("__b"))
    total = F.coalesce("__a", F.lit(0.0)) * vector_share + F.coalesce("__b", F.lit(0.0)) * text_share
    return a.join(b, keys, "full_outer").select(*keys, rounded(total, 2).alias("score"))


def experience_curve(have: Column, need: Column) -> Column:
    """100 without a need; 80 plus 5 per extra year up to 100 when met; else 70 times the ratio."""
    return (
        F.when(need <= 0, F.lit(100.0))
        .when(have >= need, F.least((have - need) * 5 + 80, F.lit(100.0)))
        .otherwise(have / need * 70.0)
    )


def preferred_experience(have: Column, need: Column, preferred: Column) -> Column:
    """100 at the preferred years, 80 to 100 between both, 80 times the ratio below the need."""
    span = F.greatest(preferred - need, F.lit(0.0001))
    return (
        F.when(have >= preferred, F.lit(100.0))
        .when(have >= need, (have - need) / span * 20 + 80)
        .otherwise(have / F.greatest(need, F.lit(0.0001)) * 80)
    )


def score_band(score: Column) -> Column:
    return F.when(score >= 80, "excellent").when(score >= 60, "good").when(score >= 40, "moderate").otherwise("poor")


def or_default(score: Column, default: float = 50.0) -> Column:
    return F.coalesce(score, F.lit(default))


def holds_all(held: Column, mandatory: Column) -> Column:
    lowered = F.transform(held, F.lower)
    return F.forall(mandatory, lambda s: F.array_contains(lowered, F.lower(s)))


def skill_importance(text: Column, skill: Column) -> Column:
    """Earlier and more frequent mentions weigh more: position share plus capped frequency; an empty skill counts 0."""
    body, word = F.lower(text), F.lower(skill)
    at = F.instr(body, word)
    times = (F.length(body) - F.length(F.replace(body, word, F.lit("")))) / F.greatest(F.length(word), F.lit(1))
    early = 1.0 - (at - 1) / F.greatest(F.length(body), F.lit(1))
    return F.when((at > 0) & (F.length(word) > 0), rounded(early * 0.5 + F.least(times, F.lit(5.0)) / 5.0 * 0.5, 4)).otherwise(F.lit(0.0))


def mention_context(text: Column, skill: Column, strong: list[str], weak: list[str], window: int = 10) -> Column:
    """1.0, 0.3 or 0.6 by the wording before a skill: strong cue, weak cue, none; NULL where the skill isn't mentioned.

    The nearest cue word among the ``window`` words before a mention decides it, and the best
    mention counts. Texts and skills are compared by words, so a skill of several words is found as a run.
    """
    cues = F.array(*[F.lit(w) for w in [*strong, *weak]])

    def level(words: Column, at: Column) -> Column:
        before = F.slice(words, F.greatest(at - window, F.lit(0)) + 1, F.least(at, F.lit(window)))
        nearest = F.get(F.filter(F.reverse(before), lambda w: F.array_contains(cues, w)), F.lit(0))
        return F.when(nearest.isin(*strong), 1.0).when(nearest.isin(*weak), 0.3).otherwise(0.6)

    def best(words: Column, run: Column) -> Column:
        places = F.transform(words, lambda _, i: i)
        found = F.filter(places, lambda i: (F.get(words, i) == F.get(run, F.lit(0))) & (F.slice(words, i + 1, F.size(run)) == run))
        return F.array_max(F.transform(found, lambda i: level(words, i)))

    return let(tokens(text), lambda words: let(tokens(skill), lambda run: best(words, run)))


def importance_in_context(text: Column, skill: Column, strong: list[str], weak: list[str], window: int = 10) -> Column:
    """As :func:`skill_importance` with the wording around the skill as a third part; 0 without a mention as words."""
    context = mention_context(text, skill, strong, weak, window)
    return F.coalesce(rounded(skill_importance(text, skill) * 0.7 + context * 0.3, 4), F.lit(0.0))


def multi_job_candidates(results: DataFrame, at_least: int = 2) -> DataFrame:
    """(resume_id, jobs, jd_id) rows of candidates ranked for several jobs."""
    counts = results.groupBy("resume_id").agg(F.countDistinct("jd_id").alias("jobs")).filter(F.col("jobs") >= at_least)
    return results.select("resume_id", "jd_id").distinct().join(counts, "resume_id").select("resume_id", "jobs", "jd_id")


def skill_pools(people: DataFrame, key: str, skills: str) -> DataFrame:
    """(skill, bucket, members): who holds each skill, as one bitmap per skill and 32,768 ids.

    ``key`` holds whole numbers. Bitmaps combine before the shuffle, so a skill that
    everybody holds sends one bitmap per task and bucket. NULL ids and skills are in no pool.
    """
    rows = people.select(F.col(key).cast("bigint").alias("k"), F.explode(skills).alias("s")).filter("k is not null and s is not null")
    return (
        rows.groupBy(F.lower("s").alias("skill"), F.bitmap_bucket_number("k").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("k")).alias("members"))
    )


def pool_sizes(wishes: DataFrame, pools: DataFrame, key: str, skills: str) -> DataFrame:
    """(key, wanted, holders, with_any): people who hold all of a row's skills, and any of them.

    Counts come from intersected and united bitmaps; no list of people is built. A row
    without skills has no pool and gives zeros.
    """
    wanted = wishes.select(key, F.array_distinct(F.transform(F.array_compact(F.coalesce(skills, F.array())), F.lower)).alias("w"))
    hits = wanted.select(key, F.size("w").alias("n"), F.explode("w").alias("skill")).join(pools, "skill")
    per_bucket = hits.groupBy(key, "n", "bucket").agg(
        F.count("*").alias("pools"), F.bitmap_count(F.bitmap_and_agg("members")).alias("every"), F.bitmap_count(F.bitmap_or_agg("members")).alias("any")
    )
    counted = per_bucket.groupBy(key).agg(F.sum(F.when(F.col("pools") == F.col("n"), F.col("every")).otherwise(0)).alias("h"), F.sum("any").alias("a"))
    zero = F.lit(0).cast("bigint")
    return wanted.join(counted, key, "left").select(
        key, F.size("w").cast("bigint").alias("wanted"), F.coalesce("h", zero).alias("holders"), F.coalesce("a", zero).alias("with_any")
    )


def weight_grid(components: DataFrame, weights: DataFrame) -> DataFrame:
    """Total per weight set. The caller's sets ride along as one array, so no pair join is needed."""
    columns = ["name", "w_search", "w_skill", "w_position", "w_experience"]
    sets = [r.asDict() for r in weights.select(*columns).collect()]
    grid = F.from_json(F.lit(json.dumps(sets)), "array<struct<name:string,w_search:double,w_skill:double,w_position:double,w_experience:double>>")
    total = lambda w: (
        F.col("search_score") * w["w_search"] + F.col("skill_score") * w["w_skill"] + F.col("position_score") * w["w_position"] + F.col("exp_score") * w["w_experience"]
    )
    return components.select("jd_id", "resume_id", F.inline(F.transform(grid, lambda w: F.struct(w["name"].alias("name"), total(w).alias("total")))))


def quality_weighted(pairs: DataFrame, columns: list[str], score: Column, fallback: Column, out: str = "score") -> DataFrame:
    """Use ``fallback`` for jobs whose pool has less than half of the columns filled."""
    filled = sum((F.col(c).isNotNull().cast("double") for c in columns), F.lit(0.0)) / len(columns)
    quality = F.avg(filled).over(Window.partitionBy("jd_id"))
    return pairs.withColumn("quality", rounded(quality, 4)).withColumn(out, F.when(F.col("quality") < 0.5, fallback).otherwise(score))


def chunk_tokens(df: DataFrame, text: str, size: int = 512) -> DataFrame:
    """Whole texts as chunks of ``size`` blank-separated tokens."""
    words = F.filter(F.split(F.col(text), r"\s+"), lambda w: w != "")
    starts = F.sequence(F.lit(1), F.greatest(F.size("__w"), F.lit(1)), F.lit(size))
    return (
        df.withColumn("__w", words).select("*", F.posexplode(starts).alias("chunk", "__at"))
        .withColumn("chunk_text", F.array_join(F.slice("__w", F.col("__at"), F.lit(size)), " "))
        .drop("__w", "__at", text)
    )


def quantize(vector: Column) -> Column:
    """Eight-bit vector scaled by its largest magnitude."""
    doubles = vector.cast("array<double>")
    top = F.array_max(F.transform(doubles, lambda x: F.abs(x)))
    return F.transform(doubles, lambda x: F.rint(x / top * 127).cast("tinyint"))


#: Most held skills whose counts set the first floor of every missing skill.
FLOOR_SKILLS = 8


def related_floors(skills: DataFrame, gaps: DataFrame, top: int = 3) -> tuple[DataFrame, DataFrame]:
    """(skill, floor) and (related, held): counts that a pair must and can reach.

    Two skills are held together at most as often as the rarer one is held. The counts with the few
    most held skills are exact, so the ``top``-th best of them is a floor of the answer; a skill held
    less often than that can't be among the best.
    """
    held = skills.groupBy(F.col("skill").alias("related")).agg(F.count("*").alias("held"))
    seeds = held.orderBy(F.desc("held"), "related").limit(max(FLOOR_SKILLS, top + 1)).select("related")
    counts = _together(skills.join(gaps.select("skill"), "skill", "left_semi"), skills.withColumnRenamed("skill", "related").join(F.broadcast(seeds), "related", "left_semi"))
    nth = F.row_number().over(Window.partitionBy("skill").orderBy(F.desc("together"), "related"))
    floors = counts.withColumn("n", nth).filter(F.col("n") == top).select("skill", F.col("together").alias("floor"))
    return gaps.select("skill").distinct().join(floors, "skill", "left").fillna(1, ["floor"]), held


def related_pairs(skills: DataFrame, gaps: DataFrame, top: int = 3) -> DataFrame:
    """(resume_id, skill, related) rows that may matter for the ``top`` most related skills."""
    floors, held = related_floors(skills, gaps, top)
    owners = skills.join(floors, "skill")
    others = skills.withColumnRenamed("skill", "related").join(held, "related")
    # the bound is part of the join condition: pairs below it never become rows
    joined = owners.alias("o").join(others.alias("r"), (F.col("o.resume_id") == F.col("r.resume_id")) & (F.col("held") >= F.col("floor")) & (F.col("skill") != F.col("related")))
    return joined.select("o.resume_id", "skill", "related")


def _together(owners: DataFrame, others: DataFrame) -> DataFrame:
    pairs = owners.select("resume_id", "skill").join(others.select("resume_id", "related"), "resume_id").filter("skill <> related")
    return pairs.groupBy("skill", "related").agg(F.count("*").alias("together"))


def related_skills(skills: DataFrame, gaps: DataFrame, top: int = 3) -> DataFrame:
    """Skills most often held together with each missing skill.

    ``skills``: distinct (resume_id, skill) rows, ``gaps``: distinct (skill). Only rows of
    candidates who hold a missing skill are paired, within one candidate each, and only
    with skills held often enough to be among the best.
    """
    counts = related_pairs(skills, gaps, top).groupBy("skill", "related").agg(F.count("*").alias("together"))
    order = Window.partitionBy("skill").orderBy(F.desc("together"), "related")
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def recency_score(positions: Column, skills: Column) -> Column:
    """100/80 by the share of job skills in the latest position's text, 60 by the one before, else 40; 50 without data.

    ``positions``: array<struct<end:int, description:string>>; an open end counts as latest.
    """
    ordered = F.array_sort(F.transform(
        positions, lambda p, i: F.struct((-F.coalesce(p["end"], F.lit(9999))).alias("e"), i.alias("i"), F.lower(p["description"]).alias("d"))
    ))

    def share(text: Column) -> Column:
        return F.size(F.filter(skills, lambda s: F.contains(F.coalesce(text, F.lit("")), F.lower(s)))) / F.size(skills)

    def score(rows: Column) -> Column:
        first, second = share(F.get(rows, F.lit(0))["d"]), share(F.get(rows, F.lit(1))["d"])
        return (
            F.when(first >= 0.7, 100.0).when(first >= 0.3, 80.0).when((F.size(rows) > 1) & (second >= 0.5), 60.0).otherwise(40.0)
        )

    known = (F.coalesce(F.size(positions), F.lit(0)) > 0) & (F.coalesce(F.size(skills), F.lit(0)) > 0)
    return F.when(known, let(ordered, score)).otherwise(F.lit(50.0))


def experience_quality(positions: Column) -> Column:
    """Mean of relevance weighted by duration; array<struct<relevance:double, weight:double>>."""
    total = F.aggregate(positions, F.lit(0.0), lambda acc, p: acc + p["weight"])
    score = F.aggregate(positions, F.lit(0.0), lambda acc, p: acc + p["relevance"] * p["weight"])
    return F.when(total > 0, rounded(score / total, 4)).otherwise(F.lit(0.0))


def quality_by_key(rows: DataFrame, key: str, relevance: Column, weight: Column) -> DataFrame:
    """(key, quality): as :func:`experience_quality` for positions that come as rows; two sums, nothing is collected."""
    total = F.sum(weight)
    return rows.groupBy(key).agg(F.when(total > 0, rounded(F.sum(relevance * weight) / total, 4)).otherwise(F.lit(0.0)).alias("quality"))


def shifted_weights(weight: Column, quality: Column) -> Column:
    """A component's weight after poor data quality moved part of it to the search weight."""
    return F.when(quality < 0.5, weight - (0.5 - quality) * weight).otherwise(weight)


def fit_weights(feedback: DataFrame, features: list[str], label: str = "label"):
    """Weights of the components learnt from accepted and rejected results (distributed logistic regression)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    assembler = VectorAssembler(inputCols=features, outputCol="features")
    return Pipeline(stages=[assembler, LogisticRegression(labelCol=label, maxIter=20)]).fit(feedback)


def project_vectors(df: DataFrame, vector: str, k: int, out: str = "projected") -> DataFrame:
    """Vectors on their k principal components."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = df.withColumn("__v", array_to_vector(F.col(vector).cast("array<double>")))
    model = PCA(k=k, inputCol="__v", outputCol="__p").fit(rows)
    return model.transform(rows).withColumn(out, vector_to_array("__p")).drop("__v", "__p")
