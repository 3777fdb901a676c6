"""Score formulas: experience, position, normalisers, weighted reranks."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from .arrays import joined
from .lexicon import MIN_RANGE, WEIGHT_PROFILES


def rounded(value: Column, digits: int) -> Column:
    """Round half to even on the stored double; stays in generated code."""
    scale = float(10**digits)
    return F.rint(value * scale) / scale


def experience_score(have: Column, need: Column) -> Column:
    return F.when(have >= need, F.lit(100.0)).when(need > 0, rounded(have / need * 100.0, 2)).otherwise(F.lit(0.0))


def guarded_experience_score(have: Column, need: Column) -> Column:
    """As in reranking: no requirement counts 0, not 100."""
    return F.when(need > 0, experience_score(have, need)).otherwise(F.lit(0.0))


def experience_difference(have: Column, need: Column) -> Column:
    return rounded(have - need, 1)


def position_score(title: Column, positions: Column) -> Column:
    """100 for an equal past title, 70 for one containing the other, else 0."""
    want = F.lower(title)
    equal = F.exists(positions, lambda p: F.lower(p) == want)
    inside = F.exists(positions, lambda p: F.contains(F.lower(p), want) | F.contains(want, F.lower(p)))
    known = F.coalesce(title, F.lit("")) != ""
    return F.when(known & equal, F.lit(100.0)).when(known & inside, F.lit(70.0)).otherwise(F.lit(0.0))


def minmax_percent(score: Column, *partition: str) -> Column:
    """0..100 position of a score in its pool."""
    w = Window.partitionBy(*partition)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return (score - low) / F.greatest(high - low, F.lit(MIN_RANGE)) * 100.0


def signed_minmax_percent(score: Column, *partition: str) -> Column:
    """As :func:`minmax_percent`; negative scores are measured against the lowest."""
    low = F.min(score).over(Window.partitionBy(*partition))
    negative = (1.0 - F.abs(score) / (F.abs(low) + MIN_RANGE)) * 100.0
    return F.when(score < 0, negative).otherwise(minmax_percent(score, *partition))


def max_percent(score: Column, *partition: str) -> Column:
    top = F.max(score).over(Window.partitionBy(*partition))
    return F.least(rounded(score / top * 100.0, 2), F.lit(100.0))


def logistic_percent(percent: Column, steepness: float) -> Column:
    squashed = 100.0 / (1.0 + F.exp(-(percent / 100.0 - 0.5) * steepness))
    return F.least(rounded(squashed, 2), F.lit(100.0))


def flat_minmax_percent(score: Column, *partition: str) -> Column:
    """Min-max percent where a constant pool gives 50."""
    w = Window.partitionBy(*partition)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high == low, F.lit(50.0)).otherwise((score - low) / (high - low) * 100.0)


def weighted_score(
    profile: str, search: Column, skill: Column, position: Column, experience: Column, meets: Column | None = None
) -> Column:
    """Weighted rerank score of one of the stored profiles."""
    w_search, w_skill, w_pos, w_exp, penalty = WEIGHT_PROFILES[profile]
    total = search * w_search + skill * w_skill + position * w_pos + experience * w_exp
    if penalty != 1.0:
        total = total * F.when(meets, F.lit(1.0)).otherwise(F.lit(penalty))
    return F.least(rounded(total, 2), F.lit(100.0))


def pool_size(k: Column, most: int | None = None) -> Column:
    """Three times the results asked for, at least 30; ``most`` is a caller's policy."""
    size = F.greatest(k * 3, F.lit(30))
    return size if most is None else F.least(size, F.lit(most))


def clamp_results(k: Column, default: int = 30, most: int | None = None) -> Column:
    """Results asked for, at least one; ``most`` is a caller's policy."""
    asked = F.greatest(F.coalesce(k, F.lit(default)), F.lit(1))
    return asked if most is None else F.least(asked, F.lit(most))


def candidate_analysis(
    overall: Column, experience: Column, years: Column, required: Column,
    coverage: Column, position: Column, missing: Column,
) -> Column:
    """Templated strengths and gaps text of one candidate."""
    bullet = "• "
    years_s, req_s, cov_s = years.cast("string"), required.cast("string"), coverage.cast("string")
    has = F.concat(F.lit("Has "), years_s, F.lit(" years of experience, "))
    exp_point = (
        F.when(experience >= 90, F.concat(has, F.lit("exceeding the required "), req_s, F.lit(" years")))
        .when(experience >= 70, F.concat(F.lit("Meets the experience requirement of "), req_s, F.lit(" years")))
        .otherwise(F.concat(has, F.lit("below the required "), req_s, F.lit(" years")))
    )
    skill_point = (
        F.when(coverage >= 90, F.concat(F.lit("Possesses nearly all required skills ("), cov_s, F.lit("% coverage)")))
        .when(coverage >= 70, F.concat(F.lit("Has good coverage of required skills ("), cov_s, F.lit("%)")))
        .otherwise(
            F.concat(F.lit("Missing several key skills ("), rounded(100.0 - coverage, 1).cast("string"), F.lit("% gap)"))
        )
    )
    title_point = F.lit("Has directly relevant job titles matching the position")

    def block(heading: str, points: list[Column]) -> Column:
        lines = F.array_compact(F.array(*points))
        text = F.array_join(F.transform(lines, lambda p: F.concat(F.lit(bullet), p, F.lit("\n"))), "")
        return F.when(F.size(lines) > 0, F.concat(F.lit(heading + "\n"), text, F.lit("\n"))).otherwise(F.lit(""))

    strengths = block(
        "Key strengths:",
        [
            F.when(experience >= 70, exp_point),
            F.when(coverage >= 70, skill_point),
            F.when(position >= 80, title_point),
        ],
    )
    concerns = block(
        "Areas for consideration:",
        [F.when(experience < 70, exp_point), F.when(coverage < 70, skill_point)],
    )
    gaps = F.when(F.size(missing) > 0, F.concat(F.lit("Missing skills: "), joined(missing, 5))).otherwise(F.lit(""))
    head = F.concat(F.lit("Overall Match: "), F.format_string("%.1f", rounded(overall, 1)), F.lit("%\n\n"))
    return F.concat(head, strengths, concerns, gaps)
