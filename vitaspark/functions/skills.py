"""Skill spelling, matching and coverage as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let
from .lexicon import API_ALIASES, BATCH_ALIASES
from .scores import rounded


def _literal_map(entries: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


def _strip_marks_py(name: str) -> str:
    for old, new in ((".", ""), ("-", " "), ("/", " "), ("(", ""), (")", ""), (",", "")):
        name = name.replace(old, new)
    return name


# Keys are cleaned like the values looked up, so every alias can be reached.
BATCH_MAP = {_strip_marks_py(k): v for k, v in BATCH_ALIASES.items()}


def strip_marks(skill: Column) -> Column:
    """Lower, trim, drop ``. ( ) ,`` and turn ``- /`` into blanks."""
    return F.translate(F.lower(F.trim(skill)), "-/.(),", "  ")


def normalize_skill(skill: Column, profile: str = "batch") -> Column:
    """Canonical spelling of one skill under the batch or the api alias table."""
    if profile == "api":
        cleaned, table = F.lower(F.trim(skill)), API_ALIASES
    else:
        cleaned, table = strip_marks(skill), BATCH_MAP
    return F.coalesce(F.try_element_at(_literal_map(table), cleaned), cleaned)


def normalize_skills(skills: Column, profile: str = "batch") -> Column:
    return F.transform(skills, lambda s: normalize_skill(s, profile))


def _words(skill: Column) -> Column:
    return F.array_distinct(F.filter(F.split(skill, r"\s+"), lambda w: w != ""))


def word_overlap(left: Column, right: Column) -> Column:
    """Number of distinct words two skills share."""
    return F.size(F.array_intersect(_words(left), _words(right)))


def partial_weight(wanted: Column, held: Column) -> Column:
    """How much a held skill counts for a wanted one it does not equal."""
    common = word_overlap(wanted, held)
    multi = F.contains(wanted, F.lit(" ")) & F.contains(held, F.lit(" "))
    return (
        F.when((F.length(wanted) < 4) | (F.length(held) < 4), F.lit(0.0))
        .when(F.contains(held, wanted), F.lit(0.75))
        .when(F.contains(wanted, held), F.lit(0.5))
        .when(multi & ((common >= 2) | ((common == 1) & (F.size(_words(wanted)) <= 2))), F.lit(0.5))
        .otherwise(F.lit(0.0))
    )


def exact_count(wanted: Column, held: Column) -> Column:
    return F.size(F.filter(wanted, lambda w: F.array_contains(held, w)))


def partial_sum(wanted: Column, held: Column) -> Column:
    """Sum of partial weights; the first held skill that qualifies decides."""
    unmet = F.filter(wanted, lambda w: ~F.array_contains(held, w))
    per_skill = F.transform(
        unmet,
        lambda w: F.coalesce(
            F.get(F.filter(F.transform(held, lambda h: partial_weight(w, h)), lambda x: x > 0), F.lit(0)),
            F.lit(0.0),
        ),
    )
    return F.aggregate(per_skill, F.lit(0.0), lambda acc, x: acc + x)


def skill_match_score(wanted: Column, held: Column) -> Column:
    """0..100 match of normalised wanted (job) and held (candidate) skills."""
    size = F.size(wanted)
    exact = exact_count(wanted, held)
    score = (exact + partial_sum(wanted, held)) * 100.0 / size
    boosted = F.when(exact >= size * 0.7, F.least(score * 1.15, F.lit(100.0))).otherwise(score)
    return F.when((F.coalesce(size, F.lit(0)) > 0) & (F.size(held) > 0), rounded(boosted, 2)).otherwise(F.lit(0.0))


def matched_by_case(wanted: Column, held: Column) -> Column:
    return let(F.transform(held, F.lower), lambda low: F.filter(wanted, lambda s: F.array_contains(low, F.lower(s))))


def missing_by_case(wanted: Column, held: Column) -> Column:
    return let(F.transform(held, F.lower), lambda low: F.filter(wanted, lambda s: ~F.array_contains(low, F.lower(s))))


def missing_skills(wanted: Column, wanted_norm: Column, held_norm: Column) -> Column:
    """Wanted skills (job spelling) whose canonical form is not held."""
    return F.filter(wanted, lambda s, i: ~F.array_contains(held_norm, F.get(wanted_norm, i)))


def matching_skills(held: Column, held_norm: Column, wanted_norm: Column) -> Column:
    """Held skills (candidate spelling, repeats kept) whose canonical form is wanted."""
    return F.filter(held, lambda s, i: F.array_contains(wanted_norm, F.get(held_norm, i)))


def partial_pairs(wanted: Column, wanted_norm: Column, held: Column, held_norm: Column) -> Column:
    """All (required, resume) pairs related by substring, without exact matches."""
    rest = let(
        matching_skills(held, held_norm, wanted_norm),
        lambda matching: F.filter(
            F.arrays_zip(held.alias("s"), held_norm.alias("n")),
            lambda p: ~F.array_contains(matching, p["s"]) & (F.length(p["n"]) > 2),
        ),
    )
    required = F.filter(F.arrays_zip(wanted.alias("s"), wanted_norm.alias("n")), lambda p: F.length(p["n"]) > 2)

    def related(w: Column, others: Column) -> Column:
        near = F.filter(others, lambda h: F.contains(h["n"], w["n"]) | F.contains(w["n"], h["n"]))
        return F.transform(near, lambda h: F.struct(w["s"].alias("required"), h["s"].alias("resume")))

    return let(rest, lambda others: F.flatten(F.transform(required, lambda w: related(w, others))))


def coverage_percent(n_matching: Column, n_partial: Column, n_required: Column) -> Column:
    raw = (n_matching + n_partial * 0.5) / n_required * 100.0
    return F.when(n_required > 0, F.least(F.lit(100.0), rounded(raw, 1))).otherwise(F.lit(0.0))
