"""Column helpers for ordered arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def empty_strings() -> Column:
    return F.array().cast("array<string>")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value`` computed once, also when ``body`` uses it inside lambdas
    (a plain column would be computed again for every element)."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with column ``name``, computed once a row and where it stands.

    A plain column is put into every expression that reads it, and a filter on
    it moves below a repartition; neither goes through a generated column.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def first_wins(values: Column, key: Callable[[Column], Column] = F.lower) -> Column:
    """Drop later elements whose key was seen before; order and spelling stay.

    Positions of the keys decide, so no accumulator array is copied per step:
    an element stays when the first position of its key is its own position.
    """
    def kept(items: Column) -> Column:
        return let(
            F.transform(items, key),
            lambda keys: F.filter(items, lambda v, i: F.array_position(keys, F.get(keys, i)) == i.cast("bigint") + 1),
        )

    return let(values, kept)


def joined(values: Column, limit: int, sep: str = ", ") -> Column:
    """First ``limit`` elements joined, followed by `` and N more`` when cut."""
    return F.concat(
        F.array_join(F.slice(values, 1, limit), sep),
        F.when(F.size(values) > limit, F.concat(F.lit(" and "), (F.size(values) - limit).cast("string"), F.lit(" more")))
        .otherwise(F.lit("")),
    )


def split_trimmed(text: Column, pattern: str = ",") -> Column:
    """Split on a regex, trim, drop blanks."""
    return F.filter(F.transform(F.split(text, pattern), lambda s: F.trim(s)), lambda s: s != "")


def blank_to_null(value: Column) -> Column:
    return F.when(F.trim(value) != "", value)


def extract(text: Column, pattern: str, group: int = 1) -> Column:
    """``regexp_extract`` that gives NULL, not '', when nothing is found."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def extract_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def first_of(values: Column) -> Column:
    return F.get(values, F.lit(0))
