"""Repair of stored model responses that are not clean JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import extract, extract_all, first_of, let, once

FENCED = r"(?s)```(?:json)?\s*(\{.*?\})\s*```"
BRACES = r"\{[^{}]*+(?:\{[^{}]*+\}[^{}]*+)*+\}"
FIELDS = r'"([^"]+)":\s*(?:"([^"]*)"|\[([^\]]*)\]|(\d+))'
QUOTED = r'"([^"]+)"'


def as_object(text: Column) -> Column:
    """The text as JSON object text, trailing commas repaired; NULL when it is none."""
    repaired = F.regexp_replace(text, r",\s*([}\]])", "$1")

    def good(c: Column) -> Column:
        return F.when(F.json_object_keys(c).isNotNull() & F.try_parse_json(c).isNotNull(), c)

    return F.coalesce(good(text), good(repaired))


def n_keys(text: Column) -> Column:
    return F.coalesce(F.size(F.json_object_keys(text)), F.lit(0))


def salvage(response: Column) -> Column:
    """struct<method, json>: fenced block, whole text, braces with the most keys, then single fields."""
    rich = lambda c: n_keys(c) > 3
    fenced = first_of(F.filter(F.transform(extract_all(response, FENCED, 1), as_object), rich))
    body = F.regexp_replace(response, r"\A\s+|\s+\z", "")
    whole = F.when(body.rlike(r"(?s)\A\{.*\}\z"), as_object(body))
    candidates = F.transform(extract_all(response, BRACES), as_object)
    ranked = F.array_sort(F.transform(
        F.filter(candidates, lambda c: c.isNotNull()), lambda c, i: F.struct((-n_keys(c)).alias("n"), i.alias("i"), c.alias("json"))
    ))
    braces = first_of(ranked)["json"]
    keys = extract_all(response, FIELDS, 1)
    values = F.arrays_zip(keys.alias("k"), *[extract_all(response, FIELDS, g).alias(f"v{g}") for g in (2, 3, 4)])
    value = lambda m: F.coalesce(*[F.nullif(m[f"v{g}"], F.lit("")) for g in (2, 3, 4)], F.lit(""))
    last = lambda vs, k: F.element_at(F.filter(vs, lambda m: m["k"] == k), -1)
    entries = let(values, lambda vs: F.transform(
        F.array_distinct(F.transform(vs, lambda m: m["k"])), lambda k: F.struct(k.alias("key"), value(last(vs, k)).alias("value"))
    ))
    fields = let(entries, lambda es: F.when(F.size(es) > 3, F.to_json(F.map_from_entries(es))))
    method = (
        F.when(fenced.isNotNull(), "fenced").when(rich(whole), "whole").when(braces.isNotNull(), "braces")
        .when(fields.isNotNull(), "fields").otherwise("none")
    )
    json = F.when(fenced.isNotNull(), fenced).when(rich(whole), whole).otherwise(F.coalesce(braces, fields))
    return F.struct(method.alias("method"), json.alias("json"))


def string_array(text: Column) -> Column:
    """A JSON array of strings inside the text, else every quoted string."""
    inner = extract(text, r"(?s)(\[.*\])")
    return F.coalesce(F.from_json(inner, "array<string>"), extract_all(text, QUOTED, 1))


def salvage_responses(df: DataFrame, response: str = "response") -> DataFrame:
    """Add ``method`` and ``json``; rows that give nothing keep method ``none`` for the error sink."""
    return once(df, "__s", salvage(F.col(response))).withColumns({"method": F.col("__s.method"), "json": F.col("__s.json")}).drop("__s")
