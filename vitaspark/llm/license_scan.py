"""License notices in documents, by MinHash bands over windows of text. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitaspark.llm.common import NOT_WORD, folded

#: Words of a shingle, hash functions (one band of one row each), share of a template's shingles a match must hold.
SHINGLE, BANDS, CONTAINED = 3, 4, 0.8
#: Words a match may lie off its place, from words put in or left out.
SLACK = 3
#: Most template windows times bands: their keys are part of the scan's plan.
MOST_KEYS = 200_000

#: License notices looked for.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


def template_table(spark: SparkSession, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    pairs = [F.struct(F.lit(name).alias("license"), F.lit(text).alias("text")) for name, text in templates]
    return spark.range(1).select(F.inline(F.array(*pairs)))


def words(text: Column) -> Column:
    inner = F.regexp_replace(text, f"^{NOT_WORD}|{NOT_WORD}$", "")
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, NOT_WORD))


def shingles(found: Column, size: int) -> Column:
    """Hash of each run of ``size`` words; none in shorter texts."""
    hashed = F.transform(found, lambda w, i: F.xxhash64(w, *[F.get(found, i + j) for j in range(1, size)]))
    return F.slice(hashed, 1, F.greatest(F.size(found) - size + 1, F.lit(0)))


def computed(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """``keep`` and new columns, each computed once per row.

    A select would do but for the optimiser, which moves later filters below it
    and writes an array out again wherever it is used, inside lambdas as well.
    It leaves what a generator of one row makes alone.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def with_minima(df: DataFrame, hashes: str, window: int, bands: int) -> DataFrame:
    """Add m0, m1, ...: least value of each hash function over each window of so many shingles, a window at every shingle.

    Widths double by steps that pair a window with the next but so many.
    """
    names, rest = [f"m{b}" for b in range(bands)], df.columns
    out = computed(df, rest, **{n: _permuted(hashes, b) for b, n in enumerate(names)})
    width = 1
    while width < window:
        step = min(width, window - width)
        out = computed(out, rest, **{n: _paired(n, step) for n in names})
        width += step
    return out


def _permuted(hashes: str, band: int) -> Column:
    return F.transform(hashes, lambda h: F.xxhash64(h, F.lit(band)))


def _paired(least: str, step: int) -> Column:
    return F.zip_with(least, F.slice(least, step + 1, F.greatest(F.size(least) - step, F.lit(0))), lambda a, b: F.least(a, b))


def _among(values: list[int]):
    return lambda v: v.isin(values)


def _places(least: str, band: int, values: list[int]) -> Column:
    """Windows of a band whose value a template has, with their first shingle."""
    named = F.transform(least, lambda v, i: F.struct(F.lit(band).alias("band"), v.alias("value"), i.alias("at")))
    return F.filter(named, lambda s: s["value"].isin(values))


def license_matches(
    docs: DataFrame, templates: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, contained: float = CONTAINED, slack: int = SLACK,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, license, first_word, n_words, containment): every place where a template stands.

    Windows are as long as the shortest template, counted in shingles, and
    begin at every word of a document; a template has such windows as well. Two
    windows of similarity J share one of the bands with probability
    1 - (1 - J)**bands: a window left as it was collides for certain, one of
    similarity 0.8 misses with 0.0016 at 4 bands. Every collision names a
    template and a place; there the share of the template's shingles is counted
    exactly. A place is a match if no better one, by that share and then by the
    shingles that stand exactly where the template has them, lies within the
    template's length.

    The scan keeps documents with a colliding window and shuffles none of the
    others. Templates with fewer words than a shingle match nothing. Null and
    empty texts have no match, repeated rows (same id and text) match once.
    """
    listed = computed(computed(templates.select("license", "text"), ["license"], w=words(folded("text"))), ["license"], template=shingles(F.col("w"), shingle), n_words=F.size("w"))
    listed = listed.filter(F.size("template") > 0)
    window, longest = listed.agg(F.min(F.size("template")), F.max("n_words")).first()
    if window is None:
        return docs.limit(0).select(
            F.col(id_col).cast("long").alias("doc_id"), F.lit("").alias("license"), F.lit(0).alias("first_word"), F.lit(0).alias("n_words"), F.lit(0.0).alias("containment")
        )
    inside = F.size("template") - window + 1
    own = F.array(*[F.slice(f"m{b}", 1, inside) for b in range(bands)])
    asked = with_minima(listed, "template", window, bands).select(
        "license", F.array_distinct("template").alias("template"), F.col("template").alias("sequence"), "n_words", F.posexplode(own).alias("band", "values")
    ).select("license", "template", "sequence", "n_words", "band", F.posexplode("values").alias("offset", "value"))
    rows = asked.select("band", "value").distinct().collect()
    if len(rows) > MOST_KEYS:
        raise ValueError(f"{len(rows)} template keys: scan for a part of the templates at a time")
    wanted = [[r["value"] for r in rows if r["band"] == b] for b in range(bands)]

    scanned = docs.select(F.col(id_col).cast("long").alias("doc_id"), folded(text_col).alias("text"))
    scanned = computed(scanned, ["doc_id"], print=F.xxhash64("text"), w=words(F.col("text")))
    scanned = computed(scanned, ["doc_id", "print"], h=shingles(F.col("w"), shingle))
    scanned = with_minima(scanned, "h", window, bands)
    collides = [F.exists(f"m{b}", _among(wanted[b])) for b in range(bands)]
    around = longest + slack
    places = F.flatten(F.array(*[_places(f"m{b}", b, wanted[b]) for b in range(bands)]))
    hit = scanned.filter(F.array_contains(F.array(*collides), True)).select(
        "doc_id", "print",
        F.explode(F.transform(places, lambda s: F.struct(
            s["band"].alias("band"), s["value"].alias("value"), s["at"].alias("at"), F.greatest(s["at"] - around, F.lit(0)).alias("from"),
            F.slice("h", F.greatest(s["at"] - around, F.lit(0)) + 1, 2 * around + 1).alias("near"),
        ))).alias("hit"),
    ).select("doc_id", "print", "hit.*")
    met = hit.join(asked, ["band", "value"]).withColumn("place", F.col("at") - F.col("offset"))
    start = F.greatest(F.col("place") - slack - F.col("from"), F.lit(0))
    stop = F.col("place") + F.col("n_words") - shingle + 1 + slack - F.col("from")
    held = F.size(F.array_intersect("template", F.slice("near", start + 1, F.greatest(stop - start, F.lit(0)))))
    in_place = F.size(F.filter(F.transform("sequence", lambda t, i: F.get("near", F.col("place") - F.col("from") + i).eqNullSafe(t)), lambda same: same))
    matched = (
        met.withColumn("containment", held / F.size("template")).filter(F.col("containment") >= contained)
        .groupBy("doc_id", "print", "license", "n_words", "place").agg(F.max("containment").alias("containment"), F.max(in_place).alias("in_place"))
        .withColumn("worth", F.struct("containment", "in_place", (-F.col("place")).alias("early")))
    )
    # places less than a template's length apart compete; places are counted in millionths of that length
    near_by = Window.partitionBy("doc_id", "print", "license").orderBy(F.floor(F.col("place").cast("long") * 1_000_000 / F.col("n_words"))).rangeBetween(-999_999, 999_999)
    return matched.withColumn("best", F.max("worth").over(near_by)).filter("worth = best").select(
        "doc_id", "license", F.greatest("place", F.lit(0)).alias("first_word"), "n_words", "containment"
    )


def licenses(docs: DataFrame, templates: DataFrame, **options) -> DataFrame:
    """Per document and license: places and best containment."""
    found = license_matches(docs, templates, **options)
    return found.groupBy("doc_id", "license").agg(F.count("*").alias("places"), F.max("containment").alias("containment"))


def sql(templates: list[tuple[str, str]] = TEMPLATES) -> str:
    """The counts of :func:`licenses` in DuckDB SQL, from every shared shingle instead of bands."""
    rows = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in templates)
    fold = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    split = rf"regexp_extract_all({fold}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
with tw as (select license, {split} as w from (values {rows}) t(license, text)),
ts as (select license, len(w) as n_words, i - 1 as off, array_to_string(w[i:i + {SHINGLE - 1}], ' ') as s from (select *, unnest(range(1, len(w) - {SHINGLE - 2})) as i from tw)),
tn as (select license, count(distinct s) as n from ts group by license),
dw as (select doc_id, {split} as w from documents),
ds as (select doc_id, i - 1 as pos, array_to_string(w[i:i + {SHINGLE - 1}], ' ') as s from (select *, unnest(range(1, greatest(len(w) - {SHINGLE - 2}, 1))) as i from dw)),
met as (select doc_id, license, n_words, pos, off, s from ds join ts using (s)),
places as (select distinct doc_id, license, n_words, pos - off as place from met),
held as (select p.doc_id, p.license, p.n_words, p.place, count(distinct m.s) as k from places p join met m on p.doc_id = m.doc_id and p.license = m.license
  and m.pos >= p.place - {SLACK} and m.pos < p.place + p.n_words - {SHINGLE - 1} + {SLACK} group by all),
good as (select h.*, k / n as containment from held h join tn using (license) where k / n >= {CONTAINED}),
aligned as (select g.*, (select count(*) from met m where m.doc_id = g.doc_id and m.license = g.license and m.pos - m.off = g.place) as in_place from good g),
marked as (select *, not exists (select 1 from aligned b where b.doc_id = a.doc_id and b.license = a.license and abs(b.place - a.place) < a.n_words
  and (b.containment, b.in_place, -b.place) > (a.containment, a.in_place, -a.place)) as fresh from aligned a)
select doc_id, license, count(*) as places, max(containment) as containment from marked where fresh group by doc_id, license
"""
