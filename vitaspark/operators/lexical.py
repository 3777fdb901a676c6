"""Text retrieval: postings, corpus statistics, fuzzy expansion, BM25 per field.

Scores follow Okapi BM25 (Robertson and Zaragoza 2009) per field. Fuzzy
candidates come from the pigeonhole rule of Pass-Join (Li, Deng, Wang, Feng
2011): cut a term into d+1 pieces and any string within d edits holds one of
them nearly in place, so blocking on pieces loses nothing.

Layout: query-side tables (terms, expansions, weights) depend on the jobs and
travel to the documents in passes of bounded size. A document's terms are
shuffled once, as arrays, by document; its scores for all jobs of a pass are
summed in arrays, so a frequent term cannot overload a task and pairs are
neither hashed nor sorted nor shuffled before the cut to the best.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lexicon import BM25_B, BM25_K1, TIE_BREAKER
from ..functions.text import phrase_key, tokens
from ..plans.sizing import checked_broadcast
from ..session import ensure_checkpoint_dir
from .vector_search import JOB_TILE, _merged, top_per_job

# The task functions travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def field_tokens(docs: DataFrame, fields: list[str], key: str = "resume_id") -> DataFrame:
    """One row per (document, field) with its tokens; array fields are read as one text."""
    types = dict(docs.dtypes)

    def as_text(name: str) -> Column:
        return F.array_join(F.col(name), " ") if types[name].startswith("array") else F.col(name)

    entries = F.array(*[F.struct(F.lit(f).alias("field"), tokens(as_text(f)).alias("toks")) for f in fields])
    return docs.select(key, F.inline(entries)).filter(F.size("toks") > 0)


def postings(docs: DataFrame, fields: list[str], key: str = "resume_id") -> DataFrame:
    """(document, field, term, field length), one row per token."""
    return field_tokens(docs, fields, key).select(key, "field", F.size("toks").alias("len"), F.explode("toks").alias("term"))


def query_terms(jobs: DataFrame, text: Column, key: str = "jd_id") -> DataFrame:
    """(job, term, times in the query)."""
    return jobs.select(key, F.explode(tokens(text)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("qtf"))


def dictionary(docs: DataFrame, fields: list[str], terms: DataFrame | None = None, key: str = "resume_id") -> DataFrame:
    """(field, term, df, tokens) of the corpus, optionally of the given terms only.

    Each document adds the empty term once per field, so that the row of ''
    carries the field's document count and token total and one pass serves
    both the term counts and the field statistics.
    """
    rows = field_tokens(docs, fields, key).select(
        "field", F.size("toks").alias("len"), F.explode(F.array_append(F.array_distinct("toks"), F.lit(""))).alias("term")
    )
    if terms is not None:
        wanted = terms.select("term").unionByName(docs.sparkSession.range(1).select(F.lit("").alias("term")))
        rows = rows.join(checked_broadcast(wanted), "term", "left_semi")
    return rows.groupBy("field", "term").agg(
        F.count("*").alias("df"), F.sum(F.when(F.col("term") == "", F.col("len"))).alias("tokens")
    )


def merge_dictionaries(parts: DataFrame) -> DataFrame:
    """One dictionary of the rows of several, whose documents differ: counts and lengths add up."""
    return parts.groupBy("field", "term").agg(F.sum("df").alias("df"), F.sum("tokens").alias("tokens"))


def corpus_stats(terms: DataFrame) -> DataFrame:
    """(field, n_docs, avg_len) from a dictionary."""
    return terms.filter("term = ''").select("field", F.col("df").alias("n_docs"), (F.col("tokens") / F.col("df")).alias("avg_len"))


def term_frequencies(terms: DataFrame) -> DataFrame:
    """(field, term, df) from a dictionary."""
    return terms.filter("term <> ''").select("field", "term", "df")


def allowed_edits(term: Column) -> Column:
    """AUTO:4,7 - exact below four characters, one edit up to six, two from seven."""
    n = F.length(term)
    return F.when(n < 4, F.lit(0)).when(n < 7, F.lit(1)).otherwise(F.lit(2))


def _piece_start(length: Column, edits: Column, i: Column) -> Column:
    """1-based start of piece ``i`` when ``length`` is cut into ``edits + 1`` pieces, long ones last."""
    n = edits + 1
    base = F.floor(length / n)
    short = n - length % n
    return (i * base + F.greatest(i - short, F.lit(0)) + 1).cast("int")


def _piece_len(length: Column, edits: Column, i: Column) -> Column:
    n = edits + 1
    return (F.floor(length / n) + F.when(i >= n - length % n, 1).otherwise(0)).cast("int")


def fuzzy_pairs(wanted: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(wanted, term, edits) for every vocabulary term within the edits a wanted term allows.

    Both inputs have one distinct column ``term``. Exact pairs have 0 edits. A
    piece may sit ``s`` places off where ``|s| + |length difference - s|`` stays
    within the edits, which bounds the probes per term.
    """
    exact = wanted.join(vocabulary, "term").select(F.col("term").alias("wanted"), "term", F.lit(0).alias("edits"))
    pieces = (
        wanted.withColumn("d", allowed_edits(F.col("term")))
        .filter(F.col("d") > 0)
        .withColumn("qlen", F.length("term"))
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("d"))))
        .select(
            F.col("term").alias("wanted"), "d", "qlen", "i",
            F.substring(
                F.col("term"),
                _piece_start(F.col("qlen"), F.col("d"), F.col("i")),
                _piece_len(F.col("qlen"), F.col("d"), F.col("i")),
            ).alias("piece"),
        )
    )
    size = F.length("term")
    probes = (
        vocabulary.filter(size >= 3)
        .withColumn("qlen", F.explode(F.sequence(F.greatest(size - 2, F.lit(4)), size + 2)))
        .withColumn("d", F.when(F.col("qlen") < 7, 1).otherwise(2))
        .filter(F.abs(size - F.col("qlen")) <= F.col("d"))
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("d"))))
        .withColumn("p", _piece_start(F.col("qlen"), F.col("d"), F.col("i")))
        .withColumn("n", _piece_len(F.col("qlen"), F.col("d"), F.col("i")))
        .withColumn("longer", size - F.col("qlen"))
        .withColumn("low", F.greatest(F.col("p") - F.floor((F.col("d") - F.col("longer")) / 2).cast("int"), F.lit(1)))
        .withColumn("high", F.least(F.col("p") + F.floor((F.col("d") + F.col("longer")) / 2).cast("int"), size - F.col("n") + 1))
        .filter(F.col("low") <= F.col("high"))
        .withColumn("at", F.explode(F.sequence("low", "high")))
        .select("term", "qlen", "i", F.substring(F.col("term"), F.col("at"), F.col("n")).alias("piece"))
    )
    near = (
        probes.join(checked_broadcast(pieces), ["qlen", "i", "piece"])
        .select("wanted", "term", F.levenshtein("wanted", "term", 2).alias("edits"), "d")
        .filter((F.col("edits") > 0) & (F.col("edits") <= F.col("d")))
        .select("wanted", "term", "edits")
        .distinct()
    )
    return exact.unionByName(near)


def term_weights(terms: DataFrame, docs: DataFrame, fields: list[str], *, fuzzy: bool, key: str = "resume_id") -> DataFrame:
    """(job, field, term, idf, exact, near, avg_len): what one occurrence of a corpus term is worth to a job.

    ``exact`` counts the term itself, ``near`` also the similar terms, each at
    ``1 - edits / shorter length``.
    """
    return counted_weights(terms, stable(dictionary(docs, fields, None if fuzzy else terms.select("term").distinct(), key)), fuzzy=fuzzy)


def counted_weights(terms: DataFrame, corpus: DataFrame, *, fuzzy: bool) -> DataFrame:
    """:func:`term_weights` from a dictionary that holds the wanted terms, with ``fuzzy`` all terms."""
    wanted = terms.select("term").distinct()
    if fuzzy:
        pairs = fuzzy_pairs(wanted, term_frequencies(corpus).select("term").distinct())
    else:
        pairs = wanted.select(F.col("term").alias("wanted"), "term", F.lit(0).alias("edits"))
    similarity = 1.0 - F.col("edits") / F.least(F.length("wanted"), F.length("term"))
    expanded = (
        terms.withColumnRenamed("term", "wanted")
        .join(pairs, "wanted")
        .groupBy("jd_id", "term")
        .agg(
            F.sum(F.when(F.col("edits") == 0, F.col("qtf")).otherwise(0)).cast("double").alias("exact"),
            F.sum(F.col("qtf") * similarity).alias("near"),
        )
    )
    stats = corpus_stats(corpus)
    idf = F.log(1.0 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = (
        term_frequencies(corpus).join(F.broadcast(stats), "field")
        .select("field", "term", "avg_len", idf.alias("idf"))
    )
    return expanded.join(weighted, "term").select("jd_id", "field", "term", "idf", "exact", "near", "avg_len")


def text_evidence(docs: DataFrame, fields: list[str], key: str = "resume_id") -> DataFrame:
    """Evidence rows (document, field, len, terms, value), one per document and field."""
    return field_tokens(docs, fields, key).select(
        key, "field", F.size("toks").alias("len"), F.col("toks").alias("terms"), F.lit(None).cast("double").alias("value")
    )


def phrase_evidence(docs: DataFrame, key: str = "resume_id") -> DataFrame:
    """Contiguous token runs of each skill, so that a phrase match is an equality."""
    size = F.size("toks")
    runs = F.transform(F.sequence(F.lit(1), size - F.col("at") + 1), lambda n: F.array_join(F.slice("toks", F.col("at"), n), " "))
    return (
        docs.select(key, F.explode("skills").alias("skill"))
        .select(key, tokens(F.col("skill")).alias("toks"))
        .filter(size > 0)
        .withColumn("at", F.explode(F.sequence(F.lit(1), size)))
        .select(key, F.lit("phrase").alias("field"), F.lit(1).alias("len"), runs.alias("terms"), F.lit(1.0).alias("value"))
    )


def vector_evidence(nearest: DataFrame, key: str = "resume_id") -> DataFrame:
    """Nearest-neighbour hits (jd_id, document, cosine) in the shape of evidence."""
    return nearest.select(
        key, F.lit("vector").alias("field"), F.lit(1).alias("len"), F.array(F.col("jd_id").cast("string")).alias("terms"),
        F.col("cosine").alias("value"),
    )


def _plain_weights(rows: DataFrame) -> DataFrame:
    return rows.select(
        "jd_id", "field", "term", F.lit(1.0).alias("idf"), "exact", F.lit(0.0).alias("near"), F.lit(1.0).alias("avg_len")
    )


def phrase_weights(jobs: DataFrame, terms: Column) -> DataFrame:
    phrases = jobs.select("jd_id", F.explode(terms).alias("t")).select("jd_id", phrase_key(F.col("t")).alias("term"))
    counted = phrases.filter("term <> ''").groupBy("jd_id", "term").agg(F.count("*").cast("double").alias("exact"))
    return _plain_weights(counted.withColumn("field", F.lit("phrase")))


def vector_weights(jobs: DataFrame) -> DataFrame:
    return _plain_weights(
        jobs.select("jd_id", F.lit("vector").alias("field"), F.col("jd_id").cast("string").alias("term"), F.lit(1.0).alias("exact"))
    )


#: Weights a task may hold for the jobs of one pass, and best scores so far.
MAX_WEIGHTS, MAX_BEST = 4_000_000, 8_000_000
#: Tokens read and products summed at a time.
MAX_TOKENS, MAX_PRODUCTS = 1_000_000, 2_000_000


class Weights:
    """Weights of the jobs of one pass: wanted terms by field, and per term its idf and the jobs that ask for it."""

    def __init__(self, **parts):
        self.__dict__ |= parts

    @classmethod
    def of(cls, table: pa.Table) -> "Weights":
        self = cls()
        jobs = table.column("jd_id").combine_chunks().dictionary_encode(null_encoding="encode")
        self.jobs, job = jobs.dictionary, jobs.indices.to_numpy()
        self.fields = sorted(set(table.column("field").to_pylist()))
        field = pc.index_in(table.column("field").combine_chunks(), pa.array(self.fields, pa.string())).to_numpy()
        self.terms, self.first, number = [], [0], np.zeros(len(table), np.int64)
        for f in range(len(self.fields)):
            coded = table.column("term").combine_chunks().filter(pa.array(field == f)).dictionary_encode()
            number[field == f] = coded.indices.to_numpy() + self.first[-1]
            self.terms.append(coded.dictionary)
            self.first.append(self.first[-1] + len(coded.dictionary))
        n = self.first[-1]
        self.idf, self.avg_len, self.field_of = np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
        self.idf[number], self.avg_len[number], self.field_of[number] = table.column("idf").to_numpy(), table.column("avg_len").to_numpy(), field
        order = np.argsort(number, kind="stable")
        self.begin = np.searchsorted(number[order], np.arange(n + 1))
        self.job, self.exact, self.near = job[order], table.column("exact").to_numpy()[order], table.column("near").to_numpy()[order]
        return self

    def postings(self, rows: pa.Table, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, term, worth) of the wanted terms of evidence rows, by document."""
        lists = rows.column("terms").combine_chunks()
        row, flat = pc.list_parent_indices(lists).to_numpy(), lists.flatten()
        field = pc.fill_null(pc.index_in(rows.column("field").combine_chunks(), pa.array(self.fields, pa.string())), -1).to_numpy()[row]
        term = np.full(len(flat), -1, np.int64)
        for f, known in enumerate(self.terms):
            mine = field == f
            found = pc.fill_null(pc.index_in(flat.filter(pa.array(mine)), known), -1).to_numpy().astype(np.int64)
            term[mine] = np.where(found >= 0, found + self.first[f], -1)
        kept = np.flatnonzero(term >= 0)
        term, row = term[kept], row[kept]
        length, value = rows.column("len").to_numpy()[row], pc.fill_null(rows.column("value"), np.nan).to_numpy()[row]
        order = np.lexsort((length, term, doc[row]))
        term, doc, length, value = term[order], doc[row][order], length[order], value[order]
        new = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (doc[1:] != doc[:-1]) | (length[1:] != length[:-1])])) if len(term) else order
        tf = np.diff(np.append(new, len(term))).astype(np.float64)
        value = np.fmax.reduceat(value, new) if len(new) else value
        term, doc, length = term[new], doc[new], length[new]
        saturated = tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * length / self.avg_len[term]))
        return doc, term, np.where(np.isnan(value), self.idf[term] * saturated, value)

    def sums(self, doc: np.ndarray, term: np.ndarray, worth: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Per block of documents: (its first, hits, exact, near), each by document, field and job."""
        held, cells = self.begin[term + 1] - self.begin[term], max(len(self.fields) * len(self.jobs), 1)
        products = np.cumsum(held)
        at = 0
        while at < len(doc):
            first, done = doc[at], products[at - 1] if at else 0
            full = max(int(np.searchsorted(products, done + MAX_PRODUCTS)), at)
            last = max(int(doc[min(full, len(doc) - 1)]) - (full < len(doc)), first)
            end = int(np.searchsorted(doc, min(last, first + MAX_PRODUCTS // cells), "right"))
            n = held[at:end]
            each = np.repeat(np.arange(at, end), n)
            place = self.begin[term[each]] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
            cell = (doc[each] - first) * cells + self.field_of[term[each]] * len(self.jobs) + self.job[place]
            shape = (int(doc[end - 1] - first) + 1, len(self.fields), len(self.jobs))
            size = shape[0] * cells
            yield int(first), *(x.reshape(shape) for x in (
                np.bincount(cell, minlength=size), np.bincount(cell, worth[each] * self.exact[place], size), np.bincount(cell, worth[each] * self.near[place], size)
            ))
            at = end


def _documents(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, pa.Array, np.ndarray]]:
    """(rows, documents, index of each row's document) of whole documents, which come in order, of bounded size where a document allows it."""
    waiting: list[pa.RecordBatch] = []
    for batch in chain(batches, [None]):
        if batch is not None:
            if not batch.num_rows:
                continue
            waiting.append(batch)
            if sum(b.num_rows for b in waiting) > 1 and batch.column(key)[batch.num_rows - 1].equals(waiting[0].column(key)[0]):
                continue  # one document so far
        if not waiting:
            return
        rows = pa.Table.from_batches(waiting)
        coded = rows.column(key).combine_chunks().dictionary_encode(null_encoding="encode")
        doc = coded.indices.to_numpy()
        whole = len(doc) if batch is None else int(np.searchsorted(doc, doc[-1]))
        waiting = rows.slice(whole).combine_chunks().to_batches()
        tokens_before = np.concatenate([[0], np.cumsum(pc.list_value_length(rows.column("terms")).to_numpy())])
        at = 0
        while at < whole:
            end = int(np.searchsorted(tokens_before, tokens_before[at] + MAX_TOKENS))
            end = int(np.searchsorted(doc, doc[min(max(end, at), whole - 1)], "right")) if end < whole else whole
            yield rows.slice(at, end - at), coded.dictionary, doc[at:end]
            at = end


def _scored(
    evidence: DataFrame, weights: DataFrame, key: str, columns: list[tuple[str, T.DataType]], k: int, each: Callable,
) -> DataFrame:
    """``each(weights, blocks)`` over the evidence of every document, jobs in as many passes as their bounded weights need.

    Evidence is shuffled once, by document, as arrays of terms. The weights
    travel to it; products are summed in arrays, so no pair becomes a row of a
    shuffle or of a hash table.
    """
    rows, jobs = weights.agg(F.count("*"), F.count_distinct("jd_id")).first()
    passes = max(-(-rows // MAX_WEIGHTS), -(-jobs * k // MAX_BEST), 1)
    dealt = evidence.repartition(key).sortWithinPartitions(key)
    kinds = {"jd_id": weights.schema["jd_id"].dataType, key: evidence.schema[key].dataType}
    schema = T.StructType([T.StructField(n, kinds.get(n, t)) for n, t in columns])
    part = F.pmod(F.xxhash64("jd_id"), F.lit(passes))

    def one(number: int) -> DataFrame:
        mine = weights.filter(part == number).select("jd_id", "field", "term", "idf", "avg_len", "exact", "near")
        shared = evidence.sparkSession.sparkContext.broadcast(vars(Weights.of(mine.toArrow())))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = Weights(**shared.value)

            def blocks():
                for found, names, doc in _documents(batches, key):
                    for first, *sums in held.sums(*held.postings(found, doc)):
                        yield names.slice(first), *sums

            if len(held.jobs):
                for columns in each(held, blocks()):
                    yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

        return dealt.mapInArrow(score, schema)

    return reduce(DataFrame.unionByName, [one(p) for p in range(passes)])


def field_scores(evidence: DataFrame, weights: DataFrame, key: str = "resume_id") -> DataFrame:
    """(job, document, field, exact, near): worth of each field of every matching pair.

    Text evidence is scored by BM25; evidence that carries a value counts with it.
    """
    def rows(held: Weights, blocks: Iterator) -> Iterator[list[pa.Array]]:
        names = pa.array(held.fields, pa.string())
        for docs, hits, exact, near in blocks:
            doc, field, job = np.nonzero(hits)
            yield [docs.take(pa.array(doc)), held.jobs.take(pa.array(job)), names.take(pa.array(field)), pa.array(exact[doc, field, job]), pa.array(near[doc, field, job])]

    return _scored(evidence, weights, key, [(key, None), ("jd_id", None), ("field", T.StringType()), ("exact", T.DoubleType()), ("near", T.DoubleType())], 0, rows)


def pair_scores(
    evidence: DataFrame, weights: DataFrame, exact_boosts: dict[str, float], best_fields: dict[str, float], key: str = "resume_id", k: int | None = None,
) -> DataFrame:
    """(document, jd_id, raw_score, fields): scores of :func:`combine_fields` over :func:`field_scores` and how many fields match.

    With ``k`` a task only hands on its k best of each job, ties by document, so all that can be among a job's k best.
    """
    def rows(held: Weights, blocks: Iterator) -> Iterator[list[pa.Array]]:
        clause, best = (np.array([boosts.get(f, 0.0) for f in held.fields])[None, :, None] for boosts in (exact_boosts, best_fields))
        kept, which = np.full((len(held.jobs), k or 0), -np.inf), None
        for docs, hits, exact, near in blocks:
            near = near * best
            top, total = near.max(axis=1), near.sum(axis=1)
            score = np.rint(((exact * clause).sum(axis=1) + top + (total - top) * TIE_BREAKER) * 1e9) / 1e9
            fields = np.count_nonzero(hits, axis=1)
            docs = docs.slice(0, len(score))
            doc, job = np.nonzero(fields)
            if k is not None:
                named = pc.is_valid(docs).to_numpy(zero_copy_only=False)
                doc, job = (x[~named[doc]] for x in (doc, job))  # the document without an id goes on as it is
                ids = docs.filter(pa.array(named)).to_numpy(zero_copy_only=False)
                if len(ids):
                    which = np.full(kept.shape, ids[0], ids.dtype) if which is None else which
                    kept, which = _merged(kept, which, np.where(fields > 0, score, -np.inf)[named].T, ids, k)
            if len(doc):
                yield [docs.take(pa.array(doc)), held.jobs.take(pa.array(job)), pa.array(score[doc, job]), pa.array(fields[doc, job].astype(np.int64))]
            kind = docs.type
        if which is not None:
            for first in range(0, len(kept), JOB_TILE):
                job, nth = np.nonzero(kept[first:first + JOB_TILE] > -np.inf)
                job += first
                yield [pa.array(which[job, nth], kind), held.jobs.take(pa.array(job)), pa.array(kept[job, nth]), pa.nulls(len(job), pa.int64())]

    return _scored(evidence, weights, key, [(key, None), ("jd_id", None), ("raw_score", T.DoubleType()), ("fields", T.LongType())], k or 0, rows)


def _boost(boosts: dict[str, float], value: Column) -> Column:
    """``value`` times the boost of the row's field, 0 for other fields."""
    chain = reduce(
        lambda acc, item: acc.when(F.col("field") == item[0], F.lit(item[1])),
        list(boosts.items())[1:],
        F.when(F.col("field") == list(boosts)[0], F.lit(list(boosts.values())[0])),
    )
    return chain.otherwise(F.lit(0.0)) * value


def settled(value: Column) -> Column:
    """Cut the last digits, which depend on the order of a floating sum, so equal inputs rank equally in every run."""
    return F.rint(value * 1e9) / 1e9


def combine_fields(scores: DataFrame, exact_boosts: dict[str, float], best_fields: dict[str, float], key: str = "resume_id") -> DataFrame:
    """(jd_id, document, raw_score): exact clauses plus the best-fields clause (max + tie-breaker * rest)."""
    best = _boost(best_fields, F.col("near")) if best_fields else F.lit(0.0)
    exact = _boost(exact_boosts, F.col("exact")) if exact_boosts else F.lit(0.0)
    return (
        scores.groupBy(key, "jd_id")
        .agg(F.sum(exact).alias("clauses"), F.max(best).alias("top"), F.sum(best).alias("total"))
        .select("jd_id", key, settled(F.col("clauses") + F.col("top") + (F.col("total") - F.col("top")) * TIE_BREAKER).alias("raw_score"))
    )


def stable(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared checkpoint folder, so a small query-side
    table that several stages read is computed once and outlives an executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


#: Documents per result asked for whose best terms set a job's first floor.
SEEDS = 20
#: Share of the floor that terms which open no pairs may add; the rest is what a pair must reach without them.
SHARE = 0.5
#: Scores are cut to nine digits; bounds allow for more than that.
SLACK = 1e-6


def unit_worths(evidence: DataFrame, weights: DataFrame, key: str = "resume_id") -> DataFrame:
    """(document, field, term, worth): what a wanted term is worth in a document to a job that asks for it once."""
    terms = checked_broadcast(weights.groupBy("field", "term").agg(F.max("idf").alias("idf"), F.max("avg_len").alias("avg_len")))
    spelled = evidence.select(key, "field", "len", F.explode("terms").alias("term"), "value")
    counted = (
        spelled.join(terms, ["field", "term"]).groupBy(key, "field", "term", "len", "idf", "avg_len")
        .agg(F.count("*").alias("tf"), F.max("value").alias("value"))
    )
    tf = F.col("tf")
    saturated = tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * F.col("len") / F.col("avg_len")))
    return counted.select(key, "field", "term", F.coalesce("value", F.col("idf") * saturated).alias("worth"))


def _sums(worths: DataFrame, weights: DataFrame, key: str) -> DataFrame:
    asked = checked_broadcast(weights.select("jd_id", "field", "term", "exact", "near"))
    return worths.join(asked, ["field", "term"]).groupBy(key, "jd_id", "field").agg(
        F.sum(F.col("worth") * F.col("exact")).alias("exact"), F.sum(F.col("worth") * F.col("near")).alias("near")
    )


def term_bounds(worths: DataFrame, weights: DataFrame, limits: DataFrame, exact_boosts: dict[str, float], best_fields: dict[str, float], always: str) -> DataFrame:
    """Weights with ``bound``, the most a term adds to any document, and ``seed``, whether it helps to find a job's first floor.

    Seeds are the terms of the largest bounds until their postings would fill
    the results several times. Terms of field ``always`` are seeds whatever
    their bound, as their worth may be negative.
    """
    largest = worths.groupBy("field", "term").agg(F.max("worth").alias("most"), F.count("*").alias("held"))
    boost = _boost(exact_boosts or {"": 0.0}, F.col("exact")) + _boost(best_fields or {"": 0.0}, F.col("near"))
    bounded = weights.join(checked_broadcast(largest), ["field", "term"]).withColumn("bound", F.greatest(F.col("most"), F.lit(0.0)) * boost)
    earlier = Window.partitionBy("jd_id").orderBy(F.desc("bound"), "field", "term").rowsBetween(Window.unboundedPreceding, -1)
    sure = F.col("field") == always
    return bounded.join(limits, "jd_id").withColumn("seed", sure | (F.coalesce(F.sum("held").over(earlier), F.lit(0)) < SEEDS * F.col("k"))).select(
        "jd_id", "field", "term", "exact", "near", "bound", "held", "seed", sure.alias("sure")
    )


def split_terms(bounds: DataFrame, floors: DataFrame) -> DataFrame:
    """Bounds with ``floor``, ``essential`` and ``rest``.

    Terms of a job whose bounds together stay below its floor are not
    essential: a document that holds no other can't be among its best. Any such
    set will do, so the floor is spent on the terms with the most postings for
    their bound. ``rest`` is what they can add at most.
    """
    upto = Window.partitionBy("jd_id").orderBy("sure", F.col("bound") / F.col("held"), "field", "term").rowsBetween(Window.unboundedPreceding, 0)
    job = Window.partitionBy("jd_id")
    known = bounds.join(floors, "jd_id", "left")
    essential = F.col("sure") | F.coalesce(F.sum("bound").over(upto) >= F.col("floor") * SHARE - SLACK, F.lit(True))
    return known.withColumn("essential", essential).withColumn("rest", F.sum(F.when(F.col("essential"), 0.0).otherwise(F.col("bound"))).over(job))


def contenders(worths: DataFrame, terms: DataFrame, exact_boosts: dict[str, float], best_fields: dict[str, float], key: str = "resume_id") -> DataFrame:
    """(job, document, parts): pairs whose essential terms and the rest together can reach the floor; ``parts`` are their field sums so far."""
    best = _boost(best_fields, F.col("near")) if best_fields else F.lit(0.0)
    exact = _boost(exact_boosts, F.col("exact")) if exact_boosts else F.lit(0.0)
    pairs = _sums(worths, terms.filter("essential"), key).groupBy(key, "jd_id").agg(
        F.sum(exact).alias("clauses"), F.max(best).alias("top"), F.sum(best).alias("total"), F.collect_list(F.struct("field", "exact", "near")).alias("parts")
    )
    jobs = checked_broadcast(terms.select("jd_id", "floor", "rest").distinct())
    reached = F.col("clauses") + F.col("top") + (F.col("total") - F.col("top")) * TIE_BREAKER + F.col("rest")
    return pairs.join(jobs, "jd_id").filter(F.col("floor").isNull() | (reached >= F.col("floor") - SLACK)).select("jd_id", key, "parts")


def best_scores(
    evidence: DataFrame, weights: DataFrame, limits: DataFrame, exact_boosts: dict[str, float], best_fields: dict[str, float], key: str = "resume_id", always: str = "vector",
) -> DataFrame:
    """(jd_id, document, raw_score) of all pairs that can be among the ``k`` best of their job (``limits``: jd_id, k), with the scores of :func:`combine_fields`.

    MaxScore (Turtle and Flood 1995) as joins. A few strong terms of each job
    find k documents, whose whole scores give a floor that its k-th best score
    can't fall below. Then only essential
    terms open pairs, pairs that can't reach the floor drop out, and the frequent
    weak terms are looked up for the pairs that are left.
    """
    worths = stable(unit_worths(evidence, weights, key))
    bounds = stable(term_bounds(worths, weights, limits, exact_boosts, best_fields, always))
    first = combine_fields(_sums(worths, bounds.filter("seed"), key), exact_boosts, best_fields, key)
    lowest = top_per_job(first.join(limits, "jd_id"), F.col("k"), "raw_score", item=key)
    sums = lowest.select("jd_id", key).join(worths, key).join(checked_broadcast(weights), ["jd_id", "field", "term"]).groupBy(key, "jd_id", "field").agg(
        F.sum(F.col("worth") * F.col("exact")).alias("exact"), F.sum(F.col("worth") * F.col("near")).alias("near")
    )
    whole = combine_fields(sums, exact_boosts, best_fields, key)
    floors = whole.join(limits, "jd_id").groupBy("jd_id").agg(F.min("raw_score").alias("floor"), F.count("*").alias("n"), F.max("k").alias("k")).filter("n >= k")
    floors = floors.select("jd_id", "floor")
    terms = stable(split_terms(bounds, floors))
    left = stable(contenders(worths, terms, exact_boosts, best_fields, key))
    weak = checked_broadcast(terms.filter("not essential").select("jd_id", "field", "term", F.col("exact").alias("e"), F.col("near").alias("n")))
    frequent = worths.join(checked_broadcast(weak.select("field", "term").distinct()), ["field", "term"], "left_semi")
    more = left.select("jd_id", key).join(frequent, key).join(weak, ["jd_id", "field", "term"]).groupBy(key, "jd_id", "field").agg(
        F.sum(F.col("worth") * F.col("e")).alias("exact"), F.sum(F.col("worth") * F.col("n")).alias("near")
    )
    sums = left.select("jd_id", key, F.inline("parts")).unionByName(more).groupBy(key, "jd_id", "field").agg(F.sum("exact").alias("exact"), F.sum("near").alias("near"))
    return combine_fields(sums, exact_boosts, best_fields, key)


def text_scores(
    jobs: DataFrame, query: Column, docs: DataFrame, *, exact_boosts: dict[str, float], best_fields: dict[str, float],
    fuzzy: bool = True, key: str = "resume_id", limits: DataFrame | None = None, k: int | None = None,
) -> DataFrame:
    """(jd_id, resume_id, raw_score) of every document matching at least one clause; with ``limits`` or ``k`` of those that can be among the k best."""
    fields = sorted(set(exact_boosts) | set(best_fields))
    weights = stable(term_weights(query_terms(jobs, query), docs, fields, fuzzy=fuzzy, key=key))
    if limits is not None:
        return best_scores(text_evidence(docs, fields, key), weights, limits, exact_boosts, best_fields, key)
    return pair_scores(text_evidence(docs, fields, key), weights, exact_boosts, best_fields, key, k).select("jd_id", key, "raw_score")


def key_terms(skills: Column, title: Column | None = None) -> Column:
    """First ten of skills and title, short ones dropped."""
    if title is not None:
        skills = F.concat(skills, F.array_compact(F.array(F.nullif(title, F.lit("")))))
    return F.filter(F.slice(skills, 1, 10), lambda t: F.length(t) >= 3)


def hybrid_scores(
    jobs: DataFrame, query: Column, terms: Column, docs: DataFrame, nearest: DataFrame, *,
    best_fields: dict[str, float], vector_boost: float, phrase_boost: float, fuzzy: bool = True, key: str = "resume_id", limits: DataFrame | None = None, k: int | None = None,
) -> DataFrame:
    """(jd_id, resume_id, raw_score): vector hits, best-fields text and skill phrases in one pass.

    The three kinds of evidence meet before the one shuffle by document, so no
    pair table is joined afterwards.
    """
    fields = sorted(best_fields)
    weights = stable(
        term_weights(query_terms(jobs, query), docs, fields, fuzzy=fuzzy, key=key)
        .unionByName(phrase_weights(jobs, terms))
        .unionByName(vector_weights(jobs))
    )
    evidence = (
        text_evidence(docs, fields, key).unionByName(phrase_evidence(docs, key)).unionByName(vector_evidence(nearest, key))
    )
    boosts = {"vector": vector_boost, "phrase": phrase_boost}
    if limits is not None:
        return best_scores(evidence, weights, limits, boosts, best_fields, key)
    return pair_scores(evidence, weights, boosts, best_fields, key, k).select("jd_id", key, "raw_score")
