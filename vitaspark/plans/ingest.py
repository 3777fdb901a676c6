"""Ingest: texts and stored responses to records, resolved ids and store snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import redact
from ..operators import identity as I
from ..operators import normalize as N
from ..operators.lexical import stable
from ..operators.metrics import ingest_summary
from ..operators.salvage import salvage_responses
from ..sources import stores as S
from ..sources.buckets import BucketTable
from .sizing import spread

SHORTEST_TEXT = 200


def combined_text(standard: Column, redacted: Column) -> Column:
    """Standard text, a heading and the redacted original."""
    return F.concat(standard, F.lit("\n\n# ORIGINAL RESUME TEXT\n"), redacted)


def minimal_records(docs: DataFrame, text: str = "text", filename: str = "filename") -> DataFrame:
    """Tag documents without usable text and fill name and years from the file name."""
    failed = F.length(F.trim(F.coalesce(text, F.lit("")))) < SHORTEST_TEXT
    name, years = N.filename_metadata(F.col(filename))
    return docs.withColumns({
        "extraction_error": F.when(failed, F.lit("Failed to extract text from document")),
        "file_name_person": F.when(failed, name), "file_years": F.when(failed, years),
    })


def split_errors(df: DataFrame, error: str = "extraction_error") -> tuple[DataFrame, DataFrame]:
    return df.filter(F.col(error).isNull()), df.filter(F.col(error).isNotNull())


def records_of(batch: DataFrame) -> DataFrame:
    """Normalised records of a batch with resume_id, text, filename and response."""
    repaired = salvage_responses(batch.withColumnRenamed("resume_id", "row_id"))
    keep = ["row_id", "text", "filename", "method"]
    records = N.normalize_responses(repaired, "json", keep=keep)
    name, years = N.filename_metadata(F.col("filename"))
    return records.withColumns({
        "resume_id": F.col("row_id"),
        "name": F.coalesce("name", name, N.name_from_filename(F.col("filename"))),
        "total_experience": F.when(F.col("total_experience") > 0, F.col("total_experience")).otherwise(F.coalesce(years, F.lit(0.0))),
        "extraction_error": F.when(F.col("method") == "none", F.lit("no response")),
    }).drop("row_id")


PII_COLUMNS = ["resume_id", "name", "email", "phone_number", "address", "linkedin_url", "file_type", "original_filename", "created_dt", "updated_dt"]


def batch_tables(rows: DataFrame) -> dict[str, DataFrame]:
    """The contact, document and index rows of resolved records, one per id."""
    redacted = redact(F.col("text"), F.col("name"), F.col("email"), F.col("phone_number"), F.col("linkedin_url"), F.col("address"))
    return {
        "pii": rows.filter(I.has_contact()).select(*PII_COLUMNS),
        "documents": N.without_pii(rows),
        "index": N.index_document(rows).join(
            # both sides lie by id already; texts are never broadcast
            rows.select("resume_id", combined_text(N.standard_text(rows), redacted).alias("index_text")).hint("merge"), "resume_id"
        ),
    }


#: Tables whose rows keep the date they came with first.
CREATED = {"pii": "created_dt", "documents": None, "index": "created_dt"}


def _stamped(batch: DataFrame, stamp: int) -> tuple[DataFrame, DataFrame]:
    """Records and error rows of a batch."""
    stamps = {"updated_dt": F.lit(stamp).cast("bigint"), "created_dt": F.lit(stamp).cast("bigint")}
    # both sides come from one pass over the responses, which uses all task slots however few files hold the batch
    records, errors = split_errors(stable(records_of(spread(batch)).withColumns(stamps)))
    return records, errors.select("resume_id", "filename", F.col("extraction_error").alias("error"), "updated_dt")


def _resolved(records: DataFrame, known: DataFrame | None) -> DataFrame:
    """Records under their final ids, the last one of each id."""
    contacts = known if known is not None else records.select(*PII_COLUMNS).limit(0)
    return S.latest(stable(I.adopt_ids(records, contacts).withColumn("resume_id", F.col("final_id")).drop("final_id", "known_id", "component")))


def _outcome(records: DataFrame, errors: DataFrame) -> DataFrame:
    return ingest_summary(records.select(F.lit(True).alias("ok")).unionByName(errors.select(F.lit(False).alias("ok"))), F.col("ok"))


def ingest_batch(spark: SparkSession, batch: DataFrame, root: str, stamp: int, version: int | None = None) -> DataFrame:
    """Run one batch into the contact, document, index, child and error tables under ``root``, as whole versions.

    For loads that touch much of the tables; :func:`ingest_increment` is the form for small batches.
    Ids are resolved before anything is written, each table gets one new
    version, and a version that is there already is left alone, so a batch that
    is run again changes nothing. Returns the batch's summary per store.
    """
    def before(table: S.SnapshotTable) -> DataFrame | None:
        done = [v for v in table.versions() if version is None or v < version]
        return table.read(done[-1]) if done else None

    records, failed = _stamped(batch, stamp)
    rows = _resolved(records, before(S.SnapshotTable(spark, f"{root}/pii")))
    for name, new in batch_tables(rows).items():
        table = S.SnapshotTable(spark, f"{root}/{name}")
        old = before(table)
        table.write(new if old is None else S.upsert(old, new, created=CREATED[name]), version)
    for name, fresh in S.child_rows(rows).items():
        table = S.SnapshotTable(spark, f"{root}/{name}")
        old = before(table)
        table.write(fresh if old is None else S.replace_children(old, rows, fresh), version)
    error_table = S.SnapshotTable(spark, f"{root}/errors")
    old = before(error_table)
    # a record that went through since is no error any more
    error_table.write(S.latest(failed) if old is None else S.upsert(S.delete(old, rows), S.latest(failed), created=None), version)
    return _outcome(records, failed)


def increment_table(spark: SparkSession, root: str, name: str) -> BucketTable:
    """A table of :func:`ingest_increment`: pii, documents, index, children, errors or contacts."""
    if name == "contacts":
        return BucketTable(spark, f"{root}/{name}", ["contact", "resume_id"], by=["contact"])
    return BucketTable(spark, f"{root}/{name}", created=CREATED.get(name))


def contact_rows(rows: DataFrame) -> DataFrame:
    """(contact, resume_id): the contact keys of rows, e-mails and phones apart."""
    keys = F.array_compact(F.array(F.concat(F.lit("e:"), I.email_key()), F.concat(F.lit("p:"), I.phone_key())))
    return rows.select("resume_id", F.explode(keys).alias("contact")).select("contact", "resume_id").distinct()


def _known_contacts(spark: SparkSession, records: DataFrame, root: str, version: int) -> DataFrame | None:
    """Stored contact rows that share a key with the records. Ids come from the contact keys' own table, whose
    pairs may be outdated, so their present rows are read before anything is resolved with them."""
    incoming = contact_rows(records).select("contact").distinct()
    pairs = increment_table(spark, root, "contacts").read(version, incoming)
    return None if pairs is None else increment_table(spark, root, "pii").read(version, pairs.select("resume_id"))


def ingest_increment(spark: SparkSession, batch: DataFrame, root: str, stamp: int, version: int) -> DataFrame:
    """Run one batch as deltas: nothing stored is written again, and only the buckets of incoming keys are read.

    Ids, rows and errors come out as with :func:`ingest_batch`. Children of a record are one row of arrays, so a batch that
    writes the record replaces them, also by none; :func:`children_of` gives them as rows. Running a batch again changes nothing.
    """
    records, failed = _stamped(batch, stamp)
    known = _known_contacts(spark, records, root, version)
    rows = stable(_resolved(records, None if known is None else stable(known)))
    parts = batch_tables(rows)
    for name, new in parts.items():
        increment_table(spark, root, name).write(new, version)
    increment_table(spark, root, "contacts").write(contact_rows(parts["pii"]), version)
    increment_table(spark, root, "children").write(rows.select("resume_id", "education", "companies", "skills"), version)
    errors = increment_table(spark, root, "errors")
    # only errors that are stored get a deletion, so the table follows the failures and not all records
    mended = errors.read(version, rows)
    errors.write(S.latest(failed), version, None if mended is None else mended.select("resume_id"))
    return _outcome(records, failed)


def children_of(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Education, experience and skill rows after the last batch."""
    return S.child_rows(increment_table(spark, root, "children").read())


def compact(spark: SparkSession, root: str) -> None:
    """Merge the deltas of all tables; for an operator to run now and then, as reading gets slower with each delta."""
    for name in ("pii", "documents", "index", "children", "errors", "contacts"):
        increment_table(spark, root, name).compact()
