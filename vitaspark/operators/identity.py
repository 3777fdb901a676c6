"""Contact keys, identity resolution, duplicate clean-up and id synchronisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.sizing import counted_join, lookup
from .lexical import stable


def email_key(email: Column | str = "email") -> Column:
    email = F.col(email) if isinstance(email, str) else email
    return F.nullif(F.lower(F.trim(email)), F.lit(""))


def phone_key(phone: Column | str = "phone_number") -> Column:
    """Digits of a phone number with more than five of them."""
    phone = F.col(phone) if isinstance(phone, str) else phone
    digits = F.regexp_replace(phone, r"[^0-9]", "")
    return F.when(F.length(digits) > 5, digits)


def has_contact() -> Column:
    return F.coalesce(F.nullif(F.col("email"), F.lit("")), F.nullif(F.col("phone_number"), F.lit(""))).isNotNull()


def with_keys(df: DataFrame) -> DataFrame:
    return df.withColumn("email_key", email_key()).withColumn("phone_key", phone_key())


def contact_map(known: DataFrame, key: str, ts: str = "updated_dt") -> DataFrame:
    """(key, known_id): the id written last under a contact key."""
    return (
        known.filter(F.col(key).isNotNull()).groupBy(key)
        .agg(F.max_by("resume_id", F.struct(ts, "resume_id")).alias("known_id"))
    )


def resolve_contacts(incoming: DataFrame, known: DataFrame, ts: str = "updated_dt") -> DataFrame:
    """Add ``known_id``: the stored id with the same e-mail, else with the same phone."""
    known = with_keys(known)
    by_email = contact_map(known, "email_key", ts).withColumnRenamed("known_id", "by_email")
    by_phone = contact_map(known, "phone_key", ts).withColumnRenamed("known_id", "by_phone")
    found = lookup(lookup(with_keys(incoming), by_email, "email_key"), by_phone, "phone_key")
    return found.withColumn("known_id", F.coalesce("by_email", "by_phone"))


def resolve_index_rows(incoming: DataFrame, index: DataFrame, contacts: DataFrame, ts: str = "updated_dt") -> DataFrame:
    """Precedence of an index write: contact match, then the same id, else insert."""
    found = resolve_contacts(incoming, contacts, ts)
    ids = index.select(F.col("resume_id").alias("same_id")).distinct()
    matched = found.join(ids, F.col("resume_id") == F.col("same_id"), "left")
    return matched.withColumn("target_id", F.coalesce("known_id", "same_id", "resume_id")).withColumn(
        "action", F.when(F.col("known_id").isNotNull(), "update_by_contact").when(F.col("same_id").isNotNull(), "update_by_id").otherwise("insert")
    )


def components(df: DataFrame) -> DataFrame:
    """(resume_id, component): smallest id reachable over shared e-mails and phones.

    Labels travel from rows to contact keys and back, with a pointer jump per
    round. A key held by very many rows takes part as one aggregated minimum,
    pairs inside a group never exist. Every round is checkpointed, and rounds
    go on until no label changes. Whether labels are broadcast goes by their
    count.
    """
    keyed = with_keys(df)
    edges = stable(
        keyed.select(
            "resume_id",
            F.explode(F.array_compact(F.array(
                F.when(F.col("email_key").isNotNull(), F.concat(F.lit("e:"), "email_key")),
                F.when(F.col("phone_key").isNotNull(), F.concat(F.lit("p:"), "phone_key")),
            ))).alias("key"),
        ).distinct()
    )
    labels = stable(keyed.select("resume_id", F.col("resume_id").alias("component")).distinct())
    how = counted_join(labels)
    while True:
        by_key = edges.join(labels.hint(how), "resume_id").groupBy("key").agg(F.min("component").alias("low"))
        by_row = lookup(edges, by_key, "key", how="inner").groupBy("resume_id").agg(F.min("low").alias("low"))
        lower = stable(labels.join(by_row.hint(how), "resume_id", "left").select(
            "resume_id", F.col("component").alias("old"), F.least("component", F.coalesce("low", "component")).alias("new")
        ))
        jump = lower.select(F.col("resume_id").alias("new"), F.col("new").alias("next"))
        moved = stable(lookup(lower, jump, "new").select("resume_id", "old", F.least("new", F.coalesce("next", "new")).alias("component")))
        labels = moved.select("resume_id", "component")
        if moved.filter("old <> component").isEmpty():
            return labels


def duplicate_groups(df: DataFrame) -> DataFrame:
    """(kind, key, n, keep_id) of contact keys held by more than one row."""
    long = with_keys(df).select("resume_id", F.inline(F.array(
        F.struct(F.lit("email").alias("kind"), F.col("email_key").alias("key")),
        F.struct(F.lit("phone").alias("kind"), F.col("phone_key").alias("key")),
    ))).filter(F.col("key").isNotNull())
    return long.groupBy("kind", "key").agg(F.count("*").alias("n"), F.min("resume_id").alias("keep_id")).filter("n > 1")


def keep_first(df: DataFrame, key: str) -> DataFrame:
    """Add ``keep_id``: the first id of the row's key, its own id without a key.

    The first is an aggregate and not a row number, so a hot key is combined
    before the shuffle instead of sorted in one task.
    """
    first = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min("resume_id").alias("keep_id"))
    return lookup(df, first, key).withColumn("keep_id", F.coalesce("keep_id", "resume_id"))


def cleanup_plan(index: DataFrame, contacts: DataFrame) -> DataFrame:
    """(resume_id, reason) of index rows to delete: orphans, then e-mail copies, then
    phone copies among the rows the e-mail step keeps, so no group vanishes."""
    ids = index.select("resume_id")
    orphans = ids.join(contacts.select("resume_id"), "resume_id", "left_anti").withColumn("reason", F.lit("orphan"))
    known = with_keys(contacts).join(ids, "resume_id", "left_semi").select("resume_id", "email_key", "phone_key")
    by_email = keep_first(known, "email_key")
    email_copies = by_email.filter("keep_id <> resume_id").select("resume_id", F.lit("email").alias("reason"))
    left = by_email.filter("keep_id = resume_id").drop("keep_id")
    phone_copies = keep_first(left, "phone_key").filter("keep_id <> resume_id").select("resume_id", F.lit("phone").alias("reason"))
    return orphans.unionByName(email_copies).unionByName(phone_copies)


def sync_plan(contacts: DataFrame, store: DataFrame, stored_contacts: DataFrame, ts: str = "updated_dt") -> DataFrame:
    """(resume_id, action, from_id): contact rows absent from a store are re-keyed
    from a stored row with the same contact, else created."""
    missing = contacts.join(store.select("resume_id"), "resume_id", "left_anti")
    stored = stored_contacts.join(store.select("resume_id"), "resume_id", "left_semi")
    found = resolve_contacts(missing, stored, ts)
    return found.select(
        "resume_id", F.when(F.col("known_id").isNotNull(), "rekey").otherwise("create").alias("action"),
        F.col("known_id").alias("from_id"),
    )


def adopt_ids(incoming: DataFrame, known: DataFrame, ts: str = "updated_dt") -> DataFrame:
    """Final ids of a batch: the component's stored id when any member has one, else its smallest id."""
    resolved = resolve_contacts(incoming, known, ts).select(*incoming.columns, "known_id")
    parts = components(incoming)
    owned = lookup(resolved, parts, "resume_id")
    best = owned.groupBy("component").agg(F.min("known_id").alias("owner"))
    return lookup(owned, best, "component").withColumn("final_id", F.coalesce("owner", "component")).drop("owner")
