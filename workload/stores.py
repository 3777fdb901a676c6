"""Identity, stores, metrics and maintenance over contact rows derived from customer, orders and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitaspark.operators import identity as I
from vitaspark.operators import metrics as G
from vitaspark.sources import stores as ST
from vitaspark.operators.vector_search import top_per_job

from .records import W, records
from .registry import query, table

# Portable SQL. Stored contacts: customers; incoming rows: orders of those customers.
EMAIL = "CASE WHEN c_custkey % 6 = 0 THEN NULL WHEN c_custkey % 4 = 0 THEN ' USER' || CAST(c_custkey % 700 AS STRING) || '@Mail.com ' ELSE 'user' || CAST(c_custkey % 700 AS STRING) || '@mail.com' END"
PHONE = "CASE WHEN c_custkey % 5 = 0 THEN '12-34' ELSE '+1 (555) ' || CAST(100000 + c_custkey % 900 AS STRING) END"
PII_COLS = f"c_custkey AS resume_id, c_name AS name, {EMAIL} AS email, {PHONE} AS phone_number, c_custkey * 37 % 1009 AS updated_dt, c_custkey % 50 AS created_dt"
IN_EMAIL = "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'User' || CAST(o_custkey % 800 AS STRING) || '@MAIL.com' END"
IN_PHONE = "CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE '1555' || CAST(100000 + o_custkey % 1000 AS STRING) END"
IN_COLS = f"o_orderkey + 1000000 AS resume_id, {IN_EMAIL} AS email, {IN_PHONE} AS phone_number, o_orderkey AS updated_dt"


def _keys(src: str) -> str:
    return f"""SELECT *, nullif(lower(trim(email)), '') AS email_key,
      CASE WHEN length(regexp_replace(phone_number, '[^0-9]', '', 'g')) > 5 THEN regexp_replace(phone_number, '[^0-9]', '', 'g') END AS phone_key FROM {src}"""


PII_SQL = f"WITH RECURSIVE pii AS (SELECT {PII_COLS} FROM customer), pk AS ({_keys('pii')}), inc AS (SELECT {IN_COLS} FROM orders), ik AS ({_keys('inc')})"
MAPS_SQL = """bye AS (SELECT email_key, arg_max(resume_id, updated_dt * 10000000 + resume_id) AS id FROM pk WHERE email_key IS NOT NULL GROUP BY 1),
byp AS (SELECT phone_key, arg_max(resume_id, updated_dt * 10000000 + resume_id) AS id FROM pk WHERE phone_key IS NOT NULL GROUP BY 1)"""
RESOLVED = "ik LEFT JOIN bye USING (email_key) LEFT JOIN byp USING (phone_key)"


def pii(spark, sf):
    return table(spark, sf, "customer").selectExpr(*PII_COLS.split(", c_name")[0:1], "c_name AS name", f"{EMAIL} AS email", f"{PHONE} AS phone_number", "c_custkey * 37 % 1009 AS updated_dt", "c_custkey % 50 AS created_dt")


def incoming(spark, sf):
    return table(spark, sf, "orders").selectExpr("o_orderkey + 1000000 AS resume_id", f"{IN_EMAIL} AS email", f"{IN_PHONE} AS phone_number", "o_orderkey AS updated_dt")


@query("j4", f"{PII_SQL}, {MAPS_SQL} SELECT resume_id, bye.id AS by_email, byp.id AS by_phone, coalesce(bye.id, byp.id) AS known_id FROM {RESOLVED}")
def j4(spark, sf):
    return I.resolve_contacts(incoming(spark, sf), pii(spark, sf)).select("resume_id", "by_email", "by_phone", "known_id")


@query("g7", f"{PII_SQL}, {MAPS_SQL} SELECT email_key, id AS known_id FROM bye")
def g7(spark, sf):
    return I.contact_map(I.with_keys(pii(spark, sf)), "email_key")


COMPONENTS = """ed AS (SELECT resume_id AS a, min(resume_id) OVER (PARTITION BY email_key) AS b FROM pk WHERE email_key IS NOT NULL
  UNION SELECT resume_id, min(resume_id) OVER (PARTITION BY phone_key) FROM pk WHERE phone_key IS NOT NULL),
both_ways AS (SELECT a, b FROM ed UNION SELECT b, a FROM ed),
reach AS (SELECT resume_id AS id, resume_id AS other FROM pii UNION SELECT r.id, e.b FROM reach r JOIN both_ways e ON r.other = e.a)"""


@query("j5", f"{PII_SQL}, {COMPONENTS} SELECT id AS resume_id, min(other) AS component FROM reach GROUP BY id")
def j5(spark, sf):
    return I.components(pii(spark, sf))


@query("g6", f"""{PII_SQL} SELECT 'email' AS kind, email_key AS key, count(*) AS n, min(resume_id) AS keep_id FROM pk WHERE email_key IS NOT NULL GROUP BY 2 HAVING count(*) > 1
  UNION ALL SELECT 'phone', phone_key, count(*), min(resume_id) FROM pk WHERE phone_key IS NOT NULL GROUP BY 2 HAVING count(*) > 1""")
def g6(spark, sf):
    return I.duplicate_groups(pii(spark, sf))


@query("w6", f"{PII_SQL} SELECT resume_id, CASE WHEN email_key IS NULL THEN resume_id ELSE min(resume_id) OVER (PARTITION BY email_key) END AS keep_id FROM pk")
def w6(spark, sf):
    return I.keep_first(I.with_keys(pii(spark, sf)), "email_key").select("resume_id", "keep_id")


# Index rows are keyed by the customer of an order, so some contacts lack a row and some rows lack a contact.
INDEX = "SELECT DISTINCT o_custkey * 3 % 2500 AS resume_id FROM orders"


def index_rows(spark, sf):
    return table(spark, sf, "orders").select((F.col("o_custkey") * 3 % 2500).alias("resume_id")).distinct()


@query("j6", f"SELECT resume_id FROM ({INDEX}) WHERE resume_id NOT IN (SELECT c_custkey FROM customer)")
def j6(spark, sf):
    return index_rows(spark, sf).join(pii(spark, sf).select("resume_id"), "resume_id", "left_anti")


@query("j8", f"SELECT c_custkey AS resume_id FROM customer WHERE c_custkey IN ({INDEX})")
def j8(spark, sf):
    return ST.existing(pii(spark, sf).select("resume_id"), index_rows(spark, sf))


@query("m1", f"""{PII_SQL}, idx AS ({INDEX}), kn AS (SELECT * FROM pk WHERE resume_id IN (SELECT resume_id FROM idx)),
  e AS (SELECT *, CASE WHEN email_key IS NULL THEN resume_id ELSE min(resume_id) OVER (PARTITION BY email_key) END AS k FROM kn),
  p AS (SELECT *, CASE WHEN phone_key IS NULL THEN resume_id ELSE min(resume_id) OVER (PARTITION BY phone_key) END AS k2 FROM e WHERE k = resume_id)
  SELECT resume_id, 'orphan' AS reason FROM idx WHERE resume_id NOT IN (SELECT resume_id FROM pii) UNION ALL SELECT resume_id, 'email' FROM e WHERE k <> resume_id
  UNION ALL SELECT resume_id, 'phone' FROM p WHERE k2 <> resume_id""")
def m1(spark, sf):
    return I.cleanup_plan(index_rows(spark, sf), pii(spark, sf))


SYNC_SQL = f"""{PII_SQL}, idx AS ({INDEX}), st AS (SELECT * FROM pk WHERE resume_id IN (SELECT resume_id FROM idx)),
  se AS (SELECT email_key, arg_max(resume_id, updated_dt * 10000000 + resume_id) AS id FROM st WHERE email_key IS NOT NULL GROUP BY 1),
  sp AS (SELECT phone_key, arg_max(resume_id, updated_dt * 10000000 + resume_id) AS id FROM st WHERE phone_key IS NOT NULL GROUP BY 1),
  plan AS (SELECT resume_id, CASE WHEN coalesce(se.id, sp.id) IS NULL THEN 'create' ELSE 'rekey' END AS action, coalesce(se.id, sp.id) AS from_id
    FROM pk LEFT JOIN se USING (email_key) LEFT JOIN sp USING (phone_key) WHERE resume_id NOT IN (SELECT resume_id FROM idx))"""


def _sync(spark, sf):
    return I.sync_plan(pii(spark, sf), index_rows(spark, sf), pii(spark, sf))


@query("j7", f"{SYNC_SQL} SELECT * FROM plan")
def j7(spark, sf):
    return _sync(spark, sf)


@query("m2", f"{SYNC_SQL} SELECT action, count(*) AS rows, count(DISTINCT from_id) AS sources FROM plan GROUP BY action")
def m2(spark, sf):
    return _sync(spark, sf).groupBy("action").agg(F.count("*").alias("rows"), F.countDistinct("from_id").alias("sources"))


@query("g8", f"{SYNC_SQL} SELECT action, count(*) AS n FROM plan GROUP BY action")
def g8(spark, sf):
    return _sync(spark, sf).groupBy("action").agg(F.count("*").alias("n"))


@query("j12", f"""{PII_SQL}, {MAPS_SQL}, idx AS ({INDEX}) SELECT r.resume_id, coalesce(known_id, idx.resume_id, r.resume_id) AS target_id,
    CASE WHEN known_id IS NOT NULL THEN 'update_by_contact' WHEN idx.resume_id IS NOT NULL THEN 'update_by_id' ELSE 'insert' END AS action
  FROM (SELECT resume_id % 2000 AS resume_id, coalesce(bye.id, byp.id) AS known_id FROM {RESOLVED}) r LEFT JOIN idx ON r.resume_id = idx.resume_id""")
def j12(spark, sf):
    rows = incoming(spark, sf).withColumn("resume_id", F.col("resume_id") % 2000)
    return I.resolve_index_rows(rows, index_rows(spark, sf), pii(spark, sf)).select("resume_id", "target_id", "action")


@query("j9", f"""SELECT i.resume_id, c.c_name AS name, n.n_name AS nation FROM ({INDEX}) i LEFT JOIN customer c ON c.c_custkey = i.resume_id LEFT JOIN nation n ON n.n_nationkey = i.resume_id""")
def j9(spark, sf):
    data = table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("resume_id"), "n_name")
    out = ST.details(index_rows(spark, sf), pii(spark, sf), data)
    return out.select("resume_id", F.col("pii.name").alias("name"), F.col("data.n_name").alias("nation"))


@query("j10", "SELECT o_orderkey, o_orderstatus, l_linenumber, l_quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P'")
def j10(spark, sf):
    parents = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    kids = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_quantity")
    gone = parents.filter("o_orderstatus = 'P'").select("o_orderkey")
    return ST.delete(parents, gone, "o_orderkey").join(ST.delete(kids, gone, "o_orderkey"), "o_orderkey")


@query("d8", f"""{W} SELECT 'education' AS child, resume_id, e.degree AS first, e.institution AS second FROM (SELECT resume_id, unnest(education) AS e FROM nrm)
  UNION ALL SELECT 'experience', resume_id, c.name, c.duration FROM (SELECT resume_id, unnest(companies) AS c FROM nrm)
  UNION ALL SELECT 'skills', resume_id, s, NULL FROM (SELECT resume_id, unnest(skills) AS s FROM nrm)""")
def d8(spark, sf):
    kids = ST.child_rows(records(spark, sf))
    part = lambda name, a, b: kids[name].select(F.lit(name).alias("child"), "resume_id", F.col(a).alias("first"), b.alias("second"))
    return part("education", "degree", F.col("institution")).unionByName(
        part("experience", "company_name", F.col("duration"))
    ).unionByName(part("skills", "skill_name", F.lit(None).cast("string")))


# New versions of contact rows: the last order per customer key, keys partly unknown to the table.
NEW = """nw AS (SELECT o_custkey * 3 % 2200 AS resume_id, 'New ' || CAST(max(o_orderkey) AS VARCHAR) AS name,
    CASE WHEN max(o_orderkey) % 2 = 0 THEN 'new' || CAST(max(o_orderkey) AS VARCHAR) || '@mail.com' END AS email,
    CASE WHEN max(o_orderkey) % 3 = 0 THEN '777' || CAST(max(o_orderkey) AS VARCHAR) END AS phone_number,
    max(o_orderkey) AS updated_dt, max(o_orderkey) AS created_dt FROM orders GROUP BY 1)"""


def new_rows(spark, sf):
    top = table(spark, sf, "orders").groupBy((F.col("o_custkey") * 3 % 2200).alias("resume_id")).agg(F.max("o_orderkey").alias("m"))
    return top.selectExpr(
        "resume_id", "'New ' || CAST(m AS STRING) AS name", "CASE WHEN m % 2 = 0 THEN 'new' || CAST(m AS STRING) || '@mail.com' END AS email",
        "CASE WHEN m % 3 = 0 THEN '777' || CAST(m AS STRING) END AS phone_number", "m AS updated_dt", "m AS created_dt",
    )


@query("io11", f"""{PII_SQL}, {NEW} SELECT resume_id, name, email, phone_number, updated_dt, created_dt FROM pii WHERE resume_id NOT IN (SELECT resume_id FROM nw)
  UNION ALL SELECT nw.resume_id, nw.name, nw.email, nw.phone_number, nw.updated_dt, coalesce(pii.created_dt, nw.created_dt) FROM nw LEFT JOIN pii USING (resume_id)""")
def io11(spark, sf):
    return ST.upsert(pii(spark, sf), new_rows(spark, sf))


@query("io15", f"""{PII_SQL}, {NEW} SELECT resume_id, coalesce(nw.name, pii.name) AS name, coalesce(nw.email, pii.email) AS email, coalesce(nw.phone_number, pii.phone_number) AS phone_number,
  coalesce(nw.updated_dt, pii.updated_dt) AS updated_dt, coalesce(pii.created_dt, nw.created_dt) AS created_dt FROM pii FULL OUTER JOIN nw USING (resume_id)""")
def io15(spark, sf):
    return ST.upsert(pii(spark, sf), new_rows(spark, sf), partial=True)


@query("io13", f"""{W}, od AS (SELECT c_custkey AS resume_id, c_mktsegment AS summary, c_acctbal AS total_experience FROM customer), nd AS (SELECT c_custkey * 2 AS resume_id, summary, total_experience FROM nrm)
  SELECT * FROM od WHERE resume_id NOT IN (SELECT resume_id FROM nd) UNION ALL SELECT * FROM nd""")
def io13(spark, sf):
    from vitaspark.operators.normalize import without_pii

    old = table(spark, sf, "customer").select(F.col("c_custkey").alias("resume_id"), F.col("c_mktsegment").alias("summary"), F.col("c_acctbal").alias("total_experience"))
    new = without_pii(records(spark, sf)).withColumn("resume_id", F.col("resume_id").cast("bigint") * 2)
    return ST.upsert(old, new.select("resume_id", "summary", "total_experience"), created=None)


@query("io12", """SELECT l_orderkey AS resume_id, l_linenumber AS n, l_quantity AS q FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')
  UNION ALL SELECT o_orderkey, 1, o_totalprice FROM orders WHERE o_orderstatus = 'F'""")
def io12(spark, sf):
    kids = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("resume_id"), F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("q"))
    updated = table(spark, sf, "orders").filter("o_orderstatus = 'F'").withColumnRenamed("o_orderkey", "resume_id")
    return ST.replace_children(kids, updated, updated.select("resume_id", F.lit(1).alias("n"), F.col("o_totalprice").alias("q")))


@query("io14", f"""{PII_SQL}, {MAPS_SQL}, tg AS (SELECT coalesce(bye.id, byp.id, resume_id) AS resume_id, ik.resume_id AS src, ik.updated_dt FROM {RESOLVED}),
  lt AS (SELECT resume_id, max(updated_dt) AS updated_dt, arg_max(src, updated_dt) AS source_id FROM tg GROUP BY 1)
  SELECT resume_id, updated_dt, -1 AS source_id FROM pii WHERE resume_id NOT IN (SELECT resume_id FROM lt) UNION ALL SELECT resume_id, updated_dt, source_id FROM lt""")
def io14(spark, sf):
    index = pii(spark, sf).select("resume_id", "updated_dt", F.lit(-1).cast("bigint").alias("source_id"))
    found = I.resolve_index_rows(incoming(spark, sf), index, pii(spark, sf))
    rows = found.select(F.col("target_id").alias("resume_id"), "updated_dt", F.col("resume_id").alias("source_id"))
    return ST.upsert(index, ST.latest(rows), created=None)


@query("io16", f"{PII_SQL} SELECT resume_id, name FROM pii WHERE resume_id NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def io16(spark, sf):
    doomed = table(spark, sf, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("resume_id"))
    return ST.delete(pii(spark, sf).select("resume_id", "name"), doomed)


@query("io17", f"{PII_SQL} SELECT resume_id, name, email FROM pii WHERE resume_id IN (SELECT CAST(s_suppkey AS BIGINT) * 7 FROM supplier)")
def io17(spark, sf):
    ids = table(spark, sf, "supplier").select((F.col("s_suppkey") * 7).alias("resume_id"))
    return ST.fetch_many(pii(spark, sf), ids).select("resume_id", "name", "email")


@query("f10", f"{PII_SQL} SELECT resume_id, name FROM pii WHERE resume_id = 77")
def f10(spark, sf):
    return ST.fetch(pii(spark, sf), 77).select("resume_id", "name")


@query("s5", f"{PII_SQL}, {NEW} SELECT resume_id, name FROM pii WHERE resume_id NOT IN (SELECT resume_id FROM nw) UNION ALL SELECT resume_id, name FROM nw")
def s5(spark, sf):
    return ST.upsert(pii(spark, sf).select("resume_id", "name"), new_rows(spark, sf).select("resume_id", "name"), created=None)


@query("w9", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def w9(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type", "value")
    return ST.latest(e, "user_id", "event_id")


# ---- metrics -------------------------------------------------------------------------------

OK = "event_type <> 'error'"


@query("g2", f"SELECT count(*) AS total, count(*) FILTER ({OK}) AS succeeded, count(*) FILTER (NOT {OK}) AS failed, round(count(*) FILTER ({OK}) * 100.0 / count(*), 1) AS success_rate FROM events")
def g2(spark, sf):
    return G.ingest_summary(table(spark, sf, "events"), F.expr(OK))


@query("g3", f"SELECT user_id % 3 AS store, count(*) AS total, count(*) FILTER ({OK}) AS succeeded, count(*) FILTER (NOT {OK}) AS failed, round(count(*) FILTER ({OK}) * 100.0 / count(*), 1) AS success_rate FROM events GROUP BY 1")
def g3(spark, sf):
    return G.ingest_summary(table(spark, sf, "events").withColumn("store", F.col("user_id") % 3), F.expr(OK), "store")


@query("g4", """SELECT event_type, count(*) AS total, string_agg(CAST(user_id AS VARCHAR), ', ' ORDER BY event_id) FILTER (rn <= 5) || CASE WHEN count(*) > 5 THEN ' and ' || (count(*) - 5) || ' more' ELSE '' END AS shown
  FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM events) GROUP BY event_type""")
def g4(spark, sf):
    return G.first_and_more(table(spark, sf, "events"), "event_type", "user_id", "event_id")


@query("g5", "SELECT event_type, round(avg(value), 2) AS avg_seconds, round(count(*) / sum(value), 2) AS per_second FROM events GROUP BY 1")
def g5(spark, sf):
    return G.throughput(table(spark, sf, "events"), "value", "event_type")


BATCH_SQL = "SELECT event_id, CAST(floor((row_number() OVER (ORDER BY event_id) - 1) / 25) AS BIGINT) AS batch FROM events"


@query("w7", BATCH_SQL)
def w7(spark, sf):
    return G.batches(table(spark, sf, "events").select("event_id"), "event_id")


@query("io3", "SELECT batch, count(*) AS files, min(url) AS first_key FROM (SELECT url, page_id, CAST(floor((row_number() OVER (ORDER BY page_id) - 1) / 25) AS BIGINT) AS batch FROM pages) GROUP BY batch")
def io3(spark, sf):
    listed = G.batches(table(spark, sf, "pages").select("page_id", "url"), "page_id")
    return listed.groupBy("batch").agg(F.count("*").alias("files"), F.min("url").alias("first_key"))


@query("o1", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def o1(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query("io10", "SELECT props IS NOT NULL AND TRY_CAST(CAST(props AS JSON) ->> '$.k' AS INT) < 90 AS ok, count(*) AS n FROM events GROUP BY 1")
def io10(spark, sf):
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "int")
    return table(spark, sf, "events").select((F.col("props").isNotNull() & (k < 90)).alias("ok")).groupBy("ok").agg(F.count("*").alias("n"))


@query("s6", """WITH a AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS ra, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rb FROM orders)
  SELECT coalesce(x.o_custkey, y.o_custkey) AS jd_id, coalesce(x.o_orderkey, y.o_orderkey) AS resume_id, CASE WHEN y.o_orderkey IS NULL THEN 'first' WHEN x.o_orderkey IS NULL THEN 'second' ELSE 'both' END AS side
  FROM (SELECT * FROM a WHERE ra <= 3) x FULL OUTER JOIN (SELECT * FROM a WHERE rb <= 3) y ON x.o_orderkey = y.o_orderkey""")
def s6(spark, sf):
    from vitaspark.operators.optional import compare_rankings

    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("jd_id"), F.col("o_orderkey").alias("resume_id"), "o_totalprice", F.col("o_orderdate").alias("d"))
    return compare_rankings(top_per_job(o, 3, "o_totalprice"), top_per_job(o, 3, "d"))
