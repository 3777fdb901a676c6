"""Roles of the supplied tables: which columns act as candidates, jobs, contacts.

The tables hold no careers, so names of skills, titles and degrees are drawn
by arithmetic on the row's key and joined to the row's own text, vector,
conversation and page. Every role has as many rows as its table. The pieces
are plain SQL that Spark and DuckDB read alike, so both start from equal input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import table

DIM = 64

SKILLS = (
    "Python;JS;React.js;Spring Boot;Java 11;AWS;REST API;Kubernetes;k8s;Docker;SQL;NoSQL;PostgreSQL;postgres;"
    "Machine Learning;ML;Node.js;JavaScript;TypeScript;C++;C#;CI/CD;Apache Spark;Spark;Kafka;Azure;GCP;"
    "Google Cloud Platform;Amazon Web Services;Data Science;Big Data;Tableau;Power BI;Django Framework;Agile;"
    "Agile Methodology;Scrum;Unit Testing;Micro-services;RESTful Web Services"
)
N_SKILLS = 40
TITLES = (
    "Software Engineer;Senior Software Engineer;Data Engineer;Data Scientist;Project Manager;QA Engineer;"
    "DevOps Engineer;Frontend Developer;Java Developer;Business Analyst"
)
DEGREES = "Bachelor of Technology;Master of Science;MBA;Bachelor of Science in Physics;Diploma"


def pick(pool: str, n: int, expr: str) -> str:
    return f"split_part('{pool}', ';', CAST(1 + ({expr}) % {n} AS INT))"


def _skill(expr: str) -> str:
    return pick(SKILLS, N_SKILLS, expr)


# Portable scalar SQL (Spark and DuckDB); strings are joined by ';' and split by each engine.
CANDIDATE_SKILLS = f"""concat_ws(';', {_skill('doc_id * 7')}, {_skill('doc_id * 11 + 3')}, {_skill('doc_id * 13 + 5')},
  {_skill('doc_id * 17 + 8')}, {_skill('doc_id + n_chars')},
  CASE WHEN doc_id % 3 = 0 THEN {_skill('doc_id * 3 + 1')} END,
  CASE WHEN doc_id % 5 < 2 THEN {_skill('doc_id * 5 + 2')} END,
  nullif(split_part(lower(replace(text, ';', ' ')), ' ', 1), ''), nullif(split_part(replace(text, ';', ' '), ' ', 2), ''))"""
CANDIDATE_POSITIONS = f"""concat_ws(';', {pick(TITLES, 10, 'doc_id')}, CASE WHEN doc_id % 2 = 0 THEN {pick(TITLES, 10, 'doc_id * 3 + 1')} END)"""
CANDIDATE_EXPERIENCE = "CAST(doc_id % 13 AS DOUBLE) + 0.5"
JOB_SKILLS = f"""concat_ws(';', {_skill('item_id * 3')}, {_skill('item_id * 5 + 1')}, {_skill('item_id * 7 + 2')},
  {_skill('item_id * 9 + 4')}, {_skill('length(text)')}, split_part(lower(text), ' ', 1))"""
JOB_NICE = f"concat_ws(';', CASE WHEN item_id % 2 = 0 THEN {_skill('item_id * 19 + 6')} END, CASE WHEN item_id % 4 = 0 THEN {_skill('item_id * 23 + 9')} END)"
JOB_TITLE = f"CASE WHEN item_id % 7 = 6 THEN '' ELSE {pick(TITLES, 10, 'item_id')} END"
JOB_EXPERIENCE = "CAST(item_id % 9 AS DOUBLE)"
JOB_LEVEL = "CASE WHEN item_id % 3 = 0 THEN 'Senior' WHEN item_id % 3 = 1 THEN 'Junior' END"
JOB_INDUSTRY = "CASE WHEN item_id % 5 = 0 THEN 'Finance' END"

CANDIDATES_SQL = f"""cand AS (
  SELECT d.doc_id AS resume_id,
    list_filter(string_split({CANDIDATE_SKILLS}, ';'), lambda s: s <> '') AS skills,
    string_split({CANDIDATE_POSITIONS}, ';') AS positions,
    d.text AS summary,
    c.companies_description,
    p.url AS projects_description,
    {pick(DEGREES, 5, 'd.doc_id')} AS education_degree,
    {CANDIDATE_EXPERIENCE} AS total_experience,
    CAST(e.embedding AS DOUBLE[]) AS embedding
  FROM documents d
  LEFT JOIN (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS companies_description FROM conversations GROUP BY conv_id) c
    ON c.conv_id = d.doc_id
  LEFT JOIN pages p ON p.page_id = d.doc_id
  LEFT JOIN embeddings e ON e.vec_id = d.doc_id)"""

JOBS_SQL = f"""jobs AS (
  SELECT item_id AS jd_id, text, {JOB_TITLE} AS job_title, {JOB_EXPERIENCE} AS required_experience,
    string_split({JOB_SKILLS}, ';') AS required_skills,
    list_filter(string_split({JOB_NICE}, ';'), lambda s: s <> '') AS nice_to_have_skills,
    {JOB_LEVEL} AS seniority_level, {JOB_INDUSTRY} AS industry,
    CAST(5 + item_id % 8 AS INT) AS max_results, CAST(item_id % 4 AS DOUBLE) AS min_experience,
    CAST(e.embedding AS DOUBLE[]) AS embedding
  FROM benchmark b LEFT JOIN embeddings e ON e.vec_id = b.item_id)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    talk = (
        table(spark, sf_dir, "conversations").groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("turns"))
        .select(F.col("conv_id").alias("doc_id"), F.array_join("turns.text", " ").alias("companies_description"))
    )
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("url").alias("projects_description"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    base = docs.selectExpr(
        "doc_id",
        f"filter(split({CANDIDATE_SKILLS}, ';'), s -> s <> '') AS skills",
        f"split({CANDIDATE_POSITIONS}, ';') AS positions",
        "text AS summary",
        f"{pick(DEGREES, 5, 'doc_id')} AS education_degree",
        f"{CANDIDATE_EXPERIENCE} AS total_experience",
    )
    return (
        base.join(talk, "doc_id", "left").join(pages, "doc_id", "left").join(vectors, "doc_id", "left")
        .withColumnRenamed("doc_id", "resume_id")
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    return (
        table(spark, sf_dir, "benchmark").join(vectors, "item_id", "left")
        .selectExpr(
            "item_id AS jd_id", "text", f"{JOB_TITLE} AS job_title", f"{JOB_EXPERIENCE} AS required_experience",
            f"split({JOB_SKILLS}, ';') AS required_skills",
            f"filter(split({JOB_NICE}, ';'), s -> s <> '') AS nice_to_have_skills",
            f"{JOB_LEVEL} AS seniority_level", f"{JOB_INDUSTRY} AS industry",
            "CAST(5 + item_id % 8 AS INT) AS max_results", "CAST(item_id % 4 AS DOUBLE) AS min_experience",
            "embedding",
        )
    )
