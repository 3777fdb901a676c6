"""Score formulas on small cases."""

import pytest
from pyspark.sql import functions as F

from vitaspark.functions import scores as S
from vitaspark.functions import skills as K


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def strings(*values):
    return F.array(*[F.lit(v) for v in values])


@pytest.mark.parametrize(
    ("wanted", "held", "score"),
    [
        (["javascript"], ["java", "javascript es6"], 50.0),
        (["javascript"], ["javascript es6", "java"], 75.0),
        (["python", "spring data"], ["python", "springframework", "rest apis"], 50.0),
        (["java"], ["javascript"], 75.0),
        (["a b", "c"], ["c"], 50.0),
        (["python", "java", "sql"], ["python", "java", "sql"], 100.0),
    ],
)
def test_skill_match(spark, wanted, held, score):
    assert one(spark, K.skill_match_score(strings(*wanted), strings(*held))) == score


def test_skill_match_empty(spark):
    empty = F.array().cast("array<string>")
    assert one(spark, K.skill_match_score(empty, strings("a"))) == 0.0
    assert one(spark, K.skill_match_score(strings("a"), empty)) == 0.0


@pytest.mark.parametrize(
    ("skill", "batch", "api"),
    [("React.js", "react", "react"), ("AWS", "amazon web services", "aws"), ("Amazon Web Services", "amazon web services", "aws"),
     ("C/C++", "cplusplus", "c/c++"), ("OAuth 2.0", "oauth", "oauth 2.0"), ("Micro-Services", "microservices", "micro-services")],
)
def test_spellings(spark, skill, batch, api):
    assert one(spark, K.normalize_skill(F.lit(skill))) == batch
    assert one(spark, K.normalize_skill(F.lit(skill), "api")) == api


def test_experience(spark):
    lit = F.lit
    assert one(spark, S.experience_score(lit(5.0), lit(0.0))) == 100.0
    assert one(spark, S.guarded_experience_score(lit(5.0), lit(0.0))) == 0.0
    assert one(spark, S.experience_score(lit(2.0), lit(3.0))) == 66.67
    rows = spark.range(0, 200).select(S.experience_score(F.col("id") / 10.0, F.lit(12.0)).alias("s")).collect()
    values = [r["s"] for r in rows]
    assert values == sorted(values) and 0 <= min(values) and max(values) == 100.0


def test_position(spark):
    assert one(spark, S.position_score(F.lit("Data Engineer"), strings("QA", "data engineer"))) == 100.0
    assert one(spark, S.position_score(F.lit("Data Engineer"), strings("Senior Data Engineer"))) == 70.0
    assert one(spark, S.position_score(F.lit(""), strings("QA"))) == 0.0


def test_constant_pool(spark):
    rows = spark.range(5).select(F.lit(1).alias("jd_id"), F.lit(0.4).alias("s")).select(S.minmax_percent(F.col("s"), "jd_id").alias("v")).collect()
    assert {r["v"] for r in rows} == {0.0}


def test_coverage_counts_pairs(spark):
    wanted, held = strings("Python", "Java"), strings("Python", "python 3", "JavaScript")
    pairs = K.partial_pairs(wanted, K.normalize_skills(wanted, "api"), held, K.normalize_skills(held, "api"))
    assert [tuple(p) for p in one(spark, pairs)] == [("Python", "python 3"), ("Java", "JavaScript")]
    assert one(spark, K.coverage_percent(F.lit(1), F.lit(2), F.lit(2))) == 100.0
