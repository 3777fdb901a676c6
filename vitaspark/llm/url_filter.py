"""URL rules by hashed host-suffix and path-prefix expressions. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitaspark.llm.common import LOWER, UPPER

#: Hex digits of a digest that candidates are joined on.
PREFIX = 8


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first "://" up to "/", "?", "#" or the end, A-Z lower-cased. Path: from there up to "?" or "#". Else both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def folder(path: Column) -> Column:
    """The path up to its last "/", that included."""
    return F.regexp_extract(path, r"(?s)^.*/", 0)


def expression(host: Column, path: Column) -> Column:
    return F.concat(host, F.lit("\n"), path)


def prepared(rules: DataFrame) -> DataFrame:
    """Rules with their digest; null hosts and paths count as empty, of equal rules a block stands."""
    host, path = F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER), F.coalesce("path", F.lit(""))
    named = rules.select(host.alias("rule_host"), path.alias("rule_path"), "verdict")
    one = named.groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("rule_verdict"))
    digest = F.sha2(expression(F.col("rule_host"), folder(F.col("rule_path"))), 256)
    return one.withColumn("rule_digest", digest).withColumn("rule_prefix", F.substring("rule_digest", 1, PREFIX))


def expansions(keys: DataFrame, most_labels: int, most_folders: int) -> DataFrame:
    """A row per host suffix and folder prefix of (host, path), no deeper than any rule is."""
    labels, parts = F.split("host", r"\.", -1), F.split("path", "/", -1)
    sized = keys.select(
        "host", "path", labels.alias("labels"), parts.alias("parts"),
        F.least(F.size(labels), F.lit(most_labels)).alias("n_labels"), F.least(F.size(parts) - 1, F.lit(most_folders)).alias("n_folders"),
    )
    suffix = F.transform(F.sequence(F.lit(1), "n_labels"), lambda n: F.array_join(F.slice("labels", F.size("labels") - n + 1, n), "."))
    # 0 folders: the empty prefix; n folders: the first n parts with a "/" behind each
    prefix = F.transform(
        F.sequence(F.lit(0), "n_folders"),
        lambda n: F.when(n == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice("parts", 1, n), "/"), F.lit("/"))),
    )
    both = sized.select("host", "path", F.explode(suffix).alias("suffix"), prefix.alias("prefixes"))
    return (
        both.select("host", "path", "suffix", F.explode("prefixes").alias("folder"))
        .withColumn("digest", F.sha2(expression(F.col("suffix"), F.col("folder")), 256))
    )


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", url_col: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict; every row and column stays.

    A rule (host, path, verdict) fits its host and all subdomains if the path
    starts with the rule's; the longest rule wins, then the longer host. Urls
    that no rule fits get ``default``; null and urls without "://" have neither
    host nor path and fit none but a rule of two empty strings.

    Distinct (host, path) pairs are judged once and joined back, so a hot url
    counts once and extra page columns are shuffled only if selected.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path})
    keys = rows.select("host", "path").distinct()
    listed = prepared(rules)
    most_labels, most_folders = listed.agg(
        F.coalesce(F.max(F.size(F.split("rule_host", r"\.", -1))), F.lit(1)), F.coalesce(F.max(F.size(F.split("rule_path", "/", -1)) - 1), F.lit(0))
    ).first()
    asked = expansions(keys, most_labels, most_folders).withColumn("prefix", F.substring("digest", 1, PREFIX))
    fitting = asked.join(listed, asked["prefix"] == listed["rule_prefix"]).filter(
        (F.col("digest") == F.col("rule_digest")) & (F.col("suffix") == F.col("rule_host")) & F.col("path").startswith(F.col("rule_path"))
    )
    rule = F.concat("rule_host", "rule_path")
    best = F.max_by(
        F.struct(rule.alias("rule"), F.col("rule_verdict").alias("verdict")), F.struct(F.length(rule), F.length("rule_host"), rule)
    )
    verdicts = fitting.groupBy("host", "path").agg(best.alias("best")).select("host", "path", "best.rule", "best.verdict")
    return rows.join(verdicts, ["host", "path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit(default)))


#: Rules fixed by the query's contract.
RULES = """
values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block') as rules(host, path, verdict)
"""

SQL = """
with rules(host, path, verdict) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
rest as (select page_id, url, case when strpos(url, '://') > 0 then url[strpos(url, '://') + 3:] else '' end as r from pages),
cut as (select page_id, translate(regexp_extract(coalesce(r, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(coalesce(r, '')[length(regexp_extract(coalesce(r, ''), '^[^/?#]*')) + 1:], '^[^?#]*') as path from rest)
select page_id, c.host, c.path,
  (select r.host || r.path from rules r where (c.host = r.host or ends_with(c.host, '.' || r.host)) and starts_with(c.path, r.path)
   order by length(r.host || r.path) desc limit 1) as rule,
  coalesce((select r.verdict from rules r where (c.host = r.host or ends_with(c.host, '.' || r.host)) and starts_with(c.path, r.path)
   order by length(r.host || r.path) desc limit 1), 'allow') as verdict
from cut c
"""
