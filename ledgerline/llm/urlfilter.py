"""URL verdicts: hashed host-suffix and path-prefix expressions met with a rule table by equi-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hex digits of a digest that the join is made on; the whole digest is compared afterwards.
PREFIX_DIGITS = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL_SHAPE = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, URL_SHAPE, 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty if there is no ``://``."""
    return F.coalesce(F.regexp_extract(url, URL_SHAPE, 2), F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules (action, host, path) as a table; action is allow or block."""
    return spark.createDataFrame(rules, "action string, host string, path string")


def _prepared(rules: DataFrame) -> DataFrame:
    """One row per expression: equal rules merge, and a block outweighs an equal allow."""
    host = F.translate(F.col("host"), UPPER, LOWER)
    usable = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("action").isin("allow", "block"))
    merged = usable.groupBy(host.alias("rule_host"), F.col("path").alias("rule_path")).agg(F.max("action").alias("action"))
    return merged.select(
        F.concat("rule_host", "rule_path").alias("rule"),
        F.size(F.split("rule_host", r"\.")).alias("labels"),
        F.char_length("rule_path").alias("path_length"),
        "action",
    ).withColumn("digest", F.sha2("rule", 256))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Verdict of every row of ``pages``: id, host, path, rule, verdict, n_rules.

    ``rules`` has (action, host, path).  A rule fits its host and all subdomains, if the
    path starts with the rule's.  The longest fitting rule wins, of equal ones the one with
    more host labels; without one ``rule`` is null and ``default`` is the verdict.  ``n_rules``
    counts the fitting rules.

    A URL is expanded only into the shapes (number of host labels, length of path) that
    some rule has.  The number of shapes follows the rule list, not the pages.  Distinct
    (host, path start) pairs are judged once, so copies of a hot URL meet before any
    shuffle, and the rows get their verdict back by a join that adaptive execution can split.

    Nulls and texts without ``://`` have an empty host and path and take the default.
    Repeated rows and null ids each keep their own row.  Rules with a null part or another
    action are left out.  Other columns of either table do not matter.
    """
    known = _prepared(rules)
    shapes = [tuple(row) for row in known.select("labels", "path_length").distinct().collect()]
    rows = pages.select(F.col(id_col).alias(id_col), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    longest = max((length for _, length in shapes), default=0)
    rows = rows.withColumn("start", F.substring("path", 1, longest) if longest else F.lit(""))

    starts = rows.select("host", "start").distinct().withColumn("parts", F.split("host", r"\."))
    shape = F.explode(F.array(*[F.struct(F.lit(a).alias("labels"), F.lit(b).alias("cut")) for a, b in shapes] or [F.struct(F.lit(1).alias("labels"), F.lit(0).alias("cut"))]))
    expanded = starts.select("host", "start", "parts", shape.alias("shape")).where(
        (F.size("parts") >= F.col("shape.labels")) & (F.char_length("start") >= F.col("shape.cut"))
    )
    suffix = F.array_join(F.slice("parts", -F.col("shape.labels"), F.col("shape.labels")), ".")
    expressions = expanded.select(
        "host", "start", F.sha2(F.concat(suffix, F.col("start").substr(F.lit(1), F.col("shape.cut"))), 256).alias("digest")
    )
    short = lambda column: F.substring(column, 1, PREFIX_DIGITS)
    met = expressions.withColumn("short", short("digest")).join(
        known.select(short("digest").alias("short"), F.col("digest").alias("rule_digest"), "rule", "action", "labels"), "short"
    )
    found = (
        met.where(F.col("digest") == F.col("rule_digest"))
        .groupBy("host", "start")
        .agg(F.max(F.struct(F.char_length("rule").alias("size"), "labels", "rule", "action")).alias("best"), F.count(F.lit(1)).alias("n_rules"))
    )
    return rows.join(found, ["host", "start"], "left").select(
        id_col,
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.action", F.lit(default)).alias("verdict"),
        F.coalesce("n_rules", F.lit(0)).cast("bigint").alias("n_rules"),
    )
