"""Presentation order: head with a remainder, default rank, tails of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.functions.text import split_lines


def head_with_rest(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows plus the number of rows not shown, on every row.

    Top-n and count run as two aggregates over the input; no global window.
    """
    total = df.agg(F.count(F.lit(1))).scalar()
    return df.orderBy(*order).limit(n).withColumn("remaining", F.greatest(total - F.lit(n), F.lit(0).cast("bigint")))


def order_default(df: DataFrame, rank: str, then: list[Column], default: int = 999999) -> DataFrame:
    """T4: ascending rank; a missing rank sorts as the default."""
    return df.withColumn("sort_rank", F.coalesce(F.col(rank), F.lit(default))).orderBy("sort_rank", *then)


def tail_of_text(df: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """T5 on whole documents: the last n lines with their numbers, no shuffle."""
    lines = df.select(F.col(key), split_lines(F.col(text)).alias("_lines"))
    size = F.size("_lines")
    first = F.greatest(size - n, F.lit(0))
    last = F.slice("_lines", first + 1, F.lit(n))
    return lines.select(key, first.alias("_skip"), F.posexplode(last).alias("_pos", "text")).select(
        key, (F.col("_skip") + F.col("_pos") + 1).alias("line"), "text"
    )


def tail_lines(lines: DataFrame, key: list[str], line: str, n: int) -> DataFrame:
    """T5 on numbered lines: Spark cuts each map task to n rows per document before the shuffle."""
    newest = W.partitionBy(*key).orderBy(F.col(line).desc())
    return lines.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= n).drop("_rank")


def pick_release(df: DataFrame, group: list[str], ts: str, ident: str, now: Column, hold_hours: int) -> DataFrame:
    """Per group the newest release past its hold and the newest one still held."""
    eligible = past_hold(F.col(ts), now, hold_hours)
    row = F.struct(F.col(ts).alias("ts"), F.col(ident).alias("id"))
    best = df.where(F.col(ts).isNotNull()).groupBy(*group).agg(
        F.max(F.when(eligible, row)).alias("_ok"), F.max(F.when(~eligible, row)).alias("_held")
    )
    return best.select(
        *group,
        F.col("_ok.id").alias("eligible_id"),
        F.col("_ok.ts").alias("eligible_ts"),
        F.col("_held.id").alias("held_id"),
        F.col("_held.ts").alias("held_ts"),
    )


def past_hold(ts: Column, now: Column, hold_hours: int) -> Column:
    """``now - ts >= hold``; the exact boundary is eligible."""
    return ts <= now - F.make_dt_interval(F.lit(0), F.lit(hold_hours))


def stable(df: DataFrame, draft: str = "draft", prerelease: str = "prerelease", published: str = "published_at") -> DataFrame:
    """draft and prerelease exactly false, publish time present; missing flags drop the row."""
    return df.where((F.col(draft) == F.lit(False)) & (F.col(prerelease) == F.lit(False)) & (F.col(published).isNotNull()))


def max_version(df: DataFrame, group: list[str], version: str) -> DataFrame:
    """Highest version per group in natural order, ties broken by text."""
    from ledgerline.functions.text import natural_key

    distinct = df.select(*group, version).distinct()
    return distinct.groupBy(*group).agg(
        F.max_by(F.col(version), F.struct(natural_key(F.col(version)).alias("k"), F.col(version).alias("t"))).alias(version)
    )
