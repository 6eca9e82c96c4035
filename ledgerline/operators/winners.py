"""Pick one row per key: keep-best, last write, newest, ordered distinct.

Every pick is a ``min_by``/``max_by`` aggregate.  Each map task reduces its rows to
one candidate per key before the shuffle, so a key with a third of all rows costs
no more than any other.  Ranking windows would send the whole group to one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.session import durable
from ledgerline.skew import attach

#: Digests of repeated keys that are broadcast; with more of them all rows take part in what follows.
FEW_KEYS = 500_000


def split_repeated(df: DataFrame, keys: list[str], few_keys: int = FEW_KEYS) -> tuple[DataFrame, DataFrame]:
    """(rows that are alone with their key, all others).

    Only an 8-byte digest of each key crosses the network.  The digests that come more than once are broadcast, so a table with few
    repeats is told apart where it lies, and only rows that may share their key move later.  Keys whose digests
    clash count as shared, and with more than ``few_keys`` digests every row does: what follows has to compare the keys themselves.
    """
    digest = F.xxhash64(*keys)
    counts = df.groupBy(digest.alias("_digest")).agg(F.count(F.lit(1)).alias("_rows"))
    found = durable(counts.where("_rows > 1").select("_digest"))
    if found.limit(few_keys + 1).count() > few_keys:
        return df.where("false"), df
    marked, known = df.withColumn("_digest", digest), F.broadcast(found)
    return tuple(marked.join(known, "_digest", how).select(*df.columns) for how in ("left_anti", "left_semi"))


def edge_order(confidence: Column, created: Column, ident: Column) -> list[Column]:
    """Default order of W1: high confidence first (null = -1), early creation (null last), small id."""
    return [
        -F.coalesce(confidence.cast("double"), F.lit(-1.0)),
        F.coalesce(created.cast("string"), F.lit("9999-12-31T23:59:59Z")),
        ident,
    ]


def _rank(order: list[Column]) -> Column:
    return F.struct(*[col.alias(f"o{index}") for index, col in enumerate(order)])


def keep_best(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One whole row per key, the smallest by ``order`` (which must end in a unique column)."""
    rest = [name for name in df.columns if name not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), _rank(order)).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.{name}").alias(name) for name in rest]).select(*df.columns)


def dedup_audit(df: DataFrame, keys: list[str], order: list[Column], ident: str) -> DataFrame:
    """(id, kept_id) for every dropped row."""
    winners = df.groupBy(*keys).agg(F.min_by(F.col(ident), _rank(order)).alias(ident))
    return dropped_by(df, winners, keys, ident)


def dropped_by(df: DataFrame, kept: DataFrame, keys: list[str], ident: str) -> DataFrame:
    """(id, kept_id) for every row that lost to the one row of its key in ``kept``."""
    winners = kept.select(*keys, F.col(ident).alias("kept_id"))
    return (
        attach(df.select(*keys, ident), winners, keys, "inner")
        .where(F.col(ident) != F.col("kept_id"))
        .select(F.col(ident).alias("id"), "kept_id")
    )


def dedup_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Raw, unique and dropped row counts (one row)."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("raw_count"),
        F.count(F.lit(1)).alias("unique_count"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("dropped_count"),
    )


def merge_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Per key the row that comes last in input order."""
    rest = [name for name in df.columns if name not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), _rank(order)).alias("_last"))
    return last.select(*keys, *[F.col(f"_last.{name}").alias(name) for name in rest]).select(*df.columns)


def distinct_ordered(df: DataFrame, col: str, order: str) -> DataFrame:
    """Distinct values with the place of their first appearance; sort by it to present them."""
    return df.groupBy(col).agg(F.min(order).alias("first_seen"))


def distinct_members(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """The set of values per group, as rows; null values are ignored.

    Rows, not arrays: the number of distinct values of a group has no bound.
    """
    return df.where(F.col(value).isNotNull()).select(*group, value).distinct()


def sorted_set(col: Column, domain: list[str]) -> Column:
    """A6 as an aggregate, for a value with a declared finite domain: sorted array of members seen."""
    flags = [F.when(F.bool_or(col == F.lit(value)), F.lit(value)) for value in sorted(domain)]
    return F.array_compact(F.array(*flags))
