"""Keys, references, counts and audits."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.skew import attach
from ledgerline.violations import failed_rules


@dataclass(frozen=True)
class ForeignKey:
    """child.column refers to parent.key; null children pass unless ``nullable`` is false."""

    child: str
    column: str
    parent: str
    key: str = "id"
    ident: str = "id"
    nullable: bool = True


def fk_violations(tables: dict[str, DataFrame], fks: list[ForeignKey]) -> DataFrame:
    """One row per dangling key value, with the number of rows and the smallest row id.

    Child and parent keys meet in one aggregate per edge.  It combines on the map side,
    so a value shared by a third of the child table crosses the network once per task;
    an anti-join would be pushed below the grouping and move every row.
    """
    edges = []
    for fk in fks:
        child = tables[fk.child]
        if fk.nullable:
            child = child.where(F.col(fk.column).isNotNull())
        smallest = F.min(F.when(F.col("_child"), F.col("_id")))
        rows = child.select(F.col(fk.column).alias("_value"), F.col(fk.ident).alias("_id"), F.lit(True).alias("_child"))
        parents = tables[fk.parent].where(F.col(fk.key).isNotNull()).select(
            F.col(fk.key).alias("_value"), F.lit(None).cast(child.schema[fk.ident].dataType).alias("_id"), F.lit(False).alias("_child")
        )
        both = rows.unionByName(parents).groupBy("_value").agg(
            F.count_if("_child").alias("row_count"), smallest.alias("first_id"), F.bool_and("_child").alias("_dangling")
        )
        edges.append(
            both.where("_dangling").select(
                F.lit(f"{fk.child}.{fk.column}").alias("edge"),
                F.col("_value").cast("string").alias("value"),
                "row_count",
                F.col("first_id").cast("string").alias("first_id"),
            )
        )
    return reduce(DataFrame.unionByName, edges)


def repair_orphans_by_signature(
    child: DataFrame, parent: DataFrame, fk: str, sig: Column, ident: str, parent_key: str = "id"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept, dropped, violations).

    An orphan row may be dropped only when its signature is found under exactly one
    live parent; the audit names that parent and the smallest live row id.
    """
    parents = parent.select(F.col(parent_key).alias(fk)).distinct().withColumn("_live", F.lit(True))
    marked = attach(child.withColumn("_sig", sig), parents, [fk], "left")
    kept = marked.where(F.col("_live")).select(*child.columns)
    orphans = marked.where(F.col("_live").isNull()).select(F.col(ident).alias("id"), F.col(fk).alias("missing_parent"), "_sig")
    live = (
        marked.where(F.col("_live"))
        .groupBy("_sig")
        .agg(F.min(fk).alias("_low"), F.max(fk).alias("_high"), F.min(ident).alias("duplicate_id"))
    )
    judged = attach(orphans, live, ["_sig"], "left")
    single = F.col("_low").isNotNull() & (F.col("_low") == F.col("_high"))
    dropped = judged.where(single).select("id", "missing_parent", F.col("_low").alias("duplicate_parent"), "duplicate_id")
    violations = judged.where(~single | F.col("_low").isNull()).select("id", "missing_parent")
    return kept, dropped, violations


def repair_bounded_orphans(
    child: DataFrame,
    parent: DataFrame,
    fk: str,
    status: str,
    allowed: list[str],
    ident: str,
    limit: int = 1,
    parent_key: str = "id",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept, dropped, violations).

    The first ``limit`` orphans by id may be dropped if their status allows it; every
    other orphan is a violation.
    """
    parents = parent.select(F.col(parent_key).alias(fk)).distinct().withColumn("_live", F.lit(True))
    marked = attach(child, parents, [fk], "left")
    kept = marked.where(F.col("_live")).select(*child.columns)
    orphans = marked.where(F.col("_live").isNull()).select(
        F.col(ident).alias("id"), F.col(fk).alias("missing_parent"), F.col(status).alias("status")
    )
    # the limit is the operator's own parameter, so this side has at most ``limit`` rows
    first = F.broadcast(orphans.orderBy("id").limit(limit).select("id").withColumn("_first", F.lit(True)))
    judged = orphans.join(first, "id", "left").withColumn(
        "_ok", F.coalesce(F.col("_first"), F.lit(False)) & F.coalesce(F.col("status").isin(allowed), F.lit(False))
    )
    return kept, judged.where("_ok").select("id", "missing_parent", "status"), judged.where("NOT _ok").select(
        "id", "missing_parent", "status"
    )


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """A1: (table, actual)."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("actual")).select(F.lit(name).alias("table"), "actual")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def check_counts(tables: dict[str, DataFrame] | DataFrame, declared: DataFrame) -> DataFrame:
    """A1: tables whose declared count (table, declared) differs or is missing on one side; ``tables`` may be counted already (table, actual)."""
    actual = tables if isinstance(tables, DataFrame) else row_counts(tables)
    both = actual.join(declared, "table", "full_outer")
    return both.where(~F.col("actual").eqNullSafe(F.col("declared"))).select("table", "declared", "actual")


def check_unique(df: DataFrame, cols: list[str]) -> DataFrame:
    """A4: keys that occur more than once; keys with a null part are ignored."""
    present = df.dropna(subset=cols)
    return present.groupBy(*cols).agg(F.count(F.lit(1)).alias("row_count")).where(F.col("row_count") > 1)


def multi_owned(claims: DataFrame, item: str, owner: str) -> DataFrame:
    """A5: items claimed more than once; the lowest and highest owner name the dispute."""
    per_owner = claims.groupBy(item, owner).agg(F.count(F.lit(1)).alias("_n"))
    return (
        per_owner.groupBy(item)
        .agg(
            F.sum("_n").alias("claims"),
            F.count(F.lit(1)).alias("owners"),
            F.min(owner).alias("first_owner"),
            F.max(owner).alias("last_owner"),
        )
        .where(F.col("claims") > 1)
    )


def check_single_value(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Groups bound to more than one value."""
    span = df.groupBy(*group).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    return span.where(F.col("low") != F.col("high"))


def check_audit(kept: DataFrame, dropped: DataFrame, keys: list[str], declared_raw: Column | int, declared_unique: Column | int) -> DataFrame:
    """Rules on raw, kept, dropped and distinct-key counts; one row per rule that fails.

    The scalars travel as (name, value) rows and meet in one tiny aggregate.
    """
    measures = [
        kept.agg(F.count(F.lit(1)).alias("value")).select(F.lit("kept").alias("name"), "value"),
        dropped.agg(F.count(F.lit(1)).alias("value")).select(F.lit("dropped").alias("name"), "value"),
        kept.select(*keys).distinct().agg(F.count(F.lit(1)).alias("value")).select(F.lit("keys").alias("name"), "value"),
    ]
    named = reduce(DataFrame.unionByName, measures)
    pick = lambda name: F.max(F.when(F.col("name") == name, F.col("value"))).alias(name)
    facts = named.agg(pick("kept"), pick("dropped"), pick("keys"))
    raw = F.lit(declared_raw) if isinstance(declared_raw, int) else declared_raw
    unique = F.lit(declared_unique) if isinstance(declared_unique, int) else declared_unique
    rules = {
        "unique count matches rows": unique == F.col("kept"),
        "dropped count is consistent": raw - unique == F.col("dropped"),
        "keys are unique": F.col("keys") == unique,
    }
    return facts.select("kept", "dropped", "keys", F.explode(failed_rules(rules)).alias("rule"))


def set_cover(declared: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Values on one side only; empty means the sets are equal.

    One aggregate over both sides; copies combine before the shuffle.
    """
    both = declared.select(key, F.lit(True).alias("_declared")).unionByName(actual.select(key, F.lit(False).alias("_declared")))
    seen = both.groupBy(key).agg(F.bool_and("_declared").alias("_only_declared"), F.bool_or("_declared").alias("_declared"))
    side = F.when(F.col("_only_declared"), F.lit("missing")).when(~F.col("_declared"), F.lit("unexpected"))
    return seen.select(key, side.alias("side")).where(F.col("side").isNotNull())


def fingerprint_diff(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that were added, removed or changed between two snapshots (key unique in each)."""
    left = before.select(key, F.col(value).alias("before"), F.lit(True).alias("_b"))
    right = after.select(key, F.col(value).alias("after"), F.lit(True).alias("_a"))
    kind = (
        F.when(F.col("_b").isNull(), F.lit("added"))
        .when(F.col("_a").isNull(), F.lit("removed"))
        .when(~F.col("before").eqNullSafe(F.col("after")), F.lit("changed"))
    )
    return (
        left.join(right, key, "full_outer").withColumn("kind", kind).where(F.col("kind").isNotNull()).select(key, "kind", "before", "after")
    )


def parity(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Catalogue entries present on one side only, or with unequal values (null equals null)."""
    values = [name for name in a.columns if name not in keys]
    left = a.select(*keys, F.struct(*values).alias("_left"), F.lit(True).alias("_in_a"))
    right = b.select(*keys, F.struct(*values).alias("_right"), F.lit(True).alias("_in_b"))
    differs = reduce(
        lambda acc, name: acc | ~F.col(f"_left.{name}").eqNullSafe(F.col(f"_right.{name}")), values, F.lit(False)
    )
    status = (
        F.when(F.col("_in_b").isNull(), F.lit("only in first"))
        .when(F.col("_in_a").isNull(), F.lit("only in second"))
        .when(differs, F.lit("different"))
    )
    joined = left.join(right, keys, "full_outer").withColumn("status", status)
    return joined.where(F.col("status").isNotNull()).select(*keys, "status")


def check_values(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """one row per record and failed rule."""
    return df.select(F.col(key), F.explode(failed_rules(rules)).alias("rule"))


def check_capacity(df: DataFrame, parts: list[str], capacity: str, reserve_percent: Column) -> Column:
    """Why the sizes do not fit, or null: all positive, reserve below 100, sum within capacity."""
    total = reduce(lambda acc, name: acc + F.col(name), parts[1:], F.col(parts[0]))
    positive = reduce(lambda acc, name: acc & (F.col(name) > 0), [*parts, capacity], reserve_percent > 0)
    return (
        F.when(~F.coalesce(positive, F.lit(False)), F.lit("values must be positive"))
        .when(reserve_percent >= 100, F.lit("reserve must be below 100"))
        .when(total > F.col(capacity) * (F.lit(100) - reserve_percent) / 100, F.lit("no reserve left"))
    )
