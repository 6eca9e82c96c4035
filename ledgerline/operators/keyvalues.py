"""Key/value tables (file or group, line index, key, value): rename, fill, overlay, look up."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.skew import attach

#: Parts that the rows of one large group go to.
SALTS = 16


def _literal_map(mapping: dict[str, str]) -> Column:
    return F.create_map(*[part for key, value in mapping.items() for part in (F.lit(key), F.lit(value))])


def rename_key_strict(kv: DataFrame, mapping: dict[str, str], group: list[str]) -> tuple[DataFrame, DataFrame]:
    """(renamed rows, violations).  Old and new key with equal values merge; different values clash."""
    renamed = kv.withColumn("key", F.coalesce(F.try_element_at(_literal_map(mapping), F.col("key")), F.col("key")))
    merged = renamed.groupBy(*group, "key").agg(F.min("value").alias("value"), F.max("value").alias("_high"))
    clash = F.col("value") != F.col("_high")
    return (
        merged.where(~F.coalesce(clash, F.lit(False))).select(*group, "key", "value"),
        merged.where(clash).select(*group, "key"),
    )


def rename_key_prefer_new(kv: DataFrame, mapping: dict[str, str], group: list[str], order: str) -> DataFrame:
    """Rows under the new key win; otherwise the first old row is renamed."""
    new_key = F.coalesce(F.try_element_at(_literal_map(mapping), F.col("key")), F.col("key"))
    rank = F.struct((F.col("key") != new_key).alias("is_old"), F.col(order).alias("place"))
    return (
        kv.groupBy(*group, new_key.alias("_key"))
        .agg(F.min_by(F.struct("value", order), rank).alias("_row"))
        .select(*group, F.col("_key").alias("key"), F.col("_row.value").alias("value"), F.col(f"_row.{order}").alias(order))
    )


def fill_defaults(kv: DataFrame, defaults: dict[str, str], group: list[str]) -> DataFrame:
    """Add default rows for keys a group lacks; existing values stay.

    The defaults are an array literal exploded per group, so no cross join is needed.
    """
    keys = F.array(*[F.lit(key) for key in defaults])
    present = kv.groupBy(*group).agg(
        F.collect_set(F.when(F.col("key").isin(list(defaults)), F.col("key"))).alias("_have")
    )
    added = present.select(*group, F.explode(F.array_except(keys, "_have")).alias("key")).withColumn(
        "value", F.element_at(_literal_map(defaults), F.col("key"))
    )
    return kv.select(*group, "key", "value").unionByName(added)


def overlay(kv: DataFrame, removals: list[str], desired: DataFrame, group: list[str]) -> DataFrame:
    """Keyed overlay with the kind of change per key.

    Keys on the removal list go, then desired non-empty values are set.  Returns
    (group, key, value, change); change is kept, removed, added or changed.
    """
    base = kv.select(*group, "key", F.col("value").alias("_old"))
    wanted = desired.where(F.coalesce(F.col("value"), F.lit("")) != "").select(*group, "key", F.col("value").alias("_new"))
    removed = F.col("key").isin(removals)
    change = (
        F.when(F.col("_new").isNull() & removed, F.lit("removed"))
        .when(F.col("_new").isNull() | F.col("_new").eqNullSafe(F.col("_old")), F.lit("kept"))
        .when(F.col("_old").isNull(), F.lit("added"))
        .otherwise(F.lit("changed"))
    )
    return base.join(wanted, [*group, "key"], "full_outer").select(
        *group, "key", F.when(change == "removed", F.lit(None)).otherwise(F.coalesce("_new", "_old")).alias("value"), change.alias("change")
    )


def copy_keys(source: DataFrame, target: DataFrame, mapping: dict[str, str], group: list[str]) -> tuple[DataFrame, DataFrame]:
    """(copied rows with a changed flag, missing source keys).

    ``mapping`` is target key to source key.  Both sides are reduced to the mapped
    keys first and meet in one aggregate per group.
    """
    pairs = F.array(*[F.struct(F.lit(t).alias("target"), F.lit(s).alias("source")) for t, s in mapping.items()])
    have = source.where(F.col("key").isin(list(set(mapping.values())))).select(*group, "key", "value")
    groups = source.select(*group).distinct().select(*group, F.explode(pairs).alias("p"))
    wanted = groups.select(*group, F.col("p.target").alias("target_key"), F.col("p.source").alias("key"))
    found = wanted.join(have, [*group, "key"], "left")
    missing = found.where(F.col("value").isNull()).select(*group, "key").distinct()
    old = target.select(*group, F.col("key").alias("target_key"), F.col("value").alias("_old"))
    copied = found.where(F.col("value").isNotNull()).join(old, [*group, "target_key"], "left")
    return copied.select(*group, F.col("target_key").alias("key"), "value", (~F.col("value").eqNullSafe(F.col("_old"))).alias("changed")), missing


def project_fields(kv: DataFrame, group: list[str], required: list[str], defaults: dict[str, str]) -> DataFrame:
    """One row per group with a column per field and the sorted list of missing required ones."""
    names = [*required, *defaults]
    # Spark sorts rows to take the greatest text of a group; it sorts them behind a shuffle, whose parts have a bounded size, not a whole input split.
    # A group's rows of one split stay together; those of a large group come from many splits and go to up to SALTS parts.
    rows = kv.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS))).repartition(*group, "_salt")
    parts = rows.groupBy(*group, "_salt").agg(*[F.max(F.when(F.col("key") == name, F.col("value"))).alias(name) for name in names])
    wide = parts.groupBy(*group).agg(*[F.max(name).alias(name) for name in names])
    missing = F.array_compact(F.array(*[F.when(F.col(name).isNull(), F.lit(name)) for name in sorted(required)]))
    return wide.withColumn("missing", F.array_join(missing, ", ")).withColumns(
        {name: F.coalesce(F.col(name), F.lit(value)) for name, value in defaults.items()}
    )


def explode_items(df: DataFrame, key: str, items: str, enabled: Column, override: dict[str, str], default: Column, include_disabled: bool = True) -> DataFrame:
    """P25: list entries in order, with checked/skipped status and one overridable column."""
    rows = df.withColumn("_enabled", enabled).withColumn("_default", default)
    if not include_disabled:
        rows = rows.where("_enabled")
    group = F.col("_default")
    if override:
        group = F.coalesce(F.try_element_at(_literal_map(override), F.col("item")), group)
    return rows.select(key, "_enabled", "_default", F.posexplode(items).alias("position", "item")).select(
        key, "position", "item", group.alias("group"), F.when(F.col("_enabled"), F.lit("checked")).otherwise(F.lit("skipped")).alias("status")
    )


def resolve_vars(registry: DataFrame, variables: str, kv: DataFrame, service: str) -> DataFrame:
    """Value of each service variable; variables that are null or absent give no row.

    ``registry`` has a map column from variable name to key; ``kv`` has (key, value).
    """
    wanted = registry.select(service, F.explode(variables).alias("variable", "key"))
    values = kv.where(F.col("value").isNotNull()).select("key", "value")
    return attach(wanted, values, ["key"], "inner").select(service, "variable", "value")


def fill_from(wide: DataFrame, rules: list[tuple[str, str, str]], render: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """On pivoted rows, set ``key`` from ``related`` where ``key`` equals ``marker``.

    Each rule is (key, marker, related); an empty related value changes nothing.
    """
    columns = {}
    for key, marker, related in rules:
        source = F.nullif(F.col(related), F.lit(""))
        columns[key] = F.when((F.col(key) == marker) & source.isNotNull(), render(source)).otherwise(F.col(key))
    return wide.withColumns(columns)


def compare_and_set(kv: DataFrame, group: list[str], old: dict[str, str], new: dict[str, str], allow_absent: bool = False) -> DataFrame:
    """Replace a group's values only if every one still equals its old default.

    Groups in which any key differs or is missing stay as they are; with
    ``allow_absent`` a group holding none of the keys takes the new set as well.
    Returns all key rows with a changed flag.
    """
    in_set = F.col("key").isin(list(old))
    same = F.coalesce(F.try_element_at(_literal_map(old), F.col("key")) == F.col("value"), F.lit(False))
    flags = kv.groupBy(*group).agg(F.count_if(in_set).alias("_present"), F.count_if(same).alias("_same"))
    ready = (F.col("_present") == len(old)) & (F.col("_same") == len(old))
    absent = F.col("_present") == 0
    replacement = F.try_element_at(_literal_map(new), F.col("key"))
    joined = attach(kv.select(*group, "key", "value"), flags, group, "inner")
    take = ready & in_set & replacement.isNotNull()
    updated = joined.select(
        *group, "key", F.when(take, replacement).otherwise(F.col("value")).alias("value"), F.coalesce(take, F.lit(False)).alias("changed")
    )
    if not allow_absent:
        return updated
    fresh = flags.where(absent).select(*group, F.explode(_literal_map(new)).alias("key", "value")).withColumn("changed", F.lit(True))
    return updated.unionByName(fresh)


def both_set(a: Column, b: Column) -> Column:
    """true when two exclusive settings are both given."""
    return a.isNotNull() & b.isNotNull()


def exclusive_choice(first: Column, second: Column, first_value: Column, second_value: Column) -> Column:
    """struct(value, error): the value of the enabled mode; both enabled is an error, none is empty."""
    both = first & second
    return F.struct(
        F.when(~both & first, first_value).when(~both & second, second_value).when(~both, F.lit("")).alias("value"),
        F.when(both, F.lit("modes are mutually exclusive")).alias("error"),
    )


def classify_slot(rows: DataFrame, group: list[str], exact: Column, related: Column) -> DataFrame:
    """present, conflict or absent per group.

    One exact row and no conflict means present; a row that shares slot, source or
    target without being exact is a conflict.
    """
    counts = rows.groupBy(*group).agg(F.count_if(exact).alias("_exact"), F.count_if(related & ~exact).alias("_conflicts"))
    state = (
        F.when(F.col("_conflicts") > 0, F.lit("conflict")).when(F.col("_exact") == 1, F.lit("present")).otherwise(F.lit("absent"))
    )
    return counts.select(*group, state.alias("state"))


def union_values(frames: list[DataFrame], col: str) -> DataFrame:
    """Distinct values over several sources."""
    return reduce(DataFrame.unionByName, [frame.select(col) for frame in frames]).distinct()


def unknown(selected: DataFrame, known: DataFrame) -> DataFrame:
    """Selected rows that are not known."""
    return selected.subtract(known)


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in both sets."""
    return a.intersect(b)
