"""Names, zones, records, addresses, path containment.  All matching is by equi-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.paths import ancestors, suffixes
from ledgerline.skew import attach

# Accepted host key lines and types.
HOST_KEY = r"^(ssh-ed25519|ssh-rsa|ecdsa-sha2-nistp(256|384|521)) [A-Za-z0-9+/]+={0,2}$"


def longest_suffix(names: DataFrame, zones: DataFrame, name: str = "name", zone: str = "zone") -> DataFrame:
    """Most specific zone of each distinct name; null zone where none matches.

    A name has few suffixes, so exploding them turns the scan over all zones into an
    equi-join; a zone that covers a third of the names is spread by ``attach``.
    """
    return longest_suffix_within(names.select(name).distinct(), zones, [], name, zone)


def longest_suffix_within(names: DataFrame, zones: DataFrame, scope: list[str], name: str = "name", zone: str = "zone") -> DataFrame:
    """J6 where only zones with the same ``scope`` columns count; keeps all columns of ``names``."""
    counted = names.groupBy(*names.columns).agg(F.count(F.lit(1)).alias("_rows"))
    exploded = counted.withColumn("_suffix", F.explode(suffixes(F.col(name))))
    known = zones.select(*scope, F.col(zone).alias("_suffix")).distinct().withColumn("_zone", F.col("_suffix"))
    matched = attach(exploded, known, [*scope, "_suffix"], "left")
    best = matched.groupBy(*names.columns, "_rows").agg(F.max_by("_zone", F.length("_zone")).alias(zone))
    return best.withColumn("_rows", F.explode(F.sequence(F.lit(1).cast("bigint"), "_rows"))).drop("_rows")


def trim_dots(col: Column) -> Column:
    return F.rtrim(col, F.lit("."))


def reconcile(desired: DataFrame, actual: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Unchanged where an actual record has the same keys and value (final dots ignored), else upsert."""
    keyed = [trim_dots(F.col(name).cast("string")).alias(f"_k{index}") for index, name in enumerate(keys)]
    on = [f"_k{index}" for index in range(len(keys))] + ["_v"]
    have = actual.select(*keyed, trim_dots(F.col(value).cast("string")).alias("_v")).distinct().withColumn("_same", F.lit(True))
    want = desired.withColumns({f"_k{index}": trim_dots(F.col(name).cast("string")) for index, name in enumerate(keys)})
    want = want.withColumn("_v", trim_dots(F.col(value).cast("string")))
    action = F.when(F.col("_same"), F.lit("unchanged")).otherwise(F.lit("upsert"))
    return attach(want, have, on, "left").select(*keys, value, action.alias("action"))


def check_containment(members: DataFrame, roots: DataFrame, member: str = "path", root: str = "root") -> DataFrame:
    """Number of roots containing each distinct member; anything but one is a violation."""
    exploded = members.select(member).distinct().select(member, F.explode(ancestors(F.col(member))).alias("_prefix"))
    known = roots.select(F.col(root).alias("_prefix")).distinct().withColumn("_root", F.col("_prefix"))
    matched = attach(exploded, known, ["_prefix"], "left")
    return matched.groupBy(member).agg(F.count("_root").alias("roots"), F.min("_root").alias(root))


def overlapping_roots(roots: DataFrame, root: str = "root") -> DataFrame:
    """Roots listed twice, or lying inside another root."""
    twice = roots.groupBy(root).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(root, F.lit("duplicate").alias("problem"))
    distinct = roots.select(root).distinct()
    above = distinct.select(root, F.explode(ancestors(F.col(root))).alias("_outer")).where(F.col(root) != F.col("_outer"))
    inside = attach(above, distinct.select(F.col(root).alias("_outer")), ["_outer"], "left_semi").select(root).distinct()
    return twice.unionByName(inside.select(root, F.lit("inside another root").alias("problem")))


def alias_keys(keys: DataFrame, host: str, key: str, aliases: list[str], allowed: str = HOST_KEY) -> tuple[DataFrame, DataFrame]:
    """(alias, key) for every alias column of the key's host, and the malformed keys.

    The aliases sit next to the key, so the product is an explode of a short array.
    """
    good = F.coalesce(F.col(key).rlike(allowed), F.lit(False))
    distinct = keys.where(good).select(host, key, *[name for name in aliases if name != host]).distinct()
    pairs = distinct.select(F.explode(F.array(*[F.col(name) for name in aliases])).alias("alias"), key).distinct()
    return pairs, keys.where(~good).select(host, key)


def first_gap(used: DataFrame, col: str, above: Column | int, below: Column | int) -> DataFrame:
    """Smallest unused value greater than ``above`` and less than ``below``; null when full.

    A free value directly follows ``above`` or a used one.  Every used value marks itself
    and its successor, and one aggregate finds the successors nobody uses: no scan of the
    range, no window, and copies of a value combine before the shuffle.
    """
    low = F.lit(above) if isinstance(above, int) else above
    high = F.lit(below) if isinstance(below, int) else below
    values = used.select(F.col(col).cast("bigint").alias("v")).where(F.col("v") > low)
    taken = F.struct(F.col("v").alias("v"), F.lit(1).alias("taken"))
    after = F.struct((F.col("v") + 1).alias("v"), F.lit(0).alias("taken"))
    start = used.sparkSession.range(1).select((low + 1).cast("bigint").alias("v"), F.lit(0).alias("taken"))
    marks = values.select(F.explode(F.array(taken, after)).alias("m")).select("m.v", "m.taken").unionByName(start)
    free = marks.groupBy("v").agg(F.max("taken").alias("taken")).where("taken = 0").where(F.col("v") < high)
    return free.agg(F.min("v").alias("first_free"))


def check_agreement(members: DataFrame, side: str, domain: str, connected: Column, expected_domain: str | Column, expected_members: int) -> DataFrame:
    """Per side whether domain, member count and connectivity are as expected."""
    want = F.lit(expected_domain) if isinstance(expected_domain, str) else expected_domain
    return (
        members.groupBy(side)
        .agg(
            F.count(F.lit(1)).alias("members"),
            F.bool_or(connected).alias("connected"),
            F.min(domain).alias("_low"),
            F.max(domain).alias("_high"),
        )
        .select(
            side,
            "members",
            F.coalesce("connected", F.lit(False)).alias("connected"),
            F.coalesce((F.col("_low") == want) & (F.col("_high") == want), F.lit(False)).alias("same_domain"),
        )
        .withColumn("agrees", F.col("connected") & F.col("same_domain") & (F.col("members") == expected_members))
    )
