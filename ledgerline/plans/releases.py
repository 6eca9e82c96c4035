"""Release discovery: stable releases, hold period, newest eligible one, status of every pin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.text import matches_series
from ledgerline.operators import ranking as R
from ledgerline.operators import releases as L

# Hold periods in hours.
DEFAULT_HOLD_HOURS = 48
STRICT_HOLD_HOURS = 168


def discover(pins: DataFrame, releases: DataFrame, now: Column, hold_hours: int = STRICT_HOLD_HOURS, series: str | None = None) -> DataFrame:
    """(target, current, latest, status, detail) per pin.

    ``pins`` has (target, current, is_default), one row per target; ``releases`` has
    (target, version, published_at, draft, prerelease).  A pin that is missing or custom
    is skipped; a target without an eligible release is an error; the newest release
    still held is named in the detail.
    """
    stable = R.stable(releases)
    if series is not None:
        stable = stable.where(matches_series(F.col("version"), series))
    picked = R.pick_release(stable, ["target"], "published_at", "version", now, hold_hours)
    joined = pins.join(picked, "target", "left")
    skip = F.col("current").isNull() | ~F.col("is_default")
    status = (
        F.when(skip, F.lit("skip"))
        .when(F.col("eligible_id").isNull(), F.lit("error"))
        .when(F.col("eligible_id") == F.col("current"), F.lit("current"))
        .otherwise(F.lit("updated"))
    )
    detail = (
        F.when(F.col("current").isNull(), F.lit("version pin not present"))
        .when(~F.col("is_default"), F.lit("custom operator pin"))
        .when(F.col("eligible_id").isNull(), F.lit("no release satisfies the hold"))
        .when(F.col("held_id").isNotNull(), F.concat("held_id", F.lit(" remains inside the hold")))
        .otherwise(F.lit("newest eligible release"))
    )
    return joined.select(
        "target", "current", F.when(~skip, F.col("eligible_id")).alias("latest"), status.alias("status"), detail.alias("detail")
    )


def _eligible(releases: DataFrame, now: Column, hold_hours: int, series: str | None, proofs: list[str]) -> DataFrame:
    """(target, pick) with the newest eligible release of each target: when, which, whether identified, identity, proofs."""
    stable = R.stable(releases).where(R.past_hold(F.col("published_at"), now, hold_hours))
    if series is not None:
        stable = stable.where(matches_series(F.col("version"), series))
    digest = L.identity(F.col("version"), F.col("published_at"), F.col("url"), F.col("assets"))
    row = F.struct(F.col("published_at").alias("ts"), F.col("version").alias("id"), L.identified(F.col("assets")).alias("known"), digest.alias("identity"), *proofs)
    return stable.groupBy("target").agg(F.max(row).alias("pick"))


def discover_confirmed(
    pins: DataFrame, first: DataFrame, second: DataFrame, now: Column, hold_hours: int = STRICT_HOLD_HOURS, series: str | None = None, proofs: tuple[str, ...] = ()
) -> DataFrame:
    """A14 on top of ``discover``: an update is made only if a second read picks the same release.

    ``first`` and ``second`` are two reads of the releases with (url, assets array<struct<name, url, id>>) and the
    ``proofs`` columns (checksum, provenance) beside what ``discover`` needs.  Only pins that would be updated are
    compared.  The second read picks anew; another or no release, other assets in any order, or another proof is an error, as
    is an asset without a name or url.  Two equal versions of one time count with the greater identity.
    """
    found = discover(pins, first, now, hold_hours, series)
    reads = [_eligible(read, now, hold_hours, series, list(proofs)).withColumnRenamed("pick", name) for read, name in ((first, "_a"), (second, "_b"))]
    both = found.join(reads[0], "target", "left").join(reads[1], "target", "left")
    updating = F.col("status") == "updated"
    unknown = updating & (~F.col("_a.known") | ~F.coalesce(F.col("_b.known"), F.lit(True)))
    changed = updating & ~F.col("_a").eqNullSafe(F.col("_b"))
    bad = unknown | changed
    detail = F.when(unknown, F.lit("release has an unidentified asset")).when(changed, F.lit("release changed during re-resolution"))
    return both.select(
        "target", "current", F.when(~bad, F.col("latest")).alias("latest"), F.when(bad, F.lit("error")).otherwise(F.col("status")).alias("status"),
        F.coalesce(detail, F.col("detail")).alias("detail"),
    )
