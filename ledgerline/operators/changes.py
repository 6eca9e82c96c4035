"""Planned changes, their stateful owners, backup evidence and the gate over all of it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.integrity import fingerprint_diff, set_cover
from ledgerline.skew import attach
from ledgerline.violations import first_reason

# Change kinds and the freshness limit in hours.
KINDS = ["create", "update", "replace", "delete", "read", "no_op"]
MAX_BACKUP_AGE_HOURS = 24


def change_kind(actions: Column) -> Column:
    """A3: kind of an action list; null for lists that are not counted."""
    only = lambda name: actions.eqNullSafe(F.array(F.lit(name)))
    has = lambda name: F.array_contains(actions, name)
    return (
        F.when(has("delete") & has("create"), F.lit("replace"))
        .when(only("delete"), F.lit("delete"))
        .when(only("create"), F.lit("create"))
        .when(only("update"), F.lit("update"))
        .when(only("read"), F.lit("read"))
        .when(only("no-op"), F.lit("no_op"))
    )


def is_destructive(actions: Column) -> Column:
    """A3: any list with delete, also those without a counted kind."""
    return F.coalesce(F.array_contains(actions, "delete"), F.lit(False))


def summarize_changes(changes: DataFrame, actions: str = "actions", group: list[str] | None = None) -> DataFrame:
    """A3: number of changes per kind and of destructive changes, in one pass."""
    kind = change_kind(F.col(actions))
    counts = [F.count_if(kind == name).alias(name) for name in KINDS]
    return changes.groupBy(*(group or [])).agg(*counts, F.count_if(is_destructive(F.col(actions))).alias("destructive"))


def top_module(address: Column, strip_index: bool = True) -> Column:
    """Module name of an address; ``module.name[0].x`` gives ``name``.

    ``strip_index=False`` keeps the index, which then matches no registry entry.
    """
    second = F.split_part(address, F.lit("."), F.lit(2))
    name = F.regexp_replace(second, r"\[.*$", "") if strip_index else second
    return F.when(address.startswith("module.") & (second != ""), name)


def attach_owners(changes: DataFrame, registry: DataFrame, address: str = "address", strip_index: bool = True) -> DataFrame:
    """One row per destructive change and enabled stateful service of its module.

    ``registry`` has (service, terraform_module, state_capable, enabled).
    """
    owners = registry.where("enabled AND state_capable AND terraform_module IS NOT NULL").select(
        F.col("terraform_module").alias("module"), "service"
    )
    targets = changes.withColumn("module", top_module(F.col(address), strip_index)).where(F.col("module").isNotNull())
    return attach(targets, owners, ["module"], "inner")


def latest_evidence(
    backups: DataFrame, service: str, mtime: str, name: str, now: Column, excluded: Column, max_age_hours: int = MAX_BACKUP_AGE_HOURS, services: DataFrame | None = None
) -> DataFrame:
    """Newest backup per service and the first check it fails.

    Checks, in order: archive missing (all excluded), checksum missing, checksum
    mismatch, wrong target or kind, too old.  Expects the columns expected_sha256,
    sha256, manifest_target and archive_kind.  ``services`` names services that are judged even
    if they have no backup row at all.
    """
    usable = F.when(~excluded, F.struct(F.col(mtime).alias("mtime"), F.col(name).alias("name"), "expected_sha256", "sha256", "manifest_target", "archive_kind"))
    known = backups.select(F.col(service), usable.alias("b"))
    if services is not None:
        known = known.unionByName(services.select(F.col(service), F.lit(None).cast(known.schema["b"].dataType).alias("b")))
    newest = known.groupBy(service).agg(F.max("b").alias("b"))
    age_limit = F.make_dt_interval(F.lit(0), F.lit(max_age_hours))
    error = first_reason(
        [
            (F.col("b").isNull(), "backup archive is missing"),
            (F.col("b.expected_sha256").isNull(), "backup checksum is missing"),
            (F.col("b.expected_sha256") == "", "backup checksum is empty"),
            (~F.col("b.expected_sha256").eqNullSafe(F.col("b.sha256")), "backup checksum does not match"),
            (
                ~F.col("b.manifest_target").eqNullSafe(F.col(service).cast("string")) | ~F.col("b.archive_kind").eqNullSafe(F.lit("backup")),
                "backup manifest target or kind is invalid",
            ),
            (now - F.col("b.mtime") > age_limit, f"backup is older than {max_age_hours} hours"),
        ]
    )
    return newest.select(
        service, F.col("b.name").alias("archive"), F.col("b.mtime").alias("mtime"), F.col("b.sha256").alias("sha256"), error.alias("error")
    )


def gate_results(rules: list[tuple[int, str, DataFrame]]) -> DataFrame:
    """Gate table: one row per rule with the number of offending rows.

    Each entry is (number, reason, offending rows); the lowest failing number is the
    reason a run stops.
    """
    parts = [
        rows.agg(F.count(F.lit(1)).alias("offending")).select(
            F.lit(number).alias("rule_no"), F.lit(reason).alias("reason"), (F.col("offending") == 0).alias("passed"), "offending"
        )
        for number, reason, rows in rules
    ]
    return reduce(DataFrame.unionByName, parts)


def first_failure(gate: DataFrame) -> DataFrame:
    """First failing rule of a gate table (one row; null reason when all pass)."""
    return gate.agg(F.min(F.when(~F.col("passed"), F.struct("rule_no", "reason"))).alias("f")).select(
        F.col("f.rule_no").alias("rule_no"), F.col("f.reason").alias("reason")
    )


def group_gate(members: DataFrame, group: str, name: str, current: str, default: str, resolved: str, published: str, now: Column, hold_hours: int = 168) -> DataFrame:
    """Status of every member of a pin group; the group moves together or not at all.

    ``current`` is null where the pin is absent.  Flags per group come from one
    aggregate and are attached to the members with hot groups spread.
    """
    absent = F.col(current).isNull()
    custom = ~absent & ~F.col(current).eqNullSafe(F.col(default))
    changed = ~F.col(resolved).eqNullSafe(F.col(current))
    held = changed & (now - F.col(published) < F.make_dt_interval(F.lit(0), F.lit(hold_hours)))
    rows = members.select(
        group, name, F.col(current).alias("current"), F.col(resolved).alias("_resolved"),
        absent.alias("_absent"), custom.alias("_custom"), changed.alias("_changed"), F.coalesce(held, F.lit(False)).alias("_held"),
    )
    flags = rows.groupBy(group).agg(
        F.bool_and("_absent").alias("_none"),
        F.bool_or("_absent").alias("_some_absent"),
        F.bool_or("_custom").alias("_any_custom"),
        F.bool_or("_held").alias("_any_held"),
    )
    skip = F.col("_none") | F.col("_some_absent") | F.col("_any_custom")
    status = (
        F.when(skip, F.lit("skip"))
        .when(F.col("_any_held"), F.when(F.col("_held"), F.lit("hold")).otherwise(F.lit("current")))
        .when(F.col("_changed"), F.lit("updated"))
        .otherwise(F.lit("current"))
    )
    detail = (
        F.when(F.col("_none"), F.lit("pin not present"))
        .when(F.col("_some_absent"), F.lit("incomplete operator pin group"))
        .when(F.col("_any_custom"), F.lit("custom operator pin group"))
        .when(F.col("_any_held"), F.lit("pin group held"))
        .otherwise(F.lit("verified"))
    )
    shown_current = F.when(F.col("_some_absent"), F.lit(None)).otherwise(F.col("current"))
    latest = F.when(~skip, F.col("_resolved"))
    return attach(rows, flags, [group], "inner").select(
        group, name, shown_current.alias("current"), latest.alias("latest"), status.alias("status"), detail.alias("detail")
    )


def change_gate(
    saved: DataFrame,
    current: DataFrame,
    inputs_saved: DataFrame,
    inputs_now: DataFrame,
    changes: DataFrame,
    owned: DataFrame,
    evidence_saved: DataFrame,
    evidence_now: DataFrame,
    allow_destroy: bool = False,
    allow_batch: bool = False,
) -> DataFrame:
    """The gate over a saved plan, rules in their fixed order; see ``gate_results`` for the output.

    ``saved`` (expires_at, plan_sha256, git_commit) and ``current`` (now, plan_sha256,
    git_commit) have one row each; inputs are (path, sha256); ``changes`` has an actions
    array; ``owned`` comes from ``attach_owners``; evidence is that of ``latest_evidence``.
    """
    s, c = saved.select(F.struct("*").alias("s"), F.lit(1).alias("_one")), current.select(F.struct("*").alias("c"), F.lit(1).alias("_one"))
    head = s.join(c, "_one")
    differs = lambda name: ~F.col(f"s.{name}").eqNullSafe(F.col(f"c.{name}"))
    both_known = F.col("s.git_commit").isNotNull() & F.col("c.git_commit").isNotNull()
    risky = changes.where(is_destructive(F.col("actions")))
    modules = owned.select("module").distinct()
    several = modules.where(modules.agg(F.count(F.lit(1))).scalar() > 1)
    services = owned.select("service").distinct()
    kept = evidence_saved.join(services, "service", "left_semi")
    uncovered = set_cover(services, evidence_saved, "service")
    judged = fingerprint_diff(
        kept.select("service", F.to_json(F.struct("archive", "sha256", "error")).alias("state")),
        evidence_now.join(services, "service", "left_semi").select("service", F.to_json(F.struct("archive", "sha256", "error")).alias("state")),
        "service",
        "state",
    )
    none = lambda rows: rows.limit(0)
    return gate_results(
        [
            (1, "plan is expired", head.where(F.col("c.now") > F.col("s.expires_at"))),
            (2, "plan changed", head.where(differs("plan_sha256"))),
            (3, "plan inputs changed", fingerprint_diff(inputs_saved, inputs_now, "path", "sha256")),
            (4, "commit changed", head.where(both_known & differs("git_commit"))),
            (5, "plan is destructive", none(risky) if allow_destroy else risky),
            (6, "plan changes several stateful targets", none(several) if allow_batch else several),
            (7, "backup evidence does not cover the services", uncovered),
            (8, "no current verified backup", kept.where(F.col("error").isNotNull())),
            (9, "backup evidence changed", judged),
        ]
    )
