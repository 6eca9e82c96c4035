"""Ordered event logs: sequence, lifecycle, pairing, field rules, roll-ups, run reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.normalize import age_text, decode_status, duration_text, to_utc
from ledgerline.session import durable
from ledgerline.skew import attach
from ledgerline.violations import failed_rules

# Schema version, event types, recipes, failure codes, mutation boundaries.
SCHEMA_VERSION = 1
EVENT_TYPES = [
    "episode_started",
    "command_started",
    "command_completed",
    "command_interrupted",
    "command_spawn_failed",
    "reflection_completed",
]
TERMINAL_TYPES = ["command_completed", "command_interrupted", "command_spawn_failed"]
RECIPES = ["update", "validate", "plan"]
FAILURE_CODES = [
    "command-failed",
    "command-interrupted",
    "spawn-not-found",
    "spawn-denied",
    "plan-artifact-missing",
    "journal-write-failed",
]
BOUNDARIES = [
    "episode_files",
    "tracked_or_private_pins",
    "private_artifacts",
    "private_values_migration",
    "root_plan_artifacts",
    "tooling_workdirs",
    "generated_python_cache",
    "docker_runtime_cache",
]
REPORT_FILES = ["summary.json", "failures.md", "commands.md"]
RECOMMENDATIONS = {
    "spawn-not-found": "preflight",
    "spawn-denied": "preflight",
    "plan-artifact-missing": "workflow-guard",
    "journal-write-failed": "workflow-guard",
    "command-failed": "no-action",
    "command-interrupted": "no-action",
    "interrupted-unknown": "no-action",
}
# Run status codes and which of them end a run.
RUN_STATUS = {
    0: "unknown",
    1: "success",
    2: "failure",
    3: "cancelled",
    4: "skipped",
    5: "waiting",
    6: "running",
    7: "blocked",
}
TERMINAL_OK = ["success", "skipped"]
TERMINAL_BAD = ["failure", "cancelled", "blocked", "unknown"]

# The 17 fields of a journal event.
EVENT_SCHEMA = (
    "schema_version int, episode_id string, event_id string, sequence bigint, event_type string, "
    "command_id string, recipe string, command_argv array<string>, mutation_boundaries array<string>, "
    "status string, started_at string, completed_at string, exit_code int, signal int, failure_code string, "
    "evidence_paths array<string>, report_generation_id string"
)


def check_sequence(events: DataFrame, part: list[str], seq: str, first_type: tuple[str, str] | None = None, start: int = 1) -> DataFrame:
    """Breaks of the rule "sequence runs start, start+1, ... without gap or repeat".

    A break shows locally: a number without its predecessor, a number used twice, or a
    first event of the wrong kind.  Every event marks its own number and the next one;
    one aggregate by (part, number) then knows both.  It combines on the map side and is
    spread evenly even when one part holds most of the events.  Returns (part, seq, rule).
    """
    own = F.struct(F.col(seq).alias("at"), F.lit(1).alias("own"))
    following = F.struct((F.col(seq) + 1).alias("at"), F.lit(0).alias("own"))
    marks = events.select(*part, F.explode(F.array(own, following)).alias("_m"))
    numbers = marks.groupBy(*part, F.col("_m.at").alias(seq)).agg(
        F.sum("_m.own").alias("_n"), F.count_if(F.col("_m.own") == 0).alias("_before")
    )
    rules = F.array_compact(
        F.array(
            F.when(
                (F.col("_before") == 0) & (F.col(seq) != start),
                F.when(F.col(seq) < start, F.lit("before first")).otherwise(F.lit("gap before")),
            ),
            F.when(F.col("_n") > 1, F.lit("repeated")),
        )
    )
    found = numbers.where("_n > 0").select(*part, seq, F.explode(rules).alias("rule"))
    if first_type is not None:
        column, value = first_type
        wrong = events.where((F.col(seq) == start) & ~F.col(column).eqNullSafe(F.lit(value)))
        found = found.unionByName(wrong.select(*part, seq, F.lit("first event type").alias("rule")))
    return found


def check_event_ids(events: DataFrame) -> DataFrame:
    """Events whose id is not episode id plus six-digit sequence."""
    expected = F.concat(F.col("episode_id"), F.lit("-"), F.lpad(F.col("sequence").cast("string"), 6, "0"))
    wide = F.concat(F.col("episode_id"), F.lit("-"), F.col("sequence").cast("string"))
    derived = F.when(F.col("sequence") >= 1000000, wide).otherwise(expected)
    return events.where(~F.col("event_id").eqNullSafe(derived)).select("episode_id", "sequence", "event_id")


def check_journal(events: DataFrame) -> DataFrame:
    """F8, W2, W6 for a whole journal: (episode_id, sequence, rule) of every broken rule.

    Numbers run from 1 without gap or repeat, the first event opens the episode, ids follow from the numbers, a command
    starts once and ends once after that, and all rules on single events and on start and end hold.
    """
    command = F.col("command_id").isNotNull()
    found = [
        check_sequence(events, ["episode_id"], "sequence", ("event_type", "episode_started")),
        check_event_ids(events).select("episode_id", "sequence", F.lit("event id does not follow from the number").alias("rule")),
        check_lifecycle(
            events.where(command), ["episode_id", "command_id"], "sequence", F.col("event_type") == "command_started", F.col("event_type").isin(TERMINAL_TYPES)
        ).select("episode_id", "sequence", "rule"),
        check_events(events),
    ]
    return reduce(DataFrame.unionByName, found)


def event_id(part: str, sequence: Column) -> Column:
    """ST4: a part's name and the number in it, of six digits at least."""
    digits = sequence.cast("string")
    text = F.when(F.length(digits) < 6, F.lpad(digits, 6, "0")).otherwise(digits)
    return F.concat(F.col(part).cast("string"), F.lit("-"), text)


def assign_sequence(events: DataFrame, part: str, order: list[str]) -> DataFrame:
    """ST4: every event with its ``sequence`` in its part, from 1, and the ``event_id`` that follows from it.

    Events are sorted over all partitions, so a part that holds most events lies in many of them.  A
    number is the place within the partition after the part's events in the partitions before.
    """
    placed = durable(
        events.repartitionByRange(part, *order).sortWithinPartitions(part, *order).withColumns({"_pid": F.spark_partition_id(), "_place": F.monotonically_increasing_id()})
    )
    pieces = placed.groupBy(part, "_pid").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(part).orderBy("_pid")) - F.col("_n")
    starts = pieces.withColumn("_before", before).select(part, "_pid", "_first", "_before")
    numbered = placed.join(starts, [part, "_pid"]).withColumn("sequence", F.col("_before") + F.col("_place") - F.col("_first") + 1)
    return numbered.withColumn("event_id", event_id(part, F.col("sequence"))).drop("_pid", "_place", "_first", "_before")


def check_lifecycle(events: DataFrame, part: list[str], seq: str, is_start: Column, is_terminal: Column) -> DataFrame:
    """A command may start once; a terminal needs its start open.

    With a single start allowed, the only valid terminal is the first one after it.  One aggregate
    by command knows the first start, the smallest and largest start and terminal and how many
    there are; a command of one start and one later terminal is sound, and only the others'
    rows are looked at again.  Returns (part, seq, rule).
    """
    marked = events.select(*part, seq, is_start.alias("_s"), is_terminal.alias("_t")).where("_s OR _t")
    facts = marked.groupBy(*part).agg(
        F.min(F.when(F.col("_s"), F.col(seq))).alias("_first_start"),
        F.min(F.when(F.col("_t"), F.col(seq))).alias("_first_end"),
        F.count_if("_s").alias("_starts"),
        F.count_if("_t").alias("_ends"),
    )
    sound = (F.col("_starts") == 1) & ((F.col("_ends") == 0) | ((F.col("_ends") == 1) & (F.col("_first_end") > F.col("_first_start"))))
    suspects = attach(marked, facts.where(~F.coalesce(sound, F.lit(False))).select(*part, "_first_start"), part, "inner")
    after = F.col("_t") & (F.col(seq) > F.col("_first_start"))
    key = F.concat_ws("\x00", *[F.col(name).cast("string") for name in part])
    # grouped by one text, so that the join above stays free to be split
    closes = suspects.where(after).groupBy(key.alias("_key")).agg(F.min(seq).alias("_close"))
    judged = attach(suspects.withColumn("_key", key), closes, ["_key"], "left")
    rule = F.when(F.col("_s") & (F.col(seq) > F.col("_first_start")), F.lit("command id is reused")).when(
        F.col("_t") & ~F.coalesce(F.col(seq) == F.col("_close"), F.lit(False)), F.lit("terminal without open start")
    )
    found = judged.withColumn("rule", rule).where(F.col("rule").isNotNull()).select(*part, seq, "rule")
    nameless = reduce(lambda a, b: a | b, [F.col(name).isNull() for name in part])
    return found.unionByName(marked.where(F.col("_t") & nameless).select(*part, seq, F.lit("terminal without open start").alias("rule")))


def pair_events(
    events: DataFrame, command: list[str], seq: str, is_start: Column, is_terminal: Column, status: str, failure: str, carry: list[str] | None = None
) -> DataFrame:
    """One row per command: its terminal, or the start as incomplete / interrupted-unknown.

    One conditional aggregate per command; no join.  ``carry`` names further columns to
    take from the row that is reported.
    """
    carry = carry or []
    payload = F.struct(
        F.col(seq).alias("sequence"), F.col(status).alias("status"), F.col(failure).alias("failure_code"), *carry
    )
    pairs = events.where(is_start | is_terminal).groupBy(*command).agg(
        F.min(F.when(is_terminal, payload)).alias("_end"), F.min(F.when(is_start, payload)).alias("_begin")
    )
    ended = F.col("_end").isNotNull()
    pick = lambda name: F.when(ended, F.col(f"_end.{name}")).otherwise(F.col(f"_begin.{name}"))
    return pairs.select(
        *command,
        pick("sequence").alias("sequence"),
        F.when(ended, F.col("_end.status")).otherwise(F.lit("incomplete")).alias("status"),
        F.when(ended, F.col("_end.failure_code")).otherwise(F.lit("interrupted-unknown")).alias("failure_code"),
        *[pick(name).alias(name) for name in carry],
    )


def attach_recommendation(df: DataFrame, failure: str = "failure_code", mapping: dict[str, str] | None = None) -> DataFrame:
    """Recommendation by failure code, as a map literal."""
    items = [part for code, kind in (mapping or RECOMMENDATIONS).items() for part in (F.lit(code), F.lit(kind))]
    return df.withColumn("recommendation", F.try_element_at(F.create_map(*items), F.col(failure)))


def event_rules(max_exit: int | None = 255) -> dict[str, Column]:
    """F8: rules of one journal event that need no other row; names in report order."""
    c = F.col
    kind = c("event_type")
    command = kind.startswith("command_")
    empty = lambda name: F.size(c(name)) == 0
    unset = lambda *names: _all([c(name).isNull() for name in names])
    when = lambda condition, rule: ~condition | rule
    ended = kind.isin(TERMINAL_TYPES)
    start, stop = to_utc(c("started_at")), to_utc(c("completed_at"))
    exit_ok = c("exit_code").isNotNull() & (c("exit_code") >= 0)
    if max_exit is not None:
        exit_ok = exit_ok & (c("exit_code") <= max_exit)
    path_ok = F.forall(
        c("evidence_paths"), lambda path: ~path.startswith("/") & ~F.array_contains(F.split(path, "/"), "..")
    )
    return {
        "schema version": c("schema_version") == SCHEMA_VERSION,
        "event type": kind.isin(EVENT_TYPES),
        "timestamps are UTC": c("started_at").endswith("Z") & start.isNotNull()
        & (c("completed_at").isNull() | (c("completed_at").endswith("Z") & stop.isNotNull())),
        "completed not before started": stop.isNull() | (stop >= start),
        "command has id": when(command, c("command_id").isNotNull() & (c("command_id") != "")),
        "command has recipe": when(command, F.coalesce(c("recipe").isin(RECIPES), F.lit(False))),
        "mutation boundaries": when(
            command,
            (F.size(F.array_distinct("mutation_boundaries")) == F.size("mutation_boundaries"))
            & F.forall("mutation_boundaries", lambda item: item.isin(BOUNDARIES)),
        ),
        "no command fields": when(
            ~command, unset("command_id", "recipe") & empty("command_argv") & empty("mutation_boundaries")
        ),
        "evidence paths are relative": path_ok,
        "episode_started": when(
            kind == "episode_started",
            (c("sequence") == 1) & (c("status") == "started") & c("completed_at").isNotNull()
            & unset("exit_code", "signal", "failure_code", "report_generation_id"),
        ),
        "command_started": when(
            kind == "command_started",
            (c("status") == "running") & c("completed_at").isNull()
            & c("command_argv").eqNullSafe(F.array(F.lit("just"), c("recipe")))
            & unset("exit_code", "signal", "failure_code", "report_generation_id"),
        ),
        "terminal status": when(
            ended, c("status").isin("passed", "failed") & c("completed_at").isNotNull() & c("report_generation_id").isNull()
        ),
        "exit status": when(kind == "command_completed", exit_ok & c("signal").isNull()),
        "exit code agrees with status": when(
            kind == "command_completed", (c("exit_code") == 0) == (c("status") == "passed")
        ),
        "failed terminal": when(
            kind.isin("command_interrupted", "command_spawn_failed"), (c("status") == "failed") & c("exit_code").isNull()
        ),
        "interrupt signal": when(kind == "command_interrupted", F.coalesce(c("signal") > 0, F.lit(False))),
        "spawn failure signal": when(kind == "command_spawn_failed", c("signal").isNull()),
        "failure code": when(
            ended,
            F.when(c("status") == "passed", c("failure_code").isNull()).otherwise(
                F.coalesce(c("failure_code").isin(FAILURE_CODES), F.lit(False))
            ),
        ),
        "reflection_completed": when(
            kind == "reflection_completed",
            (c("status") == "passed") & c("completed_at").isNotNull()
            & c("evidence_paths").eqNullSafe(F.array(*[F.lit(name) for name in REPORT_FILES]))
            & F.coalesce(c("report_generation_id") != "", F.lit(False))
            & unset("exit_code", "signal", "failure_code"),
        ),
    }


def _all(conditions: list[Column]) -> Column:
    result = F.lit(True)
    for condition in conditions:
        result = result & condition
    return result


def check_rules(events: DataFrame, key: list[str], rules: dict[str, Column]) -> DataFrame:
    """F8: one row per event and failed rule."""
    return events.select(*key, F.explode(failed_rules(rules)).alias("rule"))


def check_events(events: DataFrame) -> DataFrame:
    """F8 for journal events, including the terminal's agreement with its start."""
    key = ["episode_id", "sequence"]
    own = check_rules(events, key, event_rules())
    command = ["episode_id", "command_id"]
    fields = ["recipe", "command_argv", "mutation_boundaries"]
    start = events.where(F.col("event_type") == "command_started").groupBy(*command).agg(
        F.min(F.struct("sequence", F.struct(*fields).alias("f"))).alias("_start")
    )
    ends = events.where(F.col("event_type").isin(TERMINAL_TYPES)).select(*key, "command_id", *fields)
    joined = attach(ends, start, command, "left")
    same = F.struct(*fields).eqNullSafe(F.col("_start.f"))
    return own.unionByName(joined.where(~same).select(*key, F.lit("terminal agrees with start").alias("rule")))


def episode_summary(commands: DataFrame, episode: list[str], seq: str, event_id: str) -> DataFrame:
    """A10: status (incomplete over failed over passed), first failure and counts per episode."""
    failed = F.col("status") != "passed"
    rank = F.when(F.col("status") == "incomplete", 2).when(failed, 1).otherwise(0)
    per = commands.groupBy(*episode).agg(
        F.max(rank).alias("_rank"),
        F.min(F.when(failed, F.struct(seq, event_id))).alias("_first"),
        F.count(F.lit(1)).alias("command_count"),
        F.count_if(failed).alias("failure_count"),
    )
    status = F.when(F.col("_rank") == 2, F.lit("incomplete")).when(F.col("_rank") == 1, F.lit("failed")).otherwise(F.lit("passed"))
    return per.select(
        *episode,
        status.alias("episode_status"),
        F.col(f"_first.{event_id}").alias("first_failure_event_id"),
        "command_count",
        "failure_count",
    )


def episode_failures(commands: DataFrame, episode: list[str], seq: str, event_id: str) -> DataFrame:
    """A10: failed and incomplete commands with classification and recommendation, as rows.

    Rows instead of arrays: an episode may have any number of commands.  Sort by
    (episode, sequence) to present them.
    """
    failures = commands.where(F.col("status") != "passed").select(*episode, seq, event_id, "failure_code")
    return attach_recommendation(failures)


def check_prefix(records: DataFrame, part: list[str], seq: str, expected: list[dict], ignore: list[str] | None = None) -> DataFrame:
    """The n-th record must be the n-th expected one; returns (part, seq, rule).

    ``expected`` is the declared order: dicts of column values, n from 1.  It becomes an
    array literal, so records are compared in place without a join; missing records are
    found from the set of numbers seen, which the expected list bounds.
    """
    ignore = ignore or []
    columns = [name for name in expected[0] if name not in ignore]
    known = F.array(*[F.struct(*[F.lit(item[name]).alias(name) for name in columns]) for item in expected])
    in_range = F.col(seq).between(1, len(expected))
    want = F.when(in_range, F.get(known, (F.col(seq) - 1).cast("int")))
    rules = {"beyond expected": in_range}
    rules.update({f"wrong {name}": ~in_range | F.col(name).eqNullSafe(want[name]) for name in columns})
    wrong = records.select(*part, F.col(seq).cast("bigint").alias(seq), F.explode(failed_rules(rules)).alias("rule"))
    numbers = F.sequence(F.lit(1).cast("bigint"), F.lit(len(expected)).cast("bigint"))
    seen = records.groupBy(*part).agg(F.collect_set(F.when(in_range, F.col(seq).cast("bigint"))).alias("_seen"))
    missing = seen.select(*part, F.explode(F.array_except(numbers, "_seen")).alias(seq), F.lit("missing").alias("rule"))
    return wrong.unionByName(missing)


def runs_with_jobs(runs: DataFrame, jobs: DataFrame) -> DataFrame:
    """Every run with each of its jobs; a run without jobs appears once with defaults.

    Written as matched jobs plus unmatched runs, so that the uneven side (jobs) is the
    one that can be split.
    """
    defaults = {"name": F.lit("-"), "status": F.lit(0), "task_id": F.lit(0), "started": F.lit(0), "stopped": F.lit(0)}
    names = {"name": "job_name", "status": "job_status", "task_id": "task_id", "started": "started", "stopped": "stopped"}
    job_columns = [F.col("run_id").alias("id"), *[F.coalesce(F.col(name), value.cast(jobs.schema[name].dataType)).alias(names[name]) for name, value in defaults.items()]]
    matched = attach(jobs.select(*job_columns), runs, ["id"], "inner")
    lonely = runs.join(jobs.select(F.col("run_id").alias("id")).distinct(), "id", "left_anti").select(
        "*", *[value.cast(jobs.schema[name].dataType).alias(names[name]) for name, value in defaults.items()]
    )
    return matched.unionByName(lonely)


def run_report(rows: DataFrame, now_epoch: Column) -> DataFrame:
    """Readable status, age and duration for joined runs and jobs."""
    return rows.select(
        "id",
        decode_status(F.col("status"), RUN_STATUS).alias("status"),
        "workflow_id",
        "event",
        age_text(F.col("created"), now_epoch).alias("age"),
        duration_text(F.col("started"), F.col("stopped"), now_epoch).alias("duration"),
        F.col("job_name"),
        decode_status(F.col("job_status"), RUN_STATUS).alias("job_status"),
    )


def join_scope(runners: DataFrame, repos: DataFrame, name: str, scope: str | Column) -> DataFrame:
    """Runners of one name whose repository is ``owner/name``, ignoring case."""
    full = F.lower(F.concat_ws("/", F.col("owner_name"), F.col("lower_name")))
    scope = F.lit(scope) if isinstance(scope, str) else scope
    wanted = repos.where(full == F.lower(scope)).select(F.col("id").alias("repo_id"))
    return runners.where((F.col("name") == name) & (F.col("repo_id") != 0)).join(wanted, "repo_id").select("uuid")


def latest(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n rows with the highest key; the limit counts joined rows."""
    return df.orderBy(F.col(key).desc(), *[F.col(name) for name in df.columns if name != key]).limit(n)


def latest_runs(runs: DataFrame, jobs: DataFrame, n: int) -> DataFrame:
    """J4 with T1: the newest n joined rows.

    Every run gives at least one row, so the newest n runs hold the answer; only their
    jobs are joined, and the broadcast side has n rows.
    """
    newest = runs.orderBy(F.col("id").desc()).limit(n)
    ids = F.broadcast(newest.select(F.col("id").alias("run_id")))
    return latest(runs_with_jobs(newest, jobs.join(ids, "run_id", "left_semi")), "id", n)
