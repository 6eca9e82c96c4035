"""Journals: sequence, lifecycle, pairing, rules, roll-up, prefix, runs and jobs."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import events as E

BASE = dict(
    schema_version=1, episode_id="e", event_id="e-000001", sequence=1, event_type="episode_started", command_id=None, recipe=None,
    command_argv=[], mutation_boundaries=[], status="started", started_at="2024-01-01T00:00:00Z", completed_at="2024-01-01T00:00:00Z",
    exit_code=None, signal=None, failure_code=None, evidence_paths=[], report_generation_id=None,
)


def event(seq, kind, **extra):
    return {**BASE, "sequence": seq, "event_id": f"e-{seq:06d}", "event_type": kind, **extra}


def start(seq, cid="c"):
    return event(seq, "command_started", command_id=cid, recipe="update", command_argv=["just", "update"], status="running", completed_at=None)


def end(seq, cid="c", **extra):
    base = dict(command_id=cid, recipe="update", command_argv=["just", "update"], status="passed", exit_code=0)
    return event(seq, "command_completed", **{**base, **extra})


def frame(spark, events):
    names = [part.strip().split(" ")[0] for part in E.EVENT_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(e[n] for n in names) for e in events], E.EVENT_SCHEMA)


GOOD = [event(1, "episode_started"), start(2), end(3), start(4, "d")]


def test_good_journal_has_no_violation(spark, rows):
    log = frame(spark, GOOD)
    assert rows(E.check_events(log)) == []
    assert rows(E.check_event_ids(log)) == []
    assert rows(E.check_sequence(log, ["episode_id"], "sequence", ("event_type", "episode_started"))) == []


@pytest.mark.parametrize(
    "bad, rule",
    [
        (end(3, exit_code=1), "exit code agrees with status"),
        (end(3, exit_code=300, status="failed", failure_code="command-failed"), "exit status"),
        (end(3, status="failed", exit_code=2), "failure code"),
        (end(3, failure_code="command-failed"), "failure code"),
        (end(3, completed_at="2023-12-31T00:00:00Z"), "completed not before started"),
        (end(3, completed_at="2024-01-01T00:00:00+00:00"), "timestamps are UTC"),
        (end(3, recipe="plan"), "terminal agrees with start"),
        (end(3, evidence_paths=["/etc"]), "evidence paths are relative"),
        (end(3, evidence_paths=["a/../b"]), "evidence paths are relative"),
        (end(3, mutation_boundaries=["unknown"]), "mutation boundaries"),
        (event(3, "command_interrupted", command_id="c", recipe="update", command_argv=["just", "update"], status="failed", failure_code="command-interrupted"), "interrupt signal"),
        (event(3, "other"), "event type"),
        (event(3, "episode_started"), "episode_started"),
        ({**start(3, "x"), "command_argv": ["make"]}, "command_started"),
        (event(3, "reflection_completed", status="passed", evidence_paths=["summary.json"]), "reflection_completed"),
    ],
)
def test_event_rules(spark, rows, bad, rule):
    found = rows(E.check_events(frame(spark, [GOOD[0], GOOD[1], bad])))
    assert ("e", 3, rule) in found


def brute_sequence(numbers):
    out = set()
    for n in set(numbers):
        if n != 1 and n - 1 not in numbers:
            out.add((n, "gap before" if n >= 1 else "before first"))
        if numbers.count(n) > 1:
            out.add((n, "repeated"))
    return out


def test_sequence_against_brute_force(spark, rows):
    rng = random.Random(5)
    logs = {p: [rng.randint(0, 9) for _ in range(rng.randint(1, 9))] for p in range(30)}
    df = spark.createDataFrame([(p, n) for p, ns in logs.items() for n in ns], "p int, n int")
    want = sorted((p, n, rule) for p, ns in logs.items() for n, rule in brute_sequence(ns))
    assert rows(E.check_sequence(df, ["p"], "n")) == sorted(want, key=repr)


def brute_lifecycle(kinds):
    """(position, rule) for a list of s(tart) and t(erminal) letters."""
    out, used, is_open = [], False, False
    for n, kind in enumerate(kinds):
        if kind == "s":
            if used:
                out.append((n, "command id is reused"))
            else:
                used = is_open = True
        elif not is_open:
            out.append((n, "terminal without open start"))
        else:
            is_open = False
    return out


def test_sequence_is_assigned_over_partitions(spark, rows):
    data = [(f"e{i % 3 if i % 2 else 0}", i) for i in range(200)]
    frame = spark.createDataFrame(data, "episode string, delivery int").repartition(9)
    got = rows(E.assign_sequence(frame, "episode", ["delivery"]), "episode", "delivery", "sequence", "event_id")
    want, seen = [], {}
    for episode, delivery in sorted(data):
        seen[episode] = seen.get(episode, 0) + 1
        want.append((episode, delivery, seen[episode], f"{episode}-{seen[episode]:06d}"))
    assert got == sorted(want, key=repr)


def test_lifecycle_against_brute_force(spark, rows):
    histories = ["".join(h) for size in range(1, 6) for h in itertools.product("st", repeat=size)]
    data = [(h, n, kind) for h in histories for n, kind in enumerate(h)]
    df = spark.createDataFrame(data, "cmd string, seq int, kind string")
    got = rows(E.check_lifecycle(df, ["cmd"], "seq", F.col("kind") == "s", F.col("kind") == "t"))
    assert got == sorted([(h, n, rule) for h in histories for n, rule in brute_lifecycle(h)], key=repr)


def pairs(spark, events):
    kind = F.col("event_type")
    return E.pair_events(frame(spark, events), ["episode_id", "command_id"], "sequence", kind == "command_started", kind.isin(E.TERMINAL_TYPES), "status", "failure_code", ["event_id"])


def test_pairing_and_rollup(spark, rows):
    events = [*GOOD, start(5, "f"), end(6, "f", status="failed", exit_code=2, failure_code="spawn-denied")]
    done = pairs(spark, events)
    assert rows(done, "command_id", "sequence", "status", "failure_code") == [
        ("c", 3, "passed", None), ("d", 4, "incomplete", "interrupted-unknown"), ("f", 6, "failed", "spawn-denied"),
    ]
    summary = E.episode_summary(done, ["episode_id"], "sequence", "event_id").collect()[0]
    assert (summary["episode_status"], summary["first_failure_event_id"], summary["command_count"], summary["failure_count"]) == ("incomplete", "e-000004", 3, 2)
    failures = rows(E.episode_failures(done, ["episode_id"], "sequence", "event_id"), "sequence", "recommendation")
    assert failures == [(4, "no-action"), (6, "preflight")]


def test_pairing_ignores_row_order(spark, rows):
    events = [*GOOD, start(5, "f"), end(6, "f")]
    want = rows(pairs(spark, events))
    for seed in range(3):
        random.Random(seed).shuffle(events)
        assert rows(pairs(spark, events)) == want


def test_prefix(spark, rows):
    expected = [{"task": "A", "phase": "1"}, {"task": "B", "phase": "1"}, {"task": "C", "phase": "2"}]
    data = [("x", 1, "A", "1"), ("x", 2, "C", "1"), ("x", 4, "D", "2"), ("y", 1, "A", "1"), ("y", 2, "B", "1"), ("y", 3, "C", "2")]
    df = spark.createDataFrame(data, "ep string, seq int, task string, phase string")
    assert rows(E.check_prefix(df, ["ep"], "seq", expected)) == [("x", 2, "wrong task"), ("x", 3, "missing"), ("x", 4, "beyond expected")]


def test_runs_with_jobs_counts_joined_rows(spark, rows):
    runs = spark.createDataFrame([(1, 1, "push", "w", 10, 20), (2, 6, "push", "w", 10, 20), (3, 9, "pr", "w", 0, 0)], "id int, status int, event string, workflow_id string, created bigint, updated bigint")
    jobs = spark.createDataFrame([(2, "a", 1, 5, 100, 130), (2, "b", None, 6, 100, 0)], "run_id int, name string, status int, task_id int, started bigint, stopped bigint")
    joined = E.runs_with_jobs(runs, jobs)
    assert rows(joined, "id", "job_name", "job_status") == [(1, "-", 0), (2, "a", 1), (2, "b", 0), (3, "-", 0)]
    assert rows(E.latest(joined, "id", 2), "id") == [(2,), (3,)]
    assert rows(E.latest_runs(runs, jobs, 3), "id") == [(2,), (2,), (3,)]
    report = rows(E.run_report(joined, F.lit(200).cast("bigint")), "id", "status", "age", "duration", "job_status")
    assert report == [(1, "success", "3m", "-", "unknown"), (2, "running", "3m", "1m40s", "unknown"), (2, "running", "3m", "30s", "success"), (3, "unknown", "-", "-", "unknown")]
