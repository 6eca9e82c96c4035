"""Streams over append-only logs: live pairing, change reports, redaction, idempotent append."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerline.functions.text import redact


def stream_pairs(events: DataFrame, command: str, ts: str, is_start: Column, is_terminal: Column, status: str, timeout: str, delay: str = "0 seconds") -> DataFrame:
    """ST1: a command is emitted when its terminal arrives, or as incomplete after the timeout.

    A stream-stream outer join: state is kept per command on the JVM side and dropped
    once the watermark has passed the timeout, whether or not a terminal came.
    """
    starts = events.where(is_start).withWatermark(ts, delay).select(F.col(command), F.col(ts).alias("started_at"))
    ends = events.where(is_terminal).withWatermark(ts, delay).select(
        F.col(command).alias("_command"), F.col(ts).alias("completed_at"), F.col(status).alias("_status")
    )
    in_time = F.col("completed_at").between(F.col("started_at"), F.col("started_at") + F.expr(f"INTERVAL {timeout}"))
    paired = starts.join(ends, (F.col(command) == F.col("_command")) & in_time, "leftOuter")
    return paired.select(
        command, "started_at", "completed_at", F.coalesce("_status", F.lit("incomplete")).alias("status")
    )


def end_of_log(starts: DataFrame, paired: DataFrame, command: str, ts: str) -> DataFrame:
    """ST1 once a log has ended: what ``stream_pairs`` gave, and every start that it still holds open as incomplete."""
    left = starts.select(command, F.col(ts).alias("started_at")).join(paired.select(command), command, "left_anti")
    missing = left.withColumns({"completed_at": F.lit(None).cast("timestamp"), "status": F.lit("incomplete")})
    return paired.unionByName(missing.select(*paired.columns))


#: Keys are dealt over so many groups by their hash; a group's keys are folded in one call and are one row of the state.
GROUPS = 1024
#: Microseconds of a key that has had no news with a time.
NEVER = -(1 << 63) // 1000


def newest_only(rows: pd.DataFrame) -> pd.DataFrame:
    """One row per key: the last by time, then by state, nulls last."""
    return rows.sort_values(["ts", "state"]).drop_duplicates("key", keep="last")


def stream_changes(
    events: DataFrame, key: str, ts: str, state: str, terminal: list[str], timeout_ms: int, delay: str = "0 seconds", groups: int = GROUPS
) -> DataFrame:
    """ST2: each trigger reports the newest state of a key if its text differs from the last one reported.

    Like a poll, a trigger sees the current state only.  Reporting stops at a terminal
    state; a key without news until the timeout is reported once as such.  Output: (key,
    ts, state, outcome) with outcome change, terminal or timeout.

    Python is called once for a group of keys and not for every key.  The state of a group holds time, last report, end and deadline of each of its
    keys; keys that have timed out leave it.  It times out with the first of its keys, and rows are folded chunk by chunk.
    """
    finished = set(terminal)
    key_type = events.schema[key].dataType.simpleString()
    name_type = key_type if key_type == "binary" else "string"

    def report(_: tuple, chunks: Iterator[pd.DataFrame], store: GroupState) -> Iterator[pd.DataFrame]:
        known = {name: member for name, *member in zip(*store.get, strict=True)} if store.exists else {}
        now = store.getCurrentWatermarkMs()
        found, news = [], {}
        for chunk in () if store.hasTimedOut else chunks:
            newest = newest_only(chunk)
            times = newest["ts"].astype("datetime64[us]")
            for name, absent, at, current in zip(newest["key"], times.isna(), times.astype("int64"), newest["state"], strict=True):
                old_at, old = news.get(name) or (known[name][:2] if name in known else (NEVER, None))
                # of equal times the larger state is the newer one, null being the largest
                later = not absent and (at > old_at or (at == old_at and (old is not None if current is None else current > (old or ""))))
                news[name] = (at, current) if later else (old_at, old)
        for name, (at, current) in news.items():
            _, last, done, _ = known.get(name, (NEVER, None, False, 0))
            if not done and current != last:
                done = current in finished
                found.append((name, at, current, "terminal" if done else "change"))
            known[name] = [at, current, done, max(now + 1, at // 1000 + timeout_ms)]
        for name in [name for name, member in known.items() if member[3] < now]:
            at, last, done, _ = known.pop(name)
            if not done:
                found.append((name, at, last, "timeout"))
        if known:
            store.update((list(known), *map(list, zip(*known.values(), strict=True))))
            store.setTimeoutTimestamp(min(member[3] for member in known.values()))
        elif store.exists:
            store.remove()
        if found:
            yield pd.DataFrame(found, columns=["key", "at", "state", "outcome"])

    rows = events.select(F.col(key).cast(name_type).alias("key"), F.col(ts).alias("ts"), F.col(state).alias("state"))
    # before the shuffle a batch keeps one row per key, so a busy key stays small
    reduced = rows.mapInPandas(lambda batches: map(newest_only, batches), f"key {name_type}, ts timestamp, state string").withWatermark("ts", delay)
    dealt = reduced.withColumn("group", F.pmod(F.xxhash64("key"), F.lit(groups)).cast("int"))
    reported = dealt.groupBy("group").applyInPandasWithState(
        report,
        f"key {name_type}, at bigint, state string, outcome string",
        f"keys array<{name_type}>, moments array<bigint>, last array<string>, done array<boolean>, deadlines array<bigint>",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )
    return reported.select(F.col("key").cast(key_type).alias("key"), F.timestamp_micros("at").alias("ts"), "state", "outcome")


def stream_redact(lines: DataFrame, col: str) -> DataFrame:
    """ST3: C1 on a stream; stateless."""
    return lines.withColumn(col, redact(F.col(col)))


def stream_dedupe(events: DataFrame, ids: list[str], ts: str | None = None, delay: str = "1 hour", salts: int = 16) -> DataFrame:
    """ST4: each id passes once, for ever; with a time column only until the watermark has passed it by ``delay``.

    The first stage removes copies per (id, salt), which spreads an id that is delivered
    very often; the second one, which sees at most ``salts`` copies, decides.
    """
    if ts is None:
        spread = events.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        return spread.dropDuplicates([*ids, "_salt"]).drop("_salt").dropDuplicates(ids)
    salted = events.withWatermark(ts, delay).withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    return salted.dropDuplicatesWithinWatermark([*ids, "_salt"]).drop("_salt").dropDuplicatesWithinWatermark(ids)


#: State of streams on disk, with a bound on what an executor holds of it in memory.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
}


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB."""
    old = {key: spark.conf.get(key, None) for key in STATE}
    for key, value in STATE.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in old.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def run_to_parquet(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process all input that is available now and stop; state is on disk."""
    with rocksdb(stream.sparkSession):
        writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        writer.trigger(availableNow=True).start().awaitTermination()
