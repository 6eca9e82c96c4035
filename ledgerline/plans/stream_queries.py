"""Queries that run the streaming operators over files with an available-now trigger."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ledgerline.operators import events as E
from ledgerline.plans.registry import query
from ledgerline.plans.text_queries import redact_sql
from ledgerline.session import discard, file_names, scratch_path
from ledgerline.streaming import logs as L
from ledgerline.streaming.numbering import NumberedLog, append_numbered
from ledgerline.streaming.tail import open_store, tail


def event_stream(t, df, name, files=None):
    """The rows as a stream of Parquet files, some at each trigger."""
    path = scratch_path(t.spark, name)
    df.write.parquet(path)
    reader = t.spark.readStream.schema(df.schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def finish(t, stream, name):
    out = scratch_path(t.spark, name)
    L.run_to_parquet(stream, out, scratch_path(t.spark, name + "-progress"))
    return t.spark.read.schema(stream.schema).parquet(out)


def utc(name):
    return F.col(name).cast("timestamp")


@query(
    "stream_redact",
    f"SELECT doc_id, {redact_sql('text')} AS text FROM documents",
)
def stream_redact(t):
    stream = event_stream(t, t.documents.select("doc_id", "text"), "redact")
    return finish(t, L.stream_redact(stream, "text"), "redacted")


@query(
    "stream_dedupe",
    """
SELECT strftime(ts, '%Y%m%d') || '-' || user_id AS episode_id, row_number() OVER same AS sequence,
  strftime(ts, '%Y%m%d') || '-' || user_id || '-' || lpad(CAST(row_number() OVER same AS VARCHAR), 6, '0') AS event_id, event_id AS delivery, event_type
FROM events WINDOW same AS (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id)""",
)
def stream_dedupe(t):
    """Every event is delivered again with the last hour's events, most of them days late; each is appended once and numbered."""
    episode = F.concat(F.date_format("ts", "yyyyMMdd"), F.lit("-"), "user_id")
    rows = t.events.select(F.col("event_id").alias("delivery"), episode.alias("episode_id"), "event_type")
    stream = event_stream(t, rows.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).orderBy("copy", "delivery"), "dedupe", files=4)
    appended = finish(t, L.stream_dedupe(stream, ["delivery"]), "deduped").drop("copy")
    return E.assign_sequence(appended, "episode_id", ["delivery"])


CHANGE_CUT = "2024-01-04 00:00:00"


@query(
    "stream_changes",
    f"""
WITH b AS (SELECT user_id AS key, ts >= TIMESTAMP '{CHANGE_CUT}' AS late, arg_max(event_type, (ts, event_type)) AS state, max(ts) AS ts FROM events GROUP BY ALL),
one AS (SELECT *, state IN ('error', 'purchase') AS done FROM b WHERE NOT late),
two AS (SELECT b.*, coalesce(one.done, false) AS was_done, one.state AS before FROM b LEFT JOIN one USING (key) WHERE b.late),
last AS (SELECT key, coalesce(two.state, one.state) AS state, greatest(coalesce(two.ts, one.ts), coalesce(one.ts, two.ts)) AS ts,
   coalesce(one.done, false) OR coalesce(two.state IN ('error', 'purchase'), false) AS done FROM one FULL JOIN two USING (key))
SELECT key, state, CASE WHEN done THEN 'terminal' ELSE 'change' END AS outcome FROM one
UNION ALL SELECT key, state, CASE WHEN state IN ('error', 'purchase') THEN 'terminal' ELSE 'change' END FROM two WHERE NOT was_done AND state IS DISTINCT FROM before
UNION ALL SELECT key, state, 'timeout' FROM last WHERE NOT done AND ts + INTERVAL 2 HOURS <= (SELECT max(ts) FROM events)""",
)
def stream_changes(t):
    """Two triggers, before and after a cut; users without news for two hours time out."""
    rows = t.events.select("user_id", utc("ts").alias("ts"), "event_type")
    early = F.col("ts") < F.lit(CHANGE_CUT).cast("timestamp")
    path, out, progress = (scratch_path(t.spark, name) for name in ("changes", "changed", "changed-progress"))
    stream = t.spark.readStream.schema(rows.schema).parquet
    # a run ends with a trigger without rows, in which users would time out whose late events are still to come
    idle = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = t.spark.conf.get(idle)
    for part, ends in ((rows.where(early), False), (rows.where(~early), True)):
        part.write.mode("append").parquet(path)
        reported = L.stream_changes(stream(path), "user_id", "ts", "event_type", ["error", "purchase"], timeout_ms=2 * 3600 * 1000)
        t.spark.conf.set(idle, before if ends else "false")
        try:
            L.run_to_parquet(reported, out, progress)
        finally:
            t.spark.conf.set(idle, before)
    return t.spark.read.schema(reported.schema).parquet(out).select("key", "state", "outcome")


PAIR_ROWS = """
s AS (SELECT event_id AS command, ts FROM events WHERE event_type = 'view'),
e AS (SELECT event_id - 1 AS command, ts, event_type FROM events WHERE event_type IN ('click', 'error'))"""


@query(
    "stream_pairs",
    f"""WITH {PAIR_ROWS}
SELECT s.command, CASE WHEN e.command IS NULL THEN 'incomplete' WHEN e.event_type = 'error' THEN 'failed' ELSE 'passed' END AS status
FROM s LEFT JOIN e ON e.command = s.command AND e.ts <= s.ts + INTERVAL 10 MINUTES""",
)
def stream_pairs(t):
    """A view starts a command; the next event ends it if it is a click or an error within ten minutes.  Then the log ends."""
    kind = F.col("event_type")
    command = F.when(kind == "view", F.col("event_id")).otherwise(F.col("event_id") - 1)
    status = F.when(kind == "error", "failed").otherwise("passed")
    rows = t.events.select(command.alias("command"), utc("ts").alias("ts"), "event_type", status.alias("status"))
    stream = event_stream(t, rows, "pairs")
    paired = L.stream_pairs(stream, "command", "ts", kind == "view", kind.isin("click", "error"), "status", "10 MINUTES")
    starts = rows.where(kind == "view")
    return L.end_of_log(starts, finish(t, paired, "paired"), "command", "ts").select("command", "status")




@query(
    "stream_numbering",
    """
WITH d AS (SELECT *, CASE WHEN event_id % 2 = 0 THEN 1 WHEN event_id % 3 = 0 THEN 2 ELSE 3 END AS delivery, strftime(ts, '%Y%m%d') || '-' || user_id AS episode_id FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY delivery, event_id) AS sequence FROM d)
SELECT event_id AS delivered, episode_id, sequence, episode_id || '-' || lpad(CAST(sequence AS VARCHAR), 6, '0') AS event_id, event_type, delivery, 0 AS changed FROM n""",
)
def stream_numbering(t):
    """Three deliveries, the later ones with smaller keys and with events again; the second batch's commit is lost, so it is replayed."""
    spark = t.spark
    episode = F.concat(F.date_format("ts", "yyyyMMdd"), F.lit("-"), "user_id")
    turn = F.when(F.col("event_id") % 2 == 0, 1).when(F.col("event_id") % 3 == 0, 2).otherwise(3)
    rows = t.events.select(F.col("event_id").alias("delivered"), episode.alias("episode_id"), "event_type", turn.alias("delivery"))
    inbox, progress = scratch_path(spark, "inbox"), scratch_path(spark, "numbering-progress")
    log = NumberedLog(spark, scratch_path(spark, "numbered"), "episode_id", ["delivered"], compact_every=2)
    given = []
    for number in (1, 2, 3):
        rows.where(F.col("delivery") <= number).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(rows.schema).parquet(inbox)
        append_numbered(L.stream_dedupe(stream, ["delivered"]), log, progress)
        if number == 2:
            last = max(file_names(spark, f"{progress}/commits"), key=int)
            discard(spark, f"{progress}/commits/{last}", f"{progress}/commits/.{last}.crc")
        given.append(log.rows().select("delivered", F.col("event_id").alias("given")))
    earlier = given[0].unionByName(given[1])
    moved = earlier.join(given[2].withColumnRenamed("given", "now"), "delivered").groupBy("delivered").agg(F.count_if(F.col("given") != F.col("now")).cast("int").alias("changed"))
    return log.rows().drop("batch").join(moved, "delivered", "left").withColumn("changed", F.coalesce("changed", F.lit(0)))


@query(
    "log_tail",
    """SELECT event_id, event_type, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 2 END AS delivery, 1 AS times FROM events""",
)
def log_tail(t):
    """Log files that grow: half of the lines and a torn one, then the rest; the stream is started again and reads every line once."""
    spark = t.spark
    folder, out, progress = (scratch_path(spark, name) for name in ("log", "log-read", "log-progress"))
    file = F.floor(F.pmod("event_id", F.lit(16)) / 2)
    rows = t.events.select("event_id", "event_type", file.alias("file"), (F.col("event_id") % 2).alias("half"))

    def writer(whole):
        def write(part):
            part = part.sort_values(["half", "event_id"])
            lines = [json.dumps({"event_id": int(i), "event_type": kind}).encode() + b"\n" for i, kind in zip(part["event_id"], part["event_type"], strict=True)]
            first = int((part["half"] == 0).sum())
            text = b"".join(lines if whole else lines[:first]) + (b"" if whole else b"".join(lines[first : first + 1])[:9])
            store, place = open_store(folder)
            store.create_dir(place, recursive=True)
            with store.open_output_stream(f"{place}/{part['file'].iloc[0]}.jsonl") as file:
                file.write(text)
            return part[["event_id"]]

        return write

    for number, whole in ((1, False), (2, True)):
        rows.groupBy("file").applyInPandas(writer(whole), "event_id bigint").write.format("noop").mode("overwrite").save()
        L.run_to_parquet(tail(spark, folder, split=4096).withColumn("delivery", F.lit(number)), out, progress)
    read = spark.read.schema("file string, offset bigint, line string, delivery int").parquet(out)
    found = read.withColumn("row", F.from_json("line", "event_id bigint, event_type string"))
    return found.groupBy(F.col("row.event_id").alias("event_id"), F.col("row.event_type").alias("event_type"), "delivery").agg(F.count(F.lit(1)).cast("int").alias("times"))
