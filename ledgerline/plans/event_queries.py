"""Queries over ordered logs, runs and jobs, and codes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions import normalize as N
from ledgerline.operators import events as E
from ledgerline.operators import ranking as R
from ledgerline.plans.registry import query

# A fixed clock: 2001-09-09 01:46:40.
NOW_EPOCH = 1000000000


def order_log(t):
    """Orders as starts (sequence 0) and their lines as terminals (sequence = line number)."""
    starts = t.orders.select(
        F.col("o_orderkey").alias("command"), F.lit(0).alias("seq"), F.lit("start").alias("kind"), F.lit("running").alias("status"),
        F.lit(None).cast("string").alias("failure"),
    )
    lines = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("flag"))
    failed = F.col("flag") == "R"
    ends = lines.select(
        F.col("l_orderkey").alias("command"), F.col("l_linenumber").alias("seq"), F.lit("end").alias("kind"),
        F.when(failed, "failed").otherwise("passed").alias("status"), F.when(failed, "command-failed").alias("failure"),
    )
    return starts.unionByName(ends)


ORDER_LOG = """
log AS (SELECT o_orderkey AS command, 0 AS seq, 'start' AS kind, 'running' AS status, CAST(NULL AS VARCHAR) AS failure FROM orders
  UNION ALL SELECT l_orderkey, l_linenumber, 'end', CASE WHEN flag = 'R' THEN 'failed' ELSE 'passed' END,
         CASE WHEN flag = 'R' THEN 'command-failed' END
  FROM (SELECT l_orderkey, l_linenumber, max(l_returnflag) AS flag FROM lineitem GROUP BY ALL))"""

PAIRS = f"""
{ORDER_LOG},
ends AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY command ORDER BY seq) AS rn FROM log WHERE kind = 'end') WHERE rn = 1),
pairs AS (SELECT s.command, coalesce(e.seq, s.seq) AS sequence, coalesce(e.status, 'incomplete') AS status,
       CASE WHEN e.command IS NULL THEN 'interrupted-unknown' ELSE e.failure END AS failure_code
  FROM log s LEFT JOIN ends e USING (command) WHERE s.kind = 'start')"""


def pairs(t):
    return E.pair_events(order_log(t), ["command"], "seq", F.col("kind") == "start", F.col("kind") == "end", "status", "failure")


@query("event_pairs", f"WITH {PAIRS} SELECT * FROM pairs")
def event_pairs(t):
    return pairs(t)


@query(
    "attach_recommendation",
    f"""WITH {PAIRS} SELECT command, sequence, status, failure_code,
  CASE WHEN failure_code IN ('command-failed', 'command-interrupted', 'interrupted-unknown') THEN 'no-action' END AS recommendation FROM pairs""",
)
def attach_recommendation(t):
    return E.attach_recommendation(pairs(t))


@query(
    "sequence_check",
    """
WITH n AS (SELECT conv_id, turn + 1 AS seq FROM conversations WHERE role <> 'system')
SELECT conv_id, seq, 'gap before' AS rule FROM n WHERE seq <> 1 AND (conv_id, seq - 1) NOT IN (SELECT conv_id, seq FROM n)
UNION ALL SELECT conv_id, seq, 'repeated' FROM n GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT conv_id, turn + 1, 'first event type' FROM conversations WHERE role <> 'system' AND turn = 0 AND role <> 'assistant'""",
)
def sequence_check(t):
    """Without the system turns some conversations begin at 2."""
    turns = t.conversations.where("role <> 'system'").select("conv_id", (F.col("turn") + 1).alias("seq"), "role")
    return E.check_sequence(turns, ["conv_id"], "seq", ("role", "assistant"))


@query(
    "line_sequence_check",
    """
WITH n AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT a.l_orderkey, a.l_linenumber, 'gap before' AS rule FROM n a
  LEFT JOIN n b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber + 1 WHERE a.l_linenumber <> 1 AND b.n IS NULL
UNION ALL SELECT l_orderkey, l_linenumber, 'repeated' FROM n WHERE n > 1""",
)
def line_sequence_check(t):
    return E.check_sequence(t.lineitem, ["l_orderkey"], "l_linenumber")


@query(
    "lifecycle_check",
    """
WITH m AS (SELECT user_id, event_id, event_type = 'signup' AS s FROM events WHERE event_type IN ('signup', 'purchase')),
f AS (SELECT *, min(event_id) FILTER (WHERE s) OVER (PARTITION BY user_id) AS first_start FROM m),
c AS (SELECT *, min(event_id) FILTER (WHERE NOT s AND event_id > first_start) OVER (PARTITION BY user_id) AS closing FROM f)
SELECT user_id, event_id, CASE WHEN s THEN 'command id is reused' ELSE 'terminal without open start' END AS rule
FROM c WHERE (s AND event_id > first_start) OR (NOT s AND event_id IS DISTINCT FROM closing)""",
)
def lifecycle_check(t):
    kind = F.col("event_type")
    return E.check_lifecycle(t.events, ["user_id"], "event_id", kind == "signup", kind == "purchase")


@query(
    "event_rules",
    """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, rule FROM lineitem JOIN orders ON o_orderkey = l_orderkey,
 (VALUES ('end not before start'), ('status agrees with flag'), ('open order has discount')) r(rule)
WHERE (rule = 'end not before start' AND l_shipdate < o_orderdate)
   OR (rule = 'status agrees with flag' AND (o_orderstatus = 'F') <> (l_linestatus = 'F'))
   OR (rule = 'open order has discount' AND o_orderstatus = 'O' AND l_discount <= 0)""",
)
def event_rules(t):
    joined = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    rules = {
        "end not before start": F.col("l_shipdate") >= F.col("o_orderdate"),
        "status agrees with flag": (F.col("o_orderstatus") == "F") == (F.col("l_linestatus") == "F"),
        "open order has discount": (F.col("o_orderstatus") != "O") | (F.col("l_discount") > 0),
    }
    return E.check_rules(joined, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], rules)


def journal(t):
    """Journal events built from the event stream: one episode per user and day, with planted faults."""
    c = F.col
    day = F.date_format("ts", "yyyyMMdd")
    kinds = F.create_map(*[F.lit(x) for pair in {
        "signup": "episode_started", "view": "command_started", "click": "command_completed",
        "error": "command_interrupted", "purchase": "command_spawn_failed"}.items() for x in pair])
    argv = F.array(F.lit("just"), F.lit("update"))
    none = F.array().cast("array<string>")
    start = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    terminal = c("event_type").isin("click", "error", "purchase")
    command = c("event_type") != "signup"
    passed = (c("event_type") == "click") & (c("value") < 10)
    return t.events.select(
        F.lit(1).alias("schema_version"),
        F.concat(day, F.lit("-"), c("user_id")).alias("episode_id"),
        c("event_id").cast("string").alias("event_id"),
        c("event_id").alias("sequence"),
        kinds[c("event_type")].alias("event_type"),
        F.when(command, F.concat(F.lit("c"), F.floor(c("event_id") / 40))).alias("command_id"),
        F.when(command, F.when(c("value") > 60, "deploy").otherwise("update")).alias("recipe"),
        F.when(command, argv).otherwise(none).alias("command_argv"),
        none.alias("mutation_boundaries"),
        F.when(c("event_type") == "view", "running").when(passed, "passed").otherwise("failed").alias("status"),
        start.alias("started_at"),
        F.when(terminal, start).alias("completed_at"),
        F.when(c("event_type") == "click", F.when(c("value") < 9, 0).otherwise(2)).alias("exit_code"),
        F.when((c("event_type") == "error") & (c("value") > 2), 15).alias("signal"),
        F.when(terminal & ~passed, F.when(c("value") > 40, "other").otherwise("command-failed")).alias("failure_code"),
        F.array(F.concat(F.when(c("value") > 50, F.lit("/")).otherwise(F.lit("")), F.lit("log.txt"))).alias("evidence_paths"),
        F.lit(None).cast("string").alias("report_generation_id"),
    )


JOURNAL_RULES = """
SELECT strftime(ts, '%Y%m%d') || '-' || user_id AS episode_id, event_id AS sequence, rule FROM events,
 (VALUES ('command has recipe'), ('evidence paths are relative'), ('episode_started'), ('exit code agrees with status'),
         ('interrupt signal'), ('failure code'), ('command_started')) r(rule)
WHERE (rule = 'command has recipe' AND event_type <> 'signup' AND value > 60)
   OR (rule = 'evidence paths are relative' AND value > 50)
   OR (rule = 'episode_started' AND event_type = 'signup')
   OR (rule = 'command_started' AND event_type = 'view' AND value > 60)
   OR (rule = 'exit code agrees with status' AND event_type = 'click' AND value >= 9 AND value < 10)
   OR (rule = 'interrupt signal' AND event_type = 'error' AND value <= 2)
   OR (rule = 'failure code' AND event_type IN ('click', 'error', 'purchase') AND value > 40 AND NOT (event_type = 'click' AND value < 10))"""


@query("journal_rules", JOURNAL_RULES)
def journal_rules(t):
    """All one-event rules over a journal; every episode start is at fault (no completion, wrong status)."""
    return E.check_rules(journal(t), ["episode_id", "sequence"], E.event_rules())


@query(
    "journal_check",
    f"""
WITH j AS (SELECT strftime(ts, '%Y%m%d') || '-' || user_id AS episode_id, event_id, event_type, event_id // 40 AS cmd,
    CASE WHEN value > 60 THEN 'deploy' ELSE 'update' END AS recipe FROM events),
s AS (SELECT episode_id, cmd, arg_min(recipe, event_id) AS started FROM j WHERE event_type = 'view' GROUP BY ALL)
SELECT * FROM ({JOURNAL_RULES})
UNION ALL SELECT j.episode_id, j.event_id, 'terminal agrees with start' FROM j LEFT JOIN s ON s.episode_id = j.episode_id AND s.cmd = j.cmd
WHERE j.event_type IN ('click', 'error', 'purchase') AND s.started IS DISTINCT FROM j.recipe""",
)
def journal_check(t):
    """The full rule set, including agreement of a terminal with its start."""
    return E.check_events(journal(t))


@query(
    "journal_full_check",
    """
WITH numbered AS (SELECT *, strftime(ts, '%Y%m%d') || '-' || user_id AS episode, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id) AS n FROM events),
j AS (SELECT episode, n, event_type, value, event_id // 40 AS cmd, CASE WHEN value > 60 THEN 'deploy' ELSE 'update' END AS recipe,
   event_type IN ('click', 'error', 'purchase') AS ends FROM numbered WHERE NOT (value >= 30 AND value < 33)),
c AS (SELECT *, min(n) FILTER (WHERE event_type = 'view') OVER (PARTITION BY episode, cmd) AS opened FROM j WHERE event_type <> 'signup'),
d AS (SELECT *, min(n) FILTER (WHERE ends AND n > opened) OVER (PARTITION BY episode, cmd) AS closed FROM c),
s AS (SELECT episode, cmd, arg_min(recipe, n) AS started FROM j WHERE event_type = 'view' GROUP BY ALL)
SELECT episode AS episode_id, n AS sequence, 'gap before' AS rule FROM j WHERE n <> 1 AND (episode, n - 1) NOT IN (SELECT episode, n FROM j)
UNION ALL SELECT episode, n, 'first event type' FROM j WHERE n = 1 AND event_type <> 'signup'
UNION ALL SELECT episode, n, 'event id does not follow from the number' FROM j WHERE value >= 35 AND value < 38
UNION ALL SELECT episode, n, CASE WHEN event_type = 'view' THEN 'command id is reused' ELSE 'terminal without open start' END FROM d
  WHERE (event_type = 'view' AND n > opened) OR (ends AND n IS DISTINCT FROM closed)
UNION ALL SELECT episode, n, rule FROM j, (VALUES ('command has recipe'), ('evidence paths are relative'), ('episode_started'), ('exit code agrees with status'),
         ('interrupt signal'), ('failure code'), ('command_started')) r(rule)
WHERE (rule = 'command has recipe' AND event_type <> 'signup' AND value > 60)
   OR (rule = 'evidence paths are relative' AND value > 50)
   OR (rule = 'episode_started' AND event_type = 'signup')
   OR (rule = 'command_started' AND event_type = 'view' AND value > 60)
   OR (rule = 'exit code agrees with status' AND event_type = 'click' AND value >= 9 AND value < 10)
   OR (rule = 'interrupt signal' AND event_type = 'error' AND value <= 2)
   OR (rule = 'failure code' AND ends AND value > 40 AND NOT (event_type = 'click' AND value < 10))
UNION ALL SELECT j.episode, j.n, 'terminal agrees with start' FROM j LEFT JOIN s ON s.episode = j.episode AND s.cmd = j.cmd WHERE j.ends AND s.started IS DISTINCT FROM j.recipe""",
)
def journal_full_check(t):
    """Events numbered by episode, then some lost and some ids spoilt: sequence, ids, life cycle and all rules at once."""
    values = t.events.select(F.col("event_id").alias("_order"), F.col("value").alias("_value"))
    made = journal(t).withColumnRenamed("sequence", "_order").drop("event_id").join(values, "_order")
    numbered = E.assign_sequence(made, "episode_id", ["_order"]).drop("_order")
    kept = numbered.where(~((F.col("_value") >= 30) & (F.col("_value") < 33)))
    spoilt = F.when((F.col("_value") >= 35) & (F.col("_value") < 38), F.lit("x")).otherwise(F.col("event_id"))
    return E.check_journal(kept.withColumn("event_id", spoilt).drop("_value"))


DAY_COMMANDS = """
cmds AS (SELECT user_id, CAST(ts AS DATE) AS day, event_id AS seq, CAST(event_id AS VARCHAR) AS event_id,
  CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'incomplete' ELSE 'passed' END AS status,
  CASE event_type WHEN 'error' THEN 'spawn-denied' WHEN 'signup' THEN 'interrupted-unknown' END AS failure_code FROM events)"""


def day_commands(t):
    kind = F.col("event_type")
    return t.events.select(
        "user_id", F.to_date("ts").alias("day"), F.col("event_id").alias("seq"), F.col("event_id").cast("string").alias("event_id"),
        F.when(kind == "error", "failed").when(kind == "signup", "incomplete").otherwise("passed").alias("status"),
        F.when(kind == "error", "spawn-denied").when(kind == "signup", "interrupted-unknown").alias("failure_code"),
    )


@query(
    "episode_rollup",
    f"""
WITH {DAY_COMMANDS}
SELECT user_id, day, CASE max(CASE status WHEN 'incomplete' THEN 2 WHEN 'failed' THEN 1 ELSE 0 END)
         WHEN 2 THEN 'incomplete' WHEN 1 THEN 'failed' ELSE 'passed' END AS episode_status,
       arg_min(event_id, seq) FILTER (WHERE status <> 'passed') AS first_failure_event_id,
       count(*) AS command_count, count(*) FILTER (WHERE status <> 'passed') AS failure_count
FROM cmds GROUP BY user_id, day""",
)
def episode_rollup(t):
    return E.episode_summary(day_commands(t), ["user_id", "day"], "seq", "event_id")


@query(
    "episode_failures",
    f"""
WITH {DAY_COMMANDS}
SELECT user_id, day, seq, event_id, failure_code, CASE failure_code WHEN 'spawn-denied' THEN 'preflight' ELSE 'no-action' END AS recommendation
FROM cmds WHERE status <> 'passed'""",
)
def episode_failures(t):
    return E.episode_failures(day_commands(t), ["user_id", "day"], "seq", "event_id")


@query(
    "prefix_check",
    """
WITH e(n, role) AS (VALUES (1, 'system'), (2, 'user'), (3, 'assistant'), (4, 'user')),
r AS (SELECT conv_id, turn + 1 AS turn, role FROM conversations)
SELECT conv_id, turn, 'beyond expected' AS rule FROM r WHERE turn > 4
UNION ALL SELECT conv_id, turn, 'wrong role' FROM r JOIN e ON n = turn WHERE r.role <> e.role
UNION ALL SELECT conv_id, n, 'missing' FROM (SELECT DISTINCT conv_id FROM r), e WHERE (conv_id, n) NOT IN (SELECT conv_id, turn FROM r)""",
)
def prefix_check(t):
    expected = [{"role": role} for role in ("system", "user", "assistant", "user")]
    turns = t.conversations.select("conv_id", (F.col("turn") + 1).alias("turn"), "role")
    return E.check_prefix(turns, ["conv_id"], "turn", expected)


def runs(t):
    status = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 6).otherwise(9)
    return t.orders.select(
        F.col("o_orderkey").alias("id"), status.alias("status"), F.col("o_orderpriority").alias("event"),
        F.concat(F.lit("wf-"), "o_custkey").alias("workflow_id"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("created"),
    )


def jobs(t):
    ship = F.unix_timestamp(F.col("l_shipdate").cast("timestamp"))
    return t.lineitem.where("l_returnflag = 'R'").select(
        F.col("l_orderkey").alias("run_id"), F.concat(F.lit("part-"), "l_partkey").alias("name"), F.col("l_linenumber").alias("status"),
        F.col("l_suppkey").alias("task_id"), (ship - F.col("l_quantity").cast("int") * 171).alias("started"),
        F.when(F.col("l_linestatus") == "F", ship).otherwise(0).alias("stopped"),
    )


JOINED = """
runs AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 6 ELSE 9 END AS status, o_orderpriority AS event,
   'wf-' || o_custkey AS workflow_id, CAST(epoch(o_orderdate) AS BIGINT) AS created FROM orders),
jobs AS (SELECT l_orderkey AS run_id, 'part-' || l_partkey AS name, l_linenumber AS status, l_suppkey AS task_id,
   CAST(epoch(l_shipdate) AS BIGINT) - CAST(l_quantity AS INT) * 171 AS started,
   CASE WHEN l_linestatus = 'F' THEN CAST(epoch(l_shipdate) AS BIGINT) ELSE 0 END AS stopped FROM lineitem WHERE l_returnflag = 'R'),
joined AS (SELECT r.*, coalesce(j.name, '-') AS job_name, coalesce(j.status, 0) AS job_status, coalesce(j.task_id, 0) AS task_id,
   coalesce(j.started, 0) AS started, coalesce(j.stopped, 0) AS stopped FROM runs r LEFT JOIN jobs j ON j.run_id = r.id)"""


@query("runs_with_jobs", f"WITH {JOINED} SELECT * FROM joined")
def runs_with_jobs(t):
    return E.runs_with_jobs(runs(t), jobs(t))


@query(
    "latest_runs",
    f"""WITH {JOINED} SELECT * FROM joined ORDER BY id DESC, status, event, workflow_id, created, job_name, job_status, task_id, started, stopped LIMIT 20""",
)
def latest_runs(t):
    return E.latest_runs(runs(t), jobs(t), 20)


def status_sql(column: str) -> str:
    names = ["unknown", "success", "failure", "cancelled", "skipped", "waiting", "running", "blocked"]
    cases = " ".join(f"WHEN {code} THEN '{name}'" for code, name in enumerate(names))
    return f"(CASE {column} {cases} ELSE 'unknown' END)"


def age_sql(start: str, now: str) -> str:
    s = f"greatest(0, {now} - {start})"
    return f"""(CASE WHEN {start} IS NULL OR {start} <= 0 THEN '-' WHEN {s} < 60 THEN {s} || 's' WHEN {s} < 3600 THEN ({s} // 60) || 'm'
  WHEN {s} < 172800 THEN ({s} // 3600) || 'h' ELSE ({s} // 86400) || 'd' END)"""


def duration_sql(start: str, stop: str, now: str) -> str:
    s = f"greatest(0, (CASE WHEN coalesce({stop}, 0) <= 0 THEN {now} ELSE {stop} END) - {start})"
    return f"""(CASE WHEN coalesce({start}, 0) <= 0 THEN '-' WHEN {s} < 60 THEN {s} || 's'
  WHEN {s} < 3600 THEN ({s} // 60) || 'm' || lpad(CAST({s} % 60 AS VARCHAR), 2, '0') || 's'
  ELSE ({s} // 3600) || 'h' || lpad(CAST(({s} // 60) % 60 AS VARCHAR), 2, '0') || 'm' END)"""


@query(
    "run_report",
    f"""WITH {JOINED} SELECT id, {status_sql('status')} AS status, workflow_id, event, {age_sql('created', str(NOW_EPOCH))} AS age,
  {duration_sql('started', 'stopped', str(NOW_EPOCH))} AS duration, job_name, {status_sql('job_status')} AS job_status FROM joined""",
)
def run_report(t):
    return E.run_report(E.runs_with_jobs(runs(t), jobs(t)), F.lit(NOW_EPOCH).cast("bigint"))


@query(
    "decode_status",
    f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {status_sql('CAST(l_quantity AS INT)')} AS by_number,
       {status_sql("TRY_CAST(l_returnflag AS INT)")} AS by_text FROM lineitem""",
)
def decode_status(t):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        N.decode_status(F.col("l_quantity"), E.RUN_STATUS).alias("by_number"),
        N.decode_status(F.col("l_returnflag"), E.RUN_STATUS).alias("by_text"),
    )


EVENT_CLOCK = 1704844800  # 2024-01-10 00:00:00


@query(
    "age_text",
    f"""SELECT event_id, {age_sql('s', str(EVENT_CLOCK))} AS age FROM (
  SELECT event_id, CASE WHEN event_type = 'error' THEN 0 ELSE {EVENT_CLOCK} - ({EVENT_CLOCK} - CAST(floor(epoch(ts)) AS BIGINT)) // (1 + event_id % 5000) END AS s FROM events)""",
)
def age_text(t):
    start = F.when(F.col("event_type") == "error", 0).otherwise(F.lit(EVENT_CLOCK) - F.expr(
        f"floor(({EVENT_CLOCK} - unix_timestamp(date_trunc('second', cast(ts as timestamp)))) / cast(1 + event_id % 5000 as double))"))
    return t.events.select("event_id", N.age_text(start, F.lit(EVENT_CLOCK).cast("bigint")).alias("age"))


@query(
    "duration_text",
    f"""SELECT event_id, {duration_sql('s', 'e', str(EVENT_CLOCK))} AS duration FROM (
  SELECT event_id, CASE WHEN event_type = 'error' THEN 0 ELSE CAST(floor(epoch(ts)) AS BIGINT) END AS s,
     CASE WHEN event_type = 'view' THEN NULL ELSE CAST(floor(epoch(ts)) AS BIGINT) + user_id * user_id - 500 END AS e FROM events)""",
)
def duration_text(t):
    epoch = F.unix_timestamp(F.date_trunc("second", F.col("ts").cast("timestamp")))
    start = F.when(F.col("event_type") == "error", 0).otherwise(epoch)
    stop = F.when(F.col("event_type") != "view", epoch + F.col("user_id") * F.col("user_id") - 500)
    return t.events.select("event_id", N.duration_text(start, stop, F.lit(EVENT_CLOCK).cast("bigint")).alias("duration"))


@query(
    "scope_join",
    """
SELECT 'uuid-' || c.c_custkey AS uuid FROM customer c JOIN supplier s ON c.c_nationkey = s.s_suppkey
JOIN nation n ON n.n_nationkey = s.s_nationkey WHERE c.c_mktsegment = 'BUILDING' AND c.c_nationkey <> 0
AND lower(n.n_name || '/' || s.s_name) IN (SELECT lower(n_name || '/supplier#000000003') FROM nation)""",
)
def scope_join(t):
    """Customers as runners, suppliers as repositories (id = supplier key) owned by their nation."""
    runners = t.customer.select(
        F.concat(F.lit("uuid-"), "c_custkey").alias("uuid"), F.col("c_mktsegment").alias("name"), F.col("c_nationkey").alias("repo_id")
    )
    repos = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("id"), F.col("n_name").alias("owner_name"), F.col("s_name").alias("lower_name")
    )
    scope = repos.where("lower_name = 'Supplier#000000003'").agg(F.max(F.concat_ws("/", "owner_name", "lower_name"))).scalar()
    return E.join_scope(runners, repos, "BUILDING", scope)


@query(
    "head_with_rest",
    "SELECT o_orderkey, o_totalprice, (SELECT count(*) - 20 FROM orders) AS remaining FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
)
def head_with_rest(t):
    return R.head_with_rest(t.orders.select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), F.col("o_orderkey")], 20)


@query(
    "order_default",
    "SELECT doc_id, quality, coalesce(quality, 999999) AS sort_rank FROM documents LEFT JOIN labels USING (doc_id)",
)
def order_default(t):
    joined = t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return R.order_default(joined, "quality", [F.col("doc_id")])
