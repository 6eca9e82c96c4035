"""Queries over changes, evidence, releases and nested records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators import changes as C
from ledgerline.operators import ranking as R
from ledgerline.operators import releases as L
from ledgerline.plans.registry import ORACLES, query
from ledgerline.skew import spread

def plan(t):
    """One planned change per event; the address names a module and an index."""
    act = lambda *names: F.array(*[F.lit(name) for name in names])
    kind, value = F.col("event_type"), F.col("value")
    actions = (
        F.when(kind == "signup", act("create"))
        .when(kind == "view", act("read"))
        .when(kind == "click", F.when(value < 20, act("update")).otherwise(act("update", "create")))
        .when(kind == "purchase", act("no-op"))
        .when(value < 5, act("delete"))
        .when(value < 10, act("delete", "create"))
        .when(value < 20, act("create", "delete"))
        .otherwise(act("delete", "update"))
    )
    address = F.concat(F.lit("module.m"), F.col("user_id") % 30, F.lit("["), F.col("user_id"), F.lit("].r"), F.col("event_id"))
    return t.events.select(address.alias("address"), actions.alias("actions"))


PLAN = """
plan AS (SELECT 'module.m' || (user_id % 30) || '[' || user_id || '].r' || event_id AS address,
  CASE event_type WHEN 'signup' THEN 'create' WHEN 'view' THEN 'read' WHEN 'click' THEN CASE WHEN value < 20 THEN 'update' ELSE 'update/create' END
    WHEN 'purchase' THEN 'no-op' ELSE CASE WHEN value < 5 THEN 'delete' WHEN value < 10 THEN 'delete/create' WHEN value < 20 THEN 'create/delete' ELSE 'delete/update' END
    END AS actions FROM events),
kinds AS (SELECT *, CASE WHEN contains(actions, 'delete') AND contains(actions, 'create') THEN 'replace'
   WHEN actions IN ('delete', 'create', 'update', 'read') THEN actions WHEN actions = 'no-op' THEN 'no_op' END AS kind,
   contains(actions, 'delete') AS destructive FROM plan)"""


@query(
    "change_summary",
    f"""WITH {PLAN} SELECT count(*) FILTER (WHERE kind = 'create') AS "create", count(*) FILTER (WHERE kind = 'update') AS "update",
  count(*) FILTER (WHERE kind = 'replace') AS "replace", count(*) FILTER (WHERE kind = 'delete') AS "delete",
  count(*) FILTER (WHERE kind = 'read') AS "read", count(*) FILTER (WHERE kind = 'no_op') AS no_op,
  count(*) FILTER (WHERE destructive) AS destructive FROM kinds""",
)
def change_summary(t):
    return C.summarize_changes(plan(t))


def registry(t):
    """Nations as services with a module each; some regions hold no state or are switched off."""
    return t.nation.select(
        F.col("n_name").alias("service"), F.concat(F.lit("m"), "n_nationkey").alias("terraform_module"),
        (F.col("n_regionkey") != 2).alias("state_capable"), (F.col("n_regionkey") != 4).alias("enabled"),
    )


OWNED = f"""{PLAN},
owned AS (SELECT address, actions, 'm' || n_nationkey AS module, n_name AS service
  FROM kinds JOIN nation ON 'm' || n_nationkey = regexp_extract(address, '^module\\.([^.\\[]+)', 1)
  WHERE destructive AND n_regionkey NOT IN (2, 4))"""


def owned(t):
    risky = plan(t).where(C.is_destructive(F.col("actions")))
    rows = risky.withColumn("actions", F.array_join("actions", "/"))
    return C.attach_owners(rows, registry(t)).select("address", "actions", "module", "service")


@query("attach_owners", f"WITH {OWNED} SELECT * FROM owned")
def attach_owners(t):
    return owned(t)


@query(
    "stateful_targets",
    f"""WITH {OWNED} SELECT module, count(DISTINCT service) AS services, count(DISTINCT address) AS changes FROM owned GROUP BY module""",
)
def stateful_targets(t):
    """A6 over J8: distinct services and changes per affected module."""
    return owned(t).groupBy("module").agg(
        F.count_distinct("service").alias("services"), F.count_distinct("address").alias("changes")
    )


EVIDENCE_NOW = "2024-01-31 00:00:00"


def backups(t, kept="true"):
    """A backup per event; ``kept`` tells which events."""
    return t.events.where(kept).select(
        F.col("user_id").alias("service"), F.col("ts").alias("mtime"), F.concat(F.lit("state-"), "event_id").alias("name"),
        F.when(F.col("value") < 2, F.lit(None)).otherwise(F.sha2("props", 256)).alias("expected_sha256"),
        F.when(F.col("event_type") == "click", F.sha2(F.lit("other"), 256)).otherwise(F.sha2("props", 256)).alias("sha256"),
        F.when(F.col("event_type") == "view", F.lit("wrong")).otherwise(F.col("user_id").cast("string")).alias("manifest_target"),
        F.lit("backup").alias("archive_kind"), (F.col("event_type") == "error").alias("excluded"),
    )


@query(
    "latest_evidence",
    f"""
WITH b AS (SELECT user_id AS service, ts AS mtime, 'state-' || event_id AS name, value, event_type, sha256(props) AS digest,
   row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE event_type <> 'error')
SELECT service, name AS archive, mtime, CASE WHEN event_type = 'click' THEN sha256('other') ELSE digest END AS sha256,
  CASE WHEN value < 2 THEN 'backup checksum is missing' WHEN event_type = 'click' THEN 'backup checksum does not match'
       WHEN event_type = 'view' THEN 'backup manifest target or kind is invalid'
       WHEN TIMESTAMP '{EVIDENCE_NOW}' - mtime > INTERVAL 24 HOURS THEN 'backup is older than 24 hours' END AS error
FROM b WHERE rn = 1
UNION ALL SELECT user_id, NULL, NULL, NULL, 'backup archive is missing' FROM events GROUP BY user_id HAVING bool_and(event_type = 'error')""",
)
def latest_evidence(t):
    now = F.lit(EVIDENCE_NOW).cast("timestamp_ntz")
    return C.latest_evidence(backups(t), "service", "mtime", "name", now, F.col("excluded"))


GATE_SERVICES = f"""{OWNED},
gb AS (SELECT n_name AS service, n_nationkey AS nk, ts, 'state-' || event_id AS name, value, event_type, sha256(props) AS digest
  FROM events JOIN nation ON n_nationkey = user_id % 25 WHERE n_nationkey % 5 <> 3),
svc AS (SELECT DISTINCT service FROM owned),
named AS (SELECT service FROM gb UNION SELECT service FROM svc),
usable AS (SELECT * FROM gb WHERE event_type <> 'error' AND nk <> 6)"""


def gate_sql(name, rows):
    """SQL of the evidence of every service, from some of the backups."""
    return f"""
{name} AS (SELECT service, n.name, CASE WHEN event_type = 'click' THEN sha256('other') ELSE digest END AS sha,
  CASE WHEN n.name IS NULL THEN 'backup archive is missing' WHEN value < 2 THEN 'backup checksum is missing' WHEN event_type = 'click' THEN 'backup checksum does not match'
       WHEN event_type = 'view' THEN 'backup manifest target or kind is invalid'
       WHEN TIMESTAMP '{EVIDENCE_NOW}' - ts > INTERVAL 24 HOURS THEN 'backup is older than 24 hours' END AS error
  FROM named LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY service ORDER BY ts DESC, name DESC) AS rn FROM usable {rows}) n USING (service) WHERE rn IS NULL OR rn = 1)"""


def gate_evidence(t, services, kept="true"):
    """Evidence of the named services and of every nation that backs up; some have only excluded archives, some none at all."""
    owner = t.nation.where("n_nationkey % 5 <> 3").select(F.col("n_nationkey").alias("_key"), F.col("n_name").alias("_name"))
    every = backups(t).select((F.col("service") % 25).alias("_key")).distinct().join(owner, "_key").select(F.col("_name").alias("service"))
    rows = backups(t, kept).withColumn("_key", F.col("service") % 25).join(owner, "_key").withColumn("service", F.col("_name"))
    rows = rows.withColumn("excluded", F.col("excluded") | (F.col("_key") == 6))
    rows = rows.withColumn("manifest_target", F.when(F.col("manifest_target") == "wrong", F.lit("wrong")).otherwise(F.col("service")))
    now = F.lit(EVIDENCE_NOW).cast("timestamp_ntz")
    known = services.unionByName(every).distinct()
    return C.latest_evidence(rows, "service", "mtime", "name", now, F.col("excluded"), services=known)


@query(
    "change_gate",
    f"""
WITH {GATE_SERVICES},{gate_sql("now_all", "")},{gate_sql("before_all", "WHERE event_type <> 'signup'")},
before AS (SELECT * FROM before_all WHERE NOT ends_with(service, '1')),
kept AS (SELECT * FROM before SEMI JOIN svc USING (service)),
counts AS (
  SELECT 1 AS rule_no, 'plan is expired' AS reason, (SELECT CASE WHEN (SELECT max(l_shipdate) FROM lineitem) > (SELECT max(o_orderdate) FROM orders) THEN 1 ELSE 0 END) AS offending
  UNION ALL SELECT 2, 'plan changed', 0
  UNION ALL SELECT 3, 'plan inputs changed', (SELECT count(*) FROM customer WHERE c_acctbal <= 0)
  UNION ALL SELECT 4, 'commit changed', 1
  UNION ALL SELECT 5, 'plan is destructive', (SELECT count(*) FROM kinds WHERE destructive)
  UNION ALL SELECT 6, 'plan changes several stateful targets', (SELECT CASE WHEN count(DISTINCT module) > 1 THEN count(DISTINCT module) ELSE 0 END FROM owned)
  UNION ALL SELECT 7, 'backup evidence does not cover the services', (SELECT count(*) FROM svc FULL JOIN before ON svc.service = before.service WHERE svc.service IS NULL OR before.service IS NULL)
  UNION ALL SELECT 8, 'no current verified backup', (SELECT count(*) FROM kept WHERE error IS NOT NULL)
  UNION ALL SELECT 9, 'backup evidence changed', (SELECT count(*) FROM kept k FULL JOIN (SELECT * FROM now_all SEMI JOIN svc USING (service)) n ON k.service = n.service
     WHERE k.service IS NULL OR n.service IS NULL OR (k.name, k.sha, k.error) IS DISTINCT FROM (n.name, n.sha, n.error)))
SELECT rule_no, reason, offending = 0 AS passed, offending FROM counts""",
)
def change_gate(t):
    """All nine rules over a saved plan; missing archives and services without any backup count."""
    prints = t.customer.select(F.col("c_custkey").cast("string").alias("path"), F.sha2("c_name", 256).alias("sha256"))
    later = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("path"), F.sha2("c_name", 256).alias("sha256"))
    state = lambda day, commit: [day.alias("day"), F.sha2(F.count(F.lit(1)).cast("string"), 256).alias("plan_sha256"), F.md5(F.lit(commit)).alias("git_commit")]
    saved = t.orders.agg(*state(F.max("o_orderdate").cast("timestamp"), "before")).withColumnRenamed("day", "expires_at")
    shipped = t.lineitem.agg(F.max("l_shipdate").cast("timestamp").alias("now"))
    current = t.orders.agg(*state(F.max("o_orderdate"), "after")).drop("day").join(F.broadcast(shipped))
    risky = owned(t)
    services = risky.select("service").distinct()
    before = gate_evidence(t, services, "event_type <> 'signup'").where(~F.col("service").endswith("1"))
    return C.change_gate(saved, current, prints, later, plan(t), risky, before, gate_evidence(t, services))


@query("gate_first_failure", f"SELECT rule_no, reason FROM ({ORACLES['change_gate']}) WHERE NOT passed ORDER BY rule_no LIMIT 1")
def gate_first_failure(t):
    """The reason at which a run over the saved plan stops."""
    return C.first_failure(change_gate(t))


RELEASE_NOW = "2001-08-01 00:00:00"


@query(
    "pick_release",
    f"""
WITH o AS (SELECT *, o_orderdate <= TIMESTAMP '{RELEASE_NOW}' - INTERVAL 168 HOURS AS ok FROM orders)
SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) FILTER (WHERE ok) AS eligible_id, max(o_orderdate) FILTER (WHERE ok) AS eligible_ts,
       arg_max(o_orderkey, (o_orderdate, o_orderkey)) FILTER (WHERE NOT ok) AS held_id, max(o_orderdate) FILTER (WHERE NOT ok) AS held_ts
FROM o GROUP BY o_custkey""",
)
def pick_release(t):
    return R.pick_release(t.orders, ["o_custkey"], "o_orderdate", "o_orderkey", F.lit(RELEASE_NOW).cast("timestamp_ntz"), 168)


@query(
    "age_gate_stable",
    """
SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '5-LOW' AND regexp_full_match(o_orderpriority, '[1-4]-[A-Z ]+')
  AND o_orderdate <= TIMESTAMP '1998-06-15 00:00:00' - INTERVAL 48 HOURS""",
)
def age_gate_stable(t):
    from ledgerline.functions.text import matches_series

    releases = t.orders.select(
        "o_orderkey", "o_orderdate", "o_orderpriority",
        F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus") == "P").alias("draft"),
        (F.col("o_orderpriority") == "5-LOW").alias("prerelease"),
    )
    stable = R.stable(releases, "draft", "prerelease", "o_orderdate")
    old = R.past_hold(F.col("o_orderdate"), F.lit("1998-06-15 00:00:00").cast("timestamp_ntz"), 48)
    return stable.where(old & matches_series(F.col("o_orderpriority"), "[1-4]-[A-Z ]+")).select("o_orderkey")


@query(
    "hold_filter",
    f"SELECT o_orderkey FROM orders WHERE TIMESTAMP '{RELEASE_NOW}' - o_orderdate >= INTERVAL 168 HOURS",
)
def hold_filter(t):
    return t.orders.where(R.past_hold(F.col("o_orderdate"), F.lit(RELEASE_NOW).cast("timestamp_ntz"), 168)).select("o_orderkey")


@query(
    "first_match",
    r"""
SELECT doc_id, list_filter(regexp_split_to_array(text, '\n'), lambda x: regexp_matches(x, '[0-9]') AND len(x) > 40)[1] AS line FROM documents""",
)
def first_match(t):
    """First line of a document that is long and holds a digit."""
    hit = L.first_match(F.split("text", "\n", -1), lambda x: x.rlike("[0-9]") & (F.length(x) > 40))
    return t.documents.select("doc_id", hit.alias("line"))


@query(
    "group_gate",
    """
WITH m AS (SELECT o_custkey AS grp, o_orderkey AS name, CASE WHEN o_totalprice > 480000 THEN NULL WHEN o_totalprice > 460000 THEN 'custom' ELSE o_orderstatus END AS current,
    o_orderstatus AS dflt, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'new' ELSE o_orderstatus END AS resolved, o_orderdate AS published FROM orders),
f AS (SELECT *, bool_and(current IS NULL) OVER w AS none, bool_or(current IS NULL) OVER w AS part, bool_or(coalesce(current <> dflt, false)) OVER w AS custom,
    current IS DISTINCT FROM resolved AS changed,
    current IS DISTINCT FROM resolved AND TIMESTAMP '2001-01-01 00:00:00' - published < INTERVAL 168 HOURS AS held FROM m WINDOW w AS (PARTITION BY grp)),
g AS (SELECT *, bool_or(held) OVER (PARTITION BY grp) AS any_held FROM f)
SELECT grp, name, CASE WHEN part THEN NULL ELSE current END AS current, CASE WHEN NOT (part OR custom) THEN resolved END AS latest,
  CASE WHEN part OR custom THEN 'skip' WHEN any_held THEN CASE WHEN held THEN 'hold' ELSE 'current' END WHEN changed THEN 'updated' ELSE 'current' END AS status,
  CASE WHEN none THEN 'pin not present' WHEN part THEN 'incomplete operator pin group' WHEN custom THEN 'custom operator pin group'
       WHEN any_held THEN 'pin group held' ELSE 'verified' END AS detail FROM g""",
)
def group_gate(t):
    price = F.col("o_totalprice")
    members = t.orders.select(
        F.col("o_custkey").alias("grp"), F.col("o_orderkey").alias("name"),
        F.when(price > 480000, F.lit(None)).when(price > 460000, "custom").otherwise(F.col("o_orderstatus")).alias("pin"),
        F.col("o_orderstatus").alias("dflt"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "new").otherwise(F.col("o_orderstatus")).alias("resolved"),
        F.col("o_orderdate").alias("published"),
    )
    now = F.lit("2001-01-01 00:00:00").cast("timestamp_ntz")
    return C.group_gate(members, "grp", "name", "pin", "dflt", "resolved", "published", now)


@query(
    "target_status",
    """
SELECT o_orderkey,
  CASE WHEN o_totalprice > 480000 THEN 'skip' WHEN o_totalprice > 460000 THEN 'skip' WHEN o_totalprice > 440000 THEN 'skip'
       WHEN o_orderpriority = '5-LOW' THEN 'current' WHEN TIMESTAMP '2001-01-01 00:00:00' - o_orderdate < INTERVAL 48 HOURS THEN 'hold' ELSE 'updated' END AS status,
  CASE WHEN o_totalprice > 480000 THEN 'file not present' WHEN o_totalprice > 460000 THEN 'version pin not present' WHEN o_totalprice > 440000 THEN 'custom operator pin'
       WHEN o_orderpriority = '5-LOW' THEN 'already at latest' WHEN TIMESTAMP '2001-01-01 00:00:00' - o_orderdate < INTERVAL 48 HOURS THEN 'inside the hold period'
       ELSE 'release is old enough' END AS detail FROM orders""",
)
def target_status(t):
    """Decision order of a single pin."""
    price = F.col("o_totalprice")
    current = F.when(price <= 460000, F.lit("5-LOW"))
    now = F.lit("2001-01-01 00:00:00").cast("timestamp_ntz")
    decided = L.process_target(current, price <= 440000, F.col("o_orderpriority"), F.col("o_orderdate"), now, 48, price <= 480000)
    return t.orders.select("o_orderkey", decided.alias("d")).select("o_orderkey", "d.status", "d.detail")


@query(
    "pivot_complete",
    """
SELECT user_id, arg_max(value, event_id) FILTER (WHERE event_type = 'view') AS "view", arg_max(value, event_id) FILTER (WHERE event_type = 'error') AS error,
  arg_max(value, event_id) FILTER (WHERE event_type = 'purchase' AND value > 30) AS big,
  coalesce(bool_or(event_type = 'view') AND bool_or(event_type = 'error') AND bool_or(event_type = 'purchase' AND value > 30), false) AS complete
FROM events GROUP BY user_id""",
)
def pivot_complete(t):
    kind = F.when((F.col("event_type") == "purchase") & (F.col("value") > 30), "big").otherwise(F.col("event_type"))
    rows = t.events.select("user_id", kind.alias("kind"), "value", "event_id")
    return L.pivot_complete(rows, ["user_id"], "kind", "value", "event_id", ["view", "error", "big"])


@query(
    "identity",
    """
SELECT doc_id FROM documents WHERE (contains(text, 'the') AND lang = 'en') OR n_chars > 3000 OR source = 'src3'""",
)
def identity(t):
    """Two reads of every document, its words as assets: reversed in the second, with some words, sizes and rows changed."""

    def read(rows, words, size):
        asset = lambda word: (word, F.lit("u"), F.length(word))
        return rows.select("doc_id", L.identity(F.col("lang"), size, F.col("source"), words, asset).alias("identity"))

    words = lambda text: F.split(text, " ", -1)
    # what is replaced has no blank, so it may be replaced before the text is cut into words
    changed = F.when(F.col("lang") == "en", F.replace("text", F.lit("the"), F.lit("The"))).otherwise(F.col("text"))
    size = F.when(F.col("n_chars") > 3000, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    documents = spread(t.documents)
    first = read(documents, words(F.col("text")), F.col("n_chars"))
    second = read(documents.where("source <> 'src3'"), F.reverse(words(changed)), size)
    return L.identity_changes(first, second, "doc_id")


@query(
    "attested",
    """
SELECT o_orderkey AS id, 'file-' || o_orderkey AS filename FROM orders
WHERE o_orderpriority <> '5-LOW' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F' AND l_returnflag = 'A')""",
)
def attested(t):
    """Orders as artifacts, lines as bundles: one readable and one broken attestation each."""
    name = F.concat(F.lit("file-"), "o_orderkey")
    digest = F.when(F.col("o_orderpriority") == "5-LOW", F.sha2(F.lit("other"), 256)).otherwise(F.sha2(name, 256))
    artifacts = t.orders.select(F.col("o_orderkey").alias("id"), name.alias("filename"), digest.alias("sha256"))
    line = F.concat(F.lit("file-"), "l_orderkey")
    stated = F.when(F.col("l_returnflag") == "A", F.sha2(line, 256)).otherwise("0")
    subject = F.struct(line.alias("name"), F.create_map(F.lit("sha256"), stated).alias("digest"))
    encoded = F.base64(F.encode(F.to_json(F.struct(F.array(subject).alias("subject"))), "UTF-8"))
    statement = F.regexp_replace(encoded, r"\s", "")
    attestations = F.array(F.struct(F.lit("not base64!").alias("statement")), F.struct(statement.alias("statement")))
    publisher = F.struct(F.lit("ci").alias("kind"), F.col("l_linestatus").alias("repository"))
    bundles = spread(t.lineitem.select("l_orderkey", "l_linestatus", "l_returnflag")).select(publisher.alias("publisher"), attestations.alias("attestations"))
    return L.attested(artifacts, bundles, {"kind": "ci", "repository": "F"}).select("id", "filename")


@query(
    "resolve_pointer",
    """
SELECT o_orderkey AS name, CASE WHEN o_orderstatus = 'F' THEN sha256('c' || o_custkey)[:40] WHEN o_orderstatus = 'P' AND c_acctbal > 0 AND c_nationkey % 5 > 0 THEN sha256('n' || c_nationkey)[:40] END AS "commit",
  CASE WHEN o_orderstatus = 'P' AND c_custkey IS NULL THEN 'tag object is missing' WHEN o_orderstatus = 'P' AND c_acctbal <= 0 THEN 'annotated tag does not resolve to a commit'
       WHEN o_orderstatus = 'P' AND c_nationkey % 5 = 0 THEN 'commit is not 40 hex digits' WHEN o_orderstatus = 'O' THEN 'does not resolve to a commit' END AS error
FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_mktsegment <> 'BUILDING'""",
)
def resolve_pointer(t):
    """Orders point at customers: finished ones directly, pending ones through a tag; some tags name no full commit id."""
    name = lambda letter, key: F.left(F.sha2(F.concat(F.lit(letter), key), 256), F.lit(40))
    kind = F.when(F.col("o_orderstatus") == "F", "commit").when(F.col("o_orderstatus") == "P", "tag").otherwise("tree")
    refs = t.orders.select(F.col("o_orderkey").alias("name"), kind.alias("type"), name("c", "o_custkey").alias("target"))
    objects = t.customer.where("c_mktsegment <> 'BUILDING'").select(
        name("c", "c_custkey").alias("id"), F.when(F.col("c_acctbal") > 0, "commit").otherwise("tag").alias("type"),
        F.when(F.col("c_nationkey") % 5 == 0, F.concat(F.lit("n"), "c_nationkey")).otherwise(name("n", "c_nationkey")).alias("target"),
    )
    return L.resolve_pointer(refs, objects)
