"""Queries that write tables to a new scratch folder and read them back with the library's sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.integrity import ForeignKey, row_counts
from ledgerline.plans.registry import query
from ledgerline.session import durable, scratch_path
from ledgerline.sources import files as S
from ledgerline.sources import generations as G
from ledgerline.sources import hashtree as H
from ledgerline.sources import records as D
from ledgerline.sources import snapshot as N


def numbered_docs(t):
    return t.documents.select(F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("id"), "lang", "n_chars", "text")


def write_lines(df, column, spark, name):
    path = scratch_path(spark, name)
    df.select(F.col(column).alias("value")).write.option("maxRecordsPerFile", 50000).text(path)
    return path


FAULTS = """
f AS (SELECT event_id, CASE WHEN event_type = 'error' AND value < 1 THEN 'invalid JSON' WHEN event_type = 'error' AND value < 2 THEN 'not an object'
  WHEN event_type = 'error' AND value < 3 THEN 'unknown fields: extra, more' WHEN event_type = 'error' AND value < 4 THEN 'invalid id'
  WHEN event_type = 'error' AND value < 7 THEN 'value does not fit its column' END AS rule,
  CASE WHEN event_type = 'error' AND value >= 5 THEN CASE WHEN value < 6 THEN 'wrong type: user' WHEN value < 7 THEN 'wrong type: kind' END END AS type_rule, event_type = 'click' AND value < 1 AS twin FROM events)"""


def faulty_lines(t):
    """One JSON line per event, some broken in a known way, some ids used twice."""
    c = F.col
    ident = F.concat(F.lit("e"), "event_id")
    good = lambda **extra: F.to_json(F.struct(
        ident.alias("id"), c("user_id").alias("user"), c("event_type").alias("kind"), *[F.lit(v).alias(k) for k, v in extra.items()]))
    bad = c("event_type") == "error"
    line = (
        F.when(bad & (c("value") < 1), F.lit("{broken")).when(bad & (c("value") < 2), F.lit("[1]"))
        .when(bad & (c("value") < 3), good(more=1, extra=2)).when(bad & (c("value") < 4), F.to_json(F.struct(c("event_id").alias("id"))))
        .when(bad & (c("value") < 5), F.to_json(F.struct(ident.alias("id"), F.lit("x").alias("user"))))
        .when(bad & (c("value") < 6), F.to_json(F.struct(ident.alias("id"), c("user_id").cast("string").alias("user"), c("event_type").alias("kind"))))
        .when(bad & (c("value") < 7), F.to_json(F.struct(ident.alias("id"), c("user_id").alias("user"), F.lit(True).alias("kind")))).otherwise(good())
    )
    copies = F.when((c("event_type") == "click") & (c("value") < 1), 2).otherwise(1)
    return t.events.select(F.explode(F.array_repeat(line, copies)).alias("line"))


@query("snapshot_strict_rows", f"WITH {FAULTS} SELECT 'e' || e.event_id AS id, user_id AS user, event_type AS kind FROM events e JOIN f USING (event_id) WHERE rule IS NULL UNION ALL SELECT 'e' || e.event_id, user_id, event_type FROM events e JOIN f USING (event_id) WHERE twin")
def snapshot_strict_rows(t):
    path = write_lines(faulty_lines(t), "line", t.spark, "strict")
    return D.read_strict(t.spark, path, "id string, user bigint, kind string")[0]


@query("snapshot_strict_violations", f"WITH {FAULTS} SELECT rule, count(*) AS n FROM (SELECT rule FROM f WHERE rule IS NOT NULL UNION ALL SELECT 'duplicate id: e' || event_id FROM f WHERE twin) GROUP BY rule")
def snapshot_strict_violations(t):
    path = write_lines(faulty_lines(t), "line", t.spark, "strict")
    bad = D.read_strict(t.spark, path, "id string, user bigint, kind string")[1]
    return bad.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query(
    "snapshot_loose",
    f"""WITH {FAULTS} SELECT CASE WHEN rule IN ('invalid JSON', 'not an object') THEN rule ELSE 'record' END AS kind, count(*) + count(*) FILTER (WHERE twin) AS n FROM f GROUP BY 1""",
)
def snapshot_loose(t):
    path = write_lines(faulty_lines(t), "line", t.spark, "loose")
    rows, bad = D.read_loose(t.spark, path)
    kinds = rows.select(F.lit("record").alias("kind")).unionByName(bad.select(F.col("rule").alias("kind")))
    return kinds.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    "snapshot_log",
    f"""WITH {FAULTS} SELECT coalesce(type_rule, CASE WHEN rule IN ('unknown fields: extra, more', 'invalid id', 'value does not fit its column') THEN 'fields do not match the schema' ELSE rule END, 'event') AS kind,
  count(*) + count(*) FILTER (WHERE twin) AS n FROM f GROUP BY 1""",
)
def snapshot_log(t):
    path = write_lines(faulty_lines(t), "line", t.spark, "log")
    rows, bad = D.read_log(t.spark, path, "id string, user bigint, kind string")
    kinds = rows.select(F.lit("event").alias("kind")).unionByName(bad.select(F.col("rule").alias("kind")))
    return kinds.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("snapshot_roundtrip", "SELECT 'd' || lpad(CAST(doc_id AS VARCHAR), 12, '0') AS id, lang, n_chars, text FROM documents")
def snapshot_roundtrip(t):
    docs = numbered_docs(t)
    path = scratch_path(t.spark, "snapshot")
    N.write_snapshot({"documents": docs}, {"counts": row_counts({"documents": docs})}, path)
    return N.read_table(t.spark, path, "documents", docs.schema)


@query(
    "snapshot_verify",
    """SELECT 'after' AS state, rule, 'documents' AS "table", count(*) > 0 AS found FROM documents, (VALUES ('record count'), ('file added')) r(rule) GROUP BY rule""",
)
def snapshot_verify(t):
    """A fresh snapshot in small files has no finding; a line added to a finished table shows as an extra file and a wrong count."""
    path = scratch_path(t.spark, "snapshot")
    docs = numbered_docs(t)
    N.write_snapshot({"documents": docs}, {}, path, records_per_file=100)
    fresh = durable(N.verify_snapshot(t.spark, path).select(F.lit("fresh").alias("state"), "rule", "name"))
    extra = docs.limit(1).select(F.to_json(F.struct("*")).alias("value"))
    extra.write.mode("append").text(f"{path}/tables/documents")
    bad = fresh.unionByName(N.verify_snapshot(t.spark, path).select(F.lit("after").alias("state"), "rule", "name"))
    table = F.regexp_extract("name", "^(?:tables/)?([^/]+)", 1).alias("table")
    return bad.groupBy("state", "rule", table).agg((F.count(F.lit(1)) > 0).alias("found"))


@query("snapshot_manifest", "SELECT 'labels' AS \"table\", count(*) AS declared, 1 AS format_version FROM labels UNION ALL SELECT 'documents', count(*), 1 FROM documents")
def snapshot_manifest(t):
    path = scratch_path(t.spark, "snapshot")
    labels = t.labels.withColumn("id", F.col("doc_id").cast("string"))
    N.write_snapshot({"documents": numbered_docs(t), "labels": labels}, {}, path)
    return N.read_manifest(t.spark, path)


@query(
    "snapshot_load",
    """
SELECT 'orders' AS "table", count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS keys, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents, CAST(sum(length(o_orderpriority)) AS BIGINT) AS letters, 0 AS notes FROM orders
UNION ALL SELECT 'lines', count(*), CAST(sum(l_orderkey) AS BIGINT), CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT), CAST(sum(length(l_returnflag)) AS BIGINT), 0 FROM lineitem""",
)
def snapshot_load(t):
    """Orders, then lines, into an empty target; the absent column comes out null."""
    target = scratch_path(t.spark, "load")
    orders = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("kind"))
    lines = t.lineitem.select(F.col("l_linenumber").alias("id"), F.col("l_orderkey").alias("order_id"), F.col("l_extendedprice").alias("price"), F.col("l_returnflag").alias("kind"))
    rest = {"price": "double", "kind": "string", "note": "string"}
    columns = {"orders": {"id": "bigint", "customer": "bigint", **rest}, "lines": {"id": "int", "order_id": "bigint", **rest}}
    N.load_tables({"orders": orders, "lines": lines}, columns, target, ["orders", "lines"], [ForeignKey("lines", "order_id", "orders")])
    parts = [
        t.spark.read.parquet(f"{target}/{name}").agg(F.count(F.lit(1)).alias("n"), F.sum(key).alias("keys"), F.sum(F.round(F.col("price") * 100).cast("bigint")).alias("cents"), F.sum(F.length("kind")).alias("letters"), F.count("note").cast("int").alias("notes"))
        .withColumn("table", F.lit(name))
        for name, key in (("orders", "customer"), ("lines", "order_id"))
    ]
    return reduce(DataFrame.unionByName, parts)


def tree_level(name, below, depth):
    """SQL of one level of the key tree; trees that are not as deep pass through."""
    return f"""{name} AS (SELECT CASE WHEN max(d) > {depth} THEN substr(b, 1, {depth}) ELSE b END AS b, max(d) AS d, sum(n) AS n, sum(bytes) AS bytes,
  CASE WHEN max(d) > {depth} THEN sha256(string_agg(g, chr(10) ORDER BY b0)) ELSE max(g) END AS g
  FROM (SELECT b AS b0, CASE WHEN d > {depth} THEN substr(b, 1, {depth}) ELSE b END AS b, d, n, bytes, g FROM {below}) GROUP BY b)"""


@query(
    "inventory_totals",
    f"""
WITH k AS (SELECT page_id || ' ' || url AS k, CAST(len(html) AS BIGINT) AS s, sha256(page_id || ' ' || url) AS h FROM pages),
depth AS (SELECT CASE WHEN count(*) <= 16 THEN 0 WHEN count(*) <= 256 THEN 1 WHEN count(*) <= 4096 THEN 2 WHEN count(*) <= 65536 THEN 3 ELSE 4 END AS d FROM k),
leaf AS (SELECT substr(h, 1, d) AS b, max(d) AS d, count(*) AS n, sum(s) AS bytes, sha256(string_agg(k, chr(10) ORDER BY k) || chr(10)) AS g FROM k, depth GROUP BY 1),
{tree_level("l3", "leaf", 3)}, {tree_level("l2", "l3", 2)}, {tree_level("l1", "l2", 1)}, {tree_level("l0", "l1", 0)}
SELECT CAST(sum(n) AS BIGINT) AS object_count, CAST(sum(bytes) AS BIGINT) AS total_bytes, max(g) AS key_tree_sha256 FROM l0""",
)
def inventory_totals(t):
    """Small leaves, so that even small tables have a tree."""
    inventory = t.pages.select(F.concat_ws(" ", "page_id", "url").alias("key"), F.length("html").alias("size"))
    return S.inventory_totals(inventory, leaf_keys=16)


EXPORTED = """
rows AS (SELECT page_id, regexp_extract(url, '/([a-z]{2})/', 1) AS lang, page_id % 20 AS part, regexp_replace(html, '[\\r\\n]+', ' ', 'g') || chr(10) AS value FROM pages),
files AS (SELECT lang, part, string_agg(value, '' ORDER BY page_id) AS content FROM rows GROUP BY lang, part)"""


def exported(t, name):
    """Pages written as text, one sorted file for each language and twentieth of the pages."""
    path = scratch_path(t.spark, name)
    lang = F.regexp_extract("url", "/([a-z]{2})/", 1)
    rows = t.pages.select("page_id", lang.alias("lang"), (F.col("page_id") % 20).alias("part"), F.regexp_replace("html", r"[\r\n]+", " ").alias("value"))
    placed = rows.repartition("lang", "part").sortWithinPartitions("lang", "part", "page_id")
    placed.select("lang", "part", "value").write.partitionBy("lang", "part").text(path)
    return path


def named(rows, column):
    """Language and part of a file by its path."""
    return rows.withColumns({"lang": F.regexp_extract(column, "lang=([a-z]{2})/", 1), "part": F.regexp_extract(column, "part=([0-9]+)/", 1).cast("bigint")})


@query("snapshot_inventory", f"WITH {EXPORTED} SELECT lang, part, CAST(strlen(content) AS BIGINT) AS size, true AS below FROM files")
def snapshot_inventory(t):
    """Key and size of every file written."""
    listing = S.object_inventory(t.spark, exported(t, "inventory"))
    files = named(listing.where(F.col("key").rlike(r"\.txt$")), "key")
    return files.select("lang", "part", "size", F.col("key").rlike("^lang=[a-z]{2}/part=[0-9]+/part-[^/]+$").alias("below"))


@query("snapshot_fingerprint", f"WITH {EXPORTED} SELECT lang, part, CAST(strlen(content) AS BIGINT) AS size, sha256(content) AS sha256 FROM files")
def snapshot_fingerprint(t):
    """Overlapping patterns; files above 20 kB are digested as a stream."""
    path = exported(t, "fingerprint")
    prints = S.fingerprint(t.spark, [f"{path}/lang=*/part=*/part-*", f"{path}/lang=e*/part=1*/*.txt"], inline_bytes=20_000)
    return named(prints, "path").select("lang", "part", "size", "sha256")


@query(
    "snapshot_lines",
    r"""
WITH whole AS (SELECT page_id, regexp_replace(html || chr(10), '\r\n|[\r\n\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]', chr(10), 'g') AS x FROM pages),
pieces AS (SELECT page_id, string_split(x[:-2], chr(10)) AS p FROM whole),
l AS (SELECT page_id, unnest(p) AS text, generate_subscripts(p, 1) AS place FROM pieces)
SELECT page_id % 20 AS part, row_number() OVER (PARTITION BY page_id % 20 ORDER BY page_id, place) AS line, text FROM l""",
)
def snapshot_lines(t):
    """S7 from files of many pages each: the numbers run through the file."""
    path = scratch_path(t.spark, "lines")
    rows = t.pages.select((F.col("page_id") % 20).alias("part"), "page_id", F.col("html").alias("value")).repartition("part").sortWithinPartitions("part", "page_id")
    rows.select("part", "value").write.partitionBy("part").text(path)
    lines = S.read_lines(t.spark, f"{path}/part=*/part-*")
    return lines.select(F.regexp_extract("path", "part=([0-9]+)/", 1).cast("bigint").alias("part"), "line", "text")


@query(
    "snapshot_checksums",
    """
SELECT 'page ' || page_id AS name, CASE WHEN contains(url, '/fr/') THEN 'invalid checksum entry' ELSE sha256(url) END AS digest FROM pages""",
)
def snapshot_checksums(t):
    digest = F.sha2("url", 256)
    cut = F.when(F.col("url").contains("/fr/"), F.left(digest, F.lit(60))).otherwise(digest)
    path = write_lines(t.pages.select(F.concat(cut, F.lit("  *page "), "page_id").alias("line")), "line", t.spark, "checksums")
    rows, bad = S.read_checksums(t.spark, path)
    named = bad.select(F.regexp_extract("entry", r"\*(.*)$", 1).alias("name"), F.col("rule").alias("digest"))
    return rows.unionByName(named)


KV_LINES = """
l AS (SELECT event_id, user_id, event_type, 'K' || event_id AS key, value FROM events)"""


def kv_lines(t):
    key = F.concat(F.lit("K"), "event_id")
    kind = F.col("event_type")
    line = (
        F.when(kind == "view", F.concat(F.lit("export "), key, F.lit("="), "user_id"))
        .when(kind == "click", F.concat(key, F.lit("='two words "), "user_id", F.lit("'")))
        .when(kind == "error", F.concat(key, F.lit('="open '), "user_id"))
        .when(kind == "signup", F.concat(F.lit("# "), key)).otherwise(F.concat(key, F.lit(" is not set")))
    )
    return t.events.select(line.alias("line"))


@query(
    "snapshot_keyvalues",
    f"""WITH {KV_LINES} SELECT key, CASE event_type WHEN 'view' THEN CAST(user_id AS VARCHAR) ELSE 'two words ' || user_id END AS value FROM l WHERE event_type IN ('view', 'click')""",
)
def snapshot_keyvalues(t):
    path = write_lines(kv_lines(t), "line", t.spark, "keyvalues")
    return S.read_keyvalues(t.spark, f"{path}/part-*")[0].select("key", "value")


@query(
    "snapshot_keyvalue_violations",
    f"""WITH {KV_LINES} SELECT CASE event_type WHEN 'error' THEN 'invalid value for ' || key || ': a quote or an escape is not closed' ELSE 'expected KEY=value or export KEY=value' END AS rule, count(*) AS n
FROM l WHERE event_type IN ('error', 'purchase') GROUP BY 1""",
)
def snapshot_keyvalue_violations(t):
    path = write_lines(kv_lines(t), "line", t.spark, "keyvalues")
    bad = S.read_keyvalues(t.spark, f"{path}/part-*", strict=True)[1]
    return bad.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query("relational_scan", "SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal > 0")
def relational_scan(t):
    return D.read_relational(t.spark, t.folder, "supplier").where("s_acctbal > 0").select("s_suppkey", "s_name")


@query(
    "load_recovery",
    """
WITH o AS (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, o_orderstatus = 'F' AS first FROM orders),
l AS (SELECT l_orderkey, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, first FROM lineitem JOIN o ON l_orderkey = o_orderkey),
one AS (SELECT 'orders' AS "table", count(*) AS n, sum(cents) AS cents FROM o WHERE first UNION ALL SELECT 'lines', count(*), sum(cents) FROM l WHERE first),
two AS (SELECT 'orders' AS "table", count(*) AS n, sum(cents) AS cents FROM o UNION ALL SELECT 'lines', count(*), sum(l.cents) FROM l)
SELECT step, "table", n, CAST(cents AS BIGINT) AS cents FROM (SELECT 'first' AS step, * FROM one UNION ALL SELECT 'broken off', * FROM one UNION ALL SELECT 'resumed', * FROM two UNION ALL SELECT 'rolled back', * FROM one)""",
)
def load_recovery(t):
    """A load of some orders; a larger one that dies between two tables, is gone on with, and is taken back."""
    spark, target = t.spark, scratch_path(t.spark, "generations")
    orders = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("kind"))
    lines = t.lineitem.select(F.col("l_linenumber").alias("id"), F.col("l_orderkey").alias("order_id"), F.col("l_extendedprice").alias("price"))
    closed = orders.where(F.col("kind") == "F")
    columns = {"orders": {"id": "bigint", "price": "double", "kind": "string", "note": "string"}, "lines": {"id": "int", "order_id": "bigint", "price": "double"}}
    fks, order = [ForeignKey("lines", "order_id", "orders")], ["orders", "lines"]

    def state(step):
        folder = G.current_path(spark, target)
        return [
            spark.read.parquet(f"{folder}/{name}").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("price") * 100).cast("bigint")).alias("cents")).select(F.lit(step).alias("step"), F.lit(name).alias("table"), "n", "cents")
            for name in order
        ]

    some = {"orders": closed, "lines": lines.join(closed.select(F.col("id").alias("order_id")), "order_id", "left_semi")}
    G.load_generation(some, columns, target, order, fks, "closed orders")
    found = state("first")
    broken = lines.withColumn("price", F.when(F.col("id") > 0, F.raise_error(F.lit("lost input"))).otherwise(F.col("price")))
    try:
        G.load_generation({"orders": orders, "lines": broken}, columns, target, order, fks, "all orders")
    except Exception as error:  # noqa: BLE001  Spark's own error for the failed job
        if "lost input" not in str(error):
            raise
    found += state("broken off")
    G.load_generation({"orders": orders, "lines": lines}, columns, target, order, fks, "all orders")
    found += state("resumed")
    G.roll_back(spark, target)
    found += state("rolled back")
    return reduce(DataFrame.unionByName, found)


@query(
    "inventory_tree_diff",
    """
WITH b AS (SELECT 'd' || doc_id AS key, sha256(coalesce(text, '')) AS digest FROM documents),
a AS (SELECT 'd' || doc_id AS key, CASE WHEN doc_id % 301 = 7 THEN 'new' ELSE sha256(coalesce(text, '')) END AS digest FROM documents WHERE doc_id % 401 <> 9
  UNION ALL SELECT 'more' || doc_id, 'x' FROM documents WHERE doc_id % 499 = 3)
SELECT key, CASE WHEN b.digest IS NULL THEN 'added' WHEN a.digest IS NULL THEN 'removed' ELSE 'changed' END AS kind
FROM b FULL JOIN a USING (key) WHERE a.digest IS DISTINCT FROM b.digest""",
)
def inventory_tree_diff(t):
    """Two stored inventories of all documents, of which few rows differ."""
    ident, digest = F.col("doc_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest")
    before = t.documents.select(F.concat(F.lit("d"), ident).alias("key"), digest)
    after = t.documents.where(ident % 401 != 9).select(F.concat(F.lit("d"), ident).alias("key"), F.when(ident % 301 == 7, F.lit("new")).otherwise(digest).alias("digest"))
    after = after.unionByName(t.documents.where(ident % 499 == 3).select(F.concat(F.lit("more"), ident).alias("key"), F.lit("x").alias("digest")))
    places = [scratch_path(t.spark, "tree") for _ in range(2)]
    for inventory, place in zip((before, after), places, strict=True):
        H.write_tree(inventory, place, depth=1)
    return H.tree_diff(t.spark, *places)
