"""Queries over keys, references, counts, audits and value rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions.normalize import check_required, check_vector
from ledgerline.functions.text import signature
from ledgerline.functions.normalize import all_cidr, is_cidr
from ledgerline.operators import integrity as I
from ledgerline.operators import winners as W
from ledgerline.plans.registry import query
from ledgerline.skew import spread

LINE_KEYS = ["l_orderkey", "l_linenumber"]
LINE_REST = ["l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


def best_lines(t):
    order = [-F.col("l_extendedprice"), F.col("l_shipdate"), *[F.col(name) for name in LINE_REST]]
    return W.keep_best(t.lineitem, LINE_KEYS, order)


BEST_LINES_SQL = """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,
       l_returnflag, l_linestatus, l_shipdate
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
        ORDER BY l_extendedprice DESC, l_shipdate, l_partkey, l_suppkey, l_quantity, l_discount, l_tax,
                 l_returnflag, l_linestatus) AS rn
      FROM lineitem) WHERE rn = 1"""


@query("dedup_keep_best", BEST_LINES_SQL)
def dedup_keep_best(t):
    return best_lines(t)


@query(
    "dedup_audit",
    """
SELECT event_id AS id, kept_id FROM (
  SELECT event_id, first_value(event_id) OVER (PARTITION BY user_id, event_type
           ORDER BY value DESC, ts, event_id) AS kept_id FROM events)
WHERE event_id <> kept_id""",
)
def dedup_audit(t):
    order = W.edge_order(F.col("value"), F.col("ts"), F.col("event_id"))
    return W.dedup_audit(t.events, ["user_id", "event_type"], order, "event_id")


@query(
    "dedup_counts",
    """
SELECT count(*) AS raw_count, count(DISTINCT (l_orderkey, l_linenumber)) AS unique_count,
       count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS dropped_count FROM lineitem""",
)
def dedup_counts(t):
    return W.dedup_counts(t.lineitem, LINE_KEYS)


@query(
    "deduplicated_order_check",
    f"""
WITH kept AS ({BEST_LINES_SQL})
SELECT 'kept lines' AS measure, count(*) AS n FROM kept
UNION ALL SELECT 'dangling orders', count(DISTINCT l_orderkey) FROM kept
  WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')
UNION ALL SELECT 'raw lines', count(*) FROM lineitem""",
)
def deduplicated_order_check(t):
    """Flagship: deduplicate lines, check them against the orders that are not pending, count."""
    kept = best_lines(t)
    fk = I.ForeignKey("lineitem", "l_orderkey", "orders", "o_orderkey", "l_linenumber")
    dangling = I.fk_violations({"lineitem": kept, "orders": t.orders.where("o_orderstatus <> 'P'")}, [fk])
    counts = I.row_counts({"kept lines": kept, "dangling orders": dangling, "raw lines": t.lineitem})
    return counts.select(F.col("table").alias("measure"), F.col("actual").alias("n"))


@query(
    "fk_violations",
    """
SELECT 'lineitem.l_orderkey' AS edge, CAST(l_orderkey AS VARCHAR) AS value, count(*) AS row_count,
       CAST(min(l_linenumber) AS VARCHAR) AS first_id
FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') GROUP BY l_orderkey
UNION ALL
SELECT 'lineitem.l_partkey', CAST(l_partkey AS VARCHAR), count(*), CAST(min(l_linenumber) AS VARCHAR)
FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 40) GROUP BY l_partkey
UNION ALL
SELECT 'orders.o_custkey', CAST(o_custkey AS VARCHAR), count(*), CAST(min(o_orderkey) AS VARCHAR)
FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0) GROUP BY o_custkey""",
)
def fk_violations(t):
    tables = {
        "lineitem": t.lineitem,
        "orders": t.orders,
        "open_orders": t.orders.where("o_orderstatus <> 'P'"),
        "small_parts": t.part.where("p_size <= 40"),
        "solvent": t.customer.where("c_acctbal >= 0"),
    }
    return I.fk_violations(
        tables,
        [
            I.ForeignKey("lineitem", "l_orderkey", "open_orders", "o_orderkey", "l_linenumber"),
            I.ForeignKey("lineitem", "l_partkey", "small_parts", "p_partkey", "l_linenumber"),
            I.ForeignKey("orders", "o_custkey", "solvent", "c_custkey", "o_orderkey"),
        ],
    )


@query(
    "orphan_repair",
    """
WITH parents AS (SELECT DISTINCT source FROM documents WHERE source NOT LIKE 'src1%'),
live AS (SELECT d.text, min(d.source) AS low, max(d.source) AS high, min(d.doc_id) AS doc_id
         FROM documents d SEMI JOIN parents USING (source) GROUP BY d.text),
orphans AS (SELECT d.* FROM documents d ANTI JOIN parents USING (source))
SELECT o.doc_id AS id, o.source AS missing_parent,
       CASE WHEN l.low = l.high THEN l.low END AS duplicate_parent,
       CASE WHEN l.low = l.high THEN l.doc_id END AS duplicate_id,
       CASE WHEN l.low = l.high THEN 'dropped' ELSE 'violation' END AS outcome
FROM orphans o LEFT JOIN live l ON o.text = l.text""",
)
def orphan_repair(t):
    parents = t.documents.where("source NOT LIKE 'src1%'").select("source").distinct()
    documents = spread(t.documents.select("doc_id", "source", "text"))
    _, dropped, bad = I.repair_orphans_by_signature(
        documents, parents, "source", signature(F.col("text")), "doc_id", "source"
    )
    bad = bad.withColumns({"duplicate_parent": F.lit(None).cast("string"), "duplicate_id": F.lit(None).cast("bigint")})
    return dropped.withColumn("outcome", F.lit("dropped")).unionByName(bad.withColumn("outcome", F.lit("violation")))


@query(
    "bounded_orphans",
    """
WITH orphans AS (SELECT o_orderkey AS id, o_custkey AS missing_parent, o_orderstatus AS status,
                        row_number() OVER (ORDER BY o_orderkey) AS rn
                 FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 9500))
SELECT id, missing_parent, status,
       CASE WHEN rn <= 5 AND status = 'F' THEN 'dropped' ELSE 'violation' END AS outcome FROM orphans""",
)
def bounded_orphans(t):
    parents = t.customer.where("c_acctbal < 9500")
    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus")
    _, dropped, bad = I.repair_bounded_orphans(
        orders, parents, "o_custkey", "o_orderstatus", ["F"], "o_orderkey", 5, "c_custkey"
    )
    return dropped.withColumn("outcome", F.lit("dropped")).unionByName(bad.withColumn("outcome", F.lit("violation")))


ALL = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query("row_counts", "\nUNION ALL ".join(f"SELECT '{name}' AS \"table\", count(*) AS actual FROM {name}" for name in ALL))
def row_counts(t):
    return I.row_counts({name: getattr(t, name) for name in ALL})


@query(
    "count_check",
    """
SELECT * FROM (
  SELECT 'orders' AS "table", (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS declared, (SELECT count(*) FROM orders) AS actual
  UNION ALL SELECT 'part', (SELECT count(DISTINCT l_partkey) FROM lineitem), (SELECT count(*) FROM part)
  UNION ALL SELECT 'supplier', (SELECT count(DISTINCT l_suppkey) FROM lineitem), (SELECT count(*) FROM supplier))
WHERE declared IS DISTINCT FROM actual""",
)
def count_check(t):
    """Declared counts are the keys seen in lineitem."""
    keys = {"orders": "l_orderkey", "part": "l_partkey", "supplier": "l_suppkey"}
    lines = t.lineitem.agg(*[F.count_distinct(column).alias(name) for name, column in keys.items()])
    declared = lines.select(F.expr("stack(3, " + ", ".join(f"'{name}', {name}" for name in keys) + ") AS (`table`, declared)"))
    return I.check_counts({"orders": t.orders, "part": t.part, "supplier": t.supplier}, declared)


@query(
    "uniqueness",
    "SELECT l_orderkey, l_linenumber, count(*) AS row_count FROM lineitem GROUP BY ALL HAVING count(*) > 1",
)
def uniqueness(t):
    return I.check_unique(t.lineitem, LINE_KEYS)


@query(
    "multi_owned",
    """
SELECT p_name, count(*) AS claims, count(DISTINCT p_brand) AS owners, min(p_brand) AS first_owner, max(p_brand) AS last_owner
FROM part GROUP BY p_name HAVING count(*) > 1""",
)
def multi_owned(t):
    return I.multi_owned(t.part, "p_name", "p_brand")


@query(
    "single_value",
    """
SELECT o_custkey, min(o_orderpriority) AS low, max(o_orderpriority) AS high FROM orders
GROUP BY o_custkey HAVING min(o_orderpriority) <> max(o_orderpriority)""",
)
def single_value(t):
    return I.check_single_value(t.orders, ["o_custkey"], "o_orderpriority")


@query(
    "vector_check",
    """
SELECT vec_id, CASE WHEN len(v) <> 64 THEN 'wrong dimension' ELSE 'non-finite value' END AS error
FROM (SELECT vec_id, list_transform(list_filter(embedding, lambda x: x > -0.25), lambda x: CASE WHEN x > 0.3 THEN CAST('inf' AS FLOAT) ELSE x END) AS v
      FROM embeddings)
WHERE len(v) <> 64 OR len(list_filter(v, lambda x: isinf(x) OR isnan(x))) > 0""",
)
def vector_check(t):
    """Components below -0.25 are lost and those above 0.3 overflow, so both rules have hits."""
    damaged = F.transform(
        F.filter("embedding", lambda x: x > F.lit(-0.25).cast("float")),
        lambda x: F.when(x > F.lit(0.3).cast("float"), F.lit(float("inf")).cast("float")).otherwise(x),
    )
    return check_vector(t.embeddings.select("vec_id", damaged.alias("v")), "v", 64, "vec_id")


@query(
    "required_check",
    """
SELECT doc_id, 'quality, toxic' AS missing FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
)
def required_check(t):
    joined = t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left")
    return check_required(joined, ["toxic", "quality", "lang"], "doc_id")


@query(
    "audit_check",
    """
WITH f AS (SELECT count(DISTINCT (user_id, event_type)) AS kept,
                  count(*) - count(DISTINCT (user_id, event_type)) AS dropped,
                  count(*) AS raw, count(DISTINCT user_id) AS declared FROM events)
SELECT kept, dropped, kept AS keys, rule FROM f,
 (VALUES ('unique count matches rows'), ('dropped count is consistent'), ('keys are unique')) r(rule)
WHERE (rule = 'unique count matches rows' AND declared <> kept)
   OR (rule = 'dropped count is consistent' AND raw - declared <> dropped)
   OR (rule = 'keys are unique' AND kept <> declared)""",
)
def audit_check(t):
    """A wrong declaration (the number of users) against the true output of the deduplication."""
    raw = t.events.agg(F.count(F.lit(1))).scalar()
    declared = t.events.agg(F.count_distinct("user_id")).scalar()
    keys = ["user_id", "event_type"]
    order = W.edge_order(F.col("value"), F.col("ts"), F.col("event_id"))
    kept, dropped = W.keep_best(t.events, keys, order), W.dedup_audit(t.events, keys, order, "event_id")
    return I.check_audit(kept, dropped, keys, raw, declared)


@query(
    "set_cover",
    """
WITH en AS (SELECT doc_id FROM documents WHERE lang = 'en')
SELECT doc_id, 'missing' AS side FROM en WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, 'unexpected' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM en)""",
)
def set_cover(t):
    return I.set_cover(t.documents.where("lang = 'en'"), t.labels, "doc_id")


SHIFTED_SQL = """
before AS (SELECT c_custkey AS k, c_mktsegment || ':' || c_nationkey AS v FROM customer),
after AS (SELECT c_custkey AS k, CASE WHEN c_mktsegment = 'BUILDING' THEN 'moved' ELSE c_mktsegment || ':' || c_nationkey END AS v
          FROM customer WHERE c_acctbal > 0
          UNION ALL SELECT 1000000000000 + s_suppkey, 'new' FROM supplier)"""


@query(
    "fingerprint_diff",
    f"""
WITH {SHIFTED_SQL}
SELECT k, CASE WHEN b.k0 IS NULL THEN 'added' WHEN a.k1 IS NULL THEN 'removed' ELSE 'changed' END AS kind,
       b.v AS before, a.v AS after
FROM (SELECT k, k AS k0, v FROM before) b FULL JOIN (SELECT k, k AS k1, v FROM after) a USING (k)
WHERE b.k0 IS NULL OR a.k1 IS NULL OR a.v IS DISTINCT FROM b.v""",
)
def fingerprint_diff(t):
    state = F.concat_ws(":", "c_mktsegment", "c_nationkey")
    before = t.customer.select(F.col("c_custkey").alias("k"), state.alias("v"))
    after = t.customer.where("c_acctbal > 0").select(
        F.col("c_custkey").alias("k"), F.when(F.col("c_mktsegment") == "BUILDING", "moved").otherwise(state).alias("v")
    )
    new = t.supplier.select((F.lit(1000000000000) + F.col("s_suppkey")).alias("k"), F.lit("new").alias("v"))
    return I.fingerprint_diff(before, after.unionByName(new), "k", "v")


@query(
    "parity",
    """
WITH a AS (SELECT c_nationkey AS nation, count(*) AS n FROM customer GROUP BY 1),
b AS (SELECT s_nationkey AS nation, count(*) AS n FROM supplier GROUP BY 1)
SELECT nation, CASE WHEN b.n IS NULL THEN 'only in first' WHEN a.n IS NULL THEN 'only in second' ELSE 'different' END AS status
FROM a FULL JOIN b USING (nation) WHERE a.n IS DISTINCT FROM b.n""",
)
def parity(t):
    a = t.customer.groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("n"))
    b = t.supplier.groupBy(F.col("s_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("n"))
    return I.parity(a, b, ["nation"])


@query(
    "cidr_rules",
    """
WITH a AS (SELECT c_custkey, c_custkey % 300 AS octet, c_custkey % 37 AS prefix FROM customer)
SELECT c_custkey, rule FROM a, (VALUES ('address block'), ('all allowed blocks')) r(rule)
WHERE (rule = 'address block' AND (octet > 255 OR prefix > 32)) OR (rule = 'all allowed blocks' AND prefix > 32)""",
)
def cidr_rules(t):
    """Blocks with octets and prefixes that run beyond their range, alone and in a list."""
    block = F.concat(F.lit("10.0."), F.col("c_custkey") % 300, F.lit(".0/"), F.col("c_custkey") % 37)
    allowed = F.array(F.lit("192.0.2.0/24"), F.concat(F.lit("10.0.0.0/"), F.col("c_custkey") % 37))
    return I.check_values(t.customer, "c_custkey", {"address block": is_cidr(block), "all allowed blocks": all_cidr(allowed)})


@query(
    "value_rules",
    """
SELECT c_custkey, rule FROM customer, (VALUES ('balance in range'), ('known segment'), ('name has even number'), ('nation in range')) r(rule)
WHERE (rule = 'balance in range' AND NOT (c_acctbal BETWEEN 0 AND 9000))
   OR (rule = 'known segment' AND c_mktsegment NOT IN ('MACHINERY', 'BUILDING', 'AUTOMOBILE'))
   OR (rule = 'name has even number' AND NOT regexp_full_match(c_name, 'Customer#[0-9]*[02468]'))
   OR (rule = 'nation in range' AND NOT (c_nationkey BETWEEN 1 AND 20))""",
)
def value_rules(t):
    rules = {
        "balance in range": F.col("c_acctbal").between(0, 9000),
        "known segment": F.col("c_mktsegment").isin("MACHINERY", "BUILDING", "AUTOMOBILE"),
        "name has even number": F.col("c_name").rlike(r"^Customer#[0-9]*[02468]\z"),
        "nation in range": F.col("c_nationkey").between(1, 20),
    }
    return I.check_values(t.customer, "c_custkey", rules)


@query(
    "capacity_check",
    """
WITH s AS (SELECT l_orderkey, CAST(sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS BIGINT) AS a,
                  CAST(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS BIGINT) AS r,
                  CAST(sum(l_quantity) AS BIGINT) AS total FROM lineitem GROUP BY 1)
SELECT * FROM (SELECT l_orderkey, CASE WHEN a <= 0 OR r <= 0 OR total <= 0 THEN 'values must be positive'
            WHEN (a + r) * 100 > total * 80 THEN 'no reserve left' END AS error FROM s) WHERE error IS NOT NULL""",
)
def capacity_check(t):
    """Returned and accepted quantity of an order must leave a reserve of 20 percent."""
    part = lambda flag: F.sum(F.when(F.col("l_returnflag") == flag, F.col("l_quantity")).otherwise(0)).cast("bigint")
    sizes = t.lineitem.groupBy("l_orderkey").agg(part("A").alias("a"), part("R").alias("r"), F.sum("l_quantity").cast("bigint").alias("total"))
    checked = sizes.select("l_orderkey", I.check_capacity(sizes, ["a", "r"], "total", F.lit(20)).alias("error"))
    return checked.where(F.col("error").isNotNull())


@query(
    "last_write",
    """
SELECT user_id, event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY ALL""",
)
def last_write(t):
    rows = t.events.select("user_id", "event_type", "value", "event_id")
    return W.merge_last(rows, ["user_id", "event_type"], [F.col("event_id")])


@query("ordered_distinct", "SELECT user_id, min(event_id) AS first_seen FROM events GROUP BY user_id")
def ordered_distinct(t):
    return W.distinct_ordered(t.events, "user_id", "event_id")


@query("distinct_sets", "SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_suppkey IS NOT NULL")
def distinct_sets(t):
    return W.distinct_members(t.lineitem, ["l_orderkey"], "l_suppkey")


@query(
    "distinct_set_text",
    """
SELECT user_id, string_agg(event_type, ',' ORDER BY event_type) AS kinds
FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY user_id""",
)
def distinct_set_text(t):
    kinds = W.sorted_set(F.col("event_type"), ["view", "click", "error", "purchase", "signup"])
    return t.events.groupBy("user_id").agg(F.array_join(kinds, ",").alias("kinds"))
