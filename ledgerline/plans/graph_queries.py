"""Queries over dependency and conflict edges, all derived from whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators import graph as G
from ledgerline.plans.registry import query

NEXT_PART = "(p_partkey + p_size * 40)"


def part_edges(t):
    """Each part needs the part 40 sizes further on."""
    return t.part.select(F.col("p_partkey").alias("src"), (F.col("p_partkey") + F.col("p_size") * 40).cast("bigint").alias("dst"))


@query(
    "missing_refs",
    f"""SELECT p_partkey AS src, {NEXT_PART} AS dst FROM part WHERE {NEXT_PART} NOT IN (SELECT p_partkey FROM part WHERE p_type <> 'SMALL')""",
)
def missing_refs(t):
    return G.missing_refs(part_edges(t), t.part.where("p_type <> 'SMALL'").select(F.col("p_partkey").alias("node")))


LINKS = """
links AS (SELECT DISTINCT l_suppkey AS src, CAST(l_partkey % 120 AS BIGINT) AS dst FROM lineitem)"""


def links(t):
    """Every line's supplier names the number that its part has within a hundred and twenty."""
    return t.lineitem.select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 120).cast("bigint").alias("dst"))


@query("conflict_pairs", f"WITH {LINKS}, s AS (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) SELECT src, dst FROM links WHERE src IN (SELECT * FROM s) AND dst IN (SELECT * FROM s)")
def conflict_pairs(t):
    selected = t.supplier.where("s_acctbal > 0").select(F.col("s_suppkey").alias("node"))
    return G.conflict_pairs(links(t), selected)


@query("non_reciprocal", f"WITH {LINKS} SELECT src, dst FROM links WHERE (dst, src) NOT IN (SELECT src, dst FROM links)")
def non_reciprocal(t):
    return G.non_reciprocal(links(t))


@query("self_edges", f"WITH {LINKS} SELECT DISTINCT src FROM links WHERE src = dst")
def self_edges(t):
    return G.self_edges(links(t))


@query(
    "cycles",
    """
WITH RECURSIVE edges AS (SELECT DISTINCT a.role AS src, b.role AS dst FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
reach(src, dst) AS (SELECT src, dst FROM edges UNION SELECT r.src, e.dst FROM reach r JOIN edges e ON r.dst = e.src)
SELECT DISTINCT src AS node FROM reach WHERE src = dst""",
)
def cycles(t):
    """Roles that follow each other in a circle; a system turn only ever comes first."""
    now = t.conversations.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("role").alias("src"))
    after = t.conversations.select("conv_id", "turn", F.col("role").alias("dst"))
    return G.find_cycles(now.join(after, ["conv_id", "turn"]).select("src", "dst")).select("node")


@query(
    "cycles_users",
    """
WITH RECURSIVE edges AS (SELECT DISTINCT a.user_id AS src, b.user_id AS dst FROM events a JOIN events b ON b.event_id = a.event_id + 1
  WHERE a.event_type = 'error' AND b.event_type = 'purchase'),
reach(src, dst) AS (SELECT src, dst FROM edges UNION SELECT r.src, e.dst FROM reach r JOIN edges e ON r.dst = e.src),
mutual AS (SELECT a.src AS node, a.dst AS other FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src)
SELECT node, max(other) AS component FROM mutual GROUP BY node""",
)
def cycles_users(t):
    """Users whose errors are followed by purchases of others, in a circle."""
    bad = t.events.where("event_type = 'error'").select((F.col("event_id") + 1).alias("event_id"), F.col("user_id").alias("src"))
    good = t.events.where("event_type = 'purchase'").select("event_id", F.col("user_id").alias("dst"))
    return G.find_cycles(bad.join(good, "event_id").select("src", "dst"))


@query(
    "cycles_chain",
    """
SELECT p_partkey AS node, p_partkey // 97 * 97 + 96 AS component FROM part WHERE p_partkey // 97 * 97 + 96 IN (SELECT p_partkey FROM part)""",
)
def cycles_chain(t):
    """Long chains: every part needs the next one, and each ninety-seventh the one that many before; the last chain stays open."""
    key = F.col("p_partkey")
    needs = F.when(key % 97 == 96, key - 96).otherwise(key + 1)
    return G.find_cycles(t.part.select(key.alias("src"), needs.alias("dst")))


def service_graph(t):
    """Suppliers as services: each needs the one with an eighth of its key; pairs share a resource."""
    key = F.col("s_suppkey")
    nodes = t.supplier.select(key.alias("node"), F.floor(key / 2).alias("resource"), key.alias("ord"))
    edges = t.supplier.where("s_suppkey > 0").select(key.alias("src"), F.floor(key / 8).alias("dst"))
    return nodes, edges


@query(
    "waves",
    """
WITH RECURSIVE done(node, wave) AS (
  SELECT CAST(0 AS BIGINT), 1
  UNION ALL
  SELECT s.s_suppkey, CASE WHEN s.s_suppkey % 2 = 0 THEN d.wave + 1 WHEN s.s_suppkey = 1 THEN d.wave + 1 ELSE d.wave + 2 END
  FROM done d JOIN supplier s ON s.s_suppkey // 8 = d.node AND s.s_suppkey > 0)
SELECT node, wave FROM done""",
)
def waves(t):
    nodes, edges = service_graph(t)
    return G.waves(nodes, edges)[0]


@query(
    "waves_parts",
    "SELECT p_partkey AS node, CAST(CASE WHEN p_partkey % 10 >= 5 THEN 10 - p_partkey % 10 ELSE 6 + p_partkey % 10 END AS INTEGER) AS wave FROM part",
)
def waves_parts(t):
    """Parts by tens: the first five of ten need each other in a row, all ten share a resource, and the last comes first."""
    key = F.col("p_partkey")
    nodes = t.part.select(key.alias("node"), F.floor(key / 10).alias("resource"), (-key).alias("ord"))
    edges = t.part.where(key % 10 < 5).where(key % 10 > 0).select(key.alias("src"), (key - 1).alias("dst"))
    return G.waves(nodes, edges)[0]


@query(
    "waves_unresolved",
    """
WITH RECURSIVE edges AS (SELECT DISTINCT a.role AS src, b.role AS dst FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
SELECT DISTINCT role AS node FROM conversations WHERE role IN (SELECT src FROM edges)""",
)
def waves_unresolved(t):
    """Roles wait for the roles that follow them, which never resolves."""
    now = t.conversations.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("role").alias("src"))
    after = t.conversations.select("conv_id", "turn", F.col("role").alias("dst"))
    edges = now.join(after, ["conv_id", "turn"]).select("src", "dst").distinct()
    nodes = t.conversations.groupBy(F.col("role").alias("node")).agg(F.min("conv_id").alias("ord")).withColumn("resource", F.col("node"))
    return G.waves(nodes, edges)[1]
