"""Queries over key/value tables, fields, sets, names and addresses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions import normalize as N
from ledgerline.functions import paths as P
from ledgerline.operators import keyvalues as K
from ledgerline.operators import network as NW
from ledgerline.plans.registry import query
from ledgerline.sources.files import explode_list_map, explode_map


def settings(t):
    """Six settings per customer as (c_custkey, place, key, value); null values are absent."""
    c = F.col
    nation = c("c_nationkey").cast("string")
    values = {
        "name": F.when(c("c_nationkey") < 20, c("c_name")),
        "old_name": F.when(c("c_mktsegment") == "BUILDING", F.concat("c_name", F.lit("x"))).otherwise(c("c_name")),
        "segment": c("c_mktsegment"),
        "nation": nation,
        "address": F.when(c("c_acctbal") < 2000, F.lit("dhcp")).otherwise(F.concat(F.lit("192.0.2."), nation, F.lit("/24"))),
        "lan_ip": F.when(c("c_acctbal") < 1000, F.concat(F.lit("198.51.100."), nation)).otherwise(F.lit("")),
    }
    rows = F.array(*[F.struct(F.lit(key).alias("key"), value.alias("value")) for key, value in values.items()])
    return t.customer.select("c_custkey", F.posexplode(rows).alias("place", "r")).select("c_custkey", "place", "r.key", "r.value").where("value IS NOT NULL")


KV = """
kv AS (SELECT * FROM (SELECT c_custkey, unnest([0, 1, 2, 3, 4, 5]) AS place,
  unnest(['name', 'old_name', 'segment', 'nation', 'address', 'lan_ip']) AS key,
  unnest([CASE WHEN c_nationkey < 20 THEN c_name END, CASE WHEN c_mktsegment = 'BUILDING' THEN c_name || 'x' ELSE c_name END, c_mktsegment,
          CAST(c_nationkey AS VARCHAR), CASE WHEN c_acctbal < 2000 THEN 'dhcp' ELSE '192.0.2.' || c_nationkey || '/24' END,
          CASE WHEN c_acctbal < 1000 THEN '198.51.100.' || c_nationkey ELSE '' END]) AS value FROM customer) WHERE value IS NOT NULL)"""


@query(
    "rename_keys",
    f"""WITH {KV}, r AS (SELECT c_custkey, CASE key WHEN 'old_name' THEN 'name' ELSE key END AS key, value FROM kv)
SELECT c_custkey, key, min(value) AS value FROM r GROUP BY ALL HAVING min(value) = max(value)""",
)
def rename_keys(t):
    return K.rename_key_strict(settings(t), {"old_name": "name"}, ["c_custkey"])[0]


@query(
    "rename_conflicts",
    f"""WITH {KV}, r AS (SELECT c_custkey, CASE key WHEN 'old_name' THEN 'name' ELSE key END AS key, value FROM kv)
SELECT c_custkey, key FROM r GROUP BY ALL HAVING min(value) <> max(value)""",
)
def rename_conflicts(t):
    return K.rename_key_strict(settings(t), {"old_name": "name"}, ["c_custkey"])[1]


@query(
    "rename_prefer_new",
    f"""WITH {KV} SELECT c_custkey, k AS key, value, place FROM (
  SELECT *, CASE key WHEN 'old_name' THEN 'name' ELSE key END AS k,
    row_number() OVER (PARTITION BY c_custkey, CASE key WHEN 'old_name' THEN 'name' ELSE key END ORDER BY key = 'old_name', place) AS rn FROM kv) WHERE rn = 1""",
)
def rename_prefer_new(t):
    return K.rename_key_prefer_new(settings(t), {"old_name": "name"}, ["c_custkey"], "place")


@query(
    "fill_defaults",
    f"""WITH {KV} SELECT c_custkey, key, value FROM kv
UNION ALL SELECT c_custkey, 'port', '8080' FROM customer
UNION ALL SELECT c_custkey, 'name', 'nobody' FROM customer WHERE c_nationkey >= 20""",
)
def fill_defaults(t):
    return K.fill_defaults(settings(t), {"port": "8080", "name": "nobody"}, ["c_custkey"])


@query(
    "overlay",
    f"""WITH {KV}, d AS (SELECT c_custkey, 'segment' AS key, 'BUILDING' AS value FROM customer WHERE c_acctbal > 5000
   UNION ALL SELECT c_custkey, 'nation', '' FROM customer UNION ALL SELECT c_custkey, 'owner', c_name FROM customer WHERE c_nationkey = 3),
dd AS (SELECT * FROM d WHERE value <> '')
SELECT c_custkey, key, CASE WHEN dd.value IS NULL AND key IN ('old_name', 'lan_ip') THEN NULL ELSE coalesce(dd.value, kv.value) END AS value,
  CASE WHEN dd.value IS NULL AND key IN ('old_name', 'lan_ip') THEN 'removed' WHEN dd.value IS NULL OR dd.value = kv.value THEN 'kept'
       WHEN kv.value IS NULL THEN 'added' ELSE 'changed' END AS change FROM kv FULL JOIN dd USING (c_custkey, key)""",
)
def overlay(t):
    c = t.customer
    desired = (
        c.where("c_acctbal > 5000").select("c_custkey", F.lit("segment").alias("key"), F.lit("BUILDING").alias("value"))
        .unionByName(c.select("c_custkey", F.lit("nation").alias("key"), F.lit("").alias("value")))
        .unionByName(c.where("c_nationkey = 3").select("c_custkey", F.lit("owner").alias("key"), F.col("c_name").alias("value")))
    )
    return K.overlay(settings(t), ["old_name", "lan_ip"], desired, ["c_custkey"])


COPY = """
src AS (SELECT c_custkey, key, value FROM kv),
wanted AS (SELECT c_custkey, target, source FROM customer, (VALUES ('display', 'name'), ('zone', 'segment'), ('nation', 'nation')) m(target, source))"""


@query(
    "copy_keys",
    f"""WITH {KV}, {COPY}, old AS (SELECT c_custkey, 'display' AS key, c_name AS value FROM customer WHERE c_acctbal > 0
   UNION ALL SELECT c_custkey, 'zone', 'BUILDING' FROM customer)
SELECT w.c_custkey, w.target AS key, s.value, s.value IS DISTINCT FROM o.value AS changed
FROM wanted w JOIN src s ON s.c_custkey = w.c_custkey AND s.key = w.source LEFT JOIN old o ON o.c_custkey = w.c_custkey AND o.key = w.target""",
)
def copy_keys(t):
    old = t.customer.where("c_acctbal > 0").select("c_custkey", F.lit("display").alias("key"), F.col("c_name").alias("value")).unionByName(
        t.customer.select("c_custkey", F.lit("zone").alias("key"), F.lit("BUILDING").alias("value"))
    )
    return K.copy_keys(settings(t), old, {"display": "name", "zone": "segment", "nation": "nation"}, ["c_custkey"])[0]


@query("copy_missing", f"""WITH {KV} SELECT c_custkey, 'name' AS key FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM kv WHERE key = 'name')""")
def copy_missing(t):
    return K.copy_keys(settings(t), settings(t), {"display": "name", "zone": "segment"}, ["c_custkey"])[1]


@query(
    "project_fields",
    """
SELECT c_custkey, CASE WHEN c_nationkey < 20 THEN c_name END AS name, c_mktsegment AS segment, '100000' AS uid,
  CAST(c_nationkey AS VARCHAR) AS nation, CASE WHEN c_nationkey < 20 THEN '' ELSE 'name' END AS missing FROM customer""",
)
def project_fields(t):
    return K.project_fields(settings(t), ["c_custkey"], ["segment", "name"], {"uid": "100000", "nation": "0"})


@query(
    "fill_from",
    """
SELECT c_custkey, CASE WHEN c_acctbal < 1000 THEN '198.51.100.' || c_nationkey || '/24' WHEN c_acctbal < 2000 THEN 'dhcp' ELSE '192.0.2.' || c_nationkey || '/24' END AS address FROM customer""",
)
def fill_from(t):
    wide = K.project_fields(settings(t), ["c_custkey"], ["address", "lan_ip"], {})
    filled = K.fill_from(wide, [("address", "dhcp", "lan_ip")], lambda value: F.concat(value, F.lit("/24")))
    return filled.select("c_custkey", "address")


@query(
    "compare_and_set",
    f"""WITH {KV}, ready AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal < 2000)
SELECT c_custkey, key, CASE WHEN key = 'segment' AND r THEN 'TOWER' WHEN key = 'address' AND r THEN '203.0.113.1' ELSE value END AS value,
  key IN ('segment', 'address') AND r AS changed FROM (SELECT *, c_custkey IN (SELECT c_custkey FROM ready) AS r FROM kv)""",
)
def compare_and_set(t):
    old = {"segment": "BUILDING", "address": "dhcp"}
    return K.compare_and_set(settings(t), ["c_custkey"], old, {"segment": "TOWER", "address": "203.0.113.1"})


@query(
    "resolve_vars",
    """
WITH kv AS (SELECT 's' || s_suppkey AS key, s_name AS value FROM supplier WHERE s_acctbal > 0),
r AS (SELECT c_custkey, 'host' AS variable, 's' || c_nationkey AS key FROM customer UNION ALL SELECT c_custkey, 'user', 's' || c_custkey FROM customer)
SELECT c_custkey, variable, value FROM r JOIN kv USING (key)""",
)
def resolve_vars(t):
    registry = t.customer.select(
        "c_custkey", F.create_map(F.lit("host"), F.concat(F.lit("s"), "c_nationkey"), F.lit("user"), F.concat(F.lit("s"), "c_custkey")).alias("variables")
    )
    kv = t.supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("key"), F.when(F.col("s_acctbal") > 0, F.col("s_name")).alias("value"))
    return K.resolve_vars(registry, "variables", kv, "c_custkey")


@query(
    "explode_items",
    """
SELECT conv_id * 100 + turn AS id, CAST(i - 1 AS INTEGER) AS position, w[i] AS item, CASE WHEN w[i] IN ('the', 'the.') THEN 'article' ELSE role END AS "group",
  CASE WHEN role = 'user' THEN 'checked' ELSE 'skipped' END AS status
FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM (SELECT *, string_split(text, ' ') AS w FROM conversations))""",
)
def explode_items(t):
    turns = t.conversations.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "role", F.split("text", " ", -1).alias("words"))
    return K.explode_items(turns, "id", "words", F.col("role") == "user", {"the": "article", "the.": "article"}, F.col("role"))


@query(
    "resolve_first",
    """
SELECT p_partkey, CASE WHEN p_size > 25 THEN p_brand WHEN p_type <> 'SMALL' THEN 'module.' || lower(p_type)
  WHEN starts_with(p_name, 'red ') THEN substr(p_name, 5) ELSE 'none' END AS target FROM part""",
)
def resolve_first(t):
    explicit = F.when(F.col("p_size") > 25, F.col("p_brand")).otherwise("")
    module = F.when(F.col("p_type") != "SMALL", F.concat(F.lit("module."), F.lower("p_type")))
    return t.part.select("p_partkey", N.resolve_first(explicit, [module, N.strip_prefix(F.col("p_name"), "red ")], F.lit("none")).alias("target"))


@query(
    "exclusive",
    """
SELECT doc_id, CASE WHEN quality = 1 AND toxic = 1 THEN NULL WHEN quality = 1 THEN 'q' || doc_id WHEN toxic = 1 THEN 't' || doc_id ELSE '' END AS value,
  CASE WHEN quality = 1 AND toxic = 1 THEN 'modes are mutually exclusive' END AS error,
  nullif(quality, 0) IS NOT NULL AND nullif(toxic, 0) IS NOT NULL AS both_set FROM labels""",
)
def exclusive(t):
    q, x = F.col("quality"), F.col("toxic")
    choice = K.exclusive_choice(q == 1, x == 1, F.concat(F.lit("q"), "doc_id"), F.concat(F.lit("t"), "doc_id"))
    rows = t.labels.select("doc_id", choice.alias("c"), K.both_set(F.nullif(q, F.lit(0)), F.nullif(x, F.lit(0))).alias("both_set"))
    return rows.select("doc_id", "c.value", "c.error", "both_set")


@query(
    "classify_slot",
    """
SELECT c_nationkey, c_mktsegment, CASE WHEN count(*) FILTER (WHERE c_acctbal > 9000 AND NOT c_acctbal > 9500) > 0 THEN 'conflict'
  WHEN count(*) FILTER (WHERE c_acctbal > 9500) = 1 THEN 'present' ELSE 'absent' END AS state FROM customer GROUP BY ALL""",
)
def classify_slot(t):
    balance = F.col("c_acctbal")
    return K.classify_slot(t.customer, ["c_nationkey", "c_mktsegment"], balance > 9500, balance > 9000)


@query("set_difference", "SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def set_difference(t):
    pick = lambda status: t.orders.where(F.col("o_orderstatus") == status).select("o_custkey")
    return K.unknown(pick("F"), pick("O"))


@query("set_intersection", "SELECT c_nationkey, c_acctbal > 0 AS solvent FROM customer INTERSECT SELECT s_nationkey, s_acctbal > 0 FROM supplier")
def set_intersection(t):
    a = t.customer.select("c_nationkey", (F.col("c_acctbal") > 0).alias("solvent"))
    return K.overlap(a, t.supplier.select(F.col("s_nationkey").alias("c_nationkey"), (F.col("s_acctbal") > 0).alias("solvent")))


ADDRESS_RUNS = """regexp_extract_all(text, '[0-9.]+')"""


@query(
    "set_union",
    f"""
SELECT DISTINCT ip AS address FROM (SELECT unnest({ADDRESS_RUNS}) AS ip FROM documents
  UNION ALL SELECT unnest(regexp_extract_all(html, '[0-9.]+')) FROM pages UNION ALL SELECT unnest({ADDRESS_RUNS}) FROM conversations)
WHERE regexp_full_match(ip, '((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\\.){{3}}(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])')""",
)
def set_union(t):
    """Distinct addresses found anywhere in three text sources."""
    from ledgerline.functions.text import IPV4_CANDIDATE

    def found(df, column):
        hits = df.select(F.explode(F.regexp_extract_all(column, F.lit(IPV4_CANDIDATE), F.lit(0))).alias("address"))
        return hits.where(N.is_ipv4(F.col("address")))

    return K.union_values([found(t.documents, "text"), found(t.pages, "html"), found(t.conversations, "text")], "address")


HOST = "regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)"
ZONES = f"""
zones AS (SELECT DISTINCT regexp_extract(h, '([^.]+[.][^.]+)$', 1) AS zone FROM (SELECT {HOST} AS h FROM pages) WHERE NOT ends_with(h, '.org')
  UNION SELECT regexp_extract({HOST}, '([^.]+[.][^.]+[.][^.]+)$', 1) FROM pages WHERE contains(url, '/en/') AND starts_with(url, 'https'))"""


def page_zones(t):
    host = F.parse_url("url", F.lit("HOST"))
    hosts = t.pages.select(host.alias("name"), "url")
    short = hosts.where(~F.col("name").endswith(".org")).select(F.substring_index("name", ".", -2).alias("zone"))
    long = hosts.where(F.col("url").contains("/en/") & F.col("url").startswith("https")).select(F.substring_index("name", ".", -3).alias("zone"))
    return hosts.select("name"), short.unionByName(long)


@query(
    "longest_suffix",
    f"""WITH {ZONES}, names AS (SELECT DISTINCT {HOST} AS name FROM pages)
SELECT name, arg_max(zone, len(zone)) AS zone FROM names LEFT JOIN zones ON name = zone OR ends_with(name, '.' || zone) GROUP BY name""",
)
def longest_suffix(t):
    names, zones = page_zones(t)
    return NW.longest_suffix(names, zones)


@query(
    "reconcile",
    """
WITH a AS (SELECT DISTINCT c_nationkey AS zone, rtrim(lower(c_name), '.') AS domain, rtrim('host' || (c_custkey % 17) || '.net', '.') AS value FROM customer WHERE c_acctbal > 0)
SELECT d.zone, d.domain, d.value, CASE WHEN a.value IS NULL THEN 'upsert' ELSE 'unchanged' END AS action
FROM (SELECT c_nationkey AS zone, lower(c_name) || '.' AS domain, 'host' || (CASE WHEN c_mktsegment = 'BUILDING' THEN 3 ELSE c_custkey % 17 END) || '.net.' AS value FROM customer) d
LEFT JOIN a ON a.zone = d.zone AND a.domain = rtrim(d.domain, '.') AND a.value = rtrim(d.value, '.')""",
)
def reconcile(t):
    target = lambda number, end: F.concat(F.lit("host"), number, F.lit(end))
    number = F.col("c_custkey") % 17
    wanted = F.when(F.col("c_mktsegment") == "BUILDING", 3).otherwise(number)
    desired = t.customer.select(F.col("c_nationkey").alias("zone"), F.concat(F.lower("c_name"), F.lit(".")).alias("domain"), target(wanted, ".net.").alias("value"))
    actual = t.customer.where("c_acctbal > 0").select(F.col("c_nationkey").alias("zone"), F.lower("c_name").alias("domain"), target(number, ".net").alias("value"))
    return NW.reconcile(desired, actual, ["zone", "domain"], "value")


PAGE_PATH = "regexp_replace(regexp_extract(url, '^[a-z]+://([^?#]+)', 1), '/+$', '')"
ROOTS = f"""
m AS (SELECT DISTINCT {PAGE_PATH} AS path FROM pages),
roots AS (SELECT regexp_extract(path, '^([^/]+/[^/]+)', 1) AS root FROM m WHERE contains(path, '.net/')
          UNION SELECT regexp_extract(path, '^([^/]+)', 1) FROM m WHERE contains(path, '/en/') AND contains(path, '.com/'))"""


def page_roots(t):
    path = F.regexp_replace(F.regexp_extract("url", "^[a-z]+://([^?#]+)", 1), "/+$", "")
    members = t.pages.select(path.alias("path")).distinct()
    net = members.where(F.col("path").contains(".net/")).select(F.regexp_extract("path", "^([^/]+/[^/]+)", 1).alias("root"))
    com = members.where(F.col("path").contains("/en/") & F.col("path").contains(".com/")).select(F.regexp_extract("path", "^([^/]+)", 1).alias("root"))
    return members, net.unionByName(com)


@query(
    "containment",
    f"""WITH {ROOTS} SELECT path, count(root) AS roots, min(root) AS root FROM m LEFT JOIN roots ON path = root OR starts_with(path, root || '/') GROUP BY path""",
)
def containment(t):
    members, roots = page_roots(t)
    return NW.check_containment(members, roots)


@query(
    "overlapping_roots",
    f"""WITH m AS (SELECT DISTINCT {PAGE_PATH} AS path FROM pages),
r AS (SELECT regexp_extract(path, '^([^/]+/[^/]+)', 1) AS root FROM m UNION ALL SELECT regexp_extract(path, '^([^/]+)', 1) FROM m WHERE contains(path, '/de/'))
SELECT root, 'duplicate' AS problem FROM r GROUP BY root HAVING count(*) > 1
UNION ALL SELECT DISTINCT a.root, 'inside another root' FROM r a JOIN r b ON starts_with(a.root, b.root || '/')""",
)
def overlapping_roots(t):
    members, _ = page_roots(t)
    near = members.select(F.regexp_extract("path", "^([^/]+/[^/]+)", 1).alias("root"))
    host = members.where(F.col("path").contains("/de/")).select(F.regexp_extract("path", "^([^/]+)", 1).alias("root"))
    return NW.overlapping_roots(near.unionByName(host))


@query(
    "alias_keys",
    """
WITH k AS (SELECT c_name AS host, '192.0.2.' || c_nationkey AS address, CASE WHEN c_mktsegment = 'BUILDING' THEN 'ssh-dss ' ELSE 'ssh-ed25519 ' END || c_mktsegment AS key FROM customer)
SELECT host AS alias, key FROM k WHERE starts_with(key, 'ssh-ed') UNION SELECT address, key FROM k WHERE starts_with(key, 'ssh-ed')""",
)
def alias_keys(t):
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "ssh-dss ").otherwise("ssh-ed25519 ")
    keys = t.customer.select(F.col("c_name").alias("host"), F.concat(F.lit("192.0.2."), "c_nationkey").alias("address"), F.concat(kind, "c_mktsegment").alias("key"))
    return NW.alias_keys(keys, "host", "key", ["host", "address"])[0]


@query(
    "first_gap",
    "SELECT min(k) AS first_free FROM (SELECT unnest(range(1, (SELECT max(l_orderkey) FROM lineitem))) AS k) WHERE k NOT IN (SELECT l_orderkey FROM lineitem)",
)
def first_gap(t):
    return NW.first_gap(t.lineitem, "l_orderkey", 0, t.lineitem.agg(F.max("l_orderkey")).scalar())


@query(
    "agreement",
    """
SELECT s_nationkey AS side, count(*) AS members, bool_or(s_acctbal > 8000) AS connected, min(n_regionkey) = 2 AND max(n_regionkey) = 2 AS same_domain,
  bool_or(s_acctbal > 8000) AND min(n_regionkey) = 2 AND count(*) = 4 AS agrees
FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY s_nationkey""",
)
def agreement(t):
    members = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_nationkey").alias("side"), F.col("n_regionkey").cast("string").alias("domain"), "s_acctbal"
    )
    return NW.check_agreement(members, "side", "domain", F.col("s_acctbal") > 8000, "2", 4)


@query(
    "normalize_refs",
    """
SELECT c_custkey, CASE c_nationkey % 5 WHEN 0 THEN 'k' || c_custkey WHEN 1 THEN 'k' || c_custkey WHEN 2 THEN 'k' || c_custkey END AS id,
  CASE c_nationkey % 5 WHEN 3 THEN 'invalid customer record reference' WHEN 4 THEN 'invalid customer record reference' END AS error FROM customer""",
)
def normalize_refs(t):
    key = F.concat(F.lit("k"), "c_custkey")
    kind = F.col("c_nationkey") % 5
    text = (
        F.when(kind == 0, F.concat(F.lit("customer:"), key)).when(kind == 1, F.concat(F.lit("customer:`"), key, F.lit("`")))
        .when(kind == 2, key).when(kind == 3, F.concat(F.lit("supplier:"), key)).otherwise(F.lit("customer:"))
    )
    return t.customer.select("c_custkey", N.normalize_ref(text, "customer").alias("r")).select("c_custkey", "r.*")


@query(
    "normalize_variant_refs",
    """
SELECT c_custkey, CASE WHEN c_nationkey % 4 <> 3 THEN 'k' || c_custkey END AS id,
  CASE WHEN c_nationkey % 4 = 3 THEN 'expected customer record reference' END AS error FROM customer""",
)
def normalize_variant_refs(t):
    key = F.concat(F.lit("k"), "c_custkey")
    kind = F.col("c_nationkey") % 4
    text = (
        F.when(kind == 0, F.concat(F.lit('"customer:'), key, F.lit('"')))
        .when(kind == 1, F.concat(F.lit('{"tb": "customer", "id": "'), key, F.lit('"}')))
        .when(kind == 2, F.concat(F.lit('{"table": "customer", "id": {"String": "'), key, F.lit('"}}')))
        .otherwise(F.concat(F.lit('{"tb": "supplier", "id": "'), key, F.lit('"}')))
    )
    return t.customer.select("c_custkey", N.normalize_ref_variant(F.parse_json(text), "customer").alias("r")).select("c_custkey", "r.*")


@query(
    "normalize_times",
    """
SELECT event_id, CASE event_type WHEN 'error' THEN NULL ELSE strftime(date_trunc('second', ts) - CASE event_type WHEN 'view' THEN INTERVAL 1 HOUR WHEN 'click' THEN -INTERVAL 330 MINUTE ELSE INTERVAL 0 HOUR END,
  '%Y-%m-%dT%H:%M:%SZ') END AS utc FROM events""",
)
def normalize_times(t):
    kind = F.col("event_type")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    text = (
        F.when(kind == "view", F.concat(stamp, F.lit("+01:00"))).when(kind == "click", F.concat(stamp, F.lit("-05:30")))
        .when(kind == "signup", F.concat(stamp, F.lit("Z"))).when(kind == "error", F.concat(F.lit("on "), stamp)).otherwise(stamp)
    )
    wrapped = F.to_json(F.struct(text.alias("Datetime")))
    return t.events.select("event_id", N.utc_text(N.to_utc_variant(F.parse_json(wrapped))).alias("utc"))


@query(
    "normalize_json",
    r"""
SELECT event_id, '{"items":[{"raw":"' || replace(props, '"', '\"') || '","ref":"' || event_id || '"}],"owner":"' || user_id || '"}' AS value,
  CAST(NULL AS VARCHAR) AS error FROM events""",
)
def normalize_json(t):
    """P4 on nested documents that hold references; Python sees only the schemaless column."""
    nested = F.to_json(F.struct(
        F.struct(F.lit("customer").alias("tb"), F.col("user_id").cast("string").alias("id")).alias("owner"),
        F.array(F.struct(F.struct(F.lit("e").alias("table"), F.col("event_id").alias("id")).alias("ref"), F.col("props").alias("raw"))).alias("items"),
    ))
    return t.events.select("event_id", N.normalize_json(nested).alias("j")).select("event_id", "j.*")


@query(
    "normalize_numbers",
    """
SELECT o_orderkey, CASE o_orderkey % 4
    WHEN 0 THEN '{"a":' || o_orderkey || '.0,"long":' || repeat('1234567890', 5) || o_orderkey || '}'
    WHEN 1 THEN '{"deep":[{"x":' || CAST(o_totalprice * 1e12::DOUBLE AS VARCHAR) || '}]}'
    WHEN 2 THEN '{"x":' || CAST(o_totalprice / 1e9::DOUBLE AS VARCHAR) || ',"y":' || CAST(o_totalprice AS VARCHAR) || '}' END AS value,
  CASE o_orderkey % 4 WHEN 3 THEN 'non-finite numeric value' END AS error FROM orders""",
)
def normalize_numbers(t):
    """P4 on whole numbers of over 50 digits, doubles of any size in other notations, and numbers beyond a double."""
    key, price = F.col("o_orderkey").cast("string"), F.col("o_totalprice")
    long = F.concat(F.lit('{"long": '), F.repeat(F.lit("1234567890"), 5), key, F.lit(', "a": '), key, F.lit(".0}"))
    large = F.concat(F.lit('{"deep": [{"x": '), (price * F.lit(1e12)).cast("string"), F.lit("}]}"))
    small = F.concat(F.lit('{"y": '), price.cast("string"), F.lit(', "x": '), (price / F.lit(1e9)).cast("string"), F.lit("}"))
    beyond = F.concat(F.lit('{"x": '), key, F.lit("e400}"))
    kind = F.col("o_orderkey") % 4
    text = F.when(kind == 0, long).when(kind == 1, large).when(kind == 2, small).otherwise(beyond)
    return t.orders.select("o_orderkey", N.normalize_json(text).alias("j")).select("o_orderkey", "j.*")


@query(
    "vector_literal",
    """
SELECT vec_id, '[' || array_to_string(list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1000) / 1000 AS VARCHAR)), ',') || ']' AS text FROM embeddings""",
)
def vector_literal(t):
    short = F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000).cast("double") / 1000)
    return t.embeddings.select("vec_id", N.vector_literal(short).alias("text"))


@query(
    "addresses",
    """
WITH a AS (SELECT c_custkey, c_custkey // 65536 AS x, (c_custkey // 256) % 256 AS y, c_custkey % 256 AS z, c_nationkey,
   CASE WHEN c_acctbal < 0 THEN 'dhcp' WHEN c_acctbal < 500 THEN NULL ELSE '10.' || (c_custkey // 65536) % 256 || '.' || (c_custkey // 256) % 256 || '.' || c_custkey % 256 || '/' || (16 + c_nationkey % 8) END AS cidr FROM customer)
SELECT c_custkey, coalesce(nullif(split_part(cidr, '/', 1), 'dhcp'), '') AS host,
  CASE WHEN contains(cidr, '.') THEN 167772160 + c_custkey % 16777216 END AS number,
  CASE WHEN contains(cidr, '.') THEN 16 + c_nationkey % 8 ELSE 24 END AS prefix,
  CASE WHEN contains(cidr, '.') THEN '10.' || x % 256 || '.' || y || '.77' ELSE '192.0.2.77' END AS sibling FROM a""",
)
def addresses(t):
    key = F.col("c_custkey")
    part = lambda divisor: (F.floor(key / divisor) % 256).cast("string")
    cidr = F.when(F.col("c_acctbal") < 0, F.lit("dhcp")).when(F.col("c_acctbal") < 500, F.lit(None)).otherwise(
        F.concat(F.lit("10."), part(65536), F.lit("."), part(256), F.lit("."), part(1), F.lit("/"), 16 + F.col("c_nationkey") % 8)
    )
    rows = t.customer.select("c_custkey", cidr.alias("cidr"))
    host = N.host_address(F.col("cidr"))
    return rows.select(
        "c_custkey", host.alias("host"), N.ipv4_to_long(host).alias("number"), N.prefix_length(F.col("cidr")).alias("prefix"),
        N.replace_last_octet(F.col("cidr"), 77).alias("sibling"),
    )


@query(
    "address_range",
    """
SELECT s_suppkey, '10.' || (s_suppkey // 32) % 256 || '.' || ((s_suppkey % 32) * 2048 + 253 + n) // 256 || '.' || ((s_suppkey % 32) * 2048 + 253 + n) % 256 AS address
FROM supplier, (SELECT unnest(range(0, 5)) AS n)""",
)
def address_range(t):
    low = (F.col("s_suppkey") % 32) * 2048 + 253
    start = F.concat_ws(".", F.lit("10"), (F.floor(F.col("s_suppkey") / 32) % 256), F.floor(low / 256), low % 256)
    return t.supplier.select("s_suppkey", F.explode(N.ipv4_range(start, 5)).alias("address"))


@query(
    "endpoints",
    f"""
SELECT page_id, regexp_replace(regexp_replace(CASE WHEN page_id % 3 = 2 THEN url ELSE regexp_replace(url, '^http', 'ws') END, '/+$', ''), '^ws', 'http') || '/sql' AS endpoint,
  starts_with({HOST}, 'm.') OR starts_with({HOST}, 'blog.') AS rewrite FROM pages""",
)
def endpoints(t):
    url = F.when(F.col("page_id") % 3 == 2, F.col("url")).otherwise(F.regexp_replace("url", "^http", "ws"))
    return t.pages.select("page_id", N.rewrite_endpoint(url, "/sql").alias("endpoint"), N.should_rewrite_host(F.col("url"), ("m.", "blog.")).alias("rewrite"))


@query(
    "labels_and_versions",
    """
SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN 'repo' WHEN p_size % 2 <> 0 THEN 'owner' ELSE 'global' END AS scope,
  CASE WHEN p_size > 25 THEN CAST(p_size AS VARCHAR) ELSE 'release-' || p_size END AS version,
  CASE WHEN p_type = 'SMALL' THEN p_brand ELSE p_name END AS title FROM part""",
)
def labels_and_versions(t):
    size = F.col("p_size")
    tag = F.when(size > 25, F.concat(F.lit("v"), "p_size")).otherwise(F.concat(F.lit("release-"), "p_size"))
    name = F.when(F.col("p_type") == "SMALL", "").otherwise(F.col("p_name"))
    return t.part.select(
        "p_partkey", N.scope_label(size % 3, size % 2).alias("scope"), N.normalize_version(tag).alias("version"),
        N.first_non_empty(name, F.col("p_brand")).alias("title"),
    )


@query(
    "parse_list",
    """
SELECT event_id, CASE event_type WHEN 'view' THEN 'a|' || user_id WHEN 'purchase' THEN 'plain ' || user_id END AS items,
  CASE WHEN event_type IN ('error', 'signup') THEN 'must be a JSON string list' END AS error FROM events""",
)
def parse_list(t):
    kind = F.col("event_type")
    text = (
        F.when(kind == "view", F.concat(F.lit('["a", "'), "user_id", F.lit('"]'))).when(kind == "click", F.lit(" "))
        .when(kind == "error", F.col("props")).when(kind == "signup", F.lit("[1, 2]")).otherwise(F.concat(F.lit("plain "), "user_id"))
    )
    parsed = t.events.select("event_id", N.parse_list(text).alias("l"))
    return parsed.select("event_id", F.when(F.col("l.items").isNotNull(), F.array_join("l.items", "|")).alias("items"), "l.error")


@query(
    "narrow_hex",
    """
SELECT p_partkey, CASE WHEN p_size > 20 THEN substr(sha256(p_name), 1, 32) ELSE substr(sha256(p_name), 1, p_size + 1) END AS secret FROM part""",
)
def narrow_hex(t):
    digest = F.sha2("p_name", 256)
    text = F.when(F.col("p_size") > 20, F.upper(digest)).otherwise(F.substring(digest, F.lit(1), F.col("p_size") + 1))
    return t.part.select("p_partkey", N.narrow_hex(text).alias("secret"))


@query("project_allowed", "SELECT o_orderkey, o_orderdate FROM orders")
def project_allowed(t):
    return N.project_allowed(t.orders, ["o_orderkey", "o_orderdate", "not_there"])


@query(
    "defaults",
    "SELECT doc_id, coalesce(quality, -1) AS quality, coalesce(toxic, 0) AS toxic, 'compact' AS tier FROM documents LEFT JOIN labels USING (doc_id)",
)
def defaults(t):
    joined = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return N.apply_defaults(joined, {"quality": F.lit(-1), "toxic": F.lit(0), "tier": F.lit("compact")})


@query(
    "string_arrays",
    "SELECT event_id, event_type NOT IN ('click', 'error', 'purchase') AS ok FROM events",
)
def string_arrays(t):
    kind = F.col("event_type")
    text = F.when(kind == "view", F.lit('["a", "b"]')).when(kind == "signup", F.lit("[]")).when(kind == "click", F.lit('["a", 1]')).when(
        kind == "error", F.col("props")).otherwise(F.lit('["a", null]'))
    return t.events.select("event_id", N.is_string_array(F.parse_json(text)).alias("ok"))


@query(
    "format_rules",
    f"""
SELECT page_id, regexp_full_match({HOST}, '([A-Za-z0-9]([A-Za-z0-9-]{{0,61}}[A-Za-z0-9])?\\.)*[A-Za-z0-9]([A-Za-z0-9-]{{0,61}}[A-Za-z0-9])?\\.?') AS dns_name,
  page_id % 2 = 0 AS commit_id, NOT regexp_matches(html, '[\\x00-\\x1f]') AS no_control FROM pages""",
)
def format_rules(t):
    digest = F.sha2("url", 256)
    commit = F.when(F.col("page_id") % 2 == 0, F.left(digest, F.lit(40))).otherwise(F.upper(F.left(digest, F.lit(39))))
    return t.pages.select(
        "page_id", P.has_format(F.parse_url("url", F.lit("HOST")), "dns_name").alias("dns_name"),
        P.has_format(commit, "commit").alias("commit_id"), P.has_format(F.col("html"), "no_control").alias("no_control"),
    )


PATH_TEXT = """CASE page_id % 4 WHEN 0 THEN regexp_replace(url, '^[a-z]+:/', '') WHEN 1 THEN regexp_replace(url, '^[a-z]+://', '') WHEN 2 THEN 'x/../' || page_id ELSE './/.' END"""


@query(
    "path_safety",
    f"""
SELECT page_id, CASE WHEN starts_with(p, '/') THEN 'absolute path' WHEN list_contains(string_split(p, '/'), '..') THEN 'parent reference' WHEN p = './/.' THEN 'empty path' END AS error
FROM (SELECT page_id, {PATH_TEXT} AS p FROM pages)""",
)
def path_safety(t):
    kind = F.col("page_id") % 4
    path = (
        F.when(kind == 0, F.regexp_replace("url", "^[a-z]+:/", "")).when(kind == 1, F.regexp_replace("url", "^[a-z]+://", ""))
        .when(kind == 2, F.concat(F.lit("x/../"), "page_id")).otherwise(F.lit(".//."))
    )
    return t.pages.select("page_id", P.path_error(path).alias("error"))


@query(
    "resolve_link",
    """
SELECT page_id, CASE WHEN page_id % 4 < 2 THEN 'site/' || page_id || '/x' WHEN page_id % 4 = 2 THEN 'top/y' END AS path,
  CASE WHEN page_id % 4 = 3 THEN 'link target escapes root' END AS error FROM pages""",
)
def resolve_link(t):
    kind = F.col("page_id") % 4
    member = F.concat(F.lit("site/"), "page_id", F.lit("/file"))
    link = F.when(kind == 0, "./x").when(kind == 1, F.concat(F.lit("../a/../"), "page_id", F.lit("/x")))
    link = link.when(kind == 2, "top//./y").otherwise("../../../etc")
    return t.pages.select("page_id", P.resolve_link(member, link, kind == 2).alias("l")).select("page_id", "l.*")


@query("config_map", "SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS value FROM events")
def config_map(t):
    return explode_map(t.events, "props", "string", ["event_id"])


@query(
    "config_lists",
    """
SELECT c_custkey, key, CAST(position AS INTEGER) AS position, value FROM (
  SELECT c_custkey, 'segments' AS key, unnest([0, 1]) AS position, unnest([c_mktsegment, 'ANY']) AS value FROM customer
  UNION ALL SELECT c_custkey, 'names', 0, c_name FROM customer)""",
)
def config_lists(t):
    document = F.to_json(F.struct(F.array(F.col("c_mktsegment"), F.lit("ANY")).alias("segments"), F.array("c_name").alias("names")))
    return explode_list_map(t.customer.select("c_custkey", document.alias("d")), "d", ["c_custkey"])
