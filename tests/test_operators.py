"""Integrity, selection, key/value, naming and graph operators on small fixtures."""

import base64
import json
import random

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import changes as C
from ledgerline.operators import graph as G
from ledgerline.operators import integrity as I
from ledgerline.operators import keyvalues as K
from ledgerline.operators import network as NW
from ledgerline.operators import ranking as R
from ledgerline.operators import releases as L
from ledgerline.operators import winners as W
from ledgerline.session import durable
from ledgerline.skew import attach, hot_keys
from ledgerline.violations import ValidationError, assert_empty


# ---- skew -------------------------------------------------------------------

@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_attach_equals_plain_join_with_hot_and_null_keys(spark, rows, how):
    rng = random.Random(1)
    keys = [0] * 400 + [None] * 200 + [rng.randint(1, 300) for _ in range(600)]
    facts = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "id int, k int").repartition(7)
    lookup = spark.createDataFrame([(k, f"v{k}") for k in range(0, 300, 2)], "k int, v string")
    assert rows(hot_keys(facts, ["k"], 100).where("k = 0")) == [(0, 4)]
    assert rows(attach(facts, lookup, ["k"], how, hot=hot_keys(facts, ["k"], 5))) == rows(facts.join(lookup, "k", how))


def test_hot_keys_are_bounded_by_their_share(spark):
    frame = spark.range(5000).select((F.col("id") % 2500).alias("k"))
    assert hot_keys(frame, ["k"], 2).count() == 0


# ---- winners ----------------------------------------------------------------

def test_keep_best_is_independent_of_row_order(spark, rows):
    rng = random.Random(2)
    data = [(rng.randint(0, 5), rng.choice([None, 0.1, 0.9]), rng.choice([None, "2024-01-01T00:00:00Z", "2024-01-01T00:00:00.5Z"]), f"i{n:03d}") for n in range(80)]
    schema = "k int, conf double, created string, id string"
    order = W.edge_order(F.col("conf"), F.col("created"), F.col("id"))
    rank = lambda r: (-(r[1] if r[1] is not None else -1.0), r[2] or "9999-12-31T23:59:59Z", r[3])
    best = {k: min((r for r in data if r[0] == k), key=rank) for k in {r[0] for r in data}}
    for seed in (3, 4):
        random.Random(seed).shuffle(data)
        frame = spark.createDataFrame(data, schema).repartition(seed)
        assert rows(W.keep_best(frame, ["k"], order)) == sorted(best.values(), key=repr)
        audit = rows(W.dedup_audit(frame, ["k"], order, "id"))
        assert audit == sorted((r[3], best[r[0]][3]) for r in data if r != best[r[0]])


@pytest.mark.parametrize("few_keys", [10, 1])
def test_rows_alone_and_rows_that_share_a_key(spark, rows, few_keys):
    data = [("a", None, 1), ("a", None, 2), ("b", 1, 3), ("b", 1, 4), ("b", 2, 5), (None, None, 6)]
    frame = spark.createDataFrame(data, "k string, n int, i int").repartition(3)
    alone, shared = W.split_repeated(frame, ["k", "n"], few_keys)
    assert rows(shared, "i") == [(1,), (2,), (3,), (4,)] if few_keys > 1 else [(i,) for i in range(1, 7)]
    assert rows(alone.unionByName(shared)) == rows(frame) and alone.columns == frame.columns


def test_nothing_is_worked_out_to_describe_a_sound_table(spark):
    counts = spark.range(6).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max(F.raise_error(F.lit("described")).cast("string")).alias("why"))
    assert_empty(counts.where("n > 1"), "keys")


def test_last_write_and_sets(spark, rows):
    frame = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("b", 1, "z"), ("b", 1, "z")], "k string, n int, v string")
    assert rows(W.merge_last(frame, ["k"], [F.col("n")])) == [("a", 2, None), ("b", 1, "z")]
    assert rows(W.distinct_members(frame, ["k"], "v")) == [("a", "x"), ("b", "z")]
    assert rows(W.distinct_ordered(frame, "v", "n").where("v IS NOT NULL")) == [("x", 1), ("z", 1)]
    assert frame.agg(W.sorted_set(F.col("v"), ["z", "x", "q"]).alias("s")).collect()[0]["s"] == ["x", "z"]


# ---- integrity --------------------------------------------------------------

def test_counts_uniqueness_and_owners(spark, rows):
    a = spark.createDataFrame([(1, "p"), (1, "q"), (2, "p"), (None, "p"), (None, "p")], "k int, o string")
    declared = spark.createDataFrame([("a", 5), ("gone", 1)], "`table` string, declared bigint")
    assert rows(I.check_counts({"a": a}, declared)) == [("gone", 1, None)]
    assert rows(I.check_unique(a, ["k"])) == [(1, 2)]
    assert rows(I.multi_owned(a, "o", "k").select("o", "claims", "owners")) == [("p", 4, 3)]
    assert rows(I.check_single_value(a, ["k"], "o")) == [(1, "p", "q")]
    with pytest.raises(ValidationError, match="keys"):
        assert_empty(I.check_unique(a, ["k"]), "keys")


def test_audit_rules(spark, rows):
    kept = spark.createDataFrame([("a", 1), ("b", 1)], "k string, n int")
    dropped = spark.createDataFrame([("c",)], "id string")
    assert rows(I.check_audit(kept, dropped, ["k"], 3, 2)) == []
    assert {r[-1] for r in rows(I.check_audit(kept, dropped, ["k"], 4, 2))} == {"dropped count is consistent"}


def test_capacity(spark):
    frame = spark.createDataFrame([(40, 40, 100, 20), (41, 40, 100, 20), (0, 1, 100, 20), (1, 1, 100, 100)], "a int, b int, cap int, res int")
    got = [r[0] for r in frame.select(I.check_capacity(frame, ["a", "b"], "cap", F.col("res"))).collect()]
    assert got == [None, "no reserve left", "values must be positive", "reserve must be below 100"]


# ---- changes ----------------------------------------------------------------

def test_change_kinds_and_owners(spark, rows):
    lists = [["create"], ["update"], ["delete"], ["delete", "create"], ["create", "delete"], ["no-op"], ["read"], ["delete", "update"], [], ["update", "create"]]
    plan = spark.createDataFrame([(f"module.db[{n}].x", a) for n, a in enumerate(lists)], "address string, actions array<string>")
    got = C.summarize_changes(plan).collect()[0].asDict()
    assert got == {"create": 1, "update": 1, "replace": 2, "delete": 1, "read": 1, "no_op": 1, "destructive": 4}
    registry = spark.createDataFrame([("pg", "db", True, True), ("off", "db", True, False), ("web", "db", False, True)], "service string, terraform_module string, state_capable boolean, enabled boolean")
    risky = plan.where(C.is_destructive(F.col("actions")))
    assert {r[0] for r in rows(C.attach_owners(risky, registry), "service")} == {"pg"}
    assert C.attach_owners(risky, registry, strip_index=False).count() == 0


def test_evidence_checks_in_order(spark, rows):
    now = "2024-01-03 00:00:00"
    data = [
        ("a", "2024-01-02 00:00:00", "a-old", "d", "d", "a", "backup", False),
        ("a", "2024-01-02 12:00:00", "a-pre-restore", "d", "x", "a", "backup", True),
        ("b", "2024-01-02 12:00:00", "b1", None, "d", "b", "backup", False),
        ("c", "2024-01-02 12:00:00", "c1", "d", "x", "c", "backup", False),
        ("d", "2024-01-02 12:00:00", "d1", "d", "d", "z", "backup", False),
        ("e", "2024-01-01 23:59:59", "e1", "d", "d", "e", "backup", False),
        ("f", "2024-01-02 12:00:00", "f1", "d", "d", "f", "backup", True),
    ]
    frame = spark.createDataFrame(data, "service string, mtime string, name string, expected_sha256 string, sha256 string, manifest_target string, archive_kind string, excluded boolean")
    frame = frame.withColumn("mtime", F.to_timestamp_ntz("mtime"))
    got = rows(C.latest_evidence(frame, "service", "mtime", "name", F.lit(now).cast("timestamp_ntz"), F.col("excluded")), "service", "error")
    assert got == [
        ("a", None), ("b", "backup checksum is missing"), ("c", "backup checksum does not match"),
        ("d", "backup manifest target or kind is invalid"), ("e", "backup is older than 24 hours"), ("f", "backup archive is missing"),
    ]


def test_gate_first_failure(spark, rows):
    empty, one = spark.range(0), spark.range(1)
    gate = C.gate_results([(2, "second", one), (1, "first", empty), (3, "third", one)])
    assert rows(C.first_failure(gate)) == [(2, "second")]
    assert rows(C.first_failure(C.gate_results([(1, "first", empty)]))) == [(None, None)]


def members(spark, *data):
    frame = spark.createDataFrame([("g", *row) for row in data], "grp string, name string, cur string, dflt string, res string, pub string")
    return C.group_gate(frame.withColumn("pub", F.to_timestamp_ntz("pub")), "grp", "name", "cur", "dflt", "res", "pub", F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"))


def test_group_gate(spark, rows):
    old, new = "2023-01-01 00:00:00", "2024-01-09 00:00:00"
    status = lambda frame: rows(frame, "name", "status")
    assert status(members(spark, ("a", None, "1", "2", old), ("b", None, "1", "2", old))) == [("a", "skip"), ("b", "skip")]
    assert status(members(spark, ("a", "1", "1", "2", old), ("b", None, "1", "2", old))) == [("a", "skip"), ("b", "skip")]
    assert status(members(spark, ("a", "9", "1", "2", old), ("b", "1", "1", "2", old))) == [("a", "skip"), ("b", "skip")]
    assert status(members(spark, ("a", "1", "1", "2", new), ("b", "1", "1", "2", old))) == [("a", "hold"), ("b", "current")]
    assert status(members(spark, ("a", "1", "1", "2", old), ("b", "1", "1", "1", new))) == [("a", "updated"), ("b", "current")]
    assert status(members(spark, ("a", "1", "1", "1", new), ("b", "1", "1", "1", new))) == [("a", "current"), ("b", "current")]


def test_hold_boundary_is_eligible(spark, rows):
    frame = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("b", "2024-01-01 00:00:01"), ("c", "2023-12-01 00:00:00")], "id string, ts string").withColumn("ts", F.to_timestamp_ntz("ts")).withColumn("g", F.lit(1))
    now = F.lit("2024-01-08 00:00:00").cast("timestamp_ntz")
    assert rows(R.pick_release(frame, ["g"], "ts", "id", now, 168), "eligible_id", "held_id") == [("a", "b")]


def test_stable_needs_explicit_flags(spark, rows):
    data = [("a", False, False, "t"), ("b", None, False, "t"), ("c", False, True, "t"), ("d", False, False, None)]
    frame = spark.createDataFrame(data, "id string, draft boolean, prerelease boolean, published_at string")
    assert rows(R.stable(frame), "id") == [("a",)]


def test_head_with_rest(spark, rows):
    frame = spark.range(25)
    got = rows(R.head_with_rest(frame, [F.col("id")], 20))
    assert len(got) == 20 and {r[1] for r in got} == {5}
    assert {r[1] for r in rows(R.head_with_rest(frame, [F.col("id")], 30))} == {0}


# ---- releases ---------------------------------------------------------------

def test_identity_ignores_asset_order(spark):
    frame = spark.createDataFrame([(1, [("a", "u", 1), ("b", "v", None)]), (2, [("b", "v", None), ("a", "u", 1)]), (3, [("b", "v", 2), ("a", "u", 1)])], "k int, assets array<struct<name:string,url:string,id:int>>")
    one = F.lit("x")
    ids = [r[0] for r in frame.orderBy("k").select(L.identity(one, one, one, F.col("assets"))).collect()]
    assert ids[0] == ids[1] != ids[2]


def test_identity_of_odd_assets_keeps_its_digest(spark):
    odd = [("b", None, 2), None, (None, "u", 1), ("b", None, None), ("a", "v", 1), ("B", "v", 1), ("a", "v", 1), ("", "é", -1)]
    frame = spark.createDataFrame([(1, odd), (2, odd[::-1]), (3, []), (4, None)], "k int, assets array<struct<name:string,url:string,id:int>>")
    one = F.lit("x")
    text = F.to_json(F.struct(one.alias("v"), one.alias("p"), one.alias("u"), F.array_sort(F.transform("assets", lambda a: F.struct(a["name"], a["url"], a["id"]))).alias("a")))
    got = frame.orderBy("k").select(L.identity(one, one, one, F.col("assets")), F.sha2(text, 256)).collect()
    assert all(a == b for a, b in got) and got[0][0] == got[1][0] and len({a for a, _ in got}) == 3


def test_identity_takes_fields_of_plain_words_and_calls_no_comparing_function(spark):
    frame = spark.createDataFrame([(["b", "a", None, "b"],), ([],)], "words array<string>")
    one, named = F.lit("x"), lambda w: (w, F.lit("u"), F.length(w))
    whole = F.transform("words", lambda w: F.struct(w.alias("name"), F.lit("u").alias("url"), F.length(w).alias("id")))
    plain = frame.select(L.identity(one, one, one, F.col("words"), named).alias("a"))
    assert [r.a for r in plain.collect()] == [r.a for r in frame.select(L.identity(one, one, one, whole).alias("a")).collect()]
    assert "array_sort" not in plain._jdf.queryExecution().optimizedPlan().toString()


def test_attestation_requires_publisher_name_and_digest(spark, rows):
    def statement(subjects):
        return base64.b64encode(json.dumps({"subject": subjects}).encode()).decode()

    good = statement([{"name": "x.whl", "digest": {"sha256": "d1"}}])
    two = statement([{"name": "y.whl", "digest": {"sha256": "d2", "md5": "m"}}])
    data = [(("ci", "org/app"), [("%%%",), (good,), (base64.b64encode(b"[1").decode(),)]), (("ci", "other"), [(statement([{"name": "z.whl", "digest": {"sha256": "d3"}}]),)]), (("ci", "org/app"), [(two,)])]
    bundles = spark.createDataFrame(data, "publisher struct<kind:string,repository:string>, attestations array<struct<statement:string>>")
    artifacts = spark.createDataFrame([("x.whl", "d1"), ("x.whl", "d9"), ("y.whl", "d2"), ("z.whl", "d3")], "filename string, sha256 string")
    assert rows(L.attested(artifacts, bundles, {"kind": "ci", "repository": "org/app"})) == [("x.whl", "d1")]


C1, C2 = "a1" * 20, "b2" * 20


def test_pointer_follows_one_hop(spark, rows):
    refs = [("a", "commit", C1), ("b", "tag", "t1"), ("c", "tag", "t2"), ("d", "tree", "x"), ("e", "tag", "t9"), ("f", "commit", C1.upper()), ("g", "commit", C1[:39]), ("h", "commit", None)]
    refs = spark.createDataFrame(refs, "name string, type string, target string")
    objects = spark.createDataFrame([("t1", "commit", C2), ("t2", "tag", "t1")], "id string, type string, target string")
    assert rows(L.resolve_pointer(refs, objects)) == [
        ("a", C1, None), ("b", C2, None), ("c", None, "annotated tag does not resolve to a commit"),
        ("d", None, "does not resolve to a commit"), ("e", None, "tag object is missing"),
        *[(name, None, "commit is not 40 hex digits") for name in "fgh"],
    ]


def test_pivot_takes_last_and_flags_gaps(spark, rows):
    frame = spark.createDataFrame([("r", "amd64", "1", 1), ("r", "amd64", "2", 2), ("r", "arm64", "3", 1), ("s", "amd64", "4", 1)], "g string, k string, v string, o int")
    assert rows(L.pivot_complete(frame, ["g"], "k", "v", "o", ["amd64", "arm64"])) == [("r", "2", "3", True), ("s", "4", None, False)]


# ---- key/values -------------------------------------------------------------

def kv(spark, *data):
    return spark.createDataFrame(list(data), "g string, place int, key string, value string")


def test_renames(spark, rows):
    frame = kv(spark, ("a", 1, "old", "1"), ("a", 2, "new", "1"), ("b", 1, "old", "1"), ("b", 2, "new", "2"), ("c", 1, "old", "3"))
    good, bad = K.rename_key_strict(frame, {"old": "new"}, ["g"])
    assert rows(good) == [("a", "new", "1"), ("c", "new", "3")] and rows(bad) == [("b", "new")]
    assert rows(K.rename_key_prefer_new(frame, {"old": "new"}, ["g"], "place")) == [("a", "new", "1", 2), ("b", "new", "2", 2), ("c", "new", "3", 1)]


def test_overlay_and_copy(spark, rows):
    frame = kv(spark, ("a", 1, "x", "1"), ("a", 2, "y", "2"), ("a", 3, "z", "3"))
    desired = spark.createDataFrame([("a", "y", "2"), ("a", "z", "9"), ("a", "n", "5"), ("a", "e", "")], "g string, key string, value string")
    assert rows(K.overlay(frame, ["x"], desired, ["g"])) == [("a", "n", "5", "added"), ("a", "x", None, "removed"), ("a", "y", "2", "kept"), ("a", "z", "9", "changed")]
    copied, missing = K.copy_keys(frame, desired, {"y": "y", "n": "z", "q": "nope"}, ["g"])
    assert rows(copied) == [("a", "n", "3", True), ("a", "y", "2", False)] and rows(missing) == [("a", "nope")]


def test_compare_and_set(spark, rows):
    frame = kv(spark, ("a", 1, "x", "1"), ("a", 2, "y", "2"), ("b", 1, "x", "1"), ("b", 2, "y", "custom"), ("c", 1, "x", "1"), ("d", 1, "other", "o"))
    old, new = {"x": "1", "y": "2"}, {"x": "10", "y": "20"}
    got = rows(K.compare_and_set(frame, ["g"], old, new, allow_absent=True), "g", "key", "value", "changed")
    assert got == [
        ("a", "x", "10", True), ("a", "y", "20", True), ("b", "x", "1", False), ("b", "y", "custom", False), ("c", "x", "1", False),
        ("d", "other", "o", False), ("d", "x", "10", True), ("d", "y", "20", True),
    ]


def test_slots(spark, rows):
    frame = spark.createDataFrame([("a", True, True), ("b", True, True), ("b", False, True), ("c", False, False)], "g string, exact boolean, near boolean")
    assert rows(K.classify_slot(frame, ["g"], F.col("exact"), F.col("near"))) == [("a", "present"), ("b", "conflict"), ("c", "absent")]


# ---- names and addresses ----------------------------------------------------

def test_longest_suffix(spark, rows):
    names = spark.createDataFrame([("a.b.example.com",), ("example.com",), ("badexample.com",), ("x.other",)], "name string")
    zones = spark.createDataFrame([("example.com",), ("b.example.com",), ("com",)], "zone string")
    assert rows(NW.longest_suffix(names, zones)) == [("a.b.example.com", "b.example.com"), ("badexample.com", "com"), ("example.com", "example.com"), ("x.other", None)]


def test_reconcile_ignores_final_dots(spark, rows):
    desired = spark.createDataFrame([("z", "a", "A", "1.1.1.1"), ("z", "b", "CNAME", "x.y."), ("z", "c", "A", "2.2.2.2")], "zone string, domain string, type string, value string")
    actual = spark.createDataFrame([("z", "a.", "A", "1.1.1.1"), ("z", "b", "CNAME", "x.y"), ("z", "c", "A", "9.9.9.9"), ("z", "c", "A", "8.8.8.8")], desired.schema)
    assert rows(NW.reconcile(desired, actual, ["zone", "domain", "type"], "value"), "domain", "action") == [("a", "unchanged"), ("b", "unchanged"), ("c", "upsert")]


def test_containment_and_overlap(spark, rows):
    roots = spark.createDataFrame([("srv/a",), ("srv/b",)], "root string")
    paths = spark.createDataFrame([("srv/a",), ("srv/a/x",), ("srv/ab",), ("etc",)], "path string")
    assert rows(NW.check_containment(paths, roots)) == [("etc", 0, None), ("srv/a", 1, "srv/a"), ("srv/a/x", 1, "srv/a"), ("srv/ab", 0, None)]
    nested = spark.createDataFrame([("srv",), ("srv/a",), ("srv2",), ("srv2",)], "root string")
    assert rows(NW.overlapping_roots(nested)) == [("srv/a", "inside another root"), ("srv2", "duplicate")]


@pytest.mark.parametrize("used, low, high, want", [([11, 12, 14], 10, 20, 13), ([5], 10, 20, 11), ([11, 12], 10, 13, None), ([], 10, 12, 11), ([11, 12, 13], 12, 20, 14)])
def test_first_gap(spark, rows, used, low, high, want):
    frame = spark.createDataFrame([(u,) for u in used], "v bigint")
    assert rows(NW.first_gap(frame, "v", low, high)) == [(want,)]


# ---- graph ------------------------------------------------------------------

def brute_waves(order, needs, resource):
    pending, done, out, number = list(order), set(), {}, 0
    while pending:
        number += 1
        seen, wave = set(), []
        for node in pending:
            if {d for d in needs.get(node, ()) if d in order} <= done and resource[node] not in seen:
                seen.add(resource[node])
                wave.append(node)
        if not wave:
            break
        out.update({node: number for node in wave})
        done.update(wave)
        pending = [node for node in pending if node not in wave]
    return out, set(pending)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_waves_against_brute_force(spark, rows, seed):
    rng = random.Random(seed)
    order = rng.sample(range(14), 14)
    needs = {n: {m for m in rng.sample(range(16), 2) if m < n} for n in order}
    if seed == 3:
        needs[0] = {5}
        needs[5] = {0}
    resource = {n: rng.randint(0, 5) for n in order}
    nodes = spark.createDataFrame([(n, resource[n], i) for i, n in enumerate(order)], "node int, resource int, ord int")
    edges = spark.createDataFrame([(n, m) for n, ms in needs.items() for m in ms], "src int, dst int")
    want, stuck = brute_waves(order, needs, resource)
    for part_rows in (G.PART_ROWS, 6, 0):  # parts ordered in a task, both ways side by side, rounds alone
        done, left = G.waves(nodes, edges, part_rows=part_rows)
        assert rows(done) == sorted(want.items(), key=repr)
        assert {r[0] for r in rows(left)} == stuck


def test_waves_of_odd_rows(spark, rows):
    nodes = spark.createDataFrame([("a", None, 2), ("b", None, 1), ("c", "r", None), ("d", "r", None), (None, "r", 0), ("e", "r", 5), ("e", "s", 1), ("f", "t", 1)], "node string, resource string, ord int")
    edges = spark.createDataFrame([("a", "gone"), ("f", "f"), (None, "a"), ("d", None), ("e", "b"), ("e", "b")], "src string, dst string")
    for part_rows in (G.PART_ROWS, 0):
        done, left = G.waves(nodes, edges, part_rows=part_rows)
        assert rows(done) == [("a", 2), ("b", 1), ("c", 1), ("d", 2), ("e", 2)]
        assert rows(left) == [("f",)]
    done, left = G.waves(nodes.limit(0), edges.limit(0))
    assert rows(done) == rows(left) == [] and done.dtypes == [("node", "string"), ("wave", "int")]


def test_parts_of_a_long_chain(spark, rows, monkeypatch):
    rng = random.Random(4)
    name = list(range(600))
    rng.shuffle(name)
    links = [(name[i], name[i + 1]) for i in range(399)] + [(name[i], name[400]) for i in range(401, 600)]
    steps = []
    plain = G.durable
    monkeypatch.setattr(G, "durable", lambda df: steps.append(1) or plain(df))
    parts = G.weak_parts(spark.createDataFrame([(n,) for n in name], "node int"), spark.createDataFrame(links, "src int, dst int"))
    low, high = min(name[:400]), min(name[400:])
    assert rows(parts) == sorted(((n, low if i < 400 else high) for i, n in enumerate(name)), key=repr)
    assert len(steps) <= 2 + 12


def brute_components(edges):
    nodes = {n for e in edges for n in e}
    reach = {n: {d for s, d in edges if s == n} for n in nodes}
    for _ in nodes:
        for n in nodes:
            reach[n] |= {x for m in list(reach[n]) for x in reach[m]}
    return {n: max(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes if n in reach[n]}


@pytest.mark.parametrize("seed", [1, 2])
def test_cycles_against_brute_force(spark, rows, seed):
    rng = random.Random(seed)
    edges = {(rng.randint(0, 17), rng.randint(0, 17)) for _ in range(22)} | {(20, 21), (21, 22), (22, 20), (22, 23), (23, 24), (24, 23), (30, 30), (31, 32)}
    frame = spark.createDataFrame(sorted(edges), "src int, dst int")
    assert dict(rows(G.find_cycles(frame))) == brute_components(edges)


def test_long_chains_and_rings(spark, rows):
    chain = [(i, i + 1) for i in range(100)] + [(40, 200), (200, 20)]
    ring = [(i, 300 + (i + 1 - 300) % 37) for i in range(300, 337)]
    edges = chain + ring + [(500, 500), (None, 1), (5, None)]
    found = dict(rows(G.find_cycles(spark.createDataFrame(edges, "src int, dst int"))))
    assert found == {i: 200 for i in range(20, 41)} | {200: 200} | {i: 336 for i in range(300, 337)} | {500: 500}


def test_conflicts(spark, rows):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "d"), ("e", "e")], "src string, dst string")
    selected = spark.createDataFrame([("a",), ("b",), ("c",)], "node string")
    assert rows(G.conflict_pairs(edges, selected)) == [("a", "b"), ("b", "a")]
    assert rows(G.non_reciprocal(edges)) == [("c", "d")]
    assert rows(G.self_edges(edges)) == [("e",)]
    assert rows(G.missing_refs(edges, selected)) == [("c", "d"), ("e", "e")]


def test_rounds_of_joins_keep_a_size_that_a_table_can_have(spark):
    table = spark.range(4).select(F.col("id").alias("a"), F.col("id").alias("b"))
    for _ in range(6):
        other = table.select(F.col("a").alias("b"), F.col("b").alias("c"))
        table = durable(table.join(other, "b").select("a", F.col("c").alias("b")))
        assert int(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < 1 << 64
    assert sorted(map(tuple, table.collect())) == [(n, n) for n in range(4)]


def test_short_rings_end_after_few_rounds(spark, rows, monkeypatch):
    made = []
    monkeypatch.setattr(G, "durable", lambda df: made.append(durable(df)) or made[-1])
    edges = [(3 * ring + n, 3 * ring + (n + 1) % 3) for ring in range(300) for n in range(3)] + [(1000 + n, 1001 + n) for n in range(5)]
    chains = G._chains(spark.createDataFrame(edges, "src long, dst long"))
    assert rows(chains.where("ring"), "node", "high") == sorted(((n, n // 3 * 3 + 2) for n in range(900)), key=repr)
    assert len(made) <= 5


def test_a_node_between_two_circles_is_on_none(spark, rows):
    edges = [("a", "b"), ("b", "a"), ("a", "m"), ("b", "m"), ("m", "c"), ("m", "d"), ("c", "d"), ("d", "c")]
    found = rows(G.find_cycles(spark.createDataFrame(edges, "src string, dst string")))
    assert found == [("a", "b"), ("b", "b"), ("c", "d"), ("d", "d")]


def test_labels_reach_far_nodes_in_few_rounds(spark, rows, monkeypatch):
    made = []
    monkeypatch.setattr(G, "durable", lambda df: made.append(durable(df)) or made[-1])
    steps = [(n, n + 1) for n in range(99)] + [(n, n + 2) for n in range(98)] + [(99, 0), (98, 0)]
    found = rows(G._components(spark.createDataFrame(steps, "src long, dst long")))
    assert found == sorted(((n, found[0][1]) for n in range(100)), key=repr)
    assert len(made) < 50


def test_fields_are_sorted_behind_a_shuffle(spark):
    kv = spark.range(0, 4000, 1, 4).select((F.col("id") % 1000).alias("g"), F.concat(F.lit("k"), F.col("id") % 3).alias("key"), F.col("id").cast("string").alias("value"))
    wide = K.project_fields(kv, ["g"], ["k0", "k1"], {"k2": "none"})
    want = {}
    for n in range(4000):
        want.setdefault(n % 1000, {}).setdefault(f"k{n % 3}", []).append(str(n))
    got = {row.g: row for row in wide.collect()}
    assert len(got) == 1000
    for g, fields in want.items():
        assert [got[g].k0, got[g].k1, got[g].k2] == [max(fields.get("k0", [""])) or None, max(fields.get("k1", [""])) or None, max(fields.get("k2", ["none"]))]
    plan = wide._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert "Exchange" in plan.split("Sort [")[-1]


def test_nodes_of_a_graph_are_numbered_those_that_lead_to_many_last(spark, rows):
    edges = spark.createDataFrame([("a", "h"), ("b", "h"), ("h", "c"), ("h", "d"), ("d", "a")], "src string, dst string")
    ranked = G._ranked(edges)
    assert ranked.dtypes == [("name", "string"), ("node", "bigint")]
    found = sorted((number, name) for name, number in rows(ranked))
    assert len({number for number, _ in found}) == 5 and found[-1][1] == "h" and {name for _, name in found[:2]} == {"b", "c"}
