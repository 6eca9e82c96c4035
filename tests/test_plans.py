"""Whole runs: snapshot import, change gate, service registry, record planning."""

import datetime
import json
import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import changes as C
from ledgerline.plans import migration as M
from ledgerline.plans import names as D
from ledgerline.plans import services as V
from ledgerline.session import discard, scratch_path, scratch_scope
from ledgerline.violations import ValidationError
from tests.test_migration import ENTITY, chunk, content, edge, job, run


def test_publish_check_and_import(spark, rows, tmp_path):
    done = run(
        spark, content=[content()], entity=[ENTITY], chunk=[chunk("a", "c1", embedding=[1, 2, 3]), chunk("b", "gone", embedding=[1, 2, 3])],
        content_entity=[edge("x", 0.2, "2024-01-01T00:00:00Z"), edge("y", 0.3, "2024-01-01T00:00:00Z")], pipeline_job=[job("j", "gone", "failed")],
    )
    path = str(tmp_path / "snap")
    M.publish(done, path)
    tables, violations = M.check_snapshot(spark, path, 3)
    assert rows(violations) == []
    assert rows(tables["content_entity"], "id") == [("y",)]
    M.import_snapshot(spark, path, str(tmp_path / "target"), 3)
    loaded = spark.read.parquet(str(tmp_path / "target" / "chunk"))
    assert rows(loaded, "id", "content_id", "embedding") == [("a", "c1", [1.0, 2.0, 3.0])]
    with pytest.raises(ValidationError, match="wrong dimension"):
        M.import_snapshot(spark, path, str(tmp_path / "other"), 4)


def test_audit_mismatch_is_found(spark, rows, tmp_path):
    done = run(spark, content=[content()], entity=[ENTITY], content_entity=[edge("x", 0.2, "2024-01-01T00:00:00Z"), edge("y", 0.3, "2024-01-01T00:00:00Z")])
    done.audits["deduplication"] = done.audits["deduplication"].limit(0)
    M.publish(done, str(tmp_path / "snap"))
    assert ("audits", "content_entity", "raw, dropped and kept do not agree") in rows(M.check_snapshot(spark, str(tmp_path / "snap"), 3)[1])


def test_unclean_migration_is_not_published(spark, tmp_path):
    with pytest.raises(ValidationError):
        M.publish(run(spark, content=[content()], chunk=[chunk("a", "nowhere")]), str(tmp_path / "snap"))


def gate(spark, **change):
    head = "expires_at string, plan_sha256 string, git_commit string"
    saved = spark.createDataFrame([(change.get("expires", "2024-01-02"), "p", "c")], head).withColumn("expires_at", F.to_timestamp_ntz("expires_at"))
    current = spark.createDataFrame([("2024-01-01", change.get("plan", "p"), change.get("commit", "c"))], "now string, plan_sha256 string, git_commit string").withColumn("now", F.to_timestamp_ntz("now"))
    inputs = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, sha256 string")
    later = inputs if not change.get("inputs") else inputs.limit(1)
    plan = spark.createDataFrame(change.get("plan_rows", [("module.db.x", ["delete"])]), "address string, actions array<string>")
    registry = spark.createDataFrame([("pg", "db", True, True), ("mail", "mx", True, True)], "service string, terraform_module string, state_capable boolean, enabled boolean")
    owned = C.attach_owners(plan.where(C.is_destructive(F.col("actions"))), registry)
    schema = "service string, archive string, sha256 string, error string"
    evidence = spark.createDataFrame(change.get("evidence", [("pg", "a1", "d", None)]), schema)
    now = spark.createDataFrame(change.get("evidence_now", change.get("evidence", [("pg", "a1", "d", None)])), schema)
    result = C.change_gate(saved, current, inputs, later, plan, owned, evidence, now, change.get("destroy", True), change.get("batch", False))
    return C.first_failure(result).collect()[0]["reason"]


TWO = [("module.db.x", ["delete"]), ("module.mx.y", ["delete", "create"])]


@pytest.mark.parametrize(
    "change, reason",
    [
        ({}, None),
        ({"expires": "2023-12-31"}, "plan is expired"),
        ({"plan": "other"}, "plan changed"),
        ({"inputs": True}, "plan inputs changed"),
        ({"commit": "other"}, "commit changed"),
        ({"commit": None}, None),
        ({"destroy": False}, "plan is destructive"),
        ({"plan_rows": TWO, "evidence": [("pg", "a", "d", None), ("mail", "a", "d", None)]}, "plan changes several stateful targets"),
        ({"plan_rows": TWO, "evidence": [("pg", "a", "d", None), ("mail", "a", "d", None)], "batch": True}, None),
        ({"evidence": []}, "backup evidence does not cover the services"),
        ({"evidence": [("pg", None, None, "backup archive is missing")]}, "no current verified backup"),
        ({"evidence_now": [("pg", "a2", "e", None)]}, "backup evidence changed"),
        ({"expires": "2023-12-31", "plan": "other"}, "plan is expired"),
    ],
)
def test_change_gate_reports_the_first_failure(spark, change, reason):
    assert gate(spark, **change) == reason


def service(name, playbooks=(), dependencies=(), conflicts=None, resource=None, module=None, target=None):
    return (name, list(playbooks), list(dependencies), conflicts, resource, module, target)


def test_registry_rules(spark, rows):
    good = spark.createDataFrame([service("a", ["p1"]), service("b", ["p2"], ["a"], ["c"]), service("c", ["p3"], ["a"], ["b"])], V.SERVICE_SCHEMA)
    names = lambda *items: spark.createDataFrame([(item,) for item in items], "name string")
    assert rows(V.check_services(good, names("a", "b"))) == []
    bad = spark.createDataFrame(
        [
            service("a", ["p"], ["b"]), service("b", ["p"], ["a"], ["a"]), service("c", [], ["c", "nope"], ["c", "gone"], " "),
            service("d", ["q", "q"], module="m", target="t"),
        ],
        V.SERVICE_SCHEMA,
    )
    found = {(rule, key) for rule, key, _ in rows(V.check_services(bad, names("a", "a", "z")))}
    assert found == {
        ("duplicate default", "a"), ("unknown default", "z"), ("duplicate playbook", "p"), ("duplicate playbook", "q"), ("unknown dependency", "c"),
        ("depends on itself", "c"), ("unknown conflict", "c"), ("conflicts with itself", "c"), ("conflict is not reciprocal", "b"),
        ("blank execution resource", "c"), ("module and target both set", "d"), ("cyclic dependency", "a"), ("cyclic dependency", "b"),
    }
    picked = {(rule, key) for rule, key, _ in rows(V.check_selection(good, names("b", "c", "c", "x")))}
    assert picked == {("unknown service", "x"), ("duplicate selection", "c"), ("conflict", "b"), ("conflict", "c"), ("missing dependency", "b"), ("missing dependency", "c")}


def test_confirmed_releases(spark, rows):
    from ledgerline.plans import releases as P

    kinds = "target string, version string, published_at timestamp_ntz, draft boolean, prerelease boolean, url string, assets array<struct<name: string, url: string, id: bigint>>, checksum string"
    old, new = datetime.datetime(2020, 1, 1), datetime.datetime(2020, 2, 1)

    def read(changed):
        one = lambda target, assets=(("x", "u", 1), ("y", "v", None)), draft=False, checksum="c", when=new: (target, "2", when, draft, False, "w", list(assets), checksum)
        made = [one("same", (("y", "v", None), ("x", "u", 1)) if changed else (("x", "u", 1), ("y", "v", None))), one("asset", (("x", "u", 2 if changed else 1),)), one("gone", draft=changed)]
        made += [one("proof", checksum="d" if changed else "c"), one("nameless", (("", "u", 1),)), one("time", when=old if changed else new), one("none", ()), one("pinned", draft=changed)]
        return spark.createDataFrame([*made, one("older", when=new, draft=changed), ("older", "1", old, False, False, "w", [], "c")], kinds)

    pins = spark.createDataFrame([(n, "2" if n == "pinned" else "0", True) for n in ("same", "asset", "gone", "proof", "nameless", "time", "none", "pinned", "older", "absent")], "target string, current string, is_default boolean")
    now = F.lit("2021-01-01 00:00:00").cast("timestamp_ntz")
    got = {r[0]: r[1:] for r in rows(P.discover_confirmed(pins, read(False), read(True), now, proofs=("checksum",)), "target", "latest", "status", "detail")}
    bad = (None, "error", "release changed during re-resolution")
    assert all(got[name] == bad for name in ("asset", "gone", "proof", "time", "older"))
    assert got["nameless"] == (None, "error", "release has an unidentified asset")
    assert got["same"][:2] == got["none"][:2] == ("2", "updated") and got["pinned"][:2] == ("2", "current") and got["absent"][1] == "error"
    calm = rows(P.discover_confirmed(pins, read(False), read(False), now, proofs=("checksum",)), "target", "status")
    assert {t for t, status in calm if status == "error"} == {"nameless", "absent"}


def test_start_order_shares_resources(spark, rows):
    services = spark.createDataFrame([service("db"), service("web1", [], ["db"], None, "host"), service("web2", [], ["db"], None, "host"), service("job", [], ["off"])], V.SERVICE_SCHEMA)
    chosen = spark.createDataFrame([("web2", 0), ("web1", 1), ("db", 2), ("job", 3)], "name string, ord int")
    done, left = V.start_order(services, chosen)
    assert rows(done) == [("db", 1), ("job", 1), ("web1", 3), ("web2", 2)] and rows(left) == []


def test_records(spark, rows):
    good = {"zones": {"example.com": ["f"], "sub.example.com.": ["f"]}, "a_records": {"a.sub.example.com": "192.0.2.1"}, "cname_records": {"b.example.com.": "a.sub.example.com."}}
    bad = {"zones": {"-x": [" "]}, "a_records": {"n.other": "1.2.3.999"}, "cname_records": {"n.other": "ok.name"}, "more": 1}
    docs = spark.createDataFrame([("good", json.dumps(good)), ("bad", json.dumps(bad)), ("short", '{"zones": {}}')], "doc string, document string")
    found = rows(D.check_documents(docs), "key", "rule")
    assert [rule for key, rule in found if key == "good"] == []
    assert [rule for key, rule in found if key == "short"] == ["missing key", "missing key"]
    assert [rule for key, rule in found if key == "bad"] == ["address and alias for one name", "invalid forwarder", "invalid value", "invalid zone", "no zone", "no zone", "unknown key"]
    actual = spark.createDataFrame([("sub.example.com", "a.sub.example.com.", "A", "192.0.2.1"), ("example.com", "b.example.com", "CNAME", "old")], "zone string, domain string, type string, value string")
    planned = rows(D.plan_records(docs.where("doc = 'good'"), actual), "zone", "domain", "action")
    assert planned == [("example.com", "b.example.com", "upsert"), ("sub.example.com", "a.sub.example.com", "unchanged")]


@pytest.mark.parametrize("gone", [["ledgerline/llm"], ["ledgerline/llm", "corpus_pipeline.py"]])
def test_entry_without_the_training_data_part(tmp_path, gone):
    here = Path(__file__).parent.parent
    shutil.copytree(here / "ledgerline", tmp_path / "ledgerline", ignore=lambda folder, names: {"llm", "__pycache__"} & set(names) if "ledgerline/llm" in gone else set())
    for name in {"__spark_entry__.py", "corpus_pipeline.py"} - set(gone):
        if (here / name).exists():
            shutil.copy(here / name, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 160 and set(e.oracle_sql()) <= set(q) and not any(x.startswith('op1_') or x == 'pipeline' for x in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_scratch_scope_deletes_after_success_only(spark):
    kept = scratch_path(spark, "kept")
    spark.range(3).write.parquet(kept)
    with scratch_scope(spark):
        gone = scratch_path(spark, "gone")
        spark.range(3).write.parquet(gone)
    with pytest.raises(ZeroDivisionError), scratch_scope(spark):
        failed = scratch_path(spark, "failed")
        spark.range(3).write.parquet(failed)
        1 / 0
    assert [os.path.exists(x) for x in (kept, gone, failed)] == [True, False, True]
    discard(spark, kept, failed, gone)
    assert not os.path.exists(kept) and not os.path.exists(failed)
