"""Content migration: normalise, deduplicate, repair, refuse."""

import json
import time

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import normalize as N
from ledgerline.operators import integrity as I
from ledgerline.plans import migration as M
from ledgerline.session import STEPS_AT_ONCE, side_by_side
from ledgerline.sources import snapshot as S
from ledgerline.violations import ValidationError, assert_empty

AT = "2024-01-01T00:00:00Z"


def content(ident="content:c1", **extra):
    return {"id": ident, "content_type": "note", "mime_type": "text/plain", "file_size": 3, "file_path": "a/b", "created_at": AT, "updated_at": AT, **extra}


def chunk(ident, parent, **extra):
    return {"id": f"chunk:{ident}", "content_id": f"content:{parent}", "text": "same", "chunk_index": 0, "created_at": AT, **extra}


def edge(ident, confidence, created):
    return {"id": ident, "content_id": "content:c1", "entity_id": "entity:e1", "edge_type": "mentions", "confidence": confidence, "source": "x", "created_at": created}


def job(ident, parent, status):
    return {"id": ident, "resource_key": "r", "content_id": f"content:{parent}", "status": status, "pipeline_version": "1", "created_at": AT}


ENTITY = {"id": "entity:e1", "entity_type": "t", "name": "N", "normalized_name": "n", "source": "x", "created_at": AT, "updated_at": AT}


def variants(spark, records):
    frame = spark.createDataFrame([(json.dumps(record),) for record in records], "value string")
    return frame.select(F.parse_json("value").alias("record"))


def run(spark, size=3, **tables):
    return M.migrate({name: variants(spark, records) for name, records in tables.items()}, vector_size=size)


def test_normalise_reference_time_and_unknown_field(spark):
    record = content(id={"tb": "content", "id": {"String": "c1"}}, created_at="2024-01-01T01:00:00+01:00", strange=1, metadata={"owner": {"tb": "entity", "id": "e9"}})
    row = M.normalize_table(variants(spark, [record]), "content").collect()[0]
    assert row["id"] == "c1" and row["broken"] == [] and row["tags"] == []
    assert row["created_at"].isoformat() == "2024-01-01T00:00:00"
    assert json.loads(row["metadata"]) == {"owner": "e9"}
    assert "strange" not in row.asDict()


@pytest.mark.parametrize(
    "change, rule",
    [
        ({"id": "chunk:x:y"}, "id: invalid chunk reference"),
        ({"content_id": {"tb": "entity", "id": "e"}}, "content_id: invalid content reference"),
        ({"embedding": [1.0]}, "embedding: must hold exactly 3 finite values"),
        ({"embedding": [1.0, "x", 2.0]}, "embedding: must hold exactly 3 finite values"),
        ({"text": None}, "missing required fields: text"),
        ({"created_at": "yesterday"}, "created_at: not a timestamp"),
        ({"chunk_index": "one"}, "chunk_index: not a bigint"),
    ],
)
def test_row_rules(spark, change, rule):
    row = M.normalize_table(variants(spark, [{**chunk("k", "c1"), **change}]), "chunk", 3).collect()[0]
    assert rule in row["broken"]


def test_null_vector_and_good_vector_pass(spark):
    records = [chunk("a", "c1", embedding=None), chunk("b", "c1", embedding=[1, 2.5, 3])]
    assert all(row["broken"] == [] for row in M.normalize_table(variants(spark, records), "chunk", 3).collect())


def test_tags_must_be_strings(spark):
    got = M.normalize_table(variants(spark, [content(tags=["a", 1])]), "content").collect()[0]
    assert got["broken"] == ["tags: not a array<string>"]


def test_dedup_keeps_earlier_of_equal_confidence(spark, rows):
    edges = [edge("a", 0.7, "2024-01-01T00:00:00Z"), edge("b", 0.9, "2024-01-03T00:00:00Z"), edge("c", 0.9, "2024-01-02T00:00:00Z")]
    done = run(spark, content=[content()], entity=[ENTITY], content_entity=edges)
    assert rows(done.tables["content_entity"], "id") == [("c",)]
    assert rows(done.audits["deduplication"]) == [("a", "c"), ("b", "c")]
    done.require_clean()


def test_orphans_are_repaired_with_audit(spark, rows):
    done = run(spark, content=[content()], chunk=[chunk("a", "c1"), chunk("b", "gone")], pipeline_job=[job("j", "gone", "failed")])
    assert rows(done.tables["chunk"], "id") == [("a",)]
    assert rows(done.audits["chunk_repairs"]) == [("b", "gone", "c1", "a")]
    assert rows(done.audits["job_repairs"]) == [("j", "gone", "failed")]
    done.require_clean()


def test_ambiguous_orphan_is_refused(spark):
    done = run(spark, content=[content(), content("content:c2")], chunk=[chunk("a", "c1"), chunk("b", "c2"), chunk("c", "gone")])
    with pytest.raises(ValidationError, match="unresolved reference"):
        done.require_clean()


@pytest.mark.parametrize("jobs", [[job("j", "gone", "completed")], [job("j", "gone", "failed"), job("k", "gone", "failed")]])
def test_job_orphans_beyond_the_rule_are_refused(spark, jobs):
    with pytest.raises(ValidationError):
        run(spark, content=[content()], pipeline_job=jobs).require_clean()


def test_dangling_reference_and_null_target(spark, rows):
    link = {"id": "link:l1", "source": "content:c1", "link_text": "t", "link_type": "x", "created_at": AT}
    ok = run(spark, content=[content()], link=[link])
    ok.require_clean()
    bad = run(spark, content=[content()], link=[{**link, "target": "content:no"}])
    assert rows(bad.violations) == [("link", "l1", "unresolved reference link.target=no")]


def test_dangling_edge_that_loses_is_not_reported(spark):
    good = edge("a", 0.9, AT)
    lost = {**edge("b", 0.1, AT), "entity_id": "entity:e1"}
    run(spark, content=[content()], entity=[ENTITY], content_entity=[good, lost]).require_clean()


def test_duplicate_ids_are_reported(spark, rows):
    done = run(spark, content=[content(), content()])
    assert ("content", "c1", "duplicate id") in rows(done.violations)


def test_snapshot_write_verify_corrupt_and_load(spark, rows, tmp_path):
    done = run(spark, content=[content()], chunk=[chunk("a", "c1")])
    tables = {name: done.tables[name] for name in ("content", "chunk")}
    path = str(tmp_path / "snap")
    S.write_snapshot(tables, {"counts": done.audits["source_counts"]}, path)
    assert rows(S.verify_snapshot(spark, path)) == []
    with pytest.raises(FileExistsError):
        S.write_snapshot(tables, {}, path)
    part = next((tmp_path / "snap" / "tables" / "chunk").glob("part-*"))
    part.write_text(part.read_text().replace("same", "diff"))
    crc = part.with_name(f".{part.name}.crc")
    if crc.exists():
        crc.unlink()
    assert {rule for rule, _ in rows(S.verify_snapshot(spark, path))} == {"file changed"}
    target = str(tmp_path / "target")
    fks = [fk for fk in M.REFERENCES if fk.child == "chunk"]
    cols = {name: M.load_columns(name) for name in tables}
    S.load_tables(tables, cols, target, ["content", "chunk"], fks)
    assert spark.read.parquet(f"{target}/chunk").columns == list(cols["chunk"])
    with pytest.raises(FileExistsError):
        S.load_tables(tables, cols, target, ["content", "chunk"], fks)


def test_load_refuses_unknown_columns_and_dangling_rows(spark, tmp_path):
    parent = spark.createDataFrame([("a",)], "id string")
    child = spark.createDataFrame([("x", "b")], "id string, pid string")
    fk = [I.ForeignKey("child", "pid", "parent")]
    cols = {"parent": {"id": "string"}, "child": {"id": "string", "pid": "string"}}
    with pytest.raises(ValidationError):
        S.load_tables({"parent": parent, "child": child}, cols, str(tmp_path / "t1"), ["parent", "child"], fk)
    with pytest.raises(ValueError, match="unknown fields"):
        S.load_tables({"parent": parent.withColumn("z", F.lit(1)), "child": child}, cols, str(tmp_path / "t2"), ["parent", "child"], [])


def test_incomplete_snapshot_is_refused(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        S.read_manifest(spark, str(tmp_path / "none"))


def test_best_edges_are_sorted_out_once(spark, rows):
    edges = [edge("a", 0.7, "2024-01-01T00:00:00Z"), edge("b", 0.9, "2024-01-03T00:00:00Z")]
    done = run(spark, content=[content()], entity=[ENTITY], content_entity=edges)
    for part in (done.tables["content_entity"], done.violations):
        assert "min_by" not in part._jdf.queryExecution().analyzed().toString()
    assert rows(done.audits["deduplication"]) == [("a", "b")]


def test_lines_of_all_tables_are_counted_in_one_pass(spark, rows, tmp_path):
    tables = {"a": spark.range(3).select(F.col("id").cast("string")), "b": spark.range(0).select(F.col("id").cast("string")), "c_1": spark.range(2).select(F.col("id").cast("string"))}
    S.write_snapshot(tables, {}, str(tmp_path / "snap"))
    assert rows(S.read_manifest(spark, str(tmp_path / "snap"))) == [("a", 3, 1), ("b", 0, 1), ("c_1", 2, 1)]
    counted = S.line_counts(spark, str(tmp_path / "snap"), list(tables))
    assert rows(counted) == [("a", 3), ("b", 0), ("c_1", 2)]
    assert counted._jdf.queryExecution().optimizedPlan().toString().count(" text") == 1
    assert rows(S.verify_snapshot(spark, str(tmp_path / "snap"))) == []


def test_few_steps_run_side_by_side(spark):
    running, most = [], []

    def step():
        running.append(1)
        most.append(len(running))
        time.sleep(0.05)
        running.pop()
        return len(most)

    assert len(side_by_side(spark, [step] * 12)) == 12 and max(most) <= STEPS_AT_ONCE


def test_violations_are_asked_part_by_part(spark):
    sound, wrong = spark.range(3).where("id < 0"), spark.range(3).where("id = 1")
    assert_empty([sound, sound], "parts")
    with pytest.raises(ValidationError, match="parts: {'id': 1}"):
        assert_empty([sound, wrong], "parts")


def test_only_edges_that_share_a_key_are_sorted_out(spark, rows, tmp_path):
    other = {**edge("c", 0.1, AT), "edge_type": "names"}
    raw = {"content": [content()], "entity": [ENTITY], "content_entity": [edge("a", 0.7, AT), edge("b", 0.9, AT), other]}
    stage = str(tmp_path / "stage")
    done = M.migrate({name: variants(spark, records) for name, records in raw.items()}, vector_size=3, stage=stage)
    assert rows(done.tables["content_entity"], "id") == [("b",), ("c",)]
    assert rows(spark.read.parquet(f"{stage}/kept_edges"), "id") == [("b",)]


def test_ids_are_not_moved_to_find_the_repeated_ones(spark, rows):
    done = run(spark, content=[content(), content(), content("content:c2")])
    assert rows(done.unresolved) == []
    moved = [part for part in done.violations._jdf.queryExecution().optimizedPlan().toString().split("Union") if "Aggregate [id#" in part]
    assert moved and all("_digest" in part for part in moved)
    assert rows(done.violations) == [("content", "c1", "duplicate id")]


@pytest.mark.parametrize(
    "given, ident, error",
    [
        ("content:c_1-x", "c_1-x", False),
        ("c1", "c1", False),
        ("content:⟨c1⟩", "c1", False),
        ("content:c.1", "c.1", False),
        ("content:", None, True),
        ("contentc1", "contentc1", False),
        ("entity:c1", None, True),
        ("content:c1\n", "c1\n", False),
        (7, "7", False),
        ({"tb": "content", "id": "c1"}, "c1", False),
    ],
)
def test_references_of_usual_and_other_forms(spark, given, ident, error):
    record = F.parse_json(F.lit(json.dumps({"v": given})))
    got = spark.range(1).select(N.normalize_ref_variant(F.variant_get(record, "$.v", "variant"), "content").alias("r")).first()["r"]
    assert (got["id"], got["error"] is not None) == (ident, error)


def test_times_of_usual_and_other_forms_agree(spark):
    same = ["2024-05-01T08:00:00.5Z", "2024-05-01 10:00:00.500+02:00", "2024-05-01T08:00:00,5", "20240501T080000.5", "2024-05-01T10:00:00.5000009+0200"]
    bad = ["2024-05-01T25:00:00Z", "2024-05-01T08:00:00+19:00", "2024-02-30T08:00:00Z", "yesterday", "2024-05-01T08:00:00Z "]
    frame = spark.createDataFrame([(text,) for text in same + bad], "at string")
    got = [row["x"] for row in frame.select(N.to_utc(F.col("at")).cast("string").alias("x")).collect()]
    assert got == ["2024-05-01 08:00:00.5"] * len(same) + [None] * len(bad)


def test_snapshot_lines_are_judged_once(spark, rows, tmp_path):
    done = run(spark, content=[content()], chunk=[chunk("a", "c1", embedding=[1, 2.5, 3])])
    M.publish(done, str(tmp_path / "snap"))
    tables, violations = M.check_snapshot(spark, str(tmp_path / "snap"), 3)
    assert rows(violations) == []
    assert rows(tables["chunk"], "id", "embedding") == [("a", [1.0, 2.5, 3.0])]
    assert "from_json" not in violations._jdf.queryExecution().analyzed().toString()
