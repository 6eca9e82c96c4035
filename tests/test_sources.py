"""Files in, tables out: strict and loose records, logs, key/values, inventories; and streams."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from ledgerline.session import durable, shared_root
from ledgerline.sources import files as S
from ledgerline.sources import records as D
from ledgerline.streaming import logs as L


def test_strict_read(spark, rows, tmp_path):
    lines = [{"id": "a", "n": 1}, {"id": "b", "n": None}, {"id": "c", "n": 1, "z": 0, "y": 0}, {"id": "", "n": 1}, {"id": 5}, {"id": "d", "n": "x"}, {"id": "a", "n": 2}]
    text = "\n".join(json.dumps(line) for line in lines) + '\n[1]\n{"id":\n\n'
    (tmp_path / "t.ndjson").write_text(text)
    good, bad = D.read_strict(spark, str(tmp_path), "id string, n int")
    assert rows(good) == [("a", 1), ("a", 2), ("b", None)]
    assert sorted(r[0] for r in rows(bad, "rule")) == sorted(
        ["unknown fields: y, z", "invalid id", "invalid id", "value does not fit its column", "not an object", "invalid JSON", "blank line", "duplicate id: a"]
    )


def test_loose_read(spark, rows, tmp_path):
    (tmp_path / "t").write_text('{"id": 1, "more": {"x": 2}}\n"text"\n')
    good, bad = D.read_loose(spark, str(tmp_path / "t"))
    assert rows(good.select(F.try_variant_get("record", "$.more.x", "int").alias("x"))) == [(2,)]
    assert rows(bad, "rule") == [("not an object",)]


@pytest.mark.parametrize("ending, torn", [("\n", []), ("", ["torn final line"])])
def test_log_finds_torn_line(spark, rows, tmp_path, ending, torn):
    (tmp_path / "log").write_text('{"a": 1, "b": "é"}\n{"a": 2, "b": "y"}' + ending, encoding="utf-8")
    good, bad = D.read_log(spark, str(tmp_path / "log"), "a int, b string")
    assert len(rows(good)) == 2 and [r[0] for r in rows(bad, "rule")] == torn


def test_log_rejects_wrong_types(spark, rows, tmp_path):
    lines = ['{"id": "x", "seq": "oops", "code": true, "on": true, "tags": ["a"]}', '{"id": 5, "seq": 1, "code": 2, "on": 1, "tags": ["a", 1]}', '{"id": null, "seq": 1, "code": null, "on": false, "tags": []}']
    (tmp_path / "log").write_text("\n".join(lines) + "\n")
    good, bad = D.read_log(spark, str(tmp_path / "log"), "id string, seq bigint, code int, on boolean, tags array<string>")
    assert rows(good) == [(None, 1, None, False, [])]
    assert rows(bad, "rule") == [("wrong type: code, seq",), ("wrong type: id, on, tags",)]


def test_log_requires_exact_fields(spark, rows, tmp_path):
    (tmp_path / "log").write_text('{"a": 1}\n{"a": 1, "b": "x", "c": 0}\n\n')
    _, bad = D.read_log(spark, str(tmp_path / "log"), "a int, b string")
    assert [r[0] for r in rows(bad, "rule")] == ["blank line", "fields do not match the schema", "fields do not match the schema"]


def test_keyvalues(spark, rows, tmp_path):
    text = "# note\n\nexport A=1\nB='two words'\nC=\"x\\\"y\"\nD=a b\nE='open\nA=2\nnot a pair\nZ=9\n  F=plain\nG=\n"
    (tmp_path / "env").write_text(text)
    good, bad = S.read_keyvalues(spark, str(tmp_path / "env"), ["A", "B", "C", "D", "E", "F", "G"], strict=True)
    assert rows(good, "key", "value") == [("A", "1"), ("A", "2"), ("B", "two words"), ("C", 'x"y'), ("F", "plain")]
    found = rows(bad, "line", "rule")
    assert {line for line, _ in found} == {6, 7, 8, 9, 10, 12}
    assert (8, "duplicate key A") in found and (10, "unsupported key Z") in found
    loose, none = S.read_keyvalues(spark, str(tmp_path / "env"), ["A"])
    assert rows(loose, "key", "value") == [("A", "1"), ("A", "2")] and rows(none, "rule") == [("duplicate key A",)]


def test_lines_skip_undecodable_files(spark, rows, tmp_path):
    (tmp_path / "good").write_text("a\nb\n")
    (tmp_path / "bad").write_bytes(b"\xff\xfe\x00x\n")
    assert rows(S.read_lines(spark, str(tmp_path)), "line", "text") == [(1, "a"), (2, "b")]


def test_line_numbers_run_through_blocks(spark, tmp_path):
    lines = [f"{i} " + "x" * (i % 90) + ("\x0bsecond" if i % 7 == 0 else "") + ("\r" if i % 5 == 0 else "") for i in range(400)]
    text = "\n".join(lines) + "\n\nlast"
    (tmp_path / "long").write_bytes(text.encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        found = S.read_lines(spark, str(tmp_path / "long"))
        assert spark.read.option("lineSep", "\n").text(str(tmp_path / "long")).rdd.getNumPartitions() > 1
        got = sorted((r.line, r.text) for r in found.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == list(enumerate(text.splitlines(), 1))


def test_inventory_fingerprint_and_totals(spark, rows, tmp_path):
    root = tmp_path / "objects"
    (root / "x").mkdir(parents=True)
    (root / "x" / "b").write_text("22")
    (root / "a").write_text("1")
    inventory = S.object_inventory(spark, str(root))
    assert rows(inventory) == [("a", 1), ("x/b", 2)]
    total = S.inventory_totals(inventory).collect()[0]
    assert (total["object_count"], total["total_bytes"]) == (2, 3)
    assert total["key_tree_sha256"] == hashlib.sha256(b"a\nx/b\n").hexdigest()
    empty = S.inventory_totals(inventory.where("size > 9")).collect()[0]
    assert empty["object_count"] == 0 and empty["key_tree_sha256"] == hashlib.sha256(b"").hexdigest()
    prints = S.fingerprint(spark, [f"{root}/*", f"{root}/a", f"{root}/x/*"])
    assert sorted(r[0] for r in rows(prints, "sha256")) == sorted(hashlib.sha256(b).hexdigest() for b in (b"1", b"22"))
    assert rows(S.fingerprint(spark, [f"{root}/*", f"{root}/a", f"{root}/x/*"], inline_bytes=0)) == rows(prints)


@pytest.mark.parametrize("count, leaf", [(10, 16), (300, 16), (5000, 16), (5000, 1024)])
def test_inventory_digest_is_one_function_at_every_size(spark, count, leaf):
    keys = [f"k{i}" for i in range(count)]
    depth = 0
    while 16**depth * leaf < count:
        depth += 1

    def node(prefix):
        own = sorted(k for k in keys if hashlib.sha256(k.encode()).hexdigest().startswith(prefix))
        if not own:
            return None
        if len(prefix) == depth:
            return hashlib.sha256(("\n".join(own) + "\n").encode()).hexdigest()
        return hashlib.sha256("\n".join(filter(None, (node(prefix + c) for c in "0123456789abcdef"))).encode()).hexdigest()

    frame = spark.createDataFrame([(k, 1) for k in keys], "key string, size int")
    first = S.inventory_totals(frame, leaf_keys=leaf).collect()[0]
    assert (first["object_count"], first["total_bytes"], first["key_tree_sha256"]) == (count, count, node(""))
    assert S.inventory_totals(frame.repartition(7).orderBy(F.desc("key")), leaf_keys=leaf).collect()[0] == first
    twice = S.inventory_totals(frame.unionByName(frame.limit(1)), leaf_keys=leaf).collect()[0]
    assert twice["object_count"] == count + 1 and twice["key_tree_sha256"] != first["key_tree_sha256"]


def test_checksum_list(spark, rows, tmp_path):
    d = "a" * 64
    (tmp_path / "sums").write_text(f"{d}  one\n{d} *two\n{'b' * 63}  three\n{d}  one\n")
    good, bad = S.read_checksums(spark, str(tmp_path / "sums"))
    assert [r[0] for r in rows(good, "name")] == ["one", "one", "two"]
    assert rows(bad, "rule") == [("duplicate checksum entry",), ("invalid checksum entry",)]


def test_config_documents(spark, rows, tmp_path):
    (tmp_path / "c.json").write_text('{"zones": {"z1": ["f1", "f2"]},\n "names": {"a": "1"}}')
    document = S.read_config(spark, str(tmp_path / "c.json"))
    part = document.select(F.get_json_object("document", "$.zones").alias("z"), F.get_json_object("document", "$.names").alias("n"))
    assert rows(S.explode_list_map(part, "z")) == [("z1", 0, "f1"), ("z1", 1, "f2")]
    assert rows(S.explode_map(part, "n")) == [("a", "1")]


def test_durable_uses_the_shared_folder(spark):
    kept = durable(spark.range(3))
    assert kept.count() == 3
    assert shared_root(spark).rstrip("/").split("/")[-1] in spark.sparkContext.getCheckpointDir()


# ---- streams ----------------------------------------------------------------

EVENTS = "command string, ts timestamp, kind string, status string"


def source(spark, folder, *batches):
    """One Parquet file per batch, read one file per trigger."""
    for number, batch in enumerate(batches):
        frame = spark.createDataFrame(batch, "command string, ts string, kind string, status string")
        frame.withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(f"{folder}/b{number}")
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/b*")


def finish(spark, stream, tmp_path):
    L.run_to_parquet(stream, str(tmp_path / "out"), str(tmp_path / "progress"))
    return spark.read.schema(stream.schema).parquet(str(tmp_path / "out"))


def test_stream_pairs(spark, rows, tmp_path):
    first = [("a", "2024-01-01 00:00:00", "s", None), ("b", "2024-01-01 00:00:10", "s", None), ("a", "2024-01-01 00:01:00", "t", "passed")]
    later = [("z", "2024-01-02 00:00:00", "s", None), ("y", "2024-01-02 00:00:00", "t", "failed")]
    stream = source(spark, str(tmp_path / "in"), first, later)
    paired = L.stream_pairs(stream, "command", "ts", F.col("kind") == "s", F.col("kind") == "t", "status", "10 MINUTES")
    assert rows(finish(spark, paired, tmp_path), "command", "status") == [("a", "passed"), ("b", "incomplete")]


def test_stream_changes_report_once_per_state(spark, rows, tmp_path):
    one = [("r", "2024-01-01 00:00:00", "x", "waiting"), ("r", "2024-01-01 00:00:05", "x", "running")]
    two = [("r", "2024-01-01 00:00:09", "x", "running"), ("q", "2024-01-01 00:00:09", "x", "running")]
    three = [("r", "2024-01-01 00:00:20", "x", "success")]
    four = [("r", "2024-01-01 00:00:30", "x", "running"), ("p", "2024-01-01 03:00:00", "x", "waiting")]
    stream = source(spark, str(tmp_path / "in"), one, two, three, four)
    changes = L.stream_changes(stream, "command", "ts", "status", ["success", "failure"], timeout_ms=3600_000)
    got = rows(finish(spark, changes, tmp_path), "key", "state", "outcome")
    assert ("r", "running", "change") in got and ("r", "success", "terminal") in got
    assert ("q", "running", "timeout") in got and ("p", "waiting", "change") in got
    assert len([g for g in got if g[0] == "r"]) == 2


def test_end_of_log_reports_open_starts(spark, rows, tmp_path):
    events = [("a", "2024-01-01 00:00:00", "s", None), ("a", "2024-01-01 00:01:00", "t", "passed"), ("b", "2024-01-01 00:02:00", "s", None)]
    stream = source(spark, str(tmp_path / "in"), events)
    paired = finish(spark, L.stream_pairs(stream, "command", "ts", F.col("kind") == "s", F.col("kind") == "t", "status", "10 MINUTES"), tmp_path)
    starts = spark.createDataFrame(events, "command string, ts string, kind string, status string").where("kind = 's'").withColumn("ts", F.to_timestamp("ts"))
    assert rows(L.end_of_log(starts, paired, "command", "ts"), "command", "status") == [("a", "passed"), ("b", "incomplete")]


def test_copies_are_refused_for_ever(spark, rows, tmp_path):
    one = [("a", "2024-01-01 00:00:00", "x", "1"), ("a", "2024-01-01 00:00:00", "x", "1")]
    much_later = [("a", "2024-03-01 00:00:00", "x", "1"), ("b", "2024-03-01 00:00:02", "x", "2")]
    stream = source(spark, str(tmp_path / "in"), one, much_later, one)
    assert rows(finish(spark, L.stream_dedupe(stream, ["command"]), tmp_path), "command") == [("a",), ("b",)]


def test_stream_redact_and_dedupe(spark, rows, tmp_path):
    one = [("a", "2024-01-01 00:00:00", "x", "at 10.0.0.1"), ("a", "2024-01-01 00:00:00", "x", "at 10.0.0.1")]
    two = [("a", "2024-01-01 00:00:01", "x", "again"), ("b", "2024-01-01 00:00:02", "x", "me@example.com")]
    stream = source(spark, str(tmp_path / "in"), one, two)
    clean = L.stream_redact(L.stream_dedupe(stream, ["command"], "ts"), "status")
    assert rows(finish(spark, clean, tmp_path), "command", "status") == [("a", "at <ip>"), ("b", "<email>")]


def test_changes_are_folded_for_many_keys_at_once(spark, rows, tmp_path):
    at = lambda minute: f"2024-01-01 {minute // 60:02d}:{minute % 60:02d}:00"
    one = [(f"k{i}", at(0), "x", "running") for i in range(300)] + [(None, at(0), "x", "running")]
    two = [(f"k{i}", at(30), "x", "success" if i % 2 else "waiting") for i in range(100)] + [("k0", at(20), "x", "old"), ("k1", at(30), "x", "failure")]
    three = [(f"k{i}", at(50), "x", "running") for i in range(50)] + [("k60", at(65), "x", "waiting"), ("z", at(80), "x", None)]
    stream = source(spark, str(tmp_path / "in"), one, two, three)
    changes = L.stream_changes(stream, "command", "ts", "status", ["success", "failure"], timeout_ms=3600_000, groups=3)
    expected = [(f"k{i}", "running", "change") for i in range(300)] + [(None, "running", "change")]
    expected += [(f"k{i}", "success" if i % 2 else "waiting", "terminal" if i % 2 else "change") for i in range(100)]
    expected += [(f"k{i}", "running", "change") for i in range(0, 50, 2)]
    expected += [(f"k{i}", "running", "timeout") for i in range(100, 300)] + [(None, "running", "timeout")]
    assert rows(finish(spark, changes, tmp_path), "key", "state", "outcome") == sorted(expected, key=repr)


def test_changes_call_python_once_for_a_group_of_keys(spark, tmp_path):
    stream = source(spark, str(tmp_path / "in"), [(f"k{i}", "2024-01-01 00:00:00", "x", "running") for i in range(200)])
    changes = L.stream_changes(stream, "command", "ts", "status", ["success"], timeout_ms=3600_000, groups=3)
    finish(spark, changes, tmp_path)
    kept = spark.read.format("statestore").load(str(tmp_path / "progress"))
    assert kept.count() == 3
