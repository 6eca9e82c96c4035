"""Numbers that stay, loads that recover, logs that grow, numbers as text."""

import json
import random
import struct

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions import normalize as N
from ledgerline.functions import text as X
from ledgerline.operators.integrity import ForeignKey
from ledgerline.session import file_names
from ledgerline.sources import generations as G
from ledgerline.streaming import logs as L
from ledgerline.streaming.numbering import NumberedLog
from ledgerline.streaming.tail import SPLIT, TASKS, TailReader, tail
from ledgerline.violations import ValidationError


def test_numbers_as_text_equal_their_repr(spark):
    draw = random.Random(7)
    values = [0.0, -0.0, 1e16, 1e-5, 1e22, 123456789.0, 1e7, 1e15, 9999999999999998.0, 1e-4, 5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, 2e-3, 2e23, 1e23, 0.1, 100.0, None]
    values += [2.2367600000000003e25, 2.0624899999999997e25]
    values += [x for x in (struct.unpack("d", draw.randbytes(8))[0] for _ in range(3000)) if x == x and abs(x) != float("inf")]
    values += [round(draw.uniform(-1e6, 1e6), draw.randint(0, 9)) * 10.0 ** draw.randint(-12, 12) for _ in range(2000)]
    frame = spark.createDataFrame(list(enumerate(values)), "i int, v double")
    line = X.canonical_json(F.struct("v"), frame.select("v").schema)
    found = {r.i: (r.t, r.line) for r in frame.select("i", X.number_text(F.col("v"), T.DoubleType()).alias("t"), line.alias("line")).collect()}
    assert [v for i, v in enumerate(values) if found[i][1] != ('{"v":%s}' % (json.dumps(v)))] == []
    assert [(v, found[i][0]) for i, v in enumerate(values) if v is not None and (float(found[i][0]) != v or len(found[i][0]) != len(repr(v)))] == []


def test_canonical_json_of_nested_floats(spark):
    kind = "b double, a struct<y array<double>, x map<string,double>, n string>, c int, f float"
    rows = [(1e16, ([1.0, None, 1e-5], {"q": 2.5, "\"p": 1e7}, "é\"\\"), 3, 0.1), (None, None, None, None), (2.0, ([], {}, None), -1, 1e10)]
    frame = spark.createDataFrame(rows, kind)
    got = [r.v for r in frame.select(X.canonical_json(F.struct(*frame.columns), frame.schema).alias("v")).collect()]
    want = [{"b": b, "a": a and dict(zip("yxn", a, strict=True)), "c": c, "f": f} for b, a, c, f in rows]
    assert got == [json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False) for x in want]


TEXTS = [
    '{"f": 1.0}', '{"n": 12345678901234567890123456789012345678901234567890}', '[1e16, 1E5, -0.0, 1e-7, 0.1]', '{"b": 1, "a": {"d": 2.50, "c": [true, null, "x1.0"]}}', "1.5", '"1.0"',
    '{"e": -0, "k": 9007199254740993}', '{"x": [[[[[[[[[[1.0]]]]]]]]]]}', "3", None,
]


def test_normalised_numbers_keep_kind_and_value(spark):
    frame = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    got = {r.i: r.j for r in frame.select("i", N.normalize_json(F.col("t")).alias("j")).collect()}
    for i, text in enumerate(TEXTS):
        want = None if text is None else json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        assert (got[i].value, got[i].error) == (want, None)


@pytest.mark.parametrize("text, error", [('{"a": 1e999}', "non-finite numeric value"), ("[-Infinity]", "non-finite numeric value"), ("NaN", "non-finite numeric value"), ('{"a": 1.}', "invalid JSON"), ('{"tb": "x", "id": null, "f": 1.5}', "reference without id"), ("{", "invalid JSON")])
def test_normalised_errors(spark, text, error):
    got = spark.range(1).select(N.normalize_json(F.lit(text)).alias("j")).first().j
    assert (got.value, got.error) == (None, error)


def log_rows(log):
    return {r.key: r.sequence for r in log.rows().collect()}


def test_numbers_stay_and_batches_count_once(spark, tmp_path):
    log = NumberedLog(spark, str(tmp_path / "log"), "part", ["key"], compact_every=2)
    assert log.last_numbers() is None
    frame = lambda *rows: spark.createDataFrame(list(rows), "part string, key int")
    log.write(frame(("a", 5), ("a", 7), ("b", 1)), 0)
    first = log_rows(log)
    assert first == {5: 1, 7: 2, 1: 1}
    late = frame(("a", 6), ("c", 9), ("a", 2))
    log.write(late, 1)
    log.write(late, 1)
    log.write(frame(("a", 100), ("b", 101)), 0)
    assert log_rows(log) == first | {2: 3, 6: 4, 9: 1}
    spark.range(5).write.parquet(f"{log.path}/rows/batch=000000000002")  # a batch that was broken off
    assert log_rows(log) == first | {2: 3, 6: 4, 9: 1}
    log.write(frame(("a", 11), ("b", 10), (None, 3)), 2)
    log.write(frame((None, 4)).limit(0), 3)
    log.write(frame((None, 4), ("d", 8)), 4)
    found = log_rows(log)
    assert found[7] == 2 and found[5] == 1 and found[2] == 3 and found[6] == 4 and found[9] == 1
    assert sorted((r.part or "", r.sequence) for r in log.rows().collect()) == sorted([("a", i) for i in range(1, 6)] + [("b", 1), ("b", 2), ("c", 1), ("d", 1)])
    assert {r.event_id for r in log.rows().where("part = 'a'").collect()} == {f"a-{i:06d}" for i in range(1, 6)}
    spark.range(5).write.parquet(f"{log.path}/last/batch=000000000009")
    log.remove_unfinished()
    assert "batch=000000000009" not in file_names(spark, f"{log.path}/last") and log.batches() == [0, 1, 2, 3, 4]


COLUMNS = {"parent": {"id": "int", "note": "string"}, "child": {"id": "int", "up": "int"}}


def load(spark, target, parents, children, source, **more):
    tables = {"parent": spark.createDataFrame([(i,) for i in parents], "id int"), "child": spark.createDataFrame(children, "id int, up int")}
    return G.load_generation(tables, COLUMNS, target, ["parent", "child"], [ForeignKey("child", "up", "parent")], source, **more)


def ids(spark, target, table="parent"):
    return sorted(r.id for r in G.read_loaded(spark, target, table).collect())


def test_generations(spark, tmp_path):
    target = str(tmp_path / "target")
    with pytest.raises(FileNotFoundError):
        G.current_path(spark, target)
    first = load(spark, target, [1, 2], [(1, 1)], "one", counts={"parent": 2, "child": 1})
    assert ids(spark, target) == [1, 2] and load(spark, target, [9], [(9, 9)], "one") == first
    with pytest.raises(ValidationError):
        load(spark, target, [3], [(1, 7)], "two")
    with pytest.raises(ValueError):
        load(spark, target, [3], [(1, 3)], "three", counts={"parent": 4})
    assert ids(spark, target) == [1, 2] and (tmp_path / "target/pending.json").exists()
    kept = load(spark, target, [4], [(1, 3)], "three", counts={"parent": 1})  # whole tables are kept when it goes on
    assert ids(spark, target) == [3] and ids(spark, target, "child") == [1] and not (tmp_path / "target/pending.json").exists()
    assert G.roll_back(spark, target) == first and ids(spark, target) == [1, 2] and kept != first
    with pytest.raises(FileNotFoundError):
        G.roll_back(spark, target)
    with pytest.raises(ValueError):
        G.load_generation({"parent": spark.range(1).withColumn("z", F.lit(1))}, COLUMNS, target, ["parent"], [], "four")


def test_a_growing_file_is_read_on(spark, tmp_path):
    folder, out, progress = tmp_path / "log", str(tmp_path / "out"), str(tmp_path / "progress")
    folder.mkdir()
    (folder / "a.jsonl").write_bytes(b"")

    def seen():
        L.run_to_parquet(tail(spark, str(folder), split=7), out, progress)
        return sorted((r.file, r.offset, r.line) for r in spark.read.schema("file string, offset bigint, line string").parquet(out).collect())

    def append(name, data):
        with open(folder / name, "ab") as file:
            file.write(data)

    append("a.jsonl", b"one\n\nthree is longer than a split\r\nto")
    append("skipped.txt", b"no\n")
    first = [("a.jsonl", 0, "one"), ("a.jsonl", 4, ""), ("a.jsonl", 5, "three is longer than a split")]
    assert seen() == first
    append("a.jsonl", b"rn")
    append("b.jsonl", "ü\n".encode())
    assert seen() == first + [("b.jsonl", 0, "ü")]
    append("a.jsonl", b"\nlast\n")
    assert seen() == sorted(first + [("b.jsonl", 0, "ü"), ("a.jsonl", 35, "torn"), ("a.jsonl", 40, "last")])
    assert len(seen()) == 6


def test_tasks_of_a_tail_grow_with_its_bytes():
    sizes = {"a.jsonl": 50_000_000, "b.jsonl": 9_999}
    reader = TailReader("/nowhere", ".jsonl", 4096)
    before = {"files": json.dumps({"a.jsonl": 1_000})}
    parts = reader.partitions(before, {"files": json.dumps(sizes)})
    assert len(parts) <= TASKS + len(sizes)
    for name, first, stop in (("a.jsonl", 1_000, 50_000_000), ("b.jsonl", 0, 9_999)):
        own = [part for part in parts if part.path == name]
        assert [part.start for part in own] == [first] + [part.end for part in own[:-1]] and own[-1].end == stop
        assert all(part.end - part.start <= SPLIT and (part.first, part.stop) == (first, stop) for part in own)
