import pytest
from pyspark.sql import functions as F

from ledgerline.llm import mixing as M


def level(sizes, weights, most=3):
    """Resharing by rounds: what is above a cap goes to the others by weight."""
    total, capped = sum(sizes.values()), set()
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        open_ = sum(weight[s] for s in names if s not in capped)
        target = {s: most * sizes[s] if s in capped else weight[s] * rest / open_ for s in names}
        above = {s for s in names if s not in capped and target[s] > most * sizes[s]}
        if not above:
            return target
        capped |= above


def table(documents, sources):
    rows, at = [], 0
    for source, lengths in sources.items():
        for n in lengths:
            rows.append((at, "w " * n if n else None, "en", source))
            at += 1
    return documents(rows), rows


SOURCES = {"a": [3] * 200, "b": [100, 5, 5, 0], None: list(range(1, 60)), "c": [1], "é": [7] * 40, "empty": [0, 0]}


@pytest.mark.parametrize("part_rows", [7, 4000])
def test_targets_and_copies(documents, part_rows):
    docs, rows = table(documents, SOURCES)
    taken = M.copies_per_document(docs, [5, 2, 1], part_rows=part_rows).collect()
    assert len(taken) == len(rows)
    want = level({s: sum(x) for s, x in SOURCES.items()}, [5, 2, 1])
    source_of = {r[0]: r[3] for r in rows}
    for source, lengths in SOURCES.items():
        own = [t for t in taken if source_of[t.row.doc_id] == source]
        assert {round(t.target, 6) for t in own} == {round(want[source], 6)}
        assert all(0 <= t.copies <= 3 and t.source_size == sum(lengths) for t in own)
        rate = want[source] / sum(lengths) if sum(lengths) else 0
        assert abs(sum(t.copies for t in own) - rate * len(own)) <= 1
        assert abs(sum(t.copies * t.size for t in own) - want[source]) <= 1.5 * max(lengths)
    again = M.copies_per_document(docs.repartition(5), [5, 2, 1], part_rows=part_rows).collect()
    assert sorted((t.row.doc_id, t.copies) for t in again) == sorted((t.row.doc_id, t.copies) for t in taken)


def test_salted_join_gives_the_same(documents, monkeypatch):
    docs, _ = table(documents, SOURCES)
    plain = sorted(tuple(r) for r in M.copies_per_document(docs, [5, 2, 1]).collect())
    monkeypatch.setattr(M, "BROADCAST_SOURCES", 1)
    assert sorted(tuple(r) for r in M.copies_per_document(docs, [5, 2, 1]).collect()) == plain


def test_mix_repeats_whole_rows(documents):
    docs, _ = table(documents, SOURCES)
    taken = {t.row.doc_id: t.copies for t in M.copies_per_document(docs, [1]).collect()}
    mixed = M.mix(docs, [1])
    assert mixed.columns == docs.columns
    counts = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert counts == {i: n for i, n in taken.items() if n}


def test_odd_tables(documents):
    assert M.copies_per_document(documents([]), [1]).count() == 0
    repeated = documents([(1, "a b", "en", "s")] * 5 + [(None, "c", "en", "s"), (None, None, None, None)])
    assert M.copies_per_document(repeated, [2]).count() == 7
    with pytest.raises(ValueError):
        M.copies_per_document(repeated, [1, 0])


def test_word_count(documents, spark):
    from pyspark.sql import functions as F

    texts = [None, "", " ", "a", " a\tb\n", "a\x0bb\x0cc\rd", "a\x1cb", "a\u00a0b", "x " * 50_000]
    found = documents([(i, t) for i, t in enumerate(texts)]).select("doc_id", M.word_count(F.col("text")).alias("n")).collect()
    assert [r.n for r in sorted(found, key=lambda r: r.doc_id)] == [0, 0, 0, 1, 2, 4, 1, 1, 50_000]


def test_many_sources_are_sorted_in_many_tasks(spark):
    sizes = {f"s{i:04d}": i * 37 % 1009 for i in range(1500)} | {None: 40_000}
    table = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size bigint, source_rows bigint").repartition(4)
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        found = M.source_targets(table, [5, 2, 1]).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set(name, before)
    assert len({r.task for r in found}) > 1
    want = level(sizes, [5, 2, 1])
    assert len(found) == len(want) and all(r.target == pytest.approx(want[r.source]) for r in found)
