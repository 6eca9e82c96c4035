import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import maxscore as X


def plain(vectors, queries, k):
    out = []
    for q, a in queries:
        scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), v) for v, b in vectors if v != q and len(a) == len(b))
        out += [(q, i + 1, v, -s) for i, (s, v) in enumerate(scored[:k])]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(v, x, 1, 0) for v, x in rows], "vec_id bigint, vector array<bigint>, length int, score int")


def some(draw, rows, dims, spread=60, centres=4):
    middle = [[draw.randint(-300, 300) for _ in range(dims)] for _ in range(centres)]
    return [(i, [m + draw.randint(-spread, spread) for m in draw.choice(middle)]) for i in range(rows)]


@pytest.mark.parametrize("shard_rows, query_rows, strip", [(65_536, 8_192, 64), (37, 3, 8), (50, 2, 1)])
def test_equal_to_scoring_everything(spark, monkeypatch, shard_rows, query_rows, strip):
    monkeypatch.setattr(X, "STRIP", strip)
    draw = random.Random(shard_rows)
    rows = some(draw, 150, 12)
    rows += [(200 + i, rows[i % 3][1]) for i in range(25)]
    asked = rows[::30]
    found = X.search(frame(spark, rows), frame(spark, asked), 10, shard_rows, query_rows)
    assert sorted(tuple(r) for r in found.collect()) == plain(rows, asked, 10)


def test_pruning_leaves_rows_unscored():
    draw = random.Random(5)
    rows = some(draw, 4000, 16, spread=5, centres=8)
    matrix, ids = np.array([x for _, x in rows], float), np.arange(4000)
    touched = []

    class Counted(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, tuple) and isinstance(key[1], np.ndarray):
                touched.append(len(key[1]))
            return super().__getitem__(key)

    original = np.ascontiguousarray
    try:
        np.ascontiguousarray = lambda a: original(a).view(Counted)
        found = list(X.search_shard(matrix[:3], ids[:3], matrix, ids, 10))
    finally:
        np.ascontiguousarray = original
    assert len(found) == 3 and sum(touched) < 3 * 4000 * 16 / 2


def test_odd_rows(spark):
    rows = [(1, [1, 2]), (2, [3, 4]), (2, [3, 4]), (None, [9, 9]), (3, None), (4, [5]), (5, []), (6, []), (7, [1 << 62, 1 << 62]), (8, [0, 0])]
    found = X.search(frame(spark, rows), frame(spark, [(1, [1, 2]), (1, [1, 2]), (5, []), (None, [1, 2]), (7, [1 << 62, 1 << 62])]), 10).collect()
    got = {}
    for r in found:
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(got[1]) == [(1, 7, (1 << 63) - 1), (2, 2, 11), (3, 2, 11), (4, 8, 0)]
    assert got[5] == [(1, 6, 0)]
    assert [v for _, v, _ in sorted(got[7])] == [1, 2, 2, 8] or {v for _, v, _ in got[7]} == {1, 2, 8}
    assert X.search(frame(spark, []), frame(spark, rows)).count() == 0
    assert X.search(frame(spark, rows), frame(spark, [])).count() == 0


def test_integer_vectors(spark):
    rows = [[0.1, -0.1, 0.0], [float("nan"), 1.0, 1.0], [float("inf"), 1.0, 1.0], [None, 1.0, 1.0], None, [], [1e30, -1e30, 5e-324]]
    found = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, e array<double>").select("i", X.integer_vector(F.col("e")).alias("v")).collect()
    got = {r.i: r.v for r in found}
    assert got[0] == [math.floor(1024 * x) for x in rows[0]]
    assert [got[i] for i in range(1, 6)] == [None, None, None, None, []]
    assert got[6] == [1 << 62, -(1 << 62), 0]
