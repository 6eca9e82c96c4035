import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import hardneg as X


def plain(vectors, anchors, positives=5, negatives=10):
    out = []
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    for anchor, label, vector in anchors:
        others = sorted((-score(vector, v), i, own) for i, own, v in vectors if i != anchor and len(v) == len(vector))
        for minus, positive, _ in [x for x in others if x[2] == label][:positives]:
            fits = [x for x in others if x[2] != label and 30 * -minus <= 100 * -x[0] <= 90 * -minus][:negatives]
            out += [(anchor, positive, rank + 1, i, -minus, -s) for rank, (s, i, _) in enumerate(fits)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 0, 0) for r in rows], "vec_id bigint, label int, vector array<bigint>, anchor string, shard int, score int")


def some(draw, rows, dims, labels=4, spread=60):
    middle = [[draw.randint(-300, 300) for _ in range(dims)] for _ in range(labels)]
    made = []
    for i in range(rows):
        label = draw.randrange(labels)
        centre = middle[label if draw.random() < 0.7 else draw.randrange(labels)]
        made.append((i, label if draw.random() < 0.7 else 0, [m + draw.randint(-spread, spread) for m in centre]))
    return made


@pytest.mark.parametrize("shard, block, step, dims, seed", [(65_536, 8_192, 8, 20, 1), (37, 3, 1, 7, 2), (50, 2, 3, 12, 3), (9, 100, 4, 1, 4)])
def test_equal_to_scoring_everything(spark, monkeypatch, shard, block, step, dims, seed):
    monkeypatch.setattr(X, "SHARD_ROWS", shard)
    monkeypatch.setattr(X, "BLOCK_ROWS", block)
    monkeypatch.setattr(X, "STEP", step)
    draw = random.Random(seed)
    rows = some(draw, 160, dims)
    rows += [(300 + i, draw.randrange(4), rows[i % 3][2]) for i in range(25)]
    asked = rows[::20]
    found = X.mine(frame(spark, rows), frame(spark, asked))
    assert sorted(tuple(r) for r in found.collect()) == plain(rows, asked)


@pytest.mark.parametrize("seed", range(6))
def test_scan_equals_sorting(monkeypatch, seed):
    draw = random.Random(seed)
    monkeypatch.setattr(X, "STEP", draw.choice([1, 2, 8]))
    rows = some(draw, 400, 16, spread=draw.choice([2, 60, 400]))
    shard = X.Shard(np.array([v for *_, v in rows], float), np.arange(400), np.array([own for _, own, _ in rows]))
    for anchor in np.array([v for *_, v in rows[:20]], float):
        scores = shard.columns.T @ anchor
        alive = shard.labels != draw.randrange(4)
        windows = [(None, None)] + [tuple(sorted(draw.choices(list(scores), k=2))) for _ in range(3)] + [(5, 4)]
        for (low, high), (got, sums) in zip(windows, shard.scan(anchor, alive, windows, 7), strict=True):
            inside = [i for i in np.flatnonzero(alive) if low is None or low <= scores[i] <= high]
            assert list(got) == sorted(inside, key=lambda i: (-scores[i], i))[:7] and list(sums) == [scores[i] for i in got]


def test_bitmap_shrinks():
    draw = random.Random(5)
    rows = some(draw, 4000, 32, labels=8, spread=5)
    touched = []

    class Counted(np.ndarray):
        def __getitem__(self, key):
            touched.append(len(key[1]) * len(key[0]) if isinstance(key, tuple) else self.shape[1] * len(key))
            return np.asarray(self)[key]

    shard = X.Shard(np.array([v for *_, v in rows], float), np.arange(4000), np.zeros(4000, int))
    shard.columns = shard.columns.view(Counted)
    for anchor in np.array([v for *_, v in rows[:5]], float):
        shard.scan(anchor, np.ones(4000, bool), [(None, None)], 5)
    assert sum(touched) < 5 * 4000 * 32 * 0.7


def test_odd_rows(spark):
    rows = [(1, 0, [1, 2]), (2, 0, [3, 4]), (2, 0, [3, 4]), (None, 0, [9, 9]), (3, 1, None), (4, None, [5, 5]), (5, 1, [5]), (6, 1, []), (8, 1, [0, 0]), (9, 1, [2, 2]), (9, 1, [2, 2]), (10, 2, [1, 3]), (11, 0, [-1, -1]), (1, 3, [1, 1])]
    known = [r for r in rows if None not in r]
    asked = [rows[0], rows[0], rows[12], (None, 0, [1, 1]), (6, 1, [])]
    found = sorted(tuple(r) for r in X.mine(frame(spark, rows), frame(spark, asked)).collect())
    assert [r for r in found if r[0] != 1 or r[1] != 2] == [r for r in plain(known, [rows[0], rows[12], (6, 1, [])]) if r[0] != 1 or r[1] != 2]
    assert {r[3:] for r in found if r[:2] == (1, 2)} == {r[3:] for r in plain(known, [rows[0]]) if r[1] == 2}
    assert X.mine(frame(spark, []), frame(spark, known)).count() == 0
    assert X.mine(frame(spark, known), frame(spark, [])).count() == 0


def test_large_components_stay_exact(spark):
    draw = random.Random(9)
    rows = [(i, i % 2, [draw.randint(-(1 << 29), 1 << 29) for _ in range(3)]) for i in range(40)]
    found = X.mine(frame(spark, rows), frame(spark, rows[:6]))
    assert sorted(tuple(r) for r in found.collect()) == plain(rows, rows[:6])


def test_whole_vectors(spark):
    rows = [[0.1, -0.1, 0.0], [float("nan"), 1.0, 1.0], [float("inf"), 1.0, 1.0], [None, 1.0, 1.0], None, [], [1e30, -1e30, 5e-324]]
    got = {r.i: r.v for r in spark.createDataFrame(list(enumerate(rows)), "i int, e array<double>").select("i", X.whole_vector(F.col("e"), 256).alias("v")).collect()}
    assert got[0] == [25, -26, 0] and [got[i] for i in range(1, 6)] == [None, None, None, None, []] and got[6] == [1 << 62, -(1 << 62), 0]
