"""Differences of stored inventories against a plain comparison."""

import random
import shutil
from pathlib import Path

import pytest

from ledgerline.sources import hashtree as H


def brute(before, after):
    """Kind by key, for rows as multisets."""
    out = {}
    for key in {k for k, _ in before + after}:
        a, b = (sorted((repr(v) for k, v in side if k == key)) for side in (before, after))
        if a != b:
            out[key] = "added" if not a else "removed" if not b else "changed"
    return out


def write(spark, data, path, depth=1):
    H.write_tree(spark.createDataFrame(data, "key string, digest string"), str(path), depth=depth)
    return str(path)


def test_tree_diff_against_plain_comparison(spark, rows, tmp_path):
    rng = random.Random(6)
    before = [(f"k{i}", f"v{rng.randrange(9)}") for i in range(300)] + [("twice", "x"), ("twice", "x"), (None, "n"), ("null", None), ("", "e"), ("hot", "h")] + [("hot", "h")] * 400
    after = [(k, "new" if k and rng.random() < 0.01 else v) for k, v in before if k != "k17"] + [("extra", "y"), ("twice", "z"), (None, "n")]
    after.remove(("hot", "h"))
    want = brute(before, after)
    assert {"k17", "extra", "twice", None, "hot"} <= set(want)
    for depth in (0, 1, 2):
        a, b = write(spark, before, tmp_path / f"a{depth}", depth), write(spark, after, tmp_path / f"b{depth}", depth)
        assert dict(rows(H.tree_diff(spark, a, b))) == want
        assert rows(H.tree_diff(spark, a, a)) == []


def test_only_differing_leaves_are_read(spark, rows, tmp_path):
    before = [(f"k{i}", "v") for i in range(2000)]
    a, b = write(spark, before, tmp_path / "a", 2), write(spark, [*before[:-2], ("k1998", "w")], tmp_path / "b", 2)
    leaves = H.differing_leaves(spark, a, b)
    assert 1 <= len(leaves) <= 2
    for side in (a, b):
        for folder in Path(side, "rows").glob("leaf=*"):
            if folder.name.removeprefix("leaf=") not in leaves:
                shutil.rmtree(folder)
    assert rows(H.tree_diff(spark, a, b)) == [("k1998", "changed"), ("k1999", "removed")]


def test_order_and_partitions_do_not_matter(spark, tmp_path):
    data = [(f"k{i}", str(i % 7)) for i in range(500)]
    a = write(spark, data, tmp_path / "a")
    H.write_tree(spark.createDataFrame(data[::-1], "key string, digest string").repartition(7), str(tmp_path / "b"), depth=1)
    assert H.differing_leaves(spark, a, str(tmp_path / "b")) == []


def test_empty_and_unequal_trees(spark, rows, tmp_path):
    empty, full = write(spark, [], tmp_path / "empty", 1), write(spark, [("a", "1")], tmp_path / "full", 1)
    assert rows(H.tree_diff(spark, empty, full)) == [("a", "added")]
    assert rows(H.tree_diff(spark, full, empty)) == [("a", "removed")]
    assert rows(H.tree_diff(spark, empty, empty)) == []
    with pytest.raises(ValueError):
        H.tree_diff(spark, full, write(spark, [("a", "1")], tmp_path / "deep", 2))
