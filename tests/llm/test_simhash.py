import itertools
import random

import numpy as np
import pytest
import xxhash

from ledgerline.llm import simhash as S
from ledgerline.llm.components import components


def plain_print(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    digests = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(d >> b & 1 for d in digests) > len(digests))


def parts_of(values, near):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in itertools.combinations(values, 2):
        if near(a, b):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


@pytest.mark.parametrize("text", ["", " \n", "one", "One two", "a b c", "A B c a b c a b c", "É x é " * 30, "w " * 100_000])
def test_fingerprint(text):
    assert S.fingerprint(text) == plain_print(text)


def test_long_texts_are_counted_in_blocks(monkeypatch):
    text = " ".join(str(i % 97 * i) for i in range(500))
    whole = S.fingerprint(text)
    monkeypatch.setattr(S, "BLOCK", 7)
    assert S.fingerprint(text) == whole


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_masks_cover_every_difference(radius):
    masks = S.covering_masks(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    for bits in itertools.combinations(range(64), radius):
        assert any(not any(m >> b & 1 for b in bits) for m in masks)
    draw = random.Random(1)
    for mask in masks:
        finer = S.finer_masks(mask, radius)
        free = [b for b in range(64) if not mask >> b & 1]
        for _ in range(200):
            bits = draw.sample(free, radius)
            assert any(not any(m >> b & 1 for b in bits) for m in finer)


def flip(value, draw, most):
    for b in draw.sample(range(64), draw.randint(0, most)):
        value ^= 1 << b
    return value


@pytest.mark.parametrize("bucket_rows", [4096, 6])
def test_links_connect_what_is_close(spark, bucket_rows):
    draw = random.Random(bucket_rows)
    seeds = [draw.getrandbits(64) for _ in range(15)]
    values = {0, (1 << 64) - 1} | {flip(s, draw, 4) for s in seeds for _ in range(25)}
    frame = spark.createDataFrame([(S._signed(v),) for v in values], "fp bigint")
    links = S.close_links(frame, 3, bucket_rows).collect()
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 3 for a, b in links)
    want = parts_of(sorted(S._signed(v) for v in values), lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 3)
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert {v: found.get(v, v) for v in want} == want


def test_a_dense_group_gives_a_forest():
    values = np.array([1 << i for i in range(60)] + [0], np.uint64)
    links = S._forest(np.sort(values), 3)
    assert len(links) == len(values) - 1


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(1000, i) for i in range(1001, 1100)] + [(5, 5), (None, 3), (7, None)]
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert found == {i: 1 for i in range(1, 61)} | {i: 1000 for i in range(1000, 1100)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_documents(documents, prose):
    base = prose("xx", 300, 1)
    words = base.split()
    texts = [base, base, base.upper(), " ".join(words[:-1] + ["other"]), prose("yy", 300, 2), None, "", " ", "one", prose("zz", 20_000, 3), words[0]]
    docs = documents([(10 + i, t) for i, t in enumerate(texts)] + [(None, "one"), (10, base)])
    rows = S.near_duplicates(docs).collect()
    assert len(rows) == len(texts) + 2
    prints = {10 + i: plain_print(t or "") for i, t in enumerate(texts)}
    want = parts_of(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    for row in rows:
        assert row.fingerprint == f"{prints[18 if row.doc_id is None else row.doc_id]:016x}"
        assert row.component_id == want[18 if row.doc_id is None else row.doc_id]


def test_one_row_of_each_component_stays(documents, prose):
    text = prose("xx", 200, 1)
    docs = documents([(3, text), (2, text), (2, text), (None, text), (None, prose("yy", 200, 2)), (9, None)])
    kept = S.keep_representatives(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 2), (False, 9), (True, 0)]
    assert S.keep_representatives(documents([])).count() == 0
    assert S.near_duplicates(documents([])).count() == 0
