import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import langid as L


@pytest.fixture(scope="module")
def model():
    draw = np.random.default_rng(1)
    words = ["ab", "cd", "ef", "gh"]
    rows = {f: i for i, f in enumerate(sorted({f for w in words for f in L.features(w)}))}
    return L.Model(["p", "q", "r"], rows, draw.normal(size=(len(rows), 3)), draw.normal(size=(3, 3)), draw.normal(size=3)), words


def by_enumeration(model, words):
    scores = model.scores(words)
    total, sums = 0.0, np.zeros((len(words), 3))
    for path in itertools.product(range(3), repeat=len(words)):
        weight = math.exp(model.start[path[0]] + sum(scores[t, k] for t, k in enumerate(path)) + sum(model.move[a, b] for a, b in itertools.pairwise(path)))
        total += weight
        for t, k in enumerate(path):
            sums[t, k] += weight
    return sums / total


@pytest.mark.parametrize("block, blocks", [(128, 4096), (3, 2), (1, 1)])
def test_marginals_equal_enumeration(model, monkeypatch, block, blocks):
    monkeypatch.setattr(L, "BLOCK", block)
    monkeypatch.setattr(L, "BLOCKS", blocks)
    crf, words = model
    draw = np.random.default_rng(2)
    texts = [list(draw.choice(words, size=n)) for n in (1, 7, 2, 5, 1, 1, 6)]
    flat = [w for t in texts for w in t]
    first = np.zeros(len(flat), bool)
    first[np.cumsum([0, *map(len, texts[:-1])])] = True
    got = np.vstack([m for _, _, m in L.Chain(crf).marginals(L._positive(crf.scores(words)), np.array([words.index(w) for w in flat], np.int32), first)])
    assert np.allclose(got, np.vstack([by_enumeration(crf, t) for t in texts]), atol=1e-9)


def test_features():
    assert L.features(L.core("...")) == [] and L.features(L.core("12")) == []
    assert L.features(L.core("A-b,")) == ["^a", "ab", "b$", "^ab", "ab$", "^ab$", "^ab$", "=ab"]


def held_out(rows):
    return [r for r in rows if r.doc_id is not None and r.doc_id >= 1000]


def test_held_out_texts_and_code_switching(documents, prose, monkeypatch):
    monkeypatch.setattr(L, "SEQUENCES", 300)
    languages = ("xx", "yy", "zz")
    rows = [(i, prose(languages[i % 3], 60, i), languages[i % 3], "s") for i in range(90)]
    rows += [(1000 + i, prose(languages[i % 3], 40, 500 + i), languages[(i + 1) % 3], "s") for i in range(30)]
    rows += [(2000, prose("xx", 30, 1) + " " + prose("yy", 50, 2)), (3000, None), (3001, ""), (3002, "12 34 !!"), (3003, "中文 字"), (3004, prose("zz", 50_000, 9)), (None, "ka to mi", "xx"), (5, rows[5][1], "zz", "s")]
    docs = documents(rows)
    found = L.identify(docs, F.coalesce(F.col("doc_id") < 1000, F.lit(False)), carry=["doc_id"]).select("row.doc_id", "lang_pred", "score", "runs").collect()
    assert len(found) == len(rows)
    got = {r.doc_id: r for r in found}
    assert all(got[1000 + i].lang_pred == languages[i % 3] for i in range(30))
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and got[i].runs == [] for i in (3000, 3001, 3002))
    assert got[3003].lang_pred in languages and got[3004].lang_pred == "zz" and sum(r.words for r in got[3004].runs) == 50_000
    mixed = got[2000]
    assert mixed.lang_pred == "yy" and 0.5 < mixed.score < 0.75
    assert abs(mixed.runs[0].words - 30) <= 3 and mixed.runs[0].lang == "xx" and sum(r.words for r in mixed.runs) == 80
    assert all(0 <= r.score <= 1 for r in found)


def test_nothing_to_learn_and_empty(documents):
    docs = documents([(1, "some words", None, "s"), (2, None, "en", "s")])
    assert {(r.lang_pred, r.score) for r in L.identify(docs, F.lit(True)).collect()} == {("und", 0.0)}
    assert L.identify(documents([]), F.lit(True)).count() == 0


def test_every_language_is_a_label(documents, prose, monkeypatch):
    monkeypatch.setattr(L, "SEQUENCES", 300)
    monkeypatch.setattr(L, "LANGUAGES", 2)
    rows = [(i, prose("xx" if i % 2 else "yy", 60, i), "xx" if i % 2 else "yy", "s") for i in range(60)]
    rows += [(100 + i, prose("zz", 60, i), "zz", "s") for i in range(8)]
    docs = documents(rows + [(1000 + i, prose("zz", 40, 500 + i), None, "s") for i in range(5)])
    found = L.identify(docs, F.lit(True)).select("row.doc_id", "lang_pred").collect()
    assert {r.lang_pred for r in found if r.doc_id >= 100} == {"zz"}
    # a sample that misses a language takes one text of it
    few = L.training_sample(docs, F.lit(True), "doc_id", "text", "lang", rows=0)
    assert sorted(lang for lang, _ in few) == ["xx", "yy", "zz"] and all(len(words) == 60 for _, words in few)


def test_many_labels_in_small_steps(documents, monkeypatch):
    names = [f"l{i:03d}" for i in range(130)]
    words = {name: " ".join(chr(0x4E00 + 40 * i) + chr(0x4E01 + 40 * i) + chr(0x4E02 + 40 * i + k) for k in range(5)) for i, name in enumerate(names)}
    docs = documents([(i, " ".join([words[name]] * 6), name, "s") for i, name in enumerate(names)])
    samples = L.training_sample(docs, F.lit(True), "doc_id", "text", "lang")
    assert sorted(lang for lang, _ in samples) == names
    monkeypatch.setattr(L, "STEPS", 10)
    monkeypatch.setattr(L, "SEQUENCES", 200)
    whole = L.fit(samples)
    assert whole.labels == names
    texts = [" ".join([words[name]] * 4) for name in names]
    found = [x[:2] for x in L.Labeller(whole).label(texts)]
    assert [lang for lang, _ in found] == names
    monkeypatch.setattr(L, "CELLS", 130 * 130 * 2)
    assert np.allclose(L.fit(samples).weights, whole.weights)
    again = [x[:2] for x in L.Labeller(whole).label(texts)]
    assert [lang for lang, _ in again] == names and np.allclose([x for _, x in again], [x for _, x in found])


def test_a_column_named_as_a_placeholder(spark, documents, prose, monkeypatch):
    monkeypatch.setattr(L, "SEQUENCES", 100)
    docs = documents([(i, prose(["xx", "yy"][i % 2], 60, i), ["xx", "yy"][i % 2], "s") for i in range(20)]).withColumns({"_": F.lit(7), "row": F.lit("r"), "col1": F.lit(1)})
    found = L.identify(docs, F.lit(True), carry=docs.columns)
    assert {(r.row["_"], r.row["row"], r.lang_pred == r.row.lang) for r in found.collect()} == {(7, "r", True)}
    assert L.identify(docs, F.lit(True), carry=["text"]).count() == 20
