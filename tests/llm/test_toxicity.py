import numpy as np
from pyspark.sql import functions as F

from ledgerline.llm import toxicity as T

GRAMMAR = T.Grammar({"=clod": 5.0, "lowe": 3.0, "=lowest": 4.0})


def kinds(text):
    return [(k, w) for _, _, k, w in GRAMMAR.matches(text)]


def test_clauses():
    assert kinds("plain words. nothing here") == []
    assert kinds("What a CLOD!") == [("insult", 5.0)]
    assert kinds("you are a clod") == kinds("a clod, you see? A clod you are")[1:] == [("targeted", 5.0)]
    assert kinds("not a clod") == [("negated", 5.0)]
    assert kinds("not in any way ever a clod") == [("insult", 5.0)]
    assert kinds("never, clod") == [("insult", 5.0)]
    assert kinds('they said clod') == [("reported", 5.0)]
    assert kinds('a "clod" here') == [("reported", 5.0)]
    assert kinds("loweish lowest lowe") == [("insult", 3.0), ("insult", 4.0)]
    assert kinds("I will kill you") == [("threat", 1.0)]
    assert kinds("kill time") == kinds("I will not kill you") == kinds("he said kill you") == []


def test_match_places():
    text = "fine. a clod here! fine"
    ((begin, end, _, _),) = GRAMMAR.matches(text)
    assert text[begin:end] == " a clod here!"


def test_weights_follow_labels():
    rows = np.array([[2.0, 0, 0, 0, 0, 0]] * 50 + [[0.0] * 6] * 200)
    toxic = np.array([1.0] * 50 + [0.0] * 200)
    weights = T.fit_weights(rows, toxic, np.ones(250))
    chance = 1 / (1 + np.exp(-(weights[0] + rows @ weights[1:])))
    assert chance[:50].min() > 0.9 and chance[50:].max() < 0.05
    assert np.allclose(weights[3:6], T.PRIOR[3:6])


def corpus(prose):
    rows, labels = [], []
    for i in range(400):
        words = prose("xx", 60, i).split()
        if bad := i % 4 == 0:
            words[10:10] = ["brakno" + "aeiou"[i // 4 % 5]]
            words[40:40] = ["glumph"]
        rows.append((i, " ".join(words) + "."))
        labels.append((i, int(bad)))
    return rows, labels


def test_held_out_texts(spark, documents, prose):
    rows, labels = corpus(prose)
    odd = [(1000, None), (1001, ""), (1002, "glumph"), (1003, "braknox is here"), (1004, prose("xx", 100_000, 7)), (None, "glumph"), (1002, "glumph")]
    marks = spark.createDataFrame([(*x, 0) for x in labels] + [(3, None, 0), (None, 1, 0), (8, 0, 0)], "doc_id bigint, toxic int, score int")
    found = T.score(documents(rows + odd), marks, F.coalesce(F.col("doc_id") % 5 != 1, F.lit(False))).collect()
    assert len(found) == len(rows) + len(odd)
    truth = dict(labels)
    for row in found:
        assert 0 <= row.score <= 1
        if row.doc_id is not None and row.doc_id < 1000:
            assert (row.score >= 0.3) == bool(truth[row.doc_id])
    rest = {r.doc_id: r for r in found if r.doc_id is None or r.doc_id >= 1000}
    assert rest[1000].score == rest[1001].score == rest[1004].score < 0.3
    assert rest[None].score == rest[1002].score >= 0.3 and rest[1003].score >= 0.3
    assert rest[1002].matches[0].kind == "insult"


def test_without_labels(spark, documents):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    found = T.score(documents([(1, "I will kill you"), (2, "hello"), (3, None)]), none, F.lit(True)).collect()
    scores = {r.doc_id: r.score for r in found}
    assert scores[1] > scores[2] == scores[3]
    assert T.score(documents([]), none, F.lit(True)).count() == 0


def test_copies_do_not_make_words_telling(spark, documents, prose):
    rows, labels = corpus(prose)
    copied = prose("yy", 80, 1)
    rows += [(5000 + i, copied) for i in range(100)]
    labels += [(5000 + i, 1) for i in range(100)]
    marks = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    sample, _ = T.labelled_sample(documents(rows), marks, F.lit(True), "doc_id", "text")
    lexicon = T.learn_lexicon(sample)
    assert "=glumph" in lexicon and "brak" in lexicon
    assert not any(w.lower() in copied.split() for w in (k[1:] for k in lexicon if k[0] == "="))
