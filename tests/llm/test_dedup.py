import hashlib
import re

from pyspark.sql import functions as F

from ledgerline.llm import exactdedup as D


def plain(text):
    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


TEXTS = ["a b", "a  b", "a\t\nb", " a b", "a b ", "", None, " ", "\n\n", "a\x0bb", "a\x1cb", "é", "é", "x " * 50_000, "x " * 50_000 + " ", "A b"]


def expected(rows):
    groups = {}
    for number, (doc_id, text) in enumerate(rows):
        groups.setdefault(plain(text), []).append((doc_id is None, doc_id or 0, doc_id))
    return {text: (min(ids)[2], len(ids)) for text, ids in groups.items()}


def check(found, rows):
    want = expected(rows)
    assert len(found) == len(rows)
    texts = {}
    for doc_id, text in rows:
        texts.setdefault(doc_id, set()).add(plain(text))
    kept = {}
    for row in found:
        own = [t for t in texts[row.row.doc_id] if hashlib.sha256(t.encode()).hexdigest() == row.text_sha256]
        assert len(own) == 1
        assert (row.keep_id, row.group_size) == want[own[0]]
        kept[own[0]] = kept.get(own[0], 0) + row.kept
    assert set(kept.values()) == {1}


def test_groups(documents):
    rows = [(20 - i, t) for i, t in enumerate(TEXTS)] + [(None, "a b"), (None, "alone"), (3, "twice"), (3, "twice")]
    check(D.exact_dedup(documents(rows)).collect(), rows)


def test_texts_with_one_digest_are_told_apart(documents):
    rows = [(i, f"text {i % 4}") for i in range(40)] + [(100, None), (101, "")]
    weak = lambda text: F.lit("same").substr(F.lit(1), F.when(text == "", 1).otherwise(F.lit(4)))
    check(D.exact_dedup(documents(rows), digest=weak).collect(), rows)


def test_state_goes_on_with_later_files(spark, tmp_path):
    store, state = str(tmp_path / "store"), str(tmp_path / "state")
    row = "id bigint, digest string, file string, place bigint"
    schema = spark.createDataFrame([], row).schema
    for rows in ([(7, "x", "f", 0), (8, "y", "f", 1)], [(3, "x", "g", 0), (9, "z", "g", 1)]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(store)
        D.feed(spark.readStream.schema(schema).parquet(store), state)
    found = {r.digest: (r.keep, r.keep_file, r.rows) for r in D.state_table(spark, state).collect()}
    assert found == {"x": (3, "g", 2), "y": (8, "f", 1), "z": (9, "g", 1)}


def test_kept_rows_and_empty_table(documents):
    docs = documents([(2, "a"), (1, "a"), (1, "a"), (None, None)])
    kept = D.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "None"]
    assert D.exact_dedup(documents([])).count() == 0


def test_a_carried_text_is_stored_once(spark, documents, tmp_path, monkeypatch):
    made = {}
    monkeypatch.setattr(D, "scratch_path", lambda spark, name: made.setdefault(name, str(tmp_path / name)))
    docs = documents([(1, "a  b"), (2, "a b"), (3, None), (4, "")])
    assert sorted(r.doc_id for r in D.keep_first(docs).collect()) == [1, 3]
    assert spark.read.parquet(made["dedup-store"]).columns == ["row", "id", "digest"]


def test_carried_texts_with_one_digest_are_told_apart(documents):
    rows = [(i, f"text {i % 4}") for i in range(40)] + [(100, None), (101, ""), (102, "text  1")]
    weak = lambda text: F.lit("same").substr(F.lit(1), F.when(text == "", 1).otherwise(F.lit(4)))
    docs = documents(rows)
    check(D.exact_dedup(docs, carry=docs.columns, digest=weak).collect(), rows)
