import corpus_pipeline as P
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerline.llm import langid
from ledgerline.session import scratch_path


def corpus(prose):
    languages = ("xx", "yy", "zz")
    rows = [(i, prose(languages[i % 3], 120, i), languages[i % 3], f"s{i % 3}") for i in range(90)]
    near = rows[4][1].split()
    near[7] = "changed"
    junk = [(500, None, "xx", "s0"), (501, "12 34", "xx", "s1"), (502, "", None, None)]
    copies = [(600, rows[3][1], "xx", "s0"), (601, rows[3][1].replace(" ", "  "), "xx", "s0"), (602, " ".join(near), "yy", "s1")]
    odd = [(None, prose("xx", 90, 700), None, None), (3, rows[3][1], "xx", "s0")]
    return rows, rows + junk + copies + odd


def stage_by_stage(spark, docs, folder):
    kept = {}
    for name, stage in P.STAGES:
        done = stage(spark, docs, folder)
        path = scratch_path(spark, "t")
        done.write.parquet(path)
        if name != "bpe":
            assert done.columns == docs.columns
        docs = spark.read.schema(done.schema).parquet(path)
        kept[name] = docs.collect()
    return kept


def test_stages(spark, documents, prose, monkeypatch):
    monkeypatch.setattr(langid, "SEQUENCES", 300)
    clean, rows = corpus(prose)
    kept = stage_by_stage(spark, documents(rows), "")
    ids = {name: sorted((r.doc_id for r in found), key=lambda x: (x is None, x or 0)) for name, found in kept.items()}
    assert ids["language_id"] == sorted([r[0] for r in clean] + [3, 600, 601, 602]) + [None]
    assert ids["exact_dedup"] == sorted([r[0] for r in clean] + [602]) + [None]
    linked = (P.simhash.fingerprint(rows[4][1]) ^ P.simhash.fingerprint(dict((r[0], r[1]) for r in rows)[602])).bit_count() <= 3
    assert ids["near_dedup"] == sorted([r[0] for r in clean] + [602] * (not linked)) + [None]
    assert set(ids["source_mix"]) <= set(ids["near_dedup"]) and max(map(ids["source_mix"].count, ids["source_mix"])) <= 3
    library = Tokenizer.from_file(public_tokenizers.path(P.VOCABULARY))
    text = {r.doc_id: r.text for r in kept["source_mix"]}
    assert len(kept["bpe"]) == len(kept["source_mix"])
    assert all(r.n_tokens == len(library.encode(text[r.doc_id], add_special_tokens=False).ids) for r in kept["bpe"])


def test_empty_table(spark, documents):
    kept = stage_by_stage(spark, documents([]), "")
    assert set(map(len, kept.values())) == {0}


def test_run_reads_documents(spark, documents, prose, tmp_path, monkeypatch):
    monkeypatch.setattr(langid, "SEQUENCES", 300)
    documents(corpus(prose)[1]).write.parquet(str(tmp_path / "documents.parquet"))
    assert P.run(spark, str(tmp_path)).count() > 50


def test_mixed_short_and_unknown_texts_keep_their_place(spark, documents, prose, monkeypatch):
    monkeypatch.setattr(langid, "SEQUENCES", 300)
    clean, _ = corpus(prose)
    mixed = " ".join(prose(language, 40, 800) for language in ("xx", "yy", "zz"))
    odd = [(900, mixed, None, "s0"), (901, "ka pa", None, "s1"), (902, "中文 字", None, "s2"), (903, "12 34", None, "s0")]
    docs = documents(clean + odd)
    scores = {r.doc_id: r.score for r in langid.identify(docs, F.lit(True)).select("row.doc_id", "score").collect()}
    assert scores[900] < 0.4 and scores[902] < 0.4
    kept = P.keep_known_languages(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted([r[0] for r in clean] + [900, 901, 902])


def test_encoder_remembers_less_in_the_pipeline(prose):
    from ledgerline.llm import bpe

    packed = bpe.read_vocabulary(public_tokenizers.path(P.VOCABULARY))
    whole, small = bpe.encoder(packed), bpe.encoder(packed, 0.001)
    assert P.REMEMBER <= 0.25 and bpe.encoder(packed, 0.001) is small and small is not whole
    texts = [prose(language, 400, i) + f" x{i}" for i in range(30) for language in ("xx", "yy", "zz")]
    assert [small.encode(x) for x in texts] == [whole.encode(x) for x in texts]
    for name in ("words_seen", "fits", "first"):
        assert len(getattr(small, name)) + len(getattr(small, name).old) <= 2 * getattr(small, name).limit < 400
