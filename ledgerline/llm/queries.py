"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import bpe, chat, exactdedup, hardneg, langid, maxscore, mixing, packing, simhash, spelling, tokencount, toxicity, urlfilter
from ledgerline.plans.registry import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
TOKEN_LIMIT = 4096
MIX_WEIGHTS = [5, 2, 1]
MIX_SEED = 42
SEQUENCE_TOKENS = 2048
NEGATIVE_FACTOR = 256
DROP_MODULUS = 97
CHAT_PROBE = "</s>[INST] ok [/INST]"


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query(
    "op2_url_filter",
    r"""WITH parts AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
rules(action, rhost, rpath) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
judged AS (
  SELECT p.*, (SELECT max_by({'rule': rhost || rpath, 'action': action}, length(rhost || rpath)) FROM rules
    WHERE (p.host = rhost OR ends_with(p.host, '.' || rhost)) AND starts_with(p.path, rpath)) AS best,
    (SELECT count(*) FROM rules WHERE (p.host = rhost OR ends_with(p.host, '.' || rhost)) AND starts_with(p.path, rpath)) AS n_rules
  FROM parts p)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.action, 'allow') AS verdict, n_rules FROM judged""",
)
def op2_url_filter(t):
    return urlfilter.judge_urls(t.pages, urlfilter.rule_table(t.spark, URL_RULES))


@query(
    "op3_source_mix",
    rf"""WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, coalesce('=' || source, '-') AS source_key FROM documents),
sources AS (
  SELECT source_key, sum(size)::BIGINT AS source_size, count(*) AS source_rows,
    [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY min(source) NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM sized GROUP BY source_key),
filled AS (
  SELECT *, 3.0 * source_size::DOUBLE AS cap, sum(source_size::DOUBLE) OVER () AS total,
    coalesce(sum(3.0 * source_size::DOUBLE) OVER (ORDER BY 3.0 * source_size::DOUBLE / weight, source_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
    sum(weight) OVER (ORDER BY 3.0 * source_size::DOUBLE / weight, source_key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_from FROM sources),
marked AS (SELECT *, cap * open_from <= weight * (total - full_before) AS capped FROM filled),
targets AS (
  SELECT source_key, source_size, source_rows, CASE WHEN capped THEN cap ELSE weight * (total - sum(CASE WHEN capped THEN cap ELSE 0.0::DOUBLE END) OVER ()) / sum(CASE WHEN capped THEN 0.0::DOUBLE ELSE weight END) OVER () END AS target FROM marked),
rated AS (
  SELECT s.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate, ('0x' || md5(doc_id::VARCHAR)[:8])::BIGINT % ceil(source_rows / {mixing.PART_ROWS})::BIGINT AS part
  FROM sized s JOIN targets USING (source_key)),
placed AS (SELECT *, row_number() OVER (PARTITION BY source_key, part ORDER BY size DESC, md5(doc_id::VARCHAR), doc_id::VARCHAR) - 1 AS place FROM rated),
runs AS (SELECT *, floor(place * (rate - floor(rate))) AS run FROM placed),
turned AS (SELECT *, row_number() OVER (PARTITION BY source_key, part ORDER BY run, CASE WHEN run % 2 = 1 THEN -place ELSE place END) AS spot FROM runs),
starts AS (SELECT source_key, part, sum(count(*)) OVER (PARTITION BY source_key ORDER BY part) - count(*) AS start FROM rated GROUP BY source_key, part),
ranked AS (SELECT *, (start + spot)::DOUBLE AS rank, ('0x' || md5('{MIX_SEED}:' || source_key)[:8])::BIGINT / 4294967296.0::DOUBLE AS shift FROM turned JOIN starts USING (source_key, part))
SELECT doc_id, size, source_size, target, (size * (floor(rank * rate + shift) - floor((rank - 1) * rate + shift)))::BIGINT AS taken FROM ranked""",
)
def op3_source_mix(t):
    taken = mixing.copies_per_document(t.documents, MIX_WEIGHTS, MIX_SEED)
    return taken.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query(
    "op5_exact_dedup",
    r"""WITH hashed AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = min(doc_id) OVER same AS kept, text_sha256
FROM hashed WINDOW same AS (PARTITION BY text_sha256)""",
)
def op5_exact_dedup(t):
    return exactdedup.exact_dedup(t.documents).select("row.doc_id", "keep_id", "group_size", "kept", "text_sha256")


def _escaped_length(column: str) -> str:
    """SQL: the length of a text once escaped for the default template."""
    text = f"replace({column}, '\\', '\\\\')"
    for control in chat.Template().controls:
        text = f"replace({text}, '{control}', '{control[0]}\\{control[1:]}')"
    return f"length({text})"


_TEMPLATE = chat.Template()


@query(
    "op6_chat_format",
    f"""WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{CHAT_PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{CHAT_PROBE}'),
steps AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before, lead(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS NULL AS is_last FROM rows),
judged AS (SELECT *, coalesce(before, 'start') || ' ' || role IN ('start system', 'start user', 'system user', 'user assistant', 'assistant user') AS fits FROM steps)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum({len(_TEMPLATE.open + _TEMPLATE.sep + _TEMPLATE.close)} + {_escaped_length('role')} + {_escaped_length('text')})::BIGINT AS formatted_chars,
  bool_and(fits) AND bool_or(is_last AND role = 'assistant') AS valid, (count(*) FILTER (WHERE NOT fits))::BIGINT AS bad_turns
FROM judged GROUP BY conv_id""",
)
def op6_chat_format(t):
    rows = t.conversations.select("conv_id", "turn", "role", "text")
    kinds = dict(rows.dtypes)
    probe = t.spark.range(2).select(
        F.lit(-1).cast(kinds["conv_id"]).alias("conv_id"),
        F.col("id").cast(kinds["turn"]).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CHAT_PROBE).alias("text"),
    )
    done = chat.format_turns(rows.unionByName(probe))
    line = lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))
    return done.withColumn("loss", chat.loss_text(F.col("segments"))).select(
        "conv_id",
        F.size(chat.read_turns(F.col("formatted"))).cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(F.transform(chat.read_turns(F.col("formatted")), line), ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
        "valid",
        "bad_turns",
    )


@query("op1_token_counts")
def op1_token_counts(t):
    counts = tokencount.count_tokens(t.documents, public_tokenizers.path("piece_bpe_32k.model"))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


@query("op9_bpe_round_trip")
def op9_bpe_round_trip(t):
    return bpe.round_trip(t.documents, public_tokenizers.path("byte_bpe_50k.json"), outputs=["n_tokens", "ids_sha256", "decoded_sha256"])


@query("op4_simhash")
def op4_simhash(t):
    return simhash.near_duplicates(t.documents)


def bucket(column: str, buckets: int):
    """Remainder of the CRC32 of a column as text."""
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(buckets))


@query("op8_language_id")
def op8_language_id(t):
    held_out = F.coalesce(bucket("doc_id", 3) == 1, F.lit(False))
    found = langid.identify(t.documents, ~held_out)
    return found.select("row.doc_id", "lang_pred", "score").select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query(
    "op10_topk_search",
    """WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS vector FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.vector, c.vector)::BIGINT AS score
  FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10""",
)
def op10_topk_search(t):
    vectors = t.embeddings.select("vec_id", maxscore.integer_vector(F.col("embedding")).alias("vector"))
    return maxscore.search(vectors, vectors.where(F.col("vec_id") % 100 == 0))


@query("op7_toxicity")
def op7_toxicity(t):
    held_out = F.coalesce(bucket("doc_id", 4) == 2, F.lit(False))
    found = toxicity.score(t.documents, t.labels, ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op11_best_fit_packing")
def op11_best_fit_packing(t):
    return packing.pack_documents(t.documents, public_tokenizers.path("word_bpe_49k.json"), limit=SEQUENCE_TOKENS)


@query(
    "op12_hard_negatives",
    """WITH sound AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vector FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS vec_id, a.label = c.label AS same, list_inner_product(a.vector, c.vector)::BIGINT AS score
  FROM sound a JOIN sound c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY n.score DESC, n.vec_id)::INT AS rank, n.vec_id AS negative_id, positive_score, n.score AS negative_score
FROM positives JOIN scored n USING (anchor_id) WHERE NOT n.same AND 30 * positive_score <= 100 * n.score AND 100 * n.score <= 90 * positive_score
QUALIFY rank <= 10""",
)
def op12_hard_negatives(t):
    label = F.col("label").cast("bigint")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = t.embeddings.select("vec_id", moved.alias("label"), hardneg.whole_vector(F.col("embedding"), NEGATIVE_FACTOR).alias("vector"))
    return hardneg.mine(rows, rows.where(F.col("vec_id") % 100 == 0))


@query("op13_spelling_variants")
def op13_spelling_variants(t):
    return spelling.spelling_variants(t.documents, partial(spelling.drop_letter, modulus=DROP_MODULUS))
