"""Exact dedup as a stateful stream: digests in disk-backed keyed state, full bytes checked on hits."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.session import durable, scratch_path

#: Files that one micro-batch takes into the state.
FILES_PER_BATCH = 10_000
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # many small stores: no space is set aside for their logs
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    # what all stores of an executor hold in memory outside the heap; the rest is on disk
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
}
STATE = "digest {digest}, keep {id}, keep_file string, keep_place bigint, rows bigint"


def normalised(text: Column) -> Column:
    """Null as empty, every run of blank, tab, line feed, VT, FF and CR as one blank."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


@contextmanager
def _state_store(spark: SparkSession):
    """RocksDB as the state store of the streams that start inside."""
    old = {key: spark.conf.get(key, None) for key in STATE_STORE}
    for key, value in STATE_STORE.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in old.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def _first() -> Column:
    """The row with the smallest id, nulls last, then the first as stored."""
    return F.min(F.struct(F.col("id").isNull().alias("none"), "id", "file", "place")).alias("first")


def feed(stream: DataFrame, checkpoint: str) -> None:
    """Take a stream of (digest, id, file, place) into the keyed state under ``checkpoint``.

    The state holds per digest the smallest (id, file, place) and the number of rows, and never
    expires.  Calling it again with more files goes on with the same state.
    """
    state = stream.groupBy("digest").agg(_first(), F.count(F.lit(1)).alias("rows"))
    with _state_store(stream.sparkSession):
        query = state.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()


def state_table(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The state as a table: digest, keep (id), keep_file, keep_place, rows."""
    with _state_store(spark):
        state = spark.read.format("statestore").load(checkpoint)
    first = F.col("value.first") if "first" in state.schema["value"].dataType.names else F.col("value")[state.schema["value"].dataType.names[0]]
    rows = F.col("value")[state.schema["value"].dataType.names[-1]]
    return state.select(
        F.col("key.digest").alias("digest"),
        first["id"].alias("keep"),
        first["file"].alias("keep_file"),
        first["place"].alias("keep_place"),
        rows.alias("rows"),
    )


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: list[str] | None = None,
    digest: Callable[[Column], Column] = sha256,
    files_per_batch: int = FILES_PER_BATCH,
) -> DataFrame:
    """One row per document: row (a struct of ``carry``, by default the id), keep_id, group_size, kept, text_sha256.

    Texts are equal when their normalised forms are (see ``normalised``).  Of equal texts the row
    with the smallest id stays; null ids come last, and of repeated rows with one id the first
    one as stored stays, so exactly one row of every group is kept.

    The rows are written once to the shared folder; file and row number are a row's content locator.  A stream
    of the digests fills a state store on disk, which keeps digest, smallest id and locator
    for ever.  The texts of all digests that occur again are then compared whole: they are the same
    bytes if the smallest and the largest of them are, and each task reduces its copies of a text
    before they are sent on, so a hot text costs no more than others.  Should texts with one digest
    differ, the rows of that digest are grouped anew by the text itself.

    Null texts count as empty.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    carry = carry or [id_col]
    store, checkpoint, result = (scratch_path(spark, f"dedup-{name}") for name in ("store", "state", "table"))
    # a text that is carried is stored there only
    text = F.col("row")[text_col] if text_col in carry else F.col("text")
    docs.select(
        F.struct(*[F.col(f"`{name}`") for name in carry]).alias("row"),
        F.col(id_col).alias("id"),
        *([] if text_col in carry else [F.col(text_col).alias("text")]),
        digest(normalised(F.col(text_col))).alias("digest"),
    ).write.parquet(store)
    locator = [F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("place")]
    stored = spark.read.parquet(store)
    stream = spark.readStream.schema(stored.schema).option("maxFilesPerTrigger", files_per_batch).parquet(store)
    feed(stream.select("digest", "id", *locator), checkpoint)
    state_table(spark, checkpoint).write.parquet(result)
    state = spark.read.schema(STATE.format(id=stored.schema["id"].dataType.simpleString(), digest=stored.schema["digest"].dataType.simpleString())).parquet(result)

    rows = stored.select("row", "id", "digest", F.sha2(normalised(text), 256).alias("text_sha256") if digest is not sha256 else F.col("digest").alias("text_sha256"), *locator)
    judged = rows.join(state, "digest")
    is_first = (F.col("file") == F.col("keep_file")) & (F.col("place") == F.col("keep_place"))
    answer = ["row", F.col("keep").alias("keep_id"), F.col("rows").alias("group_size"), is_first.alias("kept"), "text_sha256"]
    clashes = _clashes(stored.select("digest", text.alias("text"), *locator), state)
    if clashes is None:
        return judged.select(*answer)
    mixed = stored.select("row", "id", "digest", normalised(text).alias("text"), *locator).join(clashes, "digest", "left_semi")
    own = mixed.groupBy("digest", "text").agg(_first(), F.count(F.lit(1)).alias("rows"))
    own = own.select("digest", "text", F.col("first.id").alias("keep"), F.col("first.file").alias("keep_file"), F.col("first.place").alias("keep_place"), "rows")
    apart = mixed.join(own, ["digest", "text"]).withColumn("text_sha256", F.sha2("text", 256))
    return judged.join(clashes, "digest", "left_anti").select(*answer).unionByName(apart.select(*answer))


def _clashes(texts: DataFrame, state: DataFrame) -> DataFrame | None:
    """Digests that stand for several texts, or None.

    Only texts whose digest occurs again are moved: a Bloom filter from the state, which the join is
    told to make at any input size, drops the others where they are read.
    """
    spark = texts.sparkSession
    filters = {"spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0"}
    old = {key: spark.conf.get(key) for key in filters}
    for key, value in filters.items():
        spark.conf.set(key, value)
    try:
        hits = texts.join(state.where(F.col("rows") > 1).select("digest"), "digest")
        part = F.concat_ws("-", F.col("digest"), F.pmod(F.xxhash64("file", "place"), F.lit(64)))
        text = normalised(F.col("text"))
        parts = hits.groupBy(part.alias("part")).agg(F.min("digest").alias("digest"), F.min(text).alias("low"), F.max(text).alias("high"))
        groups = parts.groupBy("digest").agg(F.min("low").alias("low"), F.max("high").alias("high"))
        found = durable(groups.where(F.col("low") != F.col("high")).select("digest"))
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)
    return None if found.isEmpty() else found


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, all columns."""
    return exact_dedup(docs, carry=docs.columns, **options).where("kept").select("row.*")
