"""Mixing sources to target weights by systematic sampling; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.session import durable

#: No source is repeated more often than this on average, and no document more often than this.
MAX_REPEATS = 3
#: Documents of one source that are ranked together; a larger source is ranked in that many more parts.
PART_ROWS = 4_000
#: Up to so many sources their table is broadcast; beyond, every source's row is copied SPREAD times and met by a salted join.
BROADCAST_SOURCES = 50_000
SPREAD = 64
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of runs of characters other than blank, tab, line feed, VT, FF, CR; null counts none."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]*" + WORD, "w")
    return F.char_length(F.regexp_replace(marked, r"[\x20\x09-\x0D]", "")).cast("bigint")


def _sums_before(rows: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """``rows`` with the sums over all rows that come before in ``order``, which has no ties.

    Rows are sorted over all partitions; a sum is that of the partitions before and of the rows before in the own one.
    """
    placed = durable(
        rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_pid": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    )
    pieces = placed.groupBy("_pid").agg(*[F.sum(value).alias(f"_{name}") for name, value in sums.items()])
    upto = lambda window: window.rowsBetween(Window.unboundedPreceding, -1)
    earlier, own = upto(Window.orderBy("_pid")), upto(Window.partitionBy("_pid").orderBy("_at"))
    starts = pieces.select("_pid", *[F.coalesce(F.sum(f"_{name}").over(earlier), F.lit(0)).alias(f"_{name}") for name in sums])
    known = placed.join(F.broadcast(starts), "_pid")
    known = known.withColumns({name: F.col(f"_{name}") + F.coalesce(F.sum(value).over(own), F.lit(0)) for name, value in sums.items()})
    return known.drop("_pid", "_at", *[f"_{name}" for name in sums])


def source_targets(sizes: DataFrame, weights: list[float], max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, source_rows, target) from one row per source.

    Sources by code point, null last, take the weights in turn and share the size of all.  A
    target stops at ``max_repeats`` times its source's size; what is cut goes to the others by
    weight.  In order of cap over weight the capped sources come first, and running sums tell
    where they end, so no round of resharing is needed.  The table has one row per source and
    is sorted over many tasks.
    """
    rows = _sums_before(sizes, [F.col("source").asc_nulls_last()], place=F.lit(1))
    turn = F.array(*[F.lit(float(w)) for w in weights])
    rows = rows.withColumn("weight", F.element_at(turn, (F.pmod("place", F.lit(len(weights))) + 1).cast("int")))
    rows = rows.withColumn("cap", F.col("source_size") * float(max_repeats))
    rows = _sums_before(rows, [F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()], full=F.col("cap"), closed=F.col("weight"))
    whole = rows.agg(F.sum(F.col("source_size").cast("double")).alias("total"), F.sum("weight").alias("weights"))
    open_from = F.col("weights") - F.col("closed")
    capped = F.col("cap") * open_from <= F.col("weight") * (F.col("total") - F.col("full"))
    rows = rows.crossJoin(F.broadcast(whole)).withColumn("capped", capped)
    rest = rows.agg(
        F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(F.lit(0.0))).alias("given"),
        F.sum(F.when(F.col("capped"), F.lit(0.0)).otherwise(F.col("weight"))).alias("left"),
    )
    rows = rows.crossJoin(F.broadcast(rest))
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * (F.col("total") - F.col("given")) / F.col("left"))
    return rows.select("source", "source_size", "source_rows", target.alias("target"))


def _digest_number(value: Column) -> Column:
    """The first eight hex digits of a text's MD5 as a number."""
    return F.conv(F.substring(F.md5(value), 1, 8), 16, 10).cast("bigint")


def _key(source: Column) -> Column:
    """A source as a text that is never null, so that plain equality joins serve."""
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), source.cast("string")))


def copies_per_document(
    docs: DataFrame,
    weights: list[float],
    seed: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    max_repeats: int = MAX_REPEATS,
    part_rows: int = PART_ROWS,
    carry: list[str] | None = None,
) -> DataFrame:
    """How often each document is taken: row (a struct of ``carry``, by default the id), size, source_size, target, copies.

    Every document of a source expects target / source size copies.  The expected copies are
    summed along the source, one offset per source, drawn from the seed, is added, and a
    document is taken once per whole number its span crosses: never more than ``max_repeats`` times.

    The order is free, so it is chosen to keep the words near the target: by size, with every other
    run between two crossings reversed, so that what one run takes too much the next takes too
    little.  A source is cut by the digest of the id into parts of about ``part_rows``, ranked each
    by itself, and the parts' row counts give the sums to start from.  A hot source is so spread
    over many tasks.  Unless the text itself is carried, it is read once: the sizes are then kept in
    the shared folder.

    Null texts have size 0, a null id is replaced by the text's digest, null sources form a source of their own, a source of size 0 is taken no
    times.  Repeated rows are documents of their own.  An empty table gives an empty one.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights have to be positive")
    carry = carry or [id_col]
    sized = docs.select(
        F.struct(*[F.col(f"`{name}`") for name in carry]).alias("row"),
        F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text "), F.md5(F.col(text_col))), F.lit("")).alias("id"),
        F.col(source_col).cast("string").alias("source"),
        _key(F.col(source_col)).alias("source_key"),
        word_count(F.col(text_col)).alias("size"),
    )
    if text_col not in carry:
        sized = durable(sized)
    sources = durable(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows")))
    targets = source_targets(sources, weights, max_repeats).withColumn("source_key", _key(F.col("source"))).drop("source")
    if sources.count() <= BROADCAST_SOURCES:
        known = sized.join(F.broadcast(targets), "source_key")
    else:
        copied = targets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
        salted = sized.withColumn("salt", F.pmod(_digest_number(F.col("id")), F.lit(SPREAD)).cast("int"))
        known = salted.join(copied, ["source_key", "salt"]).drop("salt")
    parted = (
        known
        .withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
        .withColumn("part", F.pmod(_digest_number(F.col("id")), F.ceil(F.col("source_rows") / part_rows)))
    )
    own = Window.partitionBy("source_key", "part")
    ranked = parted.withColumn("place", F.row_number().over(own.orderBy(F.col("size").desc(), F.md5("id"), "id")) - 1)
    ranked = ranked.withColumn("run", F.floor(F.col("place") * (F.col("rate") - F.floor("rate"))))
    turned = own.orderBy("run", F.when(F.col("run") % 2 == 1, -F.col("place")).otherwise(F.col("place")))
    ranked = ranked.withColumn("place", F.row_number().over(turned))
    starts = (
        parted.groupBy("source_key", "part")
        .agg(F.count(F.lit(1)).alias("rows"))
        .withColumn("start", F.sum("rows").over(Window.partitionBy("source_key").orderBy("part")) - F.col("rows"))
        .drop("rows")
    )
    offset = _digest_number(F.concat(F.lit(f"{seed}:"), "source_key")) / F.lit(float(1 << 32))
    upto = lambda rank: F.floor(rank * F.col("rate") + offset)
    rank = F.col("start") + F.col("place")
    placed = ranked.join(starts, ["source_key", "part"])
    return placed.select("row", "size", "source_size", "target", (upto(rank) - upto(rank - 1)).cast("int").alias("copies"))


def mix(docs: DataFrame, weights: list[float], **options) -> DataFrame:
    """The mixed documents: every row of ``docs``, all columns, as often as it is taken (see ``copies_per_document``)."""
    taken = copies_per_document(docs, weights, carry=docs.columns, **options)
    return taken.where(F.col("copies") > 0).select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
