"""SimHash near-duplicates: fingerprints, covering masks that meet every close pair, components."""

from __future__ import annotations

from functools import partial
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.components import components
from ledgerline.llm.workers import map_batches, ship_code
from ledgerline.session import durable, scratch_path

BITS = 64
#: Fingerprints that one bucket may hold before it is split by more bits.
BUCKET_ROWS = 4_096
#: Shingles whose digests are counted at a time.
BLOCK = 65_536

_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8).reshape(-1, 1), axis=1).astype(np.int64)
_BYTE_PLACE = (256 * np.arange(8)).reshape(1, 8)


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """The SimHash of a text: a bit is set if it is in over half of its shingles' XXH64 digests.

    A-Z are lower-cased, words are cut at blank, tab, line feed, VT, FF and CR, repeated shingles
    count each time.  A text with fewer words is one shingle, one without words has fingerprint zero.
    """
    found = text.encode().lower().split()
    if not found:
        return 0
    if len(found) <= words:
        shingles, total = iter([b" ".join(found)]), 1
    else:
        shingles, total = map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False)), len(found) - words + 1
    digests = map(partial(xxhash.xxh64_digest, seed=seed), shingles)
    counts = np.zeros(2048, np.int64)
    while block := b"".join(islice(digests, BLOCK)):
        counts += np.bincount((np.frombuffer(block, np.uint8).reshape(-1, 8) + _BYTE_PLACE).ravel(), minlength=2048)
    set_in = np.stack([counts[256 * i : 256 * i + 256] @ _BYTE_BITS for i in range(8)]).ravel()
    return int.from_bytes(np.packbits(2 * set_in > total).tobytes(), "big")


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def covering_masks(radius: int) -> list[int]:
    """2 ** (radius + 1) - 1 masks; any two fingerprints within ``radius`` agree under one of them.

    Bit i is given the vector v(i) of radius + 1 bits, and mask m keeps the bits whose v(i) has an odd
    number of bits in common with m.  At most ``radius`` vectors of differing bits leave some m but zero that is
    orthogonal to all of them, so the table of that m does not see the difference.
    """
    vectors = [i % ((1 << (radius + 1)) - 1) + 1 for i in range(BITS)]
    return [sum(1 << i for i, v in enumerate(vectors) if (v & m).bit_count() % 2) for m in range(1, 1 << (radius + 1))]


def finer_masks(mask: int, radius: int) -> list[int]:
    """radius + 1 masks that keep more bits: pairs that agree under ``mask`` agree under one of them."""
    free = [i for i in range(BITS) if not mask >> i & 1]
    return [mask | sum(1 << i for i in free[part :: radius + 1]) for part in range(radius + 1)]


def _forest(group: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links of one bucket that connect what is connected, one for each member but the first of a part."""
    left, links = group, []
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            at = front.pop()
            near = np.bitwise_count(left ^ at) <= radius
            if near.any():
                met = left[near]
                links += [(int(at), int(x)) for x in met]
                front += list(met)
                left = left[~near]
    return links


def _bucket_links(batches, radius: int):
    """Links of buckets that come sorted by (mask, key); a bucket that a batch ends in is carried over."""
    rest = np.empty((0, 3), np.int64)

    def links(rows: np.ndarray) -> pa.RecordBatch:
        borders = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1
        starts = np.concatenate([[0], borders]).astype(np.int64)
        sizes = np.diff(np.concatenate([starts, [len(rows)]]))
        two = starts[sizes == 2]
        a, b = rows[two, 2], rows[two + 1, 2]
        near = np.bitwise_count((a ^ b).view(np.uint64)) <= radius
        pairs = [np.stack([a[near], b[near]], axis=1)]
        for start, size in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
            if found := _forest(rows[start : start + size, 2].copy().view(np.uint64), radius):
                pairs.append(np.array(found, np.uint64).view(np.int64))
        done = np.concatenate(pairs)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(done[:, 0])), pa.array(np.ascontiguousarray(done[:, 1]))], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.concatenate([rest, np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)])
        last = rows[-1, :2]
        whole = int(np.searchsorted((rows[::-1, :2] != last).any(axis=1), True)) if len(rows) else 0
        cut = len(rows) - whole
        rest = rows[cut:]
        if cut:
            yield links(rows[:cut])
    if len(rest):
        yield links(rest)


def close_links(prints: DataFrame, radius: int = 3, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column ``fp``) that connect all that are within ``radius`` bits.

    Every fingerprint goes to one bucket per covering mask.  A bucket gives a spanning forest of its
    links, not all pairs.  One with over ``bucket_rows`` fingerprints is split instead by finer masks, under one of
    which each of its close pairs agrees again; as fingerprints are distinct, a mask that leaves n bits free
    has 2 ** n in a bucket at most, so the splitting ends.
    """
    ship_code(prints.sparkSession)
    masks = covering_masks(radius)
    deal = lambda rows, column: rows.select("fp", F.explode(column).alias("mask")).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
    buckets = deal(prints, F.array(*[F.lit(_signed(m)) for m in masks]))
    links = None
    while True:
        sizes = buckets.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("rows"))
        crowded = durable(sizes.where(F.col("rows") > bucket_rows).select("mask", "key"))
        full = not crowded.isEmpty()
        calm = buckets.join(crowded, ["mask", "key"], "left_anti") if full else buckets
        ordered = calm.repartition("mask", "key").sortWithinPartitions("mask", "key", "fp").select("mask", "key", "fp")
        found = ordered.mapInArrow(partial(_bucket_links, radius=radius), "a bigint, b bigint")
        links = found if links is None else links.unionByName(found)
        if not full:
            return links
        finer = {m: finer_masks(m, radius) for m in masks}
        if all(x == [m] * (radius + 1) for m, x in finer.items()):
            raise ValueError("bucket_rows is too small")
        table = F.create_map(*[x for m, own in finer.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(f)) for f in own]))])
        buckets = durable(deal(buckets.join(crowded, ["mask", "key"], "left_semi"), table[F.col("mask")]).distinct())
        masks = sorted({f for own in finer.values() for f in own})


def near_duplicates(
    docs: DataFrame,
    words: int = 3,
    radius: int = 3,
    seed: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id (the smallest id it is linked to, itself included).

    Whole texts are fingerprinted where they are read; only ids and fingerprints are kept, in the shared folder.  Equal
    fingerprints become one before the search, so copies cost nothing there.  Fingerprints link at
    ``radius`` or fewer differing bits and links reach on from text to text.

    Null texts count as empty, with fingerprint zero, and link like others.  Repeated rows each keep
    their row; null ids keep theirs, but name a component only if it has no other.  An empty table
    gives no rows.  Other columns are not read.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints = [_signed(fingerprint(text, words, seed)) for text in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], names=["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    prints = durable(map_batches(rows, work, f"id {rows.schema['id'].dataType.simpleString()}, fp bigint"))
    single = durable(prints.groupBy("fp").agg(F.min("id").alias("least")))
    linked = durable(components(close_links(single.select("fp"), radius, bucket_rows)))
    reach = linked.join(single, linked["node"] == single["fp"]).groupBy("root").agg(F.min("least").alias("component_id"))
    named = linked.join(reach, "root").select(F.col("node").alias("fp"), "component_id")
    every = single.join(named, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return prints.join(every, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of every component, all columns: the one with the smallest id, null ids last, then the first as stored.

    The rows are written to the shared folder once, so that file and row number tell repeated rows
    and null ids apart.
    """
    spark = docs.sparkSession
    store = scratch_path(spark, "near-store")
    docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id")).write.parquet(store)
    place = F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("place"))
    stored = spark.read.parquet(store).select("row", F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), place.alias("at")).alias("key"))
    found = near_duplicates(stored.select("key", F.col(f"row.`{text_col}`").alias("text")), id_col="key", text_col="text", **options)
    dropped = found.where(F.col("key") != F.col("component_id")).select(F.col("key.at").alias("at"))
    return stored.join(dropped, stored["key.at"] == dropped["at"], "left_anti").select("row.*")
