"""Hard negatives by a vertical scan: dimension by dimension, with bounds on what is left of every score."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.workers import ship_code
from ledgerline.session import durable

#: Candidates of one shard and anchors of one block; a task holds one of each.
SHARD_ROWS = 65_536
BLOCK_ROWS = 8_192
#: A small input is dealt into smaller shards, down to this size, so that every core has some.
LEAST_ROWS = 2_048
#: Dimensions that are read between two looks at the bounds.
STEP = 8
#: Components under this size, of no more than so many, have sums that floats hold exactly; others are Python integers.
SMALL, FEW = 1 << 20, 4_096
LONGEST = 1 << 62


def whole_vector(embedding: Column, factor: int) -> Column:
    """floor(factor * x) of every component, cut to 62 bits; null for a null vector or one with a null or non-finite component."""
    parts = F.transform(embedding, lambda x: x.cast("double"))
    sound = F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    edge = F.lit(float(LONGEST))
    return F.when(sound, F.transform(parts, lambda x: F.floor(F.least(F.greatest(x * float(factor), -edge), edge)).cast("bigint")))


class Shard:
    """Candidates of one length, column by column, with the least and the largest value of every dimension."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, labels: np.ndarray):
        self.columns = np.ascontiguousarray(vectors.T)
        self.ids, self.labels = ids, labels
        self.low, self.high = vectors.min(axis=0), vectors.max(axis=0)

    def scan(self, anchor: np.ndarray, alive: np.ndarray, windows: list[tuple], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(rows, scores) of the k best candidates within each window (least, largest score), ties to the smaller id.

        ``alive`` is the bitmap of candidates.  Dimensions are read in descending magnitude of the
        anchor's components.  After every few, the sum so far and the least and largest that the other
        dimensions can add bound each score.  A candidate goes once its bounds meet no
        window any more, or only windows in which k others are surely inside and surely better.  Scores are whole
        numbers, so the bounds are exact, and what is left at the end has its exact score.
        """
        order = np.argsort(-np.abs(anchor), kind="stable")
        least, most = np.minimum(anchor * self.low, anchor * self.high)[order], np.maximum(anchor * self.low, anchor * self.high)[order]
        rows = np.flatnonzero(alive)
        sums = np.zeros(len(rows), self.columns.dtype)
        for at in range(0, len(order), STEP):
            dims = order[at : at + STEP]
            whole = len(rows) == self.columns.shape[1]
            sums = sums + anchor[dims] @ (self.columns[dims] if whole else self.columns[dims[:, None], rows])
            low, high = sums + least[at + STEP :].sum(), sums + most[at + STEP :].sum()
            keep = np.zeros(len(rows), bool)
            for bottom, top in windows:
                fits = np.ones(len(rows), bool) if bottom is None else (high >= bottom) & (low <= top)
                sure = low[fits] if bottom is None else low[(low >= bottom) & (high <= top)]
                if len(sure) > k:
                    fits &= high >= _kth(sure, k)
                keep |= fits
            if not keep.all():
                rows, sums = rows[keep], sums[keep]
            if not len(rows):
                break
        found = []
        for bottom, top in windows:
            inside = np.arange(len(rows)) if bottom is None else np.flatnonzero((sums >= bottom) & (sums <= top))
            if len(inside) > k:
                inside = inside[sums[inside] >= _kth(sums[inside], k)]
            best = sorted(inside, key=lambda i: (-sums[i], self.ids[rows[i]]))[:k]
            found.append((rows[best], sums[best]))
        return found


def _kth(values: np.ndarray, k: int):
    """The k-th largest value."""
    return sorted(values)[-k] if values.dtype == object else np.partition(values, len(values) - k)[len(values) - k]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length, as floats if their sums stay exact, else as Python integers."""
    flat = column.combine_chunks()
    size = len(flat[0])
    values = flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), size)
    return values.astype(np.float64) if not values.size or (abs(values).max() < SMALL and size <= FEW) else values.astype(object)


def _deal(rows: DataFrame, anchors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates and anchors with (length, block, shard): every shard meets every block in one cell."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    total = rows.count()
    shards = max(1, -(-total // SHARD_ROWS), min(2 * cores, -(-total // LEAST_ROWS)))
    blocks = max(1, -(-anchors.count() // BLOCK_ROWS))
    share = lambda n, *of: F.pmod(F.xxhash64(*of), F.lit(n)).cast("int")
    left = rows.withColumn("shard", share(shards, "vec_id", "label", F.monotonically_increasing_id())).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = anchors.withColumn("block", share(blocks, F.col("vec_id"), F.lit("block"))).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    return left, right


def _cells(rows: DataFrame, anchors: DataFrame, work, schema: str) -> DataFrame:
    """``work`` on (shard, anchors table, anchors matrix) of every cell that has both."""
    names = [field.split()[0] for field in schema.split(", ")]

    def cell(own: pa.Table, asked: pa.Table) -> pa.Table:
        found = []
        if own.num_rows and asked.num_rows:
            vectors, wanted = _matrix(own["vector"]), _matrix(asked["vector"])
            if object in (vectors.dtype, wanted.dtype):
                vectors, wanted = vectors.astype(object), wanted.astype(object)
            found = work(Shard(vectors, own["vec_id"].to_numpy(), own["label"].to_numpy()), asked, wanted)
        columns = list(zip(*found, strict=True)) or [()] * len(names)
        return pa.table({name: pa.array([min(max(int(x), -(1 << 63)), (1 << 63) - 1) for x in values], pa.int64()) for name, values in zip(names, columns, strict=True)})

    left, right = _deal(rows, anchors)
    keys = ["length", "block", "shard"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(cell, schema)


def _best(rows: DataFrame, group: list[str], score: str, id_col: str, k: int) -> DataFrame:
    """The k best rows of every group by score, then id, with their rank."""
    order = Window.partitionBy(*group).orderBy(F.col(score).desc(), id_col)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    vectors: DataFrame,
    anchors: DataFrame,
    positives: int = 5,
    negatives: int = 10,
    least_percent: int = 30,
    most_percent: int = 90,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Both tables have (vec_id, label, vector), vectors of whole numbers.  An anchor's positives are the rows of its label with
    the highest inner products; for each of them the best rows of other labels are returned whose
    score lies between ``least_percent`` and ``most_percent`` of the positive's.  Ties go to the smaller id.

    Two passes, each of which deals candidates into shards and anchors into blocks; every shard meets every block once, in a
    task that holds one of each and scans it column by column (``Shard.scan``).  The first finds the positives, and with
    them the windows; the second finds the negatives of all windows of an anchor at once.  A task sends on no more
    rows than asked for, and these are merged by score and id.  Labels do not deal the rows, so a hot label is no
    hot task.

    Rows with a null id, label or vector take no part; vectors of different length do not meet.  Rows
    with the anchor's id are its own and left out.  Repeated candidates count each, repeated anchors once; of anchors that share an id
    but not vector or label, each has its own positives, all returned under the one id.  A
    window of a negative score is empty.  An anchor without positives, or no rows, gives no rows.  Scores beyond a long are cut to it.
    """
    ship_code(vectors.sparkSession)

    def sound(rows: DataFrame) -> DataFrame:
        ids = [F.col(name).cast("bigint").alias(name) for name in ("vec_id", "label")]
        whole = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()
        return rows.where(whole).select(*ids, F.col("vector").alias("vector"), F.size("vector").alias("length"))

    known, asked = durable(sound(vectors)), durable(sound(anchors).distinct().withColumn("anchor", F.monotonically_increasing_id()))

    def find_positives(shard: Shard, table: pa.Table, matrix: np.ndarray):
        ids, labels, numbers = (table[name].to_numpy() for name in ("vec_id", "label", "anchor"))
        for at, anchor in enumerate(matrix):
            (rows, scores), = shard.scan(anchor, (shard.labels == labels[at]) & (shard.ids != ids[at]), [(None, None)], positives)
            yield from ((numbers[at], shard.ids[row], score) for row, score in zip(rows, scores, strict=True))

    def find_negatives(shard: Shard, table: pa.Table, matrix: np.ndarray):
        ids, labels, numbers = (table[name].to_numpy() for name in ("vec_id", "label", "anchor"))
        for at, anchor in enumerate(matrix):
            wanted = sorted(set(table["scores"][at].as_py()))
            windows = [(-(-least_percent * score // 100), most_percent * score // 100) for score in wanted]
            windows, wanted = [w for w in windows if w[0] <= w[1]], [s for s, w in zip(wanted, windows, strict=True) if w[0] <= w[1]]
            if windows:
                for score, (rows, scores) in zip(wanted, shard.scan(anchor, (shard.labels != labels[at]) & (shard.ids != ids[at]), windows, negatives), strict=True):
                    yield from ((numbers[at], score, shard.ids[row], x) for row, x in zip(rows, scores, strict=True))

    partners = _best(_cells(known, asked, find_positives, "anchor bigint, positive_id bigint, positive_score bigint"), ["anchor"], "positive_score", "positive_id", positives)
    partners = durable(partners.withColumnRenamed("rank", "place"))
    scores = partners.groupBy("anchor").agg(F.collect_set("positive_score").alias("scores"))
    found = _cells(known, asked.join(scores, "anchor"), find_negatives, "anchor bigint, positive_score bigint, negative_id bigint, negative_score bigint")
    best = _best(found, ["anchor", "positive_score"], "negative_score", "negative_id", negatives)
    named = partners.join(asked.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor")
    return named.join(best, ["anchor", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
