"""Exact top-k inner-product search by MaxScore over shards of integer vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.workers import ship_code
from ledgerline.session import durable

#: Candidates of one shard and queries of one block; a task holds one of each.
SHARD_ROWS = 65_536
QUERY_ROWS = 8_192
#: A small input is dealt into smaller shards, down to this size, so that every core has some.
LEAST_ROWS = 2_048
#: Candidates that are scored against one query at a time; the threshold rises in between.
STRIP = 2_048
#: Components under this size, of no more than so many, have sums that floats hold exactly; others are Python integers.
SMALL, FEW = 1 << 20, 4_096
#: Whole numbers are cut to this size.
LARGEST = float(1 << 62)


def integer_vector(embedding: Column) -> Column:
    """floor(1024 * x) of every component as a whole number, cut to LARGEST; null for a null vector or one with a null or non-finite component."""
    parts = F.transform(embedding, lambda x: x.cast("double"))
    sound = F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    cut = lambda x: F.least(F.greatest(x * 1024.0, F.lit(-LARGEST)), F.lit(LARGEST))
    return F.when(sound, F.transform(parts, lambda x: F.floor(cut(x)).cast("bigint")))


def search_shard(queries: np.ndarray, own: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, ids, scores) of every query's best k rows of a shard, ties to the smaller id.

    A term is a component of the query.  Its bound is the largest contribution that it makes in the
    shard.  With terms in order of their bounds, those at the end whose bounds together stay under
    the threshold (the k-th score so far) are not essential: no row can come in by them alone.
    The postings of the essential terms are traversed for all rows of a strip.  The other terms are probed,
    one after another, only for rows whose score so far and bounds of the terms left reach the threshold.
    Scores are whole numbers, so the bounds are exact.
    """
    high, low = rows.max(axis=0), rows.min(axis=0)
    postings = np.ascontiguousarray(rows.T)
    for number, query in enumerate(queries):
        bound = np.maximum(query * high, query * low)
        order = np.argsort(-bound, kind="stable")
        after = np.concatenate([np.cumsum(bound[order][::-1])[::-1], [0 * bound[:1].sum()]]) if len(order) else np.zeros(1, np.int64)
        best_ids, best_scores, threshold = ids[:0], rows[:0, 0] if rows.shape[1] else np.zeros(0, np.int64), None
        for at in range(0, len(ids), STRIP):
            strip = slice(at, min(at + STRIP, len(ids)))
            essential = len(order) if threshold is None else int(np.argmax(after < threshold)) if (after < threshold).any() else len(order)
            first = order[:essential]
            scores = query[first] @ postings[first, strip] if essential else np.zeros(strip.stop - at, rows.dtype)
            alive = np.flatnonzero(ids[strip] != own[number])
            scores = scores[alive]
            for place in range(essential, len(order) + 1):
                if threshold is not None:
                    near = scores + after[place] >= threshold
                    if not near.all():
                        alive, scores = alive[near], scores[near]
                if place == len(order) or not len(alive):
                    break
                scores = scores + query[order[place]] * postings[order[place], at + alive]
            if not len(alive):
                continue
            best_ids = np.concatenate([best_ids, ids[at + alive]])
            best_scores = np.concatenate([best_scores, scores])
            if len(best_ids) > k:
                cut = np.partition(best_scores, len(best_scores) - k)[len(best_scores) - k] if best_scores.dtype != object else sorted(best_scores)[-k]
                keep = best_scores >= cut
                best_ids, best_scores = best_ids[keep], best_scores[keep]
                top = sorted(range(len(best_ids)), key=lambda i: (-best_scores[i], best_ids[i]))[:k]
                best_ids, best_scores = best_ids[top], best_scores[top]
            if len(best_ids) == k:
                threshold = best_scores.min()
        yield number, best_ids, best_scores


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors of one cell, all of one length, as floats if their sums stay exact, else as Python integers."""
    size = len(column[0]) if len(column) else 0
    values = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size)
    return values.astype(np.float64) if not values.size or (np.abs(values).max() < SMALL and size <= FEW) else values.astype(object)


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """The k best rows of ``vectors`` for every row of ``queries``: query_id, rank, vec_id, score.

    Both have (vec_id, vector), vectors of whole numbers.  Candidates are dealt into shards and queries
    into blocks; every shard meets every block once, in a task that holds one of each.  A task sends on k rows a
    query at most, and the shards' results are merged by score, then id.

    A candidate with the query's id is its own row and left out.  Rows with a null id or vector take no
    part, vectors of different length do not meet.  Repeated candidates count each, repeated queries
    once; queries of one id with different vectors share one ranking.  Scores beyond the range of a long are cut to it.  No queries or no candidates give no rows.
    """
    ship_code(vectors.sparkSession)
    size = lambda rows: rows.withColumn("length", F.size("vector"))
    known = size(vectors.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull()).select(F.col("vec_id").cast("bigint").alias("vec_id"), "vector"))
    asked = size(queries.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull()).select(F.col("vec_id").cast("bigint").alias("vec_id"), "vector").distinct())
    known, asked = durable(known), durable(asked)
    total, cores = known.count(), known.sparkSession.sparkContext.defaultParallelism
    shards = max(1, -(-total // shard_rows), min(2 * cores, -(-total // LEAST_ROWS)))
    blocks = max(1, -(-asked.count() // query_rows))
    deal = lambda n, seed: F.pmod(F.xxhash64(F.col("vec_id"), F.lit(seed), F.monotonically_increasing_id() if seed == 1 else F.lit(0)), F.lit(n)).cast("int")
    left = known.withColumn("shard", deal(shards, 1)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = asked.withColumn("block", deal(blocks, 2)).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def cell(rows: pa.Table, wanted: pa.Table) -> pa.Table:
        found = {"query_id": [], "vec_id": [], "score": []}
        if rows.num_rows and wanted.num_rows:
            base, ask = _matrix(rows["vector"].combine_chunks()), _matrix(wanted["vector"].combine_chunks())
            if object in (base.dtype, ask.dtype):
                base, ask = base.astype(object), ask.astype(object)
            own, ids = wanted["vec_id"].to_numpy(), rows["vec_id"].to_numpy()
            for number, best, scores in search_shard(ask, own, base, ids, k):
                found["query_id"] += [int(own[number])] * len(best)
                found["vec_id"] += [int(x) for x in best]
                found["score"] += [max(-(1 << 63), min((1 << 63) - 1, int(x))) for x in scores]
        return pa.table({name: pa.array(x, pa.int64()) for name, x in found.items()})

    keys = ["length", "block", "shard"]
    parts = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(cell, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
