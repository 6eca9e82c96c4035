"""Inventories kept as hash trees, and their differences found from the top down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DIFFERENCE = "key string, kind string"
LANES = range(1, 65, 8)


def _leaf(depth: int) -> Column:
    return F.concat(F.lit("n"), F.left(F.sha2(F.coalesce("key", F.lit("")), 256), F.lit(depth)))


def _sum_digest() -> Column:
    """Digest of a set of row digests that needs no order and no list: eight sums of 32 bits each, hashed.

    It tells apart what accidents make; it is no defence against rows built to collide.
    """
    lanes = [F.sum(F.conv(F.substring("_row", at, 8), 16, 10).cast("bigint")).cast("string") for at in LANES]
    return F.sha2(F.concat_ws(" ", F.count(F.lit(1)).cast("string"), *lanes), 256)


def write_tree(inventory: DataFrame, path: str, key: str = "key", value: str = "digest", depth: int = 2) -> None:
    """Store an inventory under ``path``: its rows in 16^depth folders by the digest of the key, and the digest of every node.

    Keys and values are kept as text; equal rows become one with their number ``n``, so a row that is repeated very often is
    counted in the map tasks.  Choose ``depth`` so that a folder is about as large as a file should be; trees that are to be compared
    need the same depth.  At most 2 * 16^depth nodes are kept; a leaf holds up to 2^31 different rows.
    """
    spark = inventory.sparkSession
    rows = inventory.select(F.col(key).cast("string").alias("key"), F.col(value).cast("string").alias("value"))
    counted = rows.groupBy("key", "value").agg(F.count(F.lit(1)).alias("n")).withColumn("leaf", _leaf(depth))
    counted.repartition("leaf").write.partitionBy("leaf").parquet(f"{path}/rows")
    stored = spark.read.schema("key string, value string, n bigint, leaf string").parquet(f"{path}/rows")
    row = F.sha2(F.to_json(F.struct("key", "value", "n"), {"ignoreNullFields": "false"}), 256)
    level = stored.select("leaf", row.alias("_row")).groupBy(F.col("leaf").alias("node")).agg(_sum_digest().alias("digest"))
    level.select(F.lit(depth).alias("level"), "node", "digest").coalesce(1).write.parquet(f"{path}/nodes")
    below = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "digest"))), lambda child: F.concat(child["node"], child["digest"])), " ")
    for width in range(depth - 1, -1, -1):
        level = _nodes(spark, path).where(F.col("level") == width + 1)
        level = level.groupBy(F.left("node", F.lit(width + 1)).alias("node")).agg(F.sha2(below, 256).alias("digest"))
        level.select(F.lit(width).alias("level"), "node", "digest").coalesce(1).write.mode("append").parquet(f"{path}/nodes")


def _nodes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("level int, node string, digest string").parquet(f"{path}/nodes")


def differing_leaves(spark: SparkSession, before: str, after: str) -> list[str]:
    """Names of the leaves whose rows are not the same; below a node with equal digests nothing is compared.

    A level is one join of the children of nodes that differ: at most 16^level names, a bound that the
    depth of the tree sets and not its rows.
    """
    sides = [_nodes(spark, path) for path in (before, after)]
    depths = [side.agg(F.max("level")).first()[0] for side in sides]
    found = [depth for depth in depths if depth is not None]
    if len(set(found)) > 1:
        raise ValueError(f"trees of different depth: {depths}")
    open_nodes = None
    for width in range(found[0] + 1 if found else 0):
        a, b = (side.where(F.col("level") == width) for side in sides)
        if open_nodes is not None:
            a, b = (side.where(F.left("node", F.lit(width)).isin(open_nodes)) for side in (a, b))
        both = a.select("node", F.col("digest").alias("_a")).join(b.select("node", F.col("digest").alias("_b")), "node", "full_outer")
        open_nodes = sorted(row[0] for row in both.where(~F.col("_a").eqNullSafe(F.col("_b"))).select("node").collect())
        if not open_nodes:
            break
    return open_nodes or []


def tree_diff(spark: SparkSession, before: str, after: str) -> DataFrame:
    """(key, kind) of keys that were added, removed or changed between two stored inventories.

    Only the rows of leaves that differ are read, as folders left out of the scan.  A key with several rows is changed
    if any of them, or its number, is not the same; a null key is a key of its own.
    """
    leaves = differing_leaves(spark, before, after)
    if not leaves:
        return spark.createDataFrame([], DIFFERENCE)
    side = lambda path, a, b: (
        spark.read.schema("key string, value string, n bigint, leaf string").parquet(f"{path}/rows").where(F.col("leaf").isin(leaves))
        .select("key", "value", (F.col("n") * a).alias("_a"), (F.col("n") * b).alias("_b"))
    )
    rows = side(before, 1, 0).unionByName(side(after, 0, 1)).groupBy("key", "value").agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    keys = rows.groupBy("key").agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"), F.bool_or(F.col("_a") != F.col("_b")).alias("_moved"))
    kind = F.when(F.col("_a") == 0, F.lit("added")).when(F.col("_b") == 0, F.lit("removed")).otherwise(F.lit("changed"))
    return keys.where("_moved").select("key", kind.alias("kind"))
