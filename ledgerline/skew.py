"""Joins that stay balanced when one key holds a large share of the rows.

``attach`` is the work horse: a fact side, whose keys may be very uneven, gets the
columns of a side that has one row per key.  By default that is a plain join, whose hot
partitions adaptive execution splits; it reads either side once.  Adaptive execution does
not split a join whose output is grouped by the same key.  There a caller passes the hot keys:
rows of a hot key are spread over one reducer per ROWS_PER_COPY rows, and its lookup row is copied
to each, so the copies grow with the data and a reducer's share does not.

Hot keys come from one map-side-combined count.  A hot key holds more than 1/HOT_KEYS of all
rows, so there are fewer than HOT_KEYS of them whatever the data size, and that list is
what is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HOT_KEYS = 100_000
ROWS_PER_COPY = 500_000


def hot_keys(rows: DataFrame, keys: list[str], rows_per_copy: int = ROWS_PER_COPY) -> DataFrame:
    """Keys with more than 1/HOT_KEYS of all rows and more than one copy's worth, with their ``_copies``."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    total = counts.agg(F.sum("_rows")).scalar()
    hot = counts.where((F.col("_rows") > rows_per_copy) & (F.col("_rows") * HOT_KEYS > total))
    return hot.select(*keys, F.ceil(F.col("_rows") / rows_per_copy).cast("int").alias("_copies"))


def _row_hash(rows: DataFrame) -> Column:
    """Hash of a row and its input partition: the same on a retry, and equal rows differ by partition."""
    plain = [field.name for field in rows.schema.fields if not isinstance(field.dataType, (T.MapType, T.VariantType, T.StructType, T.ArrayType))]
    return F.xxhash64(F.spark_partition_id(), *plain)


def attach(
    rows: DataFrame,
    lookup: DataFrame,
    keys: list[str],
    how: str = "left",
    hot: DataFrame | None = None,
) -> DataFrame:
    """Join ``rows`` (uneven keys allowed) to ``lookup`` (one row per key).

    ``how`` is inner, left, left_semi or left_anti.  With ``hot`` (see ``hot_keys``, best of
    the base table) the join is salted.  The salt depends on nothing random,
    so a retried task sends its rows where the first try did.  Rows with a null key match
    nothing and are spread too.
    """
    if hot is None:
        return rows.join(lookup, keys, how)
    found = F.broadcast(hot)
    null_key = F.lit(False)
    for key in keys:
        null_key = null_key | F.col(key).isNull()
    spread_over = F.when(null_key, F.lit(1 << 16)).otherwise(F.coalesce("_copies", F.lit(1)))
    salt = F.when(spread_over > 1, F.pmod(_row_hash(rows), spread_over.cast("bigint")).cast("int")).otherwise(F.lit(0))
    salted_rows = rows.join(found, keys, "left").withColumn("_salt", salt).drop("_copies")
    copies = F.sequence(F.lit(0), F.coalesce("_copies", F.lit(1)) - 1)
    salted_lookup = lookup.join(found, keys, "left").withColumn("_salt", F.explode(copies)).drop("_copies")
    return salted_rows.join(salted_lookup, [*keys, "_salt"], how).drop("_salt")


def spread(df: DataFrame) -> DataFrame:
    """Rows of a plain scan over at least as many partitions as there are cores.

    Small inputs often come as one file with one row group, which a single task has to
    read; work that is heavy per row is then better spread first.  A scan that already
    has enough partitions, as any large one has, is returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
