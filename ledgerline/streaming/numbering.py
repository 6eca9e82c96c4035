"""ST4: numbers that stay once assigned, as an exactly-once sink for the batches of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators.events import assign_sequence, event_id
from ledgerline.session import discard, exists, file_names, touch
from ledgerline.skew import attach
from ledgerline.streaming.logs import rocksdb


class NumberedLog:
    """An append-only table below ``path`` whose rows get the next numbers of their part when they arrive.

    A batch's rows are numbered among themselves in ``order``, after the last number that their part had
    before.  A late row so gets a new number and no earlier one changes.  Rows without a part belong to no log and are not written.

    Below ``path`` every batch has its rows, the last number of each part it touched, and, written last, an entry in the ledger.
    A batch that the ledger has is passed over when it is delivered again; one
    that was broken off is written anew from the same numbers.  Readers see only batches in the
    ledger.  Every ``compact_every`` batches the last numbers of all parts are written together, so that a
    batch reads that table and the few after it, whatever the length of the log.
    """

    def __init__(self, spark: SparkSession, path: str, part: str, order: list[str], compact_every: int = 16):
        self.spark, self.path, self.part, self.order, self.compact_every = spark, path.rstrip("/"), part, order, compact_every

    def _place(self, kind: str, batch: int) -> str:
        return f"{self.path}/{kind}/batch={batch:012d}"

    def batches(self) -> list[int]:
        """Ids in the ledger, ascending."""
        return sorted(int(name.rpartition("=")[2]) for name in file_names(self.spark, f"{self.path}/ledger"))

    def last_numbers(self) -> DataFrame | None:
        """(part, last): the last number of every part; None before the first batch."""
        done = self.batches()
        whole = [batch for batch in done if (batch + 1) % self.compact_every == 0]
        later = [self._place("last", batch) for batch in done if not whole or batch > whole[-1]]
        read = [self._place("all", batch) for batch in whole[-1:]] + later
        return self.spark.read.parquet(*read).groupBy(self.part).agg(F.max("last").alias("last")) if read else None

    def write(self, rows: DataFrame, batch: int) -> None:
        """Append the rows of a batch; for ``foreachBatch``.

        The rows are read once and whole, also those of a batch that the ledger has, since reading them commits the state of the stream's own operators.
        """
        incoming = self._place("incoming", batch)
        rows.write.mode("overwrite").parquet(incoming)
        if batch in self.batches():
            discard(self.spark, incoming)
            return
        before = self.last_numbers()
        arrived = self.spark.read.schema(rows.schema).parquet(incoming).where(F.col(self.part).isNotNull())
        numbered = assign_sequence(arrived, self.part, self.order)
        if before is not None:
            moved = attach(numbered, before, [self.part]).withColumn("sequence", F.col("sequence") + F.coalesce("last", F.lit(0))).drop("last")
            numbered = moved.withColumn("event_id", event_id(self.part, F.col("sequence")))
        numbered.write.mode("overwrite").parquet(self._place("rows", batch))
        fresh = self.spark.read.schema(numbered.schema).parquet(self._place("rows", batch)).groupBy(self.part).agg(F.max("sequence").alias("last"))
        fresh.write.mode("overwrite").parquet(self._place("last", batch))
        if (batch + 1) % self.compact_every == 0:
            every = fresh if before is None else before.unionByName(fresh).groupBy(self.part).agg(F.max("last").alias("last"))
            every.write.mode("overwrite").parquet(self._place("all", batch))
        touch(self.spark, self._place("ledger", batch))
        discard(self.spark, incoming)

    def rows(self) -> DataFrame:
        """All rows that the ledger has, each with ``sequence``, ``event_id`` and ``batch``."""
        done = self.batches()
        if not done:
            raise FileNotFoundError(f"no batch has been written: {self.path}")
        return self.spark.read.option("basePath", f"{self.path}/rows").parquet(*[self._place("rows", batch) for batch in done])

    def remove_unfinished(self) -> None:
        """Delete what broken-off batches left."""
        done = set(self.batches())
        for kind in ("incoming", "rows", "last", "all"):
            if exists(self.spark, f"{self.path}/{kind}"):
                discard(self.spark, *[self._place(kind, b) for b in (int(x.rpartition("=")[2]) for x in file_names(self.spark, f"{self.path}/{kind}")) if b not in done])


def append_numbered(stream: DataFrame, log: NumberedLog, checkpoint: str) -> None:
    """Number all input that is available now, batch by batch, and stop; state is on disk (RocksDB)."""
    with rocksdb(stream.sparkSession):
        query = stream.writeStream.foreachBatch(log.write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
