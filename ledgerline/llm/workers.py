"""What Python workers share: bounded caches, and broadcasts turned into objects once per worker."""

from __future__ import annotations

import ctypes
import gc
import io
import sys
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

import ledgerline
from ledgerline.session import shared_root


class Cache(dict):
    """A dictionary that makes missing values and stays under ``2 * limit`` entries.

    When it is full it becomes the old generation; what is asked for again moves back.
    Keys over ``longest`` characters are made but not stored.
    """

    def __init__(self, make: Callable, limit: int, longest: int = 64, fixed: dict | None = None):
        super().__init__()
        self.make, self.limit, self.longest, self.old, self.fixed = make, limit, longest, {}, fixed or {}

    def __missing__(self, key):
        value = self.fixed.get(key)
        if value is None:
            value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


_MADE: dict = {}
_OWNER: list[str] = []


def once(key, make: Callable):
    """The object that ``make`` gave in this worker for ``key``; a worker that goes on to another one lets it go."""
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = make()
    return _MADE[key]


def enter(owner: str) -> None:
    """A worker that goes on to other work lets go of what the work before has made, and gives its memory back."""
    if _OWNER == [owner]:
        return
    _OWNER[:] = [owner]
    if _MADE:
        _MADE.clear()
        gc.collect()
        if sys.platform == "linux":
            ctypes.CDLL(None).malloc_trim(0)


_SHIPPED: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, so that workers find it wherever they run.

    The archive stays in the shared folder, where executors that start later find it.
    """
    application = spark.sparkContext.applicationId
    if application in _SHIPPED:
        return
    root = Path(ledgerline.__file__).parent
    archive = io.BytesIO()
    with zipfile.ZipFile(archive, "w") as target:
        for source in sorted(root.rglob("*.py")):
            target.writestr(str(source.relative_to(root.parent)), source.read_bytes())
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_root(spark).rstrip('/')}/code-{uuid.uuid4().hex}/ledgerline.zip")
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out = store.create(path)
    out.write(bytearray(archive.getvalue()))
    out.close()
    spark.sparkContext.addPyFile(store.makeQualified(path).toString())
    _SHIPPED.add(application)


def share(spark: SparkSession, value):
    """A broadcast of a value whose size does not depend on the input."""
    return spark.sparkContext.broadcast(value)


#: Bytes of text that are worked on at a time; a longer text is worked on alone.
PORTION = 1 << 20


def portions(batch: pa.RecordBatch, most: int = PORTION) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose last column, a text, has about ``most`` bytes each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_pylist()
    start = held = 0
    for at, size in enumerate(sizes):
        if held and held + size > most:
            yield batch.slice(start, at - start)
            start, held = at, 0
        held += size
    yield batch.slice(start)


def map_batches(df: DataFrame, work: Callable[..., pa.RecordBatch], schema: str, state: Callable | None = None, rest: Callable | None = None) -> DataFrame:
    """``work`` on portions of every Arrow batch, whose last column is a text.

    With ``state``, ``work`` also gets what that made for the task, and ``rest`` turns it into a last batch.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter(f"{work.__module__}.{work.__qualname__}")
        own = [state()] if state else []
        for batch in batches:
            if batch.num_rows:
                yield from (work(portion, *own) for portion in portions(batch))
        if rest:
            yield rest(*own)

    ship_code(df.sparkSession)
    return df.mapInArrow(run, schema)
