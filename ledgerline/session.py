"""Session factory and durable (fault-tolerant) intermediate results."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")


def get_session(app: str = "ledgerline", master: str | None = None, conf: dict | None = None) -> SparkSession:
    """UTC session with ANSI mode and adaptive execution on; ``conf`` wins over the defaults.

    Checkpoints are deleted once nothing refers to them.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
    }
    if not (master or "").startswith("local"):
        # many partitions to begin with; adaptive execution joins small ones
        settings["spark.sql.adaptive.coalescePartitions.initialPartitionNum"] = "20000"
    settings.update(conf or {})
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """Folder for intermediate data: the session's ``spark.checkpoint.dir``.

    A cluster has to name one that every executor reaches.  Only a local master,
    where driver and executors share one machine, may fall back to a new folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    root = os.path.join(tempfile.gettempdir(), f"ledgerline-{spark.sparkContext.applicationId}")
    os.makedirs(root, exist_ok=True)
    return root


_SCOPES: list[list[str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path under the shared folder; inside a ``scratch_scope`` it lasts until that ends."""
    path = f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


def _store(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path with its scheme."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return store, store.makeQualified(place)


def exists(spark: SparkSession, path: str) -> bool:
    store, place = _store(spark, path)
    return store.exists(place)


def file_names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, none if it does not exist; hidden files are left out."""
    store, place = _store(spark, folder)
    found = [status.getPath().getName() for status in store.listStatus(place)] if store.exists(place) else []
    return [name for name in found if name[0] not in "._"]


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete files and folders that are no longer read; those that do not exist are passed over."""
    for path in paths:
        store, place = _store(spark, path)
        store.delete(place, True)


def touch(spark: SparkSession, path: str) -> None:
    """Make an empty file, in one step."""
    store, place = _store(spark, path)
    store.create(place, True).close()


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace a small file: written aside, then renamed over the old one, so that readers see one or the other."""
    jvm = spark._jvm
    store, place = _store(spark, path)
    aside = jvm.org.apache.hadoop.fs.Path(f"{place.toString()}.{uuid.uuid4().hex}")
    out = store.create(aside)
    out.write(bytearray(text.encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    options[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), spark._jsc.hadoopConfiguration()).rename(aside, place, options)


def read_text(spark: SparkSession, path: str) -> str:
    """The text of a small file."""
    return spark.read.text(path, wholetext=True).first()[0]


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete what ``scratch_path`` named inside once all went well; after a failure it stays for inspection.

    What is computed inside has to be written elsewhere inside, to a path named before.
    """
    own: list[str] = []
    _SCOPES.append(own)
    try:
        yield
    finally:
        _SCOPES.remove(own)
    discard(spark, *own)


#: Steps that run side by side: plans, generated code and task results of so many are in the driver's memory at once.
STEPS_AT_ONCE = 3


def side_by_side(spark: SparkSession, work: Iterable[Callable[[], T]]) -> list[T]:
    """Results of independent steps, each of which runs Spark jobs of its own, so that small jobs do not wait for each other."""
    steps = list(work)
    with ThreadPoolExecutor(max_workers=min(len(steps), STEPS_AT_ONCE) or 1) as pool:
        return [done.result() for done in [pool.submit(inheritable_thread_target(spark)(step)) for step in steps]]


def let_go(spark: SparkSession) -> None:
    """Collect the driver's garbage after a large step.

    Shuffle files are deleted only once the driver has collected the plans that wrote them, and a driver with
    memory to spare may not do so before the next step has written its own.
    """
    gc.collect()
    spark._jvm.System.gc()


def expected_bytes(df: DataFrame) -> int:
    """The size that Spark expects a table to have."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage through a reliable checkpoint that survives lost executors.

    A checkpoint keeps the expected size, and a join multiplies those of its sides.  Where a table is joined with itself in rounds,
    the number's digits double each time, until the driver does nothing else.  A size that no table can have is forgotten.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_root(spark))
    kept = df.checkpoint(eager=True)
    if expected_bytes(kept) < 1 << 63:
        return kept
    return DataFrame(spark._jsparkSession.createDataFrame(kept._jdf.javaRDD(), kept._jdf.schema()), spark)
