"""Loads of several tables that are seen together or not at all, and can be broken off and gone on with."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators.integrity import ForeignKey, fk_violations
from ledgerline.session import discard, exists, put_text, read_text
from ledgerline.violations import assert_empty

# Files of a target: what readers see, and what is being written.
CURRENT, PENDING = "current.json", "pending.json"


def _state(spark: SparkSession, target: str, name: str) -> dict:
    path = f"{target}/{name}"
    return json.loads(read_text(spark, path)) if exists(spark, path) else {}


def current_path(spark: SparkSession, target: str) -> str:
    """The folder of the generation that readers see."""
    state = _state(spark, target, CURRENT)
    if not state:
        raise FileNotFoundError(f"nothing has been loaded: {target}")
    return f"{target}/{state['current']}"


def read_loaded(spark: SparkSession, target: str, table: str) -> DataFrame:
    """One table as of the last load that was published."""
    return spark.read.parquet(f"{current_path(spark, target)}/{table}")


def load_generation(
    tables: dict[str, DataFrame],
    columns: dict[str, dict[str, str]],
    target: str,
    order: list[str],
    fks: list[ForeignKey],
    source: str,
    counts: dict[str, int] | None = None,
    database: str | None = None,
) -> str:
    """Load all tables as one new generation of ``target`` and return its folder.

    Tables are written, parents first, to a folder of their own, with the closed column list of each (absent columns
    become null).  Then row counts are compared with ``counts``, references are checked, and a
    small file that names the generation is replaced by one atomic rename.  Until then
    readers see the generation before.

    A load that was broken off is named in a second file together with its ``source``, a name for the
    input such as a snapshot's path.  Called again for that source it keeps tables that are whole and goes on; for
    another one it begins anew.  The same source loaded and published already is not loaded again.  With ``database`` the tables are
    registered there and their statistics computed once they are published.
    """
    spark = next(iter(tables.values())).sparkSession
    for name in order:
        unknown = sorted(set(tables[name].columns) - set(columns[name]))
        if unknown:
            raise ValueError(f"{name} contains unknown fields: {', '.join(unknown)}")
    seen, pending = _state(spark, target, CURRENT), _state(spark, target, PENDING)
    if seen.get("source") == source and not pending:
        return f"{target}/{seen['current']}"
    if pending and pending["source"] != source:
        abandon(spark, target)
        pending = {}
    if not pending:
        pending = {"generation": f"generation-{uuid.uuid4().hex}", "source": source}
        put_text(spark, f"{target}/{PENDING}", json.dumps(pending))
    folder = f"{target}/{pending['generation']}"
    if seen.get("current") != pending["generation"]:
        for name in order:
            if not exists(spark, f"{folder}/{name}/_SUCCESS"):
                chosen = [(F.col(c) if c in tables[name].columns else F.lit(None)).cast(kind).alias(c) for c, kind in columns[name].items()]
                tables[name].select(*chosen).write.mode("overwrite").parquet(f"{folder}/{name}")
        staged = {name: spark.read.parquet(f"{folder}/{name}") for name in order}
        wrong = [f"{name}: {found} of {want} rows" for name, want in (counts or {}).items() if (found := staged[name].count()) != want]
        if wrong:
            raise ValueError(f"row counts differ: {'; '.join(wrong)}")
        assert_empty(fk_violations(staged, fks), "unresolved references in load")
        put_text(spark, f"{target}/{CURRENT}", json.dumps({"current": pending["generation"], "previous": seen.get("current"), "source": source, "before": seen.get("source")}))
    for name in order if database else []:
        spark.sql(f"DROP TABLE IF EXISTS {database}.{name}")
        spark.catalog.createTable(f"{database}.{name}", path=f"{folder}/{name}", source="parquet")
        spark.sql(f"ANALYZE TABLE {database}.{name} COMPUTE STATISTICS FOR ALL COLUMNS")
    discard(spark, f"{target}/{PENDING}")
    return folder


def abandon(spark: SparkSession, target: str) -> None:
    """Give up a load that was broken off: its folder goes, what readers see stays."""
    pending = _state(spark, target, PENDING)
    if pending and pending["generation"] != _state(spark, target, CURRENT).get("current"):
        discard(spark, f"{target}/{pending['generation']}")
    discard(spark, f"{target}/{PENDING}")


def roll_back(spark: SparkSession, target: str) -> str:
    """Readers see the generation before again; returns its folder."""
    state = _state(spark, target, CURRENT)
    if not state.get("previous"):
        raise FileNotFoundError(f"no earlier generation: {target}")
    put_text(spark, f"{target}/{CURRENT}", json.dumps({"current": state["previous"], "previous": None, "source": state["before"], "before": None}))
    return f"{target}/{state['previous']}"
