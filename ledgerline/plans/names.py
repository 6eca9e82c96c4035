"""Desired DNS state from config documents: check it, place every name in a zone, plan the changes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.normalize import is_ipv4
from ledgerline.functions.paths import has_format
from ledgerline.functions.text import strip
from ledgerline.operators import network as NW
from ledgerline.sources.files import explode_list_map, explode_map
from ledgerline.violations import violation

# Keys a document must have and may have.
REQUIRED_KEYS = ["a_records", "cname_records", "zones"]
ALLOWED_KEYS = [*REQUIRED_KEYS, "settings"]


def _part(documents: DataFrame, name: str) -> DataFrame:
    return documents.select("doc", F.get_json_object("document", f"$.{name}").alias("part"))


def desired_records(documents: DataFrame) -> DataFrame:
    """(doc, domain, type, value) of all records; names without their final dots."""
    kinds = {"A": "a_records", "CNAME": "cname_records"}
    parts = [
        explode_map(_part(documents, column), "part", "string", ["doc"]).select(
            "doc", NW.trim_dots(F.col("key")).alias("domain"), F.lit(kind).alias("type"), "value"
        )
        for kind, column in kinds.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def check_documents(documents: DataFrame) -> DataFrame:
    """Violations (rule, key, detail) of documents (doc, document)."""
    keys = F.json_object_keys("document")
    missing = F.array_except(F.array(*[F.lit(key) for key in REQUIRED_KEYS]), keys)
    extra = F.array_sort(F.array_except(keys, F.array(*[F.lit(key) for key in ALLOWED_KEYS])))
    zones = explode_list_map(_part(documents, "zones"), "part", ["doc"])
    lists = explode_map(_part(documents, "zones"), "part", "array<string>", ["doc"])
    records = desired_records(documents)
    bad_value = F.when(F.col("type") == "A", ~is_ipv4(F.col("value"))).otherwise(~has_format(F.col("value"), "dns_name"))
    both = records.where("type = 'A'").select("doc", "domain").intersect(records.where("type = 'CNAME'").select("doc", "domain"))
    found = [
        documents.select("doc", F.explode(missing).alias("k")).select(*violation("missing key", F.col("doc"), F.col("k"))),
        documents.select("doc", F.explode(extra).alias("k")).select(*violation("unknown key", F.col("doc"), F.col("k"))),
        zones.where(~has_format(NW.trim_dots(F.col("key")), "dns_name")).select(*violation("invalid zone", F.col("doc"), F.col("key"))),
        zones.where((strip(F.col("value")) == "") | ~F.col("value").rlike(r"^[^\x00-\x1f]*\z")).select(
            *violation("invalid forwarder", F.col("doc"), F.col("key"))
        ),
        lists.where(F.coalesce(F.size("value") == 0, F.lit(True))).select(*violation("zone without forwarders", F.col("doc"), F.col("key"))),
        records.where(~has_format(F.col("domain"), "dns_name")).select(*violation("invalid name", F.col("doc"), F.col("domain"))),
        records.where(F.coalesce(bad_value, F.lit(True))).select(*violation("invalid value", F.col("doc"), F.col("domain"))),
        both.select(*violation("address and alias for one name", F.col("doc"), F.col("domain"))),
        placed_records(documents).where("zone IS NULL").select(*violation("no zone", F.col("doc"), F.col("domain"))),
    ]
    return reduce(DataFrame.unionByName, found)


def placed_records(documents: DataFrame) -> DataFrame:
    """Records with the most specific zone of their own document.

    The document id leads both names and zones, so one suffix join serves all documents.
    """
    records = desired_records(documents)
    zones = explode_map(_part(documents, "zones"), "part", "array<string>", ["doc"]).select(
        "doc", NW.trim_dots(F.col("key")).alias("zone")
    )
    return NW.longest_suffix_within(records, zones, ["doc"], "domain", "zone")


def plan_records(documents: DataFrame, actual: DataFrame) -> DataFrame:
    """Action per record against the actual (zone, domain, type, value)."""
    return NW.reconcile(placed_records(documents), actual, ["zone", "domain", "type"], "value")
