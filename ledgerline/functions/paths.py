"""Path and name rules; all of them are plain expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Format rules by name.
FORMATS = {
    "dns_name": r"^(?=.{1,253}\.?$)([A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)*[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.?$",
    "digest": r"^sha256:[0-9a-f]{64}\z",
    "hex_digest": r"^[0-9a-f]{64}\z",
    "commit": r"^[0-9a-f]{40}\z",
    "episode_id": r"^[0-9]{8}T[0-9]{6}Z-[0-9a-f]{8}\z",
    "short_host": r"^[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\z",
    "absolute_path": r"^/(?:[A-Za-z0-9_.:-]+/)*[A-Za-z0-9_.:-]+\z",
    "no_control": r"^[^\x00-\x1f]*\z",
}


def has_format(col: Column, rule: str) -> Column:
    """true when the text satisfies the named rule; empty and null text never do."""
    return F.coalesce(col.rlike(FORMATS[rule]), F.lit(False)) & (F.coalesce(col, F.lit("")) != "")


def path_parts(col: Column) -> Column:
    """Parts of a relative path without empty and ``.`` parts."""
    return F.filter(F.split(col, "/"), lambda part: (part != "") & (part != "."))


def path_error(col: Column) -> Column:
    """why a relative path is unsafe, or null."""
    return (
        F.when(col.isNull() | (F.size(path_parts(col)) == 0) & ~col.startswith("/"), F.lit("empty path"))
        .when(col.startswith("/"), F.lit("absolute path"))
        .when(F.array_contains(F.split(col, "/"), ".."), F.lit("parent reference"))
    )


def resolve_link(member: Column, link: Column, hard: Column) -> Column:
    """struct(path, error): link target relative to the member's parent (or the root, if hard)."""
    parent = F.when(hard, F.lit("")).otherwise(F.regexp_replace(member, r"/?[^/]*$", ""))
    parts = path_parts(F.concat_ws("/", F.nullif(parent, F.lit("")), link))
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("stack"), F.lit(False).alias("escaped"))

    def step(acc: Column, part: Column) -> Column:
        stack, escaped = acc["stack"], acc["escaped"]
        size = F.size(stack)
        up = part == ".."
        return F.struct(
            F.when(up & (size == 0), stack)
            .when(up, F.slice(stack, F.lit(1), F.greatest(size - 1, F.lit(0))))
            .otherwise(F.concat(stack, F.array(part)))
            .alias("stack"),
            (escaped | (up & (size == 0))).alias("escaped"),
        )

    done = F.aggregate(parts, start, step)
    error = (
        F.when(link.startswith("/"), F.lit("absolute link target"))
        .when(done["escaped"], F.lit("link target escapes root"))
        .when(F.size(done["stack"]) == 0, F.lit("empty link target"))
    )
    return F.struct(F.when(error.isNull(), F.array_join(done["stack"], "/")).alias("path"), error.alias("error"))


def ancestors(col: Column, separator: str = "/") -> Column:
    """The path itself and every ancestor: a/b/c -> [a, a/b, a/b/c]."""
    parts = F.split(col, separator)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), separator))


def suffixes(col: Column, separator: str = ".") -> Column:
    """The name itself and every suffix at a separator: a.b.c -> [a.b.c, b.c, c]."""
    parts = F.split(col, f"[{separator}]")
    size = F.size(parts)
    return F.transform(F.sequence(F.lit(1), size), lambda n: F.array_join(F.slice(parts, n, size), separator))
