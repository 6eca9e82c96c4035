"""Files as tables: numbered lines, key/value lines, inventories, fingerprints, config documents."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.functions.text import split_lines, strip

# Shape of a key/value line.
KEY_VALUE_LINE = r"^\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)=(.*)$"
#: Files up to this size are digested by the reader itself, larger ones as a stream; the digest is the same.
INLINE_BYTES = 1 << 26
#: Keys of one leaf of the inventory digest, on average.
LEAF_KEYS = 1024


def number_lines(df: DataFrame, path: Column, text: Column) -> DataFrame:
    """(path, line, text) with line numbers from 1; no shuffle."""
    return df.select(path.alias("path"), F.posexplode(split_lines(text)).alias("_pos", "text")).select(
        "path", (F.col("_pos") + 1).alias("line"), "text"
    )


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Numbered lines of text files of any size; files that are not UTF-8 are skipped.

    Files are read in blocks.  A line's number is its place in its block after the lines of the
    blocks before, so no task holds more than a block and no file has to fit in memory.
    """
    raw = spark.read.option("lineSep", "\n").text(paths).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_seq"),
        F.col("value"),
    )
    unreadable = raw.where(~F.is_valid_utf8("value")).select("path").distinct()
    pieces = raw.join(unreadable, "path", "left_anti").withColumn("_lines", split_lines(F.concat("value", F.lit("\n")))).drop("value")
    blocks = pieces.groupBy("path", "_block").agg(F.sum(F.size("_lines").cast("bigint")).alias("_n"))
    starts = blocks.withColumn("_start", F.sum("_n").over(Window.partitionBy("path").orderBy("_block")) - F.col("_n")).drop("_n")
    own = Window.partitionBy("path", "_block").orderBy("_seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = pieces.withColumn("_upto", F.sum(F.size("_lines").cast("bigint")).over(own) - F.size("_lines")).join(starts, ["path", "_block"])
    return placed.select("path", (F.col("_start") + F.col("_upto")).alias("_before"), F.posexplode("_lines").alias("_pos", "text")).select(
        "path", (F.col("_before") + F.col("_pos") + 1).alias("line"), "text"
    )


# One piece of a shell word: plain characters, an escaped one, single or double quotes; or white space between words.
SHELL_PIECE = r"""((?s)[^\s'"\\]+|\\.|'[^']*'|"[^"\\]*+(?:\\.[^"\\]*+)*+"|\s+)"""


def unquote(raw: Column) -> Column:
    """struct(value, error) of one shell-quoted scalar.

    The text is cut into pieces; what the pieces do not cover is an open quote or a lone escape, white space between
    two of them means several words.
    """
    pieces = F.regexp_extract_all(F.coalesce(strip(raw), F.lit("")), F.lit(SHELL_PIECE), F.lit(1))

    def plain(piece: Column) -> Column:
        inner = F.substr(piece, F.lit(2), F.length(piece) - 2)
        return (
            F.when(piece.startswith("'"), inner)
            .when(piece.startswith('"'), F.regexp_replace(inner, r'\\(["\\])', "$1"))
            .when(piece.startswith("\\"), F.substring(piece, 2, 1))
            .otherwise(piece)
        )

    value = F.array_join(F.transform(pieces, plain), "")
    covered = F.length(F.array_join(pieces, "")) == F.length(F.coalesce(strip(raw), F.lit("")))
    error = (
        F.when(~covered, F.lit("a quote or an escape is not closed"))
        .when((F.size(pieces) == 0) | F.exists(pieces, lambda piece: piece.rlike(r"^\s")), F.lit("not exactly one value"))
        .when(F.contains(value, F.lit("\x00")), F.lit("a NUL byte in the value"))
    )
    return F.struct(F.when(error.isNull(), value).alias("value"), error.alias("error"))


def parse_keyvalues(lines: DataFrame, allowed: list[str] | None = None, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """S10 on numbered lines: (rows (path, line, key, value), violations).

    Comments and blanks are skipped.  With ``strict`` other lines and keys outside
    ``allowed`` are violations; without it they are left out.
    """
    body = strip(F.col("text"))
    kept = lines.where((body != "") & ~body.startswith("#"))
    matched = kept.withColumn("_ok", F.col("text").rlike(KEY_VALUE_LINE))
    pairs = matched.where("_ok").select(
        "path", "line", F.regexp_extract("text", KEY_VALUE_LINE, 1).alias("key"), F.regexp_extract("text", KEY_VALUE_LINE, 2).alias("_raw")
    )
    none = pairs.select("path", "line", F.lit("").alias("rule")).where("false")
    violations = none
    if strict:
        other = matched.where("NOT _ok").select("path", "line", F.lit("expected KEY=value or export KEY=value").alias("rule"))
        violations = violations.unionByName(other)
    if allowed is not None:
        if strict:
            unknown = pairs.where(~F.col("key").isin(allowed))
            violations = violations.unionByName(
                unknown.select("path", "line", F.concat(F.lit("unsupported key "), F.col("key")).alias("rule"))
            )
        pairs = pairs.where(F.col("key").isin(allowed))
    values = pairs.withColumn("_u", unquote(F.col("_raw"))).select(
        "path", "line", "key", F.col("_u.value").alias("value"), F.col("_u.error").alias("error")
    )
    invalid = values.where(F.col("error").isNotNull()).select(
        "path", "line", F.concat(F.lit("invalid value for "), F.col("key"), F.lit(": "), F.col("error")).alias("rule")
    )
    repeats = (
        pairs.groupBy("path", "key")
        .agg(F.count(F.lit(1)).alias("n"), F.max("line").alias("line"))
        .where("n > 1")
        .select("path", "line", F.concat(F.lit("duplicate key "), F.col("key")).alias("rule"))
    )
    rows = values.where(F.col("error").isNull()).select("path", "line", "key", "value")
    return rows, violations.unionByName(invalid).unionByName(repeats)


def read_keyvalues(spark: SparkSession, paths: str | list[str], allowed: list[str] | None = None, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """key/value files."""
    return parse_keyvalues(read_lines(spark, paths), allowed, strict)


def read_checksums(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows (name, digest), violations) of ``digest  name`` lists; a leading ``*`` is dropped."""
    lines = spark.read.text(path).select(strip(F.col("value")).alias("text"))
    digest = F.regexp_extract("text", r"^(\S+)\s+(.+)$", 1)
    name = F.ltrim(F.regexp_extract("text", r"^(\S+)\s+(.+)$", 2), F.lit("*"))
    parsed = lines.select("text", digest.alias("digest"), name.alias("name"))
    good = (F.length("digest") == 64) & (F.col("name") != "")
    rows = parsed.where(good).select("name", "digest")
    bad = parsed.where(~good).select(F.col("text").alias("entry"), F.lit("invalid checksum entry").alias("rule"))
    twice = rows.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return rows, bad.unionByName(twice.select(F.col("name").alias("entry"), F.lit("duplicate checksum entry").alias("rule")))


def object_inventory(spark: SparkSession, root: str) -> DataFrame:
    """(key, size) of every file below a folder; contents are not read.  Sort by key to present."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    below = F.regexp_replace("path", r"^[a-z0-9+.-]+:/*", "/")
    clean = "/" + root.split(":", 1)[-1].strip("/") + "/"
    return files.select(F.regexp_replace(below, F.lit("^" + _quote(clean)), F.lit("")).alias("key"), F.col("length").alias("size"))


def _quote(text: str) -> str:
    return "\\Q" + text + "\\E"


def _stream_digests(batches):
    """(path, size, sha256) of files read a mebibyte at a time."""
    for batch in batches:
        digests = []
        for path in batch.column(0).to_pylist():
            local = path.startswith("file:")
            system, name = (fs.LocalFileSystem(), "/" + path[5:].lstrip("/")) if local else fs.FileSystem.from_uri(path)
            digest = hashlib.sha256()
            with system.open_input_stream(name) as stream:
                while block := stream.read(1 << 20):
                    digest.update(block)
            digests.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.string())], names=["path", "size", "sha256"])


def fingerprint(spark: SparkSession, globs: list[str], inline_bytes: int = INLINE_BYTES) -> DataFrame:
    """(path, size, sha256) of the distinct files behind several patterns, of any size.

    The listing does not read contents.  Files over ``inline_bytes`` are streamed by the task, which
    never holds more than a block of them; their store has to be one that Arrow opens.
    """
    files = spark.read.format("binaryFile").load(globs)
    small = files.where(F.col("length") <= inline_bytes).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    large = files.where(F.col("length") > inline_bytes).select("path", F.col("length").alias("size")).distinct().repartition("path")
    return small.distinct().unionByName(large.mapInArrow(_stream_digests, "path string, size bigint, sha256 string"))


def inventory_totals(inventory: DataFrame, key: str = "key", size: str = "size", leaf_keys: int = LEAF_KEYS) -> DataFrame:
    """A2: object count, total bytes and ``key_tree_sha256``, a digest of the key list (one row).

    The digest is one and the same function of the keys at every size: keys fall into
    16^depth leaves by the digest of the key, a leaf hashes its sorted keys, and each level above
    hashes the digests of its (at most 16) children.  The depth follows the number of distinct keys, so that
    a leaf has about ``leaf_keys`` of them.  A key listed several times counts as one line with its number.
    """
    keys = inventory.groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(size).cast("bigint")).alias("s"))
    depth, leaves = 0, 1
    distinct = keys.count()
    while leaves * leaf_keys < distinct:
        depth, leaves = depth + 1, leaves * 16
    line = F.when(F.col("n") > 1, F.concat_ws("\t", "k", "n")).otherwise(F.col("k"))
    level = keys.groupBy(F.left(F.sha2("k", 256), F.lit(depth)).alias("bucket")).agg(
        F.sum("n").alias("n"),
        F.sum("s").alias("bytes"),
        F.sha2(F.concat(F.array_join(F.array_sort(F.collect_list(line)), "\n"), F.lit("\n")), 256).alias("digest"),
    )
    below = F.transform(F.array_sort(F.collect_list(F.struct("bucket", "digest"))), lambda x: x["digest"])
    for width in range(depth - 1, -1, -1):
        level = level.groupBy(F.left("bucket", F.lit(width)).alias("_up")).agg(
            F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.sha2(F.array_join(below, "\n"), 256).alias("digest")
        ).withColumnRenamed("_up", "bucket")
    return level.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("object_count"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bytes"),
        F.coalesce(F.max("digest"), F.sha2(F.lit(""), 256)).alias("key_tree_sha256"),
    )


def explode_map(df: DataFrame, col: str, value_type: str = "string", keep: list[str] | None = None) -> DataFrame:
    """One row per entry of a JSON object column, value as ``value_type``."""
    entries = F.from_json(F.col(col), f"map<string, {value_type}>")
    return df.select(*(keep or []), F.explode(entries).alias("key", "value"))


def explode_list_map(df: DataFrame, col: str, keep: list[str] | None = None) -> DataFrame:
    """One row per item of a JSON object of string lists: (key, position, value)."""
    lists = explode_map(df, col, "array<string>", keep)
    return lists.select(*(keep or []), "key", F.posexplode("value").alias("position", "value"))


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """Config documents, one row per file: (path, document)."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("document"))
