"""Release records: nested lookups, identity, attestations, pointers, complete pivots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.text import natural_key, split_lines
from ledgerline.skew import attach


def first_match(items: Column, predicate: Callable[[Column], Column]) -> Column:
    """first element that satisfies the predicate, else null."""
    return F.get(F.filter(items, predicate), F.lit(0))


def pivot_complete(df: DataFrame, group: list[str], key: str, value: str, order: str, expected: list[str]) -> DataFrame:
    """One column per expected key holding the last value, and whether all are present."""
    columns = [F.max_by(F.when(F.col(key) == name, F.col(value)), F.when(F.col(key) == name, F.col(order))).alias(name) for name in expected]
    wide = df.groupBy(*group).agg(*columns)
    complete = F.lit(True)
    for name in expected:
        complete = complete & F.col(name).isNotNull()
    return wide.withColumn("complete", complete)


def asset_fields(asset: Column) -> tuple[Column, Column, Column]:
    return asset["name"], asset["url"], asset["id"]


def identity(version: Column, published: Column, url: Column, assets: Column, fields: Callable[[Column], tuple[Column, ...]] = asset_fields) -> Column:
    """Digest of a release that ignores the order of its assets.

    ``fields`` gives the (name, url, id) of an element of ``assets``, by default of a struct.
    They are put in order by their own ordering, not by a comparing function that is called for every two.
    """
    listed = F.transform(assets, lambda a: F.struct(*[value.alias(name) for value, name in zip(fields(a), ("name", "url", "id"), strict=True)]))
    return F.sha2(F.to_json(F.struct(version.alias("v"), published.cast("string").alias("p"), url.alias("u"), F.sort_array(listed).alias("a"))), 256)


def identified(assets: Column) -> Column:
    """Every asset has a name and a url; a release without assets passes."""
    given = lambda value: F.coalesce(value != "", F.lit(False))
    return F.coalesce(F.forall(assets, lambda a: given(a["name"]) & given(a["url"])), F.lit(True))


def identity_changes(first: DataFrame, second: DataFrame, key: str, digest: str = "identity") -> DataFrame:
    """Releases that differ, or exist on one side only, between two reads."""
    a = first.select(key, F.col(digest).alias("_a"))
    b = second.select(key, F.col(digest).alias("_b"))
    return a.join(b, key, "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b"))).select(key)


# Shape of a statement and of its encoding.
BASE64 = r"^[A-Za-z0-9+/]+={0,2}\z"
STATEMENT = "subject array<struct<name: string, digest: map<string, string>>>"


def attested(artifacts: DataFrame, bundles: DataFrame, publisher: dict[str, str]) -> DataFrame:
    """Artifacts (filename, sha256) with a subject of equal name and digest from the given publisher.

    ``bundles`` has (publisher struct, attestations array<struct<statement>>), the
    statement being base64 JSON.  Payloads that cannot be read are skipped.
    """
    wanted = F.lit(True)
    for name, value in publisher.items():
        wanted = wanted & F.col("publisher")[name].eqNullSafe(F.lit(value))
    payloads = bundles.where(wanted).select(F.explode("attestations.statement").alias("p")).where(F.col("p").rlike(BASE64))
    statements = payloads.select(F.from_json(F.try_to_binary("p", F.lit("base64")).cast("string"), STATEMENT).alias("s"))
    subjects = statements.select(F.explode("s.subject").alias("subject")).where(
        (F.size("subject.digest") == 1) & F.col("subject.digest")["sha256"].isNotNull()
    )
    proven = subjects.select(F.col("subject.name").alias("filename"), F.col("subject.digest")["sha256"].alias("sha256")).distinct()
    return artifacts.join(proven, ["filename", "sha256"], "left_semi")


# Fixed value: shape of a commit id.
COMMIT_ID = r"^[0-9a-f]{40}\z"


def resolve_pointer(refs: DataFrame, objects: DataFrame, name: str = "name") -> DataFrame:
    """Commit behind each reference; a tag is followed exactly once.

    ``refs`` has (name, type, target), ``objects`` has (id, type, target) with a unique id.  What is
    not a full commit id is an error.
    """
    tags = objects.select(F.col("id").alias("target"), F.col("type").alias("_type2"), F.col("target").alias("_target2"))
    joined = attach(refs, tags, ["target"], "left")
    is_tag = F.col("type") == "tag"
    commit = F.when(F.col("type") == "commit", F.col("target")).when(is_tag & (F.col("_type2") == "commit"), F.col("_target2"))
    error = (
        F.when(is_tag & F.col("_type2").isNull(), F.lit("tag object is missing"))
        .when(is_tag & (F.col("_type2") != "commit"), F.lit("annotated tag does not resolve to a commit"))
        .when(F.coalesce(~F.col("type").isin("tag", "commit"), F.lit(True)), F.lit("does not resolve to a commit"))
    )
    error = F.coalesce(error, F.when(~F.coalesce(commit.rlike(COMMIT_ID), F.lit(False)), F.lit("commit is not 40 hex digits")))
    return joined.select(name, F.when(error.isNull(), commit).alias("commit"), error.alias("error"))


def rollbacks(df: DataFrame, current: str, selected: str) -> DataFrame:
    """Rows whose selected version is below the current one in natural order."""
    return df.where(natural_key(F.col(selected)) < natural_key(F.col(current)))


def process_target(current: Column, is_default: Column, latest: Column, published: Column, now: Column, hold_hours: int, file_present: Column) -> Column:
    """Decision for one pin, in the order: file, pin, custom, current, hold, updated."""
    held = now - published < F.make_dt_interval(F.lit(0), F.lit(hold_hours))
    outcome = lambda status, detail: F.struct(F.lit(status).alias("status"), F.lit(detail).alias("detail"))
    return (
        F.when(~file_present, outcome("skip", "file not present"))
        .when(current.isNull(), outcome("skip", "version pin not present"))
        .when(~is_default, outcome("skip", "custom operator pin"))
        .when(latest == current, outcome("current", "already at latest"))
        .when(held, outcome("hold", "inside the hold period"))
        .otherwise(outcome("updated", "release is old enough"))
    )


# Format of a lock entry's header, its digest and forbidden origins.
LOCK_HEADER = r"(?m)^[a-z0-9][a-z0-9_.-]*(?:\[[^]]+\])?==[^ \t\\]+(?: \\| --hash=sha256:[0-9a-f]{64}(?:\s+#.*)?)$"
LOCK_SPLIT = r"(?m)(?=^[a-z0-9][a-z0-9_.-]*(?:\[[^]]+\])?==)"
LOCK_DIGEST = r"--hash=sha256:[0-9a-f]{64}"
FORBIDDEN_ORIGIN = r"(?m)^[^#\n]*(?:https?://|git\+|--find-links|--extra-index-url|--trusted-host)"


def blocks(text: Column, split: str) -> Column:
    """Text cut into blocks, each beginning where ``split`` (a zero-width pattern) matches."""
    return F.split(text, split, -1)


def own_pin(text: Column, package: str, version: Column) -> Column:
    """A line begins with the package and its extras and ends with the version and a continuation mark."""
    ending = F.concat(F.lit("]=="), version, F.lit(" \\"))
    lines = split_lines(text)
    return F.coalesce(F.exists(lines, lambda line: line.startswith(F.lit(f"{package}[")) & line.endswith(ending)), F.lit(False))


def check_lock(
    text: Column, expected: int, header: str = LOCK_HEADER, split: str = LOCK_SPLIT, digest: str = LOCK_DIGEST, forbidden: str = FORBIDDEN_ORIGIN, needed: tuple[str, ...] = (),
    package: str | None = None, version: Column | None = None, checksum: Column | None = None,
) -> Column:
    """Names of the completeness rules a lock document breaks.

    With a ``package`` the document has to pin that package with extras at ``version``, and to hold the
    package's official ``checksum``; a null checksum (no official one) is not looked for, a null version is never pinned.
    """
    entries = F.filter(blocks(text, split), lambda block: block.rlike(rf"\A{split}"))
    whole = F.filter(entries, lambda block: block.rlike(rf"\A{header}"))
    rules = [
        (F.size(F.regexp_extract_all(text, F.lit(header), F.lit(0))) != expected, "wrong number of entries"),
        (F.size(whole) != F.size(entries), "malformed entry"),
        (F.exists(entries, lambda block: ~block.rlike(digest)), "entry without digest"),
        (text.rlike(forbidden), "forbidden origin"),
        *[(~text.contains(part), f"missing text: {part}") for part in needed],
    ]
    if package is not None:
        rules.append((~own_pin(text, package, version), "own pin is missing"))
    if checksum is not None:
        rules.append((~text.contains(F.concat(F.lit("--hash=sha256:"), checksum)), "own digest is missing"))
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for bad, name in rules]))
