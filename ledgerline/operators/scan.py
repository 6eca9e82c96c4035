"""Findings in text lines: addresses, secrets, literals.  Values are never shown for secrets."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import addresses as A
from ledgerline.functions import text as X
from ledgerline.functions.normalize import ipv4_to_long, is_ipv4
from ledgerline.skew import attach

FINDING = ["path", "line", "message"]


def without_marker(lines: DataFrame, marker: str, text: str = "text") -> DataFrame:
    """lines that carry the marker are exempt."""
    return lines.where(~F.col(text).contains(marker))


def not_default(df: DataFrame, digest: Column, denylist: DataFrame, col: str = "digest") -> DataFrame:
    """rows whose digest is on the list of known defaults are refused (left out)."""
    known = denylist.select(F.col(col).alias("_digest")).distinct()
    return attach(df.withColumn("_digest", digest), known, ["_digest"], "left_anti").select(*df.columns)


def _in_network(number: Column, network: str) -> Column:
    net = ipaddress.ip_network(network)
    return number.between(int(net.network_address), int(net.broadcast_address))


def ipv4_allowed(address: Column) -> Column:
    """One of the listed addresses, or in a documentation range."""
    number = ipv4_to_long(address)
    allowed = address.isin([ip for ip in X.ALLOWED_IPS if "." in ip])
    for network in X.DOCUMENTATION_IPV4:
        allowed = allowed | _in_network(number, network)
    return allowed


def ipv6_allowed(address: Column) -> Column:
    """struct(high, low) is one of the listed addresses, or in the documentation range."""
    allowed = A.ipv6_in(address, X.DOCUMENTATION_IPV6)
    for ip in X.ALLOWED_IPS:
        if ":" in ip:
            allowed = allowed | A.ipv6_equals(address, ip)
    return allowed


def _candidates(text: Column, pattern: str, needed: str) -> Column:
    """Matches of a pattern; texts without the needed character skip it."""
    none = F.array().cast("array<string>")
    return F.when(text.contains(needed), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none)


def ipv4_findings(text: Column) -> Column:
    """Messages for the IPv4 literals of a line that are valid and not allowed."""
    hits = F.filter(_candidates(text, X.IPV4_CANDIDATE, "."), lambda ip: is_ipv4(ip) & ~ipv4_allowed(ip))
    return F.transform(hits, lambda ip: F.concat(F.lit("non-example IP literal "), ip))


def ipv6_findings(text: Column) -> Column:
    """Messages with the canonical text of the IPv6 literals of a line that are valid and not allowed."""
    found = F.transform(_candidates(text, X.IPV6_CANDIDATE, ":"), A.ipv6_to_longs)
    refused = F.filter(found, lambda address: address.isNotNull() & ~ipv6_allowed(address))
    return F.transform(refused, lambda address: F.concat(F.lit("non-example IP literal "), A.ipv6_text(address)))


def scan_ipv4(lines: DataFrame) -> DataFrame:
    """C2, IPv4 part: one finding per hit; text that is not a valid address is ignored."""
    kept = without_marker(lines, X.ALLOW_IP_MARKER)
    return kept.select("path", "line", F.explode(ipv4_findings(F.col("text"))).alias("message"))


def scan_ipv6(lines: DataFrame) -> DataFrame:
    """C2, IPv6 part."""
    kept = without_marker(lines, X.ALLOW_IP_MARKER)
    return kept.select("path", "line", F.explode(ipv6_findings(F.col("text"))).alias("message"))


def scan_ips(lines: DataFrame) -> DataFrame:
    """Both families, in one pass over the lines."""
    return _scan_once(lines, addresses=True)


def is_placeholder(value: Column) -> Column:
    """Empty after trimming quotes, or containing a placeholder marker."""
    bare = F.btrim(F.btrim(value, F.lit(" \t\r\n\x0b\x0c")), F.lit("\"'"))
    found = bare == ""
    for marker in X.PLACEHOLDERS:
        found = found | F.contains(bare, F.lit(marker))
    return found


def secret_assignments(text: Column, pattern: str = X.SECRET_ASSIGNMENT) -> Column:
    """Names of secret-like keys assigned a real value in this line, in order."""
    keys = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    pairs = F.arrays_zip(keys.alias("key"), values.alias("value"))

    def real(pair: Column) -> Column:
        key, value = pair["key"], pair["value"]
        bare = F.btrim(value, F.lit("\"') ,:"))
        exempt = F.upper(key).endswith("_RE") | F.lower(key).startswith("old_")
        exempt = exempt | key.isin(list(X.EXEMPT_KEYS)) | bare.isin(list(X.EXEMPT_VALUES))
        return ~exempt & ~is_placeholder(value)

    return F.transform(F.filter(pairs, real), lambda pair: pair["key"])


def secret_findings(text: Column, assignment: str = X.SECRET_ASSIGNMENT, names: tuple[str, ...] = X.SECRET_NAMES) -> Column:
    """Messages for one line: private-key header, token prefix, secret assignments."""
    empty = F.array().cast("array<string>")
    key = text.contains("PRIVATE KEY") & text.rlike(X.PRIVATE_KEY)
    token = X.contains_any(text, X.TOKEN_PREFIXES) & text.rlike(X.TOKEN_PREFIX)
    assigned = F.transform(
        secret_assignments(text, assignment), lambda name: F.concat(F.lit("secret-like assignment "), name, F.lit("=<redacted>"))
    )
    pinned = text.contains("==") & X.strip(text).rlike(X.PINNED_REQUIREMENT)
    exempt = text.contains(X.ALLOW_SECRET_MARKER) | pinned
    return F.when(exempt, empty).otherwise(
        F.concat(
            F.when(key, F.array(F.lit("private key material"))).otherwise(empty),
            F.when(token, F.array(F.lit("token-like literal"))).otherwise(empty),
            F.when(X.contains_any(text, names), assigned).otherwise(empty) if names else assigned,
        )
    )


def scan_secrets(lines: DataFrame, assignment: str = X.SECRET_ASSIGNMENT, names: tuple[str, ...] = X.SECRET_NAMES) -> DataFrame:
    """One row per finding.  ``names`` are texts of which every assignment holds one (empty: no such text)."""
    return lines.select("path", "line", F.explode(secret_findings(F.col("text"), assignment, names)).alias("message"))


def scan_literal(lines: DataFrame, literal: str, message: str) -> DataFrame:
    """C4: lines that contain a fixed text."""
    return lines.where(F.col("text").contains(literal)).select("path", "line", F.lit(message).alias("message"))


# The literal of the full scan and its message.
SENSITIVE_REFERENCE = "private/"
SENSITIVE_MESSAGE = "repo-local sensitive directory reference"


def _scan_once(lines: DataFrame, literal: bool = False, addresses: bool = False, secrets: bool = False) -> DataFrame:
    """Findings of the chosen rules; every line is read once and exploded to its hits."""
    text = F.col("text")
    empty = F.array().cast("array<string>")
    said = []
    if literal:
        said.append(F.when(text.contains(SENSITIVE_REFERENCE), F.array(F.lit(SENSITIVE_MESSAGE))).otherwise(empty))
    open_ip = ~text.contains(X.ALLOW_IP_MARKER)
    if addresses:
        said.append(F.when(open_ip, ipv4_findings(text)).otherwise(empty))
        said.append(F.when(open_ip, ipv6_findings(text)).otherwise(empty))
    if secrets:
        said.append(secret_findings(text))
    return lines.select("path", "line", F.explode(F.concat(*said)).alias("message"))


def scan(lines: DataFrame) -> DataFrame:
    """All findings in one pass; sort by (path, line) to present them."""
    return _scan_once(lines, literal=True, addresses=True, secrets=True)


def leaking_rows(df: DataFrame, key: str, text: Column) -> DataFrame:
    """Keys of texts that still contain private-looking data."""
    return df.where(X.leaks(text)).select(key)
