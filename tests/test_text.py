"""Text scan, redaction, digests, pins, versions."""

import hashlib

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import normalize as N
from ledgerline.functions import paths as P
from ledgerline.functions import text as X
from ledgerline.operators import ranking as R
from ledgerline.operators import releases as L
from ledgerline.operators import scan as S
from ledgerline.sources.files import number_lines, unquote


def value(spark, column):
    return spark.range(1).select(column.alias("v")).collect()[0]["v"]


def lines(spark, *texts):
    return spark.createDataFrame([("f", i + 1, text) for i, text in enumerate(texts)], "path string, line int, text string")


@pytest.mark.parametrize(
    "line, messages",
    [
        ("use 192.0.2.10 and 198.51.100.7", []),
        ("host 10.0.0.5", ["non-example IP literal 10.0.0.5"]),
        ("host 100.64.1.1, 10.0.0.5", ["non-example IP literal 10.0.0.5", "non-example IP literal 100.64.1.1"]),
        ("addr fd00::1 here", ["non-example IP literal fd00::1"]),
        ("addr FD00:0:0:0:0:0:0:1", ["non-example IP literal fd00::1"]),
        ("2001:db8::5 is documentation", []),
        ("0.0.0.0 127.0.0.1 ::1", []),
        ("time 12:30:45 and a::b::c", []),
        ("::", ["non-example IP literal ::"]),
        ("std::vector and key::value", []),
        ("10.0.0.5 # public-safety: allow-ip", []),
        ("version 1.2.3.4.5 or 300.1.1.1 or 01.2.3.4", []),
    ],
)
def test_scan_ips(spark, rows, line, messages):
    assert [row[0] for row in rows(S.scan_ips(lines(spark, line)), "message")] == messages


@pytest.mark.parametrize(
    "line, messages",
    [
        ("API_TOKEN=abc123", ["secret-like assignment API_TOKEN=<redacted>"]),
        ("API_TOKEN=REPLACE_ME", []),
        ("API_TOKEN: ${VALUE}", []),
        ('PASSWORD = "hunter2"', ["secret-like assignment PASSWORD=<redacted>"]),
        ("PASSWORD = ''", []),
        ("password=hunter2", []),
        ("SECRET_KEYS = x", []),
        ("TOKEN_RE = re.compile", []),
        ("DB_PASSWORD = {", []),
        ("PASS_TOKEN==1.2.3", []),
        ("API_TOKEN=abc # public-safety: allow-secret", []),
        ("-----BEGIN RSA PRIVATE KEY-----", ["private key material"]),
        ("x ghp_abcdefghijklmnop", ["token-like literal"]),
        ("A_TOKEN=one B_SECRET=two", ["secret-like assignment A_TOKEN=<redacted>", "secret-like assignment B_SECRET=<redacted>"]),
    ],
)
def test_scan_secrets(spark, rows, line, messages):
    assert [row[0] for row in rows(S.scan_secrets(lines(spark, line)), "message")] == messages


def test_full_scan_counts_every_rule(spark, rows):
    found = rows(S.scan(lines(spark, "see private/x", "10.1.1.1", "A_SECRET=zz")))
    assert [(line, message) for _, line, message in found] == [
        (1, "repo-local sensitive directory reference"),
        (2, "non-example IP literal 10.1.1.1"),
        (3, "secret-like assignment A_SECRET=<redacted>"),
    ]


@pytest.mark.parametrize(
    "before, after",
    [
        ("Authorization: Bearer abc.def", "Authorization: <redacted>"),
        ("my_token=abc rest", "my_token=<redacted> rest"),
        ("sha " + "a" * 40 + " end", "sha <token> end"),
        ("ip 10.0.0.1.", "ip 10.0.0.1."),
        ("ip 10.0.0.1 10.0.0.2", "ip <ip> <ip>"),
        ("me@example.com", "<email>"),
        ("https://host/path x", "<url> x"),
        ("git@host:path/x y", "<ssh-url> y"),
        ("git@host.example:path y", "<email>:path y"),
    ],
)
def test_redact(spark, before, after):
    assert value(spark, X.redact(F.lit(before))) == after


def test_leaks(spark):
    assert value(spark, X.leaks(F.lit("at 10.2.3.4")))
    assert value(spark, X.leaks(F.lit("token: abc")))
    assert not value(spark, X.leaks(F.lit("at 192.0.2.5 on example.internal")))


@pytest.mark.parametrize("text", ["a\nb\n", "a\r\nb", "a\x0bb c", "", "\n", "one", "a\n\nb\n\n", "x\x85y\x1cz"])
def test_lines_match_python(spark, rows, text):
    frame = spark.createDataFrame([("p", text)], "path string, text string")
    got = rows(number_lines(frame, F.col("path"), F.col("text")))
    assert got == [("p", i + 1, line) for i, line in enumerate(text.splitlines())]


def test_tail_forms_agree(spark, rows):
    text = "\n".join(f"l{i}" for i in range(1, 8))
    frame = spark.createDataFrame([("p", text), ("q", "only")], "path string, text string")
    whole = rows(R.tail_of_text(frame, "path", "text", 3))
    assert whole == rows(R.tail_lines(number_lines(frame, F.col("path"), F.col("text")), ["path"], "line", 3))
    assert whole == [("p", 5, "l5"), ("p", 6, "l6"), ("p", 7, "l7"), ("q", 1, "only")]


def test_canonical_json_sorts_every_level(spark):
    frame = spark.createDataFrame([(1, {"z": "1", "a": "2"}, None)], "b int, m map<string,string>, a string")
    got = frame.select(X.canonical_json(F.struct(*frame.columns), frame.schema).alias("v")).collect()[0]["v"]
    assert got == '{"a":null,"b":1,"m":{"a":"2","z":"1"}}'


def test_signature_separates_values_and_matches_nulls(spark):
    sig = lambda a, b: value(spark, X.signature(F.lit(a), F.lit(b)))
    assert sig("a", None) == sig("a", None)
    assert len({sig("a", None), sig("a", "null"), sig("ab", "c"), sig("a", "bc")}) == 4


def test_check_digest(spark):
    body = "x"
    good = "sha256:" + hashlib.sha256(b"x").hexdigest()
    call = lambda header, expected: value(spark, X.check_digest(F.lit(body), F.lit(header), F.lit(expected).cast("string")))
    assert call(good, None)["digest"] == good
    assert call("", good)["digest"] == good
    assert call("", None)["error"] == "header is missing"
    assert call("sha256:" + "0" * 64, None)["error"] == "header does not match body"
    assert call(good, "sha256:" + "0" * 64)["error"] == "digest changed"


def test_image_pin_and_replace(spark):
    ref = "docker.io/lib/app:1.2@sha256:" + "a" * 64
    assert value(spark, X.parse_image(F.lit(ref))).asDict() == {"registry": "docker.io", "repository": "lib/app", "tag": "1.2", "digest": "a" * 64}
    assert value(spark, X.parse_image(F.lit("app:latest")))["tag"] is None
    text = "v: 1.0\nv: 2.0"
    assert value(spark, X.extract_pin(F.lit(text), r"(v: )([0-9.]+)")) == "1.0"
    assert value(spark, X.replace_once(F.lit(text), "[0-9]+[.]0", F.lit("9")))["text"] == "v: 9\nv: 2.0"
    assert value(spark, X.replace_once(F.lit(text), "absent", F.lit("9")))["error"] == "expected one match, found 0"


def natural(tag):
    import re

    return tuple((0, int(p)) if p.isdigit() else (1, p) for p in re.split(r"(\d+)", tag) if p)


def test_natural_order_matches_brute_force(spark):
    tags = ["1.10", "1.9", "1.9-rc1", "v2", "2", "10", "1", "1.9.0", "1.09", "a", "1a", "99999999999999999999999", "1." + "9" * 30, "1" * 41, "2" + "0" * 40, "0" * 50 + "3"]
    frame = spark.createDataFrame([(t,) for t in tags], "tag string")
    got = [r["tag"] for r in frame.orderBy(X.natural_key(F.col("tag")), "tag").collect()]
    assert got == sorted(tags, key=lambda t: (natural(t), t))


def test_rollbacks_and_series(spark, rows):
    frame = spark.createDataFrame([("1.9", "1.10"), ("1.10", "1.9"), ("2", "2")], "cur string, sel string")
    assert rows(L.rollbacks(frame, "cur", "sel")) == [("1.10", "1.9")]
    assert not value(spark, X.matches_series(F.lit("1.2\n"), r"\d\.\d"))


def test_lock_rules(spark):
    good = "# for x\nalpha==1.0 \\\n    --hash=sha256:" + "a" * 64 + "\nbeta[x]==2 \\\n    --hash=sha256:" + "b" * 64 + "\n"
    check = lambda text, n=2: value(spark, L.check_lock(F.lit(text), n, needed=("for x",)))
    assert check(good) == []
    assert check(good, 3) == ["wrong number of entries"]
    assert "entry without digest" in check("# for x\nalpha==1.0 \\\nbeta==2 \\\n    --hash=sha256:" + "b" * 64)
    assert check(good + "--extra-index-url http://x\n") == ["forbidden origin"]
    assert check(good.replace("for x", "")) == ["missing text: for x"]


def test_lock_pins_its_own_package(spark):
    digest = "a" * 64
    good = f"tool[web,x]==1.0 \\\n    --hash=sha256:{digest}\n"
    check = lambda text, version="1.0", checksum=digest: value(spark, L.check_lock(F.lit(text), 1, package="tool", version=F.lit(version), checksum=F.lit(checksum)))
    assert check(good) == check(good, checksum=None) == []
    assert check(good, version="1.0.1") == check(good, version=None) == ["own pin is missing"]
    assert check(good, checksum="b" * 64) == ["own digest is missing"]
    assert check(good.replace("tool[", "tools[")) == ["own pin is missing"]
    assert check(good.replace("[web,x]", "")) == ["own pin is missing"]


def test_link_resolution(spark):
    call = lambda member, link, hard=False: value(spark, P.resolve_link(F.lit(member), F.lit(link), F.lit(hard)))
    assert call("a/b/file", "../c")["path"] == "a/c"
    assert call("a/b/file", "x/./y", True)["path"] == "x/y"
    assert call("file", "../x")["error"] == "link target escapes root"
    assert call("a/file", "/x")["error"] == "absolute link target"
    assert call("a/file", "..")["error"] == "empty link target"


def test_paths_and_formats(spark):
    err = lambda p: value(spark, P.path_error(F.lit(p)))
    assert [err(p) for p in ("a/b", "/a", "a/../b", "", "./")] == [None, "absolute path", "parent reference", "empty path", "empty path"]
    fmt = lambda t, r: value(spark, P.has_format(F.lit(t), r))
    assert fmt("a.example.com", "dns_name") and not fmt("-a.com", "dns_name") and not fmt("", "dns_name")
    assert fmt("20240101T000000Z-0a1b2c3d", "episode_id") and not fmt("20240101T000000Z-0A1B2C3D", "episode_id")


@pytest.mark.parametrize(
    "seconds, age, duration",
    [(0, "0s", "0s"), (59, "59s", "59s"), (60, "1m", "1m00s"), (3599, "59m", "59m59s"), (3600, "1h", "1h00m"), (172799, "47h", "47h59m"), (172800, "2d", "48h00m")],
)
def test_age_and_duration(spark, seconds, age, duration):
    start, now = F.lit(1000), F.lit(1000 + seconds).cast("bigint")
    assert value(spark, N.age_text(start, now)) == age
    assert value(spark, N.duration_text(start, F.lit(0), now)) == duration


def test_age_edge_cases(spark):
    now = F.lit(500).cast("bigint")
    assert value(spark, N.age_text(F.lit("x"), now)) == "-"
    assert value(spark, N.age_text(F.lit(0), now)) == "-"
    assert value(spark, N.duration_text(F.lit(400), F.lit(300), now)) == "0s"


def test_lists_hex_and_addresses(spark):
    got = value(spark, N.parse_list(F.lit('["a","b"]')))
    assert got["items"] == ["a", "b"] and got["error"] is None
    assert value(spark, N.parse_list(F.lit("ssh-ed25519 AAA")))["items"] == ["ssh-ed25519 AAA"]
    assert value(spark, N.parse_list(F.lit("[1]")))["error"] and value(spark, N.parse_list(F.lit("{}")))["error"]
    assert value(spark, N.narrow_hex(F.lit("AB" * 32))) == "ab" * 16
    assert value(spark, N.narrow_hex(F.lit("AB" * 16))) == "AB" * 16
    assert value(spark, N.ipv4_range(F.lit("192.0.2.254"), 3)) == ["192.0.2.254", "192.0.2.255", "192.0.3.0"]
    assert value(spark, N.ipv4_to_long(F.lit("1.2.3.999"))) is None
    assert value(spark, N.replace_last_octet(F.lit("dhcp"), 9)) == "192.0.2.9"
    assert value(spark, N.rewrite_endpoint(F.lit("wss://h/x//"), "/sql")) == "https://h/x/sql"
    assert value(spark, N.rewrite_endpoint(F.lit("ftp://h"), "/sql")) is None


def test_times(spark):
    utc = lambda t: value(spark, N.utc_text(N.to_utc(F.lit(t))))
    assert utc("2024-01-01T01:00:00+01:00") == "2024-01-01T00:00:00Z"
    assert utc("2024-01-01T00:00:00.5Z") == "2024-01-01T00:00:00.500000Z"
    assert utc("2024-01-01") == "2024-01-01T00:00:00Z"
    assert utc("soon") is None
    assert utc("2024-01-01T00:00:00.123456789Z") == "2024-01-01T00:00:00.123456Z"
    assert utc("2024-01-01T01:00:00+0100") == utc("2024-01-01T01:00+01") == utc("20240101T000000Z") == "2024-01-01T00:00:00Z"
    assert utc("2024-0101") is None and utc("2024-01-01T") is None and utc("2024-01-01T00:00:00,5") == "2024-01-01T00:00:00.500000Z"


def test_normalize_json_rejects_non_finite(spark):
    call = lambda t: value(spark, N.normalize_json(F.lit(t)))
    assert call('{"b": [{"tb": "x", "id": {"String": "7"}}], "a": 1}')["value"] == '{"a":1,"b":["7"]}'
    assert call('{"a": NaN}')["error"] == "non-finite numeric value"


@pytest.mark.parametrize("text, good", [('["a,null,b"]', True), ('["a", null]', False), ("[]", True), ('["a", 1]', False), ('"a"', False), ('{"a": 1}', False), (None, True)])
def test_string_arrays(spark, text, good):
    assert value(spark, N.is_string_array(F.parse_json(F.lit(text).cast("string")))) == good


@pytest.mark.parametrize(
    "text, good",
    [("10.0.0.0/8", True), ("10.0.0.0/32", True), ("0.0.0.0/0", True), ("10.0.0.0/33", False), ("10.0.0.256/8", False), ("10.0.0.0", False), ("10.0.0.0/", False), ("10.0.0.0/08", False), (None, False)],
)
def test_address_blocks(spark, text, good):
    assert value(spark, N.is_cidr(F.lit(text).cast("string"))) == good


def test_vector_literal_with_exponents(spark):
    assert value(spark, N.vector_literal(F.array(F.lit(1e-10), F.lit(0.1), F.lit(1e20)))) == "[1.0E-10,0.1,1.0E20]"


def test_strip_takes_all_white_space(spark):
    assert value(spark, X.strip(F.lit("\t\u00a0 a b\x0b\u3000\n"))) == "a b"


@pytest.mark.parametrize(
    "raw, want, error",
    [
        ("a", "a", None), ("'two words'", "two words", None), ('"x\\"y"', 'x"y', None), ('"a\\b"', "a\\b", None), ("a\\ b", "a b", None), ("''", "", None), ("a'b'\"c\"", "abc", None),
        ("'open", None, "a quote or an escape is not closed"), ("a b", None, "not exactly one value"), ("", None, "not exactly one value"), ("a\\", None, "a quote or an escape is not closed"),
    ],
)
def test_unquoting(spark, raw, want, error):
    found = value(spark, unquote(F.lit(raw)))
    assert (found["value"], found["error"]) == (want, error)
