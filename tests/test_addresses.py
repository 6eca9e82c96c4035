"""128-bit addresses against the standard library."""

import ipaddress
import random

from pyspark.sql import functions as F

from ledgerline.functions import addresses as A
from ledgerline.operators import scan as S


def texts(seed=5, count=3000):
    """Valid addresses in many spellings, and near misses."""
    rng = random.Random(seed)
    out = ["", ":", "::", ":::", "1::", "::1", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1::2::3", "0:0:1:0:0:1:1:1", "1:0:0:0:0:0:0:0",
           "0:0:0:0:0:0:0:0", "::ffff:192.0.2.1", "::ffff:1.2.3.04", "::1.2.3.4", ":1.2.3.4", "1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "12345::", "g::", ":1::", "1:::2",
           "2001:DB8::1", "2001:db9::", "fe80::1", "8000::8000", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4::5:6:7:8", "::\n", "1::2.3.4", "1.2.3.4::"]
    for _ in range(count):
        groups = [rng.choice(["0", "0", "0000", "1", "00a", "ABCD", "ffff", "8000", f"{rng.randrange(65536):x}"]) for _ in range(rng.choice([8, 8, 8, 7, 6, 3, 9]))]
        text = ":".join(groups)
        if rng.random() < 0.6:
            at = rng.randrange(len(groups))
            text = ":".join(groups[:at]) + "::" + ":".join(groups[at + rng.randrange(1, 4):])
        if rng.random() < 0.2:
            text = text[: text.rfind(":") + 1] + rng.choice(["1.2.3.4", "255.255.0.1", "01.2.3.4", "1.2.3"])
        if rng.random() < 0.1:
            text = text.replace("0", ":", 1)
        out.append(text)
    return out


def parsed(text):
    try:
        return ipaddress.IPv6Address(text)
    except (ValueError, TypeError):
        return None


def test_addresses_against_the_library(spark):
    given = [*texts(), None]
    network = "2001:db8::/32"
    frame = spark.createDataFrame([(t,) for t in given], "t string").select("t", A.ipv6_to_longs(F.col("t")).alias("a"))
    frame = frame.select("t", "a", A.ipv6_text(F.col("a")).alias("c"), A.ipv6_in(F.col("a"), network).alias("n"), A.ipv6_in(F.col("a"), "8000::/1").alias("h"), A.ipv6_equals(F.col("a"), "fe80::1").alias("e"))
    assert "Python" not in frame._jdf.queryExecution().toString()
    valid = 0
    for t, a, c, n, h, e in frame.collect():
        want = parsed(t)
        if want is None:
            assert (a, c, n, e) == (None, None, None, None), t
            continue
        valid += 1
        assert (a.high % 2**64 << 64) + a.low % 2**64 == int(want), t
        assert c == str(want), t
        assert n == (want in ipaddress.ip_network(network)), t
        assert h == (int(want) >> 127 == 1), t
        assert e == (want == ipaddress.ip_address("fe80::1")), t
    assert valid > 800


def test_addresses_of_long_prefixes(spark):
    frame = spark.createDataFrame([("2001:db8::ff",), ("2001:db8::100",)], "t string")
    inside = frame.select(A.ipv6_in(A.ipv6_to_longs(F.col("t")), "2001:db8::/120").alias("x")).collect()
    assert [r.x for r in inside] == [True, False]


def test_findings_of_both_families(spark, rows):
    lines = spark.createDataFrame(
        [("a", 1, "from FE80:0:0::1 to 2001:db8::7, 10.1.2.3 and 192.0.2.9"), ("a", 2, "fe80::2 public-safety: allow-ip"), ("a", 3, "at 10:20:30 or 1::2::3"), ("b", 1, None), ("b", 2, "")],
        "path string, line int, text string",
    )
    want = [("a", 1, "non-example IP literal 10.1.2.3"), ("a", 1, "non-example IP literal fe80::1")]
    assert rows(S.scan_ips(lines)) == want
    assert rows(S.scan_ipv6(lines)) == want[1:]
    assert rows(S.scan(lines)) == want
    assert "Python" not in S.scan(lines)._jdf.queryExecution().toString()
