from ledgerline.llm import urlfilter as U


def naive(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        rest = rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    fits = [(len(h + p), h.count("."), h + p, a) for a, h, p in rules if h is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"), ("block", "bad.net", ""), ("allow", "bad.net", ""), ("block", None, "/")]
URLS = [None, "", "no scheme", "http://a.example.org/es/x", "http://EXAMPLE.org/en/12?q", "http://example.org/en/2", "http://notexample.org/es/1", "http://com/de/", "http://x.com/de", "http://x.com/de/?a://b", "http://x.com?/de/", "http://bad.net", "http://sub.bad.net#x", "http://..org/", "http://É.ORG/a", "x://y://example.org/es/", "http://a.com/" + "d" * 100_000, "http://u@h.com:80/fr/1"]


def test_verdicts_equal_a_plain_scan(spark):
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(URLS)] + [(None, URLS[3], "h", "r"), (3, URLS[3], "h", "r")], "page_id bigint, url string, host string, rule string")
    rules = U.rule_table(spark, RULES)
    found = U.judge_urls(pages, rules).collect()
    assert len(found) == len(URLS) + 2
    for row in found:
        url = URLS[3 if row.page_id is None else row.page_id]
        assert (row.host, row.path, row.rule, row.verdict) == naive(url, RULES), url


def test_no_rules_and_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id bigint, url string")
    none = U.rule_table(spark, [])
    assert [(r.rule, r.verdict, r.n_rules) for r in U.judge_urls(pages, none, default="block").collect()] == [(None, "block", 0)]
    assert U.judge_urls(pages.limit(0), U.rule_table(spark, RULES)).count() == 0


def test_short_hash_clash_is_not_a_match(spark, monkeypatch):
    monkeypatch.setattr(U, "PREFIX_DIGITS", 0)
    pages = spark.createDataFrame([(1, "http://a.org/x"), (2, "http://b.de/x")], "page_id bigint, url string")
    found = {r.page_id: r.rule for r in U.judge_urls(pages, U.rule_table(spark, RULES)).collect()}
    assert found == {1: "org/", 2: None}
