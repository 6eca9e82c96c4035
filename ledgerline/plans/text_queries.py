"""Queries over text: lines, findings, redaction, pins, digests, versions.

RE2, which the SQL side uses, has no look-around.  An address candidate is by its
look-arounds exactly a maximal run of digits and dots, so the SQL takes such runs.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions import text as X
from ledgerline.operators import ranking as R
from ledgerline.operators import releases as L
from ledgerline.operators import scan as S
from ledgerline.plans.registry import query
from ledgerline.skew import spread
from ledgerline.sources.files import number_lines

BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def lines_sql(table: str, key: str, column: str, name: str = "path") -> str:
    """Numbered lines of a text column, as SQL."""
    return f"""
SELECT {name}, line, parts[line] AS text FROM (
  SELECT {name}, parts, unnest(range(1, len(parts) + 1)) AS line FROM (
    SELECT CAST({key} AS VARCHAR) AS {name},
           CASE WHEN p[-1] = '' THEN p[1:len(p) - 1] ELSE p END AS parts
    FROM (SELECT {key}, regexp_split_to_array({column}, '{BREAK}') AS p FROM {table})))"""


def docs(t, *columns):
    """Documents for work that is heavy per row."""
    return spread(t.documents.select(*columns))


def doc_lines(t):
    return number_lines(docs(t, "doc_id", "text"), F.col("doc_id").cast("string"), F.col("text"))


@query("numbered_lines", lines_sql("documents", "doc_id", "text"))
def numbered_lines(t):
    return doc_lines(t)


@query(
    "tail_of_text",
    f"""
SELECT page_id, line, text FROM (SELECT CAST(path AS BIGINT) AS page_id, line, text,
   row_number() OVER (PARTITION BY path ORDER BY line DESC) AS rn FROM ({lines_sql("pages", "page_id", "html")})) WHERE rn <= 3""",
)
def tail_of_text(t):
    return R.tail_of_text(t.pages, "page_id", "html", 3)


@query(
    "tail_lines",
    f"""
SELECT path, line, text FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line DESC) AS rn
   FROM ({lines_sql("documents", "doc_id", "text")})) WHERE rn <= 5""",
)
def tail_lines(t):
    return R.tail_lines(doc_lines(t), ["path"], "line", 5)


def ipv4_sql(lines: str) -> str:
    octet = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    return f"""
SELECT path, line, 'non-example IP literal ' || ip AS message FROM (
  SELECT path, line, unnest(regexp_extract_all(text, '[0-9.]+')) AS ip FROM ({lines})
  WHERE NOT contains(text, 'public-safety: allow-ip'))
WHERE regexp_full_match(ip, '({octet}\\.){{3}}{octet}')
  AND ip NOT IN ('1.1.1.1', '1.0.0.2', '1.1.1.2', '9.9.9.9', '149.112.112.112', '127.0.0.1', '0.0.0.0')
  AND NOT starts_with(ip, '192.0.2.') AND NOT starts_with(ip, '198.51.100.') AND NOT starts_with(ip, '203.0.113.')"""


@query("scan_ipv4", ipv4_sql(lines_sql("documents", "doc_id", "text")))
def scan_ipv4(t):
    return S.scan_ipv4(doc_lines(t))


@query("scan_ips")
def scan_ips(t):
    """Both families, as column expressions."""
    return S.scan_ips(doc_lines(t))


def secrets_sql(lines: str, flags: str = "") -> str:
    name = r"([A-Z0-9_]*(?:TOKEN|PASSWORD|SECRET|API_KEY|PASS)[A-Z0-9_]*)"
    marks = ["REPLACE", "example.", "{{", "}}", "<redacted>", "<secret>", "...", "var.", "os.environ", "os.getenv", "$"]
    holder = " OR ".join(f"contains(bare, '{mark}')" for mark in marks)
    return f"""
WITH open_lines AS (SELECT * FROM ({lines}) WHERE NOT contains(text, 'public-safety: allow-secret')
  AND NOT regexp_full_match(text, '\\s*[A-Za-z0-9_.-]+==[A-Za-z0-9_.!+-]+\\s*')),
pairs AS (SELECT path, line, unnest(regexp_extract_all(text, '{flags}\\b{name}\\s*[=:]\\s*([^\\s#]+)', 1)) AS k,
                 unnest(regexp_extract_all(text, '{flags}\\b{name}\\s*[=:]\\s*([^\\s#]+)', 2)) AS v FROM open_lines),
cleaned AS (SELECT *, trim(v, '"''') AS bare, trim(v, '"'') ,:') AS plain FROM pairs)
SELECT path, line, 'private key material' AS message FROM open_lines
  WHERE regexp_matches(text, 'BEGIN (?:RSA |OPENSSH |EC |DSA )?PRIVATE KEY')
UNION ALL SELECT path, line, 'token-like literal' FROM open_lines
  WHERE regexp_matches(text, '\\b(ghp_|github_pat_|glpat-|xoxb-|sk-)[A-Za-z0-9_\\-]{{10,}}')
UNION ALL SELECT path, line, 'secret-like assignment ' || k || '=<redacted>' FROM cleaned
  WHERE NOT ends_with(upper(k), '_RE') AND NOT starts_with(lower(k), 'old_') AND k <> 'SECRET_KEYS'
    AND plain NOT IN ('str', 'None', '{{') AND bare <> '' AND NOT ({holder})"""


# A line per page with something planted: real and exempt assignments, pinned packages, addresses of both families, a folder name.
PLANTED = """
SELECT 'page/' || page_id AS path, 1 AS line, CASE page_id % 12
  WHEN 0 THEN 'API_TOKEN=' || md5(url) WHEN 1 THEN 'export DB_PASSWORD: "' || md5(url) || '",' WHEN 2 THEN 'MAIN_SECRET={{ vault }}'
  WHEN 3 THEN chr(9) || 'NAME_TOKEN==1.0' WHEN 4 THEN '-----BEGIN RSA PRIVATE KEY-----' WHEN 5 THEN 'use ghp_' || md5(url)
  WHEN 6 THEN 'at 2606:4700::6810:' || page_id WHEN 7 THEN 'at 2001:db8::' || page_id || ' and ::1 or 12:30:45'
  WHEN 8 THEN 'at 10.1.2.' || page_id % 256 WHEN 9 THEN 'at FE80:0::0:' || page_id WHEN 10 THEN 'see private/' || page_id ELSE url END AS text FROM pages"""


def planted(t):
    c = F.col
    kind, key, digest = c("page_id") % 12, c("page_id").cast("string"), F.md5("url")
    line = (
        F.when(kind == 0, F.concat(F.lit("API_TOKEN="), digest)).when(kind == 1, F.concat(F.lit('export DB_PASSWORD: "'), digest, F.lit('",')))
        .when(kind == 2, F.lit("MAIN_SECRET={{ vault }}")).when(kind == 3, F.lit("\tNAME_TOKEN==1.0")).when(kind == 4, F.lit("-----BEGIN RSA PRIVATE KEY-----"))
        .when(kind == 5, F.concat(F.lit("use ghp_"), digest)).when(kind == 6, F.concat(F.lit("at 2606:4700::6810:"), key))
        .when(kind == 7, F.concat(F.lit("at 2001:db8::"), key, F.lit(" and ::1 or 12:30:45"))).when(kind == 8, F.concat(F.lit("at 10.1.2."), c("page_id") % 256))
        .when(kind == 9, F.concat(F.lit("at FE80:0::0:"), key)).when(kind == 10, F.concat(F.lit("see private/"), key)).otherwise(c("url"))
    )
    return t.pages.select(F.concat(F.lit("page/"), key).alias("path"), F.lit(1).alias("line"), line.alias("text"))


DOCUMENT_AND_PLANTED = f"SELECT path, line, text FROM ({lines_sql('documents', 'doc_id', 'text')}) UNION ALL SELECT * FROM ({PLANTED})"


@query("scan_secrets", secrets_sql(DOCUMENT_AND_PLANTED))
def scan_secrets(t):
    """Documents hold lower-case names only, which are no finding; the planted lines hold real and exempt ones."""
    return S.scan_secrets(doc_lines(t).unionByName(planted(t)))


# Known answers for the planted IPv6 addresses: canonical text, documentation range left out.
IPV6_FINDINGS = """
SELECT 'page/' || page_id AS path, 1 AS line, 'non-example IP literal 2606:4700::6810:' || page_id AS message FROM pages WHERE page_id % 12 = 6
UNION ALL SELECT 'page/' || page_id, 1, 'non-example IP literal fe80::' || page_id FROM pages WHERE page_id % 12 = 9
UNION ALL SELECT 'page/' || page_id, 1, 'non-example IP literal ::1' FROM pages WHERE page_id % 12 = 7 AND LOOPBACK"""


@query("scan_ips_planted", f"{ipv4_sql(PLANTED)} UNION ALL {IPV6_FINDINGS.replace('LOOPBACK', str('::1' not in X.ALLOWED_IPS).lower())}")
def scan_ips_planted(t):
    return S.scan_ips(planted(t))


@query(
    "full_scan_planted",
    f"""SELECT * FROM ({ipv4_sql(PLANTED)}) UNION ALL {IPV6_FINDINGS.replace('LOOPBACK', str('::1' not in X.ALLOWED_IPS).lower())}
UNION ALL SELECT * FROM ({secrets_sql(PLANTED)})
UNION ALL SELECT path, line, '{S.SENSITIVE_MESSAGE}' FROM ({PLANTED}) WHERE contains(text, '{S.SENSITIVE_REFERENCE}')""",
)
def full_scan_planted(t):
    """Everything that a full scan looks for, with known answers."""
    return S.scan(planted(t))


@query("scan_secrets_any_case", secrets_sql(lines_sql("documents", "doc_id", "text"), "(?i)"))
def scan_secrets_any_case(t):
    """The same rules without regard to letter case: our addition, as the tables hold lower-case names only."""
    return S.scan_secrets(doc_lines(t), X.SECRET_ASSIGNMENT.replace("(?U)", "(?iU)"), ())


@query(
    "literal_scan",
    f"SELECT path, line, 'mentions example.com' AS message FROM ({lines_sql('pages', 'page_id', 'html')}) WHERE contains(text, 'example.com')",
)
def literal_scan(t):
    lines = number_lines(t.pages, F.col("page_id").cast("string"), F.col("html"))
    return S.scan_literal(lines, "example.com", "mentions example.com")


DOC_LINES = lines_sql("documents", "doc_id", "text")


@query("full_scan")
def full_scan(t):
    """Literal, address (both families) and secret findings over documents and pages."""
    pages = number_lines(t.pages, F.concat(F.lit("page/"), F.col("page_id")), F.col("html"))
    return S.scan(doc_lines(t).unionByName(pages))


@query(
    "full_scan_ipv4",
    f"""
SELECT path, line, 'repo-local sensitive directory reference' AS message FROM ({DOC_LINES}) WHERE contains(text, 'private/')
UNION ALL {ipv4_sql(DOC_LINES)}
UNION ALL SELECT * FROM ({secrets_sql(DOC_LINES)})""",
)
def full_scan_ipv4(t):
    lines = doc_lines(t)
    found = S.scan_literal(lines, S.SENSITIVE_REFERENCE, S.SENSITIVE_MESSAGE)
    return found.unionByName(S.scan_ipv4(lines)).unionByName(S.scan_secrets(lines))


def redact_sql(column: str) -> str:
    ip = r"(^|[^0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}($|[^0-9.])"
    steps = [
        (r"(?i)(authorization:\s*)(?:basic|bearer)?\s*[^\s]+", r"\1<redacted>"),
        (r"(?i)\b([A-Z0-9_]*(?:TOKEN|SECRET|PASSWORD|PASS|API_KEY)[A-Z0-9_]*)=([^\s]+)", r"\1=<redacted>"),
        (r"\b[0-9a-fA-F]{40,}\b", "<token>"),
        (ip, r"\1<ip>\2"),
        (ip, r"\1<ip>\2"),
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "<email>"),
        (r"https?://[^\s]+", "<url>"),
        (r"git@[^\s:]+:[^\s]+", "<ssh-url>"),
    ]
    for pattern, replacement in steps:
        column = f"regexp_replace({column}, '{pattern}', '{replacement}', 'g')"
    return column


@query("redact", f"SELECT doc_id, {redact_sql('text')} AS text FROM documents")
def redact(t):
    return docs(t, "doc_id", "text").select("doc_id", X.redact(F.col("text")).alias("text"))


def leaks_sql(column: str) -> str:
    scrubbed = f"replace(replace({column}, '192.0.2.', '198.51.100.'), 'example.internal', 'example.invalid')"
    patterns = [
        r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
        r"\b(?:10|127)\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
        r"\b172\.(?:1[6-9]|2\d|3[0-1])\.\d{1,3}\.\d{1,3}\b",
        r"\b192\.168\.\d{1,3}\.\d{1,3}\b",
        r"(?i)\b(?:token|password|secret|authkey|api[_-]?key)\s*[:=]\s*[^\s]+",
    ]
    return "(" + " OR ".join(f"regexp_matches({scrubbed}, '{pattern}')" for pattern in patterns) + ")"


@query(
    "leak_assert",
    f"""
SELECT 'raw' AS stage, doc_id FROM documents WHERE {leaks_sql('text')}
UNION ALL SELECT 'redacted', doc_id FROM documents WHERE {leaks_sql(redact_sql('text'))}""",
)
def leak_assert(t):
    raw = S.leaking_rows(docs(t, "doc_id", "text"), "doc_id", F.col("text")).withColumn("stage", F.lit("raw"))
    clean = S.leaking_rows(docs(t, "doc_id", "text"), "doc_id", X.redact(F.col("text"))).withColumn("stage", F.lit("redacted"))
    return raw.unionByName(clean)


@query("marker_filter", f"SELECT path, line, text FROM ({DOC_LINES}) WHERE NOT contains(text, 'the ')")
def marker_filter(t):
    return S.without_marker(doc_lines(t), "the ")


@query(
    "not_default",
    """
SELECT path, line, digest FROM (SELECT path, line, sha256(text) AS digest FROM (""" + DOC_LINES + """))
WHERE digest NOT IN (SELECT sha256(unnest(regexp_split_to_array(text, '\\n'))) FROM benchmark)""",
)
def not_default(t):
    """Lines of documents that are not known lines of the benchmark texts."""
    known = t.benchmark.select(F.explode(F.split("text", "\n")).alias("line")).select(F.sha2("line", 256).alias("digest"))
    lines = doc_lines(t).select("path", "line", F.sha2("text", 256).alias("digest"))
    return S.not_default(lines, F.col("digest"), known)


@query("digests", "SELECT doc_id, sha256(text) AS digest FROM documents")
def digests(t):
    return t.documents.select("doc_id", X.sha256(F.col("text")).alias("digest"))


@query(
    "row_signature",
    """
SELECT min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY lang, text HAVING count(*) > 1""",
)
def row_signature(t):
    """Equal rows are found through one digest, which keeps texts out of the shuffle."""
    signed = t.documents.select("doc_id", X.signature(F.col("lang"), F.col("text")).alias("sig"))
    groups = signed.groupBy("sig").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    return groups.where("copies > 1").drop("sig")


@query(
    "canonical_json",
    """
SELECT c_custkey, '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","c_nationkey":' || c_nationkey ||
       ',"place":{"a_segment":"' || c_mktsegment || '","z_key":' || c_custkey || '}}' AS line FROM customer""",
)
def canonical_json(t):
    place = F.struct(F.col("c_custkey").alias("z_key"), F.col("c_mktsegment").alias("a_segment"))
    rows = t.customer.select("c_nationkey", "c_name", place.alias("place"), "c_custkey")
    return rows.select("c_custkey", X.canonical_json(F.struct(*rows.columns), rows.schema).alias("line"))


@query(
    "canonical_numbers",
    """
WITH v AS (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice *
    (CASE (l_orderkey + l_linenumber) % 8 WHEN 0 THEN 1e12 WHEN 1 THEN 1e-9 WHEN 2 THEN 1e22 WHEN 3 THEN -1e5 WHEN 4 THEN 1e-7 WHEN 5 THEN 1e300 WHEN 6 THEN 1 ELSE 0 END)::DOUBLE AS price FROM lineitem)
SELECT l_orderkey, l_linenumber, '{"at":[' || CAST(price AS VARCHAR) || ',null],"key":' || l_orderkey || ',"quantity":' || CAST(l_quantity AS VARCHAR) || '}' AS line FROM v""",
)
def canonical_numbers(t):
    """C7 on doubles from 1e-8 to 1e305, in an array and beside other fields."""
    kind = (F.col("l_orderkey") + F.col("l_linenumber")) % 8
    factor = F.lit(0.0)
    for at, by in enumerate((1e12, 1e-9, 1e22, -1e5, 1e-7, 1e300, 1.0)):
        factor = F.when(kind == at, F.lit(by)).otherwise(factor)
    price = F.array(F.col("l_extendedprice") * factor, F.lit(None).cast("double"))
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.struct(F.col("l_quantity").alias("quantity"), F.col("l_orderkey").alias("key"), price.alias("at")).alias("row"))
    return rows.select("l_orderkey", "l_linenumber", X.canonical_json(F.col("row"), rows.schema["row"].dataType).alias("line"))


@query(
    "digest_check",
    """
WITH p AS (SELECT page_id, 'sha256:' || sha256(html) AS computed,
   CASE WHEN ends_with(url, '#top') THEN 'sha256:' || sha256(url) WHEN starts_with(url, 'https') THEN 'sha256:' || sha256(html) ELSE '' END AS header,
   CASE WHEN contains(url, '/en/') THEN 'sha256:' || sha256(html) WHEN contains(url, '/fr/') THEN 'sha256:' || sha256(url) END AS expected FROM pages)
SELECT page_id, CASE WHEN error IS NULL THEN computed END AS digest, error FROM (
  SELECT *, CASE WHEN header <> '' AND header <> computed THEN 'header does not match body'
                 WHEN header = '' AND expected IS DISTINCT FROM computed THEN 'header is missing'
                 WHEN expected IS NOT NULL AND expected <> computed THEN 'digest changed' END AS error FROM p)""",
)
def digest_check(t):
    of = lambda name: F.concat(F.lit("sha256:"), F.sha2(F.col(name), 256))
    url = F.col("url")
    header = F.when(url.endswith("#top"), of("url")).when(url.startswith("https"), of("html")).otherwise(F.lit(""))
    expected = F.when(url.contains("/en/"), of("html")).when(url.contains("/fr/"), of("url"))
    checked = t.pages.select("page_id", X.check_digest(F.col("html"), header, expected).alias("c"))
    return checked.select("page_id", "c.digest", "c.error")


IMAGE_SQL = """lower(replace(p_name, ' ', '/')) || ':' || p_size || '.' || p_partkey || CASE WHEN p_type = 'SMALL' THEN '' ELSE '@sha256:' || sha256(p_name) END"""


@query(
    "image_parse",
    f"""
SELECT p_partkey, regexp_extract(ref, r, 1) AS registry, regexp_extract(ref, r, 2) AS repository, regexp_extract(ref, r, 3) AS tag, regexp_extract(ref, r, 4) AS digest
FROM (SELECT p_partkey, 'docker.io/' || {IMAGE_SQL} AS ref,
      '^(docker\\.io)/([a-z0-9][a-z0-9._/-]*):([^@\\s]+)@sha256:([0-9a-f]{{64}})$' AS r FROM part WHERE p_type <> 'SMALL')
UNION ALL SELECT p_partkey, NULL, NULL, NULL, NULL FROM part WHERE p_type = 'SMALL'""",
)
def image_parse(t):
    tail = F.when(F.col("p_type") == "SMALL", F.lit("")).otherwise(F.concat(F.lit("@sha256:"), F.sha2("p_name", 256)))
    ref = F.concat(
        F.lit("docker.io/"), F.lower(F.replace(F.col("p_name"), F.lit(" "), F.lit("/"))), F.lit(":"), F.col("p_size"), F.lit("."), F.col("p_partkey"), tail
    )
    return t.part.select("p_partkey", X.parse_image(ref).alias("i")).select("p_partkey", "i.*")


@query(
    "pin_capture",
    r"""
SELECT page_id, CASE WHEN regexp_matches(html, '(?m)<html lang="([a-z]+)">') THEN regexp_extract(html, '<html lang="([a-z]+)">', 1) END AS pin,
       coalesce(regexp_extract(html, '<html lang="([a-z]+)">', 1) = 'en' AND regexp_extract(html, 'charset="([^"]+)"', 1) = 'utf-8', false) AS is_default
FROM pages""",
)
def pin_capture(t):
    html = F.col("html")
    defaults = [(r'(<html lang=")([a-z]+)">', "en"), (r'(charset=")([^"]+)"', "utf-8")]
    return t.pages.select(
        "page_id", X.extract_pin(html, defaults[0][0]).alias("pin"), X.is_default_pin(html, defaults).alias("is_default")
    )


@query(
    "replace_once",
    r"""
SELECT doc_id, CASE WHEN regexp_matches(text, '[0-9]+') THEN regexp_replace(text, '[0-9]+', '<n>') END AS text,
       CASE WHEN NOT regexp_matches(text, '[0-9]+') THEN 'expected one match, found 0' END AS error FROM documents""",
)
def replace_once(t):
    return t.documents.select("doc_id", X.replace_once(F.col("text"), "[0-9]+", F.lit("<n>")).alias("r")).select("doc_id", "r.*")


@query(
    "natural_order",
    """
SELECT group_name, version FROM (
  SELECT p_type AS group_name, v AS version, row_number() OVER (PARTITION BY p_type ORDER BY a DESC, b DESC, c DESC) AS rn
  FROM (SELECT p_type, p_size || '.' || p_partkey || '.' || substr(p_brand, 7) AS v, p_size AS a, p_partkey AS b, CAST(substr(p_brand, 7) AS INT) AS c FROM part))
WHERE rn = 1""",
)
def natural_order(t):
    version = F.concat_ws(".", "p_size", "p_partkey", F.substring("p_brand", 7, 10))
    rows = t.part.select(F.col("p_type").alias("group_name"), version.alias("version"))
    return R.max_version(rows, ["group_name"], "version")


@query(
    "rollback_check",
    """
SELECT p_partkey FROM part WHERE (CAST(substr(p_brand, 7) AS INT), p_size) < (p_size, CAST(substr(p_brand, 7) AS INT))""",
)
def rollback_check(t):
    brand = F.substring("p_brand", 7, 10)
    rows = t.part.select(
        "p_partkey", F.concat_ws(".", "p_size", brand).alias("current"), F.concat_ws(".", brand, "p_size").alias("selected")
    )
    return L.rollbacks(rows, "current", "selected").select("p_partkey")


@query(
    "series_filter",
    "SELECT p_partkey FROM part WHERE regexp_full_match(p_brand, 'Brand#1[0-9]') AND regexp_full_match(p_name, '(red|hot|blue) [a-z]+')",
)
def series_filter(t):
    wanted = X.matches_series(F.col("p_brand"), "Brand#1[0-9]") & X.matches_series(F.col("p_name"), "(red|hot|blue) [a-z]+")
    return t.part.where(wanted).select("p_partkey")


@query(
    "line_blocks",
    f"""
WITH l AS (SELECT CAST(path AS BIGINT) AS doc_id, line, text, regexp_matches(text, '^[A-Z][a-z]+ ') AS header FROM ({DOC_LINES})),
b AS (SELECT *, sum(CASE WHEN header THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) AS block FROM l)
SELECT doc_id, CAST(count(DISTINCT block) AS INTEGER) AS entries, CAST(count(DISTINCT block) FILTER (WHERE has_digit) AS INTEGER) AS with_digit
FROM (SELECT doc_id, block, bool_or(regexp_matches(text, '[0-9]')) AS has_digit FROM b WHERE block > 0 GROUP BY ALL) GROUP BY doc_id""",
)
def line_blocks(t):
    """Blocks that begin with a capitalised word, and how many of them hold a digit."""
    split = r"(?m)(?=^[A-Z][a-z]+ )"
    text = F.concat_ws("\n", X.split_lines(F.col("text")))
    entries = F.filter(L.blocks(text, split), lambda block: block.rlike(rf"\A{split}"))
    counted = docs(t, "doc_id", "text").select(
        "doc_id", F.size(entries).alias("entries"), F.size(F.filter(entries, lambda block: block.rlike("[0-9]"))).alias("with_digit")
    )
    return counted.where("entries > 0")


@query(
    "lock_check",
    f"""
WITH l AS (SELECT CAST(path AS BIGINT) AS doc_id, line, text, regexp_matches(text, '^[A-Z][a-z]+ ') AS header FROM ({DOC_LINES})),
b AS (SELECT *, sum(CASE WHEN header THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) AS block FROM l),
e AS (SELECT doc_id, count(DISTINCT block) FILTER (WHERE block > 0) AS n FROM b GROUP BY doc_id),
d AS (SELECT doc_id, bool_or(NOT has) AS lacking FROM (SELECT doc_id, block, bool_or(regexp_matches(text, '[0-9]')) AS has FROM b WHERE block > 0 GROUP BY ALL) GROUP BY doc_id),
u AS (SELECT doc_id, bool_or(contains(text, '@')) AS origin FROM l GROUP BY doc_id)
SELECT doc_id, concat_ws('; ', CASE WHEN n <> 2 THEN 'wrong number of entries' END, CASE WHEN lacking THEN 'entry without digest' END,
       CASE WHEN origin THEN 'forbidden origin' END) AS broken
FROM e LEFT JOIN d USING (doc_id) LEFT JOIN u USING (doc_id)""",
)
def lock_check(t):
    head = r"^[A-Z][a-z]+ "
    text = F.concat_ws("\n", X.split_lines(F.col("text")))
    broken = L.check_lock(text, 2, rf"(?m){head}", rf"(?m)(?={head})", "[0-9]", "@")
    return docs(t, "doc_id", "text").select("doc_id", F.array_join(broken, "; ").alias("broken"))


@query(
    "lock_own_pin",
    """
WITH d AS (SELECT p_partkey, p_size AS version, CASE WHEN p_partkey % 6 > 0 THEN sha256(p_name) END AS checksum, concat(
  'alpha==1.0 \\', chr(10), '    --hash=sha256:', sha256(p_brand), chr(10),
  CASE WHEN p_partkey % 4 = 0 THEN 'tool-kit' ELSE 'tool' END, '[web]==', p_size + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END, ' \\', chr(10),
  '    --hash=sha256:', CASE WHEN p_partkey % 5 = 0 THEN sha256(p_type) ELSE sha256(p_name) END) AS text FROM part)
SELECT p_partkey, concat_ws('; ',
  CASE WHEN NOT regexp_matches(text, concat('(^|\\n)tool\\[[^\\n]*\\]==', version, ' \\\\(\\n|$)')) THEN 'own pin is missing' END,
  CASE WHEN NOT contains(text, '--hash=sha256:' || checksum) THEN 'own digest is missing' END) AS broken FROM d""",
)
def lock_own_pin(t):
    """Lock documents made from parts; some pin another version, a package of a longer name, or another digest than the official one."""
    key = F.col("p_partkey")
    text = F.concat(
        F.lit("alpha==1.0 \\\n    --hash=sha256:"), F.sha2("p_brand", 256), F.lit("\n"),
        F.when(key % 4 == 0, F.lit("tool-kit")).otherwise(F.lit("tool")), F.lit("[web]=="), F.col("p_size") + F.when(key % 3 == 0, 1).otherwise(0), F.lit(" \\\n"),
        F.lit("    --hash=sha256:"), F.when(key % 5 == 0, F.sha2("p_type", 256)).otherwise(F.sha2("p_name", 256)),
    )
    official = F.when(key % 6 > 0, F.sha2("p_name", 256))
    broken = L.check_lock(text, 2, package="tool", version=F.col("p_size").cast("string"), checksum=official)
    return t.part.select("p_partkey", F.array_join(broken, "; ").alias("broken"))
