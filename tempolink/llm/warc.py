"""WARC derivatives: linked metadata and plain-text conversion records.

Each response record gives two: ``metadata`` (JSON of title, links and the
response's headers) and ``conversion`` (the page's text), both pointing back by
WARC-Refers-To, with digests of their own blocks and the response's payload
digest and source headers preserved, in written files too.  All of it is column
functions on one row, so nothing is shuffled.  No expression looks twice for an
end, as of a tag or a comment, that doesn't come, so a page's time is in
proportion to its length.

Defined cases: a null html is an empty page; a null url is an empty target; a
null page_id has no number in its record id; repeated rows give equal records;
an empty table gives none; a page of any length is read whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import pick
from .warcread import read_responses  # noqa: F401

DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"
SOURCE_HEADERS = "X-Source-HTTP-Headers"
#: Tags that end a line of text.
BLOCKS = "p|div|br|h[1-6]|li|ul|ol|nav|article|section|header|footer|main|aside|table|tr|td|th|title|head|body|html|blockquote|pre|form"
#: The named characters that the SQL twin knows; the ampersand comes last.
NAMED = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def _named(c: Column) -> Column:
    for name, char in NAMED:
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


#: An href attribute with its value, and what of it comes before the value.
HREF_BEFORE = r"""[\s"'/]"""
HREF = rf"""(?i){HREF_BEFORE}href\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'<>=]+)"""
HREF_NAME = r"""(?i)^.?href\s*=\s*"""

#: HTML's whole table of named characters in buckets by a hash of the name, and
#: the older names, longest first, that hold without a semicolon.
BUCKETS = 2048
LEGACY = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
#: What the numbers 128 to 159 stand for.
C1 = "".join(bytes([i]).decode("cp1252", "ignore") or chr(i) for i in range(128, 160))


def _buckets() -> Column:
    held = [""] * BUCKETS
    for name, char in sorted(html5.items()):
        if name.endswith(";"):
            held[zlib.crc32(name.encode()) % BUCKETS] += f"\1{name}{char}"
    return F.split(F.lit("\2".join(held)), "\2")


def _numbered(ref: Column) -> Column:
    """The character of ``#8217;`` or ``#x2019;``; a number that is none gives U+FFFD."""
    hexed, plain = F.regexp_extract(ref, "^#[xX]0*([0-9a-fA-F]*)", 1), F.regexp_extract(ref, "^#0*([0-9]*)", 1)
    digits, base = F.when(ref.rlike("^#[xX]"), hexed).otherwise(plain), F.when(ref.rlike("^#[xX]"), F.lit(16)).otherwise(F.lit(10))
    at = F.when(F.length(digits).between(1, 7), F.call_function("conv", digits, base, F.lit(10)).cast("long")).otherwise(F.lit(0))
    char = F.decode(F.unhex(F.lpad(F.hex(at), 8, "0")), "UTF-32")
    none = (at <= 0) | (at > 0x10FFFF) | at.between(0xD800, 0xDFFF)
    return F.when(none, F.lit("\ufffd")).when(at == 0xFEFF, F.lit("\ufeff")).when(at.between(128, 159), F.substring(F.lit(C1), (at - 127).cast("int"), F.lit(1))).otherwise(char)


def decoded(c: Column, in_value: bool = False) -> Column:
    """Text with all character references read once, from left to right.

    In an attribute's value a name without semicolon counts only if no letter,
    digit or equals sign follows it.
    """
    legacy = f"^(?:{'|'.join(LEGACY)})" + ("(?![=A-Za-z0-9])" if in_value else "")
    held = _buckets()

    def named(ref: Column) -> Column:
        bucket, key = F.get(held, F.pmod(F.crc32(ref.cast("binary")), F.lit(BUCKETS)).cast("int")), F.concat(F.lit("\1"), ref)
        return F.when(F.instr(bucket, key) > 0, F.substring_index(F.call_function("substring_index", bucket, key, F.lit(-1)), "\1", 1))

    def with_ref(p: Column) -> Column:
        return F.struct(p.alias("p"), F.regexp_extract(p, "^(?:#(?:[0-9]+|[xX][0-9a-fA-F]+);?|[A-Za-z][A-Za-z0-9]*;)", 0).alias("ref"))

    def with_char(x: Column) -> Column:
        ref = x["ref"]
        char = F.when(ref == "lt;", F.lit("<")).when(ref == "gt;", F.lit(">")).when(ref == "quot;", F.lit('"')).when(ref.startswith("#"), _numbered(ref)).when(ref != "", named(ref))
        return F.struct(x["p"].alias("p"), ref.alias("ref"), char.alias("char"))

    def read(x: Column) -> Column:
        old = F.regexp_extract(x["p"], legacy, 0)
        rest = lambda n: F.substring(x["p"], n + 1, F.length(x["p"]))
        return F.when(x["char"].isNotNull(), F.concat(x["char"], rest(F.length(x["ref"])))).when(old != "", F.concat(named(F.concat(old, F.lit(";"))), rest(F.length(old)))).otherwise(F.concat(F.lit("&"), x["p"]))

    def part(p: Column, i: Column) -> Column:
        other = F.get(F.transform(F.transform(F.transform(F.array(p), with_ref), with_char), read), F.lit(0))
        return F.when(i == 0, p).when(F.startswith(p, F.lit("amp;")), F.concat(F.lit("&"), F.substring(p, 5, 1 << 30))).otherwise(other)

    return F.array_join(F.transform(F.split(c, "&"), part), "")


def _read(c: Column) -> Column:
    """References read; a no-break space is a space."""
    return F.translate(decoded(c), "\u00a0", " ")


def _removed(c: Column, start: str, rest: str, end: str, flags: str = "(?s)") -> Column:
    """Every stretch from ``<`` and a start to the next end removed.

    At a start that no end follows, the text is kept from there on as it is, so
    that no later start is tried in vain.
    """
    return F.regexp_replace(c, f"{flags}<(?:{start}{rest}{end}|(?={start})(?<=(<))({start}.*)$)", "$1$2")


def plain_text(html: Column, read: Callable[[Column], Column] = _read) -> Column:
    """A page's text: no scripts, styles or comments, a line for each block; ``read`` decodes references."""
    after = lambda c: F.substring_index(c, ">", -1)  # noqa: E731 - behind the last end of a tag, where no tag can be

    def tags(c: Column) -> Column:
        head = F.substring(c, F.lit(1), F.length(c) - F.length(after(c)))
        return F.concat(F.regexp_replace(F.regexp_replace(head, rf"(?i)</?(?:{BLOCKS})\b[^>]*>", "\n"), r"<[^>]*>", ""), after(c))

    steps = [
        lambda c: F.when(F.contains(c, F.lit("<!--")), _removed(c, "!--", ".*?", "-->")).otherwise(c),
        lambda c: _removed(c, r"script\b", ".*?", r"</script\s*>", "(?is)"),
        lambda c: _removed(c, r"style\b", ".*?", r"</style\s*>", "(?is)"),
        tags,
        lambda c: F.regexp_replace(read(c), r"[ \t\r\f]{2,}|[\t\r\f]", " "),
        lambda c: F.regexp_replace(c, r" ?\n[ \n]*", "\n"),
        lambda c: F.btrim(c, F.lit(" \n")),
    ]
    # one step at a time on a value of its own, so that no step is computed twice
    held = F.array(html)
    for step in steps:
        held = F.transform(held, step)
    return F.element_at(held, 1)


def page_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^<>]*>(?:(.*?)</title\s*>|.*$)", 1))


def page_links(html: Column) -> Column:
    """The values of all href attributes, in double, single or no quotes."""
    # the same as HREF, the name first, which is quicker here
    found = F.regexp_extract_all(html, F.lit(HREF.replace(HREF_BEFORE + "href", f"href(?<={HREF_BEFORE}href)")), 0)
    value = lambda m: F.regexp_replace(m, HREF_NAME, "")
    return F.transform(found, lambda m: F.regexp_replace(value(m), "^[\"']|[\"']$", ""))


def record_id(kind: str, *parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.lit(kind), *parts))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def digest(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c, 256))


def responses(pages: DataFrame) -> DataFrame:
    """Pages as response records: (page_id, record_id, target_uri, date, http_headers, payload, payload_digest)."""
    rows = pick(pages, page_id="long", url="string", html="string")
    uri, html = F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(html).cast("string"))
    return rows.select(
        "page_id",
        record_id("response", F.col("page_id").cast("string"), uri, html).alias("record_id"),
        uri.alias("target_uri"),
        F.lit(DATE).alias("date"),
        http.alias("http_headers"),
        html.alias("payload"),
        digest(html).alias("payload_digest"),
    )


def derivatives(records: DataFrame, whole: bool = True) -> DataFrame:
    """Two records for each response: its metadata and its plain text.

    Unless ``whole``, only the few references in ``NAMED`` are read, none in
    links, as the SQL twin does.
    """
    html, read = F.col("payload"), _read if whole else _named
    links = page_links(html)
    page = records.select(
        "*",
        read(page_title(html)).alias("title"),
        (F.transform(links, lambda v: decoded(v, in_value=True)) if whole else links).alias("links"),
        plain_text(html, read).alias("plain"),
    )
    about = F.to_json(F.struct(
        F.col("target_uri").alias("uri"), F.col("http_headers").alias("source_headers"), F.col("payload_digest").alias("payload_digest"),
        "title", "links", F.size("links").alias("n_links"), F.length("plain").alias("n_chars"),
    ))
    kinds = F.array(
        F.struct(F.lit("metadata").alias("warc_type"), F.lit("application/json").alias("content_type"), about.alias("block")),
        F.struct(F.lit("conversion").alias("warc_type"), F.lit("text/plain").alias("content_type"), F.col("plain").alias("block")),
    )
    both = page.select("page_id", F.col("record_id").alias("refers_to"), "target_uri", "date", "http_headers", "payload_digest", F.explode(kinds).alias("k"))
    return both.select(
        "page_id",
        "k.warc_type",
        F.when(F.col("k.warc_type") == "metadata", record_id("metadata", F.col("refers_to"))).otherwise(record_id("conversion", F.col("refers_to"))).alias("record_id"),
        "refers_to",
        "target_uri",
        "date",
        "k.content_type",
        F.octet_length("k.block").cast("long").alias("content_length"),
        digest(F.col("k.block")).alias("block_digest"),
        F.col("payload_digest").alias("refers_to_payload_digest"),
        F.col("http_headers").alias("source_headers"),
        "k.block",
    )


def warc_text(records: DataFrame) -> DataFrame:
    """(value): each derivative as a WARC record without the two line ends that follow it."""
    head = [
        ("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "date"),
        ("WARC-Block-Digest", "block_digest"), ("WARC-Refers-To-Payload-Digest", "refers_to_payload_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length"),
    ]
    lines = [F.lit("WARC/1.0")] + [F.concat(F.lit(f"{name}: "), F.col(c).cast("string")) for name, c in head]
    # the response's own headers as one JSON list, since a field is one line
    lines += [F.concat(F.lit(f"{SOURCE_HEADERS}: "), F.to_json(F.split("source_headers", CRLF)))]
    return records.select(F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2), F.col("block")).alias("value"))


def write_warc(records: DataFrame, path: str) -> None:
    """Writes derivatives as gzipped WARC files, one for each partition."""
    warc_text(records).write.option("lineSep", CRLF * 2).option("compression", "gzip").text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(headers map, block) of the records that ``write_warc`` wrote."""
    raw = spark.read.option("lineSep", f"WARC/1.0{CRLF}").text(path).where(F.length("value") > 0)
    at = F.expr("instr(value, '\r\n\r\n')")
    return raw.select(
        F.str_to_map(F.substring("value", F.lit(1), at - 1), F.lit(CRLF), F.lit(": ")).alias("headers"),
        F.substring("value", at + 4, F.length("value") - at - 7).alias("block"),
    )


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derivatives(responses(spark.read.parquet(f"{sf_dir}/pages.parquet")), whole=False)


def op5_warc_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``op5_warc``, with every character reference read, which its SQL doesn't do."""
    return derivatives(responses(spark.read.parquet(f"{sf_dir}/pages.parquet")))


def _sql_named(c: str) -> str:
    for name, char in NAMED:
        c = f"replace({c}, '{name}', '{char.replace(chr(39), chr(39) * 2)}')"
    return c


def _sql_id(kind: str, parts: str) -> str:
    h = f"md5('{kind}|' || {parts})"
    return f"'<urn:uuid:' || substr({h},1,8) || '-' || substr({h},9,4) || '-' || substr({h},13,4) || '-' || substr({h},17,4) || '-' || substr({h},21,12) || '>'"


SQL = rf"""
WITH r AS (
  SELECT page_id, coalesce(url, '') AS uri, coalesce(html, '') AS h FROM pages),
p AS (
  SELECT page_id, uri, {_sql_id("response", "page_id || '|' || uri || '|' || h")} AS refers_to, 'sha256:' || sha256(h) AS pd,
    'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || strlen(h) AS http,
    {_sql_named("trim(regexp_extract(h, '(?is)<title[^<>]*>(.*?)</title\\s*>', 1))")} AS title,
    list_transform(regexp_extract_all(h, '{HREF.replace("'", "''")}'), lambda m: regexp_replace(regexp_replace(m, '{HREF_NAME}', ''), '^["'']|["'']$', '', 'g')) AS links,
    regexp_replace(regexp_replace(regexp_replace({_sql_named(f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(h, '(?s)<!--.*?-->', '', 'g'), '(?is)<script" + chr(92) + "b.*?</script" + chr(92) + "s*>', '', 'g'), '(?is)<style" + chr(92) + "b.*?</style" + chr(92) + "s*>', '', 'g'), '(?i)</?(?:" + BLOCKS + ")" + chr(92) + "b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g')")},
      '[ \t\r\f]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g') AS plain
  FROM r),
b AS (
  SELECT *, 'metadata' AS warc_type, 'application/json' AS content_type,
    json_object('uri', uri, 'source_headers', http, 'payload_digest', pd, 'title', title, 'links', links, 'n_links', len(links), 'n_chars', length(plain))::VARCHAR AS block FROM p
  UNION ALL SELECT *, 'conversion', 'text/plain', plain FROM p)
SELECT page_id, warc_type, CASE warc_type WHEN 'metadata' THEN {_sql_id("metadata", "refers_to")} ELSE {_sql_id("conversion", "refers_to")} END AS record_id,
  refers_to, uri AS target_uri, '{DATE}' AS date, content_type, strlen(block)::BIGINT AS content_length, 'sha256:' || sha256(block) AS block_digest,
  pd AS refers_to_payload_digest, http AS source_headers, block
FROM b
"""
