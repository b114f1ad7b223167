"""Operator 1: derived WARC records. DataFrame functions only.

Responses become two linked records each: a ``metadata`` record (application/warc-fields: the source record's headers,
HTTP status and type, title, links and digests) and, for text responses, a ``conversion`` record with the plain text. Both
refer to the response by its id, carry its target URI, date and payload digest, and name each other, so a reader gets
from any of the three to the others. Record ids are derived from the source's id and the record's type: building the same
derivatives again gives the same ids. Digests are ``sha256:`` over the UTF-8 bytes of the block.

A response row has record_id, target_uri, warc_date, http_header, payload, payload_digest, block_digest and
source_headers (the WARC header lines). ``responses_of_pages`` makes such rows of the table ``pages``. ``warc_text`` gives a
record's serialised form, ``write_warc`` writes records as WARC text files, ``read_records`` reads them.

Comments, scripts and styles are dropped first, one that is never closed to the end of the page. Plain text: block elements end a line, other tags vanish, blanks are
collapsed. Links: the first href of each anchor, quoted either way or bare. All character references of HTML, named and
numeric, are decoded once in text, title and links. ``ORACLE_SQL`` knows double-quoted hrefs and the references in
``ENTITIES`` only, which is all that the given pages hold. The work is linear in the page; nothing is shuffled.

Defined results: a null url or html is empty; an empty page has an empty conversion record; repeated rows give repeated
records with equal ids; responses of other media types have a metadata record only, whose linked id is null; an empty
table gives an empty result.
"""

from __future__ import annotations

import io
import json
import zlib
from collections.abc import Iterator
from html.entities import html5

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from envspark.session import read_table
from envspark.sources import blocks
from envspark.sources.files import located

#: Pages have no fetch time: the date that their response records carry (a parameter).
DATE = "2024-01-01T00:00:00Z"
EOL = "\r\n"

# The named character references of ORACLE_SQL; the ampersand comes last.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"),
            ("&reg;", "®"), ("&trade;", "™"), ("&middot;", "·"), ("&bull;", "•"), ("&ndash;", "–"), ("&mdash;", "—"),
            ("&hellip;", "…"), ("&laquo;", "«"), ("&raquo;", "»"), ("&lsquo;", "‘"), ("&rsquo;", "’"), ("&ldquo;", "“"),
            ("&rdquo;", "”"), ("&euro;", "€"), ("&pound;", "£"), ("&deg;", "°"), ("&amp;", "&")]

# Patterns, in the common syntax of Java's and RE2's regular expressions.
DROPPED = (r"(?is)<!--.*?(?:-->|\z)|<script\b[^<>]*>.*?(?:</script[^<>]*>|\z)|"  # what is never closed goes to the end
           r"<style\b[^<>]*>.*?(?:</style[^<>]*>|\z)")
BLOCKS = (r"(?i)</?(?:p|div|h[1-6]|li|ul|ol|dl|dt|dd|br|hr|tr|td|th|table|article|section|header|footer|nav|aside|main|title|head|"
          r"body|html|form|blockquote|pre|figure|option|select)\b[^<>]*>")
TAGS = r"</?[A-Za-z!][^<>]*>"
BLANKS, LINES = r"[ \t\r\f]+", r" ?\n[ \n]*"
TITLE = r"(?is)<title[^<>]*>(.*?)</title"
LINK = r'(?i)<a\b[^<>]*\shref\s*=\s*"([^"<>]*)"'

# Anchors by the HTML rules (the first href of any form, other attributes skipped whole), references of names.
ANCHOR = (r"""(?is)<a(?:[\s/]++(?!href[\s=/>])[^\s=>/"'][^\s=>/]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+))?+)*+"""
          r"""(?:[\s/]++href\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+))?+""")  # a tag without one is passed over whole
NAMES = {k[:-1]: v for k, v in html5.items() if k.endswith(";")} | {"nbsp": " "}  # a no-break space is a blank in plain text
LEGACY = sorted((k for k in html5 if not k.endswith(";")), key=lambda k: (-len(k), k))  # these need no semicolon
SLOTS = 512
#: What the numbers 128 to 159 stand for in HTML (windows-1252, where it has a character).
C1 = {b: bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(128, 160)} | {0: "\ufffd", 160: " "}


def digest(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c.cast("binary"), 256))


def record_id(*parts: Column) -> Column:
    """A record id (urn:uuid) derived from its parts."""
    h = F.sha2(F.concat_ws("|", *parts).cast("binary"), 256)
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _character(number: Column) -> Column:
    """The character of a code point, by the HTML rules."""
    bad = number.isNull() | (number > 0x10FFFF) | number.between(0xD800, 0xDFFF)
    return F.when(bad, F.lit("\ufffd")).when(number.isin(list(C1)), F.get(F.from_json(F.lit(json.dumps([C1.get(i, "") for i in range(161)])), "array<string>"), number.cast("int"))).otherwise(
        F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))


def decoded(c: Column, attribute: bool = False) -> Column:
    """``c`` with all numeric and named character references decoded, each once; ``attribute``: by the rule for attributes."""
    slots = [{} for _ in range(SLOTS)]
    for name, chars in (NAMES | {k: html5[k] for k in LEGACY if k not in NAMES}).items():
        slots[zlib.crc32(name.encode()) % SLOTS][name] = chars
    table = F.from_json(F.lit(json.dumps(slots)), "array<map<string,string>>")  # a constant: read once
    legacy = "^(" + "|".join(LEGACY) + ")" + ("(?![=A-Za-z0-9])" if attribute else "")
    lookup = lambda name: F.element_at(F.get(table, (F.crc32(name.cast("binary")) % SLOTS).cast("int")), name)

    def after(x: Column) -> Column:
        """What stands after an ampersand."""
        number = F.regexp_extract(x, "^#([0-9]+|[xX][0-9A-Fa-f]+)", 1)
        digits = F.regexp_replace(number, "^[xX]?0*", "")
        number_of = F.concat(F.lit("0"), digits)
        value = F.when(F.length(digits) < 8, F.when(F.lower(number).startswith("x"), F.conv(number_of, 16, 10)).otherwise(number_of)
                       .cast("bigint"))
        numeric = F.concat(_character(value), F.regexp_replace(x, "^#(?:[0-9]+|[xX][0-9A-Fa-f]+);?", ""))
        name = F.regexp_extract(x, "^([A-Za-z][A-Za-z0-9]*);", 1)
        short = F.regexp_extract(x, legacy, 1)
        return (F.when(number != "", numeric)
                .when(lookup(name).isNotNull(), F.concat(lookup(name), F.substr(x, F.length(name) + 2)))
                .when(short != "", F.concat(lookup(short), F.substr(x, F.length(short) + 1)))
                .otherwise(F.concat(F.lit("&"), x)))

    return F.array_join(F.transform(F.split(c, "&"), lambda x, i: F.when(i == 0, x).otherwise(after(x))), "")


def links_of(visible: Column) -> Column:
    """The hrefs of the anchors of a page without comments, scripts and styles; no line ends, as in URLs."""
    bare = lambda x: F.regexp_replace(x, r"""^(?:"(.*)"|'(.*)')$""", "$1$2")
    found = F.filter(F.regexp_extract_all(visible, F.lit(ANCHOR), F.lit(1)), lambda x: x != "")
    return F.transform(found, lambda x: F.trim(
        F.regexp_replace(decoded(bare(F.regexp_replace(x, r"[\t\r\n]", "")), attribute=True), r"[\t\r\n]", "")))


def plain_text(html: Column) -> Column:
    """The text of an HTML page."""
    return _visible_text(F.regexp_replace(html, DROPPED, ""))


def _visible_text(bare: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(bare, BLOCKS, "\n"), TAGS, "")
    return F.trim(F.regexp_replace(F.regexp_replace(decoded(bare), BLANKS, " "), LINES, "\n"), F.lit(" \n"))


def responses_of_pages(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Response records of the rows of ``pages`` (page_id, url, html)."""
    html, url = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "),
                    F.octet_length("payload").cast("string"), F.lit(EOL + EOL))
    rows = pages.select("page_id", url.alias("target_uri"), html.alias("payload")).select("*", http.alias("http_header"))
    rows = rows.select("*", digest(F.col("payload")).alias("payload_digest"),
                       digest(F.concat("http_header", "payload")).alias("block_digest"))
    rows = rows.select("*", F.lit(date).alias("warc_date"), record_id(
        F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), "target_uri", "block_digest").alias("record_id"))
    length = (F.octet_length("http_header") + F.octet_length("payload")).cast("string")
    lines = [("WARC-Type", F.lit("response")), ("WARC-Record-ID", F.col("record_id")), ("WARC-Target-URI", F.col("target_uri")),
             ("WARC-Date", F.col("warc_date")), ("WARC-Payload-Digest", F.col("payload_digest")),
             ("WARC-Block-Digest", F.col("block_digest")),
             ("Content-Type", F.lit("application/http; msgtype=response")), ("Content-Length", length)]
    return rows.withColumn("source_headers", header_lines(lines))


def header_lines(fields: list[tuple[str, Column]]) -> Column:
    return F.concat(*[F.concat(F.lit(f"{name}: "), value, F.lit(EOL)) for name, value in fields])


def derivatives(responses: DataFrame, *keep: str) -> DataFrame:
    """The derived records of response rows; ``keep``: further columns to carry along."""
    media = F.trim(F.lower(F.regexp_extract("http_header", r"(?i)\r\nContent-Type:[ ]*([^;\r\n]*)", 1)))
    status = F.regexp_extract("http_header", r"^HTTP/[0-9.]+ ([0-9]{3})", 1)
    rows = responses.withColumns({"media": media, "status": status, "visible": F.regexp_replace("payload", DROPPED, "")})
    is_html, is_text = F.col("media").isin("text/html", "application/xhtml+xml"), F.col("media").startswith("text/")
    title = F.trim(F.regexp_replace(decoded(F.regexp_extract("visible", TITLE, 1)), r"[ \t\r\n\f]+", " "))
    rows = rows.withColumns({
        "text": F.when(is_html, _visible_text(F.col("visible"))).when(is_text, F.col("payload")),
        "title": F.when(is_html, title).otherwise(""),
        "links": F.when(is_html, links_of(F.col("visible")))
        .otherwise(F.array().cast("array<string>")),
        "metadata_id": record_id(F.lit("metadata"), F.col("record_id")),
        "conversion_id": F.when(is_html | is_text, record_id(F.lit("conversion"), F.col("record_id")))})
    outlinks = F.concat_ws("", F.transform("links", lambda x: F.concat(F.lit("outlink: "), x, F.lit(EOL))))
    source = F.concat_ws("", F.transform(F.filter(F.split("source_headers", EOL), lambda x: x != ""),
                                         lambda x: F.concat(F.lit("source-"), x, F.lit(EOL))))
    fields = header_lines([("http-status", F.col("status")), ("http-content-type", F.col("media")), ("title", F.col("title"))])
    about = F.concat(source, fields, outlinks)
    one = lambda kind, own, other, media_type, content: F.struct(
        F.lit(kind).alias("record_type"), own.alias("record_id"), other.alias("linked_id"),
        F.lit(media_type).alias("content_type"), content.alias("content"))
    both = F.array(
        one("metadata", F.col("metadata_id"), F.col("conversion_id"), "application/warc-fields", F.col("about")),
        one("conversion", F.col("conversion_id"), F.col("metadata_id"), "text/plain; charset=utf-8", F.col("text")))
    out = rows.withColumn("about", about).select(
        *keep, F.col("record_id").alias("refers_to"), "target_uri", "warc_date",
        F.col("payload_digest").alias("source_payload_digest"), F.col("block_digest").alias("source_block_digest"),
        "source_headers", F.explode(both).alias("r"))
    return out.where("r.record_id is not null").select(
        *keep, "r.record_type", "r.record_id", "refers_to", "r.linked_id", "target_uri", "warc_date", "r.content_type",
        F.octet_length("r.content").cast("bigint").alias("content_length"), digest(F.col("r.content")).alias("block_digest"),
        "source_payload_digest", "source_block_digest", "source_headers", F.col("r.content").alias("content"))


def warc_text() -> Column:
    """The serialised form of a derived record."""
    head = header_lines([
        ("WARC-Type", F.col("record_type")), ("WARC-Record-ID", F.col("record_id")), ("WARC-Refers-To", F.col("refers_to")),
        ("WARC-Target-URI", F.col("target_uri")), ("WARC-Date", F.col("warc_date")),
        ("WARC-Block-Digest", F.col("block_digest")), ("X-Source-Payload-Digest", F.col("source_payload_digest")),
        ("X-Linked-Record-ID", F.coalesce("linked_id", F.lit(""))), ("Content-Type", F.col("content_type")),
        ("Content-Length", F.col("content_length").cast("string"))])
    return F.concat(F.lit(f"WARC/1.1{EOL}"), head, F.lit(EOL), F.col("content"), F.lit(EOL + EOL))


def write_warc(records: DataFrame, path: str, compression: str = "none") -> None:
    """Records as WARC files, one per partition."""
    rows = records.select(warc_text().alias("record"))
    rows = rows.select(F.expr("substring(record, 1, length(record) - 1)"))  # the writer adds each record's last line end
    rows.write.option("lineSep", "\n").option("compression", compression).text(path)


RECORDS = "headers string, content string"


def records_in(stream) -> Iterator[tuple[str, str]]:
    """(headers, content) of a WARC stream, record by record; contents are as long as their Content-Length says, whatever
    they hold."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue  # the line ends between records
        head, length = [], 0
        while (line := stream.readline()) not in (b"", b"\n", EOL.encode()):
            head.append(line.rstrip(b"\r\n").decode("utf-8", "replace"))
            name, _, value = head[-1].partition(":")
            if name.strip().lower() == "content-length":
                length = int(value)
        yield "".join(h + EOL for h in head), stream.read(length).decode("utf-8", "replace")


class _RecordReader(blocks.PartsReader):
    def read(self, partition) -> Iterator[tuple[str, str]]:
        for uri, _ in partition.items:
            with io.BufferedReader(blocks.open_stream(uri), 1 << 20) as stream:
                yield from records_in(stream)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(headers, content) of the records of the WARC files under ``path`` (also compressed ones); a file is read by one task,
    one record at a time. The files must be in a store that the executors open (``blocks.opens``)."""
    files = sorted((r["file"], r["length"]) for r in located(spark, path).select("file", "length").collect())
    return blocks.read_parts(spark, "warc_records", RECORDS, _RecordReader, blocks.packed(files, 1, blocks.TASK_BYTES))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derivatives(responses_of_pages(read_table(spark, sf_dir, "pages")), "page_id")


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_decoded(c: str) -> str:
    for name, char in ENTITIES:
        c = f"replace({c}, {_sql_text(name)}, {_sql_text(char)})"
    return c


def _sql_id(kind: str, rest: str) -> str:
    h = f"sha256('{kind}|' || {rest})"
    return (f"'<urn:uuid:' || {h}[1:8] || '-' || {h}[9:12] || '-' || {h}[13:16] || '-' || {h}[17:20] || '-' || {h}[21:32] || '>'")


_E = "chr(13) || chr(10)"
ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS payload FROM pages),
h AS (SELECT *, 'HTTP/1.1 200 OK' || {_E} || 'Content-Type: text/html; charset=utf-8' || {_E} || 'Content-Length: '
             || strlen(payload) || {_E} || {_E} AS http FROM p),
d AS (SELECT *, 'sha256:' || sha256(payload) AS pd, 'sha256:' || sha256(http || payload) AS bd FROM h),
i AS (SELECT *, {_sql_id('response', "coalesce(page_id::VARCHAR, '') || '|' || target_uri || '|' || bd")} AS rid FROM d),
s AS (SELECT *, 'WARC-Type: response' || {_E} || 'WARC-Record-ID: ' || rid || {_E} || 'WARC-Target-URI: ' || target_uri || {_E}
             || 'WARC-Date: {DATE}' || {_E} || 'WARC-Payload-Digest: ' || pd || {_E} || 'WARC-Block-Digest: ' || bd || {_E}
             || 'Content-Type: application/http; msgtype=response' || {_E}
             || 'Content-Length: ' || (strlen(http) + strlen(payload)) || {_E} AS headers,
      {_sql_id('metadata', 'rid')} AS mid, {_sql_id('conversion', 'rid')} AS cid,
      regexp_replace(regexp_replace(regexp_replace(payload, {_sql_text(DROPPED)}, '', 'g'), {_sql_text(BLOCKS)}, chr(10), 'g'),
                     {_sql_text(TAGS)}, '', 'g') AS bare,
      trim(regexp_replace({_sql_decoded(f"regexp_extract(payload, {_sql_text(TITLE)}, 1)")}, '[ \\t\\r\\n\\f]+', ' ', 'g'), ' ') AS title,
      regexp_extract_all(payload, {_sql_text(LINK)}, 1) AS links FROM i),
t AS (SELECT *, trim(regexp_replace(regexp_replace({_sql_decoded('bare')}, {_sql_text(BLANKS)}, ' ', 'g'), {_sql_text(LINES)},
             chr(10), 'g'), ' ' || chr(10)) AS body,
      'source-' || replace(rtrim(headers, {_E}), {_E}, {_E} || 'source-') || {_E} || 'http-status: 200' || {_E}
      || 'http-content-type: text/html' || {_E} || 'title: ' || title || {_E}
      || coalesce(array_to_string(list_transform(links, lambda x: 'outlink: ' || {_sql_decoded('x')} || {_E}), ''), '') AS about
      FROM s),
r AS (SELECT *, 'metadata' AS record_type, mid AS record_id, cid AS linked_id, 'application/warc-fields' AS content_type,
             about AS content FROM t
      UNION ALL SELECT *, 'conversion', cid, mid, 'text/plain; charset=utf-8', body FROM t)
SELECT page_id, record_type, record_id, rid AS refers_to, linked_id, target_uri, '{DATE}' AS warc_date, content_type,
       strlen(content)::BIGINT AS content_length, 'sha256:' || sha256(content) AS block_digest, pd AS source_payload_digest,
       bd AS source_block_digest, headers AS source_headers, content FROM r
"""
