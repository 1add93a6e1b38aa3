"""WARC derivatives: responses become linked metadata and plain-text conversion records.

A record is a row: record_id, record_type, refers_to, target_uri, date, content_type, payload_digest,
block_digest, content_length, block.  ``derive`` gives two rows a response, in one narrow pass of JVM
expressions: a ``metadata`` record (``application/warc-fields``: title, source headers, one ``outlink`` a
link) and a ``conversion`` record (``text/plain``).  Both keep the response's id as ``refers_to``, its URI, date
and payload digest.  ``write_warc`` and ``read_warc`` move records to and from WARC/1.1 files.

Edge cases: a null body is an empty one; a null URI stays null and takes part in the record id as an empty
string; equal rows give equal records; markup that never closes stays as text.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaica.llm.common import tidied

FIELDS = ["record_id", "record_type", "refers_to", "target_uri", "date", "content_type", "payload_digest", "block_digest", "content_length", "block"]
RECORD = "record_id string, record_type string, refers_to string, target_uri string, date string, content_type string, payload_digest string, block_digest string, content_length long, block string"
DATE = "1970-01-01T00:00:00Z"

#: (pattern, replacement), in this order; the patterns mean the same to java.util.regex and RE2.
CLEANING = [
    (r"(?s)<!--.*?-->", ""),
    (r"(?is)<script(?:[ \t\r\n/][^>]*)?>.*?</script[ \t\r\n]*>", ""),
    (r"(?is)<style(?:[ \t\r\n/][^>]*)?>.*?</style[ \t\r\n]*>", ""),
    (r"(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|nav|header|footer|title|head|body|html|main|aside|pre|blockquote)(?:[ \t\r\n/][^>]*)?>", "\n"),
    (r"<[^>]*>", ""),
    (r"&nbsp;", " "),
    (r"&lt;", "<"),
    (r"&gt;", ">"),
    (r"&quot;", '"'),
    (r"&#39;", "'"),
    (r"&amp;", "&"),
    (r"[ \t\r]+", " "),
    (r" ?\n[ \n]*", "\n"),
    (r"^[ \n]+|[ \n]+$", ""),
]
TITLE = r"(?is)<title(?:[ \t\r\n/][^>]*)?>(.*?)</title"
LINK = r"(?i)<a[ \t\r\n](?:[^>]*[ \t\r\n])?href=\"([^\"]*)\""


#: Markup by what ends it: behind the last such end nothing matches, and looking there for an end that never comes
#: would take time quadratic in the text.
LAST = {CLEANING[0][0]: r"(?s)^.*-->", CLEANING[1][0]: r"(?is)^.*</script[ \t\r\n]*>", CLEANING[2][0]: r"(?is)^.*</style[ \t\r\n]*>", CLEANING[3][0]: r"(?s)^.*>", CLEANING[4][0]: r"(?s)^.*>"}


def replaced(html: Column, pattern: str, to: str) -> Column:
    """``html`` with what ``pattern`` matches, up to the last end of such an element, replaced; each value is computed once."""

    def cut(whole: Column) -> Column:
        head = F.regexp_extract(whole, LAST[pattern], 0)
        rest = lambda h: F.concat(F.regexp_replace(h, pattern, to), F.substring(whole, F.length(h) + 1, F.length(whole)))
        return F.transform(F.array(head), rest)[0]

    return F.transform(F.array(html), cut)[0]


def plain_text(html: Column) -> Column:
    for pattern, to in CLEANING:
        html = replaced(html, pattern, to) if pattern in LAST else F.regexp_replace(html, pattern, to)
    return html


def urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("\n", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def sha(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c.cast("binary"), 256))


def responses(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", date: str = DATE) -> DataFrame:
    """Response records of crawled pages, with an HTTP header block before the body; ``key`` is kept."""
    body = F.coalesce(F.col(html), F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(head, body)
    return pages.select(
        F.col(key),
        urn(F.lit("response"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.coalesce(F.col(url), F.lit("")), F.md5(body)).alias("record_id"),
        F.lit("response").alias("record_type"), F.lit(None).cast("string").alias("refers_to"), F.col(url).alias("target_uri"), F.lit(date).alias("date"),
        F.lit("application/http; msgtype=response").alias("content_type"), sha(body).alias("payload_digest"), sha(block).alias("block_digest"),
        F.octet_length(block).cast("long").alias("content_length"), block.alias("block"),
    )


def derive(records: DataFrame) -> DataFrame:
    """A metadata and a conversion record of each response; other record types give none.

    Columns besides those of a record come first and are kept.
    """
    extra = [c for c in records.columns if c not in FIELDS]
    end = F.instr("block", "\r\n\r\n")
    body = F.when(end > 0, F.expr("substring(block, instr(block, '\r\n\r\n') + 4)")).otherwise(F.col("block"))
    head = F.when(end > 0, F.expr("substring(block, 1, instr(block, '\r\n\r\n') - 1)")).otherwise("")
    place = {c: f"c{i}" for i, c in enumerate(extra)}  # names that no column of ours has
    source = records.where("record_type = 'response'").select(*(F.col(c).alias(place[c]) for c in extra), F.col("record_id").alias("refers_to"), "target_uri", "date", "payload_digest", head.alias("head"), body.alias("body"))
    title = plain_text(F.regexp_extract("body", TITLE, 1))
    links = F.regexp_extract_all("body", F.lit(LINK), F.lit(1))
    fields = F.concat(F.lit("title: "), title, F.lit("\r\nhttp-headers: "), F.regexp_replace("head", "\r\n", "; "), F.lit("\r\nsource-digest: "), F.coalesce("payload_digest", F.lit("")), F.lit("\r\n"), F.array_join(F.transform(links, lambda x: F.concat(F.lit("outlink: "), x, F.lit("\r\n"))), ""))
    made = F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), plain_text(F.col("body")).alias("block")),
    )
    rows = source.select(*place.values(), "refers_to", "target_uri", "date", "payload_digest", F.explode(made).alias("made")).select(*place.values(), "refers_to", "target_uri", "date", "payload_digest", "made.*")
    return rows.select(
        *(F.col(place[c]).alias(c) for c in extra), urn(F.col("record_type"), F.col("refers_to")).alias("record_id"), "record_type", "refers_to", "target_uri", "date", "content_type", "payload_digest",
        sha(F.col("block")).alias("block_digest"), F.octet_length("block").cast("long").alias("content_length"), "block",
    )


def write_warc(records: DataFrame, path: str) -> None:
    """WARC/1.1 files, one a partition, written by Spark itself and so to any of its file systems."""

    def line(name: str, column: str) -> Column:
        return F.when(F.col(column).isNotNull(), F.concat(F.lit(name + ": "), F.col(column).cast("string"), F.lit("\r\n"))).otherwise("")

    head = F.concat(F.lit("WARC/1.1\r\n"), line("WARC-Type", "record_type"), line("WARC-Record-ID", "record_id"), line("WARC-Refers-To", "refers_to"), line("WARC-Target-URI", "target_uri"), line("WARC-Date", "date"), line("WARC-Payload-Digest", "payload_digest"), line("WARC-Block-Digest", "block_digest"), line("Content-Type", "content_type"), line("Content-Length", "content_length"))
    records.select(F.concat(head, F.lit("\r\n"), F.coalesce("block", F.lit("")))).write.option("lineSep", "\r\n\r\n").text(path)


_NAMES = {"warc-record-id": "record_id", "warc-type": "record_type", "warc-refers-to": "refers_to", "warc-target-uri": "target_uri", "warc-date": "date", "content-type": "content_type", "warc-payload-digest": "payload_digest", "warc-block-digest": "block_digest"}


def parse(data: bytes) -> Iterator[dict]:
    """Records of one file, plain or gzipped (whole or by member)."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.index(b"\r\n\r\n", at)
        row: dict = dict.fromkeys(FIELDS)
        for text in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = text.partition(":")
            if name.lower() == "content-length":
                row["content_length"] = int(value)
            elif name.lower() in _NAMES:
                row[_NAMES[name.lower()]] = value.strip()
        at = end + 4 + (row["content_length"] or 0)
        yield row | {"block": data[end + 4 : at].decode("utf-8", "replace")}


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files; a file is parsed by one task, files in parallel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows: list[dict] = []
                for row in parse(data.as_py()):
                    rows.append(row)
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([(f, pa.int64() if f == "content_length" else pa.string()) for f in FIELDS])
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(tidied(run), RECORD)


def _literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def oracle() -> str:
    """DuckDB SQL of ``derive(responses(pages))``."""

    def clean(e: str) -> str:
        for pattern, to in CLEANING:
            if pattern in LAST:
                e = f"list_transform(list_transform([{e}], lambda x: [x, regexp_extract(x, {_literal(LAST[pattern])}, 0)]), lambda p: regexp_replace(p[2], {_literal(pattern)}, {_literal(to).replace(chr(10), chr(39) + ' || chr(10) || ' + chr(39))}, 'g') || substr(p[1], length(p[2]) + 1))[1]"
                continue
            e = f"regexp_replace({e}, {_literal(pattern)}, {_literal(to).replace(chr(10), chr(39) + ' || chr(10) || ' + chr(39))}, 'g')"
        return e

    def uuid(e: str) -> str:
        return f"(SELECT '<urn:uuid:' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] || '>' FROM (SELECT md5({e}) AS h))"

    crlf, nl = "chr(13) || chr(10)", "chr(10)"
    return f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS body FROM pages),
r AS (SELECT page_id, url AS target_uri, body, 'sha256:' || sha256(body) AS payload_digest, strlen(body) AS n,
  {uuid(f"'response' || {nl} || coalesce(page_id::VARCHAR, '') || {nl} || coalesce(url, '') || {nl} || md5(body)")} AS refers_to FROM p),
m AS (
  SELECT *, 'metadata' AS record_type, 'application/warc-fields' AS content_type,
    'title: ' || {clean(f"regexp_extract(body, {_literal(TITLE)}, 1)")} || {crlf} || 'http-headers: HTTP/1.1 200 OK; Content-Type: text/html; charset=utf-8; Content-Length: ' || n || {crlf}
    || 'source-digest: ' || payload_digest || {crlf} || array_to_string(list_transform(regexp_extract_all(body, {_literal(LINK)}, 1), lambda x: 'outlink: ' || x || {crlf}), '') AS block FROM r
  UNION ALL
  SELECT *, 'conversion', 'text/plain; charset=utf-8', {clean("body")} FROM r)
SELECT page_id, {uuid(f"record_type || {nl} || refers_to")} AS record_id, record_type, refers_to, target_uri, '{DATE}' AS date, content_type, payload_digest,
  'sha256:' || sha256(block) AS block_digest, strlen(block) AS content_length, block FROM m"""
