"""WARC derivatives: each response becomes a metadata record and a plain-text conversion record.

Both name the response they derive from in WARC-Refers-To; the metadata record keeps the source record's headers
and digests (those of its WARC header as they are declared), the conversion record holds the text without markup. Identifiers and digests are
functions of the content, so a rerun makes the same records.
"""

from __future__ import annotations

import gzip
import io
import itertools
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .shared import mapped, table

#: Time stamp of responses that carry none.
NO_DATE = "1970-01-01T00:00:00Z"
#: raw holds the payload's bytes, payload their text; warc_headers the record's whole WARC header, the digests what it declares ("" if nothing).
RESPONSE = "record_id string, target_uri string, date string, http_headers string, payload string, raw binary, warc_headers string, payload_digest string, block_digest string"

#: Rewrites from HTML to text, in order; each is valid in both Java's and RE2's syntax.
TO_TEXT = [
    ("(?is)<!--.*?-->", " "),
    ("(?is)<script[^>]*>.*?</script[^>]*>", " "),
    ("(?is)<style[^>]*>.*?</style[^>]*>", " "),
    ("(?is)<head[^>]*>.*?</head[^>]*>", " "),
    ("(?i)<(br|/p|/div|/h[1-6]|/li|/tr|/article|/nav|/footer)[^>]*>", "\n"),
    ("<[^>]*>", ""),
    ("(?i)&nbsp;", " "), ("(?i)&lt;", "<"), ("(?i)&gt;", ">"), ("(?i)&quot;", '"'), ("&#39;", "'"), ("(?i)&middot;", "·"), ("(?i)&copy;", "©"), ("(?i)&amp;", "&"),
    ("[ \t\r]+", " "), (" ?\n[ \n]*", "\n"), ("^[ \n]+|[ \n]+$", ""),
]


def _quoted(s: str) -> str:
    return s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\t", "\\t").replace("\r", "\\r")


def with_text(rows: DataFrame, html: str, name: str) -> DataFrame:
    """rows with the page's text, as the rewrites of TO_TEXT in turn make it; one that cannot match, as a plain search shows, is left out, and ends are trimmed without a pattern."""
    again = lambda rows, n, needed=None: rows.withColumn(name, F.expr(f"regexp_replace({name}, '{_quoted(TO_TEXT[n][0])}', '{_quoted(TO_TEXT[n][1])}')") if needed is None else F.when(needed, F.expr(f"regexp_replace({name}, '{_quoted(TO_TEXT[n][0])}', '{_quoted(TO_TEXT[n][1])}')")).otherwise(F.col(name)))
    rows = again(rows.withColumn(name, F.coalesce(html, F.lit(""))), 0, F.contains(name, F.lit("<!--")))
    for n in range(1, 6):
        rows = again(rows, n)
    rows = rows.withColumn("_low", F.lower(name))
    for n in range(6, 14):  # entities
        rows = again(rows, n, F.contains("_low", F.lit(TO_TEXT[n][0].removeprefix("(?i)"))))
    rows = rows.drop("_low").withColumn(name, F.translate(name, "\t\r", "  "))
    rows = rows.withColumn(name, F.when(F.contains(name, F.lit("  ")), F.regexp_replace(name, "  +", " ")).otherwise(F.col(name)))
    return again(rows, 15, F.contains(name, F.lit("\n"))).withColumn(name, F.expr(f"trim(both ' \\n' from {name})"))


def _uuid(*parts: str) -> str:
    h = f"sha2(concat_ws('|', {', '.join(parts)}), 256)"
    return f"concat('<urn:uuid:', substr({h}, 1, 8), '-', substr({h}, 9, 4), '-5', substr({h}, 14, 3), '-8', substr({h}, 18, 3), '-', substr({h}, 21, 12), '>')"


#: The block of a page's response, before its payload.
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8"


def response_records(pages: DataFrame) -> DataFrame:
    """page_id and record: a whole WARC response record of each row of pages (page_id, url, html), with its declared payload digest. Null fields count as empty; line ends in a url end it."""
    payload, uri = F.coalesce("html", F.lit("")), F.coalesce(F.regexp_extract("url", "^[^\r\n]*", 0), F.lit(""))
    rows = pages.select("page_id", payload.alias("_payload"), uri.alias("_uri"), F.sha2(payload.cast("binary"), 256).alias("_digest"))
    rows = rows.withColumn("_id", F.expr(_uuid("'response'", "coalesce(cast(page_id as string), '')", "_uri", "_digest")))
    line = lambda name, *c: F.concat(F.lit(f"{name}: "), *c, F.lit("\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\n"), line("WARC-Record-ID", "_id"), line("WARC-Target-URI", "_uri"), line("WARC-Date", F.lit(NO_DATE)), line("WARC-Payload-Digest", F.lit("sha256:"), "_digest"),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", (F.octet_length("_payload") + len(_HTTP) + 4).cast("string")), F.lit("\r\n"),
    )
    return rows.select("page_id", F.concat(head, F.lit(_HTTP + "\r\n\r\n"), "_payload", F.lit("\r\n\r\n")).alias("record"))


def responses(records: DataFrame, *keys: str) -> DataFrame:
    """Responses (see RESPONSE) of records that each are one whole WARC record in UTF-8 (record): the header ends at the first blank line, the block is as long as it says."""
    cut = "instr(record, '\\r\\n\\r\\n')"
    rows = records.select(*keys, F.expr(f"substring(record, 1, {cut} - 1)").alias("_head"), F.expr(f"substring(record, {cut} + 4)").alias("_rest"))
    rows = rows.withColumn("_block", F.expr("if(right(_rest, 4) = '\\r\\n\\r\\n', substring(_rest, 1, length(_rest) - 4), _rest)")).withColumn("_at", F.expr("instr(_block, '\\r\\n\\r\\n')"))
    of = lambda name: F.regexp_extract("_head", rf"(?im)^{name}: *([^\r\n]*)", 1)
    http, payload = F.expr("if(_at > 0, substring(_block, 1, _at - 1), _block)"), F.expr("if(_at > 0, substring(_block, _at + 4), '')")
    found = F.struct(of("WARC-Record-ID").alias("record_id"), of("WARC-Target-URI").alias("target_uri"), of("WARC-Date").alias("date"), http.alias("http_headers"), payload.alias("payload"), F.col("_head").alias("warc_headers"), of("WARC-Payload-Digest").alias("payload_digest"), of("WARC-Block-Digest").alias("block_digest"))
    # other records go by an empty array: a filter would be moved below and make each record twice
    rows = rows.select(*keys, F.explode(F.when(of("WARC-Type") == "response", F.array(found))).alias("r")).select(*keys, "r.*")
    return rows.withColumn("raw", F.col("payload").cast("binary"))


def derivatives(found: DataFrame, *keys: str) -> DataFrame:
    """Two records per response: keys, record_type, record_id, refers_to, target_uri, date, content_type, source_headers, source_digest, block_digest, content_length, block.

    source_digest is the SHA-256 of the payload's bytes, block_digest that of the UTF-8 block; what the source's WARC header declares is in the metadata block. Empty payloads have an empty conversion block; null fields count as empty, a null date as NO_DATE;
    responses that repeat give records that repeat.
    """
    text = lambda c: F.coalesce(c, F.lit(""))
    declared = lambda name, c: F.when(F.col(c) != "", F.concat(F.lit(f"{name}: "), F.regexp_replace(c, "\r?\n", " | "), F.lit("\n"))).otherwise(F.lit(""))
    base = found.select(*keys, *(text(c).alias(c) for c in ("record_id", "target_uri", "http_headers", "payload", "warc_headers")), text(F.col("payload_digest")).alias("_payload_digest"), text(F.col("block_digest")).alias("_block_digest"), F.coalesce("raw", text(F.col("payload")).cast("binary")).alias("raw"), F.coalesce("date", F.lit(NO_DATE)).alias("date"))
    base = base.withColumn("source_digest", F.concat(F.lit("sha256:"), F.sha2("raw", 256)))
    base = with_text(base, "payload", "_text")
    fields = F.concat(F.lit("source-record: "), "record_id", F.lit("\nsource-uri: "), "target_uri", F.lit("\nsource-digest: "), "source_digest", F.lit("\nsource-length: "), F.octet_length("raw").cast("string"), F.lit("\ntext-length: "), F.octet_length("_text").cast("string"), F.lit("\nsource-headers: "), F.regexp_replace("http_headers", "\r?\n", " | "), F.lit("\n"), declared("source-payload-digest", "_payload_digest"), declared("source-block-digest", "_block_digest"), declared("source-warc-headers", "warc_headers"))
    record = lambda kind, mime, block: F.struct(F.lit(kind).alias("record_type"), F.lit(mime).alias("content_type"), block.alias("block"))
    rows = base.select("*", F.explode(F.array(record("metadata", "application/warc-fields", fields), record("conversion", "text/plain", F.col("_text")))).alias("r"))
    return rows.select(
        *keys, "r.record_type", F.expr(_uuid("r.record_type", "record_id", "sha2(r.block, 256)")).alias("record_id"), F.col("record_id").alias("refers_to"), "target_uri", "date", "r.content_type",
        F.col("http_headers").alias("source_headers"), "source_digest", F.concat(F.lit("sha256:"), F.sha2(F.col("r.block").cast("binary"), 256)).alias("block_digest"), F.octet_length("r.block").cast("long").alias("content_length"), "r.block",
    )


def _unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; a body that is not chunked as it says stays as it is."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        try:
            size = int(body[at:end].split(b";")[0], 16) if end >= 0 else -1
        except ValueError:
            size = -1
        if size < 0 or end + 2 + size > len(body):
            return body
        if not size:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size


def _text_of(http: str, payload: bytes) -> str:
    """A payload's text: transfer and content encodings undone, in the declared character set, else UTF-8; bytes that are none become U+FFFD."""
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.splitlines()[1:])}
    if "chunked" in fields.get("transfer-encoding", "").lower():
        payload = _unchunked(payload)
    try:
        for coding in reversed([x.strip().lower() for x in fields.get("content-encoding", "").split(",") if x.strip()]):
            payload = gzip.decompress(payload) if coding in ("gzip", "x-gzip") else zlib.decompress(payload) if coding == "deflate" else payload
    except (OSError, EOFError, zlib.error):
        pass  # what cannot be undone is read as it stands
    named = re.search(r"charset=[\"']?([A-Za-z0-9_.:-]+)", fields.get("content-type", ""), re.I)
    try:
        return payload.decode(named[1] if named else "utf-8", "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def _parsed(stream):
    """Response records of one WARC file's bytes, uncompressed, one at a time. A record without a length that can be read is passed over up to the next one."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        head, lines = {}, [line]
        while (line := stream.readline()).strip():
            lines.append(line)
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip()
        if not head.get("content-length", "").isdecimal():
            continue
        body = stream.read(int(head["content-length"]))
        if head.get("warc-type") == "response":
            http, _, payload = body.partition(b"\r\n\r\n")
            shown = http.decode("utf-8", "replace")
            yield {"record_id": head.get("warc-record-id", ""), "target_uri": head.get("warc-target-uri", ""), "date": head.get("warc-date", NO_DATE), "http_headers": shown, "payload": _text_of(shown, payload),
                   "raw": payload, "warc_headers": b"".join(lines).decode("utf-8", "replace").rstrip("\r\n"), "payload_digest": head.get("warc-payload-digest", ""), "block_digest": head.get("warc-block-digest", "")}


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Response records of WARC files, plain or gzip; one task a file, as a WARC file cannot be split."""

    def run(batches):
        for b in batches:
            for raw in b.column(0).to_pylist():
                rows = _parsed(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(raw))) if raw[:2] == b"\x1f\x8b" else io.BytesIO(raw))
                while some := list(itertools.islice(rows, 200)):
                    yield pa.RecordBatch.from_pylist(some, pa.schema([(c, pa.binary() if kind == "binary" else pa.string()) for c, kind in map(str.split, RESPONSE.split(", "))]))

    return mapped(spark.read.format("binaryFile").load(path).select("content"), run, RESPONSE)


def as_warc(records: DataFrame):
    """Adds `warc`: each derivative record in WARC 1.1 form, ready to be concatenated to a file."""
    line = lambda name, c: F.concat(F.lit(f"{name}: "), c, F.lit("\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", F.col("record_id")), line("WARC-Refers-To", F.col("refers_to")), line("WARC-Target-URI", F.col("target_uri")),
        line("WARC-Date", F.col("date")), line("WARC-Block-Digest", F.col("block_digest")), line("Content-Type", F.col("content_type")), line("Content-Length", F.col("content_length").cast("string")), F.lit("\r\n"),
    )
    return records.withColumn("warc", F.concat(head, F.col("block"), F.lit("\r\n\r\n")))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of all `pages`, each written as a WARC response record and read back from it."""
    return derivatives(responses(response_records(table(spark, sf_dir, "pages")), "page_id"), "page_id")


def _oracle() -> str:
    text = "coalesce(html, '')"
    for pattern, to in TO_TEXT:
        flags, p = ("i" if "i" in pattern[:5] and pattern.startswith("(?") else "") + ("s" if pattern.startswith("(?is)") else ""), pattern.split(")", 1)[1] if pattern.startswith("(?i") else pattern
        text = "regexp_replace({}, {}, {}, 'g{}')".format(text, *("'" + s.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '").replace("\r", "' || chr(13) || '") + "'" for s in (p, to)), flags)
    uuid = lambda h: f"'<urn:uuid:' || substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-8' || substr({h}, 18, 3) || '-' || substr({h}, 21, 12) || '>'"
    return f"""
WITH p AS (SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS payload, {text} AS txt FROM pages),
h AS (SELECT *, sha256(payload) AS ph, sha256('response|' || coalesce(CAST(page_id AS VARCHAR), '') || '|' || target_uri || '|' || sha256(payload)) AS hh FROM p),
b AS (SELECT *, {uuid("hh")} AS refers_to, 'sha256:' || ph AS source_digest, 'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' AS source_headers FROM h),
r AS (
  SELECT *, 'metadata' AS record_type, 'application/warc-fields' AS content_type,
    'source-record: ' || refers_to || chr(10) || 'source-uri: ' || target_uri || chr(10) || 'source-digest: ' || source_digest || chr(10) || 'source-length: ' || strlen(payload) || chr(10) || 'text-length: ' || strlen(txt) || chr(10)
    || 'source-headers: HTTP/1.1 200 OK | Content-Type: text/html; charset=utf-8' || chr(10) || 'source-payload-digest: ' || source_digest || chr(10)
    || 'source-warc-headers: WARC/1.1 | WARC-Type: response | WARC-Record-ID: ' || refers_to || ' | WARC-Target-URI: ' || target_uri || ' | WARC-Date: {NO_DATE} | WARC-Payload-Digest: ' || source_digest || ' | Content-Type: application/http; msgtype=response | Content-Length: ' || (strlen(payload) + 59) || chr(10) AS block FROM b
  UNION ALL SELECT *, 'conversion', 'text/plain', txt FROM b
), i AS (SELECT *, sha256(record_type || '|' || refers_to || '|' || sha256(block)) AS rh FROM r)
SELECT page_id, record_type, {uuid("rh")} AS record_id, refers_to, target_uri, '{NO_DATE}' AS date, content_type,
  source_headers, source_digest, 'sha256:' || sha256(block) AS block_digest, CAST(strlen(block) AS BIGINT) AS content_length, block
FROM i"""


ORACLE_SQL = _oracle()
