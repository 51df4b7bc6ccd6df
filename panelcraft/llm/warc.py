"""WARC derivatives: linked metadata and plain-text conversion records made from response records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import query, table

#: Date given to records whose source has none.
NO_DATE = "1970-01-01T00:00:00Z"
#: (pattern, replacement) applied in turn to HTML; the last steps decode entities, ampersand last of all.
TO_TEXT = (
    (r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->", ""),
    (r"(?i)</?(p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|nav|header|footer|title|head|body|html)\b[^>]*>", "\n"),
    (r"<[^>]*>", ""),
    (r"&nbsp;", " "), (r"&lt;", "<"), (r"&gt;", ">"), (r"&quot;", '"'), (r"&#39;", "'"), (r"&middot;", "·"), (r"&copy;", "©"), (r"&amp;", "&"),
    (r"[ \t\r\f\x0B]+", " "),
    (r" ?\n[ \n]*", "\n"),
    (r"^[ \n]+|[ \n]+$", ""),
)
TITLE = r"(?is)<title[^>]*>(.*?)</title\s*>"
HREF = r"""(?i)<a\s[^>]*?href\s*=\s*["']?([^"'\s>]+)"""


def text_of(html: Column) -> Column:
    """Visible text of a page: no scripts, styles, comments or tags, one line per block."""
    for pattern, to in TO_TEXT:
        html = F.regexp_replace(html, pattern, to)
    return html


def sha256_of(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block, 256))


def record_id(*parts: Column) -> Column:
    """A urn:uuid made of the parts, so that a task that runs again writes the same id."""
    h = F.sha2(F.concat_ws("\n", *parts), 256)
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Response records of fetched pages: ``page_id, record_id, target_uri, date, http_headers, payload``.

    A null url or html counts as empty.
    """
    own = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("target_uri"), F.coalesce(F.col(html_col), F.lit("")).alias("payload"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit("\r\n"))
    return own.select("page_id", record_id(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.col("target_uri")).alias("record_id"),
                      "target_uri", F.lit(NO_DATE).alias("date"), head.alias("http_headers"), "payload")


def derivatives(records: DataFrame) -> DataFrame:
    """A metadata and a conversion record for each response record.

    Input as from ``responses``; further columns are ignored. Output per input row, two rows: ``page_id,
    record_type, record_id, refers_to, target_uri, refers_to_date, content_type, source_headers, source_digest,
    block_digest, block``. ``refers_to`` is the response's id, ``source_digest`` the digest of its payload and
    ``source_headers`` its HTTP headers, unchanged. The metadata block names the title, each link in page order
    and the conversion record, and the conversion record is plain text. A null payload, URI or header counts as
    empty and still gives both records; records that repeat give theirs again; an empty table gives no row.
    """
    own = records.select("page_id", "record_id", F.coalesce("target_uri", F.lit("")).alias("target_uri"), F.coalesce("date", F.lit(NO_DATE)).alias("date"),
                         F.coalesce("http_headers", F.lit("")).alias("http_headers"), F.coalesce(F.col("payload"), F.lit("")).alias("payload"))
    text = text_of(F.col("payload"))
    conversion_id = record_id(F.lit("conversion"), F.coalesce("record_id", F.lit("")))
    metadata_id = record_id(F.lit("metadata"), F.coalesce("record_id", F.lit("")))
    title = F.trim(F.regexp_replace(F.regexp_extract("payload", TITLE, 1), r"[\s]+", " "))
    links = F.regexp_extract_all("payload", F.lit(HREF), F.lit(1))
    lines = F.concat(F.array(F.concat(F.lit("title: "), title)), F.transform(links, lambda x: F.concat(F.lit("outlink: "), x)),
                     F.array(F.concat(F.lit("conversion: "), conversion_id)))
    made = F.array(
        F.struct(F.lit("metadata").alias("record_type"), metadata_id.alias("new_id"), F.lit("application/warc-fields").alias("content_type"),
                 F.concat(F.array_join(lines, "\r\n"), F.lit("\r\n")).alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), conversion_id.alias("new_id"), F.lit("text/plain; charset=utf-8").alias("content_type"), text.alias("block")))
    rows = own.select("page_id", "record_id", "target_uri", "date", "http_headers", sha256_of(F.col("payload")).alias("source_digest"), F.explode(made).alias("r"))
    return rows.select(
        "page_id", "r.record_type", F.col("r.new_id").alias("record_id"), F.col("record_id").alias("refers_to"), "target_uri", F.col("date").alias("refers_to_date"),
        "r.content_type", F.col("http_headers").alias("source_headers"), "source_digest", sha256_of(F.col("r.block")).alias("block_digest"), "r.block")


def warc_bytes(records: DataFrame, date: str = NO_DATE) -> DataFrame:
    """``record_id, warc``: each derivative as the bytes of one WARC/1.1 record, ready to be joined into files."""
    fields = (("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Refers-To-Target-URI", "target_uri"),
              ("WARC-Refers-To-Date", "refers_to_date"), ("WARC-Target-URI", "target_uri"), ("WARC-Block-Digest", "block_digest"),
              ("WARC-Source-Payload-Digest", "source_digest"), ("Content-Type", "content_type"))
    head = [F.lit(f"WARC/1.1\r\nWARC-Date: {date}\r\n")]
    for name, column in fields:
        head += [F.lit(f"{name}: "), F.regexp_replace(F.coalesce(F.col(column), F.lit("")), r"[\r\n]+", " "), F.lit("\r\n")]
    source = F.base64(F.encode("source_headers", "UTF-8"))
    head += [F.lit("WARC-Source-HTTP-Headers: "), F.regexp_replace(source, r"\s", ""), F.lit("\r\nContent-Length: "), F.octet_length("block").cast("string"), F.lit("\r\n\r\n")]
    return records.select("record_id", F.encode(F.concat(*head, F.col("block"), F.lit("\r\n\r\n")), "UTF-8").alias("warc"))


def _oracle() -> str:
    def lit(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    text = "payload"
    for pattern, to in TO_TEXT:
        new = "chr(10)" if to == "\n" else lit(to)
        text = f"regexp_replace({text}, {lit(pattern)}, {new}, 'g')"
    uuid = "'<urn:uuid:' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] || '>'"
    crlf = "chr(13) || chr(10)"

    def made(kind: str, of: str) -> str:
        return uuid.replace("h[", f"sha256('{kind}' || chr(10) || {of})[")

    return rf"""
WITH raw AS (SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS payload FROM pages),
resp AS (SELECT *, {made('response', "coalesce(page_id::VARCHAR, '') || chr(10) || target_uri")} AS refers_to,
    'HTTP/1.1 200 OK' || {crlf} || 'Content-Type: text/html; charset=utf-8' || {crlf} || 'Content-Length: ' || octet_length(encode(payload)) || {crlf} AS source_headers,
    'sha256:' || sha256(payload) AS source_digest FROM raw),
ids AS (SELECT *, {made('metadata', 'refers_to')} AS mid, {made('conversion', 'refers_to')} AS cid FROM resp),
both_kinds AS (
    SELECT *, 'metadata' AS record_type, mid AS record_id, 'application/warc-fields' AS content_type,
        'title: ' || trim(regexp_replace(regexp_extract(payload, {lit(TITLE)}, 1), '[\s]+', ' ', 'g'), ' ') || {crlf}
        || array_to_string(list_concat(list_transform(regexp_extract_all(payload, {lit(HREF)}, 1), lambda x: 'outlink: ' || x), ['conversion: ' || cid]), {crlf}) || {crlf} AS block
    FROM ids
    UNION ALL SELECT *, 'conversion', cid, 'text/plain; charset=utf-8', {text} FROM ids)
SELECT page_id, record_type, record_id, refers_to, target_uri, '{NO_DATE}' AS refers_to_date, content_type, source_headers, source_digest,
    'sha256:' || sha256(block) AS block_digest, block FROM both_kinds"""


@query("op5_warc_derivatives", sql=_oracle())
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derivatives(responses(table(spark, sf_dir, "pages")))
