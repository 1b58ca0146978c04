"""WARC derivatives: metadata and plain-text conversion records of responses, in DataFrame functions.

Each response gives two records.  ``metadata`` holds the source's headers and what its markup
declares; ``conversion`` is its plain text.  Both name the response in WARC-Refers-To, keep its
target, date and payload digest, and have digests of their own blocks and identifiers drawn from the
response's, so that building them again gives the same records.

Defined cases: a null page or header counts as empty; a null URL leaves the target out of the header
text; a response whose id is null gets one from its URL and payload; repeated rows give repeated
records; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm.quality import let

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2024-01-01T00:00:00Z"
#: Markup that starts a new line of plain text (fixed value).
BLOCK_TAGS = "p|div|br|li|ul|ol|h[1-6]|tr|table|section|article|header|footer|nav|aside|title|blockquote|pre"
#: Entities in the order in which they are replaced (fixed value).
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&amp;": "&"}


def digest(block: Column) -> Column:
    """``sha1:`` and the SHA-1 in base 32."""
    def base32(hexes: Column) -> Column:
        # 40 bits at a time, in the digits 0-9 and A-V of conv
        eight = [F.lpad(F.conv(F.substring(hexes, i, 10), 16, 32), 8, "0") for i in (1, 11, 21, 31)]
        return F.translate(F.concat(*eight), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)

    # bound once: the block would be hashed for each piece
    return F.concat(F.lit("sha1:"), let(F.sha1(F.encode(block, "UTF-8")), base32))


def record_id(*parts: Column) -> Column:
    """A stable urn:uuid of the parts."""
    h = F.md5(F.concat_ws("|", *parts))
    piece = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), piece(1, 8), F.lit("-"), piece(9, 4), F.lit("-"), piece(13, 4), F.lit("-"), piece(17, 4), F.lit("-"), piece(21, 12), F.lit(">"))


def plain_text(html: Column) -> Column:
    text = F.regexp_replace(html, "(?s)<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?is)<script\b.*?</script>", " ")
    text = F.regexp_replace(text, r"(?is)<style\b.*?</style>", " ")
    text = F.regexp_replace(text, rf"(?is)</?(?:{BLOCK_TAGS})(?:\s[^>]*)?/?>", "\n")
    text = F.regexp_replace(text, "(?s)<[^>]*>", "")
    for entity, shown in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(shown))
    text = F.regexp_replace(text, "[ \\t\\r]+", " ")
    return F.regexp_replace(F.regexp_replace(text, " ?\\n[ \\n]*", "\n"), r"\A[ \n]+|[ \n]+\z", "")


def responses(pages: DataFrame) -> DataFrame:
    """Response records of ``page_id``, ``url``, ``html`` rows."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    headers = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html).cast("string"))
    made = pages.select(F.col("page_id"), F.col("url").cast("string").alias("target_uri"), F.lit(DATE).alias("date"), headers.alias("headers"), html.alias("payload"))
    return made.select("page_id", record_id(F.lit("response"), F.col("page_id").cast("string"), F.col("target_uri")).alias("record_id"), "target_uri", "date", "headers", "payload", digest(F.col("payload")).alias("payload_digest"))


def derivatives(found: DataFrame, *carried: str) -> DataFrame:
    """Two records for each response: record_type, record_id, refers_to, target_uri, date, content_type, source_digest, block, block_digest, content_length."""
    base = found.select(
        *carried,
        F.coalesce("record_id", record_id(F.lit("response"), F.coalesce("target_uri", F.lit("")), F.coalesce("payload", F.lit("")))).alias("refers_to"),
        "target_uri", "date", F.coalesce("headers", F.lit("")).alias("headers"), F.coalesce("payload", F.lit("")).alias("payload"), "payload_digest",
    )
    base = base.withColumn("source_digest", F.coalesce("payload_digest", digest(F.col("payload"))))
    title = F.trim(F.regexp_replace(F.regexp_extract("payload", "(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))
    lang = F.regexp_extract("payload", "(?is)<html[^>]*\\blang=\"([^\"]*)\"", 1)
    links = F.size(F.regexp_extract_all("payload", F.lit("(?is)<a\\s[^>]*href="), 0)).cast("string")
    source = F.regexp_replace("headers", "(?m)^", "source-")
    metadata = F.concat(F.lit("title: "), title, F.lit("\r\nlanguage: "), lang, F.lit("\r\noutlinks: "), links, F.lit("\r\n"), F.replace(source, F.lit("source-HTTP/"), F.lit("source-status: HTTP/")), F.lit("\r\n"))
    both = F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"), metadata.alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), plain_text(F.col("payload")).alias("block")),
    )
    rows = base.select(*carried, "refers_to", "target_uri", "date", "source_digest", F.explode(both).alias("x")).select(*carried, "refers_to", "target_uri", "date", "source_digest", "x.*")
    return rows.select(
        *carried, "record_type", record_id(F.col("record_type"), F.col("refers_to")).alias("record_id"), "refers_to", "target_uri", "date", "content_type",
        "source_digest", "block", digest(F.col("block")).alias("block_digest"), F.octet_length("block").cast("long").alias("content_length"),
    )


_HEADERS = {"WARC-Type": "record_type", "WARC-Record-ID": "record_id", "WARC-Refers-To": "refers_to", "WARC-Target-URI": "target_uri", "WARC-Date": "date", "Content-Type": "content_type", "WARC-Source-Payload-Digest": "source_digest", "WARC-Block-Digest": "block_digest", "Content-Length": "content_length"}


def record_text(records: DataFrame) -> Column:
    """A record as it stands in a file, without the two line ends after it."""
    lines = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{k}: "), F.col(c).cast("string"), F.lit("\r\n"))).otherwise("") for k, c in _HEADERS.items()]
    return F.concat(F.lit("WARC/1.1\r\n"), *lines, F.lit("\r\n"), F.col("block"))


def write(records: DataFrame, folder: str, compression: str = "gzip") -> None:
    """WARC files, one a partition."""
    records.select(record_text(records).alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", compression).text(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Records of files that ``write`` made."""
    raw = spark.read.option("lineSep", "\r\n\r\nWARC/1.1\r\n").text(folder).select(F.regexp_replace("value", r"^WARC/1\.1\r\n", "").alias("value"))
    head, body = F.substring_index("value", "\r\n\r\n", 1), F.expr("substring(value, instr(value, '\\r\\n\\r\\n') + 4)")
    got = raw.select(head.alias("head"), body.alias("body"))
    field = lambda k: F.nullif(F.regexp_extract("head", rf"(?m)^{k}: ([^\r\n]*)", 1), F.lit(""))
    rows = got.select(*(field(k).alias(c) for k, c in _HEADERS.items()), "body").withColumn("content_length", F.col("content_length").cast("long"))
    # a file's last record still has its two line ends
    extra = F.octet_length("body") - F.col("content_length")
    return rows.withColumn("block", F.when(extra > 0, F.regexp_replace("body", r"\r\n\r\n\z", "")).otherwise(F.col("body"))).drop("body")
