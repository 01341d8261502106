"""Content-addressed WARC archive: payload bytes once, exact record headers apart, records restored by joins.

An archive is a folder of three tables:

* payloads(digest, payload): each distinct payload once, by its SHA-256;
* records(digest, content, header): for every record its exact header block, down to the blank line, and whether it has content;
* uses(digest, last_id, last_row, n): the response that revisits of a payload refer to, and how many records the payload has.

Of records with equal payloads of at least `least` bytes, that with the largest page_id is a response; the others are
revisits that refer to it and have no content of their own. Shorter payloads are stored once too, but all their records
are responses. Record ids hold the page_id and a number of the row, so that they differ for repeated page ids.

Reading back: payloads are checked against their names, and sizes and SHA-1 digests taken, once for each payload. Records with
content are joined to payload bytes, and `record_bytes` puts header, content and line ends together. `parsed` reads a record's
bytes: it splits header lines at CR LF only, cuts the content by its length, and fails on a record that is cut or whose
payload digest isn't its payload's. All joins split payloads that very many records share (shared.join_hot).
`parse_records` reads records from bytes of any WARC file, by content length.

Null html is an empty payload; a null url has no address line. An address with CR, LF or U+0000 is percent-encoded in these
and in %, and a line of its own says so, which makes it reversible; all others stand as they are. Rows with a null page_id revisit their
payload's response if there is one, else they are responses. Repeated rows of the largest page_id are all responses. Empty
tables give empty archives. Very long pages are one record each. Columns other than the named ones are not stored.
"""

from __future__ import annotations

import gzip

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from collatio.functions.text import let

from .shared import join_hot, new_folder, settle

# The base32 alphabet and the profile address of revisit records.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# End of fixed values.
EMPTY_DATE = "1970-01-01T00:00:00Z"


def base32(hexed: Column) -> Column:
    """Upper-case base32 of 40 hexadecimal digits."""
    value = [F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 10).cast("int") for i in range(8)]
    return F.concat(*[F.substring(F.lit(BASE32), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for v in value for s in (15, 10, 5, 0)])


#: The line that says how an address is written, and characters that are encoded.
ESCAPED = "X-Target-URI-Encoding: percent"
ENCODED = {"%": "%25", "\r": "%0D", "\n": "%0A", "\x00": "%00"}


def named(page_id: Column, row: Column) -> Column:
    """A record's id."""
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(":"), row.cast("string"), F.lit(">"))


def address(url: Column) -> Column:
    """The lines of a record's address."""
    encoded = url
    for raw, code in ENCODED.items():
        encoded = F.replace(encoded, F.lit(raw), F.lit(code))
    plain = F.concat(F.lit("WARC-Target-URI: "), url, F.lit("\r\n"))
    return F.when(url.isNull(), "").when(url.rlike("[\\r\\n\\x00]"), F.concat(F.lit("WARC-Target-URI: "), encoded, F.lit(f"\r\n{ESCAPED}\r\n"))).otherwise(plain)


def header(content: Column, page_id: Column, row: Column, url: Column, sha1: Column, size: Column, last_id: Column, last_row: Column) -> Column:
    """The header block of a record, with its blank line."""
    kind = F.when(content, "response").otherwise("revisit")
    refers = F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), named(last_id, last_row), F.lit("\r\n"))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), kind, F.lit("\r\nWARC-Record-ID: "), named(page_id, row), F.lit(f"\r\nWARC-Date: {EMPTY_DATE}\r\n"), address(url),
        F.lit("WARC-Payload-Digest: sha1:"), sha1, F.lit("\r\n"), F.when(content, "").otherwise(refers),
        F.lit("Content-Type: text/html; charset=utf-8\r\nContent-Length: "), F.when(content, size).otherwise(0).cast("string"), F.lit("\r\n\r\n"),
    )


def payload_facts(spark: SparkSession, folder: str) -> DataFrame:
    """(digest, size, sha1) of every stored payload, from its bytes; fails on a payload that doesn't match its name."""
    whole = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("digest"))).cast("binary"))
    read = spark.read.parquet(f"{folder}/payloads").select("digest", whole.alias("payload"))
    return read.select("digest", F.octet_length("payload").cast("long").alias("size"), base32(F.sha1("payload")).alias("sha1"))


def write_archive(pages: DataFrame, folder: str, least: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Stores a record for every row."""
    spark = pages.sparkSession
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    rows = settle(pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.sha2(payload, 256).alias("digest"), F.monotonically_increasing_id().alias("row")))
    # one shuffle of payloads, after copies inside a task are dropped; sorted, so that its memory is bounded
    stored = pages.select(payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    stored.groupBy("digest").agg(F.first("payload").alias("payload")).write.option("compression", "zstd").parquet(f"{folder}/payloads")
    last = F.max(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "row")))
    uses = rows.groupBy("digest").agg(last.alias("last"), F.count("*").alias("n")).select("digest", F.col("last.page_id").alias("last_id"), F.col("last.row").alias("last_row"), "n")
    uses.write.option("compression", "zstd").parquet(f"{folder}/uses")
    known = spark.read.parquet(f"{folder}/uses").join(payload_facts(spark, folder), "digest")
    found = join_hot(rows, settle(known), "digest", "n")
    revisit = (F.col("size") >= least) & F.col("last_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last_id"))
    found = found.withColumn("content", ~revisit)
    block = header(*[F.col(c) for c in ("content", "page_id", "row", "url", "sha1", "size", "last_id", "last_row")])
    found.select("digest", "content", block.alias("header")).write.option("compression", "zstd").parquet(f"{folder}/records")


def record_bytes() -> Column:
    """The bytes of a record as a WARC file has them, from its header and content."""
    return F.concat(F.encode("header", "UTF-8"), F.coalesce("payload", F.lit(b"")), F.lit(b"\r\n\r\n"))


def parsed(record: Column) -> Column:
    """(page_id, row, url, record_type, refers_to, sha1, length, content) from a record's bytes."""

    def fields(r: Column) -> Column:
        head = F.substring_index(r["bytes"].cast("string"), "\r\n\r\n", 1)
        return let(F.struct(r["bytes"].alias("bytes"), F.split(head, "\r\n").alias("lines"), F.octet_length(head).alias("size")), facts)

    def facts(x: Column) -> Column:
        field = lambda name: F.get(F.transform(F.filter(x["lines"], lambda v: v.startswith(f"{name}: ")), lambda v: F.substring(v, F.lit(len(name) + 3), F.length(v))), F.lit(0))
        number = lambda name, i: F.nullif(F.regexp_extract(field(name), "^<urn:page:(-?[0-9]+|null):([0-9]+)>$", i), F.lit("")).try_cast("long")
        length, begin = field("Content-Length").cast("int"), x["size"] + 5
        whole = (F.get(x["lines"], F.lit(0)) == "WARC/1.1") & (F.substring(x["bytes"], begin + length, F.octet_length(x["bytes"])) == F.lit(b"\r\n\r\n"))
        url = field("WARC-Target-URI")
        for raw, code in reversed(ENCODED.items()):
            url = F.when(F.array_contains(x["lines"], ESCAPED), F.replace(url, F.lit(code), F.lit(raw))).otherwise(url)
        good = F.struct(
            number("WARC-Record-ID", 1).alias("page_id"), number("WARC-Record-ID", 2).alias("row"), url.alias("url"), field("WARC-Type").alias("record_type"), number("WARC-Refers-To", 1).alias("refers_to"),
            F.substring_index(field("WARC-Payload-Digest"), "sha1:", -1).alias("sha1"), length.alias("length"), F.substring(x["bytes"], begin, length).alias("content"),
        )
        return F.when(F.coalesce(whole, F.lit(False)), good).otherwise(F.raise_error(F.lit("a record is cut")).cast(good_type))

    good_type = "struct<page_id: bigint, row: bigint, url: string, record_type: string, refers_to: bigint, sha1: string, length: int, content: binary>"
    return let(F.struct(record.alias("bytes")), fields)


def restored(spark: SparkSession, folder: str) -> DataFrame:
    """Every record: its digest, header, bytes, parsed fields, and its payload's size, all taken from what is stored.

    A revisit has no content; its payload is that of its digest (with_payloads).
    """
    records, payloads, uses = (spark.read.parquet(f"{folder}/{t}") for t in ("records", "payloads", "uses"))
    used = uses.select("digest", "n")
    full = join_hot(records.where("content"), payloads.join(used, "digest"), "digest", "n").select("digest", "header", "payload")
    slim = records.where("NOT content").select("digest", "header", F.lit(None).cast("binary").alias("payload"))
    read = full.unionAll(slim).select("digest", "header", record_bytes().alias("bytes")).withColumn("record", parsed(F.col("bytes")))
    facts = settle(payload_facts(spark, folder).withColumnRenamed("sha1", "payload_sha1").join(used, "digest"))
    found = join_hot(read, facts, "digest", "n")
    same = (F.col("record.sha1") == F.col("payload_sha1")) & ((F.col("record.record_type") == "revisit") | (F.col("record.length") == F.col("size")))
    sha1 = F.when(same, F.col("record.sha1")).otherwise(F.raise_error(F.concat(F.lit("a record's payload differs: "), F.col("digest"))))
    return found.select("digest", "header", "bytes", "record.page_id", "record.row", "record.url", "record.record_type", "record.refers_to", sha1.alias("sha1"), "size", "record.content")


def with_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """restored, with the full payload of revisits too."""
    payloads = spark.read.parquet(f"{folder}/payloads").join(spark.read.parquet(f"{folder}/uses").select("digest", "n"), "digest")
    return join_hot(restored(spark, folder), payloads, "digest", "n").drop("n")


def parse_records(data: bytes) -> list[tuple[dict[str, str], bytes]]:
    """(fields, content) of every record in the bytes of a WARC file, compressed or not."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    out, at = [], 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        size = int(fields["Content-Length"])
        content = data[end + 4 : end + 4 + size]
        if len(content) < size or data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} is cut")
        out.append((fields, content))
        at = end + 8 + size
    return out


def op8_warc_store(spark, sf_dir: str) -> DataFrame:
    """Every page's record, written to an archive, rebuilt from it and parsed."""
    folder = new_folder(spark, "warc")
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return restored(spark, folder).select("page_id", F.col("size").alias("payload_bytes"), F.col("sha1").alias("payload_digest"), "record_type", "refers_to")


OP8_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s FROM pages),
m AS (SELECT s, max(page_id) AS last FROM p GROUP BY s)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
    array_to_string(list_transform(generate_series(0, 31), lambda i: substr('{BASE32}', CAST(((CAST('0x' || substr(s, 5 * (i // 4) + 1, 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) + 1 AS INTEGER), 1)), '') AS payload_digest,
    CASE WHEN page_id IS NOT DISTINCT FROM last OR last IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id IS NOT DISTINCT FROM last OR last IS NULL THEN NULL ELSE last END AS refers_to
FROM p JOIN m USING (s)
"""
