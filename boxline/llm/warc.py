"""WARC archives: writing captures, reading records, assembling transactions.

A capture is a request, a response (or a revisit of an equal payload) and a
metadata record, tied by WARC-Concurrent-To. Archives are gzip files in the
shared folder, written and read by Spark alone: every record ends in CRLF CRLF,
so the text writer with that line separator writes valid archives, and each file
is read as a stream whose records are cut by their Content-Length.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxline.llm.common import text_of
from boxline.sources.session import new_path

REVISIT_BYTES = 1000
FILE_BYTES = 32 << 20  # payload of one archive file, about
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# An archive needs a date for each record; captures without one share this.
EPOCH = "1970-01-01T00:00:00Z"

_CRLF = "\r\n"
_RECORDS = (
    "record_id string, record_type string, concurrent_to string, target_uri string, date string, block_bytes long, http_status int, "
    "payload_bytes long, payload_digest string, refers_to string, payload string"
)
_NAMES = [c.split()[0] for c in _RECORDS.split(", ")]
_PIECE = 1 << 20


def _uuid(key: Column, kind: str) -> Column:
    """URN of a record, derived from its key, so that a task run again writes the same."""
    h = F.md5(F.concat_ws("|", F.lit(kind), key))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def _record(fields: list[tuple[str, Column]], block: Column) -> Column:
    """Header lines and block; the writer's line separator ends the record. Fields that are null are left out."""
    lines = [F.when(v.isNotNull(), F.concat(F.lit(f"{name}: "), v, F.lit(_CRLF))).otherwise("") for name, v in fields]
    length = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(_CRLF * 2))
    return F.concat(F.lit("WARC/1.1" + _CRLF), *lines, length, block)


def _one_line(value: Column) -> Column:
    return F.regexp_replace(value, r"[\r\n]+", "%0A")


def decide(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """Adds ``_bytes``, ``_digest`` and ``_original`` (the page to refer to, null for a response) to rows of ``_page``, ``page_id``, ``_url`` and ``_html``.

    The largest id of each payload is aggregated before the shuffle; the join
    back is left to AQE's skew join where one payload is on very many pages.
    """
    measured = pages.withColumn("_bytes", F.octet_length("_html").cast("long")).withColumn("_digest", F.sha1("_html"))
    large = pages.select("page_id", "_html").where(F.octet_length("_html") >= least)
    repeated = large.groupBy(F.sha1("_html").alias("_key")).agg(F.max("page_id").alias("_last"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    joined = measured.join(repeated, (F.col("_digest") == F.col("_key")) & (F.col("_bytes") >= least), "left")
    original = F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("_last")), F.col("_last"))
    return joined.withColumn("_original", original).drop("_key", "_last")


def records_of(pages: DataFrame, html: str = "html", url: str = "url", least: int = REVISIT_BYTES) -> DataFrame:
    """Request, response or revisit, and metadata record of each page as text in column ``value``.

    Of equal payloads of at least ``least`` bytes the page with the largest id
    is the response; rows that share that id are all responses, and so are all
    rows of a payload whose ids are all null. Null html is an empty payload.
    """
    url_column = text_of(F.col(f"`{url}`")) if url in pages.columns else F.lit("")
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), _one_line(url_column).alias("_url"), text_of(F.col(f"`{html}`")).alias("_html"))
    rows = decide(slim, least)
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    # Equal rows get equal ids; they are told apart by a number that lives only until the records are written.
    key = F.concat_ws("|", page, F.col("_url"), F.col("_digest"), F.monotonically_increasing_id().cast("string"))
    rows = rows.withColumn("_k", key).withColumn("_page", page)
    capture = _uuid(F.col("_k"), "response")
    uri = F.when(F.col("_url") != "", F.col("_url"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: "), F.col("_bytes").cast("string"), F.lit(_CRLF * 2))
    revisit = F.col("_original").isNotNull()
    digest = F.concat(F.lit("sha1:"), F.col("_digest"))
    common = [("WARC-Target-URI", uri), ("WARC-Date", F.lit(EPOCH))]
    main = _record(
        [
            ("WARC-Type", F.when(revisit, "revisit").otherwise("response")), ("WARC-Record-ID", capture), *common, ("WARC-Payload-Digest", digest),
            ("WARC-Profile", F.when(revisit, PROFILE)), ("WARC-Refers-To", F.when(revisit, F.concat(F.lit("<urn:page:"), F.col("_original").cast("string"), F.lit(">")))),
            ("Content-Type", F.lit("application/http;msgtype=response")),
        ],
        F.when(revisit, http).otherwise(F.concat(http, F.col("_html"))),
    )
    ask = F.concat(F.lit("GET "), F.coalesce(uri, F.lit("/")), F.lit(f" HTTP/1.1{_CRLF * 2}"))
    request = _record([("WARC-Type", F.lit("request")), ("WARC-Record-ID", _uuid(F.col("_k"), "request")), ("WARC-Concurrent-To", capture), *common, ("Content-Type", F.lit("application/http;msgtype=request"))], ask)
    about = F.concat(F.lit("page: "), F.col("_page"), F.lit(_CRLF))
    metadata = _record([("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", _uuid(F.col("_k"), "metadata")), ("WARC-Concurrent-To", capture), *common, ("Content-Type", F.lit("application/warc-fields"))], about)
    return rows.select(F.explode(F.array(request, main, metadata)).alias("value"))


def write_archives(pages: DataFrame, path: str, html: str = "html", url: str = "url", least: int = REVISIT_BYTES, file_bytes: int = FILE_BYTES) -> str:
    """Write gzip archives of about ``file_bytes`` of payload at most; a null or empty table writes none.

    Each task writes the captures it holds, so no shuffle lays out the files and
    a task that runs again writes all records of its captures anew.
    """
    size, n = pages.agg(F.sum(F.octet_length(F.col(f"`{html}`"))), F.count(F.lit(1))).first()
    captures = max(1, file_bytes * n // ((size or 0) + 1000 * n)) if n else 1
    records = records_of(pages, html, url, least)
    records.write.option("maxRecordsPerFile", 3 * captures).option("lineSep", _CRLF * 2).option("compression", "gzip").text(path)
    return path


def _cut(chunks):
    """Header fields and block of each record of a stream of bytes."""
    held, ended = bytearray(), False
    chunks = iter(chunks)

    def more() -> bool:
        nonlocal ended
        part = next(chunks, None)
        ended = part is None
        held.extend(part or b"")
        return not ended

    while True:
        while (at := held.find(b"\r\n\r\n")) < 0 and more():
            pass
        if at < 0:
            if held.strip():
                raise ValueError("an archive ends within a record's header")
            return
        version, *lines = held[:at].decode("utf-8").lstrip("\r\n").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {version[:80]!r}")
        fields = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}
        end = at + 4 + int(fields["content-length"])
        while len(held) < end + 4 and more():
            pass
        if len(held) < end:
            raise ValueError("an archive ends within a record")
        yield fields, bytes(held[at + 4 : end])
        del held[: end + 4]


def _unzipped(data: bytes):
    """Pieces of a gzip file of any number of members, or of a plain file."""
    if data[:2] != b"\x1f\x8b":
        yield from (data[i : i + _PIECE] for i in range(0, len(data), _PIECE))
        return
    rest = data
    while rest:
        member = zlib.decompressobj(31)
        while not member.eof:
            part = member.decompress(rest, _PIECE)
            rest = member.unconsumed_tail or member.unused_data
            if not part and not member.eof and not rest:
                raise ValueError("an archive ends within a gzip member")
            yield part


def _parsed(fields: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    kind, status, size, digest, payload, stated = fields.get("warc-type"), None, None, None, None, None
    if kind in ("response", "revisit") and "msgtype=response" in fields.get("content-type", ""):
        head, _, body = block.partition(b"\r\n\r\n")
        first, *lines = head.decode("utf-8", "replace").split("\r\n")
        status = int(first.split()[1])
        stated = next((int(v) for n, _, v in (line.partition(":") for line in lines) if n.strip().lower() == "content-length"), None)
        digest = fields.get("warc-payload-digest", "").partition(":")[2] or None
        if kind == "response":
            size, found = len(body), hashlib.sha1(body).hexdigest()
            if digest is not None and digest != found:
                raise ValueError(f"payload of {fields['warc-record-id']} does not have its digest")
            digest, payload = found, body.decode("utf-8", "replace") if with_payload else None
        else:
            size = stated
    elif kind == "metadata":
        payload = block.decode("utf-8", "replace")
    return (fields["warc-record-id"], kind, fields.get("warc-concurrent-to"), fields.get("warc-target-uri"), fields.get("warc-date"), len(block), status, size, digest, fields.get("warc-refers-to"), payload)


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives in a folder. Payloads are checked against their digests.

    A revisit states the size and digest of the payload it leaves out. Without
    ``with_payload`` the payloads of responses are measured and not returned.
    """
    types = [pa.string()] * 5 + [pa.int64(), pa.int32(), pa.int64()] + [pa.string()] * 3

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for fields, block in _cut(_unzipped(content.as_py())):
                    rows.append(_parsed(fields, block, with_payload))
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], _NAMES)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], _NAMES)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(run, _RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture_id``, ``response``, ``request``, ``metadata`` (structs of record columns).

    Requests and metadata join the response or revisit that they name, or that
    the request they name belongs to; a response may also name its request.
    Of several requests or metadata records of a capture the one with the
    smallest id counts, and of repeated records one. Captures without request or
    metadata have null there; records that lead to no response are left out.
    """
    columns = [F.col(c) for c in _NAMES]
    main = records.where(F.col("record_type").isin("response", "revisit"))
    main = main.select(F.col("record_id").alias("capture_id"), F.col("concurrent_to").alias("_names"), F.struct(*columns).alias("response"))
    requests = records.where("record_type = 'request'").select(F.col("record_id").alias("_id"), F.col("concurrent_to").alias("_to"), F.struct(*columns).alias("_record"))
    # Request to capture, by either side's pointer.
    pointed = main.where("_names is not null").select(F.col("capture_id").alias("_capture"), "_names")
    requests = requests.join(pointed, requests["_id"] == pointed["_names"], "left").withColumn("_capture", F.coalesce("_capture", "_to")).where("_capture is not null")
    request = requests.groupBy("_capture").agg(F.min("_record").alias("request"))
    extra = records.where("record_type = 'metadata' and concurrent_to is not null").select(F.col("concurrent_to").alias("_to"), F.struct(*columns).alias("_record"))
    hops = requests.select("_id", F.col("_capture").alias("_via")).distinct()
    extra = extra.join(hops, extra["_to"] == hops["_id"], "left").withColumn("_capture", F.coalesce("_via", "_to"))
    metadata = extra.groupBy("_capture").agg(F.min("_record").alias("metadata"))
    out = main.join(request.withColumnRenamed("_capture", "_c1"), F.col("capture_id") == F.col("_c1"), "left")
    out = out.join(metadata.withColumnRenamed("_capture", "_c2"), F.col("capture_id") == F.col("_c2"), "left")
    return out.select("capture_id", "response", "request", "metadata").dropDuplicates(["capture_id"])


def round_trip(pages: DataFrame, html: str = "html", url: str = "url", least: int = REVISIT_BYTES) -> DataFrame:
    """Write archives of the pages, read them back and give one row per page from its capture.

    ``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``, ``url``.
    """
    path = write_archives(pages, new_path(pages.sparkSession, "llm-warc"), html, url, least)
    captures = assemble(read_records(pages.sparkSession, path, with_payload=False))
    page = F.regexp_extract("metadata.payload", r"^page: (-?\d+)", 1)
    return captures.select(
        F.when(page != "", page.cast("long")).alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.record_type").alias("record_type"),
        F.expr("try_cast(regexp_extract(response.refers_to, 'page:(-?[0-9]+)', 1) as bigint)").alias("refers_to"),
        F.col("response.target_uri").alias("url"),
    )


ORACLE = f"""WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
    q AS (SELECT *, octet_length(encode(h)) AS n, max(page_id) OVER (PARTITION BY h) AS last FROM p)
    SELECT page_id, n::BIGINT AS payload_bytes, sha1(h) AS payload_digest,
      CASE WHEN n >= {REVISIT_BYTES} AND (page_id < last OR page_id IS NULL AND last IS NOT NULL) THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN n >= {REVISIT_BYTES} AND (page_id < last OR page_id IS NULL AND last IS NOT NULL) THEN last END AS refers_to, nullif(url, '') AS url FROM q"""
