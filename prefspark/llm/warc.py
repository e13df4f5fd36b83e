"""Operator 3, WARC archives and transaction assembly.

``write_archives`` turns captures into request, response (or revisit) and
metadata records and lets Spark's text writer put them into gzip files: a record
is a row, and the row separator is the blank lines that end a WARC record. It
works on any store that Spark can write. ``read_records`` reads such archives as
a stream of pieces between version lines and restores each record by its
Content-Length, so a payload may hold such a line or a record's end itself. ``assemble`` joins the records of a transaction
through WARC-Concurrent-To and gives one nested row per capture.

Of captures with equal payloads of at least ``revisit_least`` bytes, that with
the largest id is written as a response; the others are revisits of it that hold
the HTTP header and the digest, but no payload.

A capture is named ``<id>-<hash of url and payload>``: rows that repeat an id
with another payload stay apart. Rows repeated as a whole are captures of their own,
named ``...-2``, ``...-3`` and so on; the first of them can be the response.
Where several request or metadata records name one capture, the one with the
smallest id is shown, and their number beside it.
Defined results: a null payload is the empty one, a null URL the empty URL, a
null id is kept and reads back as null; control characters and blanks of a URL
become ``_`` in the headers; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prefspark.llm.common import prepare, saved, table, texts_of
from prefspark.session import ensure_checkpoint_dir

REVISIT_LEAST = 0
MAX_RECORDS = 200_000  # of one file
_END = "\r\n\r\n"
_VERSION = "WARC/1.1\r\n"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(digest: Column) -> Column:
    """Upper-case base32 of a SHA-1 digest, from its hex digits five bits at a
    time: bit 5i starts in hex digit 5i / 4."""

    def symbol(i):
        two = F.conv(F.substring(digest, i * 5 // 4 + 1, 2), 16, 10).cast("int")
        down = F.shiftright(two, 3 - i * 5 % 4)
        return F.substring(F.lit(_BASE32), F.pmod(down, F.lit(32)) + 1, F.lit(1))

    return F.concat(*[symbol(i) for i in range(32)])


def _record(kind: Column, capture: Column, fields: list[tuple[str, Column]], block: Column) -> Column:
    head = [F.lit(_VERSION), F.lit("WARC-Type: "), kind, F.lit("\r\nWARC-Record-ID: <urn:capture:"), capture, F.lit(":"), kind, F.lit(">\r\n")]
    for name, value in fields:  # a null field is left out
        head.append(F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit("")))
    size = F.octet_length(block).cast("string")
    return F.concat(*head, F.lit("Content-Length: "), size, F.lit(_END), block)


def write_archives(
    captures: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    revisit_least: int = REVISIT_LEAST,
) -> None:
    """One request, one response or revisit, and one metadata record per capture."""
    rows = captures.select(
        F.col(id_col).alias("id"),
        F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), r"[\x00-\x20\x7F]", "_").alias("url"),
        F.coalesce(F.col(payload_col), F.lit("")).alias("payload"),
    ).withColumn("sha", F.sha1("payload"))
    named = F.concat_ws("-", F.coalesce(F.col("id").cast("string"), F.lit("null")), F.hex(F.xxhash64("url", "sha")))
    large = F.octet_length("payload") >= revisit_least
    rows = rows.withColumn("capture", named)
    # One narrow row per capture with the number of its rows.
    counted = saved(rows.groupBy("sha", large.alias("large"), "id", "capture").agg(F.count("*").alias("m")))
    groups = counted.where("large").groupBy("sha").agg(F.max(F.struct("id", "capture")).alias("last"), F.sum("m").alias("n"))
    groups = groups.where("n > 1").select(F.col("sha").alias("of"), F.col("last.capture").alias("keeper"))
    told = counted.join(groups, F.col("large") & (F.col("sha") == F.col("of")), "left").where("m > 1 or keeper is not null")
    rows = rows.join(told.select(F.col("capture").alias("named"), "m", "keeper"), F.col("capture") == F.col("named"), "left").drop("named")
    # Rows repeated as a whole are equal: one of them, as often as there are.
    again = F.coalesce(F.col("m"), F.lit(1)) > 1
    single = rows.where(~again).withColumn("turn", F.lit(1).cast("bigint"))
    kept = rows.where(again).groupBy("capture", "id", "url", "sha", "m", "keeper").agg(F.first("payload").alias("payload"))
    rows = single.unionByName(kept.withColumn("turn", F.explode(F.sequence(F.lit(1).cast("bigint"), "m"))))
    revisit = F.col("keeper").isNotNull() & ((F.col("keeper") != F.col("capture")) | (F.col("turn") > 1))
    rows = rows.withColumn("revisit", revisit).withColumn(
        "capture", F.when(F.col("turn") > 1, F.concat_ws("-", "capture", F.col("turn").cast("string"))).otherwise(F.col("capture"))
    )
    revisit = F.col("revisit")
    urn = lambda capture, kind: F.concat(F.lit("<urn:capture:"), capture, F.lit(f":{kind}>"))
    kind = F.when(revisit, "revisit").otherwise("response")
    own = F.when(revisit, urn(F.col("capture"), "revisit")).otherwise(urn(F.col("capture"), "response"))
    date = F.date_format(F.timestamp_seconds(F.lit(1_600_000_000) + F.pmod(F.coalesce("id", F.lit(0)), F.lit(10**8))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    common = [("WARC-Date", date), ("WARC-Target-URI", F.col("url"))]
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length("payload").cast("string"),
        F.lit(_END),
    )
    answer = _record(
        kind,
        F.col("capture"),
        [
            *common,
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_sha1(F.col("sha")))),
            ("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            ("WARC-Refers-To", F.when(revisit, urn(F.col("keeper"), "response"))),
            ("Content-Type", F.lit("application/http;msgtype=response")),
        ],
        F.when(revisit, http).otherwise(F.concat(http, F.col("payload"))),
    )
    request = _record(
        F.lit("request"),
        F.col("capture"),
        [*common, ("WARC-Concurrent-To", own), ("Content-Type", F.lit("application/http;msgtype=request"))],
        F.concat(
            F.lit("GET "),
            F.coalesce(F.nullif(F.regexp_extract("url", r"^[a-zA-Z]+://[^/?#]*([^#]*)", 1), F.lit("")), F.lit("/")),
            F.lit(" HTTP/1.1\r\nHost: "),
            F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#]*)", 1),
            F.lit(_END),
        ),
    )
    metadata = _record(
        F.lit("metadata"),
        F.col("capture"),
        [*common, ("WARC-Concurrent-To", own), ("Content-Type", F.lit("application/warc-fields"))],
        F.concat(F.lit("captureId: "), F.col("capture"), F.lit("\r\nvia: "), F.col("url"), F.lit("\r\n")),
    )
    lines = rows.select(F.explode(F.array(request, answer, metadata)).alias("value"))
    lines.write.option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", MAX_RECORDS).text(path)


_COLUMNS = [
    ("record_id", pa.string()),
    ("record_type", pa.string()),
    ("date", pa.string()),
    ("url", pa.string()),
    ("concurrent_to", pa.string()),
    ("refers_to", pa.string()),
    ("first_line", pa.string()),
    ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()),
    ("payload", pa.string()),
]


def _fields(head: bytes) -> dict[str, str]:
    lines = (x.partition(b":") for x in head.split(b"\r\n") if b":" in x)
    return {k.strip().lower().decode(): v.strip().decode("utf-8", "surrogatepass") for k, _, v in lines}


def parse(record: bytes, keep_payload: bool) -> tuple | None:
    """The row of one record (without its version line); None while its block is
    shorter than its Content-Length. Digest and size are those of the payload
    itself; a revisit has none and states them in its headers."""
    head, gap, block = record.partition(b"\r\n\r\n")
    f = _fields(head)
    size = int(f["content-length"])
    if not gap or len(block) < size:
        return None
    if block[size:] != _END.encode():
        raise ValueError(f"{f['warc-record-id']} is followed by {block[size : size + 40]!r}")
    block = block[:size]
    first, payload, n, digest = block.partition(b"\r\n")[0], None, None, None
    if f["warc-type"] in ("response", "revisit"):
        http, _, payload = block.partition(b"\r\n\r\n")
        n, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if f["warc-type"] == "revisit":
            n, digest = int(_fields(http)["content-length"]), f["warc-payload-digest"].removeprefix("sha1:")
        elif f["warc-payload-digest"] != f"sha1:{digest}":
            raise ValueError(f"digest of {f['warc-record-id']} differs from its payload's")
    body = payload.decode("utf-8", "surrogatepass") if keep_payload and payload is not None else None
    return (
        f["warc-record-id"], f["warc-type"], f.get("warc-date"), f.get("warc-target-uri"), f.get("warc-concurrent-to"),
        f.get("warc-refers-to"), first.decode("utf-8", "surrogatepass"), n, digest, body,
    )


def read_records(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """One row per record. Gzip files are read whole by one task each, in order,
    as pieces between version lines; a piece too short for its Content-Length goes
    on in the next, and one that is too long is an error."""
    prepare(spark)
    # The separator must not overlap itself: after a part of it, Hadoop's reader
    # doesn't go back over the edge of its buffer.
    pieces = spark.read.option("lineSep", _VERSION).text(path)
    names = [n for n, _ in _COLUMNS]

    def run(batches):
        open_ = None
        for b in batches:
            rows = []
            for piece in texts_of(b.column(0)):
                if open_ is not None:
                    piece = open_ + _VERSION.encode() + piece
                elif not piece:  # before a file's first record
                    continue
                row = parse(piece, keep_payload)
                open_ = None if row else piece
                if row:
                    rows.append(row)
            columns = zip(*rows) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _COLUMNS)], names)
        if open_ is not None:
            raise ValueError("an archive ends within a record")

    schema = ", ".join(f"{n} {'bigint' if t == pa.int64() else 'string'}" for n, t in _COLUMNS)
    return pieces.mapInArrow(run, schema)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: its response or revisit, with the request and
    the metadata that name it in WARC-Concurrent-To, and how many there are."""
    kind = F.col("record_type")
    answer = F.struct("record_type", "first_line", "payload_bytes", "payload_digest", "refers_to", "payload")
    line = F.struct(F.col("record_id").alias("id"), "first_line")
    answers = kind.isin("response", "revisit")
    whole = F.when(answers, F.struct("url", "date", answer.alias("response")))
    of = F.when(answers, F.col("record_id")).otherwise(F.col("concurrent_to"))
    out = records.groupBy(of.alias("record_id")).agg(
        F.max(whole).alias("whole"),
        *[F.min(F.when(kind == k, line)).alias(k) for k in ("request", "metadata")],
        *[F.count(F.when(kind == k, 1)).alias(f"n_{k}") for k in ("request", "metadata")],
    )
    return out.where("whole is not null").select("record_id", "whole.*", "request", "metadata", "n_request", "n_metadata")


def _id_of(urn: Column) -> Column:
    return F.nullif(F.regexp_extract(urn, r"^<urn:capture:(-?\d+)-", 1), F.lit("")).cast("bigint")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages to archives, reads them back and assembles the captures."""
    prepare(spark)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages"), path)
    whole = assemble(read_records(spark, path, keep_payload=False))
    return whole.select(
        _id_of(F.col("record_id")).alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.record_type").alias("record_type"),
        _id_of(F.col("response.refers_to")).alias("refers_to"),
        F.col("request.first_line").alias("request_line"),
        F.col("metadata.first_line").alias("capture_field"),
    )
