"""WARC archives: writing captures and assembling them again.

*Writing.*  Each capture becomes a transaction of three records: the response (or a
revisit of an earlier payload), its request and its metadata, the latter two bound to the
first by ``WARC-Concurrent-To``.  Of captures with one payload of at least ``REVISIT_BYTES`` the
one with the largest id carries it.  Records are columns of text that Spark's text writer
puts into gzip files of about ``FILE_BYTES``, with the blank lines between records as separator,
so archives land in any file system Spark writes to.

*Reading.*  Files are read whole (their size is bounded by the writer) and parsed by
Content-Length.  Requests and metadata are then joined to their response through their
concurrent-to identifiers, giving one nested row per capture, payload included.  What is
asked of a revisit's payload comes from the response that it refers to.

Defined cases: a null payload is empty; a null url gives no target; a null id is kept as null;
identical rows are each a capture, with their equal requests and metadata listed once; of rows with
equal id and payload, the largest by url carries it; control characters in urls are
percent-encoded; requests without a response give a row without capture; a revisit of a response
that no archive holds has no payload (null); an empty table
gives an empty result; further columns are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerlake.llm.common import only, sized_join
from ledgerlake.sources.shared import materialize, shared_path

REVISIT_BYTES = 1000
FILE_BYTES = 16 * 2**20
# Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = "\r\n\r\n"

_RECORD = (
    "record_type string, record_id string, concurrent_to string, target_uri string, date string, "
    "refers_to string, payload_digest string, payload_bytes long, payload binary, "
    "fields map<string,string>"
)


def _header(fields: list[tuple[str, Column | str | None]]) -> Column:
    """Header lines; those of null value are left out."""
    lines = [
        F.concat(F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value.cast("string"), F.lit("\r\n"))
        for name, value in fields
    ]
    return F.concat(F.lit(f"{VERSION}\r\n"), *[F.coalesce(line, F.lit("")) for line in lines], F.lit("\r\n"))


def _safe_uri(url: Column) -> Column:
    for mark, code in (("\r", "%0D"), ("\n", "%0A")):
        url = F.replace(url, F.lit(mark), F.lit(code))
    return url


def _identified(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    read = only(pages, "page_id", "url", "html").select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        payload.alias("payload"),
    )
    return read.select(
        "*",
        F.octet_length("payload").cast("long").alias("bytes"),
        F.sha1(F.col("payload").cast("binary")).alias("digest"),
    ).withColumn(
        "capture",
        F.concat(
            F.lit("urn:capture:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(":"),
            F.substring(F.sha1(F.concat_ws(" ", "digest", F.coalesce("url", F.lit("")))), 1, 16),
        ),
    )


def write_archives(
    pages: DataFrame, path: str, file_bytes: int = FILE_BYTES, revisit_bytes: int = REVISIT_BYTES
) -> None:
    """Write every row of (page_id, url, html) as a transaction of records below ``path``."""
    captures = _identified(pages)
    narrow = materialize(captures.drop("payload", "url"), "captures")
    # Only payloads that occur again; their largest id carries them.
    carriers = (
        narrow.where(F.col("bytes") >= revisit_bytes)
        .groupBy("digest")
        .agg(
            F.count("*").alias("times"),
            F.max(F.struct("page_id", "capture")).getField("capture").alias("carrier"),
        )
        .where("times > 1")
        .select("digest", "carrier")
    )
    carriers = materialize(carriers, "carriers")
    total = narrow.agg(F.sum(F.col("bytes") + 2000)).first()[0] or 0
    files = max(1, -(-total // file_bytes))
    found = sized_join(captures, carriers, ["digest"], "left")
    repeated = F.col("carrier").isNotNull() & (F.col("carrier") != F.col("capture"))
    record_id = lambda kind: F.concat(F.lit("<"), F.col("capture"), F.lit(f":{kind}>"))
    first_id = record_id("capture")
    # Captures have no clock here; the id stands in for the moment.
    date = F.date_format(
        F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(31536000))),
        "yyyy-MM-dd'T'HH:mm:ss'Z'",
    )
    target = _safe_uri(F.col("url"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("bytes").cast("string"), F.lit(_END),
    )
    common = [("WARC-Date", date), ("WARC-Target-URI", target)]
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    content = F.when(repeated, http).otherwise(F.concat(http, F.col("payload")))
    capture = F.concat(
        _header([
            ("WARC-Type", F.when(repeated, "revisit").otherwise("response")),
            ("WARC-Record-ID", first_id), *common, digest,
            ("WARC-Profile", F.when(repeated, F.lit(REVISIT_PROFILE))),
            ("WARC-Refers-To", F.when(repeated, F.concat(F.lit("<"), F.col("carrier"), F.lit(":capture>")))),
            ("Content-Type", "application/http;msgtype=response"),
            ("Content-Length", F.octet_length(content)),
        ]),
        content,
    )
    path_of = F.regexp_replace(target, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*"), F.lit(""))
    asked = F.concat(F.lit("GET "), F.coalesce(path_of, F.lit("/")), F.lit(" HTTP/1.1" + _END))
    about = F.concat(F.lit("page_id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\r\n"))
    further = [
        F.concat(
            _header([
                ("WARC-Type", kind), ("WARC-Record-ID", record_id(kind)),
                ("WARC-Concurrent-To", first_id), *common,
                ("Content-Type", mime), ("Content-Length", F.octet_length(block)),
            ]),
            block,
        )
        for kind, mime, block in (
            ("request", "application/http;msgtype=request", asked),
            ("metadata", "application/warc-fields", about),
        )
    ]
    dealt = found.repartition(files, "capture")
    records = dealt.select(F.explode(F.array(capture, *further)).alias("value"))
    records.write.option("lineSep", _END).option("compression", "gzip").text(path)


def _parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"a record starts with {line[:40]!r}")
        fields: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        block = stream.read(int(fields["content-length"]))
        if len(block) < int(fields["content-length"]):
            raise ValueError("a record ends early")
        yield fields, block


def _split_http(block: bytes) -> tuple[dict[str, str], bytes]:
    head, _, payload = block.partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.decode("utf-8", "replace").partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields, payload


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record below ``path``; digest and size are those of the full payload.

    They are computed from the payload of a response and taken from the headers of a revisit.
    """

    def row(fields: dict[str, str], block: bytes) -> tuple:
        kind = fields.get("warc-type")
        digest = size = payload = None
        inner: dict[str, str] = {}
        if kind == "response":
            inner, payload = _split_http(block)
            digest, size = hashlib.sha1(payload).hexdigest(), len(payload)
        elif kind == "revisit":
            inner, _ = _split_http(block)
            digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
            size = int(inner.get("content-length", 0))
        elif kind == "metadata":
            for line in block.decode("utf-8", "replace").split("\r\n"):
                name, colon, value = line.partition(":")
                if colon:
                    inner[name.strip()] = value.strip()
        return (
            kind, fields.get("warc-record-id"), fields.get("warc-concurrent-to"),
            fields.get("warc-target-uri"), fields.get("warc-date"), fields.get("warc-refers-to"),
            digest, size, payload if payloads else None, list(inner.items()),
        )

    names = [c.split()[0] for c in _RECORD.split(", ")]
    kinds = [*[pa.string()] * 7, pa.int64(), pa.binary(), pa.map_(pa.string(), pa.string())]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names
        )

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(
                batch.column("path").to_pylist(), batch.column("content"), strict=True
            ):
                raw = io.BytesIO(content.as_buffer())
                stream = gzip.GzipFile(fileobj=raw) if name.endswith(".gz") else raw
                rows: list[tuple] = []
                for fields, block in _parse(io.BufferedReader(stream)):
                    rows.append(row(fields, block))
                    if len(rows) == 500:
                        yield batch_of(rows)
                        rows = []
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(compute, _RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture``, ``requests`` and ``metadata`` bound to it."""
    first = F.col("record_type").isin("response", "revisit")
    key = F.when(first, F.col("record_id")).otherwise(F.coalesce("concurrent_to", "record_id"))
    main = F.struct(
        "record_type", "record_id", "target_uri", "date", "refers_to", "payload_digest",
        "payload_bytes", "payload", F.map_entries("fields").alias("http"),
    )
    side = F.struct("record_id", "target_uri", "date", F.map_entries("fields").alias("fields"))
    grouped = records.groupBy(key.alias("capture_id")).agg(
        F.collect_list(F.when(first, main)).alias("captures"),
        F.collect_set(F.when(F.col("record_type") == "request", side)).alias("requests"),
        F.collect_set(F.when(F.col("record_type") == "metadata", side)).alias("metadata"),
    )
    return grouped.select("capture_id", F.explode_outer("captures").alias("capture"), "requests", "metadata")


def page_id_of(record_id: Column) -> Column:
    """The page id inside a record id of ``write_archives``."""
    text = F.regexp_extract(record_id, r"^<urn:capture:(-?\d+):", 1)
    return F.when(text != "", text.cast("long"))


def resolve_revisits(captures: DataFrame, of_payload: dict[str, Column]) -> DataFrame:
    """``captures`` of ``assemble`` with columns computed from each full payload (``capture.payload``).

    A response is asked about its own payload, a revisit about that of the response it refers to;
    only the answers are joined, so one payload with many revisits is not copied.
    """
    kind, names = F.col("capture.record_type"), list(of_payload)
    answered = captures.select(
        "capture_id", F.col("capture").dropFields("payload").alias("capture"), "requests", "metadata",
        *[F.when(kind == "response", answer).alias(name) for name, answer in of_payload.items()],
    )
    answered = materialize(answered, "captures")
    target = F.when(kind == "revisit", F.col("capture.refers_to"))
    asked = answered.select(target.alias("_target")).where("_target is not null").distinct()
    responses = answered.where(kind == "response").select(
        F.col("capture.record_id").alias("_target"), F.struct(*names).alias("_answers")
    )
    # Identical rows of a table share their record id and payload.
    found = sized_join(responses, materialize(asked, "targets"), ["_target"], "left_semi").groupBy("_target").agg(
        F.first("_answers").alias("_answers")
    )
    joined = sized_join(answered.withColumn("_target", target), materialize(found, "carriers"), ["_target"], "left")
    return joined.select(
        "capture_id", "capture", "requests", "metadata",
        *[F.coalesce(F.col(name), F.col(f"_answers.{name}")).alias(name) for name in names],
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to the shared folder, read the archives back and assemble captures."""
    path = shared_path(pages.sparkSession, "warc")
    write_archives(pages, path)
    return assemble(read_records(pages.sparkSession, path))
