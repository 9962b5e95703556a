"""WARC archives with revisit records.

Pages are written as archives of ``response`` records, one gzip member a record,
in as many files as the pages had partitions. The headers are then read back and
shuffled by payload digest alone: of the records with one digest that with the
smallest page id stays a response and the others become revisits of it. Headers
carry no payload, so a digest that a third of all pages share is a count of small
rows, reduced before the shuffle; the join back is left to adaptive execution to
split. Every archive is then copied in its own order with fresh headers: payloads
of responses go along, those of revisits do not.

Reading an archive of both kinds resolves each revisit by its ``WARC-Refers-To``
to the response it names.

Files lie on storage that all executors share, appear under their names only when
complete, and are the same whichever attempt of a task writes them.

Results in special cases: a null payload is empty; a null URL is left out of the
headers; a null page id comes after all others; rows of one page id stay apart,
and of equal ones the first in the archives is the response; payloads shorter
than ``least`` bytes are always responses; other columns are not carried.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from uuid import NAMESPACE_URL, uuid5

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fillgauge import session
from fillgauge.llm import common

#: The date of all records unless the caller gives one: archives of the same pages are then the same.
DATE = datetime(2024, 1, 1, tzinfo=timezone.utc)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"
#: Bytes read ahead while looking for the end of a record's headers.
AHEAD = 64 << 10

HEADERS = pa.schema([
    ("file", pa.string()), ("at", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()),
    ("page_id", pa.int64()), ("url", pa.string()), ("date", pa.string()), ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()), ("refers_to_record", pa.string()),
])
HEADER_KIND = (
    "file string, at long, length long, record_id string, record_type string, page_id long, url string, date string,"
    " payload_bytes long, payload_digest string, refers_to_record string"
)


def digest_of(payload: bytes) -> str:
    """SHA-1 in upper-case base32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(text: str) -> str:
    """A header value on one line."""
    return text.replace("\r", "%0D").replace("\n", "%0A")


def record(fields: dict[str, object], block: bytes) -> bytes:
    """A whole record; fields that are None are left out."""
    lines = ["WARC/1.1", *(f"{k}: {_line(str(v))}" for k, v in fields.items() if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END + block + END


def http_head(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}".encode() + END


def member(data: bytes) -> bytes:
    """A gzip member without a time stamp."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """The fields of a record and its block."""
    head, _, rest = data.partition(END)
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def members(stream, size: int = 1 << 20) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of each gzip member of a file."""
    at, held = 0, stream.read(size)
    while held:
        unpacker = zlib.decompressobj(31)
        out, taken, data = [], 0, held
        while not unpacker.eof:
            if not data:
                data = stream.read(size)
                if not data:
                    raise ValueError(f"the archive ends within the record at {at}")
            out.append(unpacker.decompress(data))
            taken += len(data) - len(unpacker.unused_data)
            data = b""
        yield at, taken, b"".join(out)
        at += taken
        held = unpacker.unused_data or stream.read(size)


def _write(batches: Iterator[pa.RecordBatch], root: str, date: str) -> Iterator[pa.RecordBatch]:
    part, number, file, stream = TaskContext.get().partitionId(), 0, None, None
    fs, folder = common.storage(root)
    name = f"pages-{part:05d}.warc.gz"
    try:
        for batch in batches:
            for page, url, text in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload"))):
                if stream is None:
                    file = common.Committed(fs, f"{folder}/{name}")
                    stream = file.__enter__()
                payload = text.encode()
                fields = {
                    "WARC-Type": "response", "WARC-Record-ID": f"<urn:uuid:{uuid5(NAMESPACE_URL, f'{part}/{number}/{page}')}>",
                    "WARC-Date": date, "WARC-Target-URI": url, "WARC-Page-ID": page,
                    "WARC-Payload-Digest": f"sha1:{digest_of(payload)}", "Content-Type": "application/http; msgtype=response",
                }
                stream.write(member(record(fields, http_head(len(payload)) + payload)))
                number += 1
    except BaseException as error:
        if file is not None:
            file.__exit__(type(error))
        raise
    if file is not None:
        file.__exit__(None)
        yield pa.RecordBatch.from_pydict({"file": [name], "records": [number]})


def _row(file: str, at: int, length: int, data: bytes) -> tuple:
    fields, block = parse(data)
    head = block.partition(END)[0].decode()
    size = next(int(x.split(":", 1)[1]) for x in head.split("\r\n") if x.startswith("Content-Length:"))
    page = fields.get("WARC-Page-ID")
    return (
        file, at, length, fields["WARC-Record-ID"], fields["WARC-Type"], None if page is None else int(page),
        fields.get("WARC-Target-URI"), fields["WARC-Date"], size, fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        fields.get("WARC-Refers-To"),
    )


def _read(batches: Iterator[pa.RecordBatch], root: str) -> Iterator[pa.RecordBatch]:
    """The headers of each record of the files."""
    fs, folder = common.storage(root)
    for batch in batches:
        for file in batch.column("file").to_pylist():
            with fs.open_input_stream(f"{folder}/{file}", compression=None) as stream:
                rows = []
                for at, length, data in members(stream):
                    rows.append(_row(file, at, length, data))
                    if len(rows) == common.BATCH_ROWS:
                        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), HEADERS)], schema=HEADERS)
                        rows = []
                if rows:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), HEADERS)], schema=HEADERS)


COPIED = pa.schema([("file", pa.string()), ("records", pa.int64())])


def _copy(batches: Iterator[pa.RecordBatch], source: str, root: str) -> Iterator[pa.RecordBatch]:
    """Each file again, in its order: the plan of its records comes sorted by file and place."""
    fs, folder = common.storage(source)
    to_fs, to = common.storage(root)
    open_file, done = None, []

    def close():
        nonlocal open_file
        if open_file:
            open_file["out"].__exit__(None)
            open_file["in"].close()
            done.append((open_file["name"], open_file["records"]))
            open_file = None

    try:
        for batch in batches:
            for row in batch.to_pylist():
                if not open_file or open_file["name"] != row["file"]:
                    close()
                    out = common.Committed(to_fs, f"{to}/{row['file']}")
                    stream = fs.open_input_stream(f"{folder}/{row['file']}", compression=None)
                    open_file = {"name": row["file"], "in": stream, "members": members(stream), "out": out, "to": out.__enter__(), "records": 0}
                at, _, data = next(open_file["members"])
                if at != row["at"]:
                    raise ValueError(f"{row['file']}: the record at {at} is not in its plan")
                fields, block = parse(data)
                fields.pop("Content-Length")
                if row["response_id"] is not None:
                    fields |= {
                        "WARC-Type": "revisit", "WARC-Profile": PROFILE, "WARC-Refers-To": row["response_id"],
                        "WARC-Refers-To-Target-URI": row["response_url"], "WARC-Refers-To-Date": row["response_date"],
                    }
                    block = block.partition(END)[0] + END
                open_file["to"].write(member(record(fields, block)))
                open_file["records"] += 1
    except BaseException as error:
        if open_file:
            open_file["out"].__exit__(type(error))
        raise
    close()
    yield pa.record_batch([pa.array([d[k] for d in done], f.type) for k, f in enumerate(COPIED)], schema=COPIED)


def write(pages: DataFrame, root: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: datetime = DATE) -> None:
    """Archives of ``response`` records below ``root``, with a table ``files`` of them."""
    common.prepare(pages.sparkSession)
    rows = pages.select(
        common.column(id_col).cast("long").alias("page_id"), common.column(url_col).alias("url"),
        F.coalesce(common.column(payload_col), F.lit("")).alias("payload"),
    )
    stamp = date.strftime("%Y-%m-%dT%H:%M:%SZ")
    rows.mapInArrow(lambda b: _write(b, root, stamp), "file string, records long").write.parquet(f"{root}/files")


def headers(spark: SparkSession, root: str) -> DataFrame:
    """The headers of all records of the archives below ``root``."""
    common.prepare(spark)
    files = spark.read.schema("file string, records long").parquet(f"{root}/files")
    return common.one_row_per_task(files.select("file"), "file", files.count()).mapInArrow(lambda b: _read(b, root), HEADER_KIND)


def deduplicate(spark: SparkSession, source: str, root: str, least: int = 0) -> None:
    """The archives of ``source`` again below ``root``, records with known payloads as revisits."""
    found = session.materialise(headers(spark, source), "warc-headers")
    place = F.struct(F.col("page_id").isNull().alias("unknown"), "page_id", "file", "at")
    first = found.where(F.col("payload_bytes") >= least).groupBy("payload_digest", "payload_bytes").agg(
        F.min_by(F.struct("file", "at", F.col("record_id").alias("id"), "url", "date"), place).alias("response")
    )
    same = (F.col("file") == F.col("response.file")) & (F.col("at") == F.col("response.at"))
    revisit = F.col("response").isNotNull() & ~same
    plan = found.join(first, ["payload_digest", "payload_bytes"], "left").select(
        "file", "at", *(F.when(revisit, F.col(f"response.{c}")).alias(f"response_{c}") for c in ("id", "url", "date"))
    )
    files = spark.read.schema("file string, records long").parquet(f"{source}/files")
    ordered = plan.repartitionByRange(max(1, files.count()), "file").sortWithinPartitions("file", "at")
    ordered.mapInArrow(lambda b: _copy(b, source, root), "file string, records long").write.parquet(f"{root}/files")


def resolve(spark: SparkSession, root: str) -> DataFrame:
    """All records of deduplicated archives, revisits with the page id of their response.

    ``page_id, url, payload_bytes, payload_digest, record_type, refers_to``. The
    size of a revisit's payload is in the HTTP headers it keeps.
    """
    found = session.materialise(headers(spark, root), "warc-headers")
    named = found.where("record_type = 'response'").select(
        F.col("record_id").alias("refers_to_record"), F.col("page_id").alias("refers_to")
    )
    revisits = found.where("record_type = 'revisit'").join(named, "refers_to_record", "left")
    columns = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    responses = found.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long"))
    return responses.select(*columns).unionByName(revisits.select(*columns))
