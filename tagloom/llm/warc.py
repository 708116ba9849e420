"""WARC archives, index first.

Pages are written as WARC/1.1 records, each a gzip member of its own. Of equal payloads of
at least ``min_bytes`` bytes, the page with the largest id holds the payload and the others
are revisit records that refer to it; which pages repeat is found by two-pass Bloom
filtering of their SHA-1, so the other pages are not shuffled.

Writing yields the index: file, offset, length, url, digest and kind of every record.
Records are read by the index alone: its rows, sorted by file and offset, are coalesced
into byte ranges (gaps up to ``gap`` bytes, ranges up to ``span`` bytes), and each range is
read with one request and cut into its records. There is a task for each 64 MiB of records at least.

A task writes files under names of its own and reports their records; files of a lost
task are in no index.

Defined cases. Null html is an empty payload; a null url gives a record without target
URI. Null ids come last: they refer to a page with an id if there is one, else all of the
group are responses, and they read back as null. Rows that repeat id and payload are all
responses if their id is the largest, and one record (with one record id) written more than once. An empty table gives an empty index.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.exact_dedup import mark_digests
from tagloom.llm.store import filesystem, make_dir, materialise, small_batches, tidy

MIN_BYTES, FILE_BYTES, LEVEL = 0, 1 << 28, 3
GAP, SPAN, TASK_BYTES = 1 << 16, 1 << 22, 1 << 26
DATE = "1970-01-01T00:00:00Z"
INDEX = "file string, offset long, length long, url string, payload_digest string, record_type string, page_id long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str, place: str = "") -> str:
    """Of a page's payload; a revisit, or a page without id, is told apart by its place in the files."""
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}:{place}').urn}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str = DATE, place: str = "") -> bytes:
    """One record, uncompressed. The block is the HTTP header and, in a response, the payload."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + (b"" if revisit else payload)
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest, place if revisit or page_id is None else '')}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-Id: {refers_to}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(WARC headers in lower case, HTTP header, payload) of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(re.findall(r"(?m)^([^:\r\n]+):[ \t]*([^\r\n]*)", head.decode()))
    fields = {k.lower(): v for k, v in fields.items()}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, http, payload


def write(df: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = MIN_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the pages as records below folder; the index, as a written table."""
    spark = df.sparkSession
    small_batches(spark)
    make_dir(spark, folder)
    text = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    pages = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), text.alias("html"))
    pages = pages.withColumn("digest", F.sha1("html"))
    keys = materialise(pages.select("page_id", "digest"), "payloads")
    marked = mark_digests(pages, "digest", id_col="page_id", keep="max", keys=keys)
    again = ~F.col("kept") & F.col("keep_id").isNotNull() & (F.octet_length("html") >= min_bytes)
    rows = marked.select("page_id", "url", "html", F.when(again, F.col("keep_id")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        out, name, at = None, "", 0
        stem = f"part-{TaskContext.get().partitionId():08d}-{uuid.uuid4().hex}"
        files = count = 0
        for batch in batches:
            index = []
            for page_id, url, html, refers_to in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                payload = html.as_py().encode()
                digest = base32_sha1(payload)
                data = gzip.compress(record(page_id, url, payload, digest, refers_to, refers_to is not None, place=f"{stem}:{count}"), LEVEL, mtime=0)
                count += 1
                if out is None or at + len(data) > file_bytes and at:
                    if out is not None:
                        out.close()
                    name, at, files = f"{stem}-{files:04d}.warc.gz", 0, files + 1
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                out.write(data)
                index.append((name, at, len(data), url, digest, "revisit" if refers_to is not None else "response", page_id))
                at += len(data)
            if index:
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*index, strict=True), kinds, strict=True)], ["file", "offset", "length", "url", "payload_digest", "record_type", "page_id"])
        if out is not None:
            out.close()

    return materialise(rows.mapInArrow(tidy(run), INDEX), "warc-index")


def ranges(rows: list[tuple[str, int, int]], gap: int = GAP, span: int = SPAN) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """(file, offset, length, records) for sorted (file, offset, length): records close to each
    other are read together."""
    held: list[tuple[int, int]] = []
    file, begin, end = "", 0, 0
    for name, offset, length in rows:
        if held and (name != file or offset > end + gap or max(end, offset + length) - begin > span):
            yield file, begin, end - begin, held
            held = []
        if not held:
            file, begin, end = name, offset, offset
        held.append((offset, length))
        end = max(end, offset + length)
    if held:
        yield file, begin, end - begin, held


def read(index: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """The records of the index's rows (all or a selection): page_id, payload_bytes,
    payload_digest, record_type, refers_to[, payload]. Digests of payloads are recomputed."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * with_payload
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()) + (pa.binary(),) * with_payload
    small_batches(index.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        for batch in batches:
            rows = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            for file, begin, size, records in ranges(rows):
                with fs.open_input_file(f"{root}/{file}") as source:
                    data = source.read_at(size, begin)
                out = []
                for offset, length in records:
                    raw = gzip.GzipFile(fileobj=io.BytesIO(data[offset - begin : offset - begin + length])).read()
                    fields, http, payload = parse(raw)
                    number = lambda k: int(fields[k]) if k in fields else None  # noqa: B023, E731
                    if fields["warc-type"] == "revisit":
                        total, digest = int(re.search(rb"(?i)content-length: *(\d+)", http)[1]), fields["warc-payload-digest"].removeprefix("sha1:")
                    else:
                        total, digest = len(payload), base32_sha1(payload)
                        if "sha1:" + digest != fields["warc-payload-digest"]:
                            raise ValueError(f"{file} at {offset}: the payload does not have its digest")
                    out.append((number("x-page-id"), total, digest, fields["warc-type"], number("x-refers-to-page-id")) + (payload,) * with_payload)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    spark = index.sparkSession
    size = index.agg(F.sum("length").alias("n")).first()["n"] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    picked = index.select("file", "offset", "length").repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    return picked.mapInArrow(tidy(run), RECORDS + (", payload binary" if with_payload else ""))
