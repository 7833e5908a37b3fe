"""WARC archives with an index: written and read by byte ranges.

A task writes its pages, record after record and each a gzip member of its own, to an archive and returns one index row
per record: archive, offset, length, url and digest. The index is a Parquet table, committed by Spark; an archive of a task that was lost
is in no index. Reading starts from selected index rows, sorted by archive and offset: ranges that touch or nearly do
are fetched together, a few megabytes at a time.

Of records with equal payloads the one with the largest page id is the response; the others are revisits that name it
and hold no payload. Page bodies are shuffled once.

Edge cases: a null html is an empty payload; a null url gives a record without target; null page ids are written under
an id of the payload's digest and never referred to while another page has the payload; rows that repeat id and
payload are all responses if theirs is the largest id; an empty table gives an empty index. Other columns are dropped.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolesieve.llm.common import new_folder

DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
INDEX = (
    "page_id bigint, url string, payload_digest string, record_type string, archive string, offset bigint, length bigint"
)
RECORDS = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
#: Bytes between two ranges that are fetched together, and bytes fetched at once.
GAP, SPAN = 64 << 10, 8 << 20
ROLL = 512 << 20
#: Compression of a record; higher levels cost more than they save here.
LEVEL = 5


def open_store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a shared folder and the path in it."""
    if "://" in path or path.startswith("file:"):
        uri = "file://" + path.removeprefix("file:") if path.startswith("file:/") and "://" not in path else path
        return pyarrow.fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
    return pyarrow.fs.LocalFileSystem(), path


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> tuple[bytes, str, str]:
    """The bytes of a record, its digest and its type. ``refers_to``: the response of a revisit, else null."""
    sha = digest(payload)
    kind = "response" if refers_to is None else "revisit"
    block = HTTP + payload if refers_to is None else HTTP
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{sha if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        safe = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)
        lines.append(f"WARC-Target-URI: {safe}")
    lines.append(f"WARC-Payload-Digest: sha1:{sha}")
    if refers_to is not None:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:page:{refers_to}>",
        ]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", sha, kind


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives under ``folder``; returns the index, which lies there too."""
    bodies = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    bodies = bodies.withColumn("key", F.sha2("html", 256))
    responses = bodies.groupBy("key").agg(F.max("page_id").alias("response"))
    refers_to = F.when(F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response")), F.col("response"))
    decided = bodies.join(responses, "key").select("page_id", "url", "html", refers_to.alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        out, archive, offset = None, "", 0
        try:
            for part in batches:
                rows = []
                for page_id, url, html, ref in zip(*[c.to_pylist() for c in part.columns], strict=True):
                    if out is None or offset > ROLL:
                        if out is not None:
                            out.close()
                        archive, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                        store.create_dir(base, recursive=True)
                        out = store.open_output_stream(f"{base}/{archive}", compression=None)
                    data, sha, kind = record(page_id, url, html.encode("utf-8", "replace"), ref)
                    data = gzip.compress(data, LEVEL, mtime=0)
                    out.write(data)
                    rows.append((page_id, url, sha, kind, archive, offset, len(data)))
                    offset += len(data)
                yield batch(rows, INDEX)
        finally:
            if out is not None:
                out.close()

    index = f"{folder}/index"
    decided.mapInArrow(run, INDEX).write.parquet(index)
    return pages.sparkSession.read.schema(INDEX).parquet(index)


def batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    kinds = [pa.int64() if kind == "bigint" else pa.string() for _, kind in fields]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, [name for name, _ in fields])


def read_records(selected: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """The records of index rows as their archives have them; every payload is checked against its digest. The bytes
    of a revisit's payload are null here, see ``resolve``. ``payloads`` adds the text."""
    schema = RECORDS + (", payload string" if payloads else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        for part in batches:
            wanted = list(zip(*[c.to_pylist() for c in part.columns], strict=True))
            rows, size, at = [], 0, 0
            while at < len(wanted):
                archive, begin, end = wanted[at][2], wanted[at][3], wanted[at][3] + wanted[at][4]
                last = at + 1
                while last < len(wanted) and wanted[last][2] == archive and 0 <= wanted[last][3] - end <= GAP and wanted[last][3] + wanted[last][4] - begin <= SPAN:
                    end = wanted[last][3] + wanted[last][4]
                    last += 1
                with store.open_input_file(f"{base}/{archive}") as f:
                    data = f.read_at(end - begin, begin)
                for page_id, url, _, offset, length in wanted[at:last]:
                    headers, payload = parse(gzip.decompress(data[offset - begin : offset - begin + length]))
                    sha = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    whole = headers["WARC-Type"] == "response"
                    if whole and digest(payload) != sha:
                        raise ValueError(f"the payload at {offset} of {archive} differs from its digest")
                    ref = None if whole else int(headers["WARC-Refers-To"].removeprefix("<urn:page:").removesuffix(">"))
                    row = (page_id, url, len(payload) if whole else None, sha, headers["WARC-Type"], ref)
                    rows.append((*row, payload.decode() if whole else None) if payloads else row)
                    size += len(payload) if payloads else 0
                if size > SPAN:
                    yield batch(rows, schema)
                    rows, size = [], 0
                at = last
            yield batch(rows, schema)

    ranges = selected.select("page_id", "url", "archive", "offset", "length")
    ordered = ranges.repartitionByRange("archive", "offset").sortWithinPartitions("archive", "offset")
    return ordered.mapInArrow(run, schema)


def resolve(records: DataFrame) -> DataFrame:
    """``records`` with the payload bytes of revisits taken from the responses they name."""
    whole = records.filter("record_type = 'response' AND page_id IS NOT NULL")
    known = whole.groupBy(F.col("page_id").alias("named"), F.col("payload_digest").alias("sha")).agg(F.max("payload_bytes").alias("bytes"))
    revisits = records.filter("record_type = 'revisit'")
    same = (F.col("refers_to") == F.col("named")) & (F.col("payload_digest") == F.col("sha"))
    found = revisits.join(known, same, "left").withColumn("payload_bytes", F.col("bytes")).select(*records.columns)
    return records.filter("record_type = 'response'").unionByName(found)


def round_trip(pages: DataFrame) -> DataFrame:
    """Archives of all ``pages`` in a new shared folder, read back: page_id, payload_bytes, payload_digest,
    record_type, refers_to, url."""
    folder = new_folder(pages.sparkSession, "warc")
    index = write_archives(pages, folder)
    read = f"{folder}/records"
    read_records(index, folder).write.parquet(read)
    return resolve(pages.sparkSession.read.schema(RECORDS).parquet(read))
