"""Operator 8, WARC archives compressed record by record with a dictionary.

Every page becomes a WARC/1.1 record.  Of pages with equal payloads of at
least ``min_bytes`` bytes, the one with the largest id is a response record,
the others are revisit records that refer to it; smaller payloads are all
responses.  A task writes its records to archives of about ``ARCHIVE_BYTES``:
a Zstandard dictionary is built from records of the archive and lies in a
leading skippable frame, then each record follows as a frame of its own.
Every attempt of a task writes names of its own, and the index lists the
files of the attempts that counted: archives of a lost executor or a retried
task, whole or half, are in no index and are not read back.

A null payload is empty.  Rows with a null id are revisits if a page with an
id has the payload, else responses.  Repeated rows of the largest id are all
responses.  An empty table gives no archives and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import shared_dir, table

ARCHIVE_BYTES = 16 << 20   # of uncompressed records
DICTIONARY_BYTES = 64 << 10
SAMPLE_BYTES = 4 << 20     # of records that a dictionary is built from
MAGIC = 0x184D2A5D         # fixed value: the skippable frame of a dictionary
DATE = "2024-01-01T00:00:00Z"
LEVEL = 3
READERS = 20_000           # most tasks that read archives back


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str | None) -> str:
    return " ".join((value or "").split())


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit has no payload but its length and digest."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
            f"WARC-Date: {DATE}", f"WARC-Target-URI: {_clean(url)}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _dictionary(records: list[bytes]):
    """A dictionary built from records spread over the archive; None if they are too few to learn from."""
    import zstandard

    step = max(1, -(-sum(map(len, records)) // SAMPLE_BYTES))
    samples = [r[:DICTIONARY_BYTES] for r in records[::step]]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples) if len(samples) >= 8 else None
    except zstandard.ZstdError:
        return None


def archive_bytes(records: list[bytes]) -> bytes:
    import zstandard

    learned, out = _dictionary(records), io.BytesIO()
    if learned is not None:
        raw = learned.as_bytes()
        out.write(struct.pack("<II", MAGIC, len(raw)) + raw)
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=learned) if learned is not None else zstandard.ZstdCompressor(level=LEVEL)
    for r in records:
        out.write(packer.compress(r))
    return out.getvalue()


def records_of(archive: bytes):
    """(header fields, block) of each record of an archive."""
    import zstandard

    learned = None
    if len(archive) >= 8 and struct.unpack("<I", archive[:4])[0] == MAGIC:
        size = struct.unpack("<I", archive[4:8])[0]
        learned, archive = zstandard.ZstdCompressionDict(archive[8:8 + size]), memoryview(archive)[8 + size:]
    unpacker = zstandard.ZstdDecompressor(dict_data=learned) if learned is not None else zstandard.ZstdDecompressor()
    with unpacker.stream_reader(archive, read_across_frames=True) as stream:
        lines = io.BufferedReader(stream, 1 << 16)
        while True:
            first = lines.readline()
            if not first:
                return
            if first.strip() != b"WARC/1.1":
                raise ValueError("not a WARC record")
            fields = {}
            while (line := lines.readline().rstrip(b"\r\n")):
                name, _, value = line.partition(b":")
                fields[name.decode().lower()] = value.strip().decode()
            block = lines.read(int(fields["content-length"]))
            if lines.read(4) != b"\r\n\r\n":
                raise ValueError("a WARC record is cut short")
            yield fields, block


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   min_bytes: int = 0) -> DataFrame:
    """Write the archives into the folder ``path``, which all executors
    share; returns (file, records, bytes), already computed."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1("html"))
    again = (rows.where(F.octet_length("html") >= min_bytes).groupBy("sha").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n"))
             .where("n > 1").select(F.col("sha").alias("same"), "keeper"))
    again = table(again, "warc-again")
    rows = rows.join(again, F.col("sha") == F.col("same"), "left").select(
        "page_id", "url", "html", "sha", F.expr("if(page_id <=> keeper, null, keeper)").alias("refers_to"))

    def run(batches):
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(_plain(path))
        store.create_dir(folder, recursive=True)
        part, count, held, size = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}", 0, [], 0

        for batch in batches:
            for page_id, url, text, sha, refers_to in zip(*(batch.column(i) for i in range(5))):
                payload = text.as_buffer().to_pybytes()
                digest = base64.b32encode(bytes.fromhex(sha.as_py())).decode()
                held.append(record(page_id.as_py(), url.as_py(), payload, digest, refers_to.as_py()))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield _written(store, folder, part, count, held)
                    count, held, size = count + 1, [], 0
        if held:
            yield _written(store, folder, part, count, held)

    return table(rows.mapInArrow(run, "file string, records long, bytes long"), "warc-index")


def _plain(path: str) -> str:
    """The folder under the scheme by which Arrow knows its file system."""
    scheme, _, rest = path.partition("://")
    return f"s3://{rest}" if scheme in ("s3a", "s3n") else path


def _written(store, folder: str, part: str, count: int, records: list[bytes]) -> pa.RecordBatch:
    name, data = f"pages-{part}-{count:05d}.warc.zst", archive_bytes(records)
    with store.open_output_stream(f"{folder}/{name}") as out:
        out.write(data)
    return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(records)], pa.int64()), pa.array([len(data)], pa.int64())], ["file", "records", "bytes"])


_ROWS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def read_archives(index: DataFrame, path: str, payload: bool = True) -> DataFrame:
    """The records of the archives in ``path`` that ``index`` lists, a task for
    each archive up to ``READERS``.  Length and digest of a response are those
    of the bytes read; a revisit has them in its header.  An archive that is
    missing or holds another number of records than listed is an error."""
    def page(value: str | None) -> int | None:
        number = (value or "").removeprefix("<urn:page:").removesuffix(">")
        return int(number) if number else None

    def run(batches):
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(_plain(path))
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
        names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
        for batch in batches:
            for name, listed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_input_stream(f"{folder}/{name}") as source:
                    content = source.read()
                out = []
                for fields, block in records_of(content):
                    body = block.partition(b"\r\n\r\n")[2]
                    size, digest = int(fields["x-payload-length"]), fields["warc-payload-digest"].removeprefix("sha1:")
                    if fields["warc-type"] == "response" and (size, digest) != (len(body), base32_sha1(body)):
                        raise ValueError(f"payload of {fields['warc-record-id']} differs from its digest")
                    out.append((page(fields["warc-record-id"]), fields["warc-target-uri"], fields["warc-type"], size, digest,
                                page(fields.get("warc-refers-to")), body if payload and fields["warc-type"] == "response" else None))
                if len(out) != listed:
                    raise ValueError(f"{name} holds {len(out)} records, {listed} are listed")
                cols = list(zip(*out)) or [()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

    tasks = max(1, min(index.count(), READERS))
    return index.select("file", "records").repartition(tasks, F.xxhash64("file")).mapInArrow(run, _ROWS)


def archived(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to a new folder of archives and read their records back, without payloads."""
    path = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return read_archives(write_archives(pages, path, id_col, url_col, html_col, min_bytes), path, payload=False)
