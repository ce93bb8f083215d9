"""WARC archives: writing, normalising monolithic gzip, reading back.

Some archives are one gzip stream over all records, so no record can be reached
without inflating what precedes it. The normaliser inflates such a stream once,
from front to back in bounded pieces, writes every record as a gzip member of its
own, and puts a sidecar index (offset and length of each member) beside it.
Archives are files of bounded size in a shared folder; each file is one row of a
DataFrame and one unit of work. Files are written under a name of the attempt and
renamed when complete, so that a lost or repeated task leaves whole files only.

Defined results: a null page has an empty payload; a null id or url is written as
an empty header; rows that repeat the smallest id of a payload are all responses;
an empty table gives no archives.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir

LEAST_REVISIT = 100  # payload bytes from which equal payloads are stored once
ARCHIVE_BYTES = 64 << 20  # uncompressed size at which a new archive is begun
PIECE = 1 << 20
STAMP = "2024-01-01T00:00:00Z"


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def marked(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """Rows (page_id, url, payload, digest, refers_to): which page each one revisits, if any."""
    payload = F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"),
                        payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    first = (rows.where(F.octet_length("payload") >= least).groupBy("digest")
             .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first"))
    return rows.join(first, "digest", "left").select(
        "page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def record(page_id, url: str, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record: a response with its payload, or a revisit with the HTTP header alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if refers_to is not None else http + payload
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}|{url}|{digest}")
    clean = " ".join(url.split())
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{name}>",
            f"WARC-Date: {STAMP}", f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha256:{digest}",
            f"WARC-Page-ID: {'' if page_id is None else page_id}", "Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Page: {refers_to}"]
    return "\r\n".join([*head, f"Content-Length: {len(body)}"]).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def system_of(uri: str) -> fs.FileSystem:
    return opened(uri)[0]


class Archive:
    """A file written under a name of the attempt, renamed when complete."""

    def __init__(self, folder: str, name: str):
        self.system, root = opened(folder)
        self.path, self.attempt = f"{root}/{name}", f"{root}/.{name}.{uuid.uuid4().hex}"
        self.out, self.size = self.system.open_output_stream(self.attempt, compression=None), 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> str:
        self.out.close()
        self.system.move(self.attempt, self.path)
        return self.path


def write_monolithic(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``marked`` rows as archives, each one gzip stream; rows (path, records) of what was written."""
    system, root = opened(folder)
    system.create_dir(root, recursive=True)

    def run(batches):
        archive, deflate, plain, count, written = None, None, 0, 0, []

        def finish():
            archive.write(deflate.flush())
            written.append((archive.close(), count))

        for batch in batches:
            for r in batch.to_pylist():
                if archive is None:
                    archive, deflate, plain, count = Archive(folder, f"{uuid.uuid4().hex}.warc.gz"), zlib.compressobj(6, zlib.DEFLATED, 31), 0, 0
                data = record(**r)
                archive.write(deflate.compress(data))
                plain, count = plain + len(data), count + 1
                if plain >= archive_bytes:
                    finish()
                    archive = None
        if archive is not None:
            finish()
        yield pa.RecordBatch.from_pydict({"path": pa.array([p for p, _ in written], pa.string()),
                                          "records": pa.array([n for _, n in written], pa.int64())})

    return rows.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, "path string, records long")


def inflated(system: fs.FileSystem, path: str) -> Iterator[bytes]:
    """The bytes of a gzip file in bounded pieces, whatever number of members it has."""
    with system.open_input_stream(path, compression=None) as source:
        inflate = zlib.decompressobj(31)
        while data := source.read(PIECE):
            while data:
                if inflate.eof:
                    inflate = zlib.decompressobj(31)
                yield inflate.decompress(data, PIECE)
                data = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
        while not inflate.eof and (rest := inflate.decompress(inflate.unconsumed_tail, PIECE)):
            yield rest
        if not inflate.eof:
            raise ValueError(f"{path} ends inside a gzip member")


def records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole WARC records of a byte stream, which need not begin or end with a piece."""
    held = bytearray()

    def more() -> bool:
        piece = next(pieces, None)
        if piece is None:
            return False
        held.extend(piece)
        return True

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if held.strip():
                    raise ValueError("the stream ends inside a record header")
                return
        size = end + 4 + int(header(bytes(held[:end]))["content-length"]) + 4
        while len(held) < size:
            if not more():
                raise ValueError("the stream ends inside a record")
        yield bytes(held[:size])
        del held[:size]


def header(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}


def normalise(archives: DataFrame, folder: str, keep: bool = True) -> DataFrame:
    """Rewrite every archive (column ``path``) with one gzip member per record and a sidecar index of JSON lines.

    Gives (path, index, records) of the new files. Without ``keep`` an archive goes as
    soon as its successor and the index are complete; a task that is repeated finds those
    and does nothing twice.
    """
    system, root = opened(folder)
    system.create_dir(root, recursive=True)

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                source, name = system_of(folder), path.rsplit("/", 1)[1]
                done, listed = (f"{root}/{name}{end}" for end in ("", ".idx"))
                if all(x.type == fs.FileType.File for x in source.get_file_info([done, listed])):
                    with source.open_input_stream(listed, compression=None) as lines:
                        found = lines.read().count(b"\n")
                    yield pa.RecordBatch.from_pydict({"path": [done], "index": [listed], "records": pa.array([found], pa.int64())})
                    continue
                archive, index, count = Archive(folder, name), Archive(folder, name + ".idx"), 0
                for data in records(inflated(source, path)):
                    head = header(data[:data.index(b"\r\n\r\n")])
                    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                    member = pack.compress(data) + pack.flush()
                    line = {"offset": archive.size, "length": len(member), "id": head["warc-record-id"], "type": head["warc-type"]}
                    archive.write(member)
                    index.write(json.dumps(line).encode() + b"\n")
                    count += 1
                made = {"index": [index.close()], "path": [archive.close()], "records": pa.array([count], pa.int64())}
                if not keep:
                    source.delete_file(path)
                yield pa.RecordBatch.from_pydict({c: made[c] for c in ("path", "index", "records")})

    return archives.select("path").mapInArrow(run, "path string, index string, records long")


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def read(archives: DataFrame, folder: str) -> DataFrame:
    """One row per record of normalised archives, each member reached by its index entry; digests are checked against the payload."""
    def run(batches):
        for batch in batches:
            for path, index in zip(batch.column("path").to_pylist(), batch.column("index").to_pylist()):
                system, _ = opened(folder)
                with system.open_input_stream(index, compression=None) as lines:
                    entries = [json.loads(x) for x in lines.read().splitlines()]
                with system.open_input_file(path) as source:
                    for a in range(0, len(entries), 1000):
                        yield pa.RecordBatch.from_pylist([entry(source, e) for e in entries[a:a + 1000]], schema=READ_ARROW)

    return archives.select("path", "index").mapInArrow(run, READ)


READ_ARROW = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])


def entry(source, at: dict) -> dict:
    source.seek(at["offset"])
    data = zlib.decompress(source.read(at["length"]), 31)
    cut = data.index(b"\r\n\r\n")
    head, block = header(data[:cut]), data[cut + 4:-4]
    http = block.index(b"\r\n\r\n")
    kind, digest, refers = head["warc-type"], head["warc-payload-digest"].removeprefix("sha256:"), head.get("warc-refers-to-page")
    size = int(header(block[:http])["content-length"])
    payload = block[http + 4:]
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"record {head['warc-record-id']} does not hold the payload its digest names")
    return {"page_id": int(head["warc-page-id"]) if head["warc-page-id"] else None, "payload_bytes": size, "payload_digest": digest,
            "record_type": kind, "refers_to": int(refers) if refers else None, "url": head["warc-target-uri"]}


def archive_pages(pages: DataFrame, folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES, keep: bool = True) -> DataFrame:
    """Write pages as monolithic archives, normalise them, and give (path, index, records) of the result.

    The lists of files are written as tables, so that a lost executor does not make a later step see other files.
    """
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_monolithic(marked(pages), f"{folder}/whole", archive_bytes).write.parquet(f"{folder}/whole-list")
    whole = spark.read.parquet(f"{folder}/whole-list")
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    normalise(whole.repartition(tasks), f"{folder}/members", keep).write.parquet(f"{folder}/members-list")
    return spark.read.parquet(f"{folder}/members-list").repartition(tasks)


def round_trip(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Every page as its archives give it back."""
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return read(archive_pages(pages, folder, archive_bytes, keep=False), f"{folder}/members")
