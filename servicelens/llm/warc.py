"""WARC archives of pages, and a normaliser for archives that are one gzip stream.

`write_archives` writes records to archives that are compressed as a whole, as some crawlers do.
`normalise` inflates each such stream once, in small steps, writes every record again as a gzip member
of its own, and puts an index of offsets beside the new archive. `read_records` then fetches single
members by that index. Archives and indexes lie in a folder of the shared file system that the caller
names; each task attempt writes files of its own name, and only files named in the result are read, so
a repeated or lost attempt leaves no trace in it.

Of equal payloads of `least_revisit` bytes or more, the page with the smallest id is stored and the
others refer to it. Finding them joins pages with the digests that two pages or more share; these are
counted first and broadcast while they are few, else the join shuffles. A payload that very many pages
share is counted before the shuffle, and its partition can be split.

Nulls and special cases: null html is an empty payload. Rows with the smallest id of a payload are all
responses, should the id repeat. A null id never is the smallest one unless the payload has no other.
A null url is written as about:blank, as a record needs a target, and control characters and blanks in
urls are percent-encoded. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from servicelens.llm.common import durable, only, shared_folder, sliced

ARCHIVE_BYTES = 64_000_000      # payload per archive
BROADCAST_DIGESTS = 100_000     # shared payloads up to which their digests, 48 bytes each, are broadcast
STEP = 1 << 20                  # bytes read at a time
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_WRITTEN = "path string, records bigint"
_INDEX = "path string, offset bigint, length bigint, record_id string"
_RECORD = ("page_id bigint, url string, record_type string, payload_bytes bigint, "
           "payload_digest string, refers_to bigint, payload binary")


def new_folder(df: DataFrame) -> str:
    """A fresh folder below the one that spark.checkpoint.dir names."""
    return f"{shared_folder(df.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    plain = folder.removeprefix("file:") if folder.startswith("file:/") else folder
    return fs.FileSystem.from_uri("/" + plain.lstrip("/") if plain.startswith("/") else plain)


def digest(payload: bytes) -> str:
    """SHA-1 in base32, without the prefix that names the algorithm."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page {page_id}')}>"


def encode_record(page_id: int | None, url: str | None, payload: bytes, first_id: int | None,
                  revisit: bool) -> bytes:
    """One WARC/1.1 record, uncompressed; a revisit keeps the HTTP header only."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    block = http if revisit else http + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"),
              ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE),
              ("WARC-Target-URI", quote(url or "about:blank", safe="!#$%&'()*+,/:;=?@[]~")),
              ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
              ("Content-Type", "application/http;msgtype=response"),
              ("Content-Length", str(len(block)))]
    if page_id is not None:
        fields.append(("Page-ID", str(page_id)))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(first_id)),
                   ("Refers-To-Page-ID", str(first_id))]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[:int(fields["Content-Length"])]


def inflated(source) -> Iterator[bytes]:
    """The content of a gzip file of one or many members, in small steps."""
    stream = zlib.decompressobj(31)
    while data := source.read(STEP):
        while data:
            yield stream.decompress(data, STEP)
            data = stream.unconsumed_tail
            if stream.eof:
                data, stream = stream.unused_data, zlib.decompressobj(31)


def split_records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of a stream of WARC content."""
    held = bytearray()
    need = 0                                    # bytes up to which a record cannot be complete
    for chunk in chunks:
        held += chunk
        while len(held) >= need:
            head = held.find(b"\r\n\r\n")
            if head < 0:
                break
            fields = bytes(held[:head]).lower().split(b"\r\n")
            length = next(int(f[15:]) for f in fields if f.startswith(b"content-length:"))
            need = head + 4 + length + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = 0
    if held.strip():
        raise ValueError("the archive ends within a record")


def write_archives(pages: DataFrame, folder: str, least_revisit: int = 0,
                   broadcast_digests: int = BROADCAST_DIGESTS) -> DataFrame:
    """(path, records) of archives with a record for every page, each one gzip stream."""
    named = (only(pages, "page_id", "url", "html")
             .select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html"))
             .withColumn("digest", F.sha1(F.encode("html", "UTF-8"))))
    firsts = durable(named.where(F.octet_length("html") >= least_revisit).groupBy("digest")
                     .agg(F.min("page_id").alias("first_id"), F.count("*").alias("pages"))
                     .where("pages > 1").select(F.col("digest").alias("same"), "first_id"))
    if firsts.limit(broadcast_digests + 1).count() <= broadcast_digests:
        firsts = F.broadcast(firsts)            # pages then stay where they lie
    told = named.join(firsts, F.col("digest") == F.col("same"), "left").select(
        "page_id", "url", "html", "first_id",
        F.coalesce(~F.col("page_id").eqNullSafe(F.col("first_id")) & F.col("same").isNotNull(),
                   F.lit(False)).alias("revisit"))

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        system.create_dir(root, recursive=True)
        done: list[tuple[str, int]] = []
        sink, packer, size = None, None, 0

        def close() -> None:
            nonlocal sink, size
            if sink:
                sink.write(packer.flush())
                sink.close()
            sink, size = None, 0

        for batch in sliced(batches):
            for row in batch.to_pylist():
                if sink is None:
                    path = f"{root}/whole-{uuid.uuid4().hex}.warc.gz"
                    sink, packer = system.open_output_stream(path, compression=None), zlib.compressobj(6, wbits=31)
                    done.append((path, 0))
                payload = row["html"].encode()
                data = encode_record(row["page_id"], row["url"], payload, row["first_id"], row["revisit"])
                sink.write(packer.compress(data))
                done[-1] = (path, done[-1][1] + 1)
                size += len(data)
                if size >= ARCHIVE_BYTES:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()),
                                          pa.array([n for _, n in done], pa.int64())],
                                         ["path", "records"])

    return durable(told.mapInArrow(written, _WRITTEN))


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite each archive of `path` with one gzip member per record.

    Returns the index: path of the new archive, offset and length of the member, record id. The same
    lines stand in a sidecar file, `path` + `.idx`. A stream has no entry points, so one archive is
    one task's work, in bounded memory.
    """
    def rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        for batch in batches:
            for source in batch.column("path").to_pylist():
                path, at = f"{root}/members-{uuid.uuid4().hex}.warc.gz", 0
                offsets, lengths, ids = [], [], []
                with system.open_input_stream(source, compression=None) as whole, \
                        system.open_output_stream(path, compression=None) as sink:
                    for record in split_records(inflated(whole)):
                        packer = zlib.compressobj(6, wbits=31)
                        member = packer.compress(record) + packer.flush()
                        sink.write(member)
                        offsets.append(at)
                        lengths.append(len(member))
                        ids.append(parse_record(record)[0]["WARC-Record-ID"])
                        at += len(member)
                with system.open_output_stream(f"{path}.idx", compression=None) as sidecar:
                    sidecar.write("".join(f"{i} {a} {n}\n" for i, a, n in
                                          zip(ids, offsets, lengths)).encode())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(ids), pa.string()), pa.array(offsets, pa.int64()),
                     pa.array(lengths, pa.int64()), pa.array(ids, pa.string())],
                    ["path", "offset", "length", "record_id"])

    return durable(only(archives, "path").mapInArrow(rewritten, _INDEX))


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records that the index names: page_id, url, record_type, payload_bytes, payload_digest,
    refers_to, and payload (null for revisits). Digests of stored payloads are checked."""
    def fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _open(folder)
        name, archive = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = []
                for entry in batch.slice(at, 256).to_pylist():
                    if entry["path"] != name:
                        if archive:
                            archive.close()
                        name, archive = entry["path"], system.open_input_file(entry["path"])
                    archive.seek(entry["offset"])
                    fields, block = parse_record(zlib.decompress(archive.read(entry["length"]), 31))
                    head, _, payload = block.partition(b"\r\n\r\n")
                    size = int(head.rpartition(b"Content-Length: ")[2])
                    kind, told = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and digest(payload) != told:
                        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
                    page, first = fields.get("Page-ID"), fields.get("Refers-To-Page-ID")
                    rows.append((page and int(page), fields["WARC-Target-URI"], kind, size, told,
                                 first and int(first), payload if kind == "response" else None))
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(),
                         pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                    ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to",
                     "payload"])
        if archive:
            archive.close()

    return only(index, "path", "offset", "length").mapInArrow(fetched, _RECORD)
