"""WARC archives in Zstandard frames, written and read back.

An archive begins with a skippable frame that holds its dictionary (itself a Zstandard frame or
raw, as the public .warc.zst convention has it), then one Zstandard frame per record. The reader
takes the dictionary from that frame, decodes one frame per record, and checks frame magic,
version line, header syntax, Content-Length against the record's bytes, and block and payload
digests. Tasks write and read archives through the file system that the shared folder's URI names.
A table names the archives that a task reported, and only those are read, so a task that ran twice
leaves nothing that counts, and no list of archives reaches the driver.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotegraph.plans.shared import fresh_path

SKIPPABLE = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
#: Payload bytes in an archive; pages that train a dictionary, the bytes of one at most, and the dictionary's size.
ARCHIVE_BYTES, DICTIONARY_PAGES, DICTIONARY_PAGE, DICTIONARY_BYTES, LEVEL = 16 << 20, 256, 1 << 16, 1 << 16, 3
LEAST_REVISIT = 100
#: Groups of equal payloads that may be broadcast; beyond it the join is shuffled.
BROADCAST_GROUPS = 100_000
#: Tasks that read archives, at most.
READ_TASKS = 20_000


class WarcError(ValueError):
    """An archive or a record that isn't valid."""


def record_types(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """``pages`` (page_id, html) as page_id, payload, digest and refers_to; null refers_to is a response.

    Of equal payloads of at least ``least`` bytes the one with the smallest page_id is the
    response. Ids may be of any type that can be ordered; among rows that repeat that id each is a response.
    """
    body = pages.select("page_id", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")).withColumn("digest", F.lower(F.sha2("payload", 256)))
    large = body.filter(F.octet_length("payload") >= least)
    groups = large.groupBy("digest").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1 AND _first IS NOT NULL").select(F.col("digest").alias("_d"), "_first")
    side = F.broadcast(groups) if groups.count() <= BROADCAST_GROUPS else groups
    again = (F.octet_length("payload") >= least) & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return body.join(side, F.col("digest") == F.col("_d"), "left").select("page_id", "payload", "digest", F.when(F.col("_first").isNotNull() & again, F.col("_first")).alias("refers_to"))


def _headers(page_id, payload: bytes, digest: str, refers_to) -> bytes:
    uri = lambda x: f"urn:page:{quote(str(x), safe='')}"
    kind = "response" if refers_to is None else "revisit"
    block = payload if refers_to is None else b""
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{uri(page_id)}#{digest}')}>",
        "WARC-Date: 2020-01-01T00:00:00Z",
        *([] if page_id is None else [f"WARC-Target-URI: {uri(page_id)}"]),
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest() if refers_to is not None else digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/octet-stream",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines[3:3] = [f"WARC-Refers-To-Target-URI: {uri(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train_dictionary(pages: DataFrame, most: int = DICTIONARY_PAGES) -> bytes:
    """A dictionary from about ``most`` whole pages, those with the least hashes of the ones that aren't large; empty if they are too few."""
    ranked = pages.filter(F.octet_length("html") <= DICTIONARY_PAGE).select("html", F.xxhash64(F.col("page_id").cast("string"), F.length("html")).alias("_h"))
    least = ranked.select("_h").orderBy("_h").limit(most).agg(F.max("_h")).first()[0]  # hashes only: each task sends its least ones
    if least is None:
        return b""
    samples = [r[0].encode("utf-8") for r in ranked.filter(F.col("_h") <= least).limit(most).collect()]
    if len(samples) < 16:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _file_system(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system and the path of a URI as Hadoop writes it."""
    scheme, colon, rest = uri.partition(":")
    if not colon or uri.startswith("/"):
        return pyarrow.fs.FileSystem.from_uri(uri)
    rest = "//" + rest if not rest.startswith("//") else rest
    return pyarrow.fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + ":" + rest)


def archive_head(dictionary: bytes) -> bytes:
    """The leading skippable frame, or nothing without a dictionary."""
    if not dictionary:
        return b""
    packed = zstandard.ZstdCompressor(level=LEVEL).compress(dictionary)
    return struct.pack("<II", SKIPPABLE, len(packed)) + packed


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    more = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    return zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True, **more)


def write_archives(records: DataFrame, folder: str, dictionary: bytes, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes ``records`` (page_id, payload, digest, refers_to) and reports ``(path, records)`` of each archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, where = _file_system(folder)
        fs.create_dir(where, recursive=True)
        packer, head = _compressor(dictionary), archive_head(dictionary)
        done, held, size = [], [], 0

        def close() -> None:
            name = f"{uuid.uuid4().hex}.warc.zst"
            with fs.open_output_stream(f"{where}/{name}", compression=None) as out:
                out.write(head + b"".join(held))
            done.append((f"{folder}/{name}", len(held)))

        for b in batches:
            for page_id, payload, digest, refers_to in zip(*(b.column(c) for c in ("page_id", "payload", "digest", "refers_to"))):
                held.append(packer.compress(_headers(page_id.as_py(), payload.as_py(), digest.as_py(), refers_to.as_py())))
                size += len(payload.as_buffer()) + 512
                if size >= archive_bytes:
                    close()
                    held, size = [], 0
        if held:
            close()
        yield pa.RecordBatch.from_pydict({"path": pa.array([d[0] for d in done], pa.string()), "records": pa.array([d[1] for d in done], pa.int64())})

    named = [F.col(c).cast("string").alias(c) for c in ("page_id", "refers_to")]
    return records.select(named[0], "payload", "digest", named[1]).mapInArrow(run, "path string, records long")


def read_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record; raises WarcError on anything that isn't valid."""
    at, dictionary = 0, None
    if len(data) >= 8:
        magic, length = struct.unpack_from("<II", data)
        if magic == SKIPPABLE:
            raw = data[8 : 8 + length]
            if len(raw) < length:
                raise WarcError("the dictionary's frame is cut short")
            if raw[:4] == struct.pack("<I", FRAME_MAGIC):
                raw = zstandard.ZstdDecompressor().decompress(raw)
            dictionary, at = zstandard.ZstdCompressionDict(raw), 8 + length
    unpacker = zstandard.ZstdDecompressor(**({"dict_data": dictionary} if dictionary else {}))
    view = memoryview(data)
    while at < len(data):
        if data[at : at + 4] != struct.pack("<I", FRAME_MAGIC):
            raise WarcError(f"no frame at byte {at}")
        frame = unpacker.decompressobj()
        try:
            # a frame's compressed end isn't known beforehand: feed pieces until it is complete
            parts, start = [], at
            while not frame.eof:
                piece = view[at : at + (1 << 13)]
                if not len(piece):
                    raise WarcError(f"the frame at byte {start} is cut short")
                parts.append(frame.decompress(piece))
                at += len(piece)
            at -= len(frame.unused_data)
        except zstandard.ZstdError as e:
            raise WarcError(f"the frame at byte {start}: {e}") from e
        yield parse_record(b"".join(parts))


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    head, gap, rest = record.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise WarcError("a record has no WARC head")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name or name != name.strip():
            raise WarcError(f"header line {line[:60]!r}")
        headers[name.decode("ascii").lower()] = value.strip().decode("utf-8")
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise WarcError(f"a record lacks {name}")
    if not headers["content-length"].isdigit():
        raise WarcError("Content-Length is no number")
    n = int(headers["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise WarcError(f"Content-Length {n} doesn't fit {len(rest)} bytes")
    return headers, rest[:n]


def _row(headers: dict[str, str], block: bytes) -> tuple:
    target, kind = headers.get("warc-target-uri"), headers["warc-type"]
    payload = headers.get("warc-payload-digest", "").removeprefix("sha256:")
    for name, want in (("block", headers.get("warc-block-digest", "")), ("payload", "sha256:" + payload if kind == "response" else "")):
        if want and want != "sha256:" + hashlib.sha256(block).hexdigest():
            raise WarcError(f"the {name} digest of {target} doesn't fit")
    length = int(headers["x-payload-length"])
    if kind == "response" and length != len(block):
        raise WarcError(f"the payload of {target} has {len(block)} bytes, not {length}")
    name = lambda uri: None if uri is None else unquote(uri.rpartition(":")[2])
    return name(target), length, payload, kind, name(headers.get("warc-refers-to-target-uri")), block


def read_archives(manifest: DataFrame, keep: bool = True, id_type: str = "bigint") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record of the archives of ``manifest`` (path); with ``keep`` the payload (null in revisits).

    A task holds one archive at a time.
    """
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"][: 6 if keep else 5]
    kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                fs, where = _file_system(path)
                with fs.open_input_file(where) as f:
                    content = f.read()
                rows = []
                for headers, block in read_archive(content):
                    row = _row(headers, block)
                    rows.append((*row[:5], block if row[3] == "response" else None)[: len(names)])
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in zip(range(len(names)), kinds)], names)

    schema = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string" + (", payload binary" if keep else "")
    found = manifest.select("path").repartition(max(1, min(manifest.count(), READ_TASKS)), "path").mapInArrow(run, schema)
    return found.select(*[F.col(c).cast(id_type).alias(c) if c in ("page_id", "refers_to") else c for c in names])


def round_trip(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES, keep: bool = False) -> DataFrame:
    """Writes ``pages`` (page_id, html; other columns are ignored) as archives and reads them back.

    A null html is an empty payload. An empty table writes no archive and gives an empty result.
    Rows repeat as records. Rows without a page_id get records without a target; among them equal
    payloads with a smallest id elsewhere are revisits of it. Ids may be of any type that a string
    can be cast to.
    """
    spark = pages.sparkSession
    folder = fresh_path(spark, "warc")
    written = write_archives(record_types(pages), folder, train_dictionary(pages), archive_bytes)
    manifest = fresh_path(spark, "warc-manifest")
    written.write.parquet(manifest)
    return read_archives(spark.read.parquet(manifest), keep, pages.schema["page_id"].dataType.simpleString())
