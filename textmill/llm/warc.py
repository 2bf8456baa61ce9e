"""Web archives: WARC records in Zstandard frames of their own, behind a dictionary made from the archive's records."""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..session import scratch_path
from .common import stored, text_bytes

#: Fixed values of the formats: the frame that may hold a dictionary, a Zstandard frame, a dictionary, and the profile of a revisit.
DICTIONARY_FRAME = 0x184D2A5D
ZSTD_FRAME = b"\x28\xb5\x2f\xfd"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ARCHIVE_BYTES = 32 << 20
DICTIONARY_BYTES = 112_640
LEVEL = 3
#: A dictionary is not worth its place, or can't be made, below these.
LEAST_SAMPLES, LEAST_BYTES = 16, 64 << 10
SUFFIX = ".warc.zst"
RECORDS = "key string, record_type string, uri string, payload binary, payload_bytes long, payload_sha1 string, refers_to string"


_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_digest(sha1_hex: Column) -> Column:
    """Base32 of a SHA-1 in hex: 32 digits of 5 bits, taken from groups of 5 hex digits."""
    groups = [F.conv(F.substring(sha1_hex, 1 + 5 * i, 5), 16, 10).cast("int") for i in range(8)]
    return F.concat(*(F.substring(F.lit(_DIGITS), 1 + F.shiftright(g, s).bitwiseAND(F.lit(31)), F.lit(1)) for g in groups for s in (15, 10, 5, 0)))


def bare_digest(sha1_hex: str) -> str:
    """Base32 of a SHA-1, as WARC payload digests are written."""
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def _name(key: str | None) -> str:
    return "<urn:x-no-key:>" if key is None else f"<urn:x-key:{quote(key, safe='')}>"


def _key(name: str | None) -> str | None:
    found = re.fullmatch(r"<urn:x-key:(.*)>", name or "")
    return unquote(found[1]) if found else None


def record_bytes(key: str | None, record_type: str, uri: str | None, payload: bytes | None, payload_bytes: int, payload_sha1: str,
                 refers_to: str | None, date: str) -> bytes:
    """One WARC record. Its block is an HTTP response; that of a revisit has the header only, with the length of the full payload."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    if record_type == "response":
        block += payload or b""
    # Control characters, spaces and other scripts can't stand in a header line.
    target = quote(uri if uri else "about:blank", safe="!#$%&'()*+,/:;=?@[]~")
    head = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: {_name(key)}", f"WARC-Date: {date}", f"WARC-Target-URI: {target}",
            f"WARC-Payload-Digest: sha1:{bare_digest(payload_sha1)}"]
    if record_type == "revisit":
        head += [f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def packed_archive(records: list[bytes], dictionary_bytes: int = DICTIONARY_BYTES, level: int = LEVEL) -> bytes:
    """The records as one archive: the dictionary made from all of them in a leading skippable frame, then a frame for each record.

    Archives of few or small records have no dictionary and start with the first record.
    """
    head, known = b"", None
    total = sum(map(len, records))
    if len(records) >= LEAST_SAMPLES and total >= LEAST_BYTES:
        try:
            known = zstandard.train_dictionary(min(dictionary_bytes, total // 8), records, k=256, d=8, f=18, accel=4)
        except zstandard.ZstdError:
            known = None  # records too alike or too short to give one
    if known is not None:
        packed = zstandard.ZstdCompressor(level=level).compress(known.as_bytes())
        head = struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed
        known.precompute_compress(level=level)
    one = zstandard.ZstdCompressor(level=level, dict_data=known, write_checksum=True)
    return b"".join([head, *map(one.compress, records)])


def _decompressor(content: bytes) -> tuple[zstandard.ZstdDecompressor, int]:
    """A decompressor with the archive's dictionary, and where the records start."""
    if len(content) >= 8:
        magic, size = struct.unpack_from("<II", content)
        if magic == DICTIONARY_FRAME:
            held = content[8:8 + size]
            if held.startswith(ZSTD_FRAME):
                held = zstandard.ZstdDecompressor().decompress(held)
            return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held)), 8 + size
    return zstandard.ZstdDecompressor(), 0


def _headers(lines: Iterator[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        if line in (b"\r\n", b"\n", b""):
            break
        name, _, value = line.partition(b":")
        out[name.strip().lower().decode()] = value.strip().decode()
    return out


def read_archive(content: bytes) -> Iterator[tuple]:
    """The records of an archive in order, with the columns of RECORDS. Payloads are held against their digests and lengths."""
    decompressor, start = _decompressor(content)
    stream = io.BufferedReader(decompressor.stream_reader(io.BytesIO(memoryview(content)[start:]), read_across_frames=True), 1 << 20)
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head = _headers(iter(stream.readline, None))
        block = stream.read(int(head["content-length"]))
        http, _, payload = block.partition(b"\r\n\r\n")
        size = int(_headers(iter(http.split(b"\r\n")[1:]))["content-length"])
        sha1 = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
        whole = head["warc-type"] == "response"
        if whole and (len(payload) != size or hashlib.sha1(payload).hexdigest() != sha1):
            raise ValueError(f"the payload of {head['warc-record-id']} differs from its digest")
        yield (_key(head["warc-record-id"]), head["warc-type"], head["warc-target-uri"], payload if whole else None, size, sha1,
               _key(head.get("warc-refers-to")))


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class ArchiveWriter(DataSourceArrowWriter):
    """Each task writes archives below a temporary folder; the commit moves those of the tasks that count to their names."""

    def __init__(self, options: dict[str, str], schema) -> None:
        self.path = options["path"]
        self.limit = int(options.get("archivebytes", ARCHIVE_BYTES))
        self.date = options.get("date", "1970-01-01T00:00:00Z")
        self.names = schema.fieldNames()
        self.job = f"_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = fs.FileSystem.from_uri(self.path)
        task = TaskContext.get().partitionId()
        attempt = uuid.uuid4().hex
        system.create_dir(f"{root}/{self.job}", recursive=True)
        files: list[str] = []
        held: list[bytes] = []
        size = 0

        def put() -> None:
            name = f"part-{task:05d}-{len(files):05d}-{attempt}{SUFFIX}"
            with system.open_output_stream(f"{root}/{self.job}/{name}", compression=None) as out:
                out.write(packed_archive(held))
            files.append(name)
            held.clear()

        order = [f.split()[0] for f in RECORDS.split(", ")]
        for batch in iterator:
            for row in zip(*(batch.column(self.names.index(c)).to_pylist() for c in order)):
                record = record_bytes(*row, date=self.date)
                if held and size + len(record) > self.limit:
                    put()
                    size = 0
                held.append(record)
                size += len(record)
        if held:
            put()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = fs.FileSystem.from_uri(self.path)
        system.create_dir(root, recursive=True)
        for message in messages:
            for name in message.files if message else []:
                system.move(f"{root}/{self.job}/{name}", f"{root}/{name}")
        self._clear(system, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*fs.FileSystem.from_uri(self.path))

    def _clear(self, system: fs.FileSystem, root: str) -> None:
        if system.get_file_info(f"{root}/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.job}")


class Archives(DataSource):
    """`df.write.format("warc_zst")` for rows with the columns of RECORDS; options `path`, `archiveBytes` and `date`."""

    @classmethod
    def name(cls) -> str:
        return "warc_zst"

    def schema(self) -> str:
        return RECORDS

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter({k.lower(): v for k, v in self.options.items()}, schema)


def write_archives(records: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Rows with the columns of RECORDS as archives of up to `archive_bytes` of records each, below a new folder."""
    records.sparkSession.dataSource.register(Archives)
    columns = [f.split()[0] for f in RECORDS.split(", ")]
    records.select(*columns).write.format("warc_zst").mode("append").option("path", path).option("archiveBytes", archive_bytes).save()


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of all archives below a folder, with the columns of RECORDS; a revisit has no payload."""
    columns = [f.split()[0] for f in RECORDS.split(", ")]
    types = [pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), types)], columns)

        for batch in batches:
            for content in batch.column("content"):
                rows: list[tuple] = []
                size = 0
                for row in read_archive(content.as_py()):
                    rows.append(row if with_payload else (*row[:3], None, *row[4:]))
                    size += 200 + len(rows[-1][3] or b"")
                    if size > 8 << 20:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{SUFFIX}").schema(
        "path string, modificationTime timestamp, length long, content binary").load(path)
    return files.select("content").mapInArrow(work, RECORDS)


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """A record for each page, with the columns of RECORDS: a revisit if a page with a smaller id has the same payload.

    The payload is the text in UTF-8, a null text has an empty one. Payloads of fewer than `min_bytes` bytes are all responses. The smallest id of
    each payload is found from 256-bit digests with map-side combination and stored; pages meet only those of payloads that
    occur more than once, so a frequent payload is a skewed join key that Spark can split.

    Rows with a null id revisit the page with the smallest id, if there is one, else they are responses. Rows that repeat the smallest
    id of a payload are all responses. An empty table gives no rows. Other columns are not read.
    """
    payload = text_bytes(text_col)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("uri"), payload.alias("payload"),
                        F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("digest"))
    owners = (rows.where(F.col("payload_bytes") >= min_bytes).groupBy("digest").agg(F.min("id").alias("owner"), F.count("*").alias("n"))
              .where("n > 1 AND owner IS NOT NULL").drop("n"))
    joined = rows.join(stored(owners, "owners"), "digest", "left")
    again = F.col("owner").isNotNull() & ~F.col("id").eqNullSafe(F.col("owner"))
    return joined.select(
        F.col("id").cast("string").alias("key"), F.when(again, "revisit").otherwise("response").alias("record_type"), "uri",
        F.when(~again, F.col("payload")).alias("payload"), "payload_bytes", F.sha1("payload").alias("payload_sha1"),
        F.when(again, F.col("owner").cast("string")).alias("refers_to"))


def archive_pages(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", text_col: str = "html",
                  min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> str:
    """Write the pages as archives below a new folder (by default one in the shared folder) and return it. See `page_records`.

    Very long texts are one record and, above `archive_bytes`, an archive of their own. A null url is written as about:blank; characters that a
    header line can't hold are percent-encoded.
    """
    path = path or scratch_path(pages.sparkSession, "archives")
    write_archives(page_records(pages, id_col, url_col, text_col, min_bytes), path, archive_bytes)
    return path
