"""WARC archives as seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each with whole WARC records, and a seek table
in a skippable frame at its end (the public seekable format: compressed size, decompressed size
and checksum of every frame). The index is a table that names for every record its bundle, its
frame, and its offset and size within the frame, so a record is read by decoding one frame.

Bundles get names of their own for each attempt of a task, and the index, which Spark commits
task by task, names only those of the attempts that count. A lost executor leaves at most a
bundle that nothing names.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyguard.llm.joins import join_counted
from tallyguard.llm.workers import map_arrow
from tallyguard.session import work_dir, written

# Fixed values of the seekable Zstandard format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80
_SKIPPABLE = struct.Struct("<II")
_ENTRY = struct.Struct("<III")
_FOOTER = struct.Struct("<IBI")

FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 256 << 20
LEAST_BYTES = 0
CAPTURED = "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "page_id long, record_id string, bundle string, frame int, offset long, size long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
_END = b"\r\n\r\n"


def record_id(page_id: int | None, digest: str) -> str:
    """The record identifier that follows from a page and its payload."""
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}"


def _header_value(text: str) -> str:
    """The text on one header line; control characters are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in text)


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    lines = "".join(f"{name}: {value}\r\n" for name, value in fields if value is not None)
    head = f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n"
    return head.encode("utf-8", "surrogatepass") + block + _END


def page_record(
    page_id: int | None,
    url: str | None,
    payload: bytes | None,
    digest: str,
    size: int,
    refers_to: int | None,
    revisit: bool,
    captured: str = CAPTURED,
) -> bytes:
    """One response record, or a revisit record, which holds the HTTP header but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<{record_id(page_id, digest)}>"),
        ("WARC-Date", captured),
        ("WARC-Target-URI", None if url is None else _header_value(url)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Page-Id", page_id),
        ("WARC-Profile", REVISIT_PROFILE if revisit else None),
        ("WARC-Refers-To", f"<{record_id(refers_to, digest)}>" if revisit else None),
        ("X-Refers-To-Page-Id", refers_to if revisit else None),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    return _record(fields, http if revisit else http + (payload or b""))


def _split_head(data: memoryview | bytes) -> tuple[dict[str, str], int]:
    """Header fields of a record or HTTP message and the place after them."""
    raw = bytes(data[: 1 << 14])
    end = raw.find(_END)
    if end < 0:
        raw = bytes(data)
        end = raw.index(_END)
    lines = raw[:end].decode("utf-8", "surrogatepass").split("\r\n")[1:]
    return dict(line.split(": ", 1) for line in lines), end + len(_END)


def parse_records(data: bytes) -> Iterator[tuple[int, dict[str, str], memoryview]]:
    """Offset, header fields and block of every record of a frame."""
    view = memoryview(data)
    at = 0
    while at < len(view):
        fields, head = _split_head(view[at:])
        size = int(fields["Content-Length"])
        yield at, fields, view[at + head : at + head + size]
        at += head + size + len(_END)
        if bytes(view[at - len(_END) : at]) != _END:
            raise ValueError("a record doesn't end where its length says")


def read_page(fields: dict[str, str], block: memoryview) -> tuple[dict, bytes | None]:
    """The row of a record and its payload, whose digest is checked; a revisit has no payload."""
    http, head = _split_head(block)
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    payload = None if revisit else bytes(block[head:])
    size = int(http["Content-Length"])
    if payload is not None and (len(payload) != size or payload_digest(payload) != digest):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} is damaged")
    page, refers = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page-Id")
    row = {
        "page_id": None if page is None else int(page),
        "url": fields.get("WARC-Target-URI"),
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": None if refers is None else int(refers),
    }
    return row, payload


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


class BundleWriter:
    """Writes records into frames and the seek table behind them."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES):
        self._out = out
        self._frame_bytes = frame_bytes
        self._compress = zstandard.ZstdCompressor(write_content_size=True).compress
        self._held: list[bytes] = []
        self._size = 0
        self._entries: list[tuple[int, int, int]] = []
        self.written = 0

    def add(self, record: bytes) -> tuple[int, int]:
        """Frame number of the record and its offset there. A record is never cut."""
        if self._held and self._size + len(record) > self._frame_bytes:
            self._flush()
        place = len(self._entries), self._size
        self._held.append(record)
        self._size += len(record)
        return place

    def _flush(self) -> None:
        data = b"".join(self._held)
        packed = self._compress(data)
        self._out.write(packed)
        self._entries.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self.written += len(packed)
        self._held, self._size = [], 0

    def close(self) -> None:
        if self._held:
            self._flush()
        table = b"".join(_ENTRY.pack(*entry) for entry in self._entries)
        table += _FOOTER.pack(len(self._entries), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self._out.write(_SKIPPABLE.pack(SKIPPABLE_MAGIC, len(table)) + table)


class BundleReader:
    """Frames of a bundle by their number, from the seek table at its end."""

    def __init__(self, source):
        self._source = source
        total = source.size()
        source.seek(total - _FOOTER.size)
        count, flags, magic = _FOOTER.unpack(source.read(_FOOTER.size))
        if magic != SEEKABLE_MAGIC or not flags & CHECKSUM_FLAG:
            raise ValueError("not a seekable bundle with checksums")
        size = count * _ENTRY.size
        source.seek(total - _FOOTER.size - size)
        self._entries = list(_ENTRY.iter_unpack(source.read(size)))
        self._starts = [0]
        for packed, _, _ in self._entries:
            self._starts.append(self._starts[-1] + packed)
        self._decompress = zstandard.ZstdDecompressor().decompress

    def __len__(self) -> int:
        return len(self._entries)

    def frame(self, number: int) -> bytes:
        packed, size, checksum = self._entries[number]
        self._source.seek(self._starts[number])
        data = self._decompress(self._source.read(packed), max_output_size=size)
        if len(data) != size or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {number} is damaged")
        return data


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as the workers need it."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    made = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()
    scheme, _, rest = made.partition(":")
    return f"file:///{rest.lstrip('/')}" if scheme == "file" else made


def _write(folder: str, frame_bytes: int, bundle_bytes: int, captured: str):
    names = [field.split()[0] for field in INDEX.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
    schema = pa.schema(list(zip(names, types, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        target, top = _open(folder)
        out = bundle = None
        name = ""
        try:
            for batch in batches:
                places = []
                for page, url, payload, sha1, size, refers, revisit in zip(*batch.columns, strict=True):
                    if bundle is None:
                        name = f"pages-{part:05d}-{uuid.uuid4().hex}.warc.zst"
                        out = target.open_output_stream(f"{top}/{name}", compression=None)
                        bundle = BundleWriter(out, frame_bytes)
                        about = [("WARC-Type", "warcinfo"), ("WARC-Date", captured), ("WARC-Filename", name)]
                        about.append(("WARC-Record-ID", f"<{record_id(None, name)}>"))
                        about.append(("Content-Type", "application/warc-fields"))
                        bundle.add(_record(about, b"format: WARC File Format 1.1\r\n"))
                    digest = base64.b32encode(bytes.fromhex(sha1.as_py())).decode()
                    page_id = page.as_py()
                    record = page_record(
                        page_id, url.as_py(), payload.as_py(), digest, size.as_py(), refers.as_py(), revisit.as_py(), captured
                    )
                    frame, offset = bundle.add(record)
                    places.append((page_id, record_id(page_id, digest), name, frame, offset, len(record)))
                    if bundle.written >= bundle_bytes:
                        bundle.close()
                        out.close()
                        bundle = None
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*places, strict=True), types, strict=True)]
                    if places
                    else [pa.array([], t) for t in types],
                    schema=schema,
                )
        finally:
            if bundle is not None:
                bundle.close()
                out.close()

    return run


def decided(pages: DataFrame, id_col: str, url_col: str, html_col: str, least_bytes: int) -> DataFrame:
    """Pages with digest, size, whether they revisit another page's payload, and which.

    Equal payloads are found by their SHA-256, aggregated before the shuffle; payloads that very
    many pages share are joined by a broadcast of at most a thousand rows.
    """
    payload = F.coalesce(F.col(html_col).cast("string").cast("binary"), F.lit(b""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        payload.alias("payload"),
    ).select(
        "*",
        F.sha1("payload").alias("sha1"),
        F.octet_length("payload").cast("long").alias("size"),
        F.sha2("payload", 256).alias("key"),
    )
    large = rows.where(F.col("size") >= least_bytes)
    counted = large.groupBy("key").agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
    joined = join_counted(large, written(counted, "payloads"), "key", "copies")
    revisit = ~F.col("page_id").eqNullSafe(F.col("first"))
    out = joined.select(
        "page_id",
        "url",
        F.when(~revisit, F.col("payload")).alias("payload"),
        "sha1",
        "size",
        F.when(revisit, F.col("first")).alias("refers_to"),
        revisit.alias("revisit"),
    )
    if least_bytes > 0:
        small = rows.where(F.col("size") < least_bytes)
        out = out.unionByName(
            small.select(
                "page_id", "url", "payload", "sha1", "size",
                F.lit(None).cast("long").alias("refers_to"), F.lit(False).alias("revisit"),
            )
        )
    return out


def write_archives(
    pages: DataFrame,
    folder: str | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    least_bytes: int = LEAST_BYTES,
    captured: str = CAPTURED,
    frame_bytes: int = FRAME_BYTES,
    bundle_bytes: int = BUNDLE_BYTES,
) -> tuple[str, DataFrame]:
    """Writes a record per page; returns the folder and the index of the records.

    Of pages with equal payloads of at least ``least_bytes`` bytes, that with the smallest id is a
    response and the others revisit it; smaller payloads are all responses. A null html is an
    empty payload, a null url has no header line. Rows that repeat both id and payload of a
    response are responses too, under one record id. Rows without an id revisit one with an id
    where there is one, else they are responses. An empty table gives no bundle. Other columns
    are not read. A record is never cut: one larger than a frame has a frame of its own.
    """
    spark = pages.sparkSession
    folder = qualified(spark, folder or work_dir(spark, "warc"))
    target, top = _open(folder)
    target.create_dir(top, recursive=True)
    rows = decided(pages, id_col, url_col, html_col, least_bytes)
    index = map_arrow(rows, _write(folder, frame_bytes, bundle_bytes, captured), INDEX)
    index.write.parquet(f"{folder}/index")
    return folder, spark.read.parquet(f"{folder}/index")


def _arrays(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


_ROW_SCHEMA = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64())]
    + [("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
)


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, top = _open(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with target.open_input_file(f"{top}/{name}") as source:
                    bundle = BundleReader(source)
                    for number in range(len(bundle)):
                        found = parse_records(bundle.frame(number))
                        rows = [read_page(f, b)[0] for _, f, b in found if f["WARC-Type"] != "warcinfo"]
                        yield _arrays(rows, _ROW_SCHEMA)

    return run


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows dealt by their bundle; stated by number, as the few bytes of names would be merged."""
    return rows.repartition(max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "bundle")


def read_archives(folder: str, index: DataFrame) -> DataFrame:
    """Every record of the bundles that the index names: page, url, size and digest of the full
    payload, type, and the page that a revisit refers to. Frames are decoded one after another,
    payloads are checked against their digests."""
    return map_arrow(_dealt(index.select("bundle").distinct()), _read(folder), RECORDS)


def _seek(folder: str):
    schema = pa.schema([*_ROW_SCHEMA, ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, top = _open(folder)
        opened, source, bundle, number, data = None, None, None, -1, b""
        try:
            for batch in batches:
                for name, frame, offset, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if name != opened:
                        if source is not None:
                            source.close()
                        source = target.open_input_file(f"{top}/{name}")
                        opened, bundle, number = name, BundleReader(source), -1
                    if frame != number:
                        number, data = frame, bundle.frame(frame)
                    _, fields, block = next(parse_records(data[offset : offset + size]))
                    row, payload = read_page(fields, block)
                    yield _arrays([{**row, "payload": payload}], schema)
        finally:
            if source is not None:
                source.close()

    return run


def find_records(folder: str, index: DataFrame, wanted: DataFrame) -> DataFrame:
    """The records, with their payloads, of the pages whose ids are in ``page_id`` of ``wanted``.
    Only their frames are read; the table of wanted ids is joined, however large it is."""
    ids = wanted.select(F.col("page_id").cast("long")).distinct()
    places = index.join(ids, "page_id", "left_semi").select("bundle", "frame", "offset", "size")
    ordered = _dealt(places).sortWithinPartitions("bundle", "frame", "offset")
    return map_arrow(ordered, _seek(folder), f"{RECORDS}, payload binary")


def oracle() -> str:
    """The same rows from the pages themselves; base32 is made of groups of five hex digits."""
    return f"""
WITH rows AS (
  SELECT page_id, coalesce(html, '') AS payload FROM pages),
digests AS (
  SELECT page_id, octet_length(encode(payload))::BIGINT AS payload_bytes, sha1(payload) AS hex,
    min(page_id) OVER (PARTITION BY payload) AS first
  FROM rows)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((
      ('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INTEGER, 1)), '') AS payload_digest,
  CASE WHEN payload_bytes >= {LEAST_BYTES} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {LEAST_BYTES} AND page_id <> first THEN first END AS refers_to
FROM digests
"""
