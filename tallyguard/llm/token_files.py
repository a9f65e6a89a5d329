"""Token-id files with Elias-Fano coded document boundaries.

Documents are dealt to ranges of ids, sorted, encoded and written as files of a bounded number
of ids. A file holds the ids of its documents one after another, and two Elias-Fano codes: the
boundaries of the documents and their ids. The global position of a file follows from the
totals of the files before it, so no 64-bit table of positions is kept.

File format, little-endian: ``IDEF``, version, bytes per id, number of documents without an id
(they come first), smallest document id, length of the codes, code of the boundaries, code of
the document ids above the smallest, ids.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyguard.llm.elias_fano import RisingList, encode
from tallyguard.llm.tokens import encoder
from tallyguard.session import work_dir
from tallyguard.llm.workers import map_arrow

_HEADER = struct.Struct("<4sHHQqQ")
_MAGIC = b"IDEF"

MANIFEST = "part int, number int, file string, n_docs long, n_ids long"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def file_bytes(doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    """One file; ``ids`` holds the unsigned 32-bit ids of each document."""
    lengths = np.array([len(x) // 4 for x in ids], dtype=np.uint64)
    bounds = encode(np.concatenate([[np.uint64(0)], np.cumsum(lengths, dtype=np.uint64)]))
    known = [x for x in doc_ids if x is not None]
    least = known[0] if known else 0
    names = encode(np.array([x - least for x in known], dtype=np.uint64))
    values = np.frombuffer(b"".join(ids), "<u4")
    wide = len(values) and int(values.max()) > 0xFFFF
    values = values.astype("<u4" if wide else "<u2")
    head = _HEADER.pack(_MAGIC, 1, values.itemsize, len(ids) - len(known), least, len(bounds) + len(names))
    return head + bounds + names + values.tobytes()


class TokenFile:
    """Reads one file; ``ids(i)`` finds document i by two selects."""

    def __init__(self, data: bytes):
        magic, version, width, self.nameless, self.least, codes = _HEADER.unpack_from(data)
        if magic != _MAGIC or version != 1:
            raise ValueError("not a token file of version 1")
        view = memoryview(data)[_HEADER.size :]
        self.bounds = RisingList(view)
        self.names = RisingList(view[self.bounds.size :])
        self.values = np.frombuffer(view[codes:], f"<u{width}")

    def __len__(self) -> int:
        return self.bounds.count - 1

    def doc_id(self, i: int) -> int | None:
        return None if i < self.nameless else self.least + self.names.get(i - self.nameless)

    def ids(self, i: int) -> np.ndarray:
        return self.values[self.bounds.get(i) : self.bounds.get(i + 1)]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Id, position in the file and token ids of every document."""
        bounds = self.bounds.all().astype(np.int64)
        names = [None] * self.nameless + [self.least + int(x) for x in self.names.all()]
        for i, name in enumerate(names):
            yield name, int(bounds[i]), self.values[bounds[i] : bounds[i + 1]]


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as the workers need it."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    made = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()
    return made.replace("file:/", "file:///", 1) if made.startswith("file:/") and not made.startswith("file://") else made


def _write(folder: str, tokenizer: str, end_id: int, file_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        target, top = _file_system(folder)
        encode_text = encoder(tokenizer).encode
        end = struct.pack("<I", end_id)
        names: list[int | None] = []
        held: list[bytes] = []
        size = number = 0
        written: list[dict] = []

        def flush() -> None:
            nonlocal size, number
            name = f"ids-{part:05d}-{number:05d}.idef"
            partial = f"{top}/.{name}.{attempt}"
            with target.open_output_stream(partial) as out:
                out.write(file_bytes(names, held))
            target.move(partial, f"{top}/{name}")
            written.append({"part": part, "number": number, "file": name, "n_docs": len(held), "n_ids": size})
            names.clear()
            held.clear()
            size, number = 0, number + 1

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                names.append(name)
                held.append(encode_text(text.as_py()) + end)
                size += len(held[-1]) // 4
                if size >= file_ids:
                    flush()
        if held:
            flush()
        yield pa.RecordBatch.from_pylist(
            written,
            schema=pa.schema(
                [("part", pa.int32()), ("number", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]
            ),
        )

    return run


def write_token_files(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    folder: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    file_ids: int = 4_000_000,
) -> tuple[str, DataFrame]:
    """Writes the files in ascending order of the document id and returns the folder and the
    manifest: part, number in the part, file, documents and ids.

    Null texts are empty, so they hold the end id only; rows without an id come first; rows with
    the same id follow in the order in which Spark reads them. A file closes once it holds
    ``file_ids`` ids. Files appear by a rename, and a task that runs again writes the same names
    with the same content. An empty table gives no file.
    """
    spark = docs.sparkSession
    folder = folder or work_dir(spark, "token-files")
    folder = _qualified(spark, folder)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
        F.monotonically_increasing_id().alias("place"),
    )
    dealt = rows.repartitionByRange("doc_id", "place").sortWithinPartitions("doc_id", "place")
    target, top = _file_system(folder)
    target.create_dir(top, recursive=True)
    manifest = map_arrow(dealt.select("doc_id", "text"), _write(folder, tokenizer, end_id, file_ids), MANIFEST)
    manifest.write.parquet(f"{folder}/manifest")
    return folder, spark.read.parquet(f"{folder}/manifest")


def placed(manifest: DataFrame) -> DataFrame:
    """The manifest with ``first``, the number of ids in all files before. Only the totals of the
    parts, one number for each task of the write, come to the driver."""
    spark = manifest.sparkSession
    parts = sorted((r["part"], r["n_ids"]) for r in manifest.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).collect())
    starts, total = [], 0
    for part, ids in parts:
        starts.append((part, total))
        total += ids
    before = spark.createDataFrame(starts, "part int, base long")
    in_part = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.join(F.broadcast(before), "part").withColumn(
        "first", F.col("base") + F.coalesce(F.sum("n_ids").over(in_part), F.lit(0))
    )


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, top = _file_system(folder)
        for batch in batches:
            for file, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with target.open_input_file(f"{top}/{file}") as source:
                    data = TokenFile(source.read())
                rows = [
                    (name, first + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
                    for name, at, ids in data.documents()
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(column, pa.int64()) for column in zip(*rows, strict=True)],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return run


def read_token_files(folder: str, manifest: DataFrame) -> DataFrame:
    """Per document, from the files: id, global start, number of ids and their CRC-32."""
    files = placed(manifest).select("file", "first")
    spark = manifest.sparkSession
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return map_arrow(files.repartition(tasks, "file"), _read(folder), ROWS)
