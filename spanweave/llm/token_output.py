"""Token ids in seekable files: independent zstandard frames, a seek table, a checksum a frame.

Format of a file (``.ids.zst``), readable by any zstandard decoder:

* frames: each holds whole documents' ids (little-endian unsigned 32 bits), document after
  document in ascending doc_id order. A document of ``frame_ids`` ids or more has a frame of its own;
  shorter neighbours share one until together they have as many. Each has zstandard's content checksum.
* a skippable frame (magic 0x184D2A50): the documents of the file, as (doc_id, null flag, ids).
* a skippable frame (magic 0x184D2A5E): zstandard's seek table, per frame the compressed size, the
  size, and the low 32 bits of the content's XXH64; then the footer with the number of frames.

``read_documents`` decompresses only the frames that hold the documents asked for.

Documents are ordered by (doc_id, text), nulls first; equal rows each get their own ids. A null text
is empty and still ends in the end id. An empty table gives no file and an empty result. Other
columns are ignored. Writers name their files anew at each attempt and return the name, so a lost
executor leaves at most an unlisted file behind; only listed files count.
"""

from __future__ import annotations

import posixpath
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanweave.llm.common import batches, row_columns, whole_text
from spanweave.llm.tokens import encoder
from spanweave.session import materialize, shared_dir

SEEK_MAGIC, INDEX_MAGIC, FOOTER_MAGIC = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1
_DOC = np.dtype([("doc_id", "<i8"), ("null", "<u4"), ("n", "<u4")])
_ENTRY = np.dtype([("packed", "<u4"), ("size", "<u4"), ("sum", "<u4")])


def _records(numbers: array, kind: np.dtype) -> bytes:
    """Numbers in a row as packed records."""
    rows = np.frombuffer(numbers, np.int64).reshape(-1, len(kind)) if numbers else np.empty((0, len(kind)), np.int64)
    out = np.empty(len(rows), kind)
    for k, name in enumerate(kind.names):
        out[name] = rows[:, k]
    return out.tobytes()


class FrameWriter:
    """Writes one file of frames to an open binary sink."""

    def __init__(self, sink, frame_ids: int = 2_048, level: int = 1):
        self.sink, self.frame_ids = sink, frame_ids
        self.packer = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.waiting: list[bytes] = []
        self.held = 0
        #: Three numbers a document, and a frame, in a row.
        self.docs, self.entries = array("q"), array("q")

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.waiting and len(ids) // 4 >= self.frame_ids:
            self._flush()
        self.docs.extend((doc_id or 0, int(doc_id is None), len(ids) // 4))
        self.waiting.append(ids)
        self.held += len(ids) // 4
        if self.held >= self.frame_ids:
            self._flush()

    def _flush(self) -> None:
        data = b"".join(self.waiting)
        packed = self.packer.compress(data)
        self.sink.write(packed)
        self.entries.extend((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self.waiting, self.held = [], 0

    def close(self) -> None:
        if self.waiting:
            self._flush()
        index, table = (_records(numbers, kind) for numbers, kind in ((self.docs, _DOC), (self.entries, _ENTRY)))
        table += struct.pack("<IBI", len(self.entries) // 3, 0x80, FOOTER_MAGIC)
        self.sink.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        self.sink.write(struct.pack("<II", SEEK_MAGIC, len(table)) + table)


class FrameReader:
    """Reads the trailing tables of a file, then any of its frames."""

    def __init__(self, source):
        self.source = source
        end = source.size()
        frames, flags, magic = struct.unpack("<IBI", source.read_at(9, end - 9))
        if magic != FOOTER_MAGIC or not flags & 0x80:
            raise ValueError("no seek table with checksums at the end of the file")
        top = end - 9 - frames * _ENTRY.itemsize
        self.entries = np.frombuffer(source.read_at(frames * _ENTRY.itemsize, top), _ENTRY)
        self.starts = np.concatenate([[0], np.cumsum(self.entries["packed"].astype(np.int64))])
        at = int(self.starts[-1])
        magic, size = struct.unpack("<II", source.read_at(8, at))
        if magic != INDEX_MAGIC:
            raise ValueError("no document index")
        self.docs = np.frombuffer(source.read_at(size, at + 8), _DOC)
        ends = np.cumsum(self.docs["n"].astype(np.int64))
        #: Where each document's ids begin in the file, counted in ids, and which frame that is in.
        self.begins = ends - self.docs["n"]
        self.frame_begins = np.concatenate([[0], np.cumsum(self.entries["size"].astype(np.int64) // 4)])
        self.frame_of = np.searchsorted(self.frame_begins, self.begins, "right") - 1

    def frame(self, k: int) -> bytes:
        """A frame's ids as bytes; raises where the checksum does not hold."""
        e = self.entries[k]
        data = zstandard.ZstdDecompressor().decompress(self.source.read_at(int(e["packed"]), int(self.starts[k])))
        if len(data) != e["size"] or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != e["sum"]:
            raise ValueError(f"frame {k} does not match its checksum")
        return data

    def documents(self, wanted: list[int] | None = None) -> Iterator[tuple[int, bytes]]:
        """(row in the index, ids as bytes) of the documents at these rows; each frame is unpacked once."""
        rows = np.arange(len(self.docs)) if wanted is None else np.sort(np.asarray(wanted, dtype=np.int64))
        last, data = -1, b""
        for r in rows.tolist():
            k = int(self.frame_of[r])
            if k != last:
                last, data = k, self.frame(k)
            at = 4 * int(self.begins[r] - self.frame_begins[k])
            yield r, data[at : at + 4 * int(self.docs["n"][r])]


_FILES = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("path", T.StringType()), T.StructField("n_docs", T.LongType()), T.StructField("n_ids", T.LongType()), T.StructField("low", T.LongType()), T.StructField("high", T.LongType())])


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, out: str | None = None, frame_ids: int = 2_048, files: int | None = None, file_bytes: int = 256 << 20) -> DataFrame:
    """Encodes every document and writes the files; returns (path, n_docs, n_ids, low, high, start) a file.

    ``out`` is a folder's URI in a store that all executors reach; by default a new folder in the
    shared one. ``files`` is by default the session's number of shuffle partitions, and more where a file
    would have over ``file_bytes`` of text. ``low`` and ``high``: the file's doc_ids. ``start``: ids
    in all files before. The list of files is written before it is returned, so files are made once.
    """
    spark = docs.sparkSession
    out = out or posixpath.join(shared_dir(spark), "spanweave", f"ids-{uuid.uuid4().hex}")
    slim = row_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    total = 0 if files else slim.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    n = files or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // file_bytes))

    def write(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part = encoder(tokenizer), TaskContext.get().partitionId()
        end, writer, path, n_docs, n_ids, low, high = struct.pack("<I", end_id), None, "", 0, 0, None, None
        for batch in rows:
            if not batch.num_rows:
                continue
            if writer is None:
                store, folder = fs.FileSystem.from_uri(out)
                store.create_dir(folder, recursive=True)
                name = f"{part:06d}-{uuid.uuid4().hex}.ids.zst"
                path, sink = posixpath.join(out, name), store.open_output_stream(posixpath.join(folder, name), compression=None)
                writer = FrameWriter(sink, frame_ids)
            ids_of, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for lo in range(0, len(ids_of), 500):
                for doc_id, ids in zip(ids_of[lo : lo + 500], code.encode(texts.slice(lo, 500).to_pylist())):
                    writer.add(doc_id, ids + end)
                    n_docs, n_ids = n_docs + 1, n_ids + len(ids) // 4 + 1
                    low, high = doc_id if low is None else low, doc_id
        if writer:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [path], "n_docs": pa.array([n_docs], pa.int64()), "n_ids": pa.array([n_ids], pa.int64()), "low": pa.array([low], pa.int64()), "high": pa.array([high], pa.int64())})

    made = slim.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(write, _FILES)
    # dealt by part, so that a task that runs again replaces its own row; few tasks write, since for each local file
    # that Spark makes the JVM may start helper processes, which have its whole memory until they run
    listed = materialize(made.repartition(8, "part"), "id-files", n)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    return listed.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long")).drop("part")


_READ = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])


def token_digests(files: DataFrame) -> DataFrame:
    """Reads all files back, a file a task: doc_id, start, n_tokens and the crc32 of the ids."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_file(name) as source:
                    got = FrameReader(source)
                    sums = np.fromiter((zlib.crc32(ids) for _, ids in got.documents()), np.int64, len(got.docs))
                    ids = pa.array(got.docs["doc_id"].astype(np.int64), mask=got.docs["null"] > 0)
                    yield from batches(schema, {"doc_id": ids, "start": start + got.begins, "n_tokens": got.docs["n"].astype(np.int64), "ids_crc32": sums})

    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select("path", "start").repartition(n, "path").mapInArrow(read, _READ)


def read_documents(path: str, doc_ids: list[int]) -> dict[int, list[int]]:
    """Ids of some documents of one file; only their frames are decompressed."""
    store, name = fs.FileSystem.from_uri(path)
    with store.open_input_file(name) as source:
        got = FrameReader(source)
        rows = np.flatnonzero(np.isin(got.docs["doc_id"], doc_ids) & (got.docs["null"] == 0)).tolist()
        return {int(got.docs["doc_id"][r]): np.frombuffer(ids, "<u4").tolist() for r, ids in got.documents(rows)}


def find_documents(files: DataFrame, doc_ids: list[int]) -> dict[int, list[int]]:
    """Ids of some documents of a whole set of files: the listing tells which files to open."""
    asked = files.sparkSession.createDataFrame([(int(i),) for i in doc_ids], "id long")
    hit = files.join(F.broadcast(asked), F.col("id").between(F.col("low"), F.col("high")))  # the caller's ids
    paths = [r["path"] for r in hit.select("path").distinct().collect()]  # as many as ids, at most
    return {i: ids for p in sorted(paths) for i, ids in read_documents(p, doc_ids).items()}
