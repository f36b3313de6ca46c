"""Token-id files of compressed byte or bit planes [operator 2].

A file holds blocks of a fixed number of ids.  A block is transposed: plane k
has byte (or bit) k of every id, and each plane is compressed by itself with
zstandard.  Behind the blocks stands the chunk index, a compressed JSON object
with the place of each plane and the columns of the documents, then its length
and a magic number.

    block 0: plane 0, plane 1, ...   block 1: ...   index   length (8 bytes)   magic (8 bytes)
"""

from __future__ import annotations

import json
import struct
from collections.abc import Callable, Iterable, Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.chunks import worker_table
from millrace.llm.common import partitions_for, slices, texts, written

MAGIC = b"IDPLANE1"
BLOCK = 1 << 16
#: Bytes of ids that a reader hands on at once.
READ_BYTES = 16 << 20


def shuffle_block(ids: np.ndarray, bits: bool = False) -> list[bytes]:
    """Planes of unsigned 32-bit ids, least first; planes above the largest id are left out."""
    width = max(1, int(ids.max()).bit_length()) if ids.size else 1
    as_bytes = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [np.ascontiguousarray(as_bytes[:, k]).tobytes() for k in range((width + 7) // 8)]
    flags = np.unpackbits(as_bytes, axis=1, bitorder="little")
    return [np.packbits(flags[:, k], bitorder="little").tobytes() for k in range(width)]


def unshuffle_block(planes: list[bytes], n: int, bits: bool = False) -> np.ndarray:
    if not bits:
        out = np.zeros((n, 4), np.uint8)
        for k, plane in enumerate(planes):
            out[:, k] = np.frombuffer(plane, np.uint8)
    else:
        flags = np.zeros((n, 32), np.uint8)
        for k, plane in enumerate(planes):
            flags[:, k] = np.unpackbits(np.frombuffer(plane, np.uint8), bitorder="little", count=n)
        out = np.packbits(flags, axis=1, bitorder="little")
    return out.reshape(-1).view("<u4")


class Writer:
    """Writes documents to an open binary file, a block at a time."""

    def __init__(self, file: BinaryIO, bits: bool = False, block: int = BLOCK, level: int = 3):
        self.file, self.bits, self.block = file, bits, block
        self.compress = zstandard.ZstdCompressor(level=level).compress
        self.at, self.held, self.parts = 0, 0, []
        self.blocks: list[list] = []
        self.keys: list[int | None] = []
        self.counts: list[int] = []

    def add(self, key: int | None, ids: bytes) -> None:
        self.keys.append(key)
        self.counts.append(len(ids) // 4)
        self.parts.append(ids)
        self.held += len(ids) // 4
        if self.held >= self.block:
            self._flush(last=False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.parts), "<u4")
        upto = len(ids) if last else len(ids) - len(ids) % self.block
        for start in range(0, upto, self.block):
            part = ids[start : min(start + self.block, upto)]
            places = []
            for plane in map(self.compress, shuffle_block(part, self.bits)):
                self.file.write(plane)
                places.append((self.at, len(plane)))
                self.at += len(plane)
            self.blocks.append([len(part), places])
        self.parts, self.held = [ids[upto:].tobytes()], len(ids) - upto

    def close(self) -> None:
        self._flush(last=True)
        index = self.compress(json.dumps({"bits": self.bits, "block": self.block, "blocks": self.blocks, "keys": self.keys, "counts": self.counts}).encode())
        self.file.write(index + struct.pack("<Q", len(index)) + MAGIC)


class Reader:
    """Reads any block or document range of a file by its index."""

    def __init__(self, file: BinaryIO, size: int):
        self.file = file
        self.decompress = zstandard.ZstdDecompressor().decompress
        file.seek(size - 16)
        tail = file.read(16)
        if tail[8:] != MAGIC:
            raise ValueError("not a file of id planes")
        n = struct.unpack("<Q", tail[:8])[0]
        file.seek(size - 16 - n)
        self.index = json.loads(self.decompress(file.read(n)))

    def block(self, k: int) -> np.ndarray:
        n, places = self.index["blocks"][k]
        planes = []
        for at, size in places:
            self.file.seek(at)
            planes.append(self.decompress(self.file.read(size)))
        return unshuffle_block(planes, n, self.index["bits"])

    def documents(self) -> Iterator[tuple[int | None, bytes]]:
        held, following = b"", 0
        for key, count in zip(self.index["keys"], self.index["counts"], strict=True):
            parts = [held]
            have = len(held) // 4
            while have < count:
                parts.append(self.block(following).tobytes())
                have += len(parts[-1]) // 4
                following += 1
            joined = b"".join(parts) if len(parts) > 1 else held
            yield key, joined[: 4 * count]
            held = joined[4 * count :]


def _open(uri: str, mode: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    if mode == "r":
        return system.open_input_file(path)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path)


#: Documents a file holds at most; its index lists them.
FILE_DOCUMENTS = 1 << 20

MANIFEST = "part int, file int, path string, n_docs long, n_ids long"


def write(
    docs: DataFrame,
    tokenizer: str,
    folder: str,
    end_id: int = 2,
    bits: bool = False,
    file_ids: int = 1 << 25,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Encode all texts and write them in ascending doc_id order as files below ``folder``, a URI that all executors reach.

    Returns the manifest, already written (see MANIFEST), one row a file; files follow each other in the
    order of ``part`` and ``file``.  file_ids: ids after which a task begins another file; a longer document
    has one to itself.  A null text counts as empty and holds the end id alone; null doc_ids come first;
    rows with the same doc_id follow each other in the order of their texts' hashes; an empty table writes no file;
    other columns are not read; texts of any length are encoded whole.  Nothing is renamed or replaced: a
    file's name holds its attempt, and only those of the attempts that Spark committed are in the manifest.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = worker_table(tokenizer).joined, np.array([end_id], "<u4").tobytes()
        context = TaskContext.get()
        part, n, writer, n_ids, path = context.partitionId(), 0, None, 0, ""
        for batch in slices(batches):
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = encode(text or "") + end
                if writer is not None and (n_ids + len(ids) // 4 > file_ids or len(writer.keys) >= FILE_DOCUMENTS):
                    yield _listed(writer, part, n, path, n_ids)
                    n, writer, n_ids = n + 1, None, 0
                if writer is None:
                    path = f"{folder}/ids-{part:06d}-{n:04d}-{context.taskAttemptId()}.planes"
                    writer = Writer(_open(path, "w"), bits)
                n_ids += len(ids) // 4
                writer.add(key, ids)
        if writer is not None:
            yield _listed(writer, part, n, path, n_ids)

    rows, key = texts(docs, id_col, text_col).withColumn("tie", F.xxhash64("text")), F.col("doc_id").asc_nulls_first()
    # the hash lets ranges divide the rows of one id, and is all that the sample for them holds of a text
    ordered = rows.repartitionByRange(partitions_for(rows), key, "tie").sortWithinPartitions(key, "tie", "text")
    return written(docs.sparkSession, ordered.select("doc_id", "text").mapInArrow(run, MANIFEST), folder, "manifest")


def _listed(writer: Writer, part: int, n: int, path: str, n_ids: int) -> pa.RecordBatch:
    """Finish a file; its row of the manifest."""
    writer.close()
    writer.file.close()
    row = (pa.array([part], pa.int32()), pa.array([n], pa.int32()), pa.array([path]), pa.array([len(writer.keys)], pa.int64()), pa.array([n_ids], pa.int64()))
    return pa.RecordBatch.from_arrays(list(row), [c.split()[0] for c in MANIFEST.split(", ")])


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, ids) of every document, from the files; start: ids of all documents before it.

    The driver holds the manifest, one row a file, to number the ids; documents stay with the executors.
    An empty manifest gives no row.
    """
    files, before = [], 0
    for row in sorted(manifest.collect(), key=lambda r: (r["part"], r["file"])):
        files.append((row["path"], before))
        before += row["n_ids"]
    if not files:
        return spark.createDataFrame([], "doc_id long, start long, ids binary")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist(), strict=True):
                file = _open(path, "r")
                yield from _batches(Reader(file, file.size()).documents(), start)
                file.close()

    return spark.createDataFrame(files, "path string, before long").repartition(len(files), "path").mapInArrow(run, "doc_id long, start long, ids binary")


def _batches(documents: Iterable[tuple[int | None, bytes]], start: int, emit: Callable = pa.RecordBatch.from_arrays) -> Iterator[pa.RecordBatch]:
    keys, starts, ids, held = [], [], [], 0
    make = lambda: emit([pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "start", "ids"])
    for key, value in documents:
        keys.append(key)
        starts.append(start)
        ids.append(value)
        start += len(value) // 4
        held += len(value)
        if held >= READ_BYTES:
            yield make()
            keys, starts, ids, held = [], [], [], 0
    if keys:
        yield make()
