"""Token ids as length-delimited binary records with a separate offset index.

A data file is a run of records: the payload's length (8 bytes), a masked checksum of the length
(4), the payload, a masked checksum of the payload (4), little-endian throughout. A payload is a
flag byte (bit 0: the id is null, bit 1: ids take four bytes instead of two), the document's id
(8 bytes) and the token ids. The index has a row per record with its file, byte offset and the
number of ids before it, so that records can be read in any order and in parts.
"""

from __future__ import annotations

import itertools
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from markset.llm.common import scratch, stored, table, tokenizer_path
from markset.llm.tokens import encoder, ids_crc32, some_texts

END_ID = 0
#: Bytes that a writer or reader holds before it passes them on.
BUFFER = 4 << 20
_HEAD = struct.Struct("<QI")
_PAYLOAD = struct.Struct("<Bq")
_INDEX = pa.schema([("file_no", pa.int32()), ("record", pa.int64()), ("file", pa.string()), ("byte_offset", pa.int64()), ("n_bytes", pa.int64()),
                    ("doc_id", pa.int64()), ("file_start", pa.int64()), ("n_tokens", pa.int64())])
_READ = pa.schema([("doc_id", pa.int64()), ("file_no", pa.int32()), ("file_start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def masked(data: bytes) -> int:
    """CRC-32, turned by 15 bits and shifted by a constant, so that a checksum of data that holds checksums stays useful."""
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray) -> bytes:
    wide = len(ids) > 0 and int(ids.max()) > 0xFFFF
    payload = _PAYLOAD.pack((doc_id is None) | wide << 1, doc_id or 0) + ids.astype("<u4" if wide else "<u2").tobytes()
    size = struct.pack("<Q", len(payload))
    return size + struct.pack("<I", masked(size)) + payload + struct.pack("<I", masked(payload))


def unframe(data: bytes) -> tuple[int | None, np.ndarray]:
    """The document's id and token ids of one record; a record that was damaged raises."""
    size, check = _HEAD.unpack_from(data)
    payload, end = data[_HEAD.size:-4], data[-4:]
    if masked(data[:8]) != check or len(payload) != size or struct.unpack("<I", end)[0] != masked(payload):
        raise ValueError("a record's checksum or length is wrong")
    flags, doc_id = _PAYLOAD.unpack_from(payload)
    return None if flags & 1 else doc_id, np.frombuffer(payload, "<u4" if flags & 2 else "<u2", offset=_PAYLOAD.size).astype(np.uint32)


def _filesystem(folder: str) -> tuple[pa.fs.FileSystem, str]:
    import pyarrow.fs as fs

    return fs.FileSystem.from_uri(folder if ":/" in folder else f"file://{folder}")


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Write ``docs(doc_id, text)`` in ascending doc_id order, a file for each range of ids, and return the stored index.

    Null ids come first; rows with the same id follow by text. A task's file has a name of its own, so
    an attempt that was lost or repeated leaves a file that the index doesn't name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        file_system, root = _filesystem(folder)
        name, out = f"part-{part:06d}-{uuid.uuid4().hex}.records", None
        at = tokens = number = 0
        for b in batches:
            rows, buffer = [], []
            for doc, ids in zip(b.column(0).to_pylist(), itertools.chain.from_iterable(map(enc.encode, some_texts(b.column(1)))), strict=True):
                ids = np.append(ids, np.uint32(end_id))
                data = frame(doc, ids)
                buffer.append(data)
                rows.append((part, number, name, at, len(data), doc, tokens, len(ids)))
                at, tokens, number = at + len(data), tokens + len(ids), number + 1
            if rows:
                if out is None:
                    file_system.create_dir(root, recursive=True)
                    out = file_system.open_output_stream(f"{root}/{name}")
                out.write(b"".join(buffer))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _INDEX, strict=True)], schema=_INDEX)
        if out is not None:
            out.close()

    ranged = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    index = ranged.mapInArrow(run, "file_no int, record long, file string, byte_offset long, n_bytes long, doc_id long, file_start long, n_tokens long")
    return stored(index, "record-index")


def with_starts(rows: DataFrame) -> DataFrame:
    """Add ``start``, the ids of all records before: those of earlier files and, in ``file_start``, of the same file."""
    files = rows.groupBy("file_no").agg(F.sum("n_tokens").alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    # one row per file
    shifts = files.select("file_no", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    return rows.join(F.broadcast(shifts), "file_no").withColumn("start", F.col("file_start") + F.col("_shift")).drop("_shift")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """Read the records that ``index`` names: doc_id, file_no, file_start, n_tokens and ids_crc32 as the files hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file_system, root = _filesystem(folder)
        name = source = None
        for b in batches:
            rows, c = [], b.to_pydict()
            k, n = 0, b.num_rows
            while k < n:
                # records that follow each other are read together
                j = k + 1
                while (j < n and c["file"][j] == c["file"][k] and c["byte_offset"][j] == c["byte_offset"][j - 1] + c["n_bytes"][j - 1]
                       and c["byte_offset"][j] - c["byte_offset"][k] < BUFFER):
                    j += 1
                if name != c["file"][k]:
                    if source is not None:
                        source.close()
                    name = c["file"][k]
                    source = file_system.open_input_file(f"{root}/{name}")
                begin = c["byte_offset"][k]
                data = source.read_at(c["byte_offset"][j - 1] + c["n_bytes"][j - 1] - begin, begin)
                for i in range(k, j):
                    at = c["byte_offset"][i] - begin
                    doc, ids = unframe(data[at:at + c["n_bytes"][i]])
                    rows.append((doc, c["file_no"][i], c["file_start"][i], len(ids), ids_crc32(ids)))
                k = j
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _READ, strict=True)], schema=_READ)
        if source is not None:
            source.close()

    return index.mapInArrow(run, "doc_id long, file_no int, file_start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write, then read back: doc_id, start, n_tokens, ids_crc32 per document, all from the files and their index.

    Null text is empty and has the end id alone; an empty table writes no file; columns besides
    doc_id and text are ignored.
    """
    index = write_records(docs, folder, tokenizer or tokenizer_path(), end_id)
    return with_starts(read_records(index, folder)).select("doc_id", "start", "n_tokens", "ids_crc32")


def op8_binary_records(spark, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), scratch(spark, "records"))
