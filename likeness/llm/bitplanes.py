"""Token ids as binary files of shuffled planes, in the order of the documents.

Ids are dealt into blocks of fixed size. A block is transposed into planes, one for each
byte (or each bit) of the ids, and every plane is compressed on its own with zstandard:
the high planes are nearly constant. A file holds whole documents, their ids and lengths,
and a chunk index, so any block can be found without reading those before it:

    magic, then u32: version, bits per plane, ids per block; u64: documents, ids, blocks
    documents x i64 doc_id, documents x u8 (1: no doc_id), documents x u64 length
    blocks x (planes + 1) u64: where each plane begins and the last one ends, from here on
    the planes

Files are rows (part, file, before, n_ids, n_docs, body) of a Parquet table that Spark
writes, so they survive lost executors and may lie in any store Spark can reach.
"""

from __future__ import annotations

import struct
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from likeness.llm.common import key
from likeness.llm.tokens import encoder

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAGIC = b"IDPLANES"
HEAD = "<8sIIIQQQ"
BLOCK = 1 << 16
# A file is closed by the document that brings it to this many ids.
FILE_IDS = 1 << 20
LEVEL = 1
FILES = "part int, file int, before long, n_ids long, n_docs long, body binary"


def planes_of(ids: np.ndarray, bits: int) -> list[bytes]:
    """The planes of one block, lowest first; each is empty where all its bits are 0."""
    if bits == 8:
        planes = ids.view("u1").reshape(-1, 4).T
        found = [np.ascontiguousarray(plane) for plane in planes]
    else:
        found = [np.packbits((ids >> b & 1).astype("u1")) for b in range(32)]
    return [plane.tobytes() if plane.any() else b"" for plane in found]


def block_of(planes: list[bytes], n: int, bits: int) -> np.ndarray:
    if bits == 8:
        ids = np.zeros((n, 4), "u1")
        for b, plane in enumerate(planes):
            if plane:
                ids[:, b] = np.frombuffer(plane, "u1")
        return ids.reshape(-1).view("<u4")
    ids = np.zeros(n, "<u4")
    for b, plane in enumerate(planes):
        if plane:
            ids |= np.unpackbits(np.frombuffer(plane, "u1"), count=n).astype("<u4") << b
    return ids


def file_body(doc_ids: list, texts: list[bytes], bits: int = 8, block: int = BLOCK) -> bytes:
    """A file of the documents' ids, given as little-endian 32-bit bytes."""
    import zstandard

    compress = zstandard.ZstdCompressor(level=LEVEL).compress
    ids = np.frombuffer(b"".join(texts), "<u4")
    stored, ends, at = [], [], 0
    for start in range(0, len(ids), block):
        ends.append(at)
        for plane in planes_of(ids[start : start + block], bits):
            stored.append(compress(plane) if plane else b"")
            at += len(stored[-1])
            ends.append(at)
    n_blocks = -(-len(ids) // block)
    head = struct.pack(HEAD, MAGIC, 1, bits, block, len(doc_ids), len(ids), n_blocks)
    names = np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes()
    missing = np.array([d is None for d in doc_ids], "u1").tobytes()
    lengths = np.array([len(t) // 4 for t in texts], "<u8").tobytes()
    return b"".join([head, names, missing, lengths, np.array(ends, "<u8").tobytes(), *stored])


def read_body(body: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """doc_ids, lengths and ids of a file."""
    import zstandard

    magic, version, bits, block, n_docs, n_ids, n_blocks = struct.unpack_from(HEAD, body)
    if magic != MAGIC or version != 1:
        raise ValueError("not a file of id planes")
    at = struct.calcsize(HEAD)
    names = np.frombuffer(body, "<i8", n_docs, at).tolist()
    missing = np.frombuffer(body, "u1", n_docs, at + 8 * n_docs)
    lengths = np.frombuffer(body, "<u8", n_docs, at + 9 * n_docs).astype(np.int64)
    at += 17 * n_docs
    n_planes = 32 // bits
    ends = np.frombuffer(body, "<u8", n_blocks * (n_planes + 1), at)
    ends = ends.astype(np.int64).reshape(n_blocks, n_planes + 1)
    at += 8 * ends.size
    expand = zstandard.ZstdDecompressor().decompress
    blocks = []
    for k in range(n_blocks):
        stored = [body[at + ends[k, p] : at + ends[k, p + 1]] for p in range(n_planes)]
        planes = [expand(one) if one else b"" for one in stored]
        blocks.append(block_of(planes, min(block, n_ids - k * block), bits))
    ids = np.concatenate(blocks) if blocks else np.zeros(0, "<u4")
    return [None if m else d for d, m in zip(names, missing, strict=True)], lengths, ids


def write_planes(
    docs: DataFrame,
    path: str,
    vocabulary: str,
    end_id: int,
    id: str = "doc_id",
    text: str = "text",
    bits: int = 8,
    block: int = BLOCK,
) -> None:
    """Encode whole texts, append ``end_id`` to each, and write the files to ``path``.

    Documents are in ascending order of id, those without id first; documents of one id
    are ordered by a hash of the text and then by the text. A null text is an empty one,
    an empty table gives no file, other columns are left out. Ids are dealt out in ranges,
    and the ranges may cut between texts of one id, so such ids are no hot key.
    """
    if bits not in (1, 8):
        raise ValueError("planes have 1 bit or 8 bits")
    own = docs.select(F.col(key(id)).cast("long").alias("id"), F.col(key(text)).alias("text"))
    hashed = F.xxhash64("text")
    ordered = own.repartitionByRange(F.col("id").asc_nulls_first(), hashed)
    ordered = ordered.sortWithinPartitions(F.col("id").asc_nulls_first(), hashed, "text")
    end = struct.pack("<I", end_id)

    def write(batches):
        from pyspark import TaskContext

        part, find = TaskContext.get().partitionId(), encoder(vocabulary).ids
        names, parts, held, file, before = [], [], 0, 0, 0

        def row():
            body = file_body(names, parts, bits, block)
            columns = [[part], [file], [before], [held], [len(names)], [body]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(
                arrays, ["part", "file", "before", "n_ids", "n_docs", "body"]
            )

        for batch in batches:
            for doc_id, body in zip(batch.column(0), batch.column(1), strict=True):
                names.append(doc_id.as_py())
                parts.append(find(body.as_py()) + end)
                held += len(parts[-1]) // 4
                if held >= FILE_IDS:
                    yield row()
                    names, parts, held, file, before = [], [], 0, file + 1, before + held
        if names:
            yield row()

    ordered.mapInArrow(write, FILES).write.parquet(path)


def read_planes(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document: ``start`` counts the ids of all
    documents before it, ``ids`` are little-endian unsigned 32-bit bytes."""
    files = spark.read.schema(FILES).parquet(path)
    # One row for each task that wrote: bounded by the number of tasks, not of documents.
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select(
        F.col("part").alias("of"),
        (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"),
    )
    placed = files.join(F.broadcast(parts), files["part"] == parts["of"]).select(
        (F.col("part_start") + F.col("before")).alias("start"), "body"
    )

    def read(batches):
        names = ["doc_id", "start", "n_tokens", "ids"]
        for batch in batches:
            for start, body in zip(batch.column(0), batch.column(1), strict=True):
                doc_ids, lengths, ids = read_body(body.as_py())
                raw, ends = ids.tobytes(), np.cumsum(lengths)
                begins = ends - lengths
                cut = [raw[4 * b : 4 * e] for b, e in zip(begins, ends, strict=True)]
                columns = [
                    pa.array(doc_ids, pa.int64()),
                    pa.array(begins + start.as_py(), pa.int64()),
                    pa.array(lengths, pa.int64()),
                    pa.array(cut, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    return placed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")
