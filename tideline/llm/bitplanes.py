"""Token ids in a binary format of shuffled planes.

A shard is one self-contained value: a header, a chunk index, a table of its documents and the compressed planes. The
ids of its documents, end to end, are cut into blocks of ``BLOCK_IDS``; each block of 32-bit ids is transposed into four
byte planes or 32 bit planes, and each plane is compressed with zstandard. The chunk index holds, for every block, the
number of ids, their crc32 and the length of every compressed plane, so a reader finds any block without decoding others.

Shards are rows of a Parquet table (part, shard, start_in_part, n_ids, n_docs, payload) in the shared folder: whatever
store Spark reads and writes holds them, and a lost task is written again. Documents are range-partitioned by id; a shard
closes at ``SHARD_IDS`` ids, so a reader holds one shard at a time. A document is never split over shards.

Defined results: null and empty texts have the end id alone; null ids sort first; repeated ids are ordered by text and
keep one entry each; an empty table gives no shard and an empty result; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm import tokens
from tideline.session import materialize

MAGIC = b"TPL1"
HEADER = struct.Struct("<4sBxxxIQII")  # magic, mode, block, ids, docs, bytes of the document table
BLOCK_IDS = 1 << 14
SHARD_IDS = 1 << 20
MODES = {"byte": 0, "bit": 1}
PLANES = {0: 4, 1: 32}
LEVEL = 3


def to_planes(ids: np.ndarray, mode: int) -> list[bytes]:
    """Planes of a block, least significant first."""
    rows = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if mode:
        rows = np.packbits(np.unpackbits(rows, axis=1, bitorder="little").T, axis=1, bitorder="little")
        return [row.tobytes() for row in rows]
    return [row.tobytes() for row in np.ascontiguousarray(rows.T)]


def from_planes(planes: list[bytes], n: int, mode: int) -> np.ndarray:
    rows = np.stack([np.frombuffer(p, dtype=np.uint8) for p in planes])
    if mode:
        rows = np.packbits(np.unpackbits(rows, axis=1, count=n, bitorder="little").T, axis=1, bitorder="little")
        return np.ascontiguousarray(rows).view("<u4").reshape(-1)
    return np.ascontiguousarray(rows.T).view("<u4").reshape(-1)


def write_shard(doc_ids: list[int | None], ids: list[np.ndarray], mode: str = "byte", block: int = BLOCK_IDS) -> bytes:
    kind, packer = MODES[mode], zstandard.ZstdCompressor(level=LEVEL)
    stream = np.concatenate(ids) if ids else np.zeros(0, "<u4")
    index, body = [], []
    for at in range(0, len(stream), block):
        part = stream[at : at + block]
        planes = [packer.compress(p) for p in to_planes(part, kind)]
        index.append(struct.pack(f"<{2 + len(planes)}I", len(part), zlib.crc32(part.tobytes()), *map(len, planes)))
        body += planes
    known = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    table = packer.compress(
        np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes() + known.tobytes() + np.array([len(x) for x in ids], dtype="<u4").tobytes()
    )
    return b"".join([HEADER.pack(MAGIC, kind, block, len(stream), len(doc_ids), len(table)), *index, table, *body])


def read_shard(payload: bytes) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of every document of a shard, block by block; a wrong checksum raises ValueError."""
    magic, kind, block, n_ids, n_docs, table_bytes = HEADER.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not a shard")
    planes, chunks, unpacker = PLANES[kind], -(-n_ids // block), zstandard.ZstdDecompressor()
    index = np.frombuffer(payload, dtype="<u4", count=chunks * (planes + 2), offset=HEADER.size).reshape(chunks, planes + 2)
    at = HEADER.size + index.nbytes
    table = unpacker.decompress(payload[at : at + table_bytes])
    at += table_bytes
    doc_ids, known = np.frombuffer(table, "<i8", n_docs).tolist(), table[8 * n_docs : 9 * n_docs]
    lengths = np.frombuffer(table, "<u4", n_docs, 9 * n_docs).tolist()
    stream = np.empty(n_ids, dtype="<u4")
    for k, (count, crc, *sizes) in enumerate(index.tolist()):
        parts = []
        for size in sizes:
            parts.append(unpacker.decompress(payload[at : at + size]))
            at += size
        ids = from_planes(parts, count, kind)
        if zlib.crc32(ids.tobytes()) != crc:
            raise ValueError(f"block {k} is damaged")
        stream[k * block : k * block + count] = ids
    start = 0
    for doc_id, there, length in zip(doc_ids, known, lengths, strict=True):
        yield (doc_id if there else None), stream[start : start + length]
        start += length


def write_token_files(
    docs: DataFrame, spec: str, end_id: int, keep_spaces: bool = False, mode: str = "byte", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Encode every text, append ``end_id``, write shards in ascending id order; the table of shards, read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = tokens.encoder(spec, keep_spaces).encode, TaskContext.get().partitionId()
        end = np.uint32(end_id)
        doc_ids, ids, held, shard, start = [], [], 0, 0, 0

        def closed() -> pa.RecordBatch:
            row = {"part": part, "shard": shard, "start_in_part": start, "n_ids": held, "n_docs": len(ids), "payload": write_shard(doc_ids, ids, mode)}
            return pa.RecordBatch.from_pylist([row], schema=shard_schema)

        for batch in tokens.slices(batches, size=tokens.ENCODE_BYTES):
            for doc_id, own in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist()), strict=True):
                doc_ids.append(doc_id)
                ids.append(np.append(own, end).astype("<u4", copy=False))
                held += len(ids[-1])
                if held >= SHARD_IDS:
                    yield closed()
                    doc_ids, ids, shard, start, held = [], [], shard + 1, start + held, 0
        if ids:
            yield closed()

    shard_schema = pa.schema(
        [("part", pa.int32()), ("shard", pa.int32()), ("start_in_part", pa.int64()), ("n_ids", pa.int64()), ("n_docs", pa.int64()), ("payload", pa.binary())]
    )
    ordered = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    shards = ordered.mapInArrow(tokens.bounded(run, encodes=True), "part int, shard int, start_in_part long, n_ids long, n_docs long, payload binary")
    return materialize(shards, "token-files")


def read_token_files(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the shards alone.

    The totals of the parts come to the driver; there are as many as range partitions, whatever the number of rows.
    """
    totals = {r["part"]: r["n"] for r in shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    part_start, run_total = {}, 0
    for part in sorted(totals):
        part_start[part] = run_total
        run_total += totals[part]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tokens.slices(batches, 1):
            (row,) = batch.to_pylist()
            start, out = part_start[row["part"]] + row["start_in_part"], []
            for doc_id, ids in read_shard(row["payload"]):
                out.append({"doc_id": doc_id, "start": start, "n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.tobytes())})
                start += len(ids)
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    return shards.mapInArrow(tokens.bounded(run), "doc_id long, start long, n_tokens long, ids_crc32 long")
