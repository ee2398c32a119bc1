"""Token ids in files of length-delimited binary records, with an offset index for shuffled reads.

A record: length (8 bytes), masked CRC-32 of those 8 bytes (4), payload, masked CRC-32 of the
payload (4); little-endian. A payload: a flag byte (1: there is a doc_id), doc_id (8), bytes per id
(1: 2 or 4), then the ids. The index beside a file has the offset (8 bytes) of each record.

Documents are dealt by ranges of doc_id and sorted within them; file n holds the n-th range, so the
files in order hold the corpus in ascending doc_id order. Each is written under a name of the task's
attempt, and the manifest names those that Spark committed. Reading goes front to back and verifies
every length and checksum.

Defined cases: null text = empty text, encoded as the end id alone; null doc_id sorts first; equal
doc_ids are ordered by text; an empty table gives no files and no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import SharedFile, materialise, open_filesystem, shared_dir
from .tokens import PieceEncoder, batches_of

END_ID = 2
SHARD_BYTES = 1 << 28
MASK_DELTA = 0xA282EAD8
MANIFEST = "shard int, path string, index_path string, records long, tokens long, bytes long"
ROWS = "shard int, nth long, doc_id long, before long, n_tokens long, ids_crc32 long"
_ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


class RecordError(ValueError):
    """A file that breaks the format or fails a checksum."""


def batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(x, _ARROW[k]) for x, k in zip(columns, kinds, strict=True)], list(names))


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame_record(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked_crc(length)), payload, struct.pack("<I", masked_crc(payload))))


def pack_payload(doc_id: int | None, ids: bytes) -> bytes:
    """``ids``: unsigned 32-bit; they take 2 bytes each where all fit."""
    values = np.frombuffer(ids, dtype="<u4")
    width = 2 if not len(values) or values.max() < 1 << 16 else 4
    return struct.pack("<BqB", doc_id is not None, doc_id or 0, width) + values.astype(f"<u{width}").tobytes()


def unpack_payload(payload: bytes) -> tuple[int | None, np.ndarray]:
    known, doc_id, width = struct.unpack_from("<BqB", payload)
    return doc_id if known else None, np.frombuffer(payload, dtype=f"<u{width}", offset=10).astype("<u4")


def iter_records(stream) -> Iterator[bytes]:
    """The payloads of a stream, one held at a time."""
    while head := stream.read(12):
        if len(head) < 12 or struct.unpack_from("<I", head, 8)[0] != masked_crc(head[:8]):
            raise RecordError("a record's length is cut off or fails its checksum")
        size = struct.unpack_from("<Q", head)[0]
        payload, tail = stream.read(size), stream.read(4)
        if len(payload) < size or len(tail) < 4 or struct.unpack("<I", tail)[0] != masked_crc(payload):
            raise RecordError("a record is cut off or fails its checksum")
        yield payload


def read_record(path: str, index_path: str, nth: int) -> tuple[int | None, np.ndarray]:
    """doc_id and ids of one record, found through the index: a shuffled read."""
    system, name = open_filesystem(index_path)
    with system.open_input_file(name) as index:
        offset = struct.unpack("<Q", index.read_at(8, 8 * nth))[0]
    system, name = open_filesystem(path)
    with system.open_input_file(name) as file:
        file.seek(offset)
        return unpack_payload(next(iter_records(file)))


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, shards: int | None = None) -> DataFrame:
    """Write all ``docs`` below ``folder``; returns the stored manifest, a row per file.

    ``shards``: where not given, so many that each has some ``SHARD_BYTES`` of text, and no fewer than the
    session's shuffle partitions."""
    spark = docs.sparkSession
    if not shards:
        size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, encoder, end = TaskContext.get().partitionId(), PieceEncoder.of(vocabulary), np.array([END_ID], dtype="<u4").tobytes()
        file, index, records, tokens = None, None, 0, 0
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), [x or "" for x in batch.column("text").to_pylist()]
            if ids and file is None:
                file, index = SharedFile(f"{folder}/files", f"part-{shard:06d}.rec"), SharedFile(f"{folder}/files", f"part-{shard:06d}.idx")
            for part in batches_of(texts):
                for doc_id, data in zip(ids[part], encoder.encode(texts[part]), strict=True):
                    data += end
                    index.write(struct.pack("<Q", file.write(frame_record(pack_payload(doc_id, data)))))
                    records, tokens = records + 1, tokens + len(data) // 4
        if file is not None:
            file.close()
            index.close()
            yield batch_of([(shard, file.uri, index.uri, records, tokens, file.size)], MANIFEST)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # the hash lets a doc_id that many rows share spread over several ranges
    dealt = rows.repartitionByRange(shards, F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id"), F.xxhash64("text"), F.col("text"))
    return materialise(dealt.mapInArrow(write, MANIFEST), "token-manifest")


def read_token_files(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """The records of the files named in ``manifest``, each read in sequence by one task."""

    schema = ROWS + ", ids binary" * with_ids

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, path in ((x["shard"], x["path"]) for b in batches for x in b.to_pylist()):
            system, name = open_filesystem(path)
            with system.open_input_stream(name, compression=None, buffer_size=1 << 20) as stream:
                rows, held, before = [], 0, 0
                for nth, payload in enumerate(iter_records(stream)):
                    doc_id, ids = unpack_payload(payload)
                    data = ids.tobytes()
                    rows.append((shard, nth, doc_id, before, len(ids), zlib.crc32(data), data)[: None if with_ids else -1])
                    before += len(ids)
                    held += len(data) if with_ids else 100
                    if held > 1 << 22:
                        yield batch_of(rows, schema)
                        rows, held = [], 0
                yield batch_of(rows, schema)

    spread = manifest.select("shard", "path").repartition(max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "shard")
    return spread.mapInArrow(scan, schema)


def positions(manifest: DataFrame, records: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32: a document starts after all ids of the files and records before its own.

    ``before`` counts the ids before a record within its file; the sum over files has a row per file, and is the
    side of the join that goes to all tasks (Spark's estimate of ``records`` is that of the manifest)."""
    files = manifest.select("shard", (F.sum("tokens").over(Window.orderBy("shard")) - F.col("tokens")).alias("base"))
    return records.join(F.broadcast(files), "shard").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Write all of ``docs`` in the session's shared folder, read the files back, and give each document's place."""
    manifest = write_token_files(docs, shared_dir(docs.sparkSession, "tokens"), vocabulary)
    return positions(manifest, read_token_files(manifest))
