"""Token-ID output (operator 2): framed binary records with an offset index.

File format, all numbers little-endian.  A shard ``NNNNNN.rec`` is a run of records; a record is

    length of the payload, uint64 | masked crc32 of those 8 bytes, uint32 | payload | masked crc32 of the payload, uint32

and the payload is ``doc_id int64, has_id uint8, width uint8 (2 or 4), ids``.  Beside it ``NNNNNN.idx`` holds one row of four int64 for each record:
doc_id, byte offset of the record, number of ids, ids before it in the shard.  The index makes shuffled
reads possible: any record can be fetched by its offset and checked by its checksums.  A masked checksum is
the crc rotated right by 15 bits plus 0xA282EAD8, so that a crc stored beside data isn't itself taken for data.

Shards hold ascending ids: the rows are range-partitioned by id and sorted within a partition, and each task
writes one shard under its partition number.  A repeated attempt writes the same bytes: files are written
under a name of their own and moved into place.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.llm import common
from maskloom.llm.bpe import ENCODE_BYTES, encoder
from maskloom.llm.words import slices

_HEAD, _META = struct.Struct("<QI"), struct.Struct("<qBB")
_FLUSH = 1 << 20
NULL_ID = -(2**63)


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray) -> bytes:
    """One record: 2 bytes an id where all fit, else 4."""
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    payload = _META.pack(doc_id if doc_id is not None else 0, doc_id is not None, width) + ids.astype(f"<u{width}").tobytes()
    size = struct.pack("<Q", len(payload))
    return size + struct.pack("<I", masked(size)) + payload + struct.pack("<I", masked(payload))


def unframe(data: bytes | memoryview, at: int = 0) -> tuple[int | None, np.ndarray, int]:
    """The record at a byte offset: id, token ids, offset of the next one.  Raises ValueError on a bad checksum."""
    size, crc = _HEAD.unpack_from(data, at)
    if masked(bytes(data[at : at + 8])) != crc:
        raise ValueError("record_length_corrupt")
    payload = bytes(data[at + 12 : at + 12 + size])
    if len(payload) != size or masked(payload) != struct.unpack_from("<I", data, at + 12 + size)[0]:
        raise ValueError("record_payload_corrupt")
    doc_id, has_id, width = _META.unpack_from(payload)
    return (doc_id if has_id else None), np.frombuffer(payload, f"<u{width}", offset=_META.size).astype("<u4"), at + 16 + size


def _put(fs, path: str, write: Callable) -> None:
    """Write a file under another name and move it into place."""
    part = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as out:
        write(out)
    fs.move(part, path)


def write_records(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, partitions: int | None = None) -> DataFrame:
    """Encode ``text`` and write shards in ascending ``doc_id`` order; one row per shard: shard, path, docs, tokens, base.

    Null texts count as empty, so such a document is its end id alone.  A null id sorts first; rows with
    equal ids follow each other by a hash of their text.  ``base`` is the number of ids in all shards before.  Other columns
    are ignored.  An empty table gives no shards.
    """
    from pyarrow import fs as pafs

    spark = docs.sparkSession
    filesystem, root = pafs.FileSystem.from_uri(path)
    filesystem.create_dir(root, recursive=True)
    width = partitions or max(2, common.shuffle_width(spark))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text"))
    # the text's hash spreads rows of one id over partitions
    ordered = rows.withColumn("h", F.xxhash64("text")).repartitionByRange(width, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pafs
        from pyspark import TaskContext

        fs, base = pafs.FileSystem.from_uri(path)
        shard = TaskContext.get().partitionId()
        encode = encoder(tokenizer).encode
        index: list[tuple[int, int, int, int]] = []
        done = {"bytes": 0, "ids": 0}

        def body(out) -> None:
            buffer: list[bytes] = []
            held = 0
            for batch in batches:
                for part in slices(batch, "text", ENCODE_BYTES):
                    ids, counts = encode(part.column(1))
                    at = 0
                    for doc_id, n in zip(part.column(0).to_pylist(), counts.tolist(), strict=True):
                        own = np.append(ids[at : at + n], np.uint32(end_id))
                        at += n
                        record = frame(doc_id, own)
                        index.append((NULL_ID if doc_id is None else doc_id, done["bytes"], n + 1, done["ids"]))
                        done["bytes"] += len(record)
                        done["ids"] += n + 1
                        buffer.append(record)
                        held += len(record)
                        if held > _FLUSH:
                            out.write(b"".join(buffer))
                            buffer, held = [], 0
            out.write(b"".join(buffer))

        name = f"{base}/{shard:06d}"
        _put(fs, f"{name}.rec", body)
        _put(fs, f"{name}.idx", lambda out: out.write(np.array(index, "<i8").tobytes()))
        if index:
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [name], "docs": [len(index)], "tokens": [done["ids"]]}, pa.schema([("shard", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())]))

    shards = common.materialise(ordered.mapInArrow(write, "shard int, path string, docs long, tokens long"), "shards")
    # one small row per shard: the running sum is made where the rows are few
    counted = sorted(shards.select("shard", "path", "docs", "tokens").collect())
    base, out = 0, []
    for r in counted:
        out.append((r["shard"], r["path"], r["docs"], r["tokens"], base))
        base += r["tokens"]
    return spark.createDataFrame(out, "shard int, path string, docs long, tokens long, base long")


def read_records(shards: DataFrame, uri: str, with_ids: bool = True) -> DataFrame:
    """All records of the shards: doc_id, start (ids of all records before), n_tokens, ids_crc32, shard, offset, ids.

    Each task goes through whole shards, fetching every record by its index entry.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pafs

        fs, _ = pafs.FileSystem.from_uri(uri)
        for batch in batches:
            for shard in batch.to_pylist():
                with fs.open_input_stream(f"{shard['path']}.idx") as f:
                    index = np.frombuffer(f.read(), "<i8").reshape(-1, 4)
                with fs.open_input_file(f"{shard['path']}.rec") as f:
                    size, at = f.size(), 0
                    while at < len(index):
                        begin = int(index[at, 1])
                        to = max(at + 1, int(np.searchsorted(index[:, 1], begin + (4 << 20), "right")) - 1)
                        stop = int(index[to, 1]) if to < len(index) else size
                        data = memoryview(f.read_at(stop - begin, begin))
                        rows = []
                        for k in range(at, to):
                            doc_id, ids, _ = unframe(data, int(index[k, 1]) - begin)
                            rows.append((doc_id, shard["base"] + int(index[k, 3]), len(ids), zlib.crc32(ids.tobytes()), shard["shard"], int(index[k, 1]), ids))
                        at = to
                        columns = list(zip(*rows, strict=True))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(columns[0], pa.int64()), *(pa.array(c, pa.int64()) for c in columns[1:4]), pa.array(columns[4], pa.int32()), pa.array(columns[5], pa.int64()), *([pa.array(columns[6], pa.list_(pa.uint32())).cast(pa.list_(pa.int64()))] if with_ids else [])],
                            ["doc_id", "start", "n_tokens", "ids_crc32", "shard", "offset", *(["ids"] if with_ids else [])],
                        )

    spread = shards.repartition(max(1, min(shards.count(), 4 * common.shuffle_width(shards.sparkSession))), "shard")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int, offset long" + ", ids array<long>" * with_ids)


def fetch(uri: str, shard_path: str, offset: int) -> tuple[int | None, np.ndarray]:
    """One record by shard and byte offset, as a shuffled reader would."""
    from pyarrow import fs as pafs

    fs, _ = pafs.FileSystem.from_uri(uri)
    with fs.open_input_file(f"{shard_path}.rec") as f:
        size, crc = _HEAD.unpack(f.read_at(12, offset))
        if masked(struct.pack("<Q", size)) != crc:
            raise ValueError("record_length_corrupt")
        return unframe(f.read_at(16 + size, offset))[:2]
