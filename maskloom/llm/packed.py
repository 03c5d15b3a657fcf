"""Hashes of all documents dealt to hash buckets as packed vectors.

Each map task sends, for every few megabytes of text, one row per bucket: row ids, how many hashes each has
there, and the hashes.  A bucket sees every document's hashes that fall to it, so counts and minima over equal
hashes are exact, while Spark moves a few thousand rows of plain bytes instead of one row per word.  A row id is the
map partition and a counter; all that follows is derived from one written table, so ids are never made twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.llm import common
from maskloom.llm.words import SLICE_BYTES, ragged, slices

SENT = "bucket int, ids binary, owners binary, docs binary, counts binary, hashes binary, extra binary"
#: Bytes of text from which a task sends what it holds.
SEND_BYTES = 8 << 20


#: Bytes of text for which a hash bucket is made: what a bucket holds doesn't grow with the corpus.
BUCKET_BYTES = 8 << 20


def buckets_for(rows: DataFrame) -> int:
    """Buckets for the ``text`` of all rows, at least as many as there are shuffle partitions."""
    return max(common.shuffle_width(rows.sparkSession), (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BUCKET_BYTES)


def press(values: np.ndarray) -> bytes:
    """Numbers as bytes by significance, compressed: sorted or small ones take little room in a shuffle."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize)
    return zstandard.ZstdCompressor(level=1).compress(raw.T.tobytes())


def unpress(rows: pa.ChunkedArray | pa.Array, kind) -> np.ndarray:
    """The numbers of all rows one after another; null and empty rows hold none."""
    kind, tool = np.dtype(kind), zstandard.ZstdDecompressor()
    parts = [np.frombuffer(tool.decompress(x), np.uint8).reshape(kind.itemsize, -1).T.copy().view(kind).ravel() for x in rows.to_pylist() if x]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def deal(rows: DataFrame, buckets: int, make: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]], slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Rows of ``SENT`` from ``rows`` with doc_id and text, and perhaps key.

    ``make`` gives for a slice of rows: the row each hash belongs to, the hash, the number that is sent for it, and a
    second number or None.  They keep their order within a document and bucket.  With a ``key`` column its values stand for the
    rows and each run of a document carries the doc_id (null: the greatest number); else rows are counted, and each
    document is listed once, in the bucket of its row id: ``docs`` holds (row id, doc_id, is null, all hashes).
    """
    keyed = "key" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        held: list[tuple[np.ndarray, ...]] = []
        size = count = 0

        def send() -> Iterator[pa.RecordBatch]:
            owner = np.concatenate([x[0] for x in held])
            h = np.concatenate([x[1] for x in held])
            extra = None if held[0][2] is None else np.concatenate([x[2] for x in held])
            home = np.concatenate([x[3] for x in held])  # rows of (row id, doc_id, is null, hashes)
            value = np.concatenate([x[4] for x in held])
            to = bucket_of(h, buckets)
            order = np.argsort(to.astype(np.uint32), kind="stable")
            bounds = np.searchsorted(to[order], np.arange(buckets + 1))
            lives = (home[:, 0].view(np.uint64) % np.uint64(buckets)).astype(np.int64)
            columns: list[list] = [[], [], [], [], [], [], []]
            local = {} if not keyed else dict(zip(home[:, 0].tolist(), np.where(home[:, 2] == 1, 2**63 - 1, home[:, 1]).tolist(), strict=True))
            for b in range(buckets):
                at = order[bounds[b] : bounds[b + 1]]
                own = home[lives == b] if not keyed else home[:0]
                if not len(at) and not len(own):
                    continue
                o = owner[at]
                cut = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]])) if len(o) else np.zeros(0, np.int64)
                names_of = press(np.array([local[x] for x in o[cut].tolist()], "<i8")) if keyed else b""
                values = (b, press(o[cut].astype("<i8")), names_of, press(own.astype("<i8").ravel()), press(np.diff(np.concatenate([cut, [len(o)]])).astype("<i4")), press(value[at]), b"" if extra is None else press(extra[at]))
                for c, v in zip(columns, values, strict=True):
                    c.append(v)
            names = ["bucket", "ids", "owners", "docs", "counts", "hashes", "extra"]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names)

        for batch in batches:
            for part in slices(batch, "text", slice_bytes):
                owner, h, value, extra = make(part)
                n = part.num_rows
                ids = part.column("key").to_numpy() if keyed else base + count + np.arange(n)
                count += n
                doc = part.column("doc_id")
                home = np.stack([ids, doc.fill_null(0).to_numpy(), doc.is_null().to_numpy(zero_copy_only=False).astype(np.int64), np.bincount(owner, minlength=n)], 1)
                held.append((ids[owner] if len(owner) else np.zeros(0, np.int64), h, extra, home, value))
                size += part.column("text").nbytes
                if size >= SEND_BYTES:
                    yield from send()
                    held, size = [], 0
        if held:
            yield from send()

    return rows.mapInArrow(run, SENT)


class Bucket:
    """What one bucket got: for each hash its row id, and the documents at home here."""

    def __init__(self, table: pa.Table, value: str, extra: str = "<u1"):
        def joined(name: str, kind) -> np.ndarray:
            return unpress(table.column(name), kind)

        self.ids, counts = joined("ids", "<i8"), joined("counts", "<i4")
        self.run = np.repeat(np.arange(len(self.ids), dtype=np.int32), counts)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        owners = joined("owners", "<i8")
        self.owners = owners if len(owners) else self.ids
        self.hash = joined("hashes", value)
        self.extra = joined("extra", extra)
        self.docs = joined("docs", "<i8").reshape(-1, 4)


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return (h >> np.uint64(40)).astype(np.int64) % buckets


def lists(values: np.ndarray, run: np.ndarray, runs: int, kind: pa.DataType) -> pa.Array:
    """Values grouped by ascending run number, as a list array with a list for each run."""
    bounds = np.searchsorted(run, np.arange(runs + 1))
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, kind))


HOMED = "home int, keys binary, owners binary, counts binary, buckets binary, values binary"


def homed(b: Bucket, at: np.ndarray, values: np.ndarray, bucket: int, homes: int) -> pa.Table:
    """Marked entries of a bucket on their way back, one row per home of their documents' keys: a few plain bytes for each."""
    runs, run = np.unique(b.run[at], return_inverse=True)
    home = (b.ids[runs].view(np.uint64) % np.uint64(homes)).astype(np.int64)
    order = np.argsort(home, kind="stable")
    counts = np.bincount(run, minlength=len(runs))
    first = np.cumsum(counts) - counts
    bounds = np.searchsorted(home[order], np.arange(homes + 1))
    columns: list[list] = [[], [], [], [], [], []]
    for h in range(homes):
        own = order[bounds[h] : bounds[h + 1]]
        if len(own):
            got = values[ragged(first[own], counts[own])].astype("<i4")
            row = (h, press(b.ids[runs[own]].astype("<i8")), press(b.owners[runs[own]].astype("<i8")), press(counts[own].astype("<i4")), press(np.full(len(own), bucket, "<i4")), press(got))
            for c, v in zip(columns, row, strict=True):
                c.append(v)
    return pa.table([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], ["home", "keys", "owners", "counts", "buckets", "values"])


def come_home(table: pa.Table) -> pa.Table:
    """One row per document of a home: key, owner, and its entries' buckets and values in order, each once.

    Rows that are repeated as they are have the same key and the same entries.
    """
    joined = lambda name, kind: unpress(table.column(name), kind)
    counts = joined("counts", "<i4")
    key, owner, bucket = (np.repeat(joined(c, k), counts) for c, k in (("keys", "<i8"), ("owners", "<i8"), ("buckets", "<i4")))
    value = joined("values", "<i4")
    order = np.lexsort((value, bucket, owner, key))
    key, owner, bucket, value = key[order], owner[order], bucket[order], value[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    once = new.copy()
    once[1:] |= (bucket[1:] != bucket[:-1]) | (value[1:] != value[:-1])
    run = (np.cumsum(new) - 1)[once]
    n, first = int(new.sum()), np.flatnonzero(new)
    return pa.table({"key": pa.array(key[first]), "owner": pa.array(owner[first]), "bucket": lists(bucket[once], run, n, pa.int32()), "at": lists(value[once], run, n, pa.int32())})


ANSWERED = "home int, keys binary, sizes binary, answers binary, docs binary"


def answered(b: Bucket, sizes: np.ndarray, values: list[np.ndarray], bucket: int, homes: int) -> pa.Table:
    """Numbers for each run of a bucket, ``sizes`` of them, on the way to the homes of the runs' rows; documents at home here go along.

    A home gets one row from a bucket: the runs' rows, how many numbers each has, and the numbers, first all of the
    first array, then of the next.
    """
    home = (b.ids.view(np.uint64) % np.uint64(homes)).astype(np.int64)
    order = np.argsort(home, kind="stable")
    bounds = np.searchsorted(home[order], np.arange(homes + 1))
    first = np.cumsum(sizes) - sizes
    columns: list[list] = [[], [], [], [], []]
    for h in range(homes):
        own = order[bounds[h] : bounds[h + 1]]
        docs = h == bucket and len(b.docs)
        if len(own) or docs:
            at = ragged(first[own], sizes[own])
            row = (h, press(b.ids[own].astype("<i8")), press(sizes[own].astype("<u4")), press(np.concatenate([v[at] for v in values])), press(b.docs.astype("<i8").ravel()) if docs else None)
            for c, v in zip(columns, row, strict=True):
                c.append(v)
    return pa.table([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], ["home", "keys", "sizes", "answers", "docs"])


@dataclass
class Home:
    """What one home got: its documents by ascending row id, and the place among them and the numbers of each answer."""

    rows: np.ndarray
    doc_ids: pa.Array
    n: np.ndarray
    place: np.ndarray
    values: list[np.ndarray]

    @classmethod
    def of(cls, table: pa.Table, kind, arrays: int = 1) -> Home:
        keys, sizes, docs = unpress(table.column("keys"), "<i8"), unpress(table.column("sizes"), "<u4").astype(np.int64), unpress(table.column("docs"), "<i8").reshape(-1, 4)
        docs = docs[np.argsort(docs[:, 0])]
        parts = [unpress(table.column("answers").slice(i, 1), kind).reshape(arrays, -1) for i in range(table.num_rows)]
        values = np.concatenate([*parts, np.zeros((arrays, 0), kind)], 1)
        place = np.searchsorted(docs[:, 0], np.repeat(keys, sizes))
        return cls(docs[:, 0], pa.array(docs[:, 1], mask=docs[:, 2] == 1), docs[:, 3], place, list(values))

    def sums(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.place, weights=values, minlength=len(self.rows))
