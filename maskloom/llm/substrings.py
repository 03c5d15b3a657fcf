"""Substring dedup (operator 7): fixed-block anchors.

Every document is cut into non-overlapping blocks of ``ANCHOR`` words, the reference index.  A window of 13 words
holds at least one whole block of 7, wherever it starts, so any repeated window has an anchor: a block of one
document that a rolling block of another equals.

1. All rolling blocks (the probes, some of them index blocks) are dealt to hash buckets as 32-bit values; a
   bucket marks probes that an index block of a smaller doc_id equals, and index blocks that a probe of a greater one equals.
2. Marked positions are extended to all windows that cover them; only these windows are dealt again, by their
   full 64-bit hash and position, and each bucket takes the least doc_id of each.
3. Windows that a smaller doc_id has are runs of starts; their union in each document are the maximal exact
   repeats, and the words they cover are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.llm import common, packed
from maskloom.llm.words import Words, ngram_hashes, ragged, slices, split_words


def _rolling(w: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, position in the document and hash of each run of ``size`` words."""
    owner = np.repeat(np.arange(len(w.counts)), w.counts)
    g = ngram_hashes(w.hash, size)
    at = np.flatnonzero(owner[: len(g)] == owner[size - 1 :][: len(g)]) if len(g) else np.zeros(0, np.int64)
    return owner[at], at - w.first[owner[at]], g[at]


def _spread(starts: np.ndarray, before: int, after: int, n: int) -> np.ndarray:
    """Mask over n positions of those from start - before to start + after."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, np.clip(starts - before, 0, n), 1)
    np.add.at(change, np.clip(starts + after + 1, 0, n), -1)
    return np.cumsum(change[:n]) > 0


def repeated_windows(docs: DataFrame, window: int = 13) -> DataFrame:
    """key, doc_id, starts (window starts that a smaller doc_id has) for documents that have any.

    ``docs`` has doc_id (long), key (long) and text without nulls.
    """
    anchor = (window + 1) // 2
    buckets = common.shuffle_width(docs.sparkSession)

    def probes(part: pa.RecordBatch):
        owner, pos, h = _rolling(split_words(part.column("text"), False), anchor)
        return owner, h, ((h & np.uint64(0xFFFFFFFE)).astype("<u4") | (pos % anchor == 0).astype("<u4")), None

    def anchors(table: pa.Table) -> pa.Table:
        b = packed.Bucket(table, "<u4")
        value, index = b.hash >> 1, (b.hash & 1).astype(bool)
        owner = b.owners[b.run]
        order = np.argsort(value, kind="stable")
        v = value[order]
        new = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if len(v) else np.zeros(0, np.int64)
        marked = np.zeros(len(v), bool)
        if len(v):
            times = np.diff(np.concatenate([new, [len(v)]]))
            least = np.repeat(np.minimum.reduceat(np.where(index, owner, 2**63 - 1)[order], new), times)
            most = np.repeat(np.maximum.reduceat(owner[order], new), times)
            marked[order] = (least < owner[order]) | (index[order] & (most > owner[order]))
        at = np.flatnonzero(marked)
        return packed.homed(b, at, at - b.first[b.run[at]], int(table.column("bucket")[0].as_py()), buckets)

    home = "key long, owner long, bucket array<int>, at array<int>"
    found = packed.deal(docs, buckets, probes).groupBy("bucket").applyInArrow(anchors, packed.HOMED)
    hits = common.materialise(found.groupBy("home").applyInArrow(packed.come_home, home), "anchors")
    with_hits = docs.join(hits, (docs["key"] == hits["key"]) & (F.coalesce(docs["doc_id"], F.lit(2**63 - 1)) == hits["owner"])).select(docs["doc_id"], docs["key"], "text", "bucket", "at")

    def windows(part: pa.RecordBatch):
        w = split_words(part.column("text"), False)
        owner, pos, h = _rolling(w, anchor)
        first = np.searchsorted(owner, np.arange(part.num_rows + 1))
        g = ngram_hashes(w.hash, window)
        owners, hashes, starts = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, "<i4")]
        bucket_lists, at_lists = part.column("bucket"), part.column("at")
        for i in range(part.num_rows):
            n = int(w.counts[i]) - window + 1
            if n <= 0:
                continue
            to = packed.bucket_of(h[first[i] : first[i + 1]], buckets)
            order = np.argsort(to, kind="stable")
            begin = np.searchsorted(to[order], np.arange(buckets))
            anchors_at = order[begin[bucket_lists[i].values.to_numpy()] + at_lists[i].values.to_numpy()]
            own = np.flatnonzero(_spread(anchors_at, window - anchor, 0, n))
            owners.append(np.full(len(own), i))
            hashes.append(g[w.first[i] + own])
            starts.append(own.astype("<i4"))
        h = np.concatenate(hashes)
        return np.concatenate(owners), h, h.astype("<u8"), np.concatenate(starts)

    def minima(table: pa.Table) -> pa.Table:
        b = packed.Bucket(table, "<u8", "<i4")
        owner = b.owners[b.run]
        order = np.argsort(b.hash, kind="stable")
        v = b.hash[order]
        marked = np.zeros(len(v), bool)
        if len(v):
            new = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
            least = np.repeat(np.minimum.reduceat(owner[order], new), np.diff(np.concatenate([new, [len(v)]])))
            marked[order] = least < owner[order]
        at = np.flatnonzero(marked)
        return packed.homed(b, at, b.extra[at], 0, buckets)

    again = packed.deal(with_hits, buckets, windows).groupBy("bucket").applyInArrow(minima, packed.HOMED)
    out = common.materialise(again.groupBy("home").applyInArrow(packed.come_home, home), "repeats")
    common.release(docs.sparkSession)
    return out.select("key", "owner", F.col("at").alias("starts"))


def dedup_substrings(docs: DataFrame, window: int = 13, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256[, kept, removed] for every row.

    Words are runs of bytes other than space and 0x09-0x0D, unchanged.  A word goes if a window of ``window``
    words that covers it also starts in a document with a smaller doc_id, judged on the input.  ``kept`` is the
    text left, one space between words; ``removed`` lists the maximal removed spans (first word, words).  Null and empty
    texts have no words; a null doc_id counts as greater than any other; rows with equal doc_id don't remove each other's words;
    other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text"))
    rows = rows.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text")
    found = repeated_windows(rows, window)
    owner = F.coalesce(rows["doc_id"], F.lit(2**63 - 1))
    joined = rows.join(found, (rows["key"] == found["key"]) & (owner == found["owner"]), "left").select(rows["doc_id"], "text", "starts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                w = split_words(part.column(1), False)
                gone = np.zeros(len(w.start), bool)
                lists = part.column(2)
                for i in np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False)).tolist():
                    starts = lists[i].values.to_numpy()
                    gone[w.first[i] : w.first[i + 1]] = _spread(starts, 0, window - 1, int(w.counts[i]))
                kept = np.flatnonzero(~gone)
                size = w.end[kept] - w.start[kept] + 1
                text = np.concatenate([w.data, [np.uint8(32)]])[np.minimum(ragged(w.start[kept], size), len(w.data))]
                stop = np.cumsum(size)
                text[stop - 1] = 32
                bounds = np.concatenate([[0], stop])[np.searchsorted(kept, w.first)]
                raw, out, spans = text.tobytes(), [], []
                total = np.concatenate([[0], np.cumsum(gone)])
                removed = total[w.first[1:]] - total[w.first[:-1]]
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    out.append(raw[a : max(a, b - 1)])
                digests = [hashlib.sha256(x).hexdigest() for x in out]
                columns = [part.column(0), pa.array(w.counts.astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(digests)]
                names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
                if with_text:
                    for i in range(part.num_rows):
                        own = gone[w.first[i] : w.first[i + 1]].astype(np.int8)
                        edge = np.flatnonzero(np.diff(np.concatenate([[0], own, [0]])))
                        spans.append([{"first": int(a), "words": int(b - a)} for a, b in zip(edge[::2], edge[1::2], strict=True)])
                    columns += [pa.array([x.decode("utf-8", "replace") for x in out]), pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())])))]
                    names += ["kept", "removed"]
                yield pa.RecordBatch.from_arrays(columns, names)

    extra = ", kept string, removed array<struct<first:long,words:long>>" if with_text else ""
    return joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string" + extra)
