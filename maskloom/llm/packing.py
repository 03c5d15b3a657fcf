"""Best-fit packing (operator 8): patterns of few lengths, fitted to the length histogram by non-negative least squares.

A plan depends on the histogram of piece lengths alone, which has at most ``capacity`` bins, so it is made on
the driver whatever the corpus size.  Full pieces are sequences of their own.  For the rest, patterns of two to
four lengths that fill a sequence exactly (or nearly) are enumerated, repeat counts are fitted so that the
patterns use up the histogram, rounded down, and taken; what remains is packed by best fit, and whole runs of
equal bins are placed at once.  Pieces of one length are interchangeable: each gets a rank among its length, and
the plan maps rank ranges to sequences.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskloom.llm import common
from maskloom.llm.bpe import ENCODE_BYTES, encoder
from maskloom.llm.words import slices


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 300) -> np.ndarray:
    """min |a x - b| with x >= 0, by accelerated projected gradient steps; columns are scaled by ``b``'s size."""
    x = y = np.zeros(a.shape[1])
    gram, right = a.T @ a, a.T @ b
    v = np.ones(len(gram)) / max(1, len(gram)) ** 0.5
    for _ in range(30):
        v = gram @ v
        v /= max(np.linalg.norm(v), 1e-300)
    step, t = 1 / max(v @ gram @ v * 1.02, 1e-300), 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * (gram @ y - right))
        grown = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / grown * (new - x), new, grown
    return x


def enumerate_patterns(counts: np.ndarray, capacity: int, most: int = 1500) -> list[tuple[int, ...]]:
    """Patterns of two to four lengths with sum ``capacity`` (or the fullest there is), long lengths first.

    For each length: its complement, and for a spread of second lengths the third that fills the rest, or the
    third and fourth.  ``most`` bounds the number; lengths with more pieces come first.
    """
    there = [int(x) for x in np.flatnonzero(counts)]
    if not there:
        return []
    found: dict[tuple[int, ...], None] = {}

    def best(room: int) -> int:
        k = bisect.bisect_right(there, room)
        return there[k - 1] if k else 0

    by_count = sorted(there, key=lambda x: (-int(counts[x]), x))
    for a in by_count:
        if b := best(capacity - a):
            found[tuple(sorted((a, b), reverse=True))] = None
    for a in by_count:
        if len(found) >= most:
            break
        for share in (0.5, 0.3, 0.7):
            if b := best(int((capacity - a) * share)):
                if c := best(capacity - a - b):
                    found[tuple(sorted((a, b, c), reverse=True))] = None
                    if d := best(capacity - a - b - c):
                        found[tuple(sorted((a, b, c, d), reverse=True))] = None
    return list(found)[:most]


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Segments (length, first rank, ranks, first sequence, offset) and the number of sequences.

    Ranks [r, r + n) of a length go to sequences [s, s + n) at the same offset.  Every rank is covered once.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        if not 0 < length <= capacity:
            raise ValueError("length_outside_capacity")
        left[length] += n
    used = np.zeros(capacity + 1, np.int64)
    segments: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def place(pattern: tuple[int, ...], times: int) -> None:
        nonlocal sequences
        at = 0
        for length in pattern:
            segments.append((length, int(used[length]), times, sequences, at))
            used[length] += times
            left[length] -= times
            at += length
        sequences += times

    if left[capacity]:
        place((capacity,), int(left[capacity]))
    patterns = [p for p in enumerate_patterns(left, capacity) if sum(p) >= 0.995 * capacity]
    if patterns:
        rows = np.flatnonzero(left)
        where = {int(x): i for i, x in enumerate(rows)}
        a = np.zeros((len(rows), len(patterns)))
        for j, p in enumerate(patterns):
            for length, n in Counter(p).items():
                a[where[length], j] = n
        repeats = nnls(a, left[rows].astype(float))
        for j in np.argsort(-repeats, kind="stable"):
            p = patterns[int(j)]
            times = min(int(repeats[j]), *(int(left[x]) // n for x, n in Counter(p).items()))
            if times > 0:
                place(p, times)
    # best fit of the rest, longest first; equal patterns are placed many at a time
    while (there := np.flatnonzero(left)).size:
        lengths = there.tolist()
        need: Counter[int] = Counter()
        room, pattern = capacity, []
        while True:
            k = bisect.bisect_right(lengths, room) - 1
            while k >= 0 and need[lengths[k]] >= left[lengths[k]]:
                k -= 1
            if k < 0:
                break
            length = lengths[k]
            if pattern and room != length:  # two lengths that fill the room exactly beat the longest that fits
                for x in reversed(lengths[: k + 1]):
                    if 2 * x < room:
                        break
                    y = room - x
                    if left[x] - need[x] >= 1 + (x == y) and y > 0 and left[y] - need[y] >= 1 + (x == y):
                        length = x
                        break
            pattern.append(length)
            need[length] += 1
            room -= length
        place(tuple(pattern), max(1, min(int(left[x]) // n for x, n in need.items())))
    return segments, sequences


def encode_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, with_ids: bool) -> DataFrame:
    """Pieces of each document: doc_id, piece, start, length, ids_crc32, task, nth (of its length in the task)[, ids]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        encode = encoder(tokenizer).encode
        seen = [0] * (capacity + 1)
        for batch in batches:
            for part in slices(batch, "text", ENCODE_BYTES):
                ids, counts = encode(part.column(1))
                rows, at = [], 0
                for doc_id, n in zip(part.column(0).to_pylist(), counts.tolist(), strict=True):
                    own = np.append(ids[at : at + n], np.uint32(end_id)).astype("<u4")
                    at += n
                    begin, piece = 0, 0
                    cut = len(own) % capacity or capacity  # the first piece is the shorter one
                    while begin < len(own):
                        got = own[begin : begin + cut]
                        rows.append((doc_id, piece, begin, len(got), zlib.crc32(got.tobytes()), task, seen[len(got)], got))
                        seen[len(got)] += 1
                        begin, piece, cut = begin + cut, piece + 1, capacity
                c = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                arrays = [pa.array(x, k) for x, k in zip(c[:7], kinds, strict=True)]
                if with_ids:
                    arrays.append(pa.array(c[7], pa.list_(pa.uint32())).cast(pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth", *(["ids"] if with_ids else [])])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long" + ", ids array<int>" * with_ids)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024, with_ids: bool = False) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` ids.

    Returns one row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids on request).
    Null texts are empty and give the end id alone; null and repeated doc_ids are packed like any other row;
    other columns are ignored; an empty table gives no rows.  Only documents longer than ``capacity`` are cut.
    """
    spark = docs.sparkSession
    # written once: a piece's rank rests on the task that made it
    pieces = common.materialise(encode_pieces(docs, tokenizer, end_id, capacity, with_ids), "pieces")
    by_task = common.materialise(pieces.groupBy("length", "task").agg(F.count("*").alias("n")), "lengths")
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # at most ``capacity`` rows
    histogram = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    segments, _ = plan(histogram, capacity)
    grouped: dict[int, list] = {}
    for x, r, _, s, at in segments:
        grouped.setdefault(x, []).append((r, s, at))
    table = {x: tuple(np.array(c, np.int64) for c in zip(*sorted(v), strict=True)) for x, v in grouped.items()}

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("nth").to_numpy() + batch.column("base").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length).tolist():
                rows = np.flatnonzero(length == x)
                first, seq, at = table[x]
                k = np.searchsorted(first, rank[rows], "right") - 1
                sequence[rows] = seq[k] + rank[rows] - first[k]
                offset[rows] = at[k]
            keep = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sequence), pa.array(offset), *([batch.column("ids")] if with_ids else [])], [*keep, "sequence_id", "offset", *(["ids"] if with_ids else [])])

    return pieces.join(bases, ["length", "task"]).mapInArrow(assign, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids array<int>" * with_ids)
