"""Benchmark decontamination (operator 6): CGK embedding, bit-sampling LSH, exact edit verification.

A document holds an item of n words if some run of its words is within k = min(n // 5, (n - 3) // 4) word edits of it.
With so few edits three words in a row of the item stay whole, so windows of the item's size are laid only where a
document shares three words with some item.  Each window is embedded by the CGK random walk: it emits the word it stands
on at each of 2n steps and moves on or stays by a random bit of (step, word), so few edits change few outputs.  In
each of ``repeats`` rounds a few sampled outputs make a key, and windows whose key equals that of an item of the same size are
candidates.  Candidates are verified by the exact edit distance of the item to the best run within the window
and its margins.

Items are a query set of bounded blocks; a document is read whole and only its hits leave the task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.llm import common
from maskloom.llm.words import mix, ngram_hashes, slices, split_words

SEED_WORDS = 3
#: Words of the items that one pass over the documents looks for.
BLOCK_WORDS = 200_000
_END = np.uint64(0x5851F42D4C957F2D)


def allowed(n: int) -> int:
    """Word edits allowed for an item of n words; -1 if it is too short to be looked for."""
    return -1 if n < SEED_WORDS else min(n // 5, (n - SEED_WORDS) // (SEED_WORDS + 1))


def sampled(size: int, rounds: int, bits: int) -> np.ndarray:
    """The steps sampled in each round for items of a size."""
    return np.sort(np.random.default_rng([size, 71]).integers(0, max(1, 2 * size), (rounds, bits)), 1)


def keys(words: np.ndarray, size: int, rounds: int, bits: int) -> np.ndarray:
    """LSH keys (windows x rounds) of windows given as rows of word hashes; rows end with ``_END``.

    The walks of all rounds go on side by side; the random bit of (round, step, word) is the top bit of the word's hash
    times an odd number of the round and step.
    """
    n = len(words)
    steps = sampled(size, rounds, bits)
    last = int(steps[:, -1].max())
    odd = np.random.default_rng([size, 72]).integers(0, 2**63, (last + 1, rounds), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    at = np.repeat(np.arange(n)[:, None] * words.shape[1], rounds, 1)
    flat, end = words.ravel(), at + words.shape[1] - 1
    out = np.tile(np.uint64(size * 1000) + np.arange(rounds, dtype=np.uint64), (n, 1))
    for j in range(last + 1):
        w = flat[at]
        own = np.flatnonzero((steps == j).any(1))
        if len(own):
            out[:, own] = mix(out[:, own] * np.uint64(0x9E3779B97F4A7C15) + w[:, own])
        at += ((w * odd[j]) >> np.uint64(63)).astype(np.int64)
        np.minimum(at, end, out=at)
    return out


@dataclass
class Items:
    """A block of items with their seeds and LSH tables."""

    ids: list[int]
    words: list[np.ndarray]
    rounds: int
    bits: int

    def __post_init__(self) -> None:
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.edits = np.array([allowed(int(n)) for n in self.size], np.int64)
        g = [ngram_hashes(w, SEED_WORDS) if k >= 0 else np.zeros(0, np.uint64) for w, k in zip(self.words, self.edits, strict=True)]
        seeds = np.concatenate([*g, np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(g)), [len(x) for x in g])
        offset = np.concatenate([*(np.arange(len(x)) for x in g), np.zeros(0, np.int64)]).astype(np.int64)
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.seed_item, self.seed_offset = seeds[order], item[order], offset[order]
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.seeds >> np.uint64(44)).astype(np.int64)] = True
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in np.unique(self.size[self.edits >= 0]).tolist():
            at = np.flatnonzero((self.size == n) & (self.edits >= 0))
            k = keys(np.stack([np.append(self.words[i], _END) for i in at]), n, self.rounds, self.bits)
            flat, who = k.ravel(), np.repeat(at, self.rounds)
            order = np.argsort(flat, kind="stable")
            self.tables[n] = flat[order], who[order]

    def _windows(self, h: np.ndarray, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Rows (document, size, start) of windows laid at shared seeds, each once."""
        g = ngram_hashes(h, SEED_WORDS)
        owner = np.repeat(np.arange(len(counts)), counts)
        at = np.flatnonzero(self.filter[(g >> np.uint64(44)).astype(np.int64)])
        at = at[owner[at] == owner[at + SEED_WORDS - 1]]
        lo, hi = np.searchsorted(self.seeds, g[at], "left"), np.searchsorted(self.seeds, g[at], "right")
        n = hi - lo
        where = np.repeat(at, n)
        k = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        doc = owner[where]
        start = np.maximum(0, where - first[doc] - self.seed_offset[k])
        return np.unique(np.stack([doc, self.size[self.seed_item[k]], start], 1), axis=0)

    def find(self, h: np.ndarray, first: np.ndarray, counts: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(document, item, first word, words, edits) of the best match of each item in each document."""
        if not len(self.seeds) or not len(h):
            return []
        windows = self._windows(h, first, counts)
        pairs: list[np.ndarray] = []
        for n in np.unique(windows[:, 1]).tolist():
            at = windows[windows[:, 1] == n]
            table, who = self.tables[n]
            for lo in range(0, len(at), 4_000):
                part = at[lo : lo + 4_000]
                pos = part[:, 2][:, None] + np.arange(n + 1)
                inside = (pos < counts[part[:, 0]][:, None]) & (np.arange(n + 1) < n)
                words = np.where(inside, h[np.minimum(first[part[:, 0]][:, None] + pos, len(h) - 1)], _END)
                k = keys(words, n, self.rounds, self.bits)
                a, b = np.searchsorted(table, k.ravel(), "left"), np.searchsorted(table, k.ravel(), "right")
                m = b - a
                row = np.repeat(np.repeat(np.arange(len(part)), self.rounds), m)
                item = who[np.repeat(a - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))]
                pairs.append(np.unique(np.stack([part[row, 0], item, part[row, 2]], 1), axis=0))
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for doc, item, start in np.concatenate(pairs).tolist() if pairs else []:
            k = int(self.edits[item])
            if (doc, item) in best and best[doc, item][0] == 0:
                continue
            a = max(0, start - k)
            b = min(int(counts[doc]), start + int(self.size[item]) + k)
            got = edit_match(self.words[item], h[first[doc] + a : first[doc] + b])
            if got[0] <= k and ((doc, item) not in best or (got[0], a + got[1]) < best[doc, item][:2]):
                best[doc, item] = got[0], a + got[1], got[2]
        return [(d, i, s, n, e) for (d, i), (e, s, n) in sorted(best.items())]


def edit_match(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Least edit distance of the item to a run of the text, and that run's first word and length."""
    n, m = len(item), len(text)
    step = np.arange(m + 1)
    row, begin = np.zeros(m + 1, np.int64), np.arange(m + 1)
    for i in range(n):
        new = row + 1  # the item's word is missing in the text
        source = begin.copy()
        diagonal = row[:-1] + (text != item[i])
        better = diagonal <= new[1:]
        new[1:] = np.where(better, diagonal, new[1:])
        source[1:] = np.where(better, begin[:-1], source[1:])
        # words only in the text: the least of what stands before, one more for each word
        level = new - step
        low = np.minimum.accumulate(level)
        at = np.maximum.accumulate(np.where(level == low, step, 0))
        row, begin = low + step, source[at]
    end = int(np.argmin(row))
    return int(row[end]), int(begin[end]), end - int(begin[end])


def item_blocks(benchmark: DataFrame, rounds: int, bits: int) -> Iterator[Items]:
    """The items in blocks of at most ``BLOCK_WORDS`` words (or one item), read one after another."""
    ids: list[int] = []
    words: list[np.ndarray] = []
    held = 0
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), common.text_of().alias("text")).where(F.col("item_id").isNotNull())
    for r in rows.orderBy("item_id").toLocalIterator():
        h = split_words(pa.array([r["text"]]), True).hash
        if held and held + len(h) > BLOCK_WORDS:
            yield Items(ids, words, rounds, bits)
            ids, words, held = [], [], 0
        ids.append(r["item_id"])
        words.append(h)
        held += len(h)
    if ids:
        yield Items(ids, words, rounds, bits)


def find_contamination(docs: DataFrame, benchmark: DataFrame, rounds: int = 16, bits: int = 2) -> DataFrame:
    """doc_id, item_id, first_word, n_words, edits: the best match of each item in each document that holds it.

    Words are lower-cased for A-Z.  Null and empty texts hold nothing; items without an id or of fewer than three words
    aren't looked for; repeated documents and items each give rows of their own; other columns are
    ignored; an empty table on either side gives no rows.
    """
    schema = "doc_id long, item_id long, first_word int, n_words int, edits int"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text"))
    out = None
    for items in item_blocks(benchmark, rounds, bits):

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text"):
                    w = split_words(part.column(1), True)
                    found = items.find(w.hash, w.first, w.counts)
                    if found:
                        c = list(zip(*found, strict=True))
                        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(c[0])), pa.array([items.ids[i] for i in c[1]], pa.int64()), *(pa.array(x, pa.int32()) for x in c[2:])], ["doc_id", "item_id", "first_word", "n_words", "edits"])

        own = rows.mapInArrow(run, schema)
        out = own if out is None else out.unionByName(own)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rounds: int = 16, bits: int = 2) -> DataFrame:
    """The documents that hold no item, with their own columns."""
    out = docs
    for items in item_blocks(benchmark, rounds, bits):

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text"):
                    w = split_words(part.column(part.schema.get_field_index("text")), True)
                    keep = np.ones(part.num_rows, bool)
                    keep[[x[0] for x in items.find(w.hash, w.first, w.counts)]] = False
                    yield part.filter(pa.array(keep))

        out = out.mapInArrow(run, docs.schema)
    return out
