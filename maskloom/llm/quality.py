"""Quality classifier (operator 3): random Fourier features of document statistics, ridge scores, isotonic calibration.

Statistics are made from the text alone, in one pass over Arrow batches.  A Gaussian kernel over the
standardised statistics is approximated by ``features`` random cosines; each partition sums its share of the
normal equations, and the driver adds up a fixed number of such sums, whatever the number of rows.  A fold of the
training rows that the ridge fit doesn't see calibrates its scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.llm import common
from maskloom.llm.fitting import isotonic, labelled
from maskloom.llm.words import ngram_hashes, slices, split_words, text_bytes

#: At most about so many labelled rows are fitted; the only bound, and only on training.
TRAINING_ROWS = 30_000
PARTS = 8

_CLASS = np.zeros(256, np.uint8)  # 0 letters and all bytes beyond ASCII
for _k, _set in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".", b",", b"!?", b"*#$%&@~^<>{}[]\\|/=+_", b"|", b"\"'():;-"), 1):
    _CLASS[list(_set)] = _k
_CLASSES = 11
NAMES = [*(f"share_{k}" for k in range(_CLASSES)), "beyond_ascii", "log_bytes", "log_words", "word_mean", "word_spread", "words_distinct", "grams_distinct", "same_as_before", "top_word", "starts_upper", "ends_odd", "line_words", "lines_distinct", "short_lines", "long_words"]


def _sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[first[1:]] - total[first[:-1]]


def _distinct(owner: np.ndarray, h: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes for each document, and how often its most frequent one occurs."""
    if not len(h):
        return np.zeros(docs), np.zeros(docs)
    order = np.lexsort((h, owner))
    o, v = owner[order], h[order]
    new = np.concatenate([[True], (o[1:] != o[:-1]) | (v[1:] != v[:-1])])
    at = np.flatnonzero(new)
    run = np.diff(np.concatenate([at, [len(o)]]))
    top = np.zeros(docs)
    np.maximum.at(top, o[at], run)
    return np.bincount(o[at], minlength=docs).astype(float), top


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of ``NAMES`` for each text; an empty text gives zeros."""
    data, offsets = text_bytes(texts)
    docs = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    kinds = _CLASS[data]
    out = [_sum(kinds == k, offsets) / np.maximum(size, 1) for k in range(_CLASSES)]
    out.append(_sum(data >= 128, offsets) / np.maximum(size, 1))
    w = split_words(texts, lower=False)
    n = w.counts.astype(float)
    some = np.maximum(n, 1)
    owner = np.repeat(np.arange(docs), w.counts)
    length = (w.end - w.start).astype(float)
    mean = _sum(length, w.first) / some
    spread = np.sqrt(np.maximum(0, _sum(length**2, w.first) / some - mean**2))
    distinct, top = _distinct(owner, w.hash, docs)
    g = ngram_hashes(w.hash, 3)
    inside = owner[: len(g)] == owner[2:] if len(g) else np.zeros(0, bool)
    grams, _ = _distinct(owner[: len(g)][inside], g[inside], docs)
    same = np.zeros(len(w.hash))
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (owner[1:] == owner[:-1])
    first, last = data[w.start], data[w.end - 1]
    lines = np.concatenate([[0], np.flatnonzero(data == 10) + 1, offsets]).astype(np.int64)
    lines = np.unique(lines[lines < max(1, len(data))])
    line_owner = np.searchsorted(offsets, lines, "right") - 1
    from_word = np.searchsorted(w.start, lines, "left")
    to_word = np.concatenate([from_word[1:], [len(w.start)]])
    line_len = to_word - from_word
    count = np.bincount(line_owner[line_owner < docs], minlength=docs)[:docs].astype(float)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w.hash * np.uint64(0x9E3779B97F4A7C15))])
    line_hash = total[to_word] - total[from_word]
    real = (line_len > 0) & (line_owner < docs)
    lines_distinct, _ = _distinct(line_owner[real], line_hash[real], docs)
    full = np.maximum(np.bincount(line_owner[real], minlength=docs)[:docs], 1)
    short = np.bincount(line_owner[real], weights=(line_len[real] <= 2).astype(float), minlength=docs)[:docs]
    out += [
        np.log1p(size), np.log1p(n), mean, spread, distinct / some, grams / np.maximum(n - 2, 1), _sum(same, w.first) / some, top / some,
        _sum((first >= 65) & (first <= 90), w.first) / some, _sum((_CLASS[last] == 8) | (_CLASS[last] == 7), w.first) / some,
        np.log1p(n / np.maximum(count, 1)), lines_distinct / full, short / full, _sum(length > 20, w.first) / some,
    ]
    return np.where(size[:, None] > 0, np.stack(out, 1), 0.0)


def document_statistics(docs: DataFrame, folds: int = 5) -> DataFrame:
    """doc_id, held_out, x (array of ``NAMES``) for each row; nulls in text count as empty, other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x = statistics(part.column(2))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], ["doc_id", "held_out", "x"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (common.fold("doc_id", folds) == 0).alias("held_out"), common.text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, x array<double>")


class Model:
    """Random cosines of standardised statistics, ridge weights, calibration."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, features: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, np.where(scale > 1e-9, scale, 1.0)
        # three kernel widths share the features
        width = np.repeat([0.5, 0.2, 0.08], -(-features // 3))[:features]
        self.w = rng.normal(size=(len(mean), features)) * width
        self.b = rng.uniform(0, 2 * np.pi, features)
        self.beta = np.zeros(features + len(mean) + 1)
        self.knots = (np.array([0.0]), np.array([0.5]))

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.concatenate([np.cos(z @ self.w + self.b) * (2 / self.w.shape[1]) ** 0.5, 0.1 * z, np.ones((len(z), 1))], 1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        r = self.raw(x)
        # the step function joined up, with a trace of the raw score so that ties keep their order
        return np.clip(0.998 * np.interp(r, *self.knots) + 0.002 / (1 + np.exp(-np.clip(8 * (r - 0.5), -30, 30))), 0, 1)


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, features: int = 384, ridge: float = 0.02, limit: int = TRAINING_ROWS) -> Model:
    """Fit on labelled rows of ``stats`` (see ``document_statistics``); without any label all scores are about 0.5."""
    train = common.materialise(labelled(stats, labels, label, folds, limit).select("doc_id", "x", "y", common.fold("doc_id", folds).alias("fold")).coalesce(PARTS), "training")
    size = len(NAMES)
    moments = train.agg(F.count("*"), *(f(F.get("x", F.lit(k))) for k in range(size) for f in (F.avg, F.stddev_pop))).first()
    if not moments[0]:
        return Model(np.zeros(size), np.ones(size), features)
    model = Model(np.array(moments[1::2], float), np.array(moments[2::2], float), features)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(model.beta)
        left, right, rows = np.zeros((n, n)), np.zeros(n), 0
        for batch in batches:
            z = model.features(batch.column("x").flatten().to_numpy().reshape(-1, size))
            left += z.T @ z
            right += z.T @ batch.column("y").to_numpy()
            rows += len(z)
        yield pa.RecordBatch.from_pydict({"left": [left.tobytes()], "right": [right.tobytes()], "n": [rows]}, pa.schema([("left", pa.binary()), ("right", pa.binary()), ("n", pa.int64())]))

    # at most PARTS sums of fixed size reach the driver
    parts = train.where(F.col("fold") != 4).coalesce(PARTS).mapInArrow(sums, "left binary, right binary, n long").collect()
    n = len(model.beta)
    left = sum(np.frombuffer(r["left"]).reshape(n, n) for r in parts)
    right, rows = sum(np.frombuffer(r["right"]) for r in parts), sum(r["n"] for r in parts)
    if rows:
        model.beta = np.linalg.solve(left + ridge * np.eye(n) * max(1.0, rows / 2000), right)
    held = train.where(F.col("fold") == 4).select("x", "y").toArrow()  # bounded by ``limit``
    if held.num_rows:
        x = held.column("x").combine_chunks().flatten().to_numpy().reshape(-1, size)
        model.knots = isotonic(model.raw(x), held.column("y").to_numpy())
    return model


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = 5, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every document.

    Labels are learned from folds other than 0 only.  Null texts score as empty ones; repeated rows get equal
    scores; null ids are scored like others; an empty table gives no rows.
    """
    stats = common.materialise(document_statistics(docs, folds), "statistics")
    model = fit(stats, labels, folds=folds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s = model.score(batch.column("x").flatten().to_numpy().reshape(-1, len(NAMES)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return stats.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
