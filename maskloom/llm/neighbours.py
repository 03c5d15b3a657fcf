"""Embedding near-dedup (operator 10): sorted projection passes.

Equal unit vectors are first folded into one row with a count.  In each pass every vector gets the signs of
random projections, concatenated to a key; rows are ordered by (label, key) across the cluster and each is
compared, in double precision, with its next neighbours in a bounded window.  Windows run over stretches of the
whole order with the rows around them, so that partitions, however small, bound nothing.  The number of passes follows from the number of rows so that a pair
at the threshold is met with the wanted probability.  The keys of all passes are made in one reading of the vectors.

How many leading signs leave a window of rows is read off the keys of each pass; a vector whose passes, so measured, don't
reach the wanted probability (those of a label that lie close together) may have links no pass showed.  A vector whose
window was full of links has more near neighbours than a window can show.  All such vectors are taken as a query set and compared with all rows of their label in blocks, which counts their links exactly and
gives a spanning forest of them, so that no window bounds a group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.llm import common
from maskloom.llm.components import components

BITS = 48
BLOCK = 1024


def passes_for(rows: int, threshold: float, window: int, recall: float) -> int:
    """Passes after which a pair at the threshold was neighbours in some pass with probability ``recall``.

    Two vectors at angle t agree in a sign with probability 1 - t/pi; they fall within a window if they agree in
    as many leading signs as leave about half a window of the rows.
    """
    agree = 1 - math.acos(min(1.0, threshold)) / math.pi
    leading = max(1.0, math.log2(max(2, rows) / max(1, window / 2)))
    return max(4, math.ceil(math.log(1 - recall) / math.log(1 - agree**leading)))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, size) if len(column) else np.zeros((0, size))


class Forest:
    """Union-find over row numbers."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.parent[max(x, y)] = min(x, y)
        return True


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, label, unit (bytes of the unit vector in double precision, null if it can't link)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, label in zip(batch.column("embedding").to_pylist(), batch.column("label").to_pylist(), strict=True):
                v = None
                if x and label is not None and None not in x:
                    a = np.array(x, np.float64)
                    if np.isfinite(a).all() and (top := np.abs(a).max()) > 0:
                        a = a / top  # so that squares neither vanish nor overflow
                        v = ((a / np.sqrt((a * a).sum())) + 0.0).tobytes()
                out.append(v)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(out, pa.binary())], ["vec_id", "label", "unit"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(run, "vec_id long, label string, unit binary")


def _window_pairs(x: np.ndarray, window: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Linked pairs at distance up to ``window`` in order, and for each row its links on either side."""
    left, right, links = [], [], np.zeros(len(x), np.int64)
    for d in range(1, min(window, len(x) - 1) + 1):
        hit = np.flatnonzero(np.einsum("ij,ij->i", x[:-d], x[d:]) >= threshold)
        left.append(hit)
        right.append(hit + d)
        links[hit] += 1
        links[hit + d] += 1
    none = np.zeros(0, np.int64)
    return (np.concatenate(left) if left else none), (np.concatenate(right) if right else none), links


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, window: int = 48, recall: float = 0.999, seed: int = 3) -> DataFrame:
    """vec_id, n_links, component_id, kept, one row per vector.

    Links are pairs of equal, non-null label with cosine of at least ``threshold`` in double precision.  Vectors
    that are null, empty, zero, or hold null or non-finite components link with nothing; vectors of unequal
    length never link; repeated rows link with each other; other columns are ignored; an empty table gives none.
    A null vec_id is a row of its own without links.
    """
    spark = vectors.sparkSession
    rows = common.materialise(unit_vectors(vectors), "units")
    good = rows.where(F.col("unit").isNotNull() & F.col("vec_id").isNotNull())
    # a vector's group also holds its length; copies are folded map-side
    group = F.concat_ws("/", F.length("unit").cast("string"), F.col("label"))
    folded = common.materialise(good.groupBy(group.alias("grp"), "unit").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")).withColumn("mark", F.xxhash64("unit")), "folded")
    total = folded.count()
    if not total:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    width = common.shuffle_width(spark)

    def hasher(numbers: range):
        """The keys of several passes, so that each pass reads ids and one column of keys but no vectors."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            planes: dict[tuple[int, int], np.ndarray] = {}
            places = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
            for batch in batches:
                units = batch.column("unit").to_pylist()
                keys = np.zeros((len(numbers), len(units)), np.int64)
                size = np.array([len(u) // 8 for u in units])
                for n in np.unique(size).tolist():
                    at = np.flatnonzero(size == n)
                    x = np.frombuffer(b"".join(units[i] for i in at), "<f8").reshape(-1, n)
                    for k, number in enumerate(numbers):
                        if (number, n) not in planes:
                            planes[number, n] = np.random.default_rng([seed, number, n]).normal(size=(n, BITS))
                        keys[k, at] = ((x @ planes[number, n]) > 0) @ places
                yield pa.RecordBatch.from_arrays([batch.column("grp"), batch.column("rep"), batch.column("mark"), *map(pa.array, keys)], ["grp", "rep", "mark", *(f"key{x}" for x in numbers)])

        return run

    def hashed(numbers: range) -> DataFrame:
        return common.materialise(folded.mapInArrow(hasher(numbers), "grp string, rep long, mark long, " + ", ".join(f"key{x} long" for x in numbers)), "keys")

    # stretches of the whole order, however it was dealt; each also gets the rows that its own can meet before and after it
    reach = window + 1
    span = max(8 * window, min(math.ceil(total / width), 1 << 16))
    stretches = math.ceil(total / span)

    def stretched(ordered: DataFrame, before: DataFrame) -> DataFrame:
        """Each row once for its own stretch and for those next to it that it can be met from."""
        rank = ordered.join(F.broadcast(before), "part").select("grp", "key", "rep", "mark", (F.col("before") + F.col("place")).alias("rank")).withColumn("own", F.expr(f"rank DIV {span}"))
        into = F.col("rank") - F.col("own") * span
        back = F.when((F.col("own") > 0) & (into < reach), F.col("own") - 1)
        on = F.when((F.col("own") + 1 < stretches) & (span - into <= reach), F.col("own") + 1)
        return rank.select(F.explode(F.array_compact(F.array("own", back, on))).alias("stretch"), "rank", "grp", "key", "rep", "mark")

    agree = 1 - math.acos(min(1.0, threshold)) / math.pi

    def missed(key: np.ndarray) -> np.ndarray:
        """For keys of a group in order, the log10 of the chance that a pair at the threshold isn't within the window.

        Rows with more leading signs in common than those just beyond the window have are within it.
        """
        signs = np.zeros(len(key), np.int64)
        if len(key) > reach:
            common_signs = BITS - np.frexp((key[:-reach] ^ key[reach:]).astype(np.float64))[1].astype(np.int64)
            signs[:-reach] = common_signs + 1
            signs[reach:] = np.maximum(signs[reach:], common_signs + 1)
        met = np.where(signs > BITS, 0.0, agree**signs)
        return np.log10(np.maximum(1 - met, 1e-9))

    def meet(table: pa.Table) -> pa.Table:
        """Pairs, saturated rows and the chances missed in a stretch."""
        table = table.sort_by("rank")
        rank, ids = table.column("rank").to_numpy(), table.column("rep").to_numpy()
        own = rank // span == table.column("stretch")[0].as_py()
        grp, units = table.column("grp").to_pylist(), table.column("unit").to_pylist()
        cuts = [0, *(i for i in range(1, len(grp)) if grp[i] != grp[i - 1]), len(grp)]
        key, chance = table.column("key").to_numpy(), np.full(len(rank), -9.0)
        out: list[tuple[int, np.ndarray, np.ndarray]] = []
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if hi - lo > 1:
                left, right, links = _window_pairs(np.frombuffer(b"".join(units[lo:hi]), "<f8").reshape(hi - lo, -1), window, threshold)
                chance[lo:hi] = missed(key[lo:hi])
                here, full = own[lo:hi], (links >= window // 2) & own[lo:hi]
                # a pair is told by the stretch of its first row; two saturated rows meet in the blocks below
                told = here[left] & ~(full[left] & full[right])
                out += [(0, ids[lo:hi][left[told]], ids[lo:hi][right[told]]), (1, ids[lo:hi][full], ids[lo:hi][full])]
        out.append((2, ids[own], ids[own]))
        none = np.zeros(0, np.int64)
        columns = [np.concatenate([none, *(np.full(len(x[1]), x[0]) for x in out)]), *(np.concatenate([none, *(x[k] for x in out)]) for k in (1, 2))]
        chances = pa.concat_arrays([pa.nulls(len(columns[0]) - int(own.sum()), pa.float64()), pa.array(chance[own])])
        return pa.table([pa.array(columns[0].astype(np.int32)), pa.array(columns[1]), pa.array(columns[2]), chances], ["kind", "a", "b", "missed"])

    # as many passes as spread-out vectors need, and more while each settles a good part of the rows left
    passes, number, found, left_before, ahead = passes_for(total, threshold, window, recall), 0, None, total, range(0)
    while True:
        if number not in ahead:
            ahead = range(number, max(passes, number + 4))
            keys = hashed(ahead)
        ordered = keys.select("grp", F.col(f"key{number}").alias("key"), "rep", "mark").repartitionByRange(width, "grp", "key", "rep").sortWithinPartitions("grp", "key", "rep")
        # the low 33 bits of the id count the rows of a partition
        ordered = common.materialise(ordered.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("place")), "order")
        before, rows_before = [], 0
        for part, n in sorted(ordered.groupBy("part").count().collect()):  # a row for each partition
            before.append((part, rows_before))
            rows_before += n
        first = spark.createDataFrame(before, "part int, before long")  # so this broadcast has as many rows as the shuffle has partitions
        dealt = stretched(ordered, first).join(folded.select("grp", "rep", "mark", "unit"), ["grp", "rep", "mark"])
        own = common.materialise(dealt.groupBy("stretch").applyInArrow(meet, "kind int, a long, b long, missed double"), "pass")
        found = own if found is None else found.unionByName(own)
        common.release(spark)
        number += 1
        if number >= passes:
            unsure = found.where("kind = 2").groupBy("a").agg(F.sum("missed").alias("missed")).where(F.col("missed") > math.log10(1 - recall)).select(F.col("a").alias("rep"))
            left = unsure.count()
            if left <= total // 64 or left > 0.9 * left_before:
                break
            left_before = left
    # rows that the passes may not have shown all their links are compared with all of their label, like saturated ones
    dense = common.materialise(found.where("kind = 1").select(F.col("a").alias("rep")).unionByName(unsure).distinct(), "dense")
    found = common.materialise(found.where("kind = 0").select("kind", "a", "b").distinct(), "links")
    pairs = found.where("kind = 0").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    # dense rows against all rows of their group, in blocks of packed vectors
    packed = folded.withColumn("block", F.pmod(F.xxhash64("rep"), F.lit(max(1, math.ceil(total / BLOCK)))))

    def pack(rows: DataFrame) -> DataFrame:
        return common.materialise(rows.groupBy("grp", "block").agg(F.collect_list(F.struct("rep", "copies", "unit")).alias("rows")), "blocks")

    query = pack(packed.join(dense, "rep", "left_semi")).select("grp", F.col("rows").alias("q"))
    every = pack(packed).select("grp", F.col("rows").alias("e"))
    mark = dense.select("rep", F.lit(True).alias("is_dense"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Weighted link counts of the query rows, and forest edges, for each pair of blocks."""
        for batch in batches:
            for q, e in zip(batch.column("q"), batch.column("e"), strict=True):
                q, e = q.as_py(), e.as_py()
                a = np.frombuffer(b"".join(r["unit"] for r in q), "<f8").reshape(len(q), -1)
                b = np.frombuffer(b"".join(r["unit"] for r in e), "<f8").reshape(len(e), -1)
                ids, others = [r["rep"] for r in q], [r["rep"] for r in e]
                hit = a @ b.T >= threshold
                near = np.argwhere(hit & (np.abs(a @ b.T - threshold) < 1e-9))
                for i, j in near:  # the sum in order decides ties at the threshold
                    hit[i, j] = float(np.sum(a[i] * b[j])) >= threshold
                for i, j in np.argwhere(np.array(ids)[:, None] == np.array(others)[None, :]):
                    hit[i, j] = False
                weight = hit @ np.array([r["copies"] for r in e])
                number = {r: k for k, r in enumerate(sorted({*ids, *others}))}
                forest = Forest(len(number))
                ea, eb = [], []
                for i in range(len(ids)):
                    own = np.flatnonzero(hit[i])
                    for j in own.tolist():
                        if forest.join(number[ids[i]], number[others[j]]):
                            ea.append(ids[i])
                            eb.append(others[j])
                n, m = len(ids), len(ea)
                yield pa.RecordBatch.from_arrays([pa.array([*ids, *ea], pa.int64()), pa.array([None] * n + eb, pa.int64()), pa.array([*weight.tolist(), *[0] * m], pa.int64())], ["a", "b", "n"])

    blocks = common.materialise(query.join(every, "grp").mapInArrow(compare, "a long, b long, n long"), "dense-links")
    exact = blocks.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    copies = folded.select("rep", "copies")
    # links of the other rows from the pairs; each side weighs the copies of the other
    sides = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    sparse = sides.join(copies.select(F.col("rep").alias("b"), F.col("copies").alias("w")), "b").groupBy(F.col("a").alias("rep")).agg(F.sum("w").alias("s"))
    extra = blocks.where("b is not null").select("a", "b")
    comp = components(pairs.unionByName(extra).select("a", "b"))
    per_rep = (
        folded.join(mark, "rep", "left").join(exact, "rep", "left").join(sparse, "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
        .select("grp", "unit", (F.col("copies") - 1 + F.coalesce(F.when(F.col("is_dense"), F.col("n")), F.col("s"), F.lit(0))).cast("long").alias("n"), F.coalesce("component", "rep").alias("c"))
    )
    per_rep = common.materialise(per_rep, "per-vector")
    out = rows.withColumn("grp", F.when(F.col("vec_id").isNotNull() & F.col("unit").isNotNull(), group)).join(per_rep, ["grp", "unit"], "left")
    component = F.coalesce("c", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
