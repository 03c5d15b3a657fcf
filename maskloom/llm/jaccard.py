"""N-gram Jaccard join (operator 5): a prefix-tree join over globally ordered shingle sets.

1. Shingle sets are dealt to hash buckets (``packed``) which give each shingle its document frequency and send the shared
   ones home, packed, a row for each bucket and home.  Shingles of one document can't be shared, so a document whose shared shingles are fewer than the threshold demands is
   done.  The global order is by frequency, rare first, then by hash.
2. Equal sets are folded into one.  Sets that share a shingle within their prefixes - the only ones that can
   reach the threshold - are grouped; no set is sent to more than one place for that.
3. Within a group the sets are stored in a trie of ordered shingles; a set walks down the trie with the overlap
   so far, shared by all sets below a node, and leaves a subtree when the overlap still possible by the lengths
   remaining can't reach what the sizes demand.
4. A group larger than a task should hold is cut into bands of sizes; what is still too large is first compared with its most central set; the sets linked to that
   one are connected and need not meet each other.  The rest meets the whole group in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.llm import common, packed
from maskloom.llm.components import components
from maskloom.llm.neighbours import Forest
from maskloom.llm.words import mix, ngram_hashes, split_words

#: A block of a large group holds at least so many shingles.
BLOCK_SHINGLES = 4096


def shingle_hashes(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each distinct shingle: runs of ``size`` words, or all words of a shorter text as one."""
    w = split_words(texts, lower=True)
    n = w.counts
    docs = len(n)
    word_owner = np.repeat(np.arange(docs), n)
    g = ngram_hashes(w.hash, size)
    inside = word_owner[: len(g)] == word_owner[size - 1 :][: len(g)] if len(g) else np.zeros(0, bool)
    owner, h = word_owner[: len(g)][inside], g[inside]
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        own = np.array([int(mix(ngram_hashes(w.hash[w.first[i] : w.first[i] + n[i]], int(n[i])) + np.uint64(n[i]))[0]) for i in short], np.uint64)
        owner, h = np.concatenate([owner, short]), np.concatenate([h, own])
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return owner[keep], h[keep]


class Trie:
    """Ordered sets in a compressed prefix tree; a node holds a run of shingles and the sets that end there."""

    __slots__ = ("below", "ends", "next", "part", "run", "size")

    def __init__(self, run: tuple = ()):
        self.run, self.part = run, frozenset(run)
        self.next: dict = {}
        self.ends: list[tuple[int, int]] = []  # number, full set size
        self.below = 0  # most shingles after this node
        self.size = 1 << 60  # least full size of a set at or below

    def add(self, items: tuple, number: int, size: int) -> None:
        node, at = self, 0
        while True:
            node.below = max(node.below, len(items) - at)
            node.size = min(node.size, size)
            if at == len(items):
                node.ends.append((number, size))
                return
            child = node.next.get(items[at])
            if child is None:
                child = Trie(items[at:])
                child.size = size
                child.ends.append((number, size))
                node.next[items[at]] = child
                return
            k, run = 0, child.run
            while k < len(run) and at + k < len(items) and run[k] == items[at + k]:
                k += 1
            if k < len(run):  # part of the run is shared: split it
                upper = Trie(run[:k])
                upper.next[run[k]] = child
                upper.below, upper.size = child.below + len(run) - k, child.size
                child.run, child.part = run[k:], frozenset(run[k:])
                node.next[items[at]] = upper
                child = upper
            node, at = child, at + k

    def search(self, own: frozenset, size: int, percent: int) -> Iterator[int]:
        """Numbers of stored sets s with 100 * |own & s| >= percent * |own | s|, by full sizes."""
        stack = [(self, 0)]
        both = 100 + percent
        while stack:
            node, overlap = stack.pop()
            overlap += len(node.part & own)
            # overlap needed: percent / (100 + percent) of the sizes' sum
            if both * (overlap + node.below) < percent * (size + node.size) or both * len(own) < percent * (size + node.size):
                continue
            for number, other in node.ends:
                if both * overlap >= percent * (size + other):
                    yield number
            stack += [(c, overlap) for c in node.next.values()]


def join_block(left: list[tuple[int, int, list]], right: list[tuple[int, int, list]] | None, percent: int) -> list[tuple[int, int]]:
    """Forest edges of the links within ``left``, or between ``left`` and ``right``; entries are (id, size, ordered shingles)."""
    edges = []
    stored = left if right is None else right
    forest = Forest(len(left) + (0 if right is None else len(right)))
    trie = Trie()
    if right is not None:
        for k, (_, size, items) in enumerate(right):
            trie.add(tuple(items), len(left) + k, size)
    for k, (i, size, items) in enumerate(left):
        for other in trie.search(frozenset(items), size, percent):
            if forest.join(k, other):
                edges.append((i, stored[other - (0 if right is None else len(left))][0]))
        if right is None:
            trie.add(tuple(items), k, size)
    return edges


def shared_sets(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """One row per document: row, doc_id, n (set size), m (shingles it shares), items and central.

    ``items`` are its shared shingles in the global order, rare first, and ``central`` their mean frequency; both are null
    where so few are shared that no other set can reach ``percent``.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text"))
    buckets = packed.buckets_for(rows)

    def make(part: pa.RecordBatch):
        owner, h = shingle_hashes(part.column("text"), size)
        return owner, h, h, None

    def count(table: pa.Table) -> pa.Table:
        """The shared shingles of each document in this bucket, with their frequencies, on their way home."""
        b = packed.Bucket(table, "<u8")
        order = np.argsort(b.hash, kind="stable")
        h = b.hash[order]
        new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        times = np.diff(np.concatenate([new, [len(h)]]))
        df = np.empty(len(h), np.uint64)
        df[order] = np.repeat(times, times)
        shared = df > 1
        sizes = np.bincount(b.run[shared], minlength=len(b.ids))
        return packed.answered(b, sizes, [b.hash[shared], df[shared]], int(table.column("bucket")[0].as_py()), buckets)

    def gather(table: pa.Table) -> pa.Table:
        home = packed.Home.of(table, "<u8", 2)
        h, df = home.values
        m = np.bincount(home.place, minlength=len(home.rows))
        enough = (m > 0) & (100 * m >= percent * home.n)
        keep = enough[home.place]
        place, h, df = home.place[keep], h[keep], df[keep]
        order = np.lexsort((h, df, place))
        bounds = np.concatenate([[0], np.cumsum(np.where(enough, m, 0))])
        items = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(h[order].view(np.int64)), mask=pa.array(~enough))
        central = np.bincount(place, weights=df.astype(float), minlength=len(home.rows)) / np.maximum(home.n, 1)
        return pa.table({"row": pa.array(home.rows), "doc_id": home.doc_ids, "n": pa.array(home.n), "m": pa.array(m), "items": items, "central": pa.array(central, mask=~enough)})

    homes = packed.deal(rows, buckets, make).groupBy("bucket").applyInArrow(count, packed.ANSWERED)
    out = common.materialise(homes.groupBy("home").applyInArrow(gather, "row long, doc_id long, n long, m long, items array<long>, central double"), "shared-shingles")
    common.release(docs.sparkSession)
    return out


def jaccard_components(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, set_id for every row.

    Two documents link when 100 * intersection >= percent * union of their shingle sets; component_id is the least
    doc_id that links reach, itself included; set_id tells equal sets apart from others within the run.  Texts are lower-cased for
    A-Z only.  Null and empty texts, and those of blanks, have an empty set and link with nothing.  Rows with a
    repeated doc_id are documents of their own; a null doc_id takes part, and is a component's id only if no
    other is there.  Other columns are ignored; an empty table gives no rows.
    """
    got = shared_sets(docs, size, percent)
    every = got.select("row", "doc_id", "n")
    same = F.when(F.col("m") == F.col("n"), F.lit(-1)).otherwise(F.col("row"))
    keyed = got.where(F.col("items").isNotNull()).select("row", "n", "m", "items", "central", F.struct("n", F.xxhash64("items"), F.xxhash64(F.lit(7), "items"), same).alias("key"))
    folded = common.materialise(keyed.groupBy("key").agg(F.min("row").alias("rep")), "folded-sets")
    members = common.materialise(keyed.select("row", "key").join(folded, "key").select("row", "rep"), "members")
    sets = keyed.join(folded.select(F.col("rep").alias("row")), "row", "left_semi").select(F.col("row").alias("rep"), "n", "m", "items", "central")
    sets = common.materialise(sets, "sets")
    # prefix: a set of n must share one of its first n - ceil(percent n / 100) + 1; those of one document come first
    prefix = F.greatest(F.lit(0), F.col("n") - F.ceil(F.col("n") * percent / 100.0 - 1e-9) + 1 - (F.col("n") - F.col("m"))).cast("int")
    tokens = common.materialise(sets.select("rep", F.explode(F.slice("items", F.lit(1), prefix)).alias("token")), "prefixes")
    least = common.materialise(tokens.groupBy("token").agg(F.min("rep").alias("a"), F.count("*").alias("c")).where("c > 1").select("token", "a"), "prefix-groups")
    groups = components(tokens.join(least, "token").select("a", F.col("rep").alias("b")))
    grouped = common.materialise(sets.join(groups.withColumnRenamed("node", "rep").withColumnRenamed("component", "grp"), "rep"), "grouped")
    edges = _group_edges(grouped, percent)
    comp = components(edges)
    of_row = members.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("row", "rep", F.coalesce("component", "rep").alias("c"))
    of_row = common.materialise(of_row.join(every.select("row", "doc_id"), "row").select("row", "doc_id", "rep", "c"), "classes")
    smallest = common.materialise(of_row.groupBy("c").agg(F.min("doc_id").alias("component_id")), "class-ids")
    named = of_row.join(smallest, "c").select("row", "rep", "component_id")
    out = every.join(named, "row", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("rep", "row").alias("set_id"), "row")


def _group_edges(grouped: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect what the links within each group connect; ``grp`` tells groups, ``rep`` sets."""
    spark = grouped.sparkSession
    total = grouped.agg(F.sum(F.size("items"))).first()[0] or 0
    most = max(BLOCK_SHINGLES, total // (2 * common.shuffle_width(spark)))
    # groups too large for a task fall apart by size: sets that link are of one band or of two neighbours
    own = F.floor(F.log("n") / F.lit(math.log(100 / percent) * 1.001))
    whole = common.materialise(grouped.groupBy("grp").agg((F.sum(F.size("items")) > most).alias("banded"), F.count("*").alias("c")).where("c > 1").drop("c"), "groups")
    banded = grouped.join(whole, "grp").withColumn("own", own).withColumn("band", F.explode(F.when(F.col("banded"), F.array(F.col("own"), F.col("own") - 1)).otherwise(F.array(F.lit(None).cast("long")))))
    grouped = banded.select(F.concat_ws("/", F.col("grp").cast("string"), F.col("band").cast("string")).alias("grp"), "rep", "n", "m", "items", "central", (F.col("band").isNull() | (F.col("band") == F.col("own"))).alias("native"))
    sizes = common.materialise(grouped.groupBy("grp").agg(F.sum(F.size("items")).alias("t"), F.count("*").alias("c"), F.bool_or("native").alias("any")).where("c > 1 and any").drop("any"), "group-sizes")
    rows = grouped.join(sizes, "grp")
    small, large = rows.where(F.col("t") <= most), rows.where(F.col("t") > most)
    # the most central set of each large group; at most total / most of them
    best = large.groupBy("grp").agg(F.max(F.struct("central", "rep")).alias("top")).select("grp", F.col("top.rep").alias("rep"))
    pivots = grouped.join(best, ["grp", "rep"], "left_semi").select("grp", F.col("rep").alias("pivot"), F.col("n").alias("pn"), F.col("items").alias("pitems"))
    pivots = common.materialise(pivots, "pivots")
    o = F.size(F.array_intersect("items", "pitems"))
    tested = large.join(pivots, "grp").withColumn("hit", (F.col("rep") == F.col("pivot")) | (o * (100 + percent) >= (F.col("n") + F.col("pn")) * percent))
    tested = common.materialise(tested.select("grp", "rep", "n", "items", "pivot", "hit"), "tested")
    star = tested.where("hit and rep != pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b"))
    blocks = tested.groupBy("grp").agg(*(F.ceil(F.coalesce(F.sum(F.when(c, F.size("items"))), F.lit(0)) / most).cast("int").alias(name) for name, c in (("nl", F.col("hit")), ("nu", ~F.col("hit")))))
    blocks = common.materialise(blocks, "block-counts")
    placed = tested.join(blocks, "grp").where("nu > 0")
    at = lambda n: F.pmod(F.xxhash64("rep"), F.greatest(F.col(n), F.lit(1))).cast("int")
    span = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    u, loose = at("nu"), placed.where("not hit")
    # blocks of loose sets (u) meet the linked blocks (l) and each other (u2 >= u)
    parts = [
        small.select(F.concat_ws("/", "grp").alias("task"), F.lit(0).alias("side"), "rep", "n", "items"),
        placed.where("hit").withColumn("l", at("nl")).select("grp", "rep", "n", "items", "l", F.explode(span("nu")).alias("u")).select(F.concat_ws("/", "grp", "u", F.lit("l"), "l").alias("task"), F.lit(1).alias("side"), "rep", "n", "items"),
        loose.select("grp", "rep", "n", "items", u.alias("u"), F.explode(span("nl")).alias("l")).select(F.concat_ws("/", "grp", "u", F.lit("l"), "l").alias("task"), F.lit(0).alias("side"), "rep", "n", "items"),
        loose.select("grp", "rep", "n", "items", u.alias("u"), F.explode(span("nu")).alias("v")).select(F.concat_ws("/", "grp", F.least("u", "v"), F.lit("u"), F.greatest("u", "v")).alias("task"), (F.col("u") > F.col("v")).cast("int").alias("side"), "rep", "n", "items"),
    ]
    # a loose block against itself is one side

    def link(table: pa.Table) -> pa.Table:
        rows = list(zip(table.column("rep").to_pylist(), table.column("n").to_pylist(), table.column("items").to_pylist(), strict=True))
        side = table.column("side").to_pylist()
        left = sorted((r for r, s in zip(rows, side, strict=True) if not s), key=lambda r: (r[1], r[0]))
        right = sorted((r for r, s in zip(rows, side, strict=True) if s), key=lambda r: (r[1], r[0]))
        crossing = bool(right) or "/l/" in table.column("task")[0].as_py()
        found = join_block(left, right, percent) if crossing else join_block(left, None, percent)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    tasks = parts[0]
    for p in parts[1:]:
        tasks = tasks.unionByName(p)
    linked = common.materialise(tasks.groupBy("task").applyInArrow(link, "a long, b long"), "links")
    return linked.unionByName(star)
