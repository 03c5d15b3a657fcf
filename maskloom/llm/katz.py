"""LM scoring (operator 4): a Katz bigram model with Good-Turing discounts.

Counts are made in hash buckets (``packed``) from whole texts; every token of every document is dealt, so sums
for a document come from its buckets and no count table is ever sent whole to a task.

* Unigram buckets count training tokens and give each document what its score needs: how many of its tokens
  have each small count, and the sum of the logarithms of the large ones.  Discounts, known only when all buckets are done, enter later.
* Bigram buckets, by context, count training bigrams.  Bigrams seen ``min_count`` times or more are stored with their Good-Turing
  discounts; the mass of the others goes to the backoff, whose weight normalises each context exactly:
  alpha(h) = (1 - sum of P(w|h) over stored w) / (1 - sum of P(w) over the same w).
* Scoring evaluates each token recursively: its stored bigram, else alpha(h) P(w), where P(w) is the discounted unigram or, for
  a token never seen, the mass that discounting left.

The unigram counts, contexts and bigrams are packed tables, a row for each bucket, in the shared folder; of its followers a bucket
asks each unigram bucket once.  A text is its
words and one end; the first word's context is the end of the text before.  Contexts are identified by their
bucket and 32 bits, followers by 64; contexts that share an identity form one class, normalised like any other.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.llm import common, packed
from maskloom.llm.words import mix, split_words

#: Counts up to so many are discounted.
SMALL = 5
#: Turns in which bigrams are counted, and scored; each reads all texts for a share of the buckets, as all at once take much disk.
TURNS = 2
END = np.uint64(0x2545F4914F6CDD1D)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner and hash of each token, the end of each text included, and where each text's tokens begin."""
    w = split_words(texts, True)
    docs = len(w.counts)
    first = w.first[:-1] + np.arange(docs)
    total = len(w.hash) + docs
    h = np.full(total, END)
    words = np.ones(total, bool)
    words[w.first[1:] + np.arange(docs)] = False
    h[words] = w.hash
    return np.repeat(np.arange(docs), w.counts + 1), h, first


def bigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, context and token of each token."""
    owner, h, first = tokens(texts)
    context = np.concatenate([[END], h[:-1]])[: len(h)]
    context[first] = END
    return owner, mix(context + np.uint64(1)), h


def discounts(frequency: dict[int, int], least: int = 1) -> np.ndarray:
    """Factors d[0..SMALL] for counts, by Katz from the numbers of types seen once, twice, ...; 1 beyond SMALL.

    Counts below ``least`` have 0.  A factor that the data make nonsense of (outside (0, 1]) falls back to absolute discounting by 0.5.
    """
    d = np.ones(SMALL + 1)
    n = [0.0] + [float(frequency.get(r, 0)) for r in range(1, SMALL + 2)]
    top = (SMALL + 1) * n[SMALL + 1] / n[1] if n[1] else 1.0
    for r in range(1, SMALL + 1):
        value = ((r + 1) * n[r + 1] / n[r] / r - top) / (1 - top) if n[r] and top < 1 else -1.0
        d[r] = value if 0 < value <= 1 else (r - 0.5) / r
        if r < least:
            d[r] = 0.0
    return d


#: A bigram's follower and how often the texts of one shipment have it.
_FOLLOWER = np.dtype([("word", "<u8"), ("times", "<u4")])


def _counted(context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct bigrams in order of context, and their followers with counts: hot ones leave a task once."""
    order = np.lexsort((word, context))
    a, w = context[order], word[order]
    at = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (w[1:] != w[:-1])])) if len(a) else np.zeros(0, np.int64)
    out = np.empty(len(at), _FOLLOWER)
    out["word"], out["times"] = w[at], np.diff(np.append(at, len(a)))
    return a[at], out


@dataclass
class Unigrams:
    """Probabilities by count: d c / N, and what is left for a token never seen."""

    total: int
    types: int
    d: np.ndarray
    unseen: float

    @classmethod
    def of(cls, frequency: dict[int, int], total: int, types: int) -> Unigrams:
        d = discounts(frequency)
        taken = sum(frequency.get(r, 0) * r * (1 - d[r]) for r in range(1, SMALL + 1))
        if total and taken <= 0:  # nothing seen rarely: reserve half a token
            return cls(total, types, d * (total - 0.5) / total, 0.5 / total)
        return cls(total, types, d, taken / total if total else 1.0)

    def probability(self, count: np.ndarray) -> np.ndarray:
        """P by training count; counts beyond SMALL share the factor of the last entry only where all are scaled."""
        c = np.asarray(count, np.int64)
        factor = np.where(c > SMALL, self.d[0], self.d[np.minimum(c, SMALL)])
        return np.where(c > 0, factor * c / max(1, self.total), self.unseen)


def score_texts(docs: DataFrame, folds: int = 10, min_count: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row.

    Documents whose fold is not 0 train the model.  Null texts are empty and score their end; repeated rows are
    documents of their own, a null doc_id is a document in the fold of the text ``null``; other columns are ignored; an empty table
    gives no rows.  With no training document at all score and base_score are those of a model that knows nothing.

    The texts are read once for the unigrams, and ``TURNS`` times each to count and to score bigrams.  A table of files gives its rows in the same order each time; where ``docs`` is derived and
    doesn't, so that the numbers of two reads belong to other rows, the result is an error and never another text's score.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text"), (common.fold("doc_id", folds) == 0).alias("held"))
    buckets = packed.buckets_for(rows)

    # 1. unigrams; the lowest bit of what is sent tells training tokens
    def unigram_make(part: pa.RecordBatch):
        owner, h, _ = tokens(part.column("text"))
        trains = ~part.column("held").to_numpy(zero_copy_only=False)
        return owner, h, (h & np.uint64(0xFFFFFFFFFFFFFFFE)) | trains[owner].astype(np.uint64), None

    def unigram_count(table: pa.Table) -> pa.Table:
        b = packed.Bucket(table, "<u8")
        value, trains = b.hash >> np.uint64(1), (b.hash & np.uint64(1)).astype(bool)
        types, which = np.unique(value, return_inverse=True)
        count = np.bincount(which[trains], minlength=len(types)).astype(np.int64)
        known = count > 0
        number = int(table.column("bucket")[0].as_py())
        few = np.bincount(np.minimum(count[known], SMALL + 2), minlength=SMALL + 3)[: SMALL + 3].astype(np.int64)
        # each token's count, by document, on its way home
        home = packed.answered(b, np.diff(b.first), [count[which].astype("<u4")], number, buckets)
        n = home.num_rows

        def ended(kind: pa.DataType, value) -> pa.Array:
            return pa.concat_arrays([pa.nulls(n, kind), pa.array([value], kind)])

        # last, with home -1, the bucket's table and totals
        last = {"home": [-1], "keys": [None], "sizes": [None], "answers": [None], "docs": [None]}
        whole = pa.concat_tables([home, pa.table(last, home.schema)])
        more = {
            "bucket": pa.array(np.full(n + 1, number, np.int32)),
            "types": ended(pa.binary(), packed.press((types[known] << np.uint64(1)).astype("<u8"))),
            "counts": ended(pa.binary(), packed.press(count[known].astype("<i8"))),
            "few": ended(pa.list_(pa.int64()), few.tolist()),
            "total": ended(pa.int64(), int(count.sum())),
            "size": ended(pa.int64(), int(known.sum())),
        }
        for name, column in more.items():
            whole = whole.append_column(name, column)
        return whole

    schema = packed.ANSWERED + ", bucket int, types binary, counts binary, few array<long>, total long, size long"
    counted = packed.deal(rows, buckets, unigram_make).groupBy("bucket").applyInArrow(unigram_count, schema)
    uni, path = common.materialise_parts(counted.withColumn("own", (F.col("home") < 0).cast("int")), "unigrams", "own")
    common.release(spark)
    totals = uni.where("own = 1").agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0)), *(F.coalesce(F.sum(F.get("few", F.lit(r))), F.lit(0)) for r in range(1, SMALL + 2))).first()
    unigrams = Unigrams.of({r: totals[r + 1] for r in range(1, SMALL + 2)}, totals[0], totals[1])

    sums = [f"m{r}" for r in range(SMALL + 1)]
    names = [*sums, "big", "log_big", "log_base"]

    def lower_sums(table: pa.Table) -> pa.Table:
        """How many tokens of each document have each small training count, and sums of logarithms over its tokens."""
        home = packed.Home.of(table, "<u4")
        c = home.values[0].astype(np.int64)
        big = c > SMALL
        columns = [home.sums(c == r) for r in range(SMALL + 1)] + [home.sums(big), home.sums(np.where(big, np.log10(np.maximum(c, 1)), 0.0)), home.sums(np.log10(c + 0.1))]
        return pa.table({"row": pa.array(home.rows), "doc_id": home.doc_ids, **dict(zip(names, columns, strict=True))})

    lower = uni.where("own = 0").select("home", "keys", "sizes", "answers", "docs").groupBy("home").applyInArrow(lower_sums, "row long, doc_id long, " + ", ".join(f"{c} double" for c in names))
    lower = common.materialise(lower, "unigram-sums")
    common.discard(spark, f"{path}/own=0")
    uni = common.read_parts(spark, path, uni.schema).where("own = 1")

    # 2. training bigrams by context, one packed row per bucket, and its followers by the bucket of their unigram counts
    def bigram_make(part: pa.RecordBatch, turn: int):
        # whose a bigram is doesn't matter here; counted, and in order of context, they take less room on their way
        _, context, h = bigrams(part.column("text"))
        own = packed.bucket_of(context, buckets) % TURNS == turn
        context, followers = _counted(context[own], h[own])
        return np.zeros(len(context), np.int64), context, context.astype("<u4"), followers

    train = rows.where(~F.col("held"))

    def bigram_count(table: pa.Table) -> pa.Table:
        b = packed.Bucket(table, "<u4", _FOLLOWER)
        number = int(table.column("bucket")[0].as_py())
        order = np.lexsort((b.extra["word"], b.hash))
        a, w, times = b.hash[order], b.extra["word"][order], b.extra["times"][order].astype(np.int64)
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (w[1:] != w[:-1])]) if len(a) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        count = np.add.reduceat(times, at) if len(at) else np.zeros(0, np.int64)
        a, w = a[at], w[at]
        contexts, which = np.unique(a, return_inverse=True)
        total = np.bincount(which, weights=count, minlength=len(contexts)).astype(np.int64)
        few = np.bincount(np.minimum(count, SMALL + 2), minlength=SMALL + 3)[: SMALL + 3]
        keep = count >= min_count
        sizes = np.bincount(which[keep], minlength=len(contexts))
        stored = sizes > 0
        # followers once each, by home; bigrams hold their places in that order
        words, place = np.unique(w[keep], return_inverse=True)
        home = packed.bucket_of(words, buckets)
        order = np.argsort(home, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        words, bounds = words[order], np.searchsorted(home[order], np.arange(buckets + 1))
        sent = np.flatnonzero(np.diff(bounds))
        n = len(sent)

        def ended(value: np.ndarray, kind: str) -> pa.Array:
            return pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array([packed.press(value.astype(kind))], pa.binary())])

        # last, with home -1, the bucket's bigrams
        return pa.table({
            "bucket": pa.array(np.full(n + 1, number, np.int32)),
            "home": pa.array(np.append(sent, -1).astype(np.int32)),
            "words": pa.array([*(packed.press(words[bounds[h] : bounds[h + 1]].astype("<u8")) for h in sent), None], pa.binary()),
            "counts": ended(count[keep], "<i8"),
            "places": ended(rank[place], "<u4"),
            "names": ended(contexts[stored], "<u4"),
            "sizes": ended(sizes[stored], "<i8"),
            "totals": ended(total[stored], "<i8"),
            "few": pa.concat_arrays([pa.nulls(n, pa.list_(pa.int64())), pa.array([few.tolist()], pa.list_(pa.int64()))]),
        })

    answer = "bucket int, home int, words binary, counts binary"
    parts = []
    for turn in range(TURNS):
        dealt = packed.deal(train, buckets, lambda part, turn=turn: bigram_make(part, turn))
        counted = dealt.groupBy("bucket").applyInArrow(bigram_count, answer + ", places binary, names binary, sizes binary, totals binary, few array<long>")
        parts.append(common.materialise_parts(counted.withColumn("asks", (F.col("home") >= 0).cast("int")), "bigrams", "asks"))
        common.release(spark)
    bi = reduce(DataFrame.unionByName, (df for df, _ in parts))
    seen = bi.where("asks = 0").agg(*(F.coalesce(F.sum(F.get("few", F.lit(r))), F.lit(0)) for r in range(1, SMALL + 2))).first()
    d = discounts({r: seen[r - 1] for r in range(1, SMALL + 2)}, min_count)

    # unigram counts of the followers: requests meet the unigram tables in their buckets, and take the upper halves of the words along
    tables = uni.select(F.col("bucket").alias("home"), "types", "counts")

    def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
        types, counts = packed.unpress(right.column("types"), "<u8"), packed.unpress(right.column("counts"), "<i8")
        upper, answers = [], []
        for raw in left.column("words").to_pylist():
            own = packed.unpress(pa.array([raw]), "<u8")
            word = own & np.uint64(0xFFFFFFFFFFFFFFFE)
            got = np.zeros(len(word), np.int64)
            if len(types):
                at = np.minimum(np.searchsorted(types, word), len(types) - 1)
                got = np.where(types[at] == word, counts[at], 0)
            upper.append(packed.press((own >> np.uint64(32)).astype("<u4")))
            answers.append(packed.press(got.astype("<i8")))
        return pa.table([left.column("bucket"), left.column("home"), pa.array(upper, pa.binary()), pa.array(answers, pa.binary())], ["bucket", "home", "words", "counts"])

    priced = bi.where("asks = 1").select("bucket", "home", "words").groupBy("home").cogroup(tables.groupBy("home")).applyInArrow(look_up, answer)
    priced = common.materialise(priced, "follower-counts")
    for _, path in parts:  # the questions are answered; their room is needed
        common.discard(spark, f"{path}/asks=1")
    bi = reduce(DataFrame.unionByName, (common.read_parts(spark, path, df.schema) for df, path in parts))
    model = bi.where("asks = 0").drop("few", "asks").unionByName(priced, allowMissingColumns=True)
    common.release(spark)

    # 3. backoff weights and gains of a bucket
    def weigh(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Contexts and the logarithms of their backoff weights; bigrams as context and upper half of the follower, and their gains over backoff."""
        table = table.sort_by("home")
        homes = table.column("home").to_numpy()

        def joined(name: str, kind: str, own: bool) -> np.ndarray:
            return packed.unpress(table.filter(pa.array((homes < 0) == own)).column(name), kind)

        names, sizes, n = joined("names", "<u4", True), joined("sizes", "<i8", True), joined("counts", "<i8", True)
        if not len(names):
            return names, np.zeros(0), np.zeros(0, np.uint64), np.zeros(0)
        place = joined("places", "<u4", True)
        upper, p = joined("words", "<u4", False)[place], unigrams.probability(joined("counts", "<i8", False))[place]
        total = joined("totals", "<i8", True)
        which = np.repeat(np.arange(len(names)), sizes)
        q = np.where(n > SMALL, 1.0, d[np.minimum(n, SMALL)]) * n / total[which]
        used, low = np.bincount(which, weights=q), np.bincount(which, weights=p)
        # a context must leave something to what it hasn't seen; where it wouldn't, its bigrams are scaled down
        least = 1 / (total + 1.0)
        scale = np.where(1 - used < least, (1 - least) / used, 1.0)
        alpha = np.log10((1 - used * scale) / np.maximum(1 - low, 1e-12))
        gain = np.log10(q * scale[which]) - alpha[which] - np.log10(p)
        return names, alpha, names[which].astype(np.uint64) << np.uint64(32) | upper, gain

    # 4. every bigram of every document against its bucket's table; in turns
    def score_make(part: pa.RecordBatch, turn: int):
        owner, context, h = bigrams(part.column("text"))
        own = packed.bucket_of(context, buckets) % TURNS == turn
        owner, context, h = owner[own], context[own], h[own]
        # in the tables' order: context, then the follower's upper half; 32 bits tell followers of one context apart
        return owner, context, context.astype("<u4"), (h >> np.uint64(32)).astype("<u4")

    def evaluate(left: pa.Table, right: pa.Table) -> pa.Table:
        b = packed.Bucket(left, "<u4", "<u4")
        value = np.zeros(len(b.hash))
        names, alpha, key, gain = weigh(right)
        if len(names):
            at = np.minimum(np.searchsorted(names, b.hash), len(names) - 1)
            value += np.where(names[at] == b.hash, alpha[at], 0.0)
            own = b.hash.astype(np.uint64) << np.uint64(32) | b.extra.astype(np.uint64)
            at = np.minimum(np.searchsorted(key, own), len(key) - 1)
            value += np.where(key[at] == own, gain[at], 0.0)
        if not len(left):
            return pa.schema([("home", pa.int32()), *((c, pa.binary()) for c in ("keys", "sizes", "answers", "docs"))]).empty_table()
        value = np.bincount(b.run, weights=value, minlength=len(b.ids))
        return packed.answered(b, np.ones(len(b.ids), np.int64), [value.astype("<f8")], int(left.column("bucket")[0].as_py()), buckets)

    def higher_sums(table: pa.Table) -> pa.Table:
        home = packed.Home.of(table, "<f8")
        return pa.table({"row": pa.array(home.rows), "doc_id": home.doc_ids, "n": pa.array(home.n), "value": pa.array(home.sums(home.values[0]))})

    higher = None
    for turn in range(TURNS):
        dealt = packed.deal(rows, buckets, lambda part, turn=turn: score_make(part, turn))
        scored = dealt.groupBy("bucket").cogroup(model.groupBy("bucket")).applyInArrow(evaluate, packed.ANSWERED)
        own = common.materialise(scored.groupBy("home").applyInArrow(higher_sums, "row long, doc_id long, n long, value double"), "bigram-sums")
        higher = own if higher is None else higher.unionByName(own)
        common.release(spark)
    higher = higher.groupBy("row", "doc_id").agg(F.sum("n").alias("n"), F.sum("value").alias("value"))
    logs = [float(np.log10(unigrams.unseen))] + [float(np.log10(unigrams.probability(np.array([r]))[0])) if unigrams.total else 0.0 for r in range(1, SMALL + 1)]
    n_tokens = sum((F.col(c) for c in sums), F.col("big"))
    base = float(np.log10(unigrams.total + 0.1 * (unigrams.types + 1)))
    unit = float(np.log10(unigrams.d[0] / max(1, unigrams.total)))
    p1 = sum((F.col(c) * F.lit(x) for c, x in zip(sums, logs, strict=True)), F.col("log_big") + F.col("big") * F.lit(unit))
    higher = higher.select("row", F.col("doc_id").alias("same_id"), "n", "value")
    met = F.col("n").isNotNull() & F.col("same_id").eqNullSafe(F.col("doc_id")) & (F.col("n") == n_tokens)
    value = F.when(met, F.col("value")).otherwise(F.raise_error(F.lit("texts_changed_between_reads")))
    return lower.join(higher, "row", "left").select(
        "doc_id", (common.fold("doc_id", folds) == 0).alias("held_out"), n_tokens.cast("long").alias("n_tokens"), (n_tokens - F.col("m0")).cast("long").alias("n_known"),
        F.lit(unigrams.total).cast("long").alias("train_tokens"), (F.col("log_base") - n_tokens * F.lit(base)).alias("base_score"), (p1 + value).alias("score"),
    )
