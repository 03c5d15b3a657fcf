"""Interval algebra over half-open character spans.

Two forms: DataFrame operators on one row per span (columns doc, start, end, and label or ord where named), by
windows within a document; and Column operators on an array of spans within a row, by folds.  The rules differ in
whether touching intervals merge and in whose label wins, and are kept apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskloom.schema import PROMOTED, SPAN

# --- one row per span ---------------------------------------------------------------------------


def islands(spans: DataFrame, keys: list[str], touching: bool) -> DataFrame:
    """Numbers the connected groups of each key's spans: adds ``island``.  ``touching``: end == start connects."""
    order = Window.partitionBy(*keys).orderBy("start", F.desc("end"))
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.col("start") > reach if touching else F.col("start") >= reach
    return spans.withColumn("_new", F.when(reach.isNull() | apart, 1).otherwise(0)).withColumn("island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def merge(spans: DataFrame, keys: list[str], touching: bool) -> DataFrame:
    """The union of each key's spans as disjoint ordered intervals."""
    return islands(spans, keys, touching).groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def union_touching(spans: DataFrame) -> DataFrame:
    """Class-agnostic character union: overlapping and touching spans merge."""
    return merge(spans, ["doc"], True)


def union_strict(spans: DataFrame) -> DataFrame:
    """Overlapping spans merge, touching ones don't; the label is that of the first, longest, least."""
    order = F.struct("start", -F.col("end"), "label")
    return islands(spans, ["doc"], False).groupBy("doc", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("label", order).alias("label")).drop("island")


def union_per_label(spans: DataFrame) -> DataFrame:
    """Strict merge within each label; spans of different labels may still overlap."""
    return merge(spans, ["doc", "label"], False)


def union_sources(spans: DataFrame, first: str = "regex") -> DataFrame:
    """Strict merge of two sources: the label of ``first``'s earliest span if one took part; source ``both`` if mixed."""
    order = F.struct("start", -F.col("end"), "label")
    own = F.col("source") == first
    g = islands(spans, ["doc"], False).groupBy("doc", "island")
    merged = g.agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by(F.when(own, F.col("label")), F.when(own, order)).alias("_own"), F.min_by("label", order).alias("_any"), F.count_distinct("source").alias("_n"), F.min("source").alias("_s"))
    return merged.select("doc", "start", "end", F.coalesce("_own", "_any").alias("label"), F.when(F.col("_n") > 1, "both").otherwise(F.col("_s")).alias("source"))


def union_refined(spans: DataFrame) -> DataFrame:
    """Union with touching, as the refinement leaves it: ADDRESS if any span is one, else the first, longest, least label.

    The source is ``refine`` if any span has it, ``both`` if sources are mixed, else the only one.
    """
    order = F.struct("start", -F.col("end"), "label")
    g = islands(spans, ["doc"], True).groupBy("doc", "island")
    merged = g.agg(F.min("start").alias("start"), F.max("end").alias("end"), F.bool_or(F.col("label") == "ADDRESS").alias("_region"), F.min_by("label", order).alias("_first"), F.bool_or(F.col("source") == "refine").alias("_refined"), F.count_distinct("source").alias("_n"), F.min("source").alias("_s"))
    label = F.when(F.col("_region"), "ADDRESS").otherwise(F.col("_first"))
    return merged.select("doc", "start", "end", label.alias("label"), F.when(F.col("_refined"), "refine").when(F.col("_n") > 1, "both").otherwise(F.col("_s")).alias("source"))


def union_promoted(spans: DataFrame) -> DataFrame:
    """Union with touching; the first, longest, least label, promoted to a region of the island that contains it."""
    order = F.struct("start", (-F.col("end")).alias("back"), "label", "end")
    grouped = islands(spans, ["doc"], True).groupBy("doc", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.array_sort(F.collect_list(order.alias("o"))).alias("items"))
    return grouped.select("doc", "start", "end", promoted_label(F.col("items")).alias("label"))


def promoted_label(items: Column) -> Column:
    """Fold over (start, -end, label, end) in order."""

    def step(pick: Column, x: Column) -> Column:
        inside = (x["start"] <= pick["start"]) & (pick["end"] <= x["end"])
        part = F.lit(False)
        for region, parts in PROMOTED.items():
            part = part | ((x["label"] == region) & pick["label"].isin(*parts))
        return F.when(part & inside, x).otherwise(pick)

    return F.aggregate(F.slice(items, F.lit(2), F.size(items)), F.element_at(items, 1), step, lambda p: p["label"])


def intersect(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pieces of the left union that the right union covers: equi-join on doc with a range residual."""
    a, b = union_touching(left).alias("a"), union_touching(right).alias("b")
    on = (F.col("a.doc") == F.col("b.doc")) & (F.col("a.start") < F.col("b.end")) & (F.col("b.start") < F.col("a.end"))
    return a.join(b, on).select(F.col("a.doc").alias("doc"), F.greatest("a.start", "b.start").alias("start"), F.least("a.end", "b.end").alias("end"))


def subtract(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pieces of the left union outside the right union: the gaps between cuts, by one window."""
    a = union_touching(left).select("doc", F.col("start").alias("lo"), F.col("end").alias("hi"))
    cuts = intersect(left, right)
    on = (a["doc"] == cuts["doc"]) & (cuts["start"] >= a["lo"]) & (cuts["end"] <= a["hi"])
    cut = a.join(cuts, on, "left").select(a["doc"], "lo", "hi", F.col("start").alias("s"), F.col("end").alias("e"))
    order = Window.partitionBy("doc", "lo").orderBy("s")
    # the gap before each cut, and the one after the last
    before = cut.select("doc", F.coalesce(F.lag("e").over(order), F.col("lo")).alias("start"), F.coalesce("s", "hi").alias("end"))
    after = cut.groupBy("doc", "lo", "hi").agg(F.max("e").alias("e")).where("e is not null").select("doc", F.col("e").alias("start"), F.col("hi").alias("end"))
    return before.unionByName(after).where("start < end")


def complement(spans: DataFrame, lengths: DataFrame) -> DataFrame:
    """What the union leaves of [0, n) in each doc of ``lengths`` (doc, n)."""
    whole = lengths.where("n > 0").select("doc", F.lit(0).alias("start"), F.col("n").alias("end"))
    return subtract(whole, spans)


def overlap_join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Rows of ``left`` (columns as they are) with those of ``right`` (prefixed r_) that overlap them in the same doc."""
    r = right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns))
    return left.join(r, (F.col("doc") == F.col("r_doc")) & (F.col("start") < F.col("r_end")) & (F.col("r_start") < F.col("end")), how)


def rules_first(rules: DataFrame, model: DataFrame) -> DataFrame:
    """All rule spans, and the model spans that overlap none of them."""
    return rules.unionByName(overlap_join(model, rules, "left_anti"))


def contained(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """Rows of ``inner`` that lie within some row of ``outer``."""
    r = outer.select(F.col("doc").alias("r_doc"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    return inner.join(r, (F.col("doc") == F.col("r_doc")) & (F.col("r_start") <= F.col("start")) & (F.col("end") <= F.col("r_end")), "left_semi")


def dedupe_detections(spans: DataFrame) -> DataFrame:
    """One row per (doc, start, end, label), the last by ord; then only spans that reach beyond all before them of their label."""
    last = Window.partitionBy("doc", "start", "end", "label").orderBy(F.desc("ord"))
    once = spans.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
    order = Window.partitionBy("doc", "label").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    return once.withColumn("_r", F.max("end").over(order)).where(F.col("_r").isNull() | (F.col("end") > F.col("_r"))).drop("_r")


# --- arrays of spans within a row ----------------------------------------------------------------


def sorted_spans(spans: Column) -> Column:
    """By start, longer first, label."""
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["label"].alias("label")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["start"].alias("start"), (-s["back"]).cast("int").alias("end"), s["label"].alias("label")))


def greedy(spans: Column) -> Column:
    """Spans in order, each dropped that begins before the last kept one ends."""
    start = F.array().cast(f"array<{SPAN}>")
    last = lambda a: F.coalesce(F.try_element_at(a, F.lit(-1))["end"], F.lit(0))
    return F.aggregate(sorted_spans(spans), start, lambda a, s: F.when(s["start"] >= last(a), F.concat(a, F.array(s))).otherwise(a))


def union_array(spans: Column, touching: bool = True) -> Column:
    """The union of a row's spans as ordered disjoint intervals with the first label of each."""
    start = F.array().cast(f"array<{SPAN}>")

    def step(a: Column, s: Column) -> Column:
        last = F.try_element_at(a, F.lit(-1))
        joins = last.isNotNull() & ((s["start"] <= last["end"]) if touching else (s["start"] < last["end"]))
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["label"].alias("label"))
        return F.when(joins, F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(grown))).otherwise(F.concat(a, F.array(s)))

    return F.aggregate(sorted_spans(spans), start, step)
