"""Regular-expression scans with offsets, as Column expressions.

Spark has no function for all matches with offsets; the pieces between matches and the matches themselves give
them by running sums of lengths.  ``length`` counts code points, which is the offset unit of the library.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of the regex engine.
EMAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\p{Nd}{2}(?: ?[A-Z0-9]{1,4}){2,8}(?![A-Za-z0-9])"


#: Matches folded together; an array grown one by one is copied each time, so long texts go in blocks.
_BLOCK = 64
_MATCHES = "array<struct<start:int,end:int,value:string>>"


def find_spans(text: Column, pattern: str) -> Column:
    """array<struct<start,end,value>> of all matches from left to right; null text gives an empty array.

    Running positions are made block by block: first the length of each block, then where each begins, then the
    matches within it; the work is linear in the number of matches but for a small factor.
    """
    text = F.coalesce(text, F.lit(""))
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)).alias("gap"), hits.alias("hit"))
    numbers = F.sequence(F.lit(0), ((F.size(hits) - 1) / _BLOCK).cast("int"))
    blocks = F.transform(numbers, lambda b: F.slice(pairs, b * _BLOCK + 1, F.lit(_BLOCK)))
    none = F.array().cast("array<struct<at:int,block:array<struct<gap:string,hit:string>>>>")

    def place(acc: Column, block: Column) -> Column:
        size = F.aggregate(block, F.lit(0), lambda n, p: n + F.length(p["gap"]) + F.length(p["hit"]))
        return F.struct((acc["pos"] + size).alias("pos"), F.concat(acc["out"], F.array(F.struct(acc["pos"].alias("at"), block.alias("block")))).alias("out"))

    placed = F.aggregate(blocks, F.struct(F.lit(0).alias("pos"), none.alias("out")), place, lambda a: a["out"])

    def step(acc: Column, pair: Column) -> Column:
        at = acc["pos"] + F.length(pair["gap"])
        end = at + F.length(pair["hit"])
        return F.struct(end.alias("pos"), F.concat(acc["out"], F.array(F.struct(at.alias("start"), end.alias("end"), pair["hit"].alias("value")))).alias("out"))

    inner = lambda b: F.aggregate(b["block"], F.struct(b["at"].alias("pos"), F.array().cast(_MATCHES).alias("out")), step, lambda a: a["out"])
    return F.when(F.size(hits) > 0, F.flatten(F.transform(placed, inner))).otherwise(F.array().cast(_MATCHES))


def labelled_spans(text: Column, pattern: str, label: str, keep=None) -> Column:
    """``find_spans`` with a label; ``keep`` filters by value."""
    found = find_spans(text, pattern)
    if keep is not None:
        found = F.filter(found, lambda m: keep(m["value"]))
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(label).alias("label")))


def render(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its label in brackets; spans are ordered and disjoint."""
    text = F.coalesce(text, F.lit(""))
    # where each piece begins: after the span before; the last one has no span of its own
    begins = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
    tail = lambda at: F.substring(text, at + 1, F.length(text))
    piece = lambda s, at: F.when(s.isNull(), tail(at)).otherwise(F.concat(F.substring(text, at + 1, s["start"] - at), F.lit("["), s["label"], F.lit("]")))
    return F.array_join(F.zip_with(spans, begins, piece), "")
