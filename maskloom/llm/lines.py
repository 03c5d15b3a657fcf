"""Line dedup (operator 1): removal of boilerplate lines that spread over many sites.

A line's key is the hash of its trimmed text.  HyperLogLog sketches of the sites are built per key, map-side
first, and merged by the aggregation, so a line that occurs everywhere costs one small sketch per task.  Where
an estimate is so near the threshold that its error could decide, the distinct sites are counted exactly; only
those lines are read again.  Everything is DataFrame work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.llm import common

#: Registers of a sketch as a power of two; the relative error is about 1.04 / 2^(LG/2).
LG = 9
#: Estimates within so many errors of the threshold are settled by exact counts.
SIGMAS = 6


def line_key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def text_mark() -> Column:
    """With doc_id, what tells rows apart; rows that agree in both are copies of each other."""
    return F.xxhash64("text")


def exploded(docs: DataFrame) -> DataFrame:
    """doc_id, mark, site, pos, key of every line that isn't blank."""
    lines = docs.select("doc_id", text_mark().alias("mark"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("site"), F.posexplode(F.split(common.text_of(), "\n", -1)).alias("pos", "line"))
    return lines.where(F.trim("line") != "").select("doc_id", "mark", "site", "pos", line_key(F.col("line")).alias("key"))


def boilerplate(docs: DataFrame, min_sites: int) -> DataFrame:
    """Keys of lines on at least ``min_sites`` sites: key, sites (exact near the threshold, else the estimate)."""
    # a key seen fewer times than min_sites can't qualify: most keys go before any exact count
    sketched = (
        exploded(docs)
        .groupBy("key")
        .agg(F.count("*").alias("lines"), F.hll_sketch_agg("site", F.lit(LG)).alias("sketch"))
        .where(F.col("lines") >= min_sites)
        .select("key", F.hll_sketch_estimate("sketch").alias("estimate"))
    )
    margin = SIGMAS * 1.04 / 2 ** (LG / 2)
    wide = common.materialise(sketched.where(F.col("estimate") >= min_sites * (1 - margin) - 1), "line-sketches")
    near = wide.where(F.col("estimate") <= min_sites * (1 + margin) + 1).select("key")
    pairs = exploded(docs).select("key", "site").join(near, "key", "left_semi").distinct()
    exact = pairs.groupBy("key").agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites)
    sure = wide.where(F.col("estimate") > min_sites * (1 + margin) + 1).select("key", F.col("estimate").cast("long").alias("sites"))
    return common.materialise(exact.unionByName(sure), "boilerplate")


def dedup_lines(docs: DataFrame, min_sites: int = 10) -> DataFrame:
    """All rows and columns of ``docs``, boilerplate lines gone from ``text``; plus lines_removed.

    A line is boilerplate if its trimmed text stands on at least ``min_sites`` distinct sites (``source``; a
    null one counts as the site of empty name).  Its first occurrence, by doc_id (null first) and position, stays, so that no
    content leaves the corpus; the others go.  Blank lines stay.  Null texts stay null; rows with equal
    doc_id and text are copies that keep and lose the same lines, rows with equal doc_id and another text are documents of
    their own in the order of a hash of it; an empty table gives an empty table.
    """
    own = [c for c in docs.columns if c != "lines_removed"]
    docs = docs.select(*own)
    bad = boilerplate(docs, min_sites)
    hits = common.materialise(exploded(docs).join(bad.select("key"), "key").select("doc_id", "mark", "pos", "key"), "line-hits")
    place = F.struct(F.coalesce("doc_id", F.lit(-(2**63))).alias("d"), "mark", "pos")
    # the first occurrence of each key is a minimum, aggregated map-side
    first = common.materialise(hits.groupBy("key").agg(F.min(place).alias("at")), "line-firsts")
    gone = (
        hits.join(first, "key")
        .where(place != F.col("at"))
        .groupBy(F.col("doc_id").alias("__hit_id"), F.col("mark").alias("__hit_mark"))
        .agg(F.collect_set("pos").alias("__gone"))
    )
    lines = F.split("text", "\n", -1)
    kept = F.filter(F.transform(lines, lambda x, i: F.when(F.array_contains("__gone", i), F.lit(None)).otherwise(x)), lambda x: x.isNotNull())
    text = F.when(F.col("__gone").isNotNull() & F.col("text").isNotNull(), F.array_join(kept, "\n")).otherwise(F.col("text"))
    joined = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("__hit_id")) & (text_mark() == F.col("__hit_mark")), "left")
    removed = F.when(F.col("text").isNull(), 0).otherwise(F.coalesce(F.size("__gone"), F.lit(0)))
    out = [text.alias("text") if c == "text" else F.col(c) for c in own]
    return joined.select(*out, removed.cast("int").alias("lines_removed"))


def oracle(min_sites: int = 10) -> str:
    """DuckDB SQL for the columns of the registered query."""
    return f"""
WITH lines AS (
  SELECT doc_id, coalesce(source, '') AS site, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
real AS (SELECT doc_id, site, pos, trim(line, ' ') AS k FROM lines WHERE trim(line, ' ') <> ''),
bad AS (SELECT k FROM real GROUP BY k HAVING count(DISTINCT site) >= {min_sites}),
hits AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) AS nth FROM real JOIN bad USING (k)),
gone AS (SELECT doc_id, pos FROM hits WHERE nth > 1),
kept AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) AS text
         FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos WHERE g.pos IS NULL GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text,
       CAST(coalesce(n.n, 0) AS INTEGER) AS lines_removed
FROM documents d LEFT JOIN kept k USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) n USING (doc_id)"""
