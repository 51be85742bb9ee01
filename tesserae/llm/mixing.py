"""Mixing sources to target weights by systematic sampling.

Targets come from water-filling: sources share all words by weight, none beyond ``MOST`` times its size. Within a
source every document expects target / size copies; the running sum of expected copies plus one random offset crosses
an integer once per copy taken. Documents run in order of coarse size, so that the words taken stay within about one
document of the target. Running positions come from counts of small cells, never from one task per source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.store import materialize, table

WEIGHTS = (1, 2, 3)
MOST = 3
#: Documents for which one more slice per (source, size class) is made.
SLICE_ROWS = 20_000
SEED = "mix-1"
_WORD = r"[^\x20\x09-\x0D]+"


def _spread(doc_id):
    """16 bits of a multiplied id, so that ids with a common factor fall into all slices."""
    return F.shiftright(F.pmod(F.pmod(doc_id, F.lit(1 << 31)) * 2654435761, F.lit(1 << 32)), 16)


def _size_class(size):
    """Sizes below 16 as they are, larger ones in sixteenths of a power of two."""
    digits = F.length(F.bin(size))
    shift = F.greatest(digits - 5, F.lit(0))
    return F.when(size < 16, size).otherwise(digits * 100 + F.floor(size / F.pow(F.lit(2.0), shift))).cast("long")


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size) -> with target: sources by code point, null last, weigh ``weights`` in turn.

    Sources fill up in order of size / weight: the level is what is left over the weights that are left. The running
    sums pass over one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")).cast("long")
    cap = F.col("source_size") * most
    filled = totals.select("source", "source_size", w.alias("w")).withColumn("cap", cap)
    up = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    below, all_ = up.rowsBetween(Window.unboundedPreceding, -1), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = filled.select(
        "*",
        (F.sum("source_size").over(all_) - F.coalesce(F.sum("cap").over(below), F.lit(0))).alias("rest"),
        (F.sum("w").over(all_) - F.coalesce(F.sum("w").over(below), F.lit(0))).alias("rest_w"),
    )
    level = F.col("rest").cast("double") / F.col("rest_w").cast("double")
    free = F.when(F.col("cap") > F.col("w") * level, level)
    return filled.select("source", "source_size", F.coalesce(F.col("w") * F.first(free, ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, 0)), F.col("cap").cast("double")).alias("target"))


def systematic_copies(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """Rows (doc_id, source, size, mark) with source_size, target and copies; ``mark`` spreads rows without an id over slices."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    slices = (totals.agg(F.sum("n")).first()[0] or 0) // SLICE_ROWS + 1
    goal = targets(totals, weights, most)
    cell = sized.withColumn("class", _size_class(F.col("size"))).withColumn("slice", F.pmod(F.coalesce(_spread(F.col("doc_id")), F.col("mark")), F.lit(slices)))
    key = ["source", "class", "slice"]
    counts = cell.groupBy(*key).agg(F.count("*").alias("in_cell"))
    # two levels of running counts: over a source's classes, of which there are a few hundred, and over a class's slices
    up = counts.groupBy("source", "class").agg(F.sum("in_cell").alias("in_class"))
    up = up.select(F.col("source").alias("s"), F.col("class").alias("c"), (F.sum("in_class").over(Window.partitionBy("source").orderBy("class")) - F.col("in_class")).alias("below"))
    inner = F.sum("in_cell").over(Window.partitionBy("source", "class").orderBy("slice")) - F.col("in_cell")
    offsets = counts.withColumn("inner", inner).join(up, F.col("source").eqNullSafe(F.col("s")) & (F.col("class") == F.col("c"))).select(*key, (F.col("inner") + F.col("below")).alias("before"))
    tag = F.md5(F.concat(F.lit(seed), F.coalesce(offsets["source"], F.lit("\x00"))).cast("binary"))
    u = F.conv(F.substring(tag, 1, 8), 16, 10).cast("double") / 4294967296.0
    start = offsets.join(goal, offsets["source"].eqNullSafe(goal["source"])).select(offsets["source"].alias("s"), F.col("class").alias("c"), F.col("slice").alias("l"), "before", "source_size", "target", u.alias("u"))
    row = cell.withColumn("at", F.row_number().over(Window.partitionBy(*key).orderBy("doc_id", "size")))
    joined = row.join(start, row["source"].eqNullSafe(F.col("s")) & (row["class"] == F.col("c")) & (row["slice"] == F.col("l")))
    at = (F.col("before") + F.col("at")).cast("double")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(F.lit(0.0))
    copies = (F.floor(F.col("u") + at * rate) - F.floor(F.col("u") + (at - 1.0) * rate)).cast("long")
    return joined.select("doc_id", row["source"].alias("source"), "size", "source_size", "target", F.least(copies, F.lit(most)).cast("long").alias("copies"))


def sizes(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("mark"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, copies, taken = copies * size.

    Null texts have no words. A null source is a source of its own, last in order. Documents without words take part
    in the sampling and count nothing. Where no source has words, targets are 0 and nothing is taken.
    """
    out = systematic_copies(materialize(sizes(docs)), weights, most, seed)
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """``docs`` once per copy taken, with ``copy`` from 1 up (a column of that name is replaced).

    Rows of equal id (without an id: of equal text) get equal copies, the mean of what sampling gives them. An empty
    table and texts without words are as in ``mix``.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))
    plain = docs.drop("copy").withColumn("_mix_key", key)
    sized = materialize(sizes(plain.withColumn("doc_id", F.col("_mix_key"))))
    taken = systematic_copies(sized, weights, most, seed).groupBy(F.col("doc_id").alias("_mix_key")).agg(F.round(F.avg("copies")).cast("long").alias("_mix_copies")).filter("_mix_copies > 0")
    return plain.join(taken, "_mix_key").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_mix_copies")))).drop("_mix_key", "_mix_copies")


def op3_systematic_mix(spark, sf_dir: str) -> DataFrame:
    """Copies of every document in the mix of all sources."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
t AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM d GROUP BY source),
w AS (SELECT source, source_size, 3 * source_size AS cap, CAST(r % 3 + 1 AS BIGINT) AS w FROM t),
f AS (SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
  sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest_w FROM w),
l AS (SELECT *, CAST(rest AS DOUBLE) / CAST(rest_w AS DOUBLE) AS level FROM f),
g AS (SELECT source, source_size, coalesce(w * first_value(CASE WHEN cap > w * level THEN level END IGNORE NULLS) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), CAST(cap AS DOUBLE)) AS target,
  CAST(CAST('0x' || substr(md5('{SEED}' || coalesce(source, chr(0))), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS u FROM l),
c AS (SELECT *, CASE WHEN size < 16 THEN size ELSE len(bin(size)) * 100 + CAST(floor(size / pow(2.0, greatest(len(bin(size)) - 5, 0))) AS BIGINT) END AS class, (doc_id % 2147483648 * 2654435761 % 4294967296 >> 16) % ((SELECT count(*) FROM d) // {SLICE_ROWS} + 1) AS slice FROM d),
p AS (SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY class, slice, doc_id, size) AS DOUBLE) AS nth FROM c),
x AS (SELECT p.doc_id, p.size, g.source_size, g.target, g.u, p.nth, CASE WHEN g.source_size > 0 THEN g.target / CAST(g.source_size AS DOUBLE) ELSE 0.0 END AS rate FROM p JOIN g ON p.source IS NOT DISTINCT FROM g.source),
y AS (SELECT *, least(CAST(floor(u + nth * rate) - floor(u + (nth - 1.0) * rate) AS BIGINT), 3) AS copies FROM x)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM y
"""
