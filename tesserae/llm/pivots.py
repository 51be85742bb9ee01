"""Embedding near-dedup with a pivot-permutation index.

Reference points (pivots) come from a bounded sample. Their number follows the largest label, so that lists keep a length
of about ``LIST`` as the table grows. A vector is described by its ``NEAREST`` pivots in order of similarity and enters the
inverted lists of all of them but the last by number: two vectors that share ``SHARED`` pivots meet in another one's
list. A list is compared block by block; pairs count in the list of their first shared pivot only and are verified by
cosine in double precision, on vectors scaled by powers of two, which no length over- or underflows. A block reports
how many links each vector has and links that span its components, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.llm.components import components
from tesserae.llm.store import drop, materialize, table

#: Fewest and most pivots, vectors of a list, sampled rows a pivot, and the cosine from which a row is too close to another pivot.
PIVOTS, LIST, SAMPLED, APART = (256, 8192), 128, 2, 0.8
NEAREST, SHARED = 8, 2
COSINE = 0.93
BLOCK, TILE = 1024, 512


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest components to [0.5, 1): cosines stay as they are."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0))[1][:, None])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def choose_pivots(classes: DataFrame, most: tuple[int, int] = PIVOTS) -> dict[int, np.ndarray]:
    """Per dimension, unit vectors of a hash-ordered sample, none close to another: as many as give lists of ``LIST`` rows, within the bounds ``most``."""
    out = {}
    for d, n in classes.groupBy("dim", "label").count().groupBy("dim").agg(F.max("count")).toLocalIterator():
        count = min(max(NEAREST * n // LIST, most[0]), most[1])
        rows = classes.filter(F.col("dim") == d).orderBy(F.xxhash64("rep"), "rep").limit(SAMPLED * count).select("v").toLocalIterator()
        have, k = np.zeros((count, d)), 0
        for x in _unit(np.array([v for (v,) in rows], np.float64)):
            if k < count and (have[:k] @ x).max(initial=-1) < APART:
                have[k] = x
                k += 1
        out[d] = have[:k]
    return out


def _describe(pivots, kind: str):
    """(rep, mult, label, dim, vector as bytes, its nearest pivots in order)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("v"))
            size = np.diff(column.offsets.to_numpy())
            values = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
            start = np.concatenate([[0], np.cumsum(size)])
            perm: list[list[int]] = [[] for _ in range(len(size))]
            for d in np.unique(size):
                rows = np.flatnonzero(size == d)
                p = pivots.value[int(d)]
                for at in range(0, len(rows), BLOCK):
                    part = rows[at : at + BLOCK]
                    near = -(_unit(values[start[part][:, None] + np.arange(d)].astype(np.float64)) @ p.T)
                    first = np.argpartition(near, min(NEAREST, len(p)) - 1, axis=1)[:, :NEAREST]
                    first = np.take_along_axis(first, np.argsort(np.take_along_axis(near, first, 1), axis=1, kind="stable"), 1)
                    for r, q in zip(part, first.tolist(), strict=True):
                        perm[r] = q
            blobs = [values[a:b].tobytes() for a, b in zip(start[:-1], start[1:], strict=True)]
            keep = [batch.column(batch.schema.get_field_index(c)) for c in ("label", "dim", "rep", "mult")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(blobs, pa.binary()), pa.array(perm, pa.list_(pa.int32()))], names=["label", "dim", "rep", "mult", "v", "perm"])

    return run


def _compare(cosine: float, shared: int, kind: str):
    """For two blocks of a list: (v, c, n) with n links of v, or c < v of v's component."""
    schema = pa.schema([("v", pa.int64()), ("c", pa.int64()), ("n", pa.int64())])

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        pivot, i, j = (key[k].as_py() for k in (2, 3, 4))
        group = group.combine_chunks()
        ids, mult, own = (group.column(c).to_numpy() for c in ("rep", "mult", "block"))
        x = _scaled(np.frombuffer(b"".join(group.column("v").to_pylist()), kind).reshape(len(ids), -1).astype(np.float64))
        norm = np.sqrt((x * x).sum(1))
        perm = np.array(group.column("perm").to_pylist(), np.int64)  # of one length: a dimension has one set of pivots
        need = min(shared, perm.shape[1])
        names, at = np.unique(perm, return_inverse=True)
        cut = int(np.searchsorted(names, pivot))
        has = np.zeros((len(ids), len(names)), np.float32)
        has[np.repeat(np.arange(len(ids)), perm.shape[1]), at.ravel()] = 1
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        links, edges = np.zeros(len(ids), np.int64), []
        for a0 in range(0, len(left), TILE):
            for b0 in range(a0 if i == j else 0, len(right), TILE):
                a, b = left[a0 : a0 + TILE], right[b0 : b0 + TILE]
                earlier = has[a, :cut] @ has[b, :cut].T
                ok = (has[a, cut:] @ has[b, cut:].T >= need) & (earlier == 0)
                if i == j and a0 == b0:
                    ok &= np.arange(len(a))[:, None] < np.arange(len(b))[None, :]
                if not ok.any():
                    continue
                p, q = np.nonzero(ok & (x[a] @ x[b].T >= (cosine - 1e-9) * (norm[a][:, None] * norm[b][None, :])))
                hit = np.zeros(len(p), bool)
                for r in range(0, len(p), 1 << 14):  # sums of products row by row settle what the threshold is close to
                    s, t = a[p[r : r + (1 << 14)]], b[q[r : r + (1 << 14)]]
                    hit[r : r + (1 << 14)] = (x[s] * x[t]).sum(1) >= cosine * (norm[s] * norm[t])
                p, q = a[p[hit]], b[q[hit]]
                np.add.at(links, p, mult[q])
                np.add.at(links, q, mult[p])
                comp = ids.copy()
                while len(p):  # smallest labels spread over the tile's links until they rest
                    low = np.minimum(comp[p], comp[q])
                    if (comp[p] == low).all() and (comp[q] == low).all():
                        break
                    np.minimum.at(comp, p, low)
                    np.minimum.at(comp, q, low)
                moved = np.flatnonzero(comp < ids)
                edges.append((ids[moved], comp[moved]))
        some = links > 0
        v, c = [np.concatenate(z) for z in zip((ids[some], ids[some]), *edges, strict=True)]
        return pa.Table.from_arrays([pa.array(v), pa.array(c), pa.array(np.concatenate([links[some], np.zeros(len(v) - some.sum(), np.int64)]))], schema=schema)

    return run


def near_duplicate_vectors(rows: DataFrame, cosine: float = COSINE, pivots: tuple[int, int] = PIVOTS, shared: int = SHARED, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row: id_col, n_links, component_id (smallest id reachable), kept.

    Vectors link within one label (and one dimension) at cosine >= ``cosine``. Null ids and labels, null or zero
    vectors and vectors with null or non-finite components link with nothing. Equal vectors are one class, whose copies
    are counted and never paired. Rows that share an id are one vertex.

    A pair is found if it shares ``shared`` of its ``NEAREST`` pivots: at a cosine of 0.93 in 64 dimensions 0.99 of the
    pairs with 4,096 pivots, 0.978 with 8,192. Lists grow beyond that number of pivots only, or where vectors crowd.
    """
    spark = rows.sparkSession
    single = isinstance(rows.schema[vector_col].dataType.elementType, T.FloatType)
    kind, array = ("<f4", "array<float>") if single else ("<f8", "array<double>")
    v = F.col(vector_col).cast(array)
    good = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & F.coalesce(~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    base = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), v.alias("v"), F.coalesce(good, F.lit(False)).alias("good"))
    key = ["label", "dim", "h1", "h2"]
    hashed = base.withColumns({"dim": F.size("v"), "h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")})
    classes = materialize(hashed.filter("good").groupBy(*key).agg(F.min("id").alias("rep"), F.count("*").alias("mult"), F.first("v").alias("v")))
    chosen = spark.sparkContext.broadcast(choose_pivots(classes, pivots))
    described = materialize(classes.select("label", "dim", "rep", "mult", "v").mapInArrow(_describe(chosen, kind), "label string, dim int, rep long, mult long, v binary, perm array<int>"))
    # who shares enough pivots shares one that isn't among the last of either in order of number
    entered = F.explode(F.slice(F.array_sort("perm"), F.lit(1), F.greatest(F.size("perm") - (shared - 1), F.lit(1))))
    sizes = described.select("label", "dim", entered.alias("pivot")).groupBy("label", "dim", "pivot").agg(F.count("*").alias("n")).filter("n > 1").select("label", "dim", "pivot", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    lists = described.select("label", "dim", "rep", "mult", "v", "perm", entered.alias("pivot"))
    placed = lists.join(sizes, ["label", "dim", "pivot"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    dealt = placed.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    found = materialize(dealt.select("label", "dim", "pivot", "i", "j", "rep", "mult", "v", "perm", "block").groupBy("label", "dim", "pivot", "i", "j").applyInArrow(_compare(cosine, shared, kind), "v long, c long, n long"))
    drop(described)
    links = found.groupBy(F.col("v").alias("rep")).agg(F.sum("n").alias("n"))
    labels = components(found.filter("c < v").select(F.col("c").alias("a"), F.col("v").alias("b")))
    named = classes.join(links, "rep", "left").join(labels.select(F.col("v").alias("rep"), "c"), "rep", "left")
    named = named.select(*key, (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("c", "rep").alias("c"))
    out = hashed.filter("good").select("id", *key).join(named, key, "left").select("id", "n_links", "c").unionByName(base.filter("not good").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("c")))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("c").alias("component_id"), F.col("id").eqNullSafe(F.col("c")).alias("kept"))


def op1_pivot_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all embeddings of equal label at cosine 0.93."""
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))
