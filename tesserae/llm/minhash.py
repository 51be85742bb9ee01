"""MinHash near-duplicates with tensored banding.

Two small groups of hash collections are computed per document (``SIDE`` collections of ``ROWS`` minhashes each).
Every pair of a collection of the first group with one of the second keys a table, so SIDE^2 tables of 2*ROWS rows
cost 2*SIDE*ROWS minhash functions only. Two sets of similarity s meet in some table unless one group agrees nowhere:
at s = 0.8 that is below 2 * (1 - 0.8^3)^12 = 0.0004. Candidates are confirmed on the full shingle sets.

Copies are handled as classes of equal sets, named by their smallest document. Members of a bucket are not paired with
each other. Each meets the smallest leader of its buckets, and those whose sketches agree with it form a family;
buckets that still hold several families try their own leader, and what is still apart then is compared in blocks that
report families only. Within a family, links to leaders are confirmed first. A link that is still missing has an end
apart from its family's main component, so members apart meet their family. Shingles that only one member of the family
has can't be in an intersection: who has too many of them for a similarity of 0.8 has no link at all and leaves, whoever
stays is compared block by block, by exact counts on full sets, with members of fitting sizes. A block pair reports the
links that span its components, never all pairs; no limit of ranks or partners applies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm import kernels as K
from tesserae.llm.components import components
from tesserae.llm.store import drop, materialize, table

SIDE, ROWS = 12, 3
_BANDED = 2 * SIDE * ROWS
#: Minhashes in a sketch (the banded ones and further ones), a byte each.
_HASHES = 192
#: Share of agreeing minhashes from which a candidate is confirmed on full sets: 4 standard deviations under 0.8.
AGREE = 0.68
#: Share from which two sets are of one family: links of one set are within distance 0.4 of each other.
FAMILY = 0.56
#: Members, and shingles, that a block holds about; shingles whose columns are counted at once.
BLOCK, BLOCK_SHINGLES, COLUMNS = 512, 1 << 18, 4096
#: Slices of a family when its members meet its main component, so that a large one isn't one task's.
SALT = 32
_MULTIPLY = np.array([K.mix_int(2 * t + 1) | 1 for t in range(_HASHES)], np.uint64).astype(np.uint32)
_ADD = np.array([K.mix_int(2 * t + 2) for t in range(_HASHES)], np.uint64).astype(np.uint32)


def _signatures(k: int):
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, offs in K.chunks(batch.column(1)):
                words, rows = K.word_hashes(buf, offs)
                h, at = K.shingle_hashes(words, rows, k)
                n = np.diff(at)
                some = np.flatnonzero(n)
                k1, k2 = np.zeros(j - i, np.uint64), np.zeros(j - i, np.uint64)
                mins = np.zeros((j - i, _HASHES), np.uint32)
                if len(some):
                    first = at[:-1][some]
                    k1[some] = np.add.reduceat(h, first)
                    k2[some] = np.add.reduceat(K.mix(h ^ np.uint64(0x5851F42D4C957F2D)), first)
                    x = (h >> np.uint64(32)).astype(np.uint32)
                    for t in range(_HASHES):
                        mins[some, t] = np.minimum.reduceat(x * _MULTIPLY[t] + _ADD[t], first)
                wide = mins[:, :_BANDED].reshape(j - i, 2 * SIDE, ROWS).astype(np.uint64)
                bands = np.zeros((j - i, 2 * SIDE), np.uint64)
                for r in range(ROWS):
                    bands = K.mix(bands * np.uint64(3) + wide[:, :, r] + np.uint64(1))
                whole = np.where(n[:, None] > 0, np.ones(2 * SIDE, bool), False)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(whole.sum(1))]), pa.int32()), pa.array(bands[n > 0].ravel().view(np.int64)))
                sketch = (mins & np.uint32(255)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), lists, pa.array([r.tobytes() for r in sketch], pa.binary())], schema=schema)

    return run


def _sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    for i, j, buf, offs in K.chunks(column):
        h, at = K.shingle_hashes(*K.word_hashes(buf, offs), k)
        yield from (h[at[x] : at[x + 1]] for x in range(j - i))


def _similar(num: int, den: int, k: int):
    """(a, b) of the pairs whose shingle sets satisfy den * |intersection| >= num * |union|."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(_sets(batch.column(2), k), _sets(batch.column(3), k), strict=True):
                both = K.overlap(x, y)
                ok.append(both > 0 and den * both >= num * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], schema=schema).filter(pa.array(ok, pa.bool_()))

    return run


def _hashes(k: int):
    """(id, f, c, in_main, n, set as bytes) of members with their texts."""
    schema = pa.schema([("id", pa.int64()), ("f", pa.int64()), ("c", pa.int64()), ("in_main", pa.bool_()), ("n", pa.int64()), ("set", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(_sets(batch.column(4), k))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([len(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], schema=schema)

    return run


def _holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(f, shingle, one holder, holders) summed over a batch of members (key, f, set)."""
    schema = pa.schema([("f", pa.int64()), ("h", pa.int64()), ("key", pa.int64()), ("holders", pa.int64())])
    for batch in batches:
        keys, fs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(2)]
        for f in np.unique(fs):
            own = np.flatnonzero(fs == f)
            h, first, n = np.unique(np.concatenate([sets[r] for r in own]), return_index=True, return_counts=True)
            who = np.repeat(keys[own], [len(sets[r]) for r in own])[first]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), f)), pa.array(h), pa.array(who), pa.array(n)], schema=schema)


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, _HASHES)


def _agreement(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, share of agreeing minhashes) of pairs that reach FAMILY."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("share", pa.float64())])
    for batch in batches:
        if batch.num_rows:
            share = (_sketches(batch.column(2)) == _sketches(batch.column(3))).mean(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(share)], schema=schema).filter(pa.array(share >= FAMILY))


def _members(part: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return tuple(np.array([v[c] for v in part], np.int64) for c in ("id", "c", "n")) + (np.frombuffer(b"".join(v["sketch"] for v in part), np.uint8).reshape(-1, _HASHES),)


def _spanning(p: np.ndarray, q: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(smallest vertex, vertex) of the vertices below n that the links (p, q) join to a smaller one."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[p], label[q])
        if (label[p] == low).all() and (label[q] == low).all():
            moved = np.flatnonzero(label < np.arange(n))
            return label[moved], moved
        np.minimum.at(label, p, low)
        np.minimum.at(label, q, low)
        label = label[label]


def _families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For two blocks of a bucket: (a, b) that span the components of members whose sketches agree."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    for batch in batches:
        for row in batch.to_pylist():
            (xi, xc, _, x), (yi, yc, _, y) = _members(row["xs"]), _members(row["ys"])
            ids, at = np.unique(np.concatenate([xi, yi]), return_inverse=True)
            p, q = [], []
            for r in range(len(xi)):
                hit = np.flatnonzero((yc != xc[r]) & ((y == x[r]).mean(1) >= FAMILY))
                p.append(np.full(len(hit), at[r]))
                q.append(at[len(xi) + hit])
            a, b = _spanning(np.concatenate(p), np.concatenate(q), len(ids))
            yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], schema=schema)


def _block_pairs(rows: DataFrame, key: str, size: str) -> DataFrame:
    """Pairs (xs, ys) of blocks of about BLOCK members (id, c, n, sketch) that share ``key``."""
    block = F.pmod(F.xxhash64("id"), F.ceil(F.col(size) / BLOCK))
    xs, ys = (rows.groupBy(key, block.alias(f"block_{name}")).agg(F.collect_list(F.struct("id", "c", "n", "sketch")).alias(name)) for name in ("xs", "ys"))
    return xs.join(ys, key).filter("block_xs <= block_ys").select("xs", "ys")


def _overlaps(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every x with every y: products of their columns, a run of shared shingles at a time."""
    shared = np.intersect1d(np.concatenate(xs), np.concatenate(ys))
    out = np.zeros((len(xs), len(ys)), np.float32)
    sides = []
    for sets in (xs, ys):
        h, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.minimum(np.searchsorted(shared, h), max(0, len(shared) - 1))
        ok = shared[at] == h if len(shared) else np.zeros(len(h), bool)
        order = np.argsort(at[ok], kind="stable")
        sides.append((row[ok][order], at[ok][order]))
    for c in range(0, len(shared), COLUMNS):
        dense = []
        for (row, at), sets in zip(sides, (xs, ys), strict=True):
            part = slice(*np.searchsorted(at, (c, c + COLUMNS)))
            m = np.zeros((len(sets), min(COLUMNS, len(shared) - c)), np.float32)
            m[row[part], at[part] - c] = 1
            dense.append(m)
        out += dense[0] @ dense[1].T
    return out


def _meet(num: int, den: int):
    """For a block of members apart and a block of their family: (a, b) of components that links between the blocks join."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(xs: pa.Table, ys: pa.Table) -> pa.Table:
        side = lambda t: ([np.frombuffer(v.as_buffer(), np.int64) for v in t.column("set").combine_chunks()], t.column("c").to_numpy(), t.column("n").to_numpy())
        if not xs.num_rows or not ys.num_rows:
            return schema.empty_table()
        (x, xc, xn), (y, yc, yn) = side(xs), side(ys)
        both = _overlaps(x, y).astype(np.int64)
        p, q = np.nonzero((den * both >= num * (xn[:, None] + yn[None, :] - both)) & (xc[:, None] != yc[None, :]))
        names, at = np.unique(np.concatenate([xc, yc]), return_inverse=True)
        a, b = _spanning(at[p], at[len(x) + q], len(names))
        return pa.Table.from_arrays([pa.array(names[a]), pa.array(names[b])], schema=schema)

    return run


def _apart(members: DataFrame, labels: DataFrame, texts: DataFrame, num: int, den: int, k: int) -> DataFrame:
    """(a, b): components that links of members apart from their family's main component join.

    ``members``: (id, f), ``labels``: (id, c) of members that aren't their component's smallest.
    """
    now = members.join(labels, "id", "left").withColumn("c", F.coalesce("c", "id"))
    main = now.groupBy("f", "c").agg(F.count("*").alias("held")).groupBy("f").agg(F.max_by("c", F.struct("held", "c")).alias("main"), F.max("held").alias("held"), F.sum("held").alias("whole"))
    main = main.filter("held < whole").select("f", "main", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    now = now.withColumn("salt", F.pmod(F.hash("id"), F.lit(SALT))).join(main, ["f", "salt"]).select("id", "f", "c", "main")
    named = texts.join(now.select("id", "f", "c", (F.col("c") == F.col("main")).alias("in_main")), "id").select("id", "f", "c", "in_main", "text")
    sets = materialize(named.mapInArrow(_hashes(k), "id long, f long, c long, in_main boolean, n long, set binary").withColumn("key", F.xxhash64("set")))
    alone = sets.select("key", "f", "set").mapInArrow(_holders, "f long, h long, key long, holders long").groupBy("f", "h").agg(F.min("key").alias("key"), F.sum("holders").alias("holders"))
    alone = alone.filter("holders = 1").groupBy("f", "key").agg(F.count("*").alias("own"))
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(den / num)) + 1e-9).cast("int")
    fit = sets.join(alone, ["f", "key"], "left").filter(F.col("n") * num <= (F.col("n") - F.coalesce("own", F.lit(0))) * den)
    fit = materialize(fit.select("id", "f", "c", "in_main", "n", "set", band.alias("band")))

    def blocks(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """Rows with their block, and the blocks."""
        sizes = rows.groupBy("f", "band").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
        each = sizes.select("f", F.col("band").alias(f"band_{name}"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias(name))
        dealt = sizes.select("f", "band", "blocks", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
        at = rows.withColumn("salt", F.pmod(F.hash("id"), F.lit(SALT))).join(dealt, ["f", "band", "salt"])
        return at.select("id", "f", "c", "n", "set", F.col("band").alias(f"band_{name}"), F.pmod(F.xxhash64("id"), F.col("blocks")).alias(name)), each

    xs, x_blocks = blocks(fit.filter("not in_main"), "x")
    ys, y_blocks = blocks(fit, "y")
    pairs = materialize(x_blocks.join(y_blocks, "f").filter("abs(band_x - band_y) <= 1"))
    key = ["f", "band_x", "x", "band_y", "y"]
    left, right = (rows.join(pairs, ["f", f"band_{v}", v]).select(*(F.col(c).alias(c) for c in (*key, "c", "n", "set"))) for rows, v in ((xs, "x"), (ys, "y")))
    return materialize(left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_meet(num, den), "a long, b long").distinct())


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id_col, n_shingles, component_id (smallest id reachable by links), kept.

    Words are maximal runs without ASCII white space, lower-cased A-Z. Null and empty texts have no shingles and link
    with nothing. Rows that share an id are one vertex. A null id links with nothing: its component is null, kept true.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sig = materialize(plain.mapInArrow(_signatures(k), "id long, n long, k1 long, k2 long, bands array<long>, sketch binary"))
    some = sig.filter("n > 0 and id is not null")
    classes = materialize(some.groupBy("k1", "k2", "n").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")))
    sketches = classes.select(F.col("rep").alias("id"), "n", "sketch")

    a, b = F.slice("bands", 1, SIDE), F.slice("bands", SIDE + 1, SIDE)
    keys = F.flatten(F.transform(a, lambda x, i: F.transform(b, lambda y, j: F.xxhash64(x, y, i * SIDE + j))))
    cells = classes.select("rep", F.explode(keys).alias("cell"))
    leads = cells.groupBy("cell").agg(F.min("rep").alias("lead"), F.count("*").alias("size")).filter("size > 1")
    buckets = materialize(cells.join(leads, "cell"))

    x, y = (sketches.select(F.col("id").alias(v), F.col("n").alias("n" + v), F.col("sketch").alias("s" + v)) for v in "ab")

    def agreeing(pairs: DataFrame) -> DataFrame:
        shares = pairs.join(x, "a").join(y, "b").select("a", "b", "sa", "sb").mapInArrow(_agreement, "a long, b long, share double")
        return materialize(shares.join(x.select("a", "na"), "a").join(y.select("b", "nb"), "b"))

    def off(rows: DataFrame, family: DataFrame) -> DataFrame:
        """Rows (cell, lead, id, size) whose member is of another family than the bucket's leader."""
        own, lead = (family.select(F.col("v").alias(v), F.col("c").alias("c_" + v)) for v in ("id", "lead"))
        named = rows.join(own, "id", "left").join(lead, "lead", "left")
        return materialize(named.filter(F.coalesce("c_id", "id") != F.coalesce("c_lead", "lead")).select("cell", "lead", "id", "size"))

    buckets = buckets.withColumnRenamed("rep", "id")
    followers = buckets.filter("id > lead")
    stars = agreeing(followers.groupBy(F.col("id").alias("b")).agg(F.min("lead").alias("a")))
    other = off(followers, components(stars))
    stars = stars.unionByName(agreeing(other.select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()))
    family = components(stars)
    cells = off(other.filter("size > 2"), family)
    rest = buckets.join(cells.select("cell").distinct(), "cell", "left_semi").join(family.withColumnRenamed("v", "id"), "id", "left").withColumn("c", F.coalesce("c", "id")).join(sketches, "id")
    wider = materialize(_block_pairs(rest, "cell", "size").mapInArrow(_families, "a long, b long").distinct())
    if not wider.isEmpty():
        family = components(stars.select("a", "b").unionByName(wider))
    for done in (buckets, other, cells, wider):
        drop(done)
    family = family.toDF("id", "f")
    family = family.unionByName(family.select(F.col("f").alias("id"), "f").distinct())
    # ids of families grow with the corpus, so they meet the texts in a sort-merge join at every size
    texts = materialize(plain.join(family.hint("merge"), "id", "left_semi").dropDuplicates(["id", "text"]))
    tx, ty = (texts.select(F.col("id").alias(v), F.col("text").alias("t" + v)) for v in "ab")

    def linked(pairs: DataFrame) -> DataFrame:
        return materialize(pairs.join(tx, "a").join(ty, "b").select("a", "b", "ta", "tb").mapInArrow(_similar(num, den, k), "a long, b long"))

    edges = linked(stars.filter(F.least("na", "nb") * den >= F.greatest("na", "nb") * num).filter(F.col("share") >= AGREE).select("a", "b"))
    labels = components(edges)
    more = _apart(family, labels.toDF("id", "c"), texts, num, den, k)
    if not more.isEmpty():
        labels = components(edges.unionByName(more))
    drop(texts)

    named = classes.join(labels.select(F.col("v").alias("rep"), "c"), "rep", "left").filter("copies > 1 or c is not null").select("k1", "k2", "n", F.coalesce("c", "rep").alias("c"))
    out = sig.select("id", "n", "k1", "k2").join(named, ["k1", "k2", "n"], "left")
    c = F.when((F.col("n") > 0) & F.col("id").isNotNull() & F.col("c").isNotNull(), F.col("c")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), c.alias("component_id"), F.col("id").eqNullSafe(c).alias("kept"))


def op7_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: 2-word shingles, similarity 0.8."""
    return near_duplicates(table(spark, sf_dir, "documents"), k=2)
