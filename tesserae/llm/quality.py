"""Quality classifier: ordinal cumulative-link regression on graded ratings.

All grades share one weight per hashed text feature; ordered thresholds split the score: P(grade <= j) = s(t_j - w.x).
The expected grade and the tail probability P(grade >= keep) select documents. Features are 64-bit hashes of words,
of word beginnings and of levels that shape shares reach, each present or not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.llm import kernels as K
from tesserae.llm.store import table

#: Labelled rows (hash-ordered) that a fit uses at most, features of each that it uses at most (those of the lowest
#: hashes; scoring uses all), and rows in which a feature must occur.
FIT_ROWS, FIT_FEATURES, FIT_DF = 6_000, 16_384, 4
STEPS, RATE, DECAY = 100, 0.12, 5e-4
#: Grades: 0 toxic, 1 poor, 2 good. A document is selected if P(grade >= KEEP_GRADE) reaches KEEP_TAIL.
GRADES, KEEP_GRADE, KEEP_TAIL = 3, 2, 0.5
_PREFIXES = (6,)
_UPPER, _MARK, _DIGIT = np.zeros(256, np.int64), np.zeros(256, np.int64), np.zeros(256, np.int64)
_UPPER[65:91] = 1
_DIGIT[48:58] = 1
_MARK[33:48] = _MARK[58:65] = _MARK[91:97] = _MARK[123:127] = 1
#: Levels that each share of a text may reach; every level reached is a feature.
_LEVELS = np.array([0.005, 0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.3, 0.45, 0.6, 0.8])


def features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per chunk of texts: feature hashes and the row of each (rows count within the chunk, repeats remain)."""
    for i, j, buf, offs in K.chunks(column):
        low = K.LOWER[buf]
        s, e, rows = K.word_spans(low, offs, K.ALNUM_BYTES)
        n, count = j - i, np.diff(rows)
        words = K.span_hashes(low, s, e)
        parts = [words]
        for p in _PREFIXES:
            long = e - s > p
            parts.append(np.where(long, K.mix(K.span_hashes(low, s, np.minimum(e, s + p)) + np.uint64(p)), np.uint64(0)))
        doc = np.repeat(np.arange(n), count)
        total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x[buf])])[offs])
        size = np.maximum(np.diff(offs), 1)
        again = np.zeros(n, np.int64)
        if len(words) > 1:
            same = np.concatenate([[False], (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])])
            again = np.bincount(doc, same, n).astype(np.int64)
        letters = np.bincount(doc, e - s, n)
        shape = np.stack([total(_UPPER) / size, total(_MARK) / size, total(_DIGIT) / size, again / np.maximum(count, 1), letters / np.maximum(count, 1) / 16, np.log2(count + 1) / 16])
        kind, level, at_row = np.nonzero(shape[:, None, :] >= _LEVELS[None, :, None])
        tag = K.mix((kind * 64 + level + 1).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))
        h = np.concatenate([*parts, tag])
        at = np.concatenate([doc] * len(parts) + [at_row])
        ok = h != 0
        yield h[ok], at[ok], n


class Model:
    """Feature hashes with weights, and the ordered thresholds."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, cuts: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.weights, self.cuts = keys[order], weights[order].astype(np.float64), cuts

    def tails(self, column: pa.Array) -> np.ndarray:
        """P(grade >= j), j = 1 .. grades - 1, of each text."""
        score = []
        for h, row, n in features(column):
            f = np.minimum(np.searchsorted(self.keys, h), max(0, len(self.keys) - 1))
            ok = self.keys[f] == h if len(self.keys) else np.zeros(len(h), bool)
            pair = np.unique(row[ok] * np.int64(len(self.keys)) + f[ok])
            score.append(np.bincount(pair // len(self.keys), self.weights[pair % len(self.keys)], n) if len(pair) else np.zeros(n))
        x = np.concatenate(score) if score else np.zeros(0)
        return 1 / (1 + np.exp(np.clip(self.cuts[None, :] - x[:, None], -60, 60)))


def fit_arrays(rows: list[np.ndarray], grades: np.ndarray, levels: int = GRADES) -> Model:
    """Fits weights and thresholds to sets of feature hashes by Adam on the whole likelihood."""
    n = len(rows)
    keys, col = np.unique(np.concatenate([*rows, np.zeros(0, np.uint64)]), return_inverse=True)
    row = np.repeat(np.arange(n), [len(r) for r in rows])
    often = np.bincount(col, minlength=len(keys)) >= min(FIT_DF, max(1, n // 50))
    place = np.cumsum(often) - 1
    ok = often[col] if n else np.zeros(0, bool)
    keys, col, row = keys[often], place[col[ok]], row[ok]
    share = np.bincount(grades, minlength=levels) + 1.0
    below = np.cumsum(share)[:-1] / share.sum()
    cuts = np.log(below / (1 - below))
    gaps = np.log(np.maximum(np.diff(cuts), 1e-3))  # thresholds stay ordered: the first one and logs of the steps
    theta = np.concatenate([np.zeros(len(keys)), cuts[:1], gaps])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    k = len(keys)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for step in range(1, STEPS + 1 if n else 1):
        w = theta[:k]
        cuts = np.concatenate([theta[k : k + 1], theta[k] + np.cumsum(np.exp(theta[k + 1 :]))])
        z = np.bincount(row, w[col], n)
        edge = sigmoid(np.concatenate([np.full((n, 1), -40.0), cuts[None, :] - z[:, None], np.full((n, 1), 40.0)], axis=1))
        upper, lower = edge[np.arange(n), grades + 1], edge[np.arange(n), grades]
        p = np.maximum(upper - lower, 1e-9)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
        gz = (du - dl) / n
        gw = np.bincount(col, gz[row], k) + DECAY * w
        gc = np.zeros(levels - 1)
        for j in range(levels - 1):
            gc[j] = (-du[grades == j].sum() + dl[grades == j + 1].sum()) / n
        tail = np.cumsum(gc[::-1])[::-1]
        grad = np.concatenate([gw, tail[:1], tail[1:] * np.exp(theta[k + 1 :])])
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad * grad
        theta -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    cuts = np.concatenate([theta[k : k + 1], theta[k] + np.cumsum(np.exp(theta[k + 1 :]))])
    heavy = np.abs(theta[:k]) > 0.01
    return Model(keys[heavy], theta[:k][heavy], cuts)


def _feature_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = []
        for h, row, n in features(batch.column(2)):
            order = np.lexsort((h, row))
            h, row = h[order], row[order]
            sets += [np.unique(part)[:FIT_FEATURES].tobytes() for part in np.split(h, np.searchsorted(row, np.arange(1, n)))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.binary())], names=["id", "grade", "hashes"])


def fit(docs: DataFrame, ratings: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Fits to at most ``rows`` rated documents: ``ratings`` (doc_id, grade 0..); hash order makes it the same sample each time.

    Rows with a null id, grade or text take no part; of rows that share an id the least text takes part, of ratings the
    lowest. Without any rated document every text gets even odds.
    """
    rated = ratings.dropna(subset=["doc_id", "grade"]).groupBy("doc_id").agg(F.min("grade").alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").dropna().join(F.broadcast(rated), "doc_id").groupBy("doc_id", "grade").agg(F.min("text").alias("text")).select(F.col("doc_id").alias("id"), F.col("grade").cast("long").alias("grade"), "text")
    got = sorted((r["id"], r["grade"], bytes(r["hashes"])) for r in texts.mapInArrow(_feature_sets, "id long, grade long, hashes binary").toLocalIterator())
    return fit_arrays([np.frombuffer(h, np.uint64) for _, _, h in got], np.array([g for _, g, _ in got], np.int64))


def _score(model, keep_tail: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tails = model.value.tails(batch.column(batch.schema.get_field_index("text")))
            good = tails[:, KEEP_GRADE - 1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tails.sum(1)), pa.array(good), pa.array(good >= keep_tail)], names=[*batch.schema.names, "expected_grade", "p_good", "selected"])

    return run


def grade_documents(docs: DataFrame, model: Model, keep_tail: float = KEEP_TAIL) -> DataFrame:
    """``docs`` with expected_grade, p_good and selected. A null or empty text has shape features only.

    Columns of ``docs`` with these names are replaced. Repeated rows get equal grades; a text of any length is read
    whole, in chunks.
    """
    plain = docs.drop("expected_grade", "p_good", "selected")
    schema = T.StructType([*plain.schema.fields, T.StructField("expected_grade", T.DoubleType()), T.StructField("p_good", T.DoubleType()), T.StructField("selected", T.BooleanType())])
    return plain.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model), keep_tail), schema)


def selected(docs: DataFrame, model: Model, keep_tail: float = KEEP_TAIL) -> DataFrame:
    """The selected rows of ``docs``, with all their columns and no others."""
    state = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tails = state.value.tails(batch.column(batch.schema.get_field_index("text")))
            yield batch.filter(pa.array(tails[:, KEEP_GRADE - 1] >= keep_tail))

    return docs.mapInArrow(run, docs.schema)


def ratings(labels: DataFrame) -> DataFrame:
    """Grades of the labels table: 0 toxic, 1 of poor quality, 2 good."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), grade.alias("grade"))


def op6_ordinal_quality(spark, sf_dir: str) -> DataFrame:
    """Expected grade, tail probability and selection of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, ratings(table(spark, sf_dir, "labels")))
    return grade_documents(docs, model).select("doc_id", "expected_grade", "p_good", "selected")
