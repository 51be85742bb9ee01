"""Vector expressions over array columns; sums are in double precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product; null if either is null."""
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def components(v: Column, width: int, name: str) -> list[Column]:
    """A double column per component, ``name`` and its place; the first is null if ``v`` has another width or holds null."""
    whole = (F.size(v) == width) & ~F.exists(v, lambda x: x.isNull())
    part = lambda i: F.get(v, F.lit(i)).cast("double")
    return [F.when(whole, part(0)).alias(f"{name}0"), *(F.coalesce(part(i), F.lit(0.0)).alias(f"{name}{i}") for i in range(1, width))]


def dot_of(a: str, b: str, width: int) -> Column:
    """``dot`` of vectors that ``components`` took apart: the same products, added in the same order."""
    total = F.lit(0.0)
    for i in range(width):
        total = total + F.col(f"{a}{i}") * F.col(f"{b}{i}")
    return total


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalize(v: Column, epsilon: float = 1e-12) -> Column:
    """Unit-length vector; one shorter than ``epsilon`` is divided by ``epsilon``."""
    length = F.greatest(norm(v), F.lit(epsilon))
    return F.transform(doubles(v), lambda x: x / length)


def mean_pool(tokens: Column) -> Column:
    """Element-wise mean of an array of equally long vectors."""
    n = F.size(tokens)
    return F.transform(F.sequence(F.lit(1), F.size(F.get(tokens, 0))), lambda i: F.aggregate(tokens, F.lit(0.0), lambda s, t: s + F.element_at(t, i.cast("int")).cast("double")) / n)


def first_token(tokens: Column) -> Column:
    return F.try_element_at(tokens, F.lit(1))


def argmax(v: Column) -> Column:
    """Zero-based place of the largest value, the first of equals."""
    return F.array_position(v, F.array_max(v)) - 1


def log_sum_exp(v: Column) -> Column:
    top = F.array_max(v)
    return top + F.log(F.aggregate(v, F.lit(0.0), lambda s, x: s + F.exp(x - top)))


def cross_entropy(scores: Column, label: Column) -> Column:
    """Of a row of scores against a zero-based label."""
    return log_sum_exp(scores) - F.element_at(scores, (label + 1).cast("int"))


def parse_preset(text: Column) -> Column:
    """Numbers of a comma-separated list; null for an empty selection."""
    return F.when(F.trim(text) != "", F.transform(F.split(text, ","), lambda x: F.trim(x).cast("double")))


def circular_slice(values: Column, offset: Column, count: Column) -> Column:
    """``count`` elements from ``offset`` on, going round; empty for an empty array."""
    take = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.element_at(values, (F.pmod(offset + i, F.size(values)) + 1).cast("int")))
    return F.when((F.size(values) > 0) & (count > 0), take).otherwise(F.slice(values, 1, 0))


def standardize(x: Column, mean: float, deviation: float) -> Column:
    """(x - mean) / deviation."""
    return (x - mean) / deviation


def flattened(rows: DataFrame, row: str, vector: str, width: int) -> DataFrame:
    """(at, value): the components of all vectors in row-major order; ``row`` numbers vectors from 0."""
    return rows.select(row, F.posexplode(vector).alias("i", "value")).select((F.col(row) * width + F.col("i")).alias("at"), "value")
