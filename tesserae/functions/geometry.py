"""Plane geometry and schedule expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Determinants within this distance of zero count as degenerate.
TOLERANCE = 1e-9


def linear_map(x: Column, y: Column, a: float, b: float, c: float, d: float) -> tuple[Column, Column]:
    return a * x + b * y, c * x + d * y


def swirl(x: Column, y: Column, strength: float = 0.3) -> tuple[Column, Column]:
    """A non-linear map: each point turns by an angle that grows with its squared distance."""
    r = strength * F.pi() * (x * x + y * y)
    return x * F.cos(r) - y * F.sin(r), x * F.sin(r) + y * F.cos(r)


def map_points(points: DataFrame, fn: Callable[[Column, Column], tuple[Column, Column]], x: str = "x", y: str = "y") -> DataFrame:
    """``points`` with x and y replaced by any function of both."""
    u, v = fn(F.col(x), F.col(y))
    return points.withColumns({x: u, y: v})


def determinant(a: Column, b: Column, c: Column, d: Column) -> Column:
    return a * d - b * c


def orientation(det: Column) -> Column:
    return F.when(F.abs(det) < TOLERANCE, "degenerate").when(det > 0, "preserved").otherwise("reversed")


def segment(points: int, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """``points`` evenly spaced (x, y) of a segment, both ends included."""
    t = lambda i: i / F.lit(points - 1.0)
    return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.struct((x0 + (x1 - x0) * t(i)).alias("x"), (y0 + (y1 - y0) * t(i)).alias("y")))


def grid(spark: SparkSession, low: int = -2, high: int = 2, points: int = 5) -> DataFrame:
    """Axis-aligned grid lines: axis, line, step, x, y."""
    lines = spark.range(low, high + 1).toDF("line")
    steps = lines.select("line", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(points - 1).cast("long"))).alias("step"))
    t = F.lit(float(low)) + F.col("step") * F.lit((high - low) / (points - 1))
    at = F.col("line").cast("double")
    return steps.select(F.lit("v").alias("axis"), "line", "step", at.alias("x"), t.alias("y")).unionByName(steps.select(F.lit("h").alias("axis"), "line", "step", t.alias("x"), at.alias("y")))


def view_extent(x: str = "x", y: str = "y", margin: float = 1.15, least: float = 2.2) -> Column:
    """Aggregate: the largest coordinate with a margin, never below ``least``."""
    return F.greatest(F.lit(least), F.max(F.greatest(F.abs(x), F.abs(y))) * margin)


def warmup_linear(step: Column, warmup: int, total: int, start: float = 0.5) -> Column:
    """Rate factor: from ``start`` up to 1 over the warm-up, then straight down to 0."""
    rising = F.lit(start) + (1 - start) * step / F.lit(float(max(1, warmup)))
    falling = F.greatest(F.lit(0.0), (F.lit(float(total)) - step) / F.lit(float(max(1, total - warmup))))
    return F.when(step < warmup, rising).otherwise(falling)


def step_decay(epoch: Column, gamma: float) -> Column:
    return F.pow(F.lit(gamma), epoch)
