"""Deterministic synthetic tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BANK = ("amber", "basin", "cedar", "delta", "ember", "fjord", "grove", "harbor", "island", "juniper", "kernel", "lattice", "meadow", "nimbus", "orchid", "prairie", "quartz", "ridge", "summit", "tundra")


def words(row: Column, count: int, seed: int, bank: tuple[str, ...] = BANK) -> Column:
    """``count`` bank words of a row."""
    names = F.array(*[F.lit(w) for w in bank])
    pick = lambda i: F.element_at(names, (F.pmod(F.xxhash64(row, i, F.lit(seed)), F.lit(len(bank))) + 1).cast("int"))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(count)), pick), " ")


def gaussians(row: Column, width: int, seed: int, kind: str = "float") -> Column:
    """``width`` standard normal numbers of a row, by Box and Muller from hashes."""
    unit = lambda i, part: (F.pmod(F.xxhash64(row, i, F.lit(seed), F.lit(part)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: (F.sqrt(-2 * F.log(unit(i, 0))) * F.cos(2 * F.pi() * unit(i, 1))).cast(kind))


def text_table(spark: SparkSession, rows: int, text_words: int = 500, query_words: int = 10, width: int = 1024, seed: int = 0) -> DataFrame:
    """text, query, embedding."""
    row = F.col("id")
    return spark.range(rows).select(words(row, text_words, seed).alias("text"), words(row, query_words, seed + 1).alias("query"), gaussians(row, width, seed).alias("embedding"))


def user_table(spark: SparkSession, rows: int, seed: int = 0) -> DataFrame:
    """text, query, features (50 doubles), user_id in [0, 2^32), email."""
    row = F.col("id")
    user = F.pmod(F.xxhash64(row, F.lit(seed)), F.lit(1 << 32))
    return spark.range(rows).select(words(row, 500, seed).alias("text"), words(row, 10, seed + 1).alias("query"), gaussians(row, 50, seed, "double").alias("features"), user.cast("decimal(20,0)").alias("user_id"), F.concat(F.lit("user"), user.cast("string"), F.lit("@example.org")).alias("email"))


def toy_table(spark: SparkSession) -> DataFrame:
    """id 0 to 4."""
    return spark.range(5).select(F.col("id"))


def user_records(spark: SparkSession) -> DataFrame:
    """Two nested records."""
    schema = "id int, name string, email string, tags array<string>, attributes map<string,bigint>"
    return spark.createDataFrame([(123, "Alice", "alice@example.com", ["rust", "parquet"], {"score": 100, "visits": 42}), (456, "Bob", None, ["thrift"], None)], schema)
