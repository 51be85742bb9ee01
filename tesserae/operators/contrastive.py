"""In-batch contrastive scores and losses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions.vectors import cross_entropy, dot


def batch_scores(left: DataFrame, right: DataFrame, temperature: float = 1.0, mask_self: bool = False) -> DataFrame:
    """(batch, i, j, score) of all pairs within each batch; rows are (batch, i, vector). A masked diagonal is -inf."""
    a, b = left.select("batch", "i", F.col("vector").alias("va")), right.select("batch", F.col("i").alias("j"), F.col("vector").alias("vb"))
    score = dot(F.col("va"), F.col("vb")) / temperature
    return a.join(b, "batch").select("batch", "i", "j", F.when((F.col("i") == F.col("j")) & F.lit(mask_self), float("-inf")).otherwise(score).alias("score"))


def score_rows(*blocks: DataFrame) -> DataFrame:
    """(batch, i, scores): the blocks' scores of each row side by side."""
    out = None
    for n, block in enumerate(blocks):
        row = block.groupBy("batch", "i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "score"))), lambda x: x["score"]).alias(f"s{n}"))
        out = row if out is None else out.join(row, ["batch", "i"])
    return out.select("batch", "i", F.concat(*[f"s{n}" for n in range(len(blocks))]).alias("scores"))


def contrastive_loss(rows: DataFrame, label) -> DataFrame:
    """(batch, loss): mean cross-entropy of score rows against a zero-based label column."""
    return rows.groupBy("batch").agg(F.avg(cross_entropy(F.col("scores"), label)).alias("loss"))
