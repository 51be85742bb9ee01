"""Corpus pipeline: quality, near-dedup, decontamination, PII, mix. Each stage reads what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import decontaminate, minhash, mixing, pii, quality
from tesserae.llm.store import drop, materialize, scratch, table


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the best grade reaches the threshold; poor and toxic ones go."""
    model = quality.fit(docs, quality.ratings(table(spark, sf_dir, "labels")))
    return quality.selected(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each component of near duplicates (5-word shingles, similarity 0.8).

    Rows without an id stay; of rows that share an id one stays.
    """
    found = materialize(minhash.near_duplicates(docs, k=5))
    gone = found.filter("not kept").select("doc_id").distinct()
    repeated = found.dropna(subset=["doc_id"]).groupBy("doc_id").count().filter("count > 1")
    kept = docs.join(gone, "doc_id", "left_anti")
    if not repeated.isEmpty():
        kept = kept.dropna(subset=["doc_id"]).dropDuplicates(["doc_id"]).unionByName(kept.filter("doc_id is null"))
    return kept.select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates in place of personal data; n_chars follows the text."""
    return pii.pseudonymize(docs, count=False).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents once per copy that the mix takes."""
    return mixing.mixed(docs)


STAGES = [
    ("quality", select_quality),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", replace_personal_data),
    ("mix", mix_sources),
]

#: The classifier and the rewriting have no SQL form; tests compare stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; a stage's own tables go when its result is written, and that when the next one is."""
    source = docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            done = keep(stage(spark, docs, sf_dir))
        if docs is not source:
            drop(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
