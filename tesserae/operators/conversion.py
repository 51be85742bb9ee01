"""Converting examples, triplets and boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPLITS = {"train": "train", "test": "valid"}


def corpus_lookup(examples: DataFrame, corpus: DataFrame, key: str, ids: str, out: str) -> DataFrame:
    """(key, out): the (title, contents) of each listed corpus position, in list order.

    Ids outside the corpus are dropped. ``corpus`` has doc_idx, title, contents.
    """
    flat = examples.select(key, F.posexplode(ids).alias("pos", "id")).select(key, "pos", F.expr("try_cast(id as bigint)").alias("doc_idx"))
    found = flat.join(corpus, "doc_idx").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "title", "contents"))).alias("found"))
    docs = F.transform("found", lambda x: F.struct(x["title"].alias("title"), x["contents"].alias("contents")))
    none = F.array().cast("array<struct<title:string,contents:string>>")
    return examples.select(key).distinct().join(found, key, "left").select(key, F.coalesce(docs, none).alias(out))


def convert_examples(examples: DataFrame, corpus: DataFrame, key: str = "query") -> DataFrame:
    """query, pos_docs, neg_docs from query, positives.doc_id, negatives.doc_id."""
    parts = examples.select(key, F.col("positives.doc_id").alias("p"), F.col("negatives.doc_id").alias("n"))
    return corpus_lookup(parts, corpus, key, "p", "pos_docs").join(corpus_lookup(parts, corpus, key, "n", "neg_docs"), key)


def triplets(qrels: DataFrame, queries: DataFrame, passages: DataFrame) -> DataFrame:
    """query, passage, label of judged pairs whose both sides exist."""
    return qrels.join(queries, "qid").join(passages, "pid").select("query", "passage", F.col("rel").alias("label"))


def negatives(positives: DataFrame, passages: int, per_positive: int, pick: Column) -> DataFrame:
    """(qid, pid) drawn ``per_positive`` times for each positive and kept unless judged for the query.

    ``pick`` maps qid, pid and draw (1, 2, ...) to a passage number below ``passages``.
    """
    drawn = positives.select("qid", "pid", F.explode(F.sequence(F.lit(1), F.lit(per_positive))).alias("draw")).withColumn("pick", F.pmod(pick, F.lit(passages)))
    judged = positives.select("qid", F.col("pid").alias("pick"))
    return drawn.join(judged, ["qid", "pick"], "left_anti").select("qid", F.col("pick").alias("pid"), "draw")


def normalized_boxes(annotations: DataFrame, images: DataFrame) -> DataFrame:
    """image_id, file_name, class, cx, cy, w, h in shares of the image; an annotation without its image is an error."""
    x, y, w, h = (F.col("bbox")[i].cast("double") for i in range(4))
    joined = annotations.join(images, "image_id", "left")
    known = F.when(F.col("file_name").isNotNull(), F.col("file_name")).otherwise(F.raise_error(F.concat(F.lit("no image "), F.col("image_id").cast("string"))))
    return joined.select("image_id", known.alias("file_name"), (F.col("category_id") - 1).alias("class"), ((x + w / 2) / F.col("width")).alias("cx"), ((y + h / 2) / F.col("height")).alias("cy"), (w / F.col("width")).alias("w"), (h / F.col("height")).alias("h"))


def box_lines(boxes: DataFrame, split: str) -> DataFrame:
    """(split, label_file, line) for ``write_boxes``."""
    return boxes.select(F.lit(SPLITS.get(split, split)).alias("split"), F.replace("file_name", F.lit(".png"), F.lit(".txt")).alias("label_file"), F.concat_ws(" ", "class", "cx", "cy", "w", "h").alias("line"))


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("count")).orderBy(F.desc("count"), column)


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    rest = F.struct(*[c for c in rows.columns if c != key])
    return rows.groupBy(key).agg(F.max_by(rest, order).alias("r")).select(key, "r.*")


def first_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key, with how many more it had as ``repeats``."""
    rest = F.struct(*[c for c in rows.columns if c != key])
    return rows.groupBy(key).agg(F.min_by(rest, order).alias("r"), (F.count("*") - 1).alias("repeats")).select(key, "r.*", "repeats")


def nested_qrels(qrels: DataFrame) -> DataFrame:
    """(qid, judged: map pid -> rel)."""
    return qrels.groupBy("qid").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("pid", "rel")))).alias("judged"))


def first_keys(rows: DataFrame, key: str, order: str, count: int) -> DataFrame:
    """(key, at) of the first ``count`` different keys in the order they appear; ``at`` numbers them by their names as strings."""
    first = rows.groupBy(F.col(key).cast("string").alias(key)).agg(F.min(order).alias("_first")).orderBy("_first", key).limit(count)
    return first.select(key, F.row_number().over(Window.orderBy(key)).cast("long").alias("at"))  # ``count`` rows
