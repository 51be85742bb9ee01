"""Readers with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.text import normalize_quotes, parse_list_literal, shard_numbers, tab_fields

PASSAGES = "title string, contents string"
EXAMPLES = "query string, positives struct<doc_id:array<string>>, negatives struct<doc_id:array<string>>"
CONVERTED = "query string, pos_docs array<struct<title:string,contents:string>>, neg_docs array<struct<title:string,contents:string>>"
COCO = "annotations array<struct<image_id:bigint,category_id:bigint,bbox:array<double>>>, images array<struct<id:bigint,file_name:string,height:bigint,width:bigint>>"


def check_path(path: str, *endings: str) -> str:
    if not path.rstrip("/").endswith(endings):
        raise ValueError(f"{path}: expected a name that ends in {' or '.join(endings)}")
    return path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, gzipped or not; a malformed line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def splits(spark: SparkSession, schema: str, **paths: str) -> DataFrame:
    """Rows of several files, each with its name as ``split``."""
    parts = [jsonl(spark, path, schema).withColumn("split", F.lit(name)) for name, path in paths.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) of the non-empty lines of text files; ``line_no`` sorts by file and line.

    Large files are read in splits: a line's place is its file, where its split starts and its order within the split.
    """
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    return spark.read.text(path).select(at.alias("line_no"), "value").filter(F.trim("value") != "")


def _fields(spark: SparkSession, path: str, count: int) -> DataFrame:
    rows = numbered_lines(spark, path).withColumn("f", tab_fields(F.col("value")))
    wrong = F.raise_error(F.concat(F.lit(f"expected {count} fields: "), F.col("value")))
    return rows.withColumn("f", F.when(F.size("f") == count, F.col("f")).otherwise(wrong))


def queries_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(qid, query); the last line of a repeated id counts."""
    rows = _fields(spark, check_path(path, ".tsv"), 2).select("line_no", F.col("f")[0].alias("qid"), F.col("f")[1].alias("query"))
    return rows.groupBy("qid").agg(F.max_by("query", "line_no").alias("query"))


def answers_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(question, answers); the first line of a repeated question counts. Answers are a list literal."""
    rows = _fields(spark, check_path(path, ".tsv"), 2).select("line_no", normalize_quotes(F.col("f")[0]).alias("question"), normalize_quotes(F.col("f")[1]).alias("answers"))
    first = rows.groupBy("question").agg(F.min_by("answers", "line_no").alias("answers"))
    return first.withColumn("answers", parse_list_literal("answers"))


def qrels_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(qid, pid, rel); the last line of a repeated pair counts."""
    rows = _fields(spark, check_path(path, ".txt", ".tsv"), 4).select("line_no", F.col("f")[0].alias("qid"), F.col("f")[2].alias("pid"), F.col("f")[3].cast("int").alias("rel"))
    return rows.groupBy("qid", "pid").agg(F.max_by("rel", "line_no").alias("rel"))


def run_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(qid, pid, rank, score); without a fourth field the score is 1 / rank to 4 places."""
    f = numbered_lines(spark, check_path(path, ".txt", ".tsv")).select(tab_fields(F.col("value")).alias("f"))
    rank = F.col("f")[2].cast("int")
    return f.select(F.col("f")[0].alias("qid"), F.col("f")[1].alias("pid"), rank.alias("rank"), F.when(F.size("f") == 3, F.round(1 / rank, 4)).otherwise(F.try_element_at("f", F.lit(4)).cast("double")).alias("score"))


def coco(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Annotations and images of a COCO-style file; of a repeated image id the last counts."""
    whole = spark.read.schema(COCO).option("multiLine", True).option("mode", "FAILFAST").json(check_path(path, ".json"))
    images = whole.select(F.posexplode("images").alias("at", "i")).select("at", "i.*").groupBy("id").agg(F.max_by(F.struct("file_name", "height", "width"), "at").alias("i")).select(F.col("id").alias("image_id"), "i.*")
    return whole.select(F.inline("annotations")), images


def vector_shards(spark: SparkSession, path: str) -> DataFrame:
    """Vectors of Parquet shards named shard_<worker>_<n>, with worker, shard and row as columns; none found is an error."""
    worker, shard = shard_numbers(F.col("_metadata.file_path"))
    rows = spark.read.option("pathGlobFilter", "shard_*_*").option("recursiveFileLookup", True).parquet(path)
    return rows.select(worker.alias("worker"), shard.alias("shard"), F.col("_metadata.row_index").alias("row"), *rows.columns)


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes) of files, from listings alone."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("bytes"))


def object_store(builder, endpoint: str | None = None):
    """A session builder with the S3A connector fed by the environment's credentials."""
    conf = {"spark.hadoop.fs.s3a.aws.credentials.provider": "software.amazon.awssdk.auth.credentials.EnvironmentVariableCredentialsProvider"}
    return builder.config(map=conf | ({"spark.hadoop.fs.s3a.endpoint": endpoint, "spark.hadoop.fs.s3a.path.style.access": "true"} if endpoint else {}))
