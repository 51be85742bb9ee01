"""Registered queries that write a format and read it back, and further arithmetic, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions import bits, text, vectors
from tesserae.operators import contrastive, conversion, sampling
from tesserae.plans.registry import _batches, _files, _t, query
from tesserae.session import shared_dir
from tesserae.sources import parquet_meta, parquet_values, readers, sinks, synthetic


def _place(spark, ending: str) -> str:
    return f"{shared_dir(spark)}/exchange/{uuid.uuid4().hex}{ending}"


def _lines(df: DataFrame, order: str, *fields, ending: str = ".tsv") -> str:
    """Writes tab-separated lines in ``order``, part by part, and returns where."""
    path = _place(df.sparkSession, ending)
    line = F.concat_ws("\t", *[f.cast("string") for f in fields])
    df.select(order, line.alias("value")).repartitionByRange(order).sortWithinPartitions(order).select("value").write.text(path)
    return path


@query("SELECT CAST(doc_id % 500 AS VARCHAR) AS qid, arg_max(coalesce(source, '-') || ' ' || doc_id, doc_id) AS query FROM documents GROUP BY 1")
def queries_file(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "source")
    return readers.queries_tsv(spark, _lines(docs, "doc_id", F.pmod("doc_id", F.lit(500)), F.concat_ws(" ", F.coalesce("source", F.lit("-")), "doc_id")))


@query("""SELECT 'item "' || item_id % 40 || '"' AS question, 'a' || min(item_id) || ',b' AS answers FROM benchmark GROUP BY item_id % 40""")
def answers_file(spark, d):
    items = _t(spark, d, "benchmark").select("item_id")
    question = F.concat(F.lit('"item ""'), F.pmod("item_id", F.lit(40)).cast("string"), F.lit('"""'))
    answers = F.concat(F.lit('"[""a'), F.col("item_id").cast("string"), F.lit("\"\", 'b']\""))
    found = readers.answers_tsv(spark, _lines(items, "item_id", question, answers))
    return found.select("question", F.array_join("answers", ",").alias("answers"))


@query("SELECT CAST(doc_id % 97 AS VARCHAR) AS qid, CAST(doc_id % 53 AS VARCHAR) AS pid, CAST(arg_max(quality, doc_id) AS INTEGER) AS rel FROM labels GROUP BY 1, 2")
def qrels_file(spark, d):
    rows = _t(spark, d, "labels").select("doc_id", "quality")
    return readers.qrels_tsv(spark, _lines(rows, "doc_id", F.pmod("doc_id", F.lit(97)), F.lit(0), F.pmod("doc_id", F.lit(53)), F.col("quality"), ending=".txt"))


@query("SELECT CAST(l_orderkey AS VARCHAR) AS qid, CAST(l_partkey AS VARCHAR) AS pid, CAST(l_linenumber AS INTEGER) AS rank, round(1.0 / l_linenumber, 4) AS score FROM lineitem")
def ranked_file(spark, d):
    rows = _t(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    return readers.run_tsv(spark, _lines(rows, "l_orderkey", F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber")))


@query("SELECT CAST(l_orderkey AS VARCHAR) AS qid, CAST(l_partkey AS VARCHAR) AS pid, CAST(l_linenumber AS INTEGER) AS rank, round(l_extendedprice, 4) AS score FROM lineitem")
def run_file(spark, d):
    run = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("qid"), F.col("l_partkey").alias("pid"), F.col("l_linenumber").alias("rank"), F.col("l_extendedprice").alias("score"))
    sinks.write_run(run, path := _place(spark, ".tsv"))
    return readers.run_tsv(spark, path)


@query("SELECT CASE doc_id % 2 WHEN 0 THEN 'train' ELSE 'validation' END AS split, source AS title, CAST(length(text) AS BIGINT) AS chars, doc_id FROM documents")
def json_splits(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", F.col("source").alias("title"), F.col("text").alias("contents"))
    paths = {}
    for n, name in enumerate(("train", "validation")):
        paths[name] = _place(spark, ".jsonl")
        docs.filter(F.pmod("doc_id", F.lit(2)) == n).write.option("compression", "gzip").json(paths[name])
    return readers.splits(spark, "doc_id bigint, " + readers.PASSAGES, **paths).select("split", "title", F.length("contents").cast("long").alias("chars"), "doc_id")


@query("""WITH l AS (SELECT DISTINCT doc_id FROM labels), p AS (SELECT l.doc_id, c.source FROM l JOIN documents c ON c.doc_id = l.doc_id),
n AS (SELECT l.doc_id, c.source, c.doc_id AS o FROM l JOIN documents c ON c.doc_id IN (l.doc_id + 1, l.doc_id + 2))
SELECT CAST(doc_id AS VARCHAR) AS query, (SELECT count(*) FROM p WHERE p.doc_id = l.doc_id) AS n_pos, (SELECT count(*) FROM n WHERE n.doc_id = l.doc_id) AS n_neg, coalesce((SELECT string_agg(source, ',' ORDER BY o) FROM n WHERE n.doc_id = l.doc_id), '') AS negatives FROM l""")
def converted_examples(spark, d):
    ids = lambda *by: F.struct(F.array(*[(F.col("doc_id") + n).cast("string") for n in by]).alias("doc_id"))
    examples = _t(spark, d, "labels").select("doc_id").distinct().select(F.col("doc_id").cast("string").alias("query"), ids(0, 10**8).alias("positives"), ids(1, 2).alias("negatives"))
    corpus = _t(spark, d, "documents").select(F.col("doc_id").alias("doc_idx"), F.col("source").alias("title"), F.col("text").alias("contents"))
    found = conversion.convert_examples(examples, corpus)
    return found.select("query", F.size("pos_docs").cast("long").alias("n_pos"), F.size("neg_docs").cast("long").alias("n_neg"), F.array_join(F.transform("neg_docs", lambda x: x["title"]), ",").alias("negatives"))


_BOX = "s_suppkey % 50 AS x, s_suppkey % 30 AS y, 10 + s_suppkey % 7 AS w, 20 + s_suppkey % 5 AS h"


@query(f"""WITH b AS (SELECT s_suppkey, s_nationkey AS image_id, s_suppkey % 5 AS class, 200.0 + n_nationkey AS iw, 100.0 + n_regionkey AS ih, {_BOX} FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT image_id, class, round((x + w / 2.0) / iw, 6) AS cx, round((y + h / 2.0) / ih, 6) AS cy, round(w / iw, 6) AS w, round(h / ih, 6) AS h FROM b""")
def annotated_boxes(spark, d):
    images = _t(spark, d, "nation").select(F.struct(F.col("n_nationkey").alias("id"), F.concat("n_name", F.lit(".png")).alias("file_name"), (100 + F.col("n_regionkey")).alias("height"), (200 + F.col("n_nationkey")).alias("width")).alias("i"))
    s = F.col("s_suppkey")
    box = F.array(*[x.cast("double") for x in (s % 50, s % 30, 10 + s % 7, 20 + s % 5)])
    marks = _t(spark, d, "supplier").select(F.struct(F.col("s_nationkey").alias("image_id"), (s % 5 + 1).alias("category_id"), box.alias("bbox")).alias("a"))
    one = F.lit(1).alias("one")  # a row each: the file is one record
    whole = images.groupBy(one).agg(F.collect_list("i").alias("images")).join(marks.groupBy(one).agg(F.collect_list("a").alias("annotations")), "one")
    whole.select(F.to_json(F.struct("annotations", "images")).alias("value")).write.text(path := _place(spark, ".json"))
    boxes = conversion.normalized_boxes(*readers.coco(spark, path))
    return boxes.select("image_id", "class", *[F.round(c, 6).alias(c) for c in ("cx", "cy", "w", "h")])


_SIDES = "v AS (SELECT vec_id // 8 AS batch, vec_id % 8 AS i, CAST(embedding AS DOUBLE[]) AS q, list_reverse(CAST(embedding AS DOUBLE[])) AS k FROM embeddings)"


@query(f"""WITH {_SIDES}, s AS (SELECT a.batch, a.i, b.i AS j, list_inner_product(a.q, b.k) / 0.5 AS qk, list_inner_product(a.q, b.q) / 0.5 AS qq, list_inner_product(a.k, b.q) / 0.5 AS kq, list_inner_product(a.k, b.k) / 0.5 AS kk FROM v a JOIN v b USING (batch))
SELECT batch, i, 4 * count(*) AS n, round(ln(sum(exp(qk) + exp(kq) + CASE WHEN i = j THEN 0 ELSE exp(qq) + exp(kk) END)) - max(qk) FILTER (i = j), 5) AS loss FROM s GROUP BY batch, i""")
def contrastive_blocks(spark, d):
    """Scores of queries and keys with each other and among themselves, side by side; a row's own key is its target."""
    q = _batches(spark, d)
    k = q.withColumn("vector", F.reverse("vector"))
    blocks = [contrastive.batch_scores(*pair, 0.5, mask_self=pair[0] is pair[1]) for pair in ((q, k), (k, q), (q, q), (k, k))]
    rows = contrastive.score_rows(*blocks)
    return rows.select("batch", "i", F.size("scores").cast("long").alias("n"), F.round(vectors.cross_entropy(F.col("scores"), F.col("i")), 5).alias("loss"))


@query("WITH f AS (SELECT CAST(doc_id * 31 % 5003 AS VARCHAR) AS qid, min(doc_id) AS first FROM labels GROUP BY 1 ORDER BY first, qid LIMIT 100) SELECT qid, row_number() OVER (ORDER BY qid) AS at FROM f")
def first_queries(spark, d):
    rows = _t(spark, d, "labels").select("doc_id", F.pmod(F.col("doc_id") * 31, F.lit(5003)).alias("qid"))
    return conversion.first_keys(rows, "qid", "doc_id", 100)


@query("""WITH n AS (SELECT l_orderkey, l_linenumber, 2 * l_orderkey * l_partkey AS z FROM lineitem), b AS (SELECT *, greatest(1, CAST(ceil(len(ltrim(bin(z), '0')) / 7.0) AS BIGINT)) AS size FROM n)
SELECT l_orderkey, l_linenumber, z // 2 AS n, array_to_string(list_transform(range(0, size), lambda i: printf('%02X', ((z >> CAST(7 * i AS BIGINT)) & 127) + CASE WHEN i < size - 1 THEN 128 ELSE 0 END)), '') AS bytes FROM b""")
def varint_round_trip(spark, d):
    rows = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") * F.col("l_partkey")).alias("n"))
    coded = rows.withColumn("bytes", bits.varint(bits.zigzag(F.col("n"))))
    return coded.select("l_orderkey", "l_linenumber", bits.unzigzag(bits.varint_decode(F.col("bytes"))).alias("n"), F.hex("bytes").alias("bytes"))


@query("SELECT event_id, round((value - 0.1307) / 0.3081, 6) AS x FROM events")
def standardized_values(spark, d):
    return _t(spark, d, "events").select("event_id", F.round(vectors.standardize(F.col("value"), 0.1307, 0.3081), 6).alias("x"))


@query("SELECT vec_id * 64 + i AS at, embedding[i + 1] AS value FROM (SELECT vec_id, embedding, unnest(range(0, 64)) AS i FROM embeddings)")
def flattened_vectors(spark, d):
    return vectors.flattened(_t(spark, d, "embeddings"), "vec_id", "embedding", 64)


@query("SELECT round(sum(part) / 4, 6) AS mean_of_ranks, round(sum(total), 4) AS total FROM (SELECT event_id % 4 AS rank, avg(value) AS part, sum(value) AS total FROM events GROUP BY 1)")
def summed_over_ranks(spark, d):
    """Each rank's mean and sum first, then their sums: over the number of ranks for the mean."""
    parts = _t(spark, d, "events").groupBy(F.pmod("event_id", F.lit(4)).alias("rank")).agg(F.avg("value").alias("part"), F.sum("value").alias("total"))
    return parts.agg(F.round(F.sum("part") / 4, 6).alias("mean_of_ranks"), F.round(F.sum("total"), 4).alias("total"))


@query("SELECT p_partkey, p_name AS decoded, printf('%.3f', p_retailprice) AS price, format('{:,}', p_partkey * 1000) AS grouped FROM part")
def decoded_and_formatted(spark, d):
    part = _t(spark, d, "part")
    return part.select("p_partkey", F.decode(F.unbase64(F.base64(F.encode("p_name", "UTF-8"))), "UTF-8").alias("decoded"), F.format_string("%.3f", "p_retailprice").alias("price"), F.format_number(F.col("p_partkey") * 1000, 0).alias("grouped"))


@query("SELECT file_row_number AS row, l_orderkey AS value FROM read_parquet('/root/testdata/sf0.01/lineitem.parquet', file_row_number = true)")
def decoded_pages(spark, d):
    return parquet_values.int64_values(spark, _files(spark, d, "lineitem"), "l_orderkey").select("row", "value")


@query("SELECT doc_id, source AS bucket, 'texts/' || doc_id || '.json' AS key FROM documents WHERE source IS NOT NULL")
def object_addresses(spark, d):
    docs = _t(spark, d, "documents").filter("source is not null").select("doc_id", F.concat(F.lit("s3://"), "source", F.lit("//texts/"), "doc_id", F.lit(".json")).alias("uri"))
    bucket, key = text.bucket_and_key(F.col("uri"))
    return docs.select("doc_id", bucket.alias("bucket"), key.alias("key"))


@query("SELECT page_id, CAST(page_id % 8 AS INTEGER) AS worker, CAST(page_id // 8 AS INTEGER) AS shard FROM pages")
def shard_names(spark, d):
    n = F.col("page_id")
    path = F.concat(F.lit("/data/a_b/shard_"), (n % 8).cast("string"), F.lit("_"), F.floor(n / 8).cast("string"), F.lit(".parquet"))
    worker, shard = text.shard_numbers(path)
    return _t(spark, d, "pages").select("page_id", worker.alias("worker"), shard.alias("shard"))


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
SELECT vec_id, round((e[1] + e[5] + e[9]) / 3, 6) AS pooled, round(e[1], 6) AS first FROM v""")
def pooled_tokens(spark, d):
    """Three runs of four components stand for a text's token vectors."""
    tokens = F.array(*[F.slice("embedding", i, 4) for i in (1, 5, 9)])
    return _t(spark, d, "embeddings").select("vec_id", F.round(F.get(vectors.mean_pool(tokens), F.lit(0)), 6).alias("pooled"), F.round(F.get(vectors.first_token(tokens), F.lit(0)).cast("double"), 6).alias("first"))


@query("SELECT part, codec, n AS num_values, CAST(ceil(n / 100.0) AS BIGINT) AS groups FROM (SELECT count(*) AS n FROM labels), (VALUES ('a', 'ZSTD'), ('b', 'UNCOMPRESSED')) AS t(part, codec)")
def written_row_groups(spark, d):
    """Row groups of a set number of rows, with the default codec and with none, as the files' footers tell."""
    rows, out = _t(spark, d, "labels").select("doc_id"), None
    for part, codec in (("a", "zstd"), ("b", "none")):
        path = _place(spark, ".parquet")
        sinks.write_parquet(rows.coalesce(1), path, codec=codec, group_rows=sinks.row_group_rows(rows.count(), size=100))
        files = sorted(r["path"] for r in readers.file_sizes(spark, path).select("path").toLocalIterator() if r["path"].endswith(".parquet"))
        told = parquet_meta.parquet_meta(spark, files, "column_chunk").agg(F.max("codec").alias("codec"), F.sum("num_values").alias("num_values"), F.countDistinct("file", "row_group").alias("groups"))
        told = told.select(F.lit(part).alias("part"), "codec", "num_values", "groups")
        out = told if out is None else out.unionByName(told)
    return out


@query("SELECT replace(n_name || '.png', '.png', '.txt') AS label_file, count(*) AS lines, CAST(sum(s_suppkey % 5) AS BIGINT) AS classes FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def written_boxes(spark, d):
    boxes = _t(spark, d, "supplier").join(_t(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.concat("n_name", F.lit(".png")).alias("file_name"), (F.col("s_suppkey") % 5).alias("class"), *[(F.col("s_suppkey") / 1e7 + i).alias(c) for i, c in enumerate(("cx", "cy", "w", "h"))]
    )
    sinks.write_boxes(conversion.box_lines(boxes, "test"), path := _place(spark, ""))
    lines = spark.read.text(f"{path}/valid").select(F.col("_metadata.file_path").alias("at"), "value")
    name = F.replace(F.element_at(F.split("at", "/"), -1), F.lit("%20"), F.lit(" "))
    return lines.groupBy(name.alias("label_file")).agg(F.count("*").alias("lines"), F.sum(F.split("value", " ")[0].cast("long")).alias("classes"))


@query("SELECT p_partkey, [p_size * 1.0, p_retailprice, -0.5, 0.0]::DOUBLE[] AS numbers FROM part")
def parsed_presets(spark, d):
    preset = F.concat_ws(", ", F.col("p_size").cast("string"), F.col("p_retailprice").cast("string"), F.lit("-0.5"), F.lit("0"))
    return _t(spark, d, "part").select("p_partkey", vectors.parse_preset(preset).alias("numbers"))


@query("SELECT range AS id FROM range(5)")
def toy_file(spark, d):
    synthetic.toy_table(spark).write.parquet(path := _place(spark, ".parquet"))
    return spark.read.parquet(path)


@query("SELECT 200 AS n, 200 AS distinct_texts, 6 AS least_words, true AS bank_words, true AS unit_mean, true AS unit_spread")
def synthetic_frame(spark, d):
    """Properties of a synthetic frame: word counts, words of the bank, and vectors of mean 0 and spread 1."""
    rows = synthetic.text_table(spark, 200, text_words=6, query_words=3, width=64, seed=7)
    words = rows.select("text", F.split("text", " ").alias("w"), "embedding", F.lit(1).alias("one"))
    bank = F.array(*[F.lit(w) for w in synthetic.BANK])
    seen = words.agg(
        F.count("*").alias("n"), F.countDistinct("text").alias("distinct_texts"), F.min(F.size("w")).alias("least_words"), F.min(F.forall("w", lambda x: F.array_contains(bank, x))).alias("bank_words"),
        F.avg(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x)).alias("m"), F.avg(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)).alias("q"),
    )
    return seen.select("n", "distinct_texts", "least_words", "bank_words", (F.abs(F.col("m") / 64) < 0.05).alias("unit_mean"), (F.abs(F.col("q") / 64 - 1) < 0.05).alias("unit_spread"))


@query("SELECT doc_id, ['a', 'b', 'c'][doc_id * 7 % 3 + 1] AS positive, 4 AS negatives, 4 AS different FROM labels")
def drawn_examples(spark, d):
    """One positive, and four different negatives of nine, drawn by a row's number."""
    several = F.array(*[F.lit(i) for i in range(9)])
    rows = _t(spark, d, "labels").select("doc_id", sampling.one_positive(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.col("doc_id") * 7).alias("positive"), sampling.some_negatives(several, 4, F.col("doc_id")).alias("n"))
    return rows.select("doc_id", "positive", F.size("n").alias("negatives"), F.size(F.array_distinct("n")).alias("different"))
