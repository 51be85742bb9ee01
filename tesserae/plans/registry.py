"""Registered queries and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import bits, geometry, text, vectors
from tesserae.operators import contrastive, conversion, embedding, evaluation, retrieval, sampling
from tesserae.operators.tables import spread_small
from tesserae.session import ship
from tesserae.sources import parquet_meta, readers, sinks

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(ship(spark), sf_dir)
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return readers.table(spark, sf_dir, name)


# --- scans, counts, duplicates ---------------------------------------------------------------------------------------


@query("SELECT doc_id, coalesce(text, '') AS text, lang FROM documents")
def scan_project_documents(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang")


@query("SELECT source, count(*) AS count FROM documents GROUP BY source")
def row_count_by_source(spark, d):
    return conversion.value_counts(_t(spark, d, "documents"), "source")


@query("SELECT quality, count(*) AS count FROM labels GROUP BY quality")
def label_value_counts(spark, d):
    return conversion.value_counts(_t(spark, d, "labels"), "quality")


@query("SELECT source, max(doc_id) AS doc_id, arg_max(n_chars, doc_id) AS n_chars FROM documents GROUP BY source")
def dedupe_last_wins(spark, d):
    return conversion.last_wins(_t(spark, d, "documents").select("source", "doc_id", "n_chars"), "source", "doc_id")


@query("SELECT source, min(doc_id) AS doc_id, arg_min(n_chars, doc_id) AS n_chars, count(*) - 1 AS repeats FROM documents GROUP BY source")
def dedupe_first_wins(spark, d):
    return conversion.first_wins(_t(spark, d, "documents").select("source", "doc_id", "n_chars"), "source", "doc_id")


@query("SELECT count(DISTINCT event_type) AS kinds, count(*) AS rows, count(DISTINCT user_id) AS users FROM events")
def distinct_counts(spark, d):
    return _t(spark, d, "events").agg(F.countDistinct("event_type").alias("kinds"), F.count("*").alias("rows"), F.countDistinct("user_id").alias("users"))


# --- retrieval and its metrics ---------------------------------------------------------------------------------------

_RUN = """q AS (SELECT vec_id AS qid, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT qid, p.vec_id AS pid, round(list_inner_product(q.e, CAST(p.embedding AS DOUBLE[])), 6) AS score FROM q, embeddings p),
run AS (SELECT qid, pid, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) AS rank FROM s)"""
_QRELS = """qrels AS (SELECT q.vec_id AS qid, p.vec_id AS pid, 1 AS rel FROM embeddings q JOIN embeddings p ON q.label = p.label AND q.vec_id <> p.vec_id WHERE q.vec_id % 20 = 0)"""


def _vectors(spark, d, extra=()):
    passages = _t(spark, d, "embeddings").select(F.col("vec_id").alias("pid"), F.col("embedding").alias("vector"), *extra)
    return passages.filter("pid % 20 = 0").withColumnRenamed("pid", "qid"), passages  # the stated query set


def _qrels(spark, d):
    e = _t(spark, d, "embeddings").select("vec_id", "label")
    q = e.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "qid")
    return q.join(e.withColumnRenamed("vec_id", "pid"), "label").filter("qid <> pid").select("qid", "pid", F.lit(1).alias("rel"))


@query(f"WITH {_RUN} SELECT qid, pid, rank, score FROM run WHERE rank <= 10")
def dense_topk(spark, d):
    return retrieval.dense_topk(*_vectors(spark, d), 10).select("qid", "pid", "rank", "score")


@query(f"WITH {_RUN} SELECT qid, pid, rank, score FROM run WHERE rank <= 10")
def dense_topk_expressions(spark, d):
    q, passages = _vectors(spark, d)
    size = readers.file_sizes(spark, f"{d}/embeddings.parquet").agg(F.sum("bytes")).first()[0]
    return retrieval.dense_topk(q, spread_small(passages, size), 10, strategy="expressions").select("qid", "pid", "rank", "score")


@query(f"WITH {_RUN} SELECT qid, pid, rank, score FROM run WHERE rank <= 10")
def dense_topk_blocked_merge(spark, d):
    q, passages = _vectors(spark, d)
    parts = [retrieval.dense_topk(q, passages.filter(F.pmod("pid", F.lit(4)) == n), 10) for n in range(4)]
    return retrieval.merge_shards(parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]), 10).select("qid", "pid", "rank", "score")


@query(f"WITH {_RUN}, k AS (SELECT * FROM run WHERE rank <= 50 AND rank % 2 = 0) SELECT qid, pid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) AS rank, round(score, 3) AS score FROM k")
def run_renumbered(spark, d):
    return sinks.renumbered(retrieval.dense_topk(*_vectors(spark, d), 50).filter(F.pmod("rank", F.lit(2)) == 0))


@query(f"WITH {_RUN}, {_QRELS}, f AS (SELECT qid, min(rank) AS r FROM run JOIN qrels USING (qid, pid) WHERE rank <= 10 GROUP BY qid) SELECT round(avg(coalesce(1.0 / r, 0)) * 100, 4) AS mrr FROM (SELECT DISTINCT qid FROM qrels) LEFT JOIN f USING (qid)")
def mrr_at_10(spark, d):
    return evaluation.mrr(_qrels(spark, d), retrieval.dense_topk(*_vectors(spark, d), 10))


_KS = "ks AS (SELECT CAST(unnest([10, 50, 100, 200, 1000]) AS BIGINT) AS k), n AS (SELECT qid, count(*) AS n FROM qrels GROUP BY qid), h AS (SELECT qid, rank, row_number() OVER (PARTITION BY qid ORDER BY rank) AS seen FROM run JOIN qrels USING (qid, pid) WHERE rank <= 1000)"
_RANGE = "unnest(range(1, 1 + least(n.n, k)))"


@query(f"""WITH {_RUN}, {_QRELS}, {_KS},
g AS (SELECT qid, k, sum(CASE WHEN rank <= k THEN 1 / log2(rank + 1.0) ELSE 0 END) AS dcg FROM h, ks GROUP BY qid, k),
i AS (SELECT qid, k, sum(1 / log2(r + 1.0)) AS best FROM (SELECT qid, k, {_RANGE} AS r FROM n, ks) GROUP BY qid, k)
SELECT k, round(avg(coalesce(dcg, 0) / best), 5) AS ndcg FROM i LEFT JOIN g USING (qid, k) GROUP BY k""")
def ndcg_at_k(spark, d):
    return evaluation.ndcg(_qrels(spark, d), retrieval.dense_topk(*_vectors(spark, d), 1000))


@query(f"WITH {_RUN}, {_QRELS}, {_KS}, a AS (SELECT qid, k, sum(CASE WHEN rank <= k THEN CAST(seen AS DOUBLE) / rank ELSE 0 END) AS p FROM h, ks GROUP BY qid, k) SELECT k, round(avg(coalesce(p, 0) / n), 5) AS map FROM (SELECT * FROM n, ks) LEFT JOIN a USING (qid, k) GROUP BY k")
def map_at_k(spark, d):
    return evaluation.mean_average_precision(_qrels(spark, d), retrieval.dense_topk(*_vectors(spark, d), 1000))


@query(f"WITH {_RUN}, {_QRELS}, {_KS}, a AS (SELECT qid, k, count(*) FILTER (rank <= k) AS c FROM h, ks GROUP BY qid, k) SELECT k, round(avg(CAST(coalesce(c, 0) AS DOUBLE) / n), 5) AS recall FROM (SELECT * FROM n, ks) LEFT JOIN a USING (qid, k) GROUP BY k")
def recall_at_k(spark, d):
    return evaluation.recall(_qrels(spark, d), retrieval.dense_topk(*_vectors(spark, d), 1000))


@query("SELECT CAST(CASE WHEN max(quality + 2 * toxic) >= 3 THEN 2 ELSE 1 END AS BIGINT) AS threshold FROM labels")
def rel_threshold(spark, d):
    return evaluation.relevance_threshold(_t(spark, d, "labels").select((F.col("quality") + 2 * F.col("toxic")).alias("rel")))


@query("SELECT doc_id % 97 AS qid, to_json(map_from_entries(list({'k': CAST(doc_id AS VARCHAR), 'v': quality} ORDER BY CAST(doc_id AS VARCHAR)))) AS judged FROM labels GROUP BY 1")
def nested_qrels(spark, d):
    rows = _t(spark, d, "labels").select(F.pmod("doc_id", F.lit(97)).alias("qid"), F.col("doc_id").cast("string").alias("pid"), F.col("quality").alias("rel"))
    return conversion.nested_qrels(rows).select("qid", F.to_json("judged").alias("judged"))


@query("""WITH a AS (SELECT vec_id, label, list_position(embedding[1:10], list_max(embedding[1:10])) - 1 AS p FROM embeddings)
SELECT count(*) AS n, count(*) FILTER (p = label) AS correct, round(100.0 * count(*) FILTER (p = label) / count(*), 4) AS accuracy FROM a""")
def argmax_accuracy(spark, d):
    """The first ten components stand for the logits of the ten labels."""
    rows = _t(spark, d, "embeddings").select("label", vectors.argmax(F.slice("embedding", 1, 10)).alias("predicted"))
    return evaluation.accuracy(rows, "predicted", "label")


@query("SELECT vec_id, round(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm, round(CAST(embedding[1] AS DOUBLE) / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS first FROM embeddings")
def vector_l2norm(spark, d):
    return _t(spark, d, "embeddings").select("vec_id", F.round(vectors.norm(F.col("embedding")), 6).alias("norm"), F.round(F.get(vectors.normalize(F.col("embedding")), F.lit(0)), 6).alias("first"))


# --- conversion ------------------------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT doc_id, unnest([doc_id, doc_id + 1, doc_id + 100000000]) AS id, unnest([0, 1, 2]) AS pos FROM labels),
f AS (SELECT e.doc_id, count(*) AS n_docs, string_agg(c.source, ',' ORDER BY pos) AS titles, CAST(sum(length(c.text)) AS BIGINT) AS chars FROM e JOIN documents c ON c.doc_id = e.id GROUP BY e.doc_id)
SELECT l.doc_id, coalesce(n_docs, 0) AS n_docs, coalesce(titles, '') AS titles, coalesce(chars, 0) AS chars FROM (SELECT DISTINCT doc_id FROM labels) l LEFT JOIN f USING (doc_id)""")
def corpus_lookup_nested(spark, d):
    ids = F.array(*[(F.col("doc_id") + n).cast("string") for n in (0, 1, 100_000_000)])
    corpus = _t(spark, d, "documents").select(F.col("doc_id").alias("doc_idx"), F.col("source").alias("title"), F.col("text").alias("contents"))
    found = conversion.corpus_lookup(_t(spark, d, "labels").select("doc_id", ids.alias("ids")), corpus, "doc_id", "ids", "docs")
    chars = F.aggregate("docs", F.lit(0).cast("long"), lambda s, x: s + F.length(x["contents"]))
    return found.select("doc_id", F.size("docs").cast("long").alias("n_docs"), F.array_join(F.transform("docs", lambda x: x["title"]), ",").alias("titles"), chars.alias("chars"))


@query("SELECT q.source || '-' || q.doc_id AS query, b.text AS passage, l.quality AS label FROM labels l JOIN documents q ON q.doc_id = l.doc_id JOIN benchmark b ON b.item_id = l.doc_id % 250")
def triplets_join(spark, d):
    qrels = _t(spark, d, "labels").select(F.col("doc_id").alias("qid"), F.pmod("doc_id", F.lit(250)).alias("pid"), F.col("quality").alias("rel"))
    q = _t(spark, d, "documents").select(F.col("doc_id").alias("qid"), F.concat_ws("-", "source", "doc_id").alias("query"))
    return conversion.triplets(qrels, q, _t(spark, d, "benchmark").select(F.col("item_id").alias("pid"), F.col("text").alias("passage")))


@query("""WITH p AS (SELECT vec_id AS qid, (vec_id * 7 + 1) % n AS pid, n FROM embeddings, (SELECT count(*) AS n FROM embeddings)), g AS (SELECT qid, pid, n, CAST(unnest(range(1, 9)) AS INTEGER) AS draw FROM p)
SELECT g.qid, (g.qid * 31 + g.pid * 3 + draw * 17) % g.n AS pid, draw FROM g LEFT JOIN p ON p.qid = g.qid AND p.pid = (g.qid * 31 + g.pid * 3 + draw * 17) % g.n WHERE p.qid IS NULL""")
def negatives_anti(spark, d):
    n = _t(spark, d, "embeddings").count()
    positives = _t(spark, d, "embeddings").select(F.col("vec_id").alias("qid"), F.pmod(F.col("vec_id") * 7 + 1, F.lit(n)).alias("pid"))
    return conversion.negatives(positives, n, 8, F.col("qid") * 31 + F.col("pid") * 3 + F.col("draw") * 17)


@query("""SELECT l_partkey AS image_id, l_linenumber - 1 AS class, round((l_discount * 100 + l_quantity / 2) / (p_size + 100), 6) AS cx, round((l_tax * 100 + CAST(l_linenumber AS DOUBLE) / 2) / p_retailprice, 6) AS cy,
round(l_quantity / (p_size + 100), 6) AS w, round(l_linenumber / p_retailprice, 6) AS h FROM lineitem JOIN part ON l_partkey = p_partkey""")
def boxes_normalized(spark, d):
    images = _t(spark, d, "part").select(F.col("p_partkey").alias("image_id"), F.col("p_name").alias("file_name"), (F.col("p_size") + 100).alias("width"), F.col("p_retailprice").alias("height"))
    box = F.array(F.col("l_discount") * 100, F.col("l_tax") * 100, "l_quantity", F.col("l_linenumber").cast("double"))
    boxes = conversion.normalized_boxes(_t(spark, d, "lineitem").select(F.col("l_partkey").alias("image_id"), F.col("l_linenumber").alias("category_id"), box.alias("bbox")), images)
    return boxes.select("image_id", "class", *[F.round(c, 6).alias(c) for c in ("cx", "cy", "w", "h")])


@query("""WITH u AS (SELECT o_custkey, o_orderkey, 0 AS v FROM orders UNION ALL SELECT o_custkey, o_orderkey, 1 FROM orders WHERE o_orderkey % 2 = 0),
m AS (SELECT o_custkey, max(v) AS v FROM u GROUP BY o_custkey) SELECT o_custkey, u.v AS version, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM u JOIN m USING (o_custkey, v) GROUP BY o_custkey, u.v""")
def upsert_union(spark, d):
    o = _t(spark, d, "orders").select("o_custkey", "o_orderkey")
    both = o.withColumn("version", F.lit(0)).unionByName(o.filter("o_orderkey % 2 = 0").withColumn("version", F.lit(1)))
    return retrieval.upsert_by_key(both, "o_custkey", "version").groupBy("o_custkey", "version").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


# --- contrastive training arithmetic ---------------------------------------------------------------------------------

_PAIRS = "SELECT a.vec_id // 8 AS batch, a.vec_id % 8 AS i, b.vec_id % 8 AS j, list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s FROM embeddings a JOIN embeddings b ON a.vec_id // 8 = b.vec_id // 8"


def _batches(spark, d):
    return _t(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 8).alias("batch"), F.pmod("vec_id", F.lit(8)).alias("i"), F.col("embedding").alias("vector"))


@query(f"SELECT batch, i, j, round(CASE WHEN i = j THEN -9 ELSE s / 0.05 END, 5) AS score FROM ({_PAIRS})")
def contrastive_scores(spark, d):
    rows = _batches(spark, d)
    scores = contrastive.batch_scores(rows, rows, 0.05, mask_self=True)
    return scores.select("batch", "i", "j", F.round(F.when(F.col("score") == float("-inf"), -9.0).otherwise(F.col("score")), 5).alias("score"))


@query(f"WITH p AS ({_PAIRS}), r AS (SELECT batch, i, ln(sum(exp(s / 0.05) )) - max(s / 0.05) FILTER (j = xor(i, 1)) AS loss FROM p WHERE i <> j GROUP BY batch, i) SELECT batch, round(avg(loss), 5) AS loss FROM r GROUP BY batch")
def contrastive_loss(spark, d):
    rows = _batches(spark, d)
    scores = contrastive.score_rows(contrastive.batch_scores(rows, rows, 0.05, mask_self=True))
    return contrastive.contrastive_loss(scores, F.col("i").bitwiseXOR(F.lit(1).cast("long"))).select("batch", F.round("loss", 5).alias("loss"))


@query("SELECT range AS step, round(CASE WHEN range < 20 THEN 0.5 + 0.5 * range / 20.0 ELSE greatest(0, (150.0 - range) / 130.0) END, 6) AS factor, round(pow(0.9, range // 10), 6) AS decay FROM range(200)")
def lr_schedule(spark, d):
    step = F.col("id")
    return spark.range(200).select(step.alias("step"), F.round(geometry.warmup_linear(step, 20, 150), 6).alias("factor"), F.round(geometry.step_decay(F.floor(step / 10), 0.9), 6).alias("decay"))


# --- geometry --------------------------------------------------------------------------------------------------------


def _points(spark, d):
    return _t(spark, d, "events").select("event_id", (F.col("value") / 100).alias("x"), (F.col("user_id") / 1000).alias("y"))


@query("SELECT event_id, round(2.0 * (value / 100) + -1.0 * (user_id / 1000.0), 6) AS x, round(0.5 * (value / 100) + 1.5 * (user_id / 1000.0), 6) AS y FROM events")
def geometry_linear(spark, d):
    return geometry.map_points(_points(spark, d), lambda x, y: geometry.linear_map(x, y, 2.0, -1.0, 0.5, 1.5)).select("event_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("""WITH p AS (SELECT event_id, value / 100 AS x, user_id / 1000.0 AS y FROM events), r AS (SELECT *, 0.3 * pi() * (x * x + y * y) AS a FROM p)
SELECT event_id, round(x * cos(a) - y * sin(a), 5) AS x, round(x * sin(a) + y * cos(a), 5) AS y FROM r""")
def geometry_nonlinear(spark, d):
    return geometry.map_points(_points(spark, d), geometry.swirl).select("event_id", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


@query("""WITH m AS (SELECT p_partkey, CAST(p_size - 25 AS DOUBLE) * 2.0 - CAST(p_partkey % 7 AS DOUBLE) * (p_retailprice / 100) AS det FROM part)
SELECT p_partkey, round(det, 6) AS det, round(abs(det), 6) AS area, CASE WHEN abs(det) < 1e-9 THEN 'degenerate' WHEN det > 0 THEN 'preserved' ELSE 'reversed' END AS orientation FROM m""")
def determinant_class(spark, d):
    det = geometry.determinant((F.col("p_size") - 25).cast("double"), F.pmod("p_partkey", F.lit(7)).cast("double"), F.col("p_retailprice") / 100, F.lit(2.0))
    rows = _t(spark, d, "part").select("p_partkey", det.alias("det"))
    return rows.select("p_partkey", F.round("det", 6).alias("det"), F.round(F.abs("det"), 6).alias("area"), geometry.orientation(F.col("det")).alias("orientation"))


@query("""WITH l AS (SELECT range AS line FROM range(-2, 3)), s AS (SELECT line, unnest(range(0, 5)) AS step FROM l)
SELECT 'v' AS axis, line, step, CAST(line AS DOUBLE) AS x, -2.0 + step * 1.0 AS y FROM s UNION ALL SELECT 'h', line, step, -2.0 + step * 1.0, CAST(line AS DOUBLE) FROM s""")
def grid_points(spark, d):
    return geometry.grid(spark)


@query("SELECT event_id, round(value / 100 + (1.0 - value / 100) * (i / 3.0), 6) AS x, round(user_id / 1000.0 + (2.0 - user_id / 1000.0) * (i / 3.0), 6) AS y, i AS step FROM (SELECT *, CAST(unnest(range(0, 4)) AS INTEGER) AS i FROM events)")
def segment_points(spark, d):
    line = geometry.segment(4, F.col("x"), F.col("y"), F.lit(1.0), F.lit(2.0))
    return _points(spark, d).select("event_id", F.posexplode(line).alias("step", "p")).select("event_id", "step", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


@query("SELECT round(greatest(2.2, max(greatest(abs(x), abs(y))) * 1.15), 6) AS extent FROM (SELECT value / 100 AS x, user_id / 1000.0 AS y FROM events UNION ALL SELECT -2.0 * (value / 100), -2.0 * (user_id / 1000.0) FROM events)")
def point_union_extent(spark, d):
    p = _points(spark, d)
    scaled = geometry.map_points(p, lambda x, y: (x * -2.0, y * -2.0))
    return p.unionByName(scaled).agg(F.round(geometry.view_extent(), 6).alias("extent"))


# --- bits, text, order -----------------------------------------------------------------------------------------------


@query("""WITH k AS (SELECT l_orderkey AS n FROM lineitem UNION ALL SELECT -l_orderkey FROM lineitem), z AS (SELECT n, CASE WHEN n >= 0 THEN 2 * n ELSE -2 * n - 1 END AS z FROM k)
SELECT n, z AS zigzag, greatest(1, CAST(ceil(len(ltrim(bin(z), '0')) / 7.0) AS BIGINT)) AS bytes FROM z""")
def zigzag_varint_len(spark, d):
    keys = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("n"))
    z = bits.zigzag(F.col("n"))
    return keys.unionByName(keys.select((-F.col("n")).alias("n"))).select("n", z.alias("zigzag"), bits.varint_length(z).alias("bytes"))


@query(r"SELECT page_id, regexp_extract(url, '^([a-z0-9+.-]+)://([^/?#]*)([^?#]*)', 1) AS scheme, regexp_extract(url, '^([a-z0-9+.-]+)://([^/?#]*)([^?#]*)', 2) AS host, ltrim(regexp_extract(url, '^([a-z0-9+.-]+)://([^/?#]*)([^?#]*)', 3), '/') AS path FROM pages")
def uri_parts(spark, d):
    scheme, host, path = text.url_parts(F.col("url"))
    return _t(spark, d, "pages").select("page_id", scheme.alias("scheme"), host.alias("host"), path.alias("path"))


@query("SELECT item_id, text FROM benchmark")
def qa_normalize(spark, d):
    quoted = F.concat(F.lit('"'), F.replace(F.col("text"), F.lit('"'), F.lit('""')), F.lit('"'))
    return _t(spark, d, "benchmark").select("item_id", text.normalize_quotes(quoted).alias("text"))


@query(r"SELECT conv_id, turn, len(string_split(regexp_replace(role || chr(9) || text || chr(9) || ' ', '^\s+|\s+$', '', 'g'), chr(9))) AS fields, regexp_replace(text, '^\s+|\s+$', '', 'g') AS stripped FROM conversations")
def strip_and_split(spark, d):
    line = F.concat("role", F.lit("\t"), "text", F.lit("\t "))
    return _t(spark, d, "conversations").select("conv_id", "turn", F.size(text.tab_fields(line)).cast("long").alias("fields"), text.strip(F.col("text")).alias("stripped"))


@query("SELECT p_partkey, lower(hex(encode(p_name))) AS hexed, to_base64(encode(p_name)) AS coded, round(p_retailprice / 7, 4) AS price, CAST(ceil(p_size / 3.0) AS BIGINT) AS groups, p_name || ' ' || p_brand AS label FROM part")
def scalar_formats(spark, d):
    name = F.encode("p_name", "UTF-8")
    return _t(spark, d, "part").select("p_partkey", F.lower(F.hex(name)).alias("hexed"), F.base64(name).alias("coded"), F.round(F.col("p_retailprice") / 7, 4).alias("price"), F.ceil(F.col("p_size") / 3).alias("groups"), F.concat_ws(" ", "p_name", "p_brand").alias("label"))


@query("SELECT n_nationkey, to_json({'n_name': n_name, 'n_regionkey': n_regionkey}) AS line FROM nation")
def json_lines(spark, d):
    return _t(spark, d, "nation").select("n_nationkey", F.to_json(F.struct("n_name", "n_regionkey")).alias("line"))


_ORDER = "o AS (SELECT doc_id, row_number() OVER (ORDER BY (doc_id * 7919 + 104729) % 1000003, doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents)"


def _ordered(spark, d, parts=16):
    docs = _t(spark, d, "documents").select("doc_id")
    return docs, F.pmod(F.col("doc_id") * 7919 + 104729, F.lit(1000003)), parts


@query(f"WITH {_ORDER} SELECT doc_id, pos FROM o WHERE pos < n // 64 * 64 AND pos >= 100")
def shuffle_epoch_resume(spark, d):
    docs, key, parts = _ordered(spark, d)
    return sampling.resume(sampling.epoch_order(docs, key, 32, 2, parts), 100).select("doc_id", "pos")


@query(f"WITH {_ORDER} SELECT doc_id, pos FROM o WHERE pos % 4 = 1")
def rank_strided_sampler(spark, d):
    docs, key, parts = _ordered(spark, d)
    return sampling.rank_stride(sampling.positions(docs, [key, F.col("doc_id")], parts), 1, 4).select("doc_id", "pos")


@query("SELECT doc_id, ntile(7) OVER (ORDER BY doc_id) - 1 AS shard FROM documents")
def contiguous_shards(spark, d):
    docs = _t(spark, d, "documents").select("doc_id")
    return sampling.contiguous_shard(sampling.positions(docs, [F.col("doc_id")], 16), docs.count(), 7).select("doc_id", "shard")


@query("SELECT vec_id // 32 AS chunk, count(*) AS rows, min(vec_id) AS first FROM embeddings GROUP BY 1")
def chunk_batches(spark, d):
    return _t(spark, d, "embeddings").groupBy(F.floor(F.col("vec_id") / 32).alias("chunk")).agg(F.count("*").alias("rows"), F.min("vec_id").alias("first"))


@query("SELECT vec_id, list_transform(range(0, 4), lambda i: embedding[(vec_id + i) % 64 + 1]) AS part FROM embeddings")
def circular_slices(spark, d):
    return _t(spark, d, "embeddings").select("vec_id", vectors.circular_slice(F.col("embedding"), F.col("vec_id").cast("int"), F.lit(4)).alias("part"))


@query("SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 100")
def first_rows(spark, d):
    return _t(spark, d, "documents").select("doc_id", "n_chars").orderBy("doc_id").limit(100)


# --- no SQL form -----------------------------------------------------------------------------------------------------


@query(r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w FROM documents), h AS (SELECT doc_id, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) AS h FROM w),
c AS (SELECT doc_id, h % 1024 AS i, sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END) AS c FROM h GROUP BY 1, 2)
SELECT d.doc_id, 1024 AS width, CASE WHEN count(*) FILTER (c <> 0) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS norm, count(*) FILTER (c > 0) AS positive, count(*) FILTER (c < 0) AS negative FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN c USING (doc_id) GROUP BY d.doc_id""")
def embed_column(spark, d):
    size = readers.file_sizes(spark, f"{d}/documents.parquet").agg(F.sum("bytes")).first()[0]
    rows = embedding.embed_column(spread_small(_t(spark, d, "documents").select("doc_id", "text"), size), "text")
    count = lambda test: F.size(F.filter("embedding", test)).cast("long")
    return rows.select("doc_id", F.size("embedding").alias("width"), F.round(vectors.norm(F.col("embedding")), 4).alias("norm"), count(lambda x: x > 0).alias("positive"), count(lambda x: x < 0).alias("negative"))


def _files(spark, d: str, name: str) -> list[str]:
    return sorted(r["path"] for r in readers.file_sizes(spark, f"{d}/{name}.parquet").select("path").toLocalIterator() if r["path"].endswith(".parquet"))


@query("SELECT row_group_id AS row_group, column_id AS \"column\", path_in_schema AS path, \"type\" AS physical_type, num_values, total_compressed_size AS compressed_bytes, total_uncompressed_size AS uncompressed_bytes FROM parquet_metadata('/root/testdata/sf0.01/customer.parquet')")
def parquet_column_chunks(spark, d):
    return parquet_meta.parquet_meta(spark, _files(spark, d, "customer"), "column_chunk").select("row_group", "column", "path", "physical_type", "num_values", "compressed_bytes", "uncompressed_bytes")


@query("SELECT created_by, num_rows, num_row_groups AS row_groups FROM parquet_file_metadata('/root/testdata/sf0.01/lineitem.parquet')")
def parquet_files(spark, d):
    return parquet_meta.parquet_meta(spark, _files(spark, d, "lineitem"), "file").select("created_by", "num_rows", "row_groups")


@query()
def parquet_pages(spark, d):
    return parquet_meta.parquet_meta(spark, _files(spark, d, "lineitem"), "page")


@query("SELECT name, CASE \"type\" WHEN 'INT64' THEN 'int64' WHEN 'BYTE_ARRAY' THEN 'string' END AS type, repetition_type = 'OPTIONAL' AS nullable FROM parquet_schema('/root/testdata/sf0.01/documents.parquet') WHERE num_children IS NULL")
def parquet_arrow_schema(spark, d):
    return parquet_meta.parquet_meta(spark, _files(spark, d, "documents"), "arrow_schema").select("name", F.regexp_replace("type", "^large_", "").alias("type"), "nullable")


from tesserae.plans import exchange  # noqa: E402, F401  (registers its queries)
