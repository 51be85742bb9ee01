"""Operators on hand-computed rows, and properties that must hold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.functions.vectors import dot
from tesserae.operators import contrastive, conversion, embedding, evaluation, retrieval, sampling
from tesserae.streaming.embed_stream import embed_stream


def qrels(spark, rows):
    return spark.createDataFrame(rows, "qid string, pid string, rel int")


def run(spark, rows):
    return spark.createDataFrame(rows, "qid string, pid string, rank int")


def test_metrics(spark):
    q = qrels(spark, [("q1", "a", 1), ("q2", "b", 1)])
    r = run(spark, [("q1", "x", 1), ("q1", "a", 2)])
    assert evaluation.mrr(q, r).first().mrr == 25.0
    late = run(spark, [("q1", "a", 11)])
    assert evaluation.mrr(q, late).first().mrr == 0.0
    assert {x.k: x.map for x in evaluation.mean_average_precision(q, r, (10,)).collect()} == {10: 0.5}
    assert {x.k: x.recall for x in evaluation.recall(q, r, (1, 10)).collect()} == {1: 0.0, 10: 1.0}
    assert evaluation.ndcg(q, r, (10,)).first().ndcg == pytest.approx(1 / np.log2(3), abs=1e-5)
    for rel, want in (([0, 1, 2], 1), ([0, 1, 2, 3], 2)):
        assert evaluation.relevance_threshold(qrels(spark, [("q", str(n), n) for n in rel])).first().threshold == want


def test_topk_ties_and_partitions(spark):
    rng = np.random.default_rng(0)
    vectors = [(i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(300)] + [(300, None)]
    passages = spark.createDataFrame(vectors, "pid bigint, vector array<double>")
    queries = passages.filter("pid < 7").withColumnRenamed("pid", "qid")
    want = retrieval.dense_topk(queries, passages, 5, strategy="expressions").orderBy("qid", "rank").collect()
    for parts in (1, 3, 11):
        assert retrieval.dense_topk(queries, passages.repartition(parts), 5).orderBy("qid", "rank").select("qid", "pid", "score", "rank").collect() == want
    assert retrieval.dense_topk(queries.filter("false"), passages, 5).count() == 0


def test_topk_by_a_join_sorts_few_pairs(spark):
    """The rows of a full sort of all pairs, of which a bound leaves few to sort; widths that differ, null components, equal vectors."""
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(3000)] + [(i, [0.5] * 6) for i in range(3000, 4000)]
    rows += [(4000, [1.0] * 5), (4001, [1.0] * 7), (4002, [None] + [1.0] * 5), (4003, [1.0] * 5 + [None]), (4004, None), (4005, [9.0] * 6)]
    passages = spark.createDataFrame(rows, "pid bigint, vector array<float>")
    queries = passages.filter("pid in (1, 7, 3500)").withColumnRenamed("pid", "qid")

    def by_sort(q):
        pairs = q.crossJoin(passages.filter("vector is not null").withColumnRenamed("vector", "pv"))
        return retrieval.top_k(pairs.select("qid", "pid", F.round(dot(F.col("vector"), F.col("pv")), 6).alias("score")), 9).orderBy("qid", "rank").collect()

    odd = passages.filter("pid in (1, 4000, 4001, 4003)").withColumnRenamed("pid", "qid")  # widths differ: the general product
    broken = passages.filter("pid = 4003").withColumnRenamed("pid", "qid")  # every score is null: all pairs are sorted
    for q in (queries, odd, broken):
        got = retrieval.dense_topk(q, passages, 9, strategy="expressions")
        assert got.orderBy("qid", "rank").collect() == by_sort(q)
    pushed = retrieval.dense_topk(queries, passages, 9, strategy="expressions")
    pushed.collect()
    assert 0 < max(_joined_rows(pushed)) < 3 * 4006 / 4


def _joined_rows(df):
    """Rows that the nested loop joins of an executed plan put out."""
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        if name == "BroadcastNestedLoopJoinExec":
            found.append(node.metrics().apply("numOutputRows").value())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


def test_conversion(spark):
    corpus = spark.createDataFrame([(i, f"t{i}", f"c{i}") for i in range(3)], "doc_idx bigint, title string, contents string")
    examples = spark.createDataFrame([("q", (["2", "5", "0"],), (["1"],)), ("none", ([],), (["9"],))], "query string, positives struct<doc_id:array<string>>, negatives struct<doc_id:array<string>>")
    got = {r.query: r for r in conversion.convert_examples(examples, corpus).collect()}
    assert [tuple(x) for x in got["q"].pos_docs] == [("t2", "c2"), ("t0", "c0")] and [tuple(x) for x in got["q"].neg_docs] == [("t1", "c1")]
    assert got["none"].pos_docs == [] and got["none"].neg_docs == []


def test_sampling(spark):
    rows = spark.range(101)
    ordered = sampling.epoch_order(rows, F.xxhash64("id", F.lit(3)), 4, 2, 5)
    kept = ordered.collect()
    assert sorted(r.pos for r in kept) == list(range(96)) and len({r.id for r in kept}) == 96
    ranks = [{r.id for r in sampling.rank_stride(ordered, n, 2).collect()} for n in range(2)]
    assert not ranks[0] & ranks[1] and len(ranks[0] | ranks[1]) == 96
    assert sampling.resume(ordered, 90).count() == 6
    shards = sampling.contiguous_shard(sampling.positions(rows, [F.col("id")], 3), 101, 4).groupBy("shard").count().orderBy("shard").collect()
    assert [r["count"] for r in shards] == [26, 25, 25, 25]
    lists = spark.createDataFrame([(1, ["a", "b", "c"])], "id int, v array<string>")
    r = lists.select(sampling.one_positive(F.col("v"), F.lit(4)).alias("p"), sampling.some_negatives(F.col("v"), 2, F.col("id")).alias("n")).first()
    assert r.p == "b" and len(set(r.n)) == 2
    with pytest.raises(Exception, match="fewer than 4"):
        lists.select(sampling.some_negatives(F.col("v"), 4, F.col("id"))).collect()


def test_contrastive(spark):
    rows = spark.createDataFrame([(0, 0, [1.0, 0.0]), (0, 1, [0.0, 1.0])], "batch bigint, i bigint, vector array<double>")
    scores = contrastive.score_rows(contrastive.batch_scores(rows, rows, 0.5), contrastive.batch_scores(rows, rows, 0.5, mask_self=True))
    first = scores.filter("i = 0").first().scores
    assert first == [2.0, 0.0, float("-inf"), 0.0]
    assert contrastive.contrastive_loss(scores, F.col("i")).first().loss == pytest.approx(np.log(np.exp(2) + 2) - 2)


def test_embedding(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "id int, text string")
    got = embedding.embed_column(df, "text").collect()
    assert len(got) == 2 and all(len(r.embedding) == 1024 for r in got) and sum(got[1].embedding) == 0
    with pytest.raises(TypeError):
        embedding.embed_column(df, "id")
    with pytest.raises(ValueError):
        embedding.embed_column(df.withColumn("embedding", F.lit(1)), "text")
    with pytest.raises(KeyError):
        embedding.embed_column(df, "missing")
    df.write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # a rerun finds nothing new
        embed_stream(spark, str(tmp_path / "in"), "id int, text string", "text", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_bounded_concurrency(spark):
    import time

    def slow(texts):
        time.sleep(0.05)
        return np.zeros((len(texts), 4), np.float32)

    df = spark.range(3).select(F.col("id").cast("string").alias("t")).coalesce(1)
    began = time.perf_counter()
    embedding.embed_column(df, "t", slow, width=4, batch_size=1, concurrency=1).collect()
    assert time.perf_counter() - began >= 0.14


def test_wins_and_upsert(spark):
    rows = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b")], "key string, at int, v string")
    assert conversion.last_wins(rows, "key", "at").first().v == "b"
    first = conversion.first_wins(rows, "key", "at").first()
    assert first.v == "a" and first.repeats == 1
    up = spark.createDataFrame([("q", 0, "x"), ("q", 1, "y"), ("r", 0, "z")], "qid string, worker int, pid string")
    assert {r.pid for r in retrieval.upsert_by_key(up, "qid", "worker").collect()} == {"y", "z"}


def test_topk_close_scores_and_equal_vectors(spark, monkeypatch):
    """Scores that differ behind the last place kept, many equal vectors, several blocks of queries and runs of passages."""
    rng = np.random.default_rng(2)
    rows = [(i, [float(v) for v in rng.choice([0.12345641, 0.12345649, 0.5, -0.12345649], 2)]) for i in rng.permutation(400)]
    passages = spark.createDataFrame([(int(i), v) for i, v in rows], "pid bigint, vector array<double>")
    queries = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "qid bigint, vector array<double>")
    want = retrieval.dense_topk(queries, passages, 7, strategy="expressions").orderBy("qid", "rank").select("qid", "pid", "score", "rank").collect()
    for parts, block, run_rows in ((1, 8192, 1 << 18), (3, 2, 50), (5, 1, 1)):
        monkeypatch.setattr(retrieval, "QUERY_BLOCK", block)
        monkeypatch.setattr(retrieval, "PASSAGE_RUN", run_rows)
        assert retrieval.dense_topk(queries, passages.repartition(parts), 7).orderBy("qid", "rank").select("qid", "pid", "score", "rank").collect() == want
    with pytest.raises(ValueError, match="use blocks"):
        retrieval.dense_topk(queries, passages, 7, strategy="expressions")
    score, pid = retrieval.best_of(np.ones((2, 9)), np.array([rng.permutation(9) for _ in range(2)]), 4)
    assert score.shape == (2, 4) and (np.sort(pid, axis=1) == np.arange(4)).all()


def test_short_shards_are_an_error(spark):
    runs = spark.createDataFrame([("q", i, float(i), i % 2) for i in range(5)], "qid string, pid int, score double, shard int")
    assert [r.pid for r in retrieval.merge_shards(runs, 2, "shard").orderBy("rank").collect()] == [4, 3]
    with pytest.raises(Exception, match="fewer than 3 rows of a query in shard 1"):
        retrieval.merge_shards(runs, 3, "shard").collect()
