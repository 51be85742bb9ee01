"""Readers, writers and the metadata source on files of their own."""

import gzip
import json

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tesserae.operators import conversion
from tesserae.sources import parquet_meta, parquet_values, readers, sinks, synthetic


def write(path, value):
    path.write_text(value, encoding="utf-8")
    return str(path)


def test_queries_keep_the_last(spark, tmp_path):
    assert [tuple(r) for r in readers.queries_tsv(spark, write(tmp_path / "q.tsv", "1\ta\n1\tb\n\n2\tc\t\n")).orderBy("qid").collect()] == [("1", "b"), ("2", "c")]
    with pytest.raises(Exception, match="expected 2 fields"):
        readers.queries_tsv(spark, write(tmp_path / "bad.tsv", "1\ta\tb\n")).collect()
    with pytest.raises(ValueError):
        readers.queries_tsv(spark, str(tmp_path / "q.csv"))


def test_answers_keep_the_first(spark, tmp_path):
    got = readers.answers_tsv(spark, write(tmp_path / "a.tsv", "q\t['x']\nq\t['y']\n\"say \"\"hi\"\"\"\t\"['z']\"\n")).orderBy("question").collect()
    assert [tuple(r) for r in got] == [("q", ["x"]), ('say "hi"', ["z"])]


def test_qrels_and_runs(spark, tmp_path):
    assert [tuple(r) for r in readers.qrels_tsv(spark, write(tmp_path / "r.txt", "q\t0\tp\t1\nq\t0\tp\t2\n")).collect()] == [("q", "p", 2)]
    run = readers.run_tsv(spark, write(tmp_path / "run.txt", "q\tp\t3\nq\tr\t4\t0.7\n")).orderBy("rank").collect()
    assert [tuple(r) for r in run] == [("q", "p", 3, 0.3333), ("q", "r", 4, 0.7)]


def test_jsonl_and_splits(spark, tmp_path):
    with gzip.open(tmp_path / "p.jsonl.gz", "wt") as f:
        f.write(json.dumps({"title": "t", "contents": "é"}) + "\n")
    assert tuple(readers.jsonl(spark, str(tmp_path / "p.jsonl.gz"), readers.PASSAGES).first()) == ("t", "é")
    a = write(tmp_path / "a.jsonl", '{"title":"1"}\n')
    assert {(r.title, r.split) for r in readers.splits(spark, readers.PASSAGES, train=a, validation=a).collect()} == {("1", "train"), ("1", "validation")}


def test_boxes(spark, tmp_path):
    image = {"id": 1, "file_name": "x.png", "height": 200, "width": 100}
    path = write(tmp_path / "c.json", json.dumps({"annotations": [{"image_id": 1, "category_id": 1, "bbox": [10, 20, 30, 40]}], "images": [image | {"width": 5}, image]}))
    boxes = conversion.normalized_boxes(*readers.coco(spark, path))
    lines = conversion.box_lines(boxes, "test")
    assert tuple(lines.first()) == ("valid", "x.txt", "0 0.25 0.2 0.3 0.2")
    assert sinks.write_boxes(lines, str(tmp_path / "out")) == 1
    assert (tmp_path / "out/valid/x.txt").read_text() == "0 0.25 0.2 0.3 0.2\n"
    missing = spark.createDataFrame([(2, 1, [0.0] * 4)], "image_id bigint, category_id bigint, bbox array<double>")
    with pytest.raises(Exception, match="no image 2"):
        conversion.normalized_boxes(missing, readers.coco(spark, path)[1]).collect()


def test_shards_in_number_order(spark, tmp_path):
    for name in ("shard_0_10", "shard_0_2"):
        pq.write_table(pa.table({"v": [[1.0], [2.0]]}), tmp_path / name)
    got = readers.vector_shards(spark, str(tmp_path)).orderBy("worker", "shard", "row").collect()
    assert [(r.worker, r.shard, r.row) for r in got] == [(0, 2, 0), (0, 2, 1), (0, 10, 0), (0, 10, 1)]
    assert readers.file_sizes(spark, str(tmp_path)).agg(F.count("*")).first()[0] == 2


def test_parquet_writer(spark, tmp_path):
    out = str(tmp_path / "p")
    sinks.write_parquet(spark.range(1000).coalesce(1), out, group_rows=sinks.row_group_rows(1000, count=10))
    meta = parquet_meta.parquet_meta(spark, [str(p) for p in (tmp_path / "p").glob("*.parquet")]).first()
    assert meta.num_rows == 1000 and meta.row_groups == 10
    with pytest.raises(ValueError):
        sinks.write_parquet(spark.range(0), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()
    assert sinks.row_group_rows(10, count=3) == 4 and sinks.row_group_rows(10, size=5) == 5 and sinks.row_group_rows(10) is None
    with pytest.raises(ValueError):
        sinks.row_group_rows(10, 1, 1)


def test_metadata_source(spark, tmp_path):
    path = str(tmp_path / "toy.parquet")
    pq.write_table(pa.table({"id": list(range(5)), "s": list("aabbc")}), path, compression="zstd")
    chunk = parquet_meta.parquet_meta(spark, [path], "column_chunk").filter("path = 'id'").first()
    assert (chunk.num_values, chunk.null_count, chunk.min_hex, chunk.max_hex, chunk.codec) == (5, 0, "00" * 8, "04" + "00" * 7, "ZSTD")
    pages = parquet_meta.parquet_meta(spark, [path], "page").orderBy("column", "page").collect()
    assert [(p.column, p.kind, p.num_values) for p in pages] == [(0, "dictionary", 5), (0, "data", 5), (1, "dictionary", 3), (1, "data", 5)]
    assert {(r.name, r.type) for r in parquet_meta.parquet_meta(spark, [path], "arrow_schema").collect()} == {("id", "int64"), ("s", "string")}
    broken = tmp_path / "broken.parquet"
    broken.write_bytes(b"PAR1" + b"x" * 20)
    with pytest.raises(Exception, match="PAR1"):
        parquet_meta.parquet_meta(spark, [str(broken)]).collect()


def test_sinks(spark, tmp_path):
    run = spark.createDataFrame([("q", "a", 1, 0.12345), ("q", "b", 2, 0.5)], "qid string, pid string, rank int, score double")
    sinks.write_run(run, str(tmp_path / "run"))
    assert {r.value for r in spark.read.text(str(tmp_path / "run")).collect()} == {"q\ta\t1\t0.1235", "q\tb\t2\t0.5"}
    assert [tuple(r) for r in sinks.renumbered(run).orderBy("rank").collect()] == [("q", "b", 1, 0.5), ("q", "a", 2, 0.123)]
    sinks.write_metrics({"é": 1}, str(tmp_path / "m.json"))
    assert "é" in (tmp_path / "m.json").read_text(encoding="utf-8")
    sinks.write_jsonl(run, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    assert sinks.preview(spark.range(8), "id") == "0, 1, 2, 3, 4 ... and 3 more"
    timer = sinks.StageTimer()
    timer.run("write", lambda: timer.observed(run, "pid").write.format("noop").mode("overwrite").save())
    assert timer.report()["rows"] == 2


def test_synthetic(spark):
    t = synthetic.text_table(spark, 20, text_words=7, query_words=2, width=16)
    r = t.first()
    assert len(r.text.split()) == 7 and len(r.query.split()) == 2 and len(r.embedding) == 16
    assert t.collect() == synthetic.text_table(spark, 20, text_words=7, query_words=2, width=16).collect()
    big = synthetic.text_table(spark, 200, width=50).select(F.explode("embedding").alias("x")).agg(F.avg("x").alias("m"), F.stddev("x").alias("s")).first()
    assert abs(big.m) < 0.05 and abs(big.s - 1) < 0.05
    assert synthetic.user_table(spark, 3).filter("user_id >= 0 and user_id < 4294967296").count() == 3
    assert synthetic.user_records(spark).count() == 2 and synthetic.toy_table(spark).count() == 5


def test_page_values(spark, tmp_path):
    """Every encoding, codec and page version against what was written, nulls, long runs and packed groups among it."""
    rng = np.random.default_rng(1)
    values = {
        "few": [int(x) if x else None for x in rng.integers(0, 9, 5000)],
        "many": [int(x) for x in rng.integers(-(2**62), 2**62, 5000)],
        "runs": [7] * 3000 + [None] * 1000 + [8, 9] * 500,
        "nulls": [None] * 5000,
    }
    kind = pa.schema([pa.field(n, pa.int64(), nullable=n != "many") for n in values])
    for i, (codec, version, dictionary) in enumerate([("none", "1.0", True), ("snappy", "2.0", True), ("zstd", "1.0", False), ("gzip", "2.0", False)]):
        path = str(tmp_path / f"{i}.parquet")
        pq.write_table(pa.table(values, schema=kind), path, compression=codec, data_page_version=version, use_dictionary=dictionary, row_group_size=2000, data_page_size=1024)
        for name, want in values.items():
            got = parquet_values.int64_values(spark, [path], name).orderBy("row").collect()
            assert [r.value for r in got] == want and {r.row_group for r in got} == {0, 1, 2}
    assert parquet_values.looked_up(np.array([5, 6]), np.array([1, 2, 0])).tolist() == [6, 0, 5]
    assert parquet_values.unpacked(bytes([0b10001000, 0b11000110, 0b11111010]), 3).tolist() == list(range(8))
    assert parquet_values.hybrid(bytes([8, 3, 3, 0b10001000, 0b11000110, 0b11111010]), 0, 3, 9).tolist() == [3, 3, 3, 3, 0, 1, 2, 3, 4]
    with pytest.raises(ValueError, match="no column"):
        parquet_values.optional([{4: b"schema"}], "x")
    with pytest.raises(ValueError, match="codec 3"):
        parquet_values.decompressed(b"", 3, 0)


def test_first_batch_and_removal(spark, tmp_path):
    timer = sinks.StageTimer()
    df = timer.observed(spark.range(10).selectExpr("cast(id as string) as t"), "t")
    assert timer.first_batch(spark.range(1000)) > 0
    timer.run("write", lambda: df.write.parquet(str(tmp_path / "w0")))
    assert timer.report()["first_batch_s"] >= 0 and timer.report()["rows"] == 10
    assert sinks.remove(str(tmp_path / "w0")) and not (tmp_path / "w0").exists()
    (tmp_path / "f").write_text("x")
    assert sinks.remove(f"file://{tmp_path}/f") and not sinks.remove(str(tmp_path / "f"))
