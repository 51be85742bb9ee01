"""Expressions on hand-computed rows."""

import math

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tesserae.functions import bits, geometry, text, vectors


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_bits(spark):
    rows = spark.createDataFrame([(0,), (-1,), (1,), (-2,), (2,), (2**62,), (-(2**63),)], "n bigint")
    got = rows.select("n", bits.zigzag(F.col("n")).alias("z"), bits.unzigzag(bits.zigzag(F.col("n"))).alias("back"), bits.varint_length(F.col("n")).alias("len"), bits.varint("n").alias("v")).collect()
    assert [r.z for r in got[:5]] == [0, 1, 2, 3, 4]
    assert all(r.back == r.n for r in got)
    assert all(r.len == len(r.v) for r in got)


@given(st.integers(0, 2**64 - 1))
def test_varint_round_trip(n):
    raw = bits.varint_bytes(n)
    assert bits.varint_value(raw) == (n, len(raw))


def test_compact_records():
    assert bits.user_bytes({"id": 123}) == bytes.fromhex("15F60100")
    assert bits.user_bytes({"id": 123, "name": "Alice"}) == bytes.fromhex("15F6011805416C69636500")
    full = {"id": 456, "name": "Bob", "email": None, "tags": ["a"] * 20, "attributes": {"x": -3, "y": 7}}
    fields, end = bits.read_struct(bits.user_bytes(full))
    assert fields == {1: 456, 2: b"Bob", 4: [b"a"] * 20, 5: {b"x": -3, b"y": 7}} and end == len(bits.user_bytes(full))
    users, _ = bits.read_struct(bits.collection_bytes([{"id": 1}, {"id": 2, "name": "n"}]))
    assert users == {1: [{1: 1}, {1: 2, 2: b"n"}]}


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(1.0), F.lit(2.0))
    r = one(spark, dot=vectors.dot(a, b), norm=vectors.norm(a), unit=vectors.normalize(a), zero=vectors.normalize(F.array(F.lit(0.0))), mean=vectors.mean_pool(F.array(a, b)), first=vectors.first_token(F.array(a, b)), best=vectors.argmax(b), loss=vectors.cross_entropy(a, F.lit(1)))
    assert r.dot == 11 and r.norm == 5 and r.unit == [0.6, 0.8] and r.zero == [0.0] and r.mean == [2.0, 3.0] and r["first"] == [3.0, 4.0] and r.best == 1
    assert r.loss == pytest.approx(math.log(1 + math.exp(-1)))
    masked = one(spark, loss=vectors.cross_entropy(F.array(F.lit(float("-inf")), F.lit(0.0)), F.lit(1)))
    assert masked.loss == pytest.approx(0)


def test_arrays(spark):
    r = one(spark, preset=vectors.parse_preset(F.lit("1, 0,0,-1")), none=vectors.parse_preset(F.lit("")), ring=vectors.circular_slice(F.array(F.lit(1), F.lit(2), F.lit(3)), F.lit(2), F.lit(4)), empty=vectors.circular_slice(F.array().cast("array<int>"), F.lit(1), F.lit(2)))
    assert r.preset == [1, 0, 0, -1] and r.none is None and r.ring == [3, 1, 2, 3] and r.empty == []


def test_quotes_and_lists(spark):
    cases = {'"He said ""hi"""': 'He said "hi"', '"': "", "": "", '""a""': "a", "plain": "plain", None: None}
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", text.normalize_quotes("t").alias("n")).collect()
    assert {r.t: r.n for r in got} == cases
    assert spark.createDataFrame([("['x', 'y']",)], "t string").select(text.parse_list_literal("t").alias("a")).first().a == ["x", "y"]
    bad = spark.createDataFrame([("__import__('os')",)], "t string").select(text.parse_list_literal("t").alias("a"))
    with pytest.raises(Exception, match="malformed"):
        bad.collect()


def test_addresses(spark):
    bucket, key = text.bucket_and_key(F.col("u"))
    good = spark.createDataFrame([("s3://b/k/f",), ("s3://b//x",)], "u string").select(bucket.alias("b"), key.alias("k")).collect()
    assert [tuple(r) for r in good] == [("b", "k/f"), ("b", "x")]
    for u in ("s3://b/", "http://b/k", "s3:///k"):
        with pytest.raises(Exception, match="not an object address"):
            spark.createDataFrame([(u,)], "u string").select(bucket, key).collect()
    worker, shard = text.shard_numbers(F.col("p"))
    got = spark.createDataFrame([("/a/shard_0_10.parquet",), ("shard_0_2",)], "p string").select(worker.alias("w"), shard.alias("s")).orderBy("w", "s").collect()
    assert [tuple(r) for r in got] == [(0, 2), (0, 10)]


def test_tokenizer(spark):
    got = spark.createDataFrame([("a b", "c"), (None, "d")], "t string, c string").select(text.tokenize_pair(max_length=2)("t", "c").alias("ids")).collect()
    assert [len(r.ids) for r in got] == [2, 1]


def test_geometry(spark):
    det = geometry.determinant(*map(F.lit, (1.0, 2.0, 2.0, 4.0)))
    r = one(spark, d=geometry.orientation(det), p=geometry.orientation(F.lit(2.0)), m=geometry.orientation(F.lit(-1.0)))
    assert tuple(r) == ("degenerate", "preserved", "reversed")
    points = geometry.segment(3, *map(F.lit, (0.0, 0.0, 2.0, 4.0)))
    assert [tuple(p) for p in one(spark, s=points).s] == [(0, 0), (1, 2), (2, 4)]
    assert geometry.grid(spark).count() == 50
    assert spark.createDataFrame([(0.5, 0.5)], "x double, y double").agg(geometry.view_extent().alias("e")).first().e == 2.2
    steps = spark.createDataFrame([(0,), (10,), (20,), (120,)], "s int").select(geometry.warmup_linear(F.col("s"), 10, 110).alias("f")).collect()
    assert np.allclose([r.f for r in steps], [0.5, 1, 0.9, 0])
