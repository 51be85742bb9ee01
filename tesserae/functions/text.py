"""Text expressions."""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def strip(text: Column) -> Column:
    """Without white space at both ends, tabs included."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def tab_fields(line: Column) -> Column:
    return F.split(strip(line), "\t")


def normalize_quotes(value: Column | str) -> Column:
    """Takes outer quotes off as long as there is a pair, halving doubled quotes inside each time; a lone quote is empty.

    Every pair taken off shortens the run of quotes in front, so the run's length bounds the steps.
    """
    value = F.col(value) if isinstance(value, str) else value
    run = F.length(F.regexp_extract(value, '^"*', 0))
    inner = lambda t: F.replace(F.substring(t, F.lit(2), F.length(t) - 2), F.lit('""'), F.lit('"'))
    return F.when(run == 0, value).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(run, F.lit(1))), value, lambda t, _: F.when(t.startswith('"') & t.endswith('"'), inner(t)).otherwise(t)))


@F.pandas_udf(T.ArrayType(T.StringType()))
def parse_list_literal(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Strings of a list literal, read as data and never evaluated."""
    for batch in texts:
        yield batch.map(lambda t: None if t is None else [str(x) for x in ast.literal_eval(t)])


def bucket_and_key(uri: Column) -> tuple[Column, Column]:
    """Bucket and key of an s3:// address; another scheme, no bucket or an empty key is an error."""
    bucket, key = F.regexp_extract(uri, r"^s3://([^/]*)", 1), F.regexp_replace(F.regexp_extract(uri, r"^s3://[^/]*(/.*)?$", 1), "^/+", "")
    ok = uri.startswith("s3://") & (bucket != "") & (key != "")
    fail = F.raise_error(F.concat(F.lit("not an object address: "), F.coalesce(uri, F.lit("null"))))
    return F.when(ok, bucket).otherwise(fail), F.when(ok, key).otherwise(fail)


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """Scheme, host and path without leading slashes; empty where absent."""
    pattern = r"^([a-z0-9+.-]+)://([^/?#]*)([^?#]*)"
    return F.regexp_extract(url, pattern, 1), F.regexp_extract(url, pattern, 2), F.regexp_replace(F.regexp_extract(url, pattern, 3), "^/+", "")


def shard_numbers(path: Column) -> tuple[Column, Column]:
    """The two trailing integers of a name like shard_<worker>_<n>."""
    parts = F.split(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[A-Za-z]+$", ""), "_")
    return F.element_at(parts, -2).cast("int"), F.element_at(parts, -1).cast("int")


def tokenize_pair(tokenizer: Callable[[str, str], list[int]] | None = None, max_length: int = 512):
    """A UDF of (title, contents) to token ids cut to ``max_length``; without a tokenizer, hashes of space-split words."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        import zlib

        fn = tokenizer or (lambda a, b: [zlib.crc32(w.encode()) & 0x7FFFFFFF for w in f"{a} {b}".split()])
        for titles, contents in batches:
            yield pd.Series([fn(a or "", b or "")[:max_length] for a, b in zip(titles, contents, strict=True)])

    return run
