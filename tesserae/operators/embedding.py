"""Appending an embedding column."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WIDTH = 1024


def hash_embedder(width: int = WIDTH) -> Callable[[list[str]], np.ndarray]:
    """A deterministic stand-in for a model: unit vectors of signed word hashes, each different word of a batch hashed once.

    Words are runs without ASCII white space; the first 32 bits of a word's MD5 give its place, the highest its sign.
    """

    def embed(texts: list[str]) -> np.ndarray:
        import hashlib

        words = [t.encode().split() for t in texts]
        place = {w: int.from_bytes(hashlib.md5(w, usedforsecurity=False).digest()[:4], "big") for w in {w for each in words for w in each}}
        h = np.array([place[w] for each in words for w in each], np.int64)
        row = np.repeat(np.arange(len(texts)), [len(each) for each in words])
        out = np.bincount(row * width + h % width, np.where(h >> 31, 1.0, -1.0), len(texts) * width).reshape(len(texts), width)
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).astype(np.float32)

    return embed


def embed_column(df: DataFrame, text_col: str, embedder: Callable[[list[str]], np.ndarray] | None = None, width: int = WIDTH, batch_size: int = 32, concurrency: int = 4, out: str = "embedding") -> DataFrame:
    """``df`` with an array<float> column. A missing or non-text column, or one named ``out`` already, is an error; null text is empty.

    Batches of ``batch_size`` go to the embedder, at most ``concurrency`` at a time in each task, as they are pulled.
    """
    if not isinstance(df.schema[text_col].dataType, T.StringType):
        raise TypeError(f"{text_col} is {df.schema[text_col].dataType.simpleString()}, not text")
    if out in df.columns:
        raise ValueError(f"there is a column {out} already")
    fn = embedder or hash_embedder(width)

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with ThreadPoolExecutor(concurrency) as pool:
            for texts in batches:
                values = texts.fill_null("").to_pylist()
                parts = list(pool.map(fn, [values[i : i + batch_size] for i in range(0, len(values), batch_size)]))
                if any(len(r) != width for part in parts for r in part):
                    raise ValueError(f"the embedder's vectors aren't {width} wide")
                flat = np.concatenate([np.asarray(part, np.float32).ravel() for part in parts]) if parts else np.zeros(0, np.float32)
                yield pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * width, pa.int32()), pa.array(flat))

    return df.withColumn(out, run(F.col(text_col)))
