"""Intermediate tables in the shared folder, so that lost executors cost one stage and lineage stays short."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

from tesserae.session import shared_dir, ship


_made: list[str] = []  # tables written since the outermost ``scratch`` began
_open: list[int] = []


def materialize(df: DataFrame) -> DataFrame:
    """Writes ``df`` once as Parquet in the shared folder and reads it back: a compact checkpoint."""
    path = f"{shared_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _open:
        _made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Of the tables that ``materialize`` makes within it only those of the yielded function stay; the others are deleted at the end."""
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        out = materialize(df)
        kept.add(_made[-1])
        return out

    first = len(_made)
    _open.append(first)
    try:
        yield keep
    finally:
        _open.pop()
        for path in _made[first:]:
            if path not in kept:
                _delete(spark, path)
        _made[first:] = [path for path in _made[first:] if path in kept] if _open else []


def _delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def drop(df: DataFrame) -> None:
    """Deletes the files of a table made by ``materialize`` that nothing will read again."""
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, parent)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")

