"""Writers."""

from __future__ import annotations

import json
import math
import time

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

CODECS = {"none": "uncompressed"}


def row_group_rows(rows: int, size: int | None = None, count: int | None = None) -> int | None:
    """Rows per group from a size or a number of groups; both is an error."""
    if size is not None and count is not None:
        raise ValueError("give a row group size or a number of row groups, not both")
    return math.ceil(rows / count) if count is not None else size


def write_parquet(df: DataFrame, path: str, codec: str = "zstd", group_rows: int | None = None, file_rows: int | None = None, mode: str = "error", allow_empty: bool = False) -> None:
    """Parquet with a codec and row limits per group and file. Empty input is an error that leaves no files."""
    if not allow_empty and df.isEmpty():
        raise ValueError("there are no rows to write")
    writer = df.write.mode(mode).option("compression", CODECS.get(codec, codec))
    if group_rows:
        writer = writer.option("parquet.block.row.count.limit", group_rows)
    if file_rows:
        writer = writer.option("maxRecordsPerFile", file_rows)
    writer.parquet(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_metrics(values: dict, path: str) -> None:
    """One small record as indented JSON, characters as they are."""
    store, at = file_system(path)
    with store.open_output_stream(at) as out:
        out.write(json.dumps(values, ensure_ascii=False, indent=4).encode())


def renumbered(run: DataFrame, digits: int = 3) -> DataFrame:
    """(qid, pid, rank, score) with ranks counted anew per query and rounded scores."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "pid")
    return run.select("qid", "pid", F.row_number().over(order).cast("long").alias("rank"), F.round("score", digits).alias("score"))


def write_run(run: DataFrame, path: str, digits: int = 4, renumber: bool = False) -> None:
    """Tab-separated qid, pid, rank, score."""
    out = renumbered(run, digits) if renumber else run.select("qid", "pid", "rank", F.round("score", digits).alias("score"))
    out.write.mode("overwrite").option("sep", "\t").csv(path)


def write_boxes(boxes: DataFrame, path: str) -> int:
    """<path>/<split>/<label_file> of (split, label_file, line), one line per box in order; returns how many files.

    Tasks write files of their own through the file system of ``path`` (a scheme or else a folder all machines share). A
    repeated task writes the same files again.
    """
    lines = boxes.groupBy("split", "label_file").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("value"))

    def run(batches):
        made: set[str] = set()
        for batch in batches:
            for split, name, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, at = file_system(f"{path}/{split}/{name}")
                folder = at.rpartition("/")[0]
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                with store.open_output_stream(at) as out:
                    out.write(f"{value}\n".encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["files"])

    return lines.mapInArrow(run, "files long").agg(F.coalesce(F.sum("files"), F.lit(0))).first()[0]


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it; s3a is s3, no scheme is this machine's."""
    scheme, _, rest = path.rpartition(":/")
    if scheme in ("", "file"):
        return fs.LocalFileSystem(), "/" + rest.lstrip("/") if scheme else path
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def remove(path: str) -> bool:
    """Deletes a file, or a folder with all in it, such as the runs of single workers once they are merged; whether it was there."""
    store, at = file_system(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.Directory:
        store.delete_dir(at)
    elif info.type == fs.FileType.File:
        store.delete_file(at)
    return info.type != fs.FileType.NotFound


def preview(df: DataFrame, column: str, first: int = 5) -> str:
    """The first values and how many more there are."""
    values, total = [r[0] for r in df.select(column).limit(first).collect()], df.count()
    return ", ".join(map(str, values)) + (f" ... and {total - len(values)} more" if total > len(values) else "")


class StageTimer:
    """Seconds, share, rows/s and MiB/s of named stages."""

    def __init__(self):
        self.seconds: dict[str, float] = {}
        self.observation = Observation()
        self.first: float | None = None

    def observed(self, df: DataFrame, text_col: str) -> DataFrame:
        return df.observe(self.observation, F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length(text_col)).alias("bytes"))

    def run(self, name: str, action):
        began = time.perf_counter()
        out = action()
        self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - began
        return out

    def first_batch(self, df: DataFrame) -> float:
        """Seconds until the first row of ``df`` is there; only the partitions that it takes are computed."""
        began = time.perf_counter()
        df.limit(1).collect()
        self.first = time.perf_counter() - began
        return self.first

    def report(self) -> dict:
        got, total = self.observation.get, sum(self.seconds.values())
        floor = max(total, 1e-9)
        stages = {k: {"seconds": round(v, 3), "percent": round(100 * v / floor, 1)} for k, v in self.seconds.items()}
        first = {"first_batch_s": round(self.first, 3)} if self.first is not None else {}
        return first | {"rows": got["rows"], "rows_per_s": got["rows"] / floor, "mib_per_s": (got["bytes"] or 0) / 1048576 / floor, "stages": stages}
