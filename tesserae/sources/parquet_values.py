"""Values of INT64 columns from Parquet pages: ``spark.read.format("parquet_int64")``.

Options: ``paths`` (comma-separated files) and ``column``. Each row group of a file is one task. The built-in reader is the
way to read tables; this one shows what single pages hold, and reads files whose dictionary indexes are damaged.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tesserae.functions.bits import read_struct, varint_value
from tesserae.sources.parquet_meta import footer, opened

SCHEMA = "file string, row_group bigint, row bigint, value bigint"
#: Fixed values of the format: codecs by number, and encodings of values.
CODECS = {1: "snappy", 2: "gzip", 4: "brotli", 6: "zstd", 7: "lz4_raw"}
PLAIN, DICTIONARY = 0, (2, 8)


def unpacked(data: bytes, width: int) -> np.ndarray:
    """Integers of ``width`` bits each, lowest bit first."""
    bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")
    bits = bits[: len(bits) // width * width].reshape(-1, width).astype(np.int64)
    return bits @ (np.int64(1) << np.arange(width, dtype=np.int64))


def hybrid(data: bytes, at: int, width: int, count: int) -> np.ndarray:
    """``count`` integers of runs that repeat one value or pack groups of eight."""
    parts, have = [], 0
    while have < count and width:
        head, at = varint_value(data, at)
        if head & 1:
            size = (head >> 1) * width
            parts.append(unpacked(data[at : at + size], width))
        else:
            size = (width + 7) // 8
            parts.append(np.full(head >> 1, int.from_bytes(data[at : at + size], "little"), np.int64))
        at += size
        have += len(parts[-1])
    return np.concatenate(parts)[:count] if parts else np.zeros(count, np.int64)


def looked_up(dictionary: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Values by index; an index that the dictionary doesn't have is 0."""
    if not len(dictionary):
        return np.zeros(len(index), np.int64)
    return np.where(index < len(dictionary), dictionary[np.minimum(index, len(dictionary) - 1)], 0)


def decompressed(data: bytes, codec: int, size: int) -> bytes:
    """A page's bytes; an unknown codec or another size than the header's is an error."""
    if codec == 0:
        out = data
    elif codec in CODECS:
        out = pa.Codec(CODECS[codec]).decompress(data, size).to_pybytes()
    else:
        raise ValueError(f"codec {codec}")
    if len(out) != size:
        raise ValueError(f"a page of {len(out)} bytes, not {size}")
    return out


def optional(schema: list[dict], name: str) -> bool:
    """Whether a top-level column may be null; the first element of that name counts. Repeated and nested ones are an error."""
    for element in schema[1:]:
        if element[4].decode() == name:
            if element.get(3) == 2 or element.get(5):
                raise ValueError(f"{name} is not a plain column")
            return element.get(3) == 1
    raise ValueError(f"no column {name}")


def chunk_values(file, info: dict, nullable: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(values, which of them are there) of each data page of a column chunk."""
    if info[1] != 2:
        raise ValueError("not an INT64 column")
    at = info.get(11) or info[9]
    end, left, dictionary = at + info[7], info[5], np.zeros(0, np.int64)
    while left > 0 and at < end:
        file.seek(at)
        raw = file.read(min(end - at, 1 << 16))
        head, used = read_struct(raw)
        body = raw[used : used + head[3]]
        if len(body) < head[3]:
            file.seek(at + used)
            body = file.read(head[3])
        at += used + head[3]
        if head[1] == 2:
            dictionary = np.frombuffer(decompressed(body, info[4], head[2]), "<i8")
            continue
        there = None
        if head[1] == 0:
            n, encoding = head[5][1], head[5][2]
            body, skip = decompressed(body, info[4], head[2]), 0
            if nullable:
                (size,) = struct.unpack_from("<i", body)
                there, skip = hybrid(body, 4, 1, n) == 1, 4 + size
            body = body[skip:]
        elif head[1] == 3:
            v2 = head[8]
            n, encoding, levels = v2[1], v2[4], v2[5] + v2[6]
            if nullable:
                there = hybrid(body, v2[6], 1, n) == 1 if v2[5] else np.ones(n, bool)
            body = decompressed(body[levels:], info[4] if v2.get(7, True) else 0, head[2] - levels)
        else:
            continue
        there = np.ones(n, bool) if there is None else there
        count, values = int(there.sum()), np.zeros(n, np.int64)
        if encoding == PLAIN:
            values[there] = np.frombuffer(body, "<i8", count)
        elif encoding in DICTIONARY:
            values[there] = looked_up(dictionary, hybrid(body, 1, body[0], count)) if count else 0
        else:
            raise ValueError(f"INT64 values in encoding {encoding}")
        left -= n
        yield values, there


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], column: str):
        self.paths, self.column = paths, column

    def partitions(self):
        return [InputPartition((p, g)) for p in self.paths for g in range(len(read_struct(footer(p)[1])[0].get(4, [])))]

    def read(self, partition):
        path, group = partition.value
        meta, _ = read_struct(footer(path)[1])
        nullable = optional(meta[2], self.column)
        row = sum(g[3] for g in meta[4][:group])
        info = next(c[3] for c in meta[4][group][1] if c[3][3] == [self.column.encode()])
        with opened(path) as file:
            for values, there in chunk_values(file, info, nullable):
                n = len(values)
                yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array(np.full(n, group)), pa.array(np.arange(row, row + n)), pa.array(values, mask=~there)], names=["file", "row_group", "row", "value"])
                row += n


class ParquetInt64(DataSource):
    @classmethod
    def name(cls):
        return "parquet_int64"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader([p for p in self.options["paths"].split(",") if p], self.options["column"])


def int64_values(spark: SparkSession, paths: list[str], column: str) -> DataFrame:
    """(file, row_group, row, value) of an INT64 column, decoded page by page."""
    spark.dataSource.register(ParquetInt64)
    return spark.read.format("parquet_int64").option("paths", ",".join(paths)).option("column", column).load()
