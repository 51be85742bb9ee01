"""A data source over Parquet footers and page headers: ``spark.read.format("parquet_meta")``.

Options: ``paths`` (comma-separated files), ``mode``: file, column_chunk, page or arrow_schema. Each file is one task.
"""

from __future__ import annotations

import base64
import json
import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tesserae.functions.bits import read_struct
from tesserae.sources.sinks import file_system

SCHEMAS = {
    "file": "file string, version string, num_rows bigint, created_by string, row_groups bigint, columns bigint, footer_bytes bigint, schema string, key_values map<string,string>",
    "column_chunk": "file string, row_group bigint, column bigint, path string, physical_type string, codec string, encodings string, num_values bigint, null_count bigint, distinct_count bigint, min_hex string, max_hex string, compressed_bytes bigint, uncompressed_bytes bigint, data_offset bigint, dictionary_offset bigint",
    "page": "file string, row_group bigint, column bigint, page bigint, kind string, num_values bigint, encoding bigint, compressed_bytes bigint, uncompressed_bytes bigint, error string",
    "arrow_schema": "file string, name string, type string, nullable boolean",
}
_KINDS = {0: "data", 1: "index", 2: "dictionary", 3: "data_v2"}
#: Place of the header of each kind in a page header, and of its encoding.
_HEADERS = {0: (5, 2), 2: (7, 2), 3: (8, 4)}


def opened(path: str):
    """A file of any store that ``file_system`` knows, open for reading."""
    store, at = file_system(path)
    return store.open_input_file(at)


def footer(path: str) -> tuple[int, bytes]:
    """Length and bytes of a footer; bad magic or length is an error."""
    with opened(path) as f:
        f.seek(0, 2)
        size = f.tell()
        if size < 12:
            raise ValueError(f"{path}: too short for Parquet")
        f.seek(0)
        head = f.read(4)
        f.seek(size - 8)
        length, tail = struct.unpack("<i4s", f.read(8))
        if head != b"PAR1" or tail != b"PAR1":
            raise ValueError(f"{path}: no PAR1 at start or end")
        if not 0 < length <= size - 12:
            raise ValueError(f"{path}: footer of {length} bytes")
        f.seek(size - 8 - length)
        return length, f.read(length)


def arrow_schema(encoded: str):
    """The schema in a base64 IPC message, with or without its continuation marker."""
    import pyarrow as pa

    raw = base64.b64decode(encoded)
    if raw[:4] != b"\xff\xff\xff\xff":
        raw = b"\xff\xff\xff\xff" + struct.pack("<i", len(raw)) + raw
    return pa.ipc.read_schema(pa.py_buffer(raw))


def pages(path: str):
    """Page header rows of every column chunk, dictionary page first; a header that can't be read ends its chunk with an error row."""
    meta, _ = read_struct(footer(path)[1])
    with opened(path) as f:
        for g, group in enumerate(meta.get(4, [])):
            for c, chunk in enumerate(group[1]):
                info = chunk.get(3)
                if info is None:
                    yield (path, g, c, 0, None, None, None, None, None, "no column metadata")
                    continue
                at, seen, page = info.get(11) or info[9], 0, 0
                end = at + info[7]
                while seen < info[5] and at < end:
                    f.seek(at)
                    try:
                        head, used = read_struct(f.read(min(1 << 16, end - at)))
                        place, coding = _HEADERS[head[1]]
                        inner = head[place]
                    except (IndexError, KeyError, ValueError) as error:
                        yield (path, g, c, page, None, None, None, None, None, f"page header: {error!r}")
                        break
                    yield (path, g, c, page, _KINDS[head[1]], inner[1], inner.get(coding), head[3], head[2], None)
                    seen += inner[1] if head[1] != 2 else 0
                    at, page = at + used + head[3], page + 1


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], mode: str):
        self.paths, self.mode = paths, mode

    def partitions(self):
        return [InputPartition(p) for p in self.paths]

    def read(self, partition):
        import pyarrow.parquet as pq

        path = partition.value
        length, _ = footer(path)
        with opened(path) as f:
            meta = pq.read_metadata(f)
        if self.mode == "file":
            kv = {k.decode("utf-8", "replace"): v.decode("utf-8", "replace") for k, v in (meta.metadata or {}).items()}
            schema = json.dumps([{"name": c.path, "physical": c.physical_type, "logical": str(c.logical_type)} for c in (meta.schema.column(i) for i in range(meta.num_columns))])
            yield (path, meta.format_version, meta.num_rows, meta.created_by, meta.num_row_groups, meta.num_columns, length, schema, kv)
        elif self.mode == "column_chunk":
            raw = {id_: group for id_, group in enumerate(read_struct(footer(path)[1])[0].get(4, []))}
            for g in range(meta.num_row_groups):
                for c in range(meta.num_columns):
                    x, stats = meta.row_group(g).column(c), raw[g][1][c].get(3, {}).get(12, {})
                    low, high = (stats.get(new, stats.get(old)) for new, old in ((6, 2), (5, 1)))
                    s = x.statistics
                    yield (path, g, c, x.path_in_schema, x.physical_type, x.compression, ",".join(x.encodings), x.num_values, s.null_count if s and s.has_null_count else None, s.distinct_count if s and s.has_distinct_count else None, low.hex() if low is not None else None, high.hex() if high is not None else None, x.total_compressed_size, x.total_uncompressed_size, x.data_page_offset, x.dictionary_page_offset)
        elif self.mode == "page":
            yield from pages(path)
        else:
            stored = (meta.metadata or {}).get(b"ARROW:schema")
            for f in arrow_schema(stored.decode()) if stored else []:
                yield (path, f.name, str(f.type), f.nullable)


class ParquetMeta(DataSource):
    @classmethod
    def name(cls):
        return "parquet_meta"

    def schema(self):
        return SCHEMAS[self.options.get("mode", "file")]

    def reader(self, schema):
        return _Reader([p for p in self.options["paths"].split(",") if p], self.options.get("mode", "file"))


def parquet_meta(spark: SparkSession, paths: list[str], mode: str = "file") -> DataFrame:
    if mode not in SCHEMAS:
        raise ValueError(f"mode {mode}: one of {', '.join(SCHEMAS)}")
    spark.dataSource.register(ParquetMeta)
    return spark.read.format("parquet_meta").option("paths", ",".join(paths)).option("mode", mode).load()
