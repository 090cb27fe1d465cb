"""Raw column files as a data source: fixed-length records of three files, read by byte ranges of all three together.

`<prefix>.meta.json` has `num_samples` and `top_k`; `<prefix>.ids_sorted.dat` (int32) and
`<prefix>.delta_k_sorted.dat` (float32) have T * K cells a sample, `<prefix>.lengths.dat` (uint32)
one. T follows from the files' sizes. What this source writes itself are parts of such files,
`<prefix>.part-<name>.*`, listed in the meta file in order of sample_id; they read as one.

A partition is a range of samples, and each of its files is read from that range's place on. Only
files of the columns in the schema are opened, and only the samples that the options `first` and
`last` enclose are read. Filters are not taken from Spark: in 4.1 all scans made from one
DataFrame share the reader that filters were pushed to last, so that one of them would read what
another asked for (a self-join of two ranges lost rows in a test). A range given to `read` is its
own.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from calibrant.errors import DataError
from calibrant.session import ship

SCHEMA = "sample_id bigint, ids array<int>, delta array<float>, response_len bigint"
#: Column to file and kind of its cells.
_FILES = {"ids": ("ids_sorted", "<i4"), "delta": ("delta_k_sorted", "<f4"), "response_len": ("lengths", "<u4")}


def _at(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _load(path: str) -> dict:
    fs, at = _at(f"{path}.meta.json")
    try:
        with fs.open_input_stream(at) as f:
            return json.loads(f.read())
    except FileNotFoundError as e:
        raise DataError(f"{path}.meta.json is not there") from e


@dataclass
class Part:
    """Samples first to first + rows - 1 of all files under a prefix."""

    prefix: str
    first: int
    rows: int


def parts_of(path: str, meta: dict) -> list[Part]:
    if "parts" not in meta:
        return [Part(path, 0, int(meta["num_samples"]))]
    folder = path.rpartition("/")[0]
    return [Part(posixpath.join(folder, p["name"]), int(p["first"]), int(p["rows"])) for p in meta["parts"]]


def cells_of(path: str, meta: dict) -> int:
    """T * K, from the size of the ids."""
    if "cells" in meta:
        return int(meta["cells"])
    n = int(meta["num_samples"])
    fs, at = _at(f"{path}.ids_sorted.dat")
    size = fs.get_file_info(at).size or 0
    if n and size % (4 * n * int(meta["top_k"])):
        raise DataError(f"{path}: {size} bytes of ids are no whole number of positions for {n} samples")
    return size // (4 * n) if n else 0


@dataclass
class Range(InputPartition):
    prefix: str
    first: int  # sample_id
    skip: int  # samples before it in its files
    rows: int


class Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, options: dict) -> None:
        meta = _load(path)
        self.parts, self.cells = parts_of(path, meta), cells_of(path, meta)
        self.columns = schema.names
        n = sum(p.rows for p in self.parts)
        self.low, self.high = max(0, int(options.get("first", 0))), min(n, int(options.get("last", n - 1)) + 1)
        width = 4 * sum((self.cells if c != "response_len" else 1) for c in self.columns if c != "sample_id")
        self.rows = max(1, int(options.get("bytesperpartition", 32 << 20)) // max(8, width))
        self.batch = max(1, (1 << 22) // max(8, width))

    def partitions(self) -> list[Range]:
        out = []
        for p in self.parts:
            low, high = max(p.first, self.low), min(p.first + p.rows, self.high)
            out += [Range(p.prefix, at, at - p.first, min(self.rows, high - at)) for at in range(low, high, self.rows)]
        return out or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        files = {}
        for c in self.columns:
            if c != "sample_id" and partition.rows:
                fs, at = _at(f"{partition.prefix}.{_FILES[c][0]}.dat")
                files[c] = fs.open_input_file(at)
        try:
            for low in range(0, partition.rows, self.batch):
                n = min(self.batch, partition.rows - low)
                arrays = []
                for c in self.columns:
                    if c == "sample_id":
                        arrays.append(pa.array(np.arange(partition.first + low, partition.first + low + n)))
                        continue
                    cells = 1 if c == "response_len" else self.cells
                    raw = files[c].read_at(4 * cells * n, 4 * cells * (partition.skip + low))
                    values = np.frombuffer(raw, _FILES[c][1])
                    if len(values) != cells * n:
                        raise DataError(f"{partition.prefix}.{_FILES[c][0]}.dat ends before sample {partition.first + low + n}")
                    arrays.append(pa.array(values.astype(np.int64)) if cells == 1 and c == "response_len" else pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * cells), pa.array(values)))
                yield pa.RecordBatch.from_arrays(arrays, names=self.columns)
        finally:
            for f in files.values():
                f.close()


@dataclass
class Written(WriterCommitMessage):
    name: str
    first: int
    rows: int
    cells: int


class Writer(DataSourceArrowWriter):
    """Each task writes the files of one part; the commit lists them in the meta file."""

    def __init__(self, path: str, options: dict, overwrite: bool) -> None:
        self.path, self.top_k, self.overwrite = path, int(options.get("topk", 1)), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        folder, _, base = self.path.rpartition("/")
        name = f"{base}.part-{uuid.uuid4().hex}"
        fs, at = _at(posixpath.join(folder, name))
        fs.create_dir(at.rpartition("/")[0], recursive=True)
        first = rows = 0
        cells = -1
        files: dict = {}
        try:
            for b in iterator:
                if not b.num_rows:
                    continue
                ids = b.column("sample_id").to_numpy()
                if not rows:
                    first = int(ids[0])
                    files = {c: fs.open_output_stream(f"{at}.{f}.dat") for c, (f, _) in _FILES.items()}
                if (ids != first + rows + np.arange(len(ids))).any():
                    raise DataError("sample_id must rise by one from row to row of a partition")
                for c, (_, kind) in _FILES.items():
                    col = b.column(c)
                    if c != "response_len":
                        sizes = np.unique(col.value_lengths().to_numpy(zero_copy_only=False))
                        cells = int(sizes[0]) if cells < 0 else cells
                        if len(sizes) != 1 or sizes[0] != cells:
                            raise DataError(f"{c} must have as many cells in every sample")
                        col = col.flatten()
                    files[c].write(col.to_numpy(zero_copy_only=False).astype(kind).tobytes())
                rows += b.num_rows
        finally:
            for f in files.values():
                f.close()
        return Written(name, first, rows, cells)

    def commit(self, messages: list[Written | None]) -> None:
        done = sorted((m for m in messages if m and m.rows), key=lambda m: m.first)
        at = 0
        for m in done:
            if m.first != at or m.cells != done[0].cells:
                raise DataError(f"samples from {at} on are missing, or have another number of cells")
            at += m.rows
        cells = done[0].cells if done else 0
        if cells % self.top_k:
            raise DataError(f"{cells} cells are no whole number of positions of {self.top_k}")
        fs, path = _at(f"{self.path}.meta.json")
        if not self.overwrite and fs.get_file_info(path).type != pafs.FileType.NotFound:
            raise DataError(f"{self.path} is there already")
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(path) as f:
            f.write(json.dumps({"num_samples": at, "top_k": self.top_k, "cells": cells, "parts": [{"name": m.name, "first": m.first, "rows": m.rows} for m in done]}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        folder = self.path.rpartition("/")[0]
        for m in messages:
            for name, _ in _FILES.values() if m and m.rows else ():
                fs, at = _at(posixpath.join(folder, f"{m.name}.{name}.dat"))
                if fs.get_file_info(at).type != pafs.FileType.NotFound:
                    fs.delete_file(at)


class ColumnFiles(DataSource):
    """SRC-09: format `column_files`, path = the prefix."""

    @classmethod
    def name(cls) -> str:
        return "column_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to the session."""
    ship(spark)
    spark.dataSource.register(ColumnFiles)


def read(spark: SparkSession, prefix: str, columns: list[str] | None = None, first: int | None = None, last: int | None = None, **options) -> DataFrame:
    """Samples of column files, from `first` to `last` where these are given; of `columns`, if given, only these files are opened."""
    register(spark)
    kinds = dict(c.split() for c in SCHEMA.split(", "))
    given = {k: str(v) for k, v in (("first", first), ("last", last)) if v is not None}
    return spark.read.format("column_files").schema(", ".join(f"{c} {kinds[c]}" for c in columns or kinds)).options(**given, **options).load(prefix)


def write(rows: DataFrame, prefix: str, top_k: int, partitions: int | None = None) -> None:
    """Write rows(sample_id, ids, delta, response_len), sample_id from 0 without gaps, as parts that lie in order."""
    spark = rows.sparkSession
    register(spark)
    kinds = [c.split() for c in SCHEMA.split(", ")]
    rows = rows.selectExpr(*(f"cast({c} as {kind}) as {c}" for c, kind in kinds))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(n, "sample_id").sortWithinPartitions("sample_id").write.format("column_files").mode("overwrite").option("topK", str(top_k)).save(prefix)
