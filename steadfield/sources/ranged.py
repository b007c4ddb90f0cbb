"""Scanning headerless and NumPy files by ranges of bytes: a Python data source whose tasks read a range each.

The driver lists the files and reads the headers of NumPy files; it plans ranges of whole values of ``range_bytes`` or less.
A task reads its range in pieces, so a file of any size is read by as many tasks as it has ranges, each in bounded memory.
Conditions on ``field_id`` and ``i`` that are compared with constants leave out whole files and ranges at planning.

Options: path (a file, or a folder with all below it), pattern (of file names), form (raw or npy), dtype (of raw files; f4,
f8 with < or >), range_bytes. The value is a double where the values have 64 bits, else a float.

Defined results: files are fields, named by their paths; i counts a file's values in C order; an empty file is no row; a raw
file whose size is not a whole number of values, a NumPy file in Fortran order or cut short, or of another kind than
floats, raises at planning.
"""

from __future__ import annotations

import fnmatch
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from ..runtime import ship
from .writers import file_system

RANGE_BYTES, PIECE = 32 << 20, 1 << 18
FORMAT = "field_files"
_PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


@dataclass(frozen=True)
class File:
    uri: str
    size: int
    start: int  # of the first value
    dtype: str
    shape: tuple[int, ...]

    @property
    def count(self) -> int:
        return int(np.prod(self.shape, dtype=np.int64))


@dataclass(frozen=True)
class Range(InputPartition):
    uri: str
    start: int  # in bytes
    first: int  # the number of the first value
    count: int
    dtype: str


def list_files(path: str, pattern: str | None = None, form: str = "raw", dtype: str = "<f4") -> list[File]:
    """The files of a folder, or the one file, in order of their paths, with what their headers say."""
    from pyarrow import fs

    source, base = file_system(path if "://" in path else f"file://{path}")
    prefix = path[: -len(base)] if path.endswith(base) else ("file://" if "://" not in path else path.partition("://")[0] + "://")
    info = source.get_file_info(base)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else [f for f in source.get_file_info(fs.FileSelector(base, recursive=True)) if f.type == fs.FileType.File]
    out = []
    for f in sorted(found, key=lambda f: f.path):
        name = posixpath.basename(f.path)
        if name.startswith((".", "_")) or pattern and not fnmatch.fnmatch(name, pattern):
            continue
        start, kind, shape = 0, np.dtype(dtype), None
        if form == "npy":
            with source.open_input_file(f.path) as h:
                version = np.lib.format.read_magic(h)
                shape, fortran, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(h)
                start = h.tell()
            if fortran and len(shape) > 1:
                raise ValueError(f"{f.path} is in Fortran order")
        if kind.kind != "f" or kind.itemsize not in (4, 8):
            raise ValueError(f"{f.path}: values of type {kind} are not read")
        if shape is None:
            if f.size % kind.itemsize:
                raise ValueError(f"{f.path}: {f.size} bytes are not a whole number of {8 * kind.itemsize}-bit values")
            shape = (f.size // kind.itemsize,)
        one = File(f"{prefix or 'file://'}{f.path}", f.size, start, kind.str, tuple(map(int, shape)))
        if one.start + one.count * kind.itemsize > f.size:
            raise ValueError(f"{f.path} is cut short")
        out.append(one)
    return out


class FieldFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _files(self) -> list[File]:
        o = self.options
        return list_files(o["path"], o.get("pattern"), o.get("form", "raw"), o.get("dtype", "<f4"))

    def schema(self) -> str:
        kinds = {np.dtype(self.options.get("dtype", "<f4")).itemsize} if self.options.get("form", "raw") == "raw" else {np.dtype(f.dtype).itemsize for f in self._files()}
        return f"field_id string, i long, x {'double' if 8 in kinds else 'float'}"

    def reader(self, schema) -> FieldReader:
        wide = schema["x"].dataType.typeName() == "double"
        return FieldReader(self._files(), int(self.options.get("range_bytes", RANGE_BYTES)), wide)


class FieldReader(DataSourceReader):
    def __init__(self, files: list[File], range_bytes: int, wide: bool) -> None:
        self.files, self.range_bytes, self.wide = files, range_bytes, wide
        self.least, self.most, self.only = 0, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = getattr(f, "attribute", None)
            if name == ("i",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.least = max(self.least, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    end = f.value + 1 - isinstance(f, LessThan)
                    self.most = end if self.most is None else min(self.most, end)
            elif name == ("field_id",) and isinstance(f, EqualTo):
                self.only = f.value
            yield f  # Spark applies all of them to the rows

    def partitions(self) -> list[Range]:
        out = []
        for f in self.files:
            if self.only is not None and f.uri != self.only:
                continue
            size = np.dtype(f.dtype).itemsize
            step = max(1, self.range_bytes // size)
            end = f.count if self.most is None else min(f.count, self.most)
            for first in range(max(0, self.least) // step * step, end, step):
                n = min(step, end - first)
                out.append(Range(f.uri, f.start + first * size, first, n, f.dtype))
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition is None or not partition.count:
            return
        source, path = file_system(partition.uri)
        size, kind = np.dtype(partition.dtype).itemsize, pa.float64() if self.wide else pa.float32()
        with source.open_input_file(path) as h:
            for at in range(0, partition.count, PIECE):
                n = min(PIECE, partition.count - at)
                x = np.frombuffer(h.read_at(n * size, partition.start + at * size), partition.dtype)
                if len(x) != n:
                    raise OSError(f"{partition.uri} has become shorter")
                i = np.arange(partition.first + at, partition.first + at + n)
                name = pa.DictionaryArray.from_arrays(np.zeros(n, dtype=np.int32), [partition.uri]).cast(pa.string())
                yield pa.RecordBatch.from_arrays([name, pa.array(i), pa.array(x.astype(x.dtype.newbyteorder("=")).astype("f8" if self.wide else "f4"), kind)], names=["field_id", "i", "x"])


def scan(spark: SparkSession, path: str, form: str = "raw", dtype: str = "<f4", pattern: str | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(field_id, i, x) of the files at path."""
    ship(spark)
    spark.conf.set(_PUSHDOWN, "true")
    spark.dataSource.register(FieldFiles)
    reader = spark.read.format(FORMAT).option("form", form).option("dtype", dtype).option("range_bytes", str(range_bytes))
    return (reader.option("pattern", pattern) if pattern else reader).load(path)
