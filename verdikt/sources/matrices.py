"""Arrays of .npz archives and .npy files as rows, by ranges: a Python data source.

Planning reads the archive's directory and the array's header only, some hundred bytes. An array that is stored as it is, in
the order of rows, is read by ranges of about ``task_bytes``: each task seeks to its range and reads it in pieces. A
compressed member, or one in the order of columns, can't be read from the middle: it is one task, which decompresses in
pieces where it lies in the order of rows.

Numbers give ``row long, vector array<double>`` (a one-dimensional array has vectors of length one, further dimensions are
written one after the other); text gives ``row long, text string``. Arrays of Python objects are refused, as they would have
to be unpickled. An array without rows gives none; a missing array or file is an error. Paths may be a file or several,
each with the array; rows are numbered in each file, and ``file`` names it.
"""

from __future__ import annotations

import ast
import json
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TASK_BYTES, PIECE_BYTES = 32 << 20, 4 << 20


def _open(uri: str):
    system, path = pyarrow.fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def _header(f) -> tuple[np.dtype, tuple[int, ...], bool, int]:
    """Kind, shape, whether columns come first, and the header's length, of an array that starts at ``f``."""
    start = f.read(8)
    if start[:6] != b"\x93NUMPY":
        raise ValueError("not an array file")
    wide = 2 if start[6] == 1 else 4
    size = f.read(wide)
    length = int.from_bytes(size, "little")
    said = ast.literal_eval(f.read(length).decode("latin1" if start[6] < 3 else "utf8").strip())
    kind = np.dtype(said["descr"])
    if kind.hasobject or kind.kind not in "biufUS":
        raise ValueError(f"arrays of kind {kind} aren't read")
    return kind, tuple(said["shape"]), bool(said["fortran_order"]), 8 + wide + length


class Layout:
    """Where an array lies in its file."""

    def __init__(self, uri: str, array: str | None) -> None:
        self.uri, self.member, self.compressed, base = uri, None, False, 0
        with _open(uri) as f:
            if array is not None:
                with zipfile.ZipFile(f) as z:
                    names = {i.filename: i for i in z.infolist()}
                    info = names.get(f"{array}.npy") or names.get(array)
                    if info is None:
                        raise ValueError(f"{uri} has no array {array}, but {sorted(names)}")
                    self.member, self.compressed = info.filename, info.compress_type != zipfile.ZIP_STORED
                    if self.compressed:
                        with z.open(info) as inner:
                            self.kind, self.shape, self.columns_first, self.at = _header(inner)
                    else:
                        f.seek(info.header_offset + 26)
                        lengths = f.read(4)
                        base = info.header_offset + 30 + int.from_bytes(lengths[:2], "little") + int.from_bytes(lengths[2:], "little")
            if not self.compressed:
                f.seek(base)
                self.kind, self.shape, self.columns_first, size = _header(f)
                self.at = base + size
        self.rows = self.shape[0] if self.shape else 1
        self.width = int(np.prod(self.shape[1:], dtype=np.int64)) if self.shape else 1
        self.row_bytes = self.width * self.kind.itemsize
        self.whole = self.compressed or (self.columns_first and len(self.shape) > 1)

    def text(self) -> bool:
        if self.kind.kind in "US" and len(self.shape) != 1:
            raise ValueError("text is read from one-dimensional arrays")
        return self.kind.kind in "US"


class Range(InputPartition):
    def __init__(self, uri: str, array: str | None, start: int, stop: int) -> None:
        super().__init__(None)
        self.uri, self.array, self.start, self.stop = uri, array, start, stop


class MatrixReader(DataSourceReader):
    def __init__(self, uris: list[str], array: str | None, task_bytes: int) -> None:
        self.uris, self.array, self.task_bytes = uris, array, task_bytes

    def partitions(self) -> list[Range]:
        out = []
        for uri in self.uris:
            x = Layout(uri, self.array)
            step = x.rows if x.whole else max(1, self.task_bytes // max(x.row_bytes, 1))
            out += [Range(uri, self.array, at, min(at + step, x.rows)) for at in range(0, x.rows, max(step, 1))]
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part is None:  # no range at all
            return
        x = Layout(part.uri, part.array)
        name = part.uri.rsplit("/", 1)[-1]
        per = max(1, PIECE_BYTES // max(x.row_bytes, 1))
        with _open(part.uri) as f:
            if x.whole:
                with (zipfile.ZipFile(f).open(x.member) if x.compressed else f) as inner:
                    if x.compressed:
                        inner.read(x.at)
                    else:
                        inner.seek(x.at)
                    if x.columns_first and len(x.shape) > 1:
                        whole = np.frombuffer(inner.read(x.rows * x.row_bytes), x.kind).reshape(x.shape, order="F").reshape(x.rows, -1)
                        yield from (self._batch(x, name, at, whole[at : at + per]) for at in range(0, x.rows, per))
                    else:
                        for at in range(0, x.rows, per):
                            yield self._piece(x, name, at, inner.read(min(per, x.rows - at) * x.row_bytes))
            else:
                f.seek(x.at + part.start * x.row_bytes)
                for at in range(part.start, part.stop, per):
                    yield self._piece(x, name, at, f.read(min(per, part.stop - at) * x.row_bytes))

    def _piece(self, x: Layout, name: str, at: int, raw: bytes) -> pa.RecordBatch:
        n = len(raw) // x.row_bytes if x.row_bytes else min(max(1, PIECE_BYTES), x.rows)
        return self._batch(x, name, at, np.frombuffer(raw, x.kind).reshape(n, x.width))

    def _batch(self, x: Layout, name: str, at: int, values: np.ndarray) -> pa.RecordBatch:
        rows, names = pa.array(np.arange(at, at + len(values))), pa.array([name] * len(values))
        if x.text():
            said = [v.decode("latin1") if isinstance(v, bytes) else str(v) for v in values[:, 0]]
            return pa.RecordBatch.from_arrays([names, rows, pa.array(said, pa.string())], ["file", "row", "text"])
        flat = pa.array(np.ascontiguousarray(values, np.float64).ravel())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * x.width), flat)
        return pa.RecordBatch.from_arrays([names, rows, lists], ["file", "row", "vector"])


class MatrixSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "matrix"

    def _uris(self) -> list[str]:
        return json.loads(self.options["uris"])

    def schema(self) -> str:
        text = Layout(self._uris()[0], self.options.get("array")).text()
        return "file string, row long, " + ("text string" if text else "vector array<double>")

    def reader(self, schema) -> MatrixReader:
        return MatrixReader(self._uris(), self.options.get("array"), int(self.options.get("task_bytes", TASK_BYTES)))


def read_matrix(spark: SparkSession, path: str | list[str], array: str | None = None, task_bytes: int = TASK_BYTES) -> DataFrame:
    """file, row and vector (or text) of the named array of an .npz archive, or of an .npy file without a name."""
    spark.dataSource.register(MatrixSource)
    uris = []
    for p in [path] if isinstance(path, str) else path:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(p)
        uris.append(hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toUri().toString())
    options = {"uris": json.dumps(uris), "task_bytes": str(task_bytes)} | ({"array": array} if array else {})
    return spark.read.format("matrix").options(**options).load()
