"""What the training-data operators share: lineage cuts in the shared folder, Arrow text access and word hashing."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that the numpy operators take at a time; it bounds a Python worker's memory.
BLOCK_BYTES = 1 << 19
#: Bytes of an Arrow batch.
BATCH_BYTES = 8 << 20
U = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, one of our own, in local mode
    only: executors of a cluster don't see the driver's folders."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="verdikt-shared-")
        sc.setCheckpointDir(path)
        path = sc.getCheckpointDir()
    return path.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session, which a Python worker holds whole: rows may have long texts."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(key, None)
    if held is None or not held.rstrip("b").isdigit() or int(held.rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, so that losing an executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._cut_path = path
    return out


def drop_folder(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def drop_cut(df: DataFrame) -> None:
    """Delete what ``cut`` wrote for ``df``; only for tables that no later plan reads."""
    path = getattr(df, "_cut_path", None)
    if path:
        drop_folder(df.sparkSession, path)


def free(taken: list[str], name: str) -> str:
    """The name, with underscores where another column has it."""
    while name.lower() in {x.lower() for x in taken}:
        name += "_"
    return name


def ascii_lower(col):
    """Lower-case A-Z only, as the word definitions of the contracts ask."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_mod(column: str, n: int):
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n+1 offsets; nulls are empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(offsets) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def give_back() -> None:
    """Return freed memory to the system: a Python worker lives on after its tasks, beside those of other operators."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", size: int | None = None) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``size`` bytes of text, one row at least. What was used is given back in the end."""
    size = BLOCK_BYTES if size is None else size
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False), np.int64)
        total, at = np.concatenate([[0], np.cumsum(lengths)]), 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(total, total[at] + size, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end
    give_back()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


_BASE = 0x9E3779B97F4A7C15 | 1
_powers = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base modulo 2^64 and of its inverse, up to n."""
    if len(_powers[0]) < n:
        n = max(n, 2 * len(_powers[0]))
        for k, base in ((0, _BASE), (1, pow(_BASE, -1, 1 << 64))):
            x = np.full(n, U(base))
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0][:n], _powers[1][:n]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the maximal runs of ``mask`` that don't cross a row's border."""
    if not len(mask):
        return (np.zeros(0, np.int64),) * 3
    first = np.zeros(len(mask) + 1, bool)
    first[offsets[:-1]] = True
    begins = mask.copy()
    begins[1:] &= ~mask[:-1] | first[1:-1]
    ends = mask.copy()
    ends[:-1] &= ~mask[1:] | first[1:-1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return starts, stops, np.searchsorted(offsets, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans from prefix sums of base powers, so that the cost is one pass over the bytes."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=sums[1:])
    h = (sums[stops] - sums[starts]) * down[starts]
    return mix(h + (stops - starts).astype(U) * U(0xA0761D6478BD642F))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word ``[^\\x20\\x09-\\x0D]+`` after A-Z are lower-cased."""
    starts, stops, rows = runs(~_SPACE[data], offsets)
    return span_hashes(_LOWER[data], starts, stops), rows


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """The sorted distinct k-word shingle hashes of each row; a row of fewer words has its whole sequence as one."""
    h, rows = word_hashes(data, offsets)
    n = len(offsets) - 1
    counts = np.bincount(rows, minlength=n)
    first = np.concatenate([[0], np.cumsum(counts)])
    full = np.zeros(max(0, len(h) - k + 1), U)
    for j in range(k):
        full += mix(h[j : j + len(full)] + U(j + 1)) * U(2 * j + 0x1D8E4E27C47D124F)
    full = mix(full)
    none, out = np.zeros(0, U), []
    for i in range(n):
        a, m = first[i], counts[i]
        if m >= k:
            out.append(np.unique(full[a : a + m - k + 1]))
        elif m:
            s = U(m)
            with np.errstate(over="ignore"):
                for j in range(m):
                    s = mix(np.atleast_1d(s * U(0x2545F4914F6CDD1D) + h[a + j]))[0]
            out.append(np.array([s], U))
        else:
            out.append(none)
    return out


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key from batches that are sorted by the keys; a group must be of bounded size."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]
        marks = list(zip(*cols, strict=True))
        at = 0
        for i in range(batch.num_rows):
            if marks[i] != last:
                if i > at:
                    held.append(batch.slice(at, i - at))
                if held:
                    yield pa.Table.from_batches(held)
                held, at, last = [], i, marks[i]
        held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)
