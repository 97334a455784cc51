"""Helpers shared by the corpus operators: shared storage, packed arrays, bucketed exchanges, components."""

from __future__ import annotations

import atexit
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words, as a Java or Python character class.
SEPARATORS = r"\x20\x09-\x0D"
#: How a null integer id is held inside packed arrays.
NULL_ID = np.iinfo(np.int64).min


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; one of our own only where none is set."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or os.environ.get("SKETCHLOOM_SHARED_DIR")
    if not conf:
        conf = os.environ["SKETCHLOOM_SHARED_DIR"] = "file://" + tempfile.mkdtemp(prefix="sketchloom-")
    return conf.rstrip("/")


_made: list[str] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. Results may be read from it as long as this process lives; then it is removed."""
    if not _made:
        atexit.register(remove_made)
    _made.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def remove_made() -> None:
    while _made:
        try:
            fs, path = open_fs(_made.pop())
            fs.delete_dir(path)
        except (OSError, pa.ArrowException):
            continue  # not written, or gone already


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write Parquet to the shared folder and read it again."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """As materialize, as a table bucketed by key, so that joins on key need not move its rows again."""
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).option("path", fresh_path(spark, name)).saveAsTable(table)
    return spark.table(table)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def columns_or_null(df: DataFrame, **kinds: str) -> DataFrame:
    """The named columns cast to the given types; further columns, whatever their names, are left out."""
    return df.select(*(F.col(f"`{c}`").cast(t).alias(c) for c, t in kinds.items()))


# ---- packed arrays -------------------------------------------------------------------------------------------------


def squeeze(data: bytes | memoryview, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data)


def expand(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack(values: np.ndarray, delta: bool = False) -> bytes:
    """A 1-D array of integers as compressed byte planes; delta: it is sorted."""
    v = np.ascontiguousarray(values)
    if delta and len(v):
        v = np.diff(v, prepend=v.dtype.type(0))
    planes = np.ascontiguousarray(v.view(np.uint8).reshape(len(v), v.itemsize).T) if len(v) else np.empty(0, np.uint8)
    return squeeze(planes.tobytes())


def unpack(data: bytes, dtype: type, delta: bool = False) -> np.ndarray:
    dt = np.dtype(dtype)
    raw = np.frombuffer(expand(data), np.uint8)
    n = len(raw) // dt.itemsize
    v = np.ascontiguousarray(raw.reshape(dt.itemsize, n).T).view(dt).reshape(n) if n else np.empty(0, dt)
    return np.cumsum(v, dtype=dt) if delta else v


def bucket_cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Cuts of sorted 64-bit keys into buckets of equal key range: buckets + 1 offsets."""
    top = (keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    return np.searchsorted(top, np.arange(buckets + 1, dtype=np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (the finalizer of a published mixing function)."""
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def trim() -> None:
    """Give freed memory back to the system, so that a worker's size follows what it holds."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


# ---- batches -------------------------------------------------------------------------------------------------------


def batch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        cols = [c for c in b.columns]
        names = b.schema.names
        for i in range(b.num_rows):
            yield {n: c[i].as_py() for n, c in zip(names, cols)}


def emit(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def text_groups(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Rows (doc_id, text as binary) gathered to about `most` bytes: ids (null: NULL_ID) and texts (null: empty)."""
    ids, texts, size = [], [], 0
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                ids.append(NULL_ID if i is None else i)
                texts.append(t or b"")
                size += len(texts[-1]) + 16
                if size >= most:
                    yield np.array(ids, np.int64), texts
                    ids, texts, size = [], [], 0
    if ids:
        yield np.array(ids, np.int64), texts


def bucketed(df: DataFrame, key: str, reduce: Callable, schema: str) -> DataFrame:
    """Send rows to tasks by key and call reduce(key, rows) with all rows of one key at a time; it yields batches.

    Rows arrive sorted by key, so a task holds one key's rows at a time whatever number of keys it gets."""

    def run(batches):
        now, held = None, []
        for row in batch_rows(batches):
            if held and row[key] != now:
                yield from reduce(now, held)
                held = []
                trim()
            now = row[key]
            held.append(row)
        if held:
            yield from reduce(now, held)

    n = shuffle_partitions(df.sparkSession)
    # buckets are numbers below n: each is a partition of its own
    dealt = df.repartitionById(n, F.col(key).cast("int")) if key == "bucket" else df.repartition(n, key)
    return dealt.sortWithinPartitions(key).mapInArrow(run, schema)


# ---- components ----------------------------------------------------------------------------------------------------


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node of each node's component among 0..n-1, for edges a-b (pointer jumping on minima)."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        keep = la != lb
        if not keep.any():
            break
        a, b, la, lb = a[keep], b[keep], la[keep], lb[keep]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (label[label] != label).any():
            label = label[label]
    return label


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for the nodes of edges (u, v), root the smallest node of the component.

    Alternating large-star and small-star steps over tables in the shared folder; no step gathers a component."""

    def tidy(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct()

    def state(pairs: DataFrame) -> tuple:
        r = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return tuple(r)

    now = materialize(tidy(edges), name)
    was = state(now)
    while was[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = tidy(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select("v", "m").union(low.select("u", "m")).toDF("u", "v")
        now = materialize(tidy(small), name)
        again = state(now)
        if again == was:
            break
        was = again
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
