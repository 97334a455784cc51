"""Where streams come from: trace files, tables, fixed streams, synthetic words; and where results go.

Readers take any path that Spark reads. Sampling is by seeded hash order, so it is the same for any partitioning."""

from __future__ import annotations

import io
import json
from pathlib import PurePosixPath

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Names of trace files, the more telling first; the last one takes any array but those of other uses.
PATTERNS = ("*.flowid.npy", "*flowid*.npy", "univ2_pt*.npy", "*.npy")


def as_text(c: Column, kind: str = "string") -> Column:
    """Items as strings; binary is UTF-8."""
    return F.decode(c, "UTF-8") if kind == "binary" else c.cast("string")


def discover(spark: SparkSession, root: str, subdir: str | None = "univ2_npy") -> list[str]:
    """Paths of the trace files under root and its sub-folder, sorted, without repeats; Spark lists the folder."""
    found: set[str] = set()
    for folder in [root] + ([f"{root.rstrip('/')}/{subdir}"] if subdir else []):
        for pattern in PATTERNS:
            try:
                files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path").collect()
            except Exception as why:
                if "PATH_NOT_FOUND" in str(why):
                    break
                raise
            paths = [r.path for r in files if pattern != "*.npy" or "omega" not in PurePosixPath(r.path).name]
            found |= set(paths)
            if paths:
                break
    return sorted(found)


def read_npy(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, position, e) of 1-D arrays of numbers, bytes or strings; object arrays are refused (they run code)."""

    def run(batches):
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                a = np.load(io.BytesIO(data), allow_pickle=False).ravel()
                text = [x.decode("utf-8", "ignore") for x in a.tolist()] if a.dtype.kind == "S" else [str(x) for x in a.tolist()]
                for i in range(0, len(text), 50_000):
                    part = text[i : i + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(part)), pa.array(range(i, i + len(part)), pa.int64()), pa.array(part, pa.string())], ["file", "position", "e"])

    if not paths:
        return spark.createDataFrame([], "file string, position long, e string")
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInArrow(run, "file string, position long, e string")


def take_per_file(rows: DataFrame, target: int, files: int, shuffle: bool = False, seed: int = 0, window: int | None = None) -> DataFrame:
    """target items of (file, position, e), as even a share of each of the first `files` files as there is.

    shuffle: from each file a seeded sample of its first max(20000 * share, 50000) items, else its first ones."""
    share = max(1, -(-target // max(1, files)))
    order = F.xxhash64("file", F.lit(seed))
    chosen = rows.select("file").distinct().orderBy(order, "file").limit(files)
    own = rows.join(F.broadcast(chosen), "file")
    reach = window or max(share * 20_000, 50_000)
    if shuffle:
        own = own.filter(F.col("position") < reach)
    place = [F.xxhash64("file", "position", F.lit(seed)), F.col("position")] if shuffle else [F.col("position")]
    nth = own.withColumn("nth", F.row_number().over(W.partitionBy("file").orderBy(*place)))
    # the first share of each file, then what files have beyond it until the target is met
    ranked = nth.filter(F.col("nth") <= target).withColumn("over", (F.col("nth") > share).cast("int"))
    out = ranked.orderBy("over", "nth", order, "file").limit(target)
    return out.select(F.struct("over", "nth", "file").alias("seq"), "e")


def enough_distinct(target: int) -> int:
    return min(target, max(1500, target // 3))


def load_sample(rows: DataFrame, target: int, files: int, shuffle: bool, seed: int, retries: int = 5) -> DataFrame:
    """As take_per_file, with the seed among a few that gives the most distinct items; enough of them end the search."""
    best = None
    for k in range(max(1, retries)):
        sample = take_per_file(rows, target, files, shuffle, seed + k).cache()
        u = sample.select(F.count_distinct("e")).first()[0]
        if best is None or u > best[0]:
            best = (u, sample)
        if u >= enough_distinct(target) or not shuffle:
            break
    return best[1]


def synthetic_words(spark: SparkSession, n: int = 10_000, seed: int = 0) -> DataFrame:
    """(seq, e): words with a few frequent ones at fixed steps and four random shapes between them."""
    fruits, animals, colours = (F.array(*map(F.lit, x.split())) for x in ("apple banana orange grape melon kiwi peach plum", "cat dog bird fish horse mouse tiger wolf", "red blue green black white amber violet teal"))
    draw = lambda k, m: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(m))
    pick = lambda a, k: F.element_at(a, (draw(k, 8) + 1).cast("int"))
    shape = draw(0, 4)
    other = F.when(shape == 0, pick(fruits, 1)).when(shape == 1, F.concat_ws("_", pick(colours, 2), pick(animals, 3))).when(shape == 2, F.concat(pick(animals, 4), draw(5, 100).cast("string"))).otherwise(F.concat_ws("-", pick(fruits, 6), draw(7, 1000).cast("string")))
    i = F.col("id")
    e = F.when(i % 5 == 0, "apple").when(i % 7 == 0, "banana").when(i % 9 == 0, "orange").when(i % 11 == 0, "grape").otherwise(other)
    return spark.range(n).select(i.alias("seq"), e.alias("e"))


# ---- proxies -------------------------------------------------------------------------------------------------------

#: Fixed values of the evaluated system's proxies, as are the bounds in proxy_base and the sizes in staged_proxies.
PROXIES = {
    # share of distinct items wanted, least and most of it, the share of these that is hot, and at least so many
    "proxy_balanced": (0.50, 0.30, 0.55, 0.20, 32),
    "proxy_head": (0.22, 0.12, 0.28, 0.10, 16),
    "proxy_collision": (None, None, None, 0.18, 32),
}


def proxy_base(mode: str, target: int, distinct: int) -> tuple[int, int]:
    """Distinct items of a proxy stream, and how many of them are repeated."""
    share, low, high, hot, least = PROXIES[mode]
    if share is None:
        u = min(distinct, max(max(64, int(target * 0.35)), min(int(target * 0.50), 1200)))
    else:
        lo = max(32, int(target * low))
        u = min(distinct, max(lo, min(int(target * share), max(lo, int(target * high)))))
    return u, min(u, max(least, int(u * hot)))


def collision_order() -> list[Column]:
    """Items that look alike stand together: by length, first and last characters."""
    return [F.length("e"), F.substring("e", 1, 4), F.when(F.length("e") >= 4, F.expr("right(e, 4)")).otherwise(F.col("e")), F.col("e")]


def proxy_stream(pool: DataFrame, mode: str, target: int, seed: int = 0) -> DataFrame:
    """(seq, e) of target items with a given skew: every base item once, the rest repeats of hot ones, in seeded order."""
    if mode not in PROXIES:
        # rows of one item are numbered, so that the order depends on what the pool holds, not on its partitions
        each = pool.groupBy("e").agg(F.count(F.lit(1)).alias("n")).select("e", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("k"))
        return each.select(F.struct(F.xxhash64("e", "k", F.lit(seed)).alias("h"), "e", "k").alias("seq"), "e").orderBy("seq").limit(target)
    distinct = pool.select("e").distinct()
    u, hot = proxy_base(mode, target, distinct.count())
    order = collision_order() if mode == "proxy_collision" else [F.xxhash64("e", F.lit(seed)), F.col("e")]
    base = distinct.orderBy(*order).limit(u)
    base = base.withColumn("r", F.row_number().over(W.orderBy(*order)) - 1).cache()
    extra = pool.sparkSession.range(max(0, target - u))
    v = F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    # descending weights hot, hot - 1, ..., 1: the rank whose share of the triangle the draw falls in
    rank = F.floor(F.lit(hot) - (F.sqrt(1 + 4 * F.lit(float(hot) * (hot + 1)) * (1 - v)) - 1) / 2) if mode == "proxy_head" else F.floor(v * hot)
    extra = extra.select("id", F.least(F.greatest(rank, F.lit(0)), F.lit(hot - 1)).cast("int").alias("r"))
    repeats = extra.join(F.broadcast(base.filter(F.col("r") < hot)), "r").select(F.col("id"), "e")
    both = base.select((-F.col("r") - 1).cast("long").alias("id"), "e").unionByName(repeats)
    return both.select(F.struct(F.xxhash64("id", F.lit(seed + 2)).alias("h"), "id").alias("seq"), "e").orderBy("seq").limit(target)


def staged_proxies(pool: DataFrame, target: int, seed: int = 0) -> DataFrame:
    """(stage, seq, e): a head, a balanced and a collision stream of a quarter, a third and the rest."""
    n0, n1 = max(int(target * 0.25), 1200), max(int(target * 0.35), 1500)
    parts = [("proxy_head", n0), ("proxy_balanced", n1), ("proxy_collision", max(0, target - n0 - n1))]
    out = None
    for s, (mode, n) in enumerate(parts):
        own = proxy_stream(pool, mode, n, seed + 50_001 + s).select(F.lit(s).alias("stage"), "seq", "e")
        out = own if out is None else out.unionByName(own)
    return out


# ---- fixed streams and sinks ---------------------------------------------------------------------------------------


def fixed_path(root: str, mode: str, pkts: int, files: int, start: int, shuffle: bool, seed: int, proxy: str | None = None) -> str:
    name = f"{mode}_p{pkts}_f{files}_s{start}_{'sh' if shuffle else 'seq'}_seed{seed}" + (f"_{proxy}" if proxy else "")
    return f"{root.rstrip('/')}/{name}.parquet"


def fixed_stream(spark: SparkSession, path: str, make) -> DataFrame:
    """The stream stored at path; made and stored first if it is not there."""
    try:
        return spark.read.parquet(path)
    except Exception as why:
        if "PATH_NOT_FOUND" not in str(why):
            raise
    make().write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


def log_events(df: DataFrame, path: str) -> None:
    """Append rows as JSON lines with the time they are written."""
    df.withColumn("ts", F.current_timestamp()).write.mode("append").json(path)


def write_results(df: DataFrame, path: str, manifest: dict | None = None) -> None:
    df.write.mode("append").parquet(f"{path}/results")
    if manifest is not None:
        rows = [(json.dumps(manifest, sort_keys=True, default=str),)]
        df.sparkSession.createDataFrame(rows, "value string").coalesce(1).write.mode("append").text(f"{path}/manifest")


def candidate_pool(rows: DataFrame, target: int, files: int, seed: int = 0) -> DataFrame:
    """A wider seeded sample, from which proxies are made."""
    share = max(1, -(-target // max(1, files)))
    return take_per_file(rows, target, files, True, seed, window=max(share * 20_000, 80_000))


def load_proxy(rows: DataFrame, mode: str, target: int, files: int, seed: int = 0, factor: int = 8, least_distinct: int = 0, retries: int = 5) -> DataFrame:
    """A proxy stream from a pool of rows; of a few seeds the one with the most distinct items, ending when enough."""
    best = None
    for k in range(max(1, retries)):
        pool = candidate_pool(rows, max(target * factor, 40_000), files, seed + k)
        stream = proxy_stream(pool, mode, target, seed + k).cache()
        u = stream.select(F.count_distinct("e")).first()[0]
        if best is None or u > best[0]:
            best = (u, stream)
        if u >= min(least_distinct, target):
            break
    return best[1]
