"""Ground truth, reports and errors of sketches, as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import hash_mod

#: Keys that are reported with frequency 0 where compat is asked for.
ZERO_KEYS = ("dragonfruit", "starfruit", "passionfruit")
FAILED = 2e9


def exact_frequency(stream: DataFrame, compat: bool = False) -> DataFrame:
    """(e, cnt). compat: the zero keys are there with count 0, whatever the stream has of them."""
    found = stream.groupBy("e").agg(F.count(F.lit(1)).alias("cnt"))
    if compat:
        zero = stream.sparkSession.createDataFrame([(k, 0) for k in ZERO_KEYS], "e string, cnt long")
        found = found.filter(~F.col("e").isin(*ZERO_KEYS)).unionByName(zero)
    return found


def first_seen(stream: DataFrame) -> DataFrame:
    """(e, cnt, first_seq): the order of first appearance breaks ties."""
    return stream.groupBy("e").agg(F.count(F.lit(1)).alias("cnt"), F.min("seq").alias("first_seq"))


def top_k(freq: DataFrame, k: int, *ties: str) -> DataFrame:
    return freq.orderBy(F.col("cnt").desc(), *(ties or ("e",))).limit(k)


def distinct_ratio(stream: DataFrame, approximate: bool = False) -> DataFrame:
    """Items, distinct items and their ratio."""
    u = F.approx_count_distinct("e") if approximate else F.count_distinct("e")
    return stream.agg(F.count(F.lit(1)).alias("n"), u.alias("u")).withColumn("u_ratio", F.col("u") / F.greatest(F.col("n"), F.lit(1)))


def error_report(freq: DataFrame, estimated: DataFrame) -> DataFrame:
    """(e, actual, est, abs_err) of the estimated keys; a key that is not in freq has actual 0."""
    joined = estimated.select("e", "est").join(freq.select("e", F.col("cnt").alias("actual")), "e", "left")
    return joined.select("e", F.coalesce("actual", F.lit(0).cast("long")).alias("actual"), "est").withColumn("abs_err", F.abs(F.col("est") - F.col("actual")))


def error_summary(report: DataFrame) -> DataFrame:
    """n, sae (sum of absolute errors) and aae (their mean)."""
    s = report.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("abs_err"), F.lit(0.0)).alias("sae"))
    return s.withColumn("aae", F.col("sae") / F.greatest(F.col("n"), F.lit(1)))


def fitness(err: Column, e0: float) -> Column:
    """1 / (1 + err / e0): 1 for no error, 0 for none that is finite."""
    finite = err.isNotNull() & ~F.isnan(err) & (F.abs(err) != F.lit(float("inf")))
    return F.when(finite, 1 / (1 + F.greatest(err, F.lit(0.0)) / F.lit(e0 or 1.0))).otherwise(0.0)


def typical_error(results: DataFrame, col: str = "err") -> DataFrame:
    """Median of the finite errors below failure, at least 1."""
    own = results.filter((F.col(col) < FAILED) & ~F.isnan(col))
    return own.agg(F.greatest(F.coalesce(F.median(col), F.lit(1.0)), F.lit(1.0)).alias("e0"))


def error_bucket(v: Column) -> Column:
    """Estimates coarsened for fingerprints: exact to 255, then in steps of 8 and 128, then capped."""
    v = F.greatest(v.cast("long"), F.lit(0).cast("long"))
    step = lambda k: F.floor(v / k).cast("long") * k
    return F.when(v <= 255, v).when(v <= 4095, step(8)).when(v <= 65535, step(128)).otherwise(F.lit(65535).cast("long"))


def absent_keys(freq: DataFrame, tag: str, k: int, *order: str) -> DataFrame:
    """k keys made of known ones that the stream lacks: (i, e) with e = base__tag__i, i running over the bases in turn.

    A made key that exists is passed over, as are the numbers it would have had."""
    bases = freq.orderBy(*(order or ("e",))).limit(max(16, 4 * k))
    n = bases.select(F.count(F.lit(1)).alias("n"))
    ranked = bases.select("e", (F.row_number().over(W.orderBy(*(order or ("e",)))) - 1).alias("r"))
    numbers = freq.sparkSession.range(4 * k + 16).select(F.col("id").alias("i"))
    made = numbers.join(F.broadcast(n), F.lit(True)).withColumn("r", F.col("i") % F.col("n")).join(F.broadcast(ranked), "r")
    made = made.select("i", F.concat("e", F.lit(f"__{tag}__"), F.col("i").cast("string")).alias("e"))
    return made.join(freq.select("e"), "e", "left_anti").orderBy("i").limit(k).select("i", "e")


def baseline_cells(stream: DataFrame, cols: int = 10_240) -> DataFrame:
    """Counters (lane, y, cnt) of a plain count-min sketch of three rows."""
    keys = exact_frequency(stream)
    lanes = F.array(*(F.struct(F.lit(i).alias("lane"), hash_mod(i, F.col("e"), cols).alias("y")) for i in range(3)))
    return keys.select("cnt", F.explode(lanes).alias("a")).groupBy("a.lane", "a.y").agg(F.sum("cnt").alias("cnt"))


def baseline_report(stream: DataFrame, cols: int = 10_240) -> DataFrame:
    """(e, actual, est, abs_err) of all keys under a plain count-min sketch; its counters are bounded by 3 * cols."""
    cells = F.broadcast(baseline_cells(stream, cols).withColumnRenamed("cnt", "c"))
    lanes = F.array(*(F.struct(F.lit(i).alias("lane"), hash_mod(i, F.col("e"), cols).alias("y")) for i in range(3)))
    probes = exact_frequency(stream).select("e", "cnt", F.explode(lanes).alias("a")).select("e", "cnt", "a.lane", "a.y")
    est = probes.join(cells, ["lane", "y"], "left").groupBy("e", "cnt").agg(F.min("c").cast("double").alias("est"))
    return est.select("e", F.col("cnt").alias("actual"), "est", F.abs(F.col("est") - F.col("cnt")).alias("abs_err"))


def stage_cut(position: Column, n: Column) -> Column:
    """Stage 0, 1 or 2 of the item at a position (from 0) of a stream of n."""
    cut1 = F.greatest(F.lit(1), F.floor(n / 3))
    cut2 = F.greatest(cut1 + 1, F.floor(2 * n / 3))
    return F.when(position < cut1, 0).when(position < cut2, 1).otherwise(2)


def split_stages(positioned: DataFrame) -> DataFrame:
    """Adds stage to (position, e); position is dense from 0, so its greatest value tells the length."""
    n = positioned.agg((F.max("position") + 1).alias("n"))
    return positioned.join(F.broadcast(n), F.lit(True)).withColumn("stage", stage_cut(F.col("position"), F.col("n"))).drop("n")


def cumulative_frequency(staged: DataFrame) -> DataFrame:
    """(stage, e, cnt) of each item up to and with each stage from its first one on."""
    own = staged.groupBy("e", "stage").agg(F.count(F.lit(1)).alias("n"))
    wide = own.groupBy("e").agg(*(F.coalesce(F.sum(F.when(F.col("stage") <= s, F.col("n"))), F.lit(0).cast("long")).alias(f"s{s}") for s in range(3)))
    rows = wide.select("e", F.posexplode(F.array("s0", "s1", "s2")).alias("stage", "cnt"))
    return rows.filter("cnt > 0").select("stage", "e", "cnt")


def collapse_stats(present: DataFrame, absent: DataFrame) -> DataFrame:
    """Whether estimates (e, est) tell keys apart: distinct values, share of the commonest, span and means."""
    by = present.groupBy("est").agg(F.count(F.lit(1)).alias("c"))
    p = by.agg(F.count(F.lit(1)).alias("uniq_present"), (F.max("c") / F.sum("c")).alias("mode_ratio"), (F.max("est") - F.min("est")).alias("present_span"), (F.sum(F.col("est") * F.col("c")) / F.sum("c")).alias("present_mean"))
    a = absent.agg(F.coalesce(F.avg("est"), F.lit(0.0)).alias("absent_mean"))
    return p.join(F.broadcast(a), F.lit(True))


def heavy_hitter_recall(report: DataFrame, k: int) -> DataFrame:
    """The share of the true k most frequent keys among the k of highest estimate."""
    true = report.orderBy(F.col("actual").desc(), "e").limit(k).select("e")
    told = report.orderBy(F.col("est").desc(), "e").limit(k).select("e")
    return true.join(told, "e", "left_semi").agg((F.count(F.lit(1)) / F.lit(float(k))).alias("recall"))
