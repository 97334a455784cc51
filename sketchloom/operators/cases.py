"""Hard cases: items that programs got wrong, kept, aged and replayed. Tables of (item, expected, score, bucket)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What the score of a kept case is worth after each round.
DECAY = 0.85


def tidy(cases: DataFrame) -> DataFrame:
    """Cases with an item; scores below 0 are 0, an empty bucket is generic."""
    bucket = F.when(F.coalesce("bucket", F.lit("")) == "", "generic").otherwise(F.col("bucket"))
    return cases.filter("item is not null and item <> ''").select("item", F.col("expected").cast("long").alias("expected"), F.greatest(F.coalesce(F.col("score").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("score"), bucket.alias("bucket"))


def hardest(cases: DataFrame, k: int) -> DataFrame:
    """Each item's case of highest score; the k highest of these, by item on ties."""
    best = tidy(cases).groupBy("item").agg(F.max_by(F.struct("expected", "bucket"), F.struct("score", "expected", "bucket")).alias("r"), F.max("score").alias("score"))
    return best.select("item", "r.expected", "score", "r.bucket").orderBy(F.col("score").desc(), "item").limit(k)


def merge_cases(old: DataFrame, new: DataFrame, k: int, decay: float = DECAY) -> DataFrame:
    aged = tidy(old).withColumn("score", F.col("score") * decay)
    return hardest(aged.unionByName(tidy(new)), k)


def round_robin(cases: DataFrame, quota: int) -> DataFrame:
    """(item, expected, score, bucket, turn): the buckets take turns, larger ones first, each giving its next case.

    An item in several buckets counts where its turn comes first."""
    ranked = cases.withColumn("nth", F.row_number().over(W.partitionBy("bucket").orderBy(F.col("score").desc(), "item")))
    sizes = cases.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"))
    order = ranked.join(F.broadcast(sizes), "bucket")
    first = order.groupBy("item").agg(F.min(F.struct("nth", (-F.col("size")).alias("s"), "bucket", "expected", "score")).alias("r"))
    # within a bucket, cases that another bucket has taken leave no gap
    own = first.select("item", "r.expected", "r.score", "r.bucket", F.col("r.s").alias("s"), F.row_number().over(W.partitionBy("r.bucket").orderBy("r.nth")).alias("turn"))
    return own.orderBy("turn", "s", "bucket").limit(quota).select("item", "expected", "score", "bucket", "turn")


def evaluation_items(freq: DataFrame, replay: DataFrame, limit: int, weight: float) -> DataFrame:
    """(e, expected): the most frequent items, with a share of the places for replayed cases, none twice."""
    quota = min(replay.count(), max(0, round(limit * weight)))
    ranked = freq.select("e", F.col("cnt").alias("expected"), F.row_number().over(W.orderBy(F.col("cnt").desc(), "first_seq")).alias("r")) if "first_seq" in freq.columns else freq.select("e", F.col("cnt").alias("expected"), F.row_number().over(W.orderBy(F.col("cnt").desc(), "e")).alias("r"))
    ranked = ranked.filter(F.col("r") <= limit)
    head = ranked.filter(F.col("r") <= max(1, limit - quota)).select("e", "expected", F.lit(0).alias("rank"), F.col("r"))
    extra = round_robin(replay, quota).select(F.col("item").alias("e"), "expected", F.lit(1).alias("rank"), F.row_number().over(W.orderBy("turn", "bucket")).alias("r"))
    extra = extra.join(head.select("e"), "e", "left_anti")
    rest = ranked.filter(F.col("r") > max(1, limit - quota)).select("e", "expected", F.lit(2).alias("rank"), "r").join(extra.select("e"), "e", "left_anti")
    return head.unionByName(extra).unionByName(rest).orderBy("rank", "r").limit(limit).select("e", "expected")


def absent_items(cases: DataFrame, bank: DataFrame, limit: int) -> DataFrame:
    """Hard absent items, then those of the bank that are not among them: (e, source)."""
    hard = cases.select(F.col("item").alias("e"), F.lit(0).alias("source"), (-F.col("score")).alias("o"))
    rest = bank.select("e", F.lit(1).alias("source"), F.col("i").cast("double").alias("o")).join(hard.select("e"), "e", "left_anti")
    return hard.unionByName(rest).orderBy("source", "o", "e").limit(limit).select("e", "source")
