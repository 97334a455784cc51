"""Populations of programs as tables: who is replaced, who migrates, who survives, what is kept.

Rows: pid, fit, err and, as needed, birth, key (of equal function), island, case_vec."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def histogram(df: DataFrame, *axes: str) -> DataFrame:
    """(axis, value, n) of each of the named columns."""
    pairs = F.array(*(F.struct(F.lit(a).alias("axis"), F.col(a).cast("string").alias("value")) for a in axes))
    return df.select(F.explode(pairs).alias("p")).groupBy("p.axis", "p.value").agg(F.count(F.lit(1)).alias("n"))


def commonest(df: DataFrame, col: str, first: str) -> DataFrame:
    """The commonest value, of equal ones that seen first."""
    by = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"), F.min(first).alias("f"))
    return by.orderBy(F.col("n").desc(), "f").limit(1).select(col, "n")


def cluster_summary(df: DataFrame, key: str = "key") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("c")).agg(F.count(F.lit(1)).alias("unique_keys"), F.max("c").alias("max_cluster"))


def replacement_rank(pop: DataFrame, step: int) -> DataFrame:
    """rank 1 is replaced first: crowded keys, then age, then low fitness, then high error; pid settles ties."""
    crowd = F.greatest(F.count(F.lit(1)).over(W.partitionBy("key")) - 2, F.lit(0))
    scored = pop.withColumn("pressure", crowd).withColumn("age", F.greatest(F.lit(step) - F.col("birth"), F.lit(0)))
    order = W.orderBy(F.col("pressure").desc(), F.col("age").desc(), F.col("fit"), F.col("err").desc(), "pid")
    return scored.withColumn("rank", F.row_number().over(order))


def best_per_key(pop: DataFrame, *ties: str) -> DataFrame:
    order = W.partitionBy("key").orderBy(F.col("fit").desc(), "err", *ties)
    return pop.withColumn("r", F.row_number().over(order)).filter("r = 1").drop("r")


def migration_elite(pop: DataFrame, k: int) -> DataFrame:
    """Half of k places for the best of distinct keys."""
    return best_per_key(pop, "pid").orderBy(F.col("fit").desc(), "err", "pid").limit(max(1, k // 2))


def migrants(pop: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """The elite, then others in seeded order, new keys first."""
    elite = migration_elite(pop, k).withColumn("o", F.lit(0))
    rest = pop.join(elite.select("pid"), "pid", "left_anti")
    known = elite.select("key").distinct().withColumn("known", F.lit(1))
    rest = rest.join(known, "key", "left").withColumn("o", F.coalesce("known", F.lit(0)) + 1).drop("known")
    order = F.md5(F.concat_ws("|", F.col("pid").cast("string"), F.lit(str(seed))))
    nth = F.row_number().over(W.partitionBy("key").orderBy(order))
    rest = rest.withColumn("o", F.when(nth > 1, 2).otherwise(F.col("o")))
    return elite.unionByName(rest, allowMissingColumns=True).orderBy("o", F.when(F.col("o") == 0, -F.col("fit")), order).limit(k).drop("o")


def top_candidates(pop: DataFrame, k: int) -> DataFrame:
    return best_per_key(pop, "island").orderBy(F.col("fit").desc(), "err", "island").limit(k)


def holdout_rerank(pop: DataFrame, relative: float = 0.10, absolute: float = 5.0) -> DataFrame:
    """bucket 0: holdout errors that the best one's tolerance does not tell from it; then fitness and error decide."""
    best = F.min("holdout_err").over(W.partitionBy())
    close = F.col("holdout_err") <= best + F.greatest(F.lit(absolute), F.abs(best) * relative)
    scored = pop.withColumn("bucket", F.when(close, 0).otherwise(1))
    return scored.withColumn("rank", F.row_number().over(W.orderBy("bucket", F.col("fit").desc(), "err", "pid")))


def lexicase(pop: DataFrame, cases: list[int], epsilon: float = 1e-9) -> DataFrame:
    """Survivors of the cases in turn, each keeping those within epsilon of its best; the fittest survivor is first."""
    alive: DataFrame = pop.withColumn("alive", F.lit(True))
    for c in cases:
        v = F.element_at("case_vec", c + 1)
        best = F.min(F.when(F.col("alive"), v)).over(W.partitionBy())
        alive = alive.withColumn("alive", F.col("alive") & (v <= best + epsilon))
    return alive.filter("alive").drop("alive").orderBy(F.col("fit").desc(), "pid")


def halve(pop: DataFrame, fraction: float, offset: float, err: str = "err") -> DataFrame:
    """keep for the share of lowest error; the error of the others grows by offset."""
    rank = F.row_number().over(W.orderBy(err, F.col("fit").desc(), "pid"))
    n = F.count(F.lit(1)).over(W.partitionBy())
    keep = rank <= F.greatest(F.ceil(n * F.lit(fraction)), F.lit(1))
    return pop.withColumn("keep", keep).withColumn("final_err", F.when(keep, F.col(err)).otherwise(F.col(err) + offset))


def archive_merge(archive: DataFrame, new: DataFrame, keep: int) -> DataFrame:
    """One row per (schema_hash, motif_key), the one of least error, of equal ones the new one; the best keep rows."""
    both = archive.withColumn("age", F.lit(1)).unionByName(new.withColumn("age", F.lit(0)))
    order = W.partitionBy("schema_hash", "motif_key").orderBy(F.coalesce("err", F.lit(1e18)), "age")
    best = both.withColumn("r", F.row_number().over(order)).filter("r = 1").drop("r", "age")
    return best.orderBy(F.coalesce("err", F.lit(1e18)), "motif_key").limit(keep)


def upsert(table: DataFrame, new: DataFrame, key: str, *values: str) -> DataFrame:
    """New values win, keys of both sides stay."""
    a, b = table.alias("a"), new.alias("b")
    both = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    return both.select(F.coalesce(f"b.{key}", f"a.{key}").alias(key), *(F.coalesce(f"b.{v}", f"a.{v}").alias(v) for v in values))


def recent(df: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """The last n rows of each group."""
    return df.withColumn("r", F.row_number().over(W.partitionBy(by).orderBy(F.col(order).desc()))).filter(F.col("r") <= n).drop("r")


def reject_reasons(df: DataFrame, k: int = 3) -> DataFrame:
    return df.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "reason").limit(k)


def weighted_case_mean(vectors: DataFrame) -> DataFrame:
    """(pid, pos, value): the case vectors of a program over several streams, averaged by weight."""
    each = vectors.select("pid", "weight", F.posexplode("case_vec").alias("pos", "v"))
    return each.groupBy("pid", "pos").agg((F.sum(F.col("v") * F.col("weight")) / F.sum("weight")).alias("value"))


def role_entropy(roles: Column) -> Column:
    """Entropy of three roles, as analyze.role_entropy."""
    kinds = F.array_distinct(roles)
    n = F.size(roles).cast("double")
    h = F.aggregate(kinds, F.lit(0.0), lambda a, k: a - (F.size(F.filter(roles, lambda r: r == k)) / n) * F.log2(F.size(F.filter(roles, lambda r: r == k)) / n))
    return F.when(F.size(kinds) < 2, 0.0).otherwise(h / F.greatest(F.lit(1.0), F.log2(F.size(kinds).cast("double"))))


def flags_distance(a: list[Column], b: list[Column]) -> Column:
    return reduce(lambda x, y: x + y, ((p != q).cast("double") for p, q in zip(a, b)))


def island_stats(pop: DataFrame) -> DataFrame:
    """Per island: how many, least, median and greatest error, mean fitness and error."""
    return pop.groupBy("island").agg(F.count(F.lit(1)).alias("n"), F.min("err").alias("min_err"), F.median("err").alias("median_err"), F.max("err").alias("max_err"), F.avg("fit").alias("avg_fit"), F.avg("err").alias("avg_err"))


def unseen(programs: DataFrame, results: DataFrame, *keys: str) -> DataFrame:
    """Programs that no stored result has under all of the keys, one of each: what is left to evaluate."""
    new = programs.join(results.select(*keys).distinct(), list(keys), "left_anti")
    order = W.partitionBy(*keys).orderBy("pid")
    return new.withColumn("r", F.row_number().over(order)).filter("r = 1").drop("r")


def blocked(candidates: DataFrame, failures: DataFrame, most: int) -> DataFrame:
    """Candidates whose basin has failed fewer than `most` times."""
    full = failures.groupBy("basin").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= most)
    return candidates.join(full.select("basin"), "basin", "left_anti")


def quota_trim(rows: list[dict], keep: int, family_quota: int, motif_quota: int) -> list[dict]:
    """The best by score under quotas of families and motifs; places left go to the best of the rest. A small list:
    each choice depends on those before it."""
    order = sorted(rows, key=lambda r: (-r["score"], r.get("err", 0.0), str(r.get("key", ""))))
    out, n = [], {}
    for r in order:
        f, m = ("family", r.get("family")), ("motif", r.get("motif"))
        if len(out) < keep and n.get(f, 0) < family_quota and n.get(m, 0) < motif_quota:
            out.append(r)
            n[f], n[m] = n.get(f, 0) + 1, n.get(m, 0) + 1
    return (out + [r for r in order if r not in out])[:keep]
