"""Quality rules: rule statistics of each text, and an isolation forest over them with a calibrated threshold."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import columns_or_null, materialize

SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\x0c\r"
STATS = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")])


def rule_statistics(text: str) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words of a whole text."""
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(map(text.count, _SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    seen: set[str] = set()
    lines = 0
    for line in text.split("\n"):
        if line.strip(_SPACES):
            lines += 1
            seen.add(line)
    repeated = 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) < len(windows):
        times, end = Counter(windows), 0
        for i, w in enumerate(windows):
            if times[w] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    return len(words), chars, symbols, lines, lines - len(seen), repeated


def statistics(docs: DataFrame) -> DataFrame:
    """One row of rule statistics per document; a null text has no words."""

    def run(batches):
        for b in batches:
            rows = [rule_statistics((t or b"").decode("utf-8", "replace")) for t in b.column(1).to_pylist()]
            cols = np.array(rows, np.int64).reshape(-1, 6).T
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, cols)], schema=STATS)

    return columns_or_null(docs, doc_id="long", text="binary").mapInArrow(run, ", ".join(f"{c} long" for c in STATS.names))


def features(n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words) -> np.ndarray:
    """Shares of symbols, repeated lines and repeated words: zero in clean prose, so splits isolate from one side.
    The added denominators keep a single repeat in a short text from looking like a large share."""
    cols = (n_symbols, word_chars, 1), (n_dup_lines, n_lines, 4), (n_repeat_words, n_words, 20)
    return np.stack([np.asarray(a, float) / (np.asarray(b, float) + few) for a, b, few in cols], axis=1)


def average_path(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search in a binary search tree of n keys."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


#: The usual cut of isolation scores.
DEFAULT = 0.6


@dataclass
class Forest:
    """Trees as arrays: split feature (-1: leaf), split value, left child (right follows it), path length of a leaf."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    sample: int
    #: By the statistic that stands out most in a row; DEFAULT where no labelled rows tell.
    thresholds: np.ndarray = field(default_factory=lambda: np.full(3, DEFAULT))

    @staticmethod
    def fit(x: np.ndarray, n_trees: int = 100, sample: int = 256, seed: int = 7) -> Forest:
        rng = np.random.default_rng(seed)
        take = max(2, min(sample, len(x)))
        limit = int(np.ceil(np.log2(take)))
        trees = []
        for _ in range(n_trees if len(x) else 0):
            rows = x[rng.choice(len(x), min(take, len(x)), replace=False)]
            feat, cut, left, path, todo = [-1], [0.0], [0], [0.0], [(0, rows, 0)]
            while todo:
                node, part, depth = todo.pop()
                low, high = part.min(axis=0), part.max(axis=0)
                open_ = np.flatnonzero(high > low)
                if depth >= limit or len(part) < 2 or not len(open_):
                    path[node] = depth + float(average_path(len(part)))
                    continue
                f = int(rng.choice(open_))
                v = float(rng.uniform(low[f], high[f]))
                feat[node], cut[node], left[node] = f, v, len(feat)
                for k, side in enumerate((part[part[:, f] <= v], part[part[:, f] > v])):
                    feat.append(-1), cut.append(0.0), left.append(0), path.append(0.0)
                    todo.append((left[node] + k, side, depth + 1))
            trees.append((np.array(feat), np.array(cut), np.array(left), np.array(path)))
        return Forest(trees, take)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly scores in (0, 1): 2 ** (-mean path length / its mean for the sample size)."""
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for feat, cut, left, path in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                f = feat[at]
                inner = f >= 0
                if not inner.any():
                    break
                at = np.where(inner, left[at] + (x[rows, f] > cut[at]), at)
            total += path[at]
        return 2.0 ** (-total / max(1, len(self.trees)) / max(float(average_path(self.sample)), 1e-9))

    def calibrate(self, x: np.ndarray, good: np.ndarray, most_good_lost: float = 0.01) -> None:
        """Set each threshold to the best Youden index among those that lose at most the given share of good rows."""
        scores, kind = self.score(x), x.argmax(axis=1)
        for k in range(len(self.thresholds)):
            own = kind == k
            if own.any():
                self.thresholds[k] = best_cut(scores[own], good[own], most_good_lost)

    def odd(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores, and whether they exceed the threshold of the statistic that stands out most."""
        s = np.concatenate([np.empty(0)] + [self.score(x[i : i + 20_000]) for i in range(0, len(x), 20_000)])
        return s, s > self.thresholds[x.argmax(axis=1)] if len(x) else np.zeros(0, bool)


def best_cut(scores: np.ndarray, good: np.ndarray, most_good_lost: float) -> float:
    """Between two neighbouring scores; infinite if no cut finds bad rows without losing more good ones."""
    order = np.argsort(-scores, kind="stable")
    s, bad = scores[order], ~good[order]
    ends = np.flatnonzero(np.r_[s[1:] != s[:-1], True])
    hit, lost = np.cumsum(bad)[ends] / max(1, bad.sum()), np.cumsum(~bad)[ends] / max(1, (~bad).sum())
    value = np.where(lost <= most_good_lost, hit - lost, 0)
    k = int(np.argmax(value))
    if value[k] <= 0:
        return np.inf
    below = s[ends[k] + 1] if ends[k] + 1 < len(s) else s[ends[k]] - 1e-6
    return float((s[ends[k]] + below) / 2)


_INPUTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


#: Ranges of scores whose totals come to the driver, so that no task sorts all labelled rows.
RANGES = 4096


def fit_thresholds(forest: Forest, judged: DataFrame, most_good_lost: float = 0.01) -> None:
    """As Forest.calibrate, from all rows of judged (the inputs of the features, good): the same thresholds."""

    def run(batches):
        for b in batches:
            x = features(*(b.column(c).to_numpy() for c in _INPUTS))
            cols = [pa.array(x.argmax(axis=1), pa.int32()), pa.array(forest.score(x)), b.column("good")]
            yield pa.RecordBatch.from_arrays(cols, ["kind", "score", "good"])

    scored = judged.select(*_INPUTS, "good").mapInArrow(run, "kind int, score double, good boolean")
    place = F.least(F.floor(F.col("score") * RANGES), F.lit(RANGES - 1)).cast("int").alias("range")
    n = [F.sum(F.when(c, 1).otherwise(0)).alias(x) for c, x in ((F.col("good"), "lost"), (~F.col("good"), "hit"))]
    each = materialize(scored.groupBy("kind", "score", place).agg(*n), "quality-scores")
    sums, before, all_ = each.groupBy("kind", "range").agg(F.sum("lost").alias("lost"), F.sum("hit").alias("hit")).collect(), [], {}
    for r in sorted(sums, key=lambda r: (r.kind, -r["range"])):
        lost, hit = all_.get(r.kind, (0, 0))
        before.append((r.kind, r["range"], lost, hit))
        all_[r.kind] = lost + r.lost, hit + r.hit
    if not before:
        return
    rows = [(*r, *(max(1, x) for x in all_[r[0]])) for r in before]
    known = each.sparkSession.createDataFrame(rows, "kind int, range int, lost_0 long, hit_0 long, lost_all long, hit_all long")
    w = W.partitionBy("kind", "range").orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, W.currentRow)
    share = lambda x: (F.sum(x).over(w) + F.col(f"{x}_0")) / F.col(f"{x}_all")
    ends = each.join(F.broadcast(known), ["kind", "range"]).select("kind", "score", share("lost").alias("lost"), share("hit").alias("hit"))
    value = F.when(F.col("lost") <= most_good_lost, F.col("hit") - F.col("lost")).otherwise(F.lit(0.0))
    # of equal values the highest score, as the first in falling order
    for r in ends.groupBy("kind").agg(F.max(F.struct(value.alias("value"), "score")).alias("x")).select("kind", "x.*").collect():
        if r.value <= 0:
            forest.thresholds[r.kind] = np.inf
            continue
        below = each.filter((F.col("kind") == r.kind) & (F.col("score") < r.score)).agg(F.max("score")).first()[0]
        forest.thresholds[r.kind] = (r.score + (r.score - 1e-6 if below is None else below)) / 2


def fit_forest(stats: DataFrame, labels: DataFrame, sample_rows: int = 25_600) -> Forest:
    """An isolation forest learns each tree from few rows by its method: 100 trees take 256 each of the first 25,600
    rows in hash order of ids. Its thresholds come from all labelled rows that pass the base rule."""

    def bounded(df: DataFrame, n: int) -> np.ndarray:
        place, total = F.shiftrightunsigned(F.xxhash64("doc_id"), 1), max(1, df.count())
        share = 1.25 * n / total
        while True:
            # the first rows of the order, little more than n of them in all
            near = df if share >= 1 else df.filter(place < F.lit(int(share * (1 << 63))))
            rows = near.orderBy(place, *_INPUTS).limit(n).collect()
            if len(rows) >= n or share >= 1:
                return np.array([list(r) for r in rows], float)
            share *= 2

    cols = ["doc_id", *_INPUTS]
    x = bounded(stats.select(*cols), sample_rows)
    if not len(x):
        return Forest([], 2)
    forest = Forest.fit(features(*x[:, 1:].T))
    own = columns_or_null(labels, doc_id="long", quality="int").filter("doc_id is not null and quality is not null")
    own = own.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    judged = stats.filter(~base_failed()).select(*cols).join(own, "doc_id")
    fit_thresholds(forest, judged.withColumn("good", F.col("quality") > 0))
    return forest


def quality_verdicts(docs: DataFrame, labels: DataFrame, **limits: int) -> DataFrame:
    """doc_id, rule statistics, base_failed, anomaly and kept, one row per document.

    kept is false where base_failed, and where the isolation forest finds the statistics anomalous: where their mean
    path over random splits is so short that the score exceeds a threshold calibrated on labelled rows, one for each
    statistic that can stand out most. Without labelled rows of that kind the threshold is 0.6. A null or empty text has no words and fails the base rule; repeated
    rows get the same verdict each; an empty table gives an empty result; further columns are ignored."""
    stats = materialize(statistics(docs), "quality")
    forest = fit_forest(stats, labels, **limits)

    def run(batches):
        for b in batches:
            x = features(*(b.column(c).to_numpy() for c in _INPUTS))
            score, odd = forest.odd(x)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score), pa.array(odd)], [*b.schema.names, "anomaly", "odd"])

    kinds = ", ".join(f"{c} long" for c in STATS.names)
    scored = stats.mapInArrow(run, f"{kinds}, anomaly double, odd boolean")
    scored = scored.withColumn("base_failed", base_failed())
    return scored.withColumn("kept", ~F.col("base_failed") & ~F.col("odd"))


def keep_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose verdict is to keep; rows without a doc_id stay, as no verdict can be joined to them."""
    bad = quality_verdicts(docs, labels).filter("not kept").select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document. A null or empty text has no words and fails the base rule; repeated rows get one verdict each,
    the same; labels without an id or a quality teach nothing; an empty table gives no rows."""
    found = quality_verdicts(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly"
    )
