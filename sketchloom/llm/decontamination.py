"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Items are partitioned by their number of distinct shingles. An item of n shingles is contained at the threshold t in a
text that has at least ceil(t n) of them, so it lacks at most n - ceil(t n). The signature of an item is its
n - ceil(t n) + 1 least shingles by hash: a text that contains the item holds at least one of them, whatever its own
length. Texts are searched for signatures only, by the hashes of their runs of words, so the search misses nothing and
the shingles of a text are made only where it found something. That is verified by counting the item's shingles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns_or_null, materialize

SHINGLE, THRESHOLD = 5, 0.8
#: Item shingles (about 100 bytes each) that are broadcast at most; more are joined by a shuffle.
BROADCAST_SHINGLES = 200_000


def words(text: str) -> Column:
    """Lower-cased runs of letters and digits of any script, so punctuation and spacing make no difference."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{M}\p{N}]+", " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def shingles(w: str | Column, size: int = SHINGLE) -> Column:
    """Runs of `size` words, joined by spaces; fewer words are one run, no words none."""
    w = F.col(w) if isinstance(w, str) else w
    starts = F.sequence(F.lit(1), F.greatest(F.size(w) - size + 1, F.lit(1)))
    runs = F.transform(starts, lambda i: F.array_join(F.slice(w, i, size), " "))
    return F.when(F.size(w) > 0, runs).otherwise(F.array().cast("array<string>"))


def run_hash(w: str, i: Column, size: int = SHINGLE) -> Column:
    """The hash of the words i, i + 1, ... of w; fewer words where w ends."""
    return F.xxhash64(*(F.get(w, i + k) for k in range(size)))


def item_shingles(items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """item_id, shingle, h, n_item, need, part and in_signature: the distinct shingles of each item; part: its
    partition by size, of all items that need from 2 ** part shingles to below 2 ** (part + 1)."""
    own = columns_or_null(items, item_id="long", text="string").filter("item_id is not null").select("item_id", words("text").alias("w"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - SHINGLE, F.lit(0)))
    runs = own.filter(F.size("w") > 0).select("item_id", "w", F.explode(starts).alias("i"))
    each = runs.select("item_id", F.array_join(F.slice("w", F.col("i") + 1, SHINGLE), " ").alias("shingle"), run_hash("w", F.col("i")).alias("h")).distinct()
    n = each.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_item"), F.sort_array(F.collect_list("h")).alias("hashes"))
    n = n.withColumn("need", F.ceil(F.col("n_item") * F.lit(threshold) - 1e-9)).withColumn("part", F.floor(F.log2("need")).cast("int"))
    # the size fixes how many of the least hashes make the signature
    n = n.withColumn("cut", F.element_at("hashes", (F.col("n_item") - F.col("need") + 1).cast("int")))
    return each.join(n.drop("hashes"), "item_id").select("item_id", "shingle", "h", "n_item", "need", "part", (F.col("h") <= F.col("cut")).alias("in_signature"))


def where_small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_SHINGLES else df


def candidates(texts: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, item_id): texts (doc_id, w) with a shingle of an item's signature, in the partitions by size that a text
    of so many words can hold. Every text that contains an item to the threshold is among them, and few others."""
    signature = known.filter("in_signature").select("h", "part", "need", "item_id").distinct()
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - SHINGLE, F.lit(0)))
    largest = F.floor(F.log2(F.greatest(F.size("w") - SHINGLE + 1, F.lit(1)))).cast("int")
    # no words: a run of nulls, which no signature holds
    each = texts.select("doc_id", "w", largest.alias("largest"), F.explode(starts).alias("i"))
    each = each.select("doc_id", "largest", run_hash("w", F.col("i")).alias("h"))
    return each.join(where_small(signature), "h").filter("part <= largest").select("doc_id", "item_id").distinct()


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, n_shared, n_item, containment: each benchmark item that a text contains to the threshold.

    containment: the share of the item's distinct five-word shingles that stand in the text. An item or text of fewer
    words is one shingle of all of them; without words (null, empty, only punctuation) it matches nothing. Whole texts
    are searched, however long. Repeated rows of one doc_id count as one text; rows without an id are left out, as no
    pair can name them. An empty table gives an empty result; further columns are ignored."""
    known = materialize(item_shingles(items, threshold), "benchmark")
    own = columns_or_null(docs, doc_id="long", text="string").filter("doc_id is not null")
    found = materialize(candidates(own.select("doc_id", words("text").alias("w")), known), "benchmark-candidates")
    # verification: shingles are made of the texts found, and counted for the items found in them
    needed = where_small(found.select("doc_id").distinct())
    each = own.join(needed, "doc_id").select("doc_id", words("text").alias("w")).select("doc_id", F.explode(shingles("w")).alias("shingle"))
    hits = each.join(where_small(known.select("shingle", "item_id", "n_item", "need")), "shingle").distinct()
    pairs = hits.join(found, ["doc_id", "item_id"]).groupBy("doc_id", "item_id", "n_item", "need").agg(F.count(F.lit(1)).alias("n_shared"))
    return pairs.filter("n_shared >= need").select("doc_id", "item_id", "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that contain no benchmark item; rows without a doc_id stay."""
    bad = contaminated(docs, items, threshold).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all items. Null, empty and wordless texts on either side match nothing; whole long texts are
    searched; repeated rows of an id count as one; rows without an id are left out; empty tables give no rows."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_WORDS = r"list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '')"
ORACLE = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda k: array_to_string(w[k:k+4], ' '))) AS s
       FROM d WHERE len(w) > 0),
its AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda k: array_to_string(w[k:k+4], ' '))) AS s
        FROM i WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS n_item FROM its GROUP BY item_id),
m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN its USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment
FROM m JOIN n USING (item_id) WHERE n_shared >= ceil(0.8 * n_item - 1e-9)
"""
