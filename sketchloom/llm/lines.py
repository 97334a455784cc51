"""Fuzzy line dedup: MinHash over character shingles, banding, exact Jaccard, components, one line per component.

Only DataFrame functions run here. The shingles of a line are its runs of SHINGLE characters, one from each character
on, whatever the script; a line of at most so many is one shingle. A signature has VALUES values, each the least shingle
hash in an order of its own: an exclusive or with a mask that differs in the top four bits. Two lines of similarity J
agree in each value with a chance of J; a band is two values, so of BANDS = 6 a pair of 0.8 shares one with a chance of
1 - 0.36 ** 6, above 99.7 %.

In each band a line is compared with a few others that follow one another in the order of the next band's values, which
joins groups of similar lines at a cost linear in the band. Bands that are then still in several components are
compared in full across these, by sketches or prefix filters, so every pair that shares a band and reaches the threshold is in one
component.

A line is named by its place, doc_id * 2**27 + line number, so the least name of a component is its first line."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import columns_or_null, connected_components, materialize, shuffle_partitions

SHINGLE, BANDS, THRESHOLD = 12, 6, 0.8
VALUES = 2 * BANDS
#: Of a line with more than ENOUGH shingles only the smaller hashes of each order's own sixteenth are looked at (some
#: ENOUGH / 16 in each) and those of the first FIRST characters. Where repeats inside a line leave fewer than
#: LEAST_OWN of the sixteenths with a hash, the line is looked at again, all of it.
ENOUGH, FIRST, LEAST_OWN = 64, 8, 8
#: In a band a line is compared with so many before it, in the order of the next band.
NEIGHBOURS = 1
#: Bands of at most so many lines that are still in several components compare all sketches across these.
FULL = 32
#: Lines outside a larger band's most frequent root that are compared with all of the band by sketches; more by prefix filters.
OUTSIDE = 1024
#: 64-bit words of a sketch, a power of two.
WORDS = 16
WORD = [f"x{i}" for i in range(WORDS)]
#: Eighths of the shingle hashes that first tell which lines of a larger band are like no other.
SOME = 3
#: Bands of more lines are cut into runs of about so many by the next band's values; the prefix filters join these.
RUN = 4096
#: Line places (8 bytes each) that are broadcast at most to fetch lines for verification; more are joined by a shuffle.
BROADCAST_LINES = 500_000
LINES = 1 << 27
LOW = (1 << 60) - 1


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingle_runs(line: str | Column) -> Column:
    """Hashes of the runs of SHINGLE characters from each character of a line on, repeats included."""
    line = F.col(line) if isinstance(line, str) else line
    # four bytes a character, so that a run is found without a walk; bound to a variable, so that it is encoded once
    runs = F.transform(F.array(F.encode(line, "UTF-32")), lambda x: F.transform(run_starts(line), lambda i: F.xxhash64(F.substring(x, i, F.lit(4 * SHINGLE)))))
    return runs[0]


def run_starts(line: Column) -> Column:
    """Places (from 1) in a line of four bytes a character where a shingle begins."""
    return F.sequence(F.lit(1), F.greatest(F.length(line) - SHINGLE, F.lit(0)) * 4 + 1, F.lit(4))


def exploded_shingles(lines: DataFrame, *keep: str) -> DataFrame:
    """The columns keep, at and h: a row for each place of a line where a shingle begins. The same hashes as
    shingle_runs, as rows, which are made and used in compiled code."""
    wide = lines.select(*keep, run_starts(F.col("line")).alias("__at"), F.encode("line", "UTF-32").alias("__wide"))
    each = wide.select(*keep, "__wide", F.explode("__at").alias("at"))
    return each.select(*keep, "at", F.xxhash64(F.substring("__wide", F.col("at"), F.lit(4 * SHINGLE))).alias("h"))


def split_lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 0) and line of all \n-split lines; a null text has none."""
    own = columns_or_null(docs, doc_id="long", text="string").filter("text is not null and doc_id is not null")
    return own.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def blank(line: Column) -> Column:
    return ~line.rlike(r"[^\x20\x09\x0B-\x0D]")


def place(wide: bool) -> Column:
    """doc_id and line_no in one number, of 64 bits unless ids are too large for it."""
    return F.col("doc_id").cast("decimal(38,0)" if wide else "long") * F.lit(LINES) + F.col("line_no")


def needs_wide(docs: DataFrame) -> bool:
    r = docs.select(F.min(F.col("doc_id").cast("long")), F.max(F.col("doc_id").cast("long"))).first()
    return any(x is not None and abs(x) >= 1 << 35 for x in r)


def cut(n: Column) -> Column:
    """The largest hash, without its top four bits, that is looked at anywhere in a line."""
    return F.when(n > ENOUGH, F.floor(F.lit(float(ENOUGH << 60)) / n)).otherwise(F.lit(LOW)).cast("long")


def signatures(shingles: DataFrame, key: str) -> DataFrame:
    """key, node (the least), n (characters that begin a shingle), own and b1, b2, ...: the bands of each line. own: in
    how many of the orders the least hash is of the order's own sixteenth, and small enough to be looked at anywhere."""
    # the sign is turned, so that an order's own sixteenth comes first among signed numbers
    masks = [signed((i ^ 8) << 60) for i in range(VALUES)]
    least = [F.min(F.col("h").bitwiseXOR(F.lit(m))).alias(f"m{i}") for i, m in enumerate(masks)]
    found = shingles.groupBy(key).agg(F.min("node").alias("node"), F.max("n").alias("n"), *least)
    own = [(F.shiftrightunsigned(f"m{i}", 60) == 8) & (F.col(f"m{i}").bitwiseAND(F.lit(LOW)) <= cut(F.col("n"))) for i in range(VALUES)]
    own = sum((x.cast("int") for x in own), F.lit(0))
    bands = [F.xxhash64(F.lit(i), F.col(f"m{i}"), F.col(f"m{i + BANDS}")).alias(f"b{i + 1}") for i in range(BANDS)]
    return found.select(key, "node", "n", own.alias("own"), *bands)


def looked_at(every: DataFrame) -> DataFrame:
    """The shingles of lines (node, digest, n, cut, line) that enter the signatures. A filter is not moved below a column
    that numbers rows, so each hash is worked out once."""
    each = exploded_shingles(every, "node", "digest", "n", "cut").withColumn("row", F.monotonically_increasing_id())
    low = F.col("h").bitwiseAND(F.lit(LOW)) <= F.col("cut")
    own = low & (F.shiftrightunsigned("h", 60) < VALUES)
    return each.filter((F.col("row") >= 0) & ((F.col("at") <= 4 * FIRST) | (F.col("n") <= ENOUGH) | own)).drop("row")


def distinct_lines(docs: DataFrame, wide: bool) -> DataFrame:
    """(node, n, b1, b2, ...) of the distinct lines, node the place of the first, n their places where a shingle begins."""
    every = split_lines(docs).filter(~blank(F.col("line")) & (F.col("line_no") < LINES))
    n = F.greatest(F.length("line") - SHINGLE + 1, F.lit(1))
    every = every.select(place(wide).alias("node"), F.unhex(F.md5("line")).alias("digest"), n.alias("n"), "line")
    every = every.withColumn("cut", cut(F.col("n")))
    each = looked_at(every)
    names = ["node", "n", *(f"b{i + 1}" for i in range(BANDS))]
    first = materialize(signatures(each, "digest").withColumn("again", (F.col("n") > ENOUGH) & (F.col("own") < LEAST_OWN)).select("again", *names), "lines")
    again = first.filter("again").select("node", "n")
    if again.isEmpty():
        return first.select(*names)
    texts = fetched(again, docs, wide).repartition(shuffle_partitions(docs.sparkSession), "node")
    whole = exploded_shingles(texts, "node", "n").withColumnRenamed("node", "key").withColumn("node", F.col("key"))
    more = materialize(signatures(whole, "key").select(*names), "lines-again")
    return first.filter("not again").select(*names).union(more)


def fetched(needed: DataFrame, docs: DataFrame, wide: bool) -> DataFrame:
    """The rows of needed (node, ...) with the lines they name. Only texts that hold one are split."""
    if needed.count() <= BROADCAST_LINES:
        holders = F.floor(F.col("node") / F.lit(LINES)).cast("long") if wide else F.shiftright("node", 27)
        docs = columns_or_null(docs, doc_id="long", text="string").join(F.broadcast(needed.select(holders.alias("doc_id")).distinct()), "doc_id", "left_semi")
        needed = F.broadcast(needed)
    lines = split_lines(docs).filter(F.col("line_no") < LINES).select(place(wide).alias("node"), "line")
    return lines.join(needed, "node").dropDuplicates(["node"])


def shared_bands(distinct: DataFrame) -> DataFrame:
    """(band, k, node, next): the bands that several distinct lines share, k of them; next is of the line's next band."""
    pairs = [F.struct(F.col(f"b{i + 1}").alias("band"), F.shiftright(f"b{(i + 1) % BANDS + 1}", 32).cast("int").alias("next")) for i in range(BANDS)]
    bands = distinct.select("node", F.explode(F.array(*pairs)).alias("x")).select("node", "x.band", "x.next")
    several = materialize(bands.groupBy("band").agg(F.count(F.lit(1)).alias("k")).filter("k > 1"), "line-bands")
    return materialize(bands.join(several.hint("shuffle_hash"), "band"), "line-shared")


def sketches(texts: DataFrame) -> DataFrame:
    """(node, n, x0, x1, ...) of lines (node, line): n distinct shingles, and a bit for each of 64 * WORDS classes of
    shingle hashes, set where the line has an odd number of the class. Two lines have at least as many shingles that the
    other lacks as bits that differ."""
    each = texts.select("node", F.explode(F.array_distinct(shingle_runs("line"))).alias("h"))
    bit = F.expr("shiftleft(1L, cast(h & 63 as int))")
    word = F.shiftrightunsigned("h", 6).bitwiseAND(F.lit(WORDS - 1))
    odd = [F.bit_xor(F.when(word == i, bit).otherwise(F.lit(0).cast("long"))).alias(c) for i, c in enumerate(WORD)]
    return each.groupBy("node").agg(F.count(F.lit(1)).cast("double").alias("n"), *odd)


def differing() -> Column:
    return sum((F.bit_count(F.col(f"{c}_u").bitwiseXOR(F.col(f"{c}_v"))) for c in WORD), F.lit(0))


def near_enough(threshold: float) -> Column:
    """Whether lines of n_u, n_v shingles and sketches x0_u, x0_v, ... may reach the threshold: necessary, not enough."""
    sized = F.greatest("n_u", "n_v") * threshold - 1e-9 <= F.least("n_u", "n_v")
    return sized & (differing() * (1 + threshold) <= (F.col("n_u") + F.col("n_v")) * (1 - threshold) + 1e-6)


def side(rows: DataFrame, x: str, *keep: str) -> DataFrame:
    return rows.select(*keep, *(F.col(c).alias(f"{c}_{x}") for c in rows.columns if c not in keep))


def close_pairs(pairs: DataFrame, sketch: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Those of the pairs (u, v) that may reach the threshold by their sketches."""
    a, b = (side(sketch, x).withColumnRenamed(f"node_{x}", x) for x in "uv")
    return pairs.join(a, "u").join(b, "v").filter(near_enough(threshold)).select("u", "v")


def neighbour_pairs(shared: DataFrame) -> DataFrame:
    """(u, v): lines that meet in a band. A line makes at most NEIGHBOURS pairs in each band, whatever its size; a band
    of at most NEIGHBOURS + 1 lines makes all its pairs."""
    run = F.when(F.col("k") > RUN, F.pmod("next", F.ceil(F.col("k") / RUN))).otherwise(F.lit(0))
    w = W.partitionBy("band", "run").orderBy("next", "node")
    met = F.array_compact(F.array(*(F.lag("node", k).over(w) for k in range(1, NEIGHBOURS + 1))))
    pairs = shared.withColumn("run", run).select("node", met.alias("met")).select("node", F.explode("met").alias("other"))
    return pairs.select(F.greatest("node", "other").alias("u"), F.least("node", "other").alias("v")).distinct()


def verified(pairs: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(u, v) of those pairs (u, v) whose lines, among texts (node, line), reach the threshold by exact Jaccard."""
    k = pairs.count()
    if not k:
        return pairs
    if 2 * k <= BROADCAST_LINES:
        texts = texts.join(F.broadcast(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()), "node", "left_semi")
    a, b = (texts.select(F.col("node").alias(x), F.col("line").alias(f"{x}_line")) for x in "uv")
    own = [F.array_distinct(shingle_runs(f"{x}_line")).alias(x * 2) for x in "uv"]
    each = pairs.join(a, "u").join(b, "v").select("u", "v", *own)
    shared, total = F.size(F.array_intersect("uu", "vv")), F.size("uu") + F.size("vv")
    return each.filter(shared * (1 + threshold) >= total * threshold - 1e-9).select("u", "v")


def split_bands(shared: DataFrame, roots: DataFrame, sketch: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(band, k, next, node, root, n, x0, ...): the lines of bands that hold a line of another component, of a size near
    enough to its own."""
    large = materialize(shared.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "line-large")
    split = large.groupBy("band").agg(F.min("root").alias("a"), F.max("root").alias("z")).filter("a <> z").select("band")
    members = large.join(split, "band", "left_semi")
    # by steps of sizes, so wide that sets of one step and the next are near enough, with those of both sides
    step = F.floor(F.log("n") / F.lit(-math.log(threshold)))
    sized = materialize(members.join(sketch, "node").withColumn("step", step.cast("int")), "line-split")
    near = sized.groupBy("band", "step").agg(F.min("root").alias("a"), F.max("root").alias("z"))
    near = near.select("a", "z", "band", F.explode(F.array(*(F.col("step") + k for k in (-1, 0, 1)))).alias("step"))
    near = near.groupBy("band", "step").agg(F.min("a").alias("a"), F.max("z").alias("z")).filter("a <> z").select("band", "step")
    return sized.join(near, ["band", "step"], "left_semi").drop("step")


def met(a: DataFrame, b: DataFrame, on: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """(u, v, root_u, root_v, bits): the pairs of members that meet by on, of different roots, that may reach the
    threshold by their sketches; bits of these differ."""
    a, b = (side(x.select(*on, "node", "root", "n", *WORD), y, *on) for x, y in ((a, "u"), (b, "v")))
    pairs = a.join(b, on).filter((F.col("root_u") != F.col("root_v")) & near_enough(threshold))
    return pairs.select(F.col("node_u").alias("u"), F.col("node_v").alias("v"), "root_u", "root_v", differing().alias("bits"))


def pairs_of_runs(members: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """As met, all pairs of each band of at most FULL lines, and those of runs of FULL lines of larger bands, in the
    order of the next band's values."""
    run = F.when(F.col("k") > RUN, F.pmod("next", F.ceil(F.col("k") / RUN))).otherwise(F.lit(0))
    w = W.partitionBy("band", "run").orderBy("next", "node")
    part = F.when(F.col("k") > FULL, F.floor((F.row_number().over(w) - 1) / FULL)).otherwise(F.lit(0))
    own = members.withColumn("run", run).withColumn("part", part)
    return met(own, own, ["band", "run", "part"], threshold).filter("u > v")


def pairs_of_outsiders(members: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """As met, all pairs of each band that may be similar enough. Outsiders are the lines outside a band's most frequent
    root: up to OUTSIDE of them are compared with all lines by sketches, more by prefix filters."""
    size = members.groupBy("band", "root").agg(F.count(F.lit(1)).alias("k"))
    main = size.groupBy("band").agg(F.max_by("root", F.struct("k", "root")).alias("main"), F.sum("k").alias("k"), (F.sum("k") - F.max("k")).alias("outside"))
    own = materialize(members.drop("k", "next").join(main, "band"), "line-outside")
    few, many = own.filter(F.col("outside") <= OUTSIDE), own.filter(F.col("outside") > OUTSIDE)
    # a band's lines are dealt to parts of about RUN, its outsiders go to each of them
    parts = F.ceil(F.col("k") / RUN)
    outsiders = few.filter("root <> main").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    pairs = met(outsiders, few.withColumn("part", F.pmod(F.xxhash64("node"), parts)), ["band", "part"], threshold)
    if many.isEmpty():
        return pairs
    likely = materialize(not_alone(many.select("band", "node", "root", "n"), texts, threshold), "line-not-alone")
    found = prefix_pairs(likely, texts, threshold).distinct()
    lines = many.dropDuplicates(["node"]).select("node", "root", "n", *WORD)
    a, b = (side(lines, x).withColumnRenamed(f"node_{x}", x) for x in "uv")
    found = found.join(a, "u").join(b, "v").filter(near_enough(threshold))
    return pairs.union(found.select("u", "v", "root_u", "root_v", differing().alias("bits")))


def not_alone(members: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Those of members (band, node, root, n) that may be similar to a line of their band under another root, told by
    SOME eighths of all shingle hashes: who has too many shingles there that no other root has is similar to none."""
    lines = texts.join(members.select("node").distinct(), "node", "left_semi")
    some = F.filter(F.array_distinct(shingle_runs("line")), lambda h: h.bitwiseAND(F.lit(7)) < SOME)
    own = members.join(lines.select("node", some.alias("some")), "node")
    each = materialize(own.select("band", "node", "root", F.explode("some").alias("s")), "line-some")
    alone = each.groupBy("band", "s").agg(F.min("root").alias("root"), F.max("root").alias("z")).filter("root = z").select("band", "s")
    count = each.join(alone.hint("shuffle_hash"), ["band", "s"], "left_semi").groupBy("band", "node").agg(F.count(F.lit(1)).alias("alone"))
    told = members.join(count, ["band", "node"], "left")
    return told.filter(F.col("n") - F.coalesce("alone", F.lit(0)) >= F.col("n") * threshold - 1e-6).drop("alone")


def prefix_pairs(members: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(u, v): all pairs of members (band, node, root, n) of one band and different roots that can be similar enough, by
    prefix filters.

    Sets of n and m <= n shingles that reach the threshold t share at least a = ceil(t (n + m) / (1 + t)). In one order
    of all shingles they have one in common among the first n - a + 1 of the one and m - a + 1 of the other: for the
    larger set at most n - ceil(t n) + 1, as m >= t n, for the smaller m - ceil(2 t m / (1 + t)) + 1, as n >= m. In the
    order, shingles that stand under one root of the band only come first, as they make no pair, then rare ones; so what
    a template gives to all its lines comes last, and is in no prefix of a smaller set where lines differ by more than
    the threshold allows. In a posting only lines outside its most frequent root look for partners."""
    t = threshold
    own = materialize(texts.join(members.select("band", "node", "root", "n"), "node"), "line-members")
    each = own.select("band", "node", "root", "n", F.explode(F.array_distinct(shingle_runs("line"))).alias("s"))
    told = each.groupBy("band", "s").agg(F.count(F.lit(1)).alias("df"), F.min("root").alias("least"), F.max("root").alias("most"))
    told = materialize(told.filter("least <> most").select("band", "s", "df"), "line-told")
    # counted from the end, where the shingles of one root only are missing
    last = F.row_number().over(W.partitionBy("band", "node").orderBy(F.desc("df"), F.desc("s")))
    n = F.col("n")
    ranked = each.join(told.hint("shuffle_hash"), ["band", "s"]).withColumn("last", last).filter(F.col("last") >= F.ceil(n * t - 1e-6))
    posts = ranked.select("band", "s", "node", "n", "root", (n + 1 - F.col("last")).alias("rank"), (F.col("last") >= F.ceil(n * 2 * t / (1 + t) - 1e-6)).alias("small"))
    posts = materialize(posts, "line-posts")
    main = posts.groupBy("band", "s", "root").agg(F.count(F.lit(1)).alias("k")).groupBy("band", "s").agg(F.max_by("root", F.struct("k", "root")).alias("main"))
    a = posts.join(main, ["band", "s"]).filter("root <> main").select("band", "s", *(F.col(c).alias(f"{c}_a") for c in ("node", "n", "root", "rank", "small")))
    b = posts.select("band", "s", *(F.col(c).alias(f"{c}_b") for c in ("node", "n", "root", "rank", "small")))
    sized = (F.greatest("n_a", "n_b") * t - 1e-9 <= F.least("n_a", "n_b")) & F.when(F.col("n_a") < F.col("n_b"), F.col("small_a")).when(F.col("n_a") > F.col("n_b"), F.col("small_b")).otherwise(F.col("small_a") | F.col("small_b"))
    # a shingle at these places leaves so many at most to share, beside those before it
    left = F.least("n_a", "n_b") - 1 >= F.ceil((F.col("n_a") + F.col("n_b")) * t / (1 + t) - 1e-6) - F.least("rank_a", "rank_b")
    met = a.join(b, ["band", "s"]).filter((F.col("root_a") != F.col("root_b")) & sized & left)
    return met.select(F.greatest("node_a", "node_b").alias("u"), F.least("node_a", "node_b").alias("v"))


def verified_best(pairs: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(u, v) as roots: those joined by the pair of lines whose sketches differ least, if it is similar enough."""
    best = pairs.groupBy("root_u", "root_v").agg(F.min(F.struct("bits", "u", "v")).alias("x")).select("x.u", "x.v", "root_u", "root_v")
    best = materialize(best, "line-best")
    links = verified(best.select("u", "v").distinct(), texts, threshold)
    return best.join(links, ["u", "v"]).select(F.col("root_u").alias("u"), F.col("root_v").alias("v"))


def merged(roots: DataFrame, more: DataFrame) -> DataFrame:
    """(node, root) with the components of roots more (node, root) joined; a node without a row is its own root."""
    new = more.withColumnsRenamed({"node": "old", "root": "new"})
    held = roots.join(new, F.col("root") == F.col("old"), "left").select("node", F.coalesce("new", "root").alias("root"))
    return materialize(held.union(more.join(roots, "node", "left_anti")), "line-roots")


def still_apart(pairs: DataFrame, more: DataFrame) -> DataFrame:
    """The pairs (u, v, root_u, root_v, bits) with new roots, without those of one root."""
    for x in "uv":
        new = more.select(F.col("node").alias(f"root_{x}"), F.col("root").alias("new"))
        pairs = pairs.join(new, f"root_{x}", "left").withColumn(f"root_{x}", F.coalesce("new", f"root_{x}")).drop("new")
    return pairs.filter("root_u <> root_v").select("u", "v", "root_u", "root_v", "bits").distinct()


def line_roots(distinct: DataFrame, docs: DataFrame, wide: bool, threshold: float = THRESHOLD) -> DataFrame:
    """(node, root) of distinct lines (node, n, b1, b2, ...) in components of similar lines: each verified pair that
    shares a band is in one component. Of the pairs between two components the likeliest is verified first, and the
    others only where the components are then still apart."""
    shared = shared_bands(distinct)
    texts = materialize(fetched(shared.select("node").distinct(), docs, wide).select("node", "line"), "line-texts")
    sketch = materialize(sketches(texts), "line-sketches")
    links = verified(materialize(close_pairs(neighbour_pairs(shared), sketch, threshold), "line-pairs"), texts, threshold)
    roots = materialize(connected_components(materialize(links, "line-links"), "line-components"), "line-roots")

    def joined(pairs: DataFrame, roots: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
        links = materialize(links, "line-links")
        if links.isEmpty():
            return pairs, roots
        more = materialize(connected_components(links, "line-components"), "line-more")
        return materialize(still_apart(pairs, more), "line-apart"), merged(roots, more)

    members = materialize(split_bands(shared.filter(F.col("k") > NEIGHBOURS + 1), roots, sketch, threshold), "line-near")
    pairs = materialize(pairs_of_runs(members, threshold).distinct(), "line-pairs")
    pairs, roots = joined(pairs, roots, verified_best(pairs, texts, threshold))
    members = materialize(split_bands(shared.filter(F.col("k") > FULL), roots, sketch, threshold), "line-near")
    if not members.isEmpty():
        pairs = materialize(pairs.union(pairs_of_outsiders(members, texts, threshold)).distinct(), "line-pairs")
    pairs, roots = joined(pairs, roots, verified_best(pairs, texts, threshold))
    left = verified(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), texts, threshold)
    ends = pairs.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b"), "root_u", "root_v")
    left = ends.join(left, (F.col("a") == F.col("u")) & (F.col("b") == F.col("v"))).select(F.col("root_u").alias("u"), F.col("root_v").alias("v"))
    return joined(pairs, roots, left)[1]


def kept_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, line_no) of the lines that stay: the first of each component of equal or similar lines, by doc_id, then
    line number. Lines of white space only are outside the comparison and stay; they are not listed here. Of a text of
    more than LINES lines, those beyond stay too."""
    wide = needs_wide(docs)
    distinct = distinct_lines(docs, wide)
    later = line_roots(distinct, docs, wide, threshold).filter("node <> root").select("node")
    first = distinct.select("node").join(later, "node", "left_anti")
    doc = F.floor(F.col("node") / F.lit(LINES)).cast("long") if wide else F.shiftright("node", 27)
    return first.select(doc.alias("doc_id"), F.pmod("node", F.lit(LINES)).cast("int").alias("line_no"))


def line_decisions(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_lines (those compared) and removed, the numbers of the lines that go; a row per document."""
    keep = materialize(kept_lines(docs, threshold), "line-kept").groupBy("doc_id").agg(F.collect_list("line_no").alias("kept"))
    own = columns_or_null(docs, doc_id="long", text="string")
    numbered = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda line, i: F.when(~blank(line) & (i < LINES), i))
    own = own.select("doc_id", F.array_compact(numbered).alias("lines"))
    none = F.array().cast("array<int>")
    gone = F.when(F.col("doc_id").isNull(), none).otherwise(F.array_except("lines", F.coalesce("kept", none)))
    return own.join(keep, "doc_id", "left").select("doc_id", F.size("lines").alias("n_lines"), gone.alias("removed"))


def dedup_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with columns as before, each text without the lines of which an equal or similar line comes first.

    n_chars, if there, follows the text. Lines of white space only stay where they are. A null text stays null, an
    empty one empty; a text may lose all its lines and is then empty. Rows of one doc_id share its decisions, so with
    repeated rows the same line numbers stay in each. Rows without a doc_id keep their texts. Empty tables give empty
    results; further columns pass through whatever their names."""
    gone = line_decisions(docs, threshold).filter(F.size("removed") > 0).groupBy("doc_id").agg(F.first("removed").alias("removed"))
    # all columns in one, so that no name of theirs meets one of ours
    held = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"))
    joined = held.join(gone, F.col("row.doc_id").cast("long") == F.col("doc_id"), "left")
    rows = F.transform(F.split(F.col("row.text"), "\n"), lambda line, i: F.struct(line.alias("line"), i.alias("i")))
    stays = F.filter(rows, lambda r: ~F.array_contains("removed", r["i"]))
    text = F.when(F.col("removed").isNull(), F.col("row.text")).otherwise(F.array_join(F.transform(stays, lambda r: r["line"]), "\n"))
    joined = joined.select("row", text.alias("text"))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return joined.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per row of documents. A null text has no lines; rows of one doc_id share its decisions; a row without a
    doc_id loses nothing; of equal lines the first by doc_id and number stays; an empty table gives no rows."""
    found = line_decisions(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.size("removed").cast("long").alias("n_removed"), "removed")
