"""SimHash near-duplicates: fingerprints of word shingles, linked through a byte-position inverted index."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns_or_null, connected_components, local_components, materialize, shuffle_partitions

#: A pair within MAX_BITS differing bits differs in at most MAX_BITS of 8 bytes, so it shares at least MIN_MATCHES.
MAX_BITS, MIN_MATCHES = 4, 4
#: Postings are keyed by the bytes at so many positions together: single bytes would be 8 x 256 postings, each with a
#: part of the whole that does not shrink as the input grows. Beyond WIDE fingerprints one position more keeps postings short.
TOGETHER, WIDE = 3, 1 << 26
#: Up to so many fingerprints of one posting are compared in blocks; beyond, differing bits are enumerated.
BLOCKWISE = 20_000


def fingerprint(text: bytes, width: int = 4, seed: int = 42) -> int:
    """A bit is set if it is set in over half the XXH64 values of the text's word shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, seed)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes)
    starts = (ends - sizes)[: len(words) - width + 1].tolist()
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(joined[a : b - 1], seed) for a, b in zip(starts, ends[width - 1 :].tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit integer. A null or wordless text has fingerprint 0."""

    def run(batches):
        for b in batches:
            fps = [fingerprint(t or b"", width, seed) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return columns_or_null(docs, doc_id="long", text="binary").mapInArrow(run, "doc_id long, fp long")


def shared_bytes(x: np.ndarray) -> np.ndarray:
    """The number of zero bytes of each exclusive or: the positional bytes that a pair shares."""
    low = np.uint64(0x7F7F7F7F7F7F7F7F)
    return np.bitwise_count(~(((x & low) + low) | x | low))


def posting_links(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that span every group of near fingerprints of one posting (distinct values, some bytes shared): pairs whose
    tally of shared positional bytes reaches MIN_MATCHES are verified by their bits."""
    n = len(fps)
    a, b = [], []
    if n <= BLOCKWISE:
        step = max(1, 2_000_000 // n)
        for i in range(0, n, step):
            x = fps[i : i + step, None] ^ fps[None, :]
            u, v = np.nonzero(shared_bytes(x) >= MIN_MATCHES)
            keep = u + i > v
            u, v = u[keep] + i, v[keep]
            near = np.bitwise_count(fps[u] ^ fps[v]) <= MAX_BITS
            a.append(u[near])
            b.append(v[near])
    else:
        free = [i for i in range(64) if np.any((fps ^ fps[0]) >> np.uint64(i) & np.uint64(1))]
        for k in range(1, MAX_BITS + 1):
            for bits in combinations(free, k):
                other = fps ^ np.uint64(sum(1 << i for i in bits))
                at = np.minimum(np.searchsorted(fps, other), n - 1)
                u = np.flatnonzero((fps[at] == other) & (at < np.arange(n)))
                a.append(u)
                b.append(at[u])
    root = local_components(n, np.concatenate(a), np.concatenate(b))
    member = np.flatnonzero(root != np.arange(n))
    return fps[member], fps[root[member]]


def links(fps: DataFrame) -> DataFrame:
    """(u, v) over distinct fingerprints (fp): links whose closure joins all pairs of MAX_BITS or fewer differing bits.

    Each posting is keyed by TOGETHER byte positions and their bytes. A near pair shares MIN_MATCHES bytes and so meets
    in one posting at least; the tally of all 8 positions tells pairs that share no more than the key from those that
    go on to be verified. Rows stream through a task in posting order; links of one posting span it like a tree, so a
    posting never yields all its pairs."""
    byte = [F.shiftrightunsigned("fp", 8 * i).bitwiseAND(F.lit(255)) for i in range(8)]
    keys = []
    for k, where in enumerate(combinations(range(8), TOGETHER if fps.count() <= WIDE else TOGETHER + 1)):
        key = F.lit(k << 32)
        for j, p in enumerate(where):
            key = key.bitwiseOR(F.shiftleft(byte[p], 8 * j))
        keys.append(key)

    def run(batches):
        rest = [np.empty(0, np.int64), np.empty(0, np.int64)]

        def links_of(keys, fps):
            cut = np.flatnonzero(np.diff(keys)) + 1
            start, end = np.r_[0, cut], np.r_[cut, len(keys)]
            size = end - start
            out = []
            two = start[size == 2]
            x, y = fps[two], fps[two + 1]
            x, y = (z[shared_bytes(x ^ y) >= MIN_MATCHES] for z in (x, y))
            near = np.bitwise_count(x ^ y) <= MAX_BITS
            out.append((np.maximum(x, y)[near], np.minimum(x, y)[near]))
            for s, e in zip(start[size > 2].tolist(), end[size > 2].tolist()):
                out.append(posting_links(np.sort(fps[s:e])))
            u, v = (np.concatenate(z).view(np.int64) for z in zip(*out))
            if len(u):
                both = np.unique(np.stack([u, v], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["u", "v"])

        for b in batches:
            k = np.concatenate([rest[0], b.column(0).to_numpy(zero_copy_only=False)])
            f = np.concatenate([rest[1], b.column(1).to_numpy(zero_copy_only=False)])
            if not len(k):
                continue
            last = np.searchsorted(k, k[-1])
            rest = [k[last:], f[last:]]
            if last:
                yield from links_of(k[:last], f[:last].view(np.uint64))
        if len(rest[0]) > 1:
            yield from links_of(rest[0], rest[1].view(np.uint64))

    postings = fps.select(F.explode(F.array(*keys)).alias("key"), "fp")
    n = shuffle_partitions(fps.sparkSession)
    return postings.repartition(n, "key").sortWithinPartitions("key").mapInArrow(run, "u long, v long")


def simhash_components(docs: DataFrame, width: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id that links of near fingerprints reach.

    Null texts count as empty; empty and wordless texts share fingerprint 0 and link like any other. Equal texts, ties
    and repeated rows share a fingerprint, so a group of copies is one node of the graph. A row without a doc_id keeps
    its fingerprint and takes the component of its fingerprint. An empty table gives an empty result; further columns
    are ignored."""
    marked = materialize(fingerprints(docs, width, seed), "simhash")
    nodes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-nodes")
    roots = connected_components(links(nodes.select("fp")), "simhash-links")
    joined = nodes.join(roots, nodes.fp == roots.node, "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    joined = materialize(joined, "simhash-roots")
    least = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    named = joined.join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_first_of_group(docs: DataFrame) -> DataFrame:
    """The documents of the smallest doc_id of their group; rows without a doc_id stay. Equal doc_ids are one document."""
    keep = simhash_components(docs).filter("doc_id is null or doc_id = component_id").select("doc_id").distinct()
    return docs.join(keep, docs["doc_id"].eqNullSafe(keep["doc_id"]), "left_semi")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, whole texts. Null, empty and wordless texts have fingerprint zero and link like any other; repeated rows
    get a row each; an empty table gives no rows; further columns are ignored."""
    found = simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
