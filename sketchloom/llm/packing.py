"""Best-fit packing of documents into sequences of several permitted lengths."""

from __future__ import annotations

from bisect import bisect_left, insort
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns_or_null, materialize

CAPACITIES = (512, 1024, 2048, 4096, 8192)
#: What a sequence costs beside its length, in tokens.
OVERHEAD = 32
#: Pieces that one task packs together.
SHARD = 65_536


def pack_lengths(lengths: np.ndarray, capacities=CAPACITIES, overhead: int = OVERHEAD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, offset in the bin and capacity of the bin of each length (all positive, none above the largest capacity).

    Pieces go from the longest to the shortest, equal ones in their order. Each goes to the open bin with the least room
    that holds it, of several the one opened first. Where none holds it, a bin is opened: of the permitted capacities
    the one of least cost (capacity and overhead) for each token that it can expect to hold, the smaller on a tie. It
    can expect the piece and, for the room beside it, the later pieces that fit there, less what the bins that are open
    have room for. Every bin ends at the least capacity that holds its contents."""
    caps = sorted(capacities)
    order = np.lexsort((-np.arange(len(lengths)), lengths))
    ascending = lengths[order]
    mass = np.r_[0, np.cumsum(ascending)].tolist()
    fitting = {r: int(np.searchsorted(ascending, r, side="right")) for c in caps for r in (c - np.unique(ascending)).tolist()}
    bins, offsets = (np.zeros(len(lengths), np.int64) for _ in range(2))
    used: list[int] = []
    rooms: list[int] = []  # distinct rooms of open bins, ascending
    at_room: dict[int, list[int]] = {}
    open_room = 0
    for i in range(len(lengths) - 1, -1, -1):
        x, row = int(ascending[i]), order[i]
        k = bisect_left(rooms, x)
        if k < len(rooms):
            room = rooms[k]
            number = heappop(at_room[room])
            if not at_room[room]:
                del at_room[room], rooms[k]
            open_room -= room
        else:
            best = None
            for c in caps[bisect_left(caps, x) :]:
                more = max(0, mass[min(i, fitting[c - x])] - open_room)
                cost = (c + overhead) / (x + min(c - x, more))
                if best is None or cost < best[0]:
                    best = cost, c
            number, room = len(used), best[1]
            used.append(0)
        bins[row], offsets[row] = number, used[number]
        used[number] += x
        room -= x
        open_room += room
        if room:
            if room not in at_room:
                insort(rooms, room)
                at_room[room] = []
            heappush(at_room[room], number)
    final = np.array(caps, np.int64)[np.searchsorted(caps, used)] if used else np.empty(0, np.int64)
    return bins, offsets, final[bins]


def word_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, n): words of each whole text, a null text having none."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len((t or b"").split()) for t in b.column(1).to_pylist()], pa.int64())], ["doc_id", "n"]
            )

    return columns_or_null(docs, doc_id="long", text="binary").mapInArrow(run, "doc_id long, n long")


def best_fit_packing(lengths: DataFrame, capacities=CAPACITIES, overhead: int = OVERHEAD, shard: int = SHARD) -> DataFrame:
    """Pack (doc_id, n) into bins: doc_id, piece, start, n_tokens, bin_id, bin_offset, bin_capacity.

    A text longer than the largest capacity is cut into pieces of it, none dropped. Texts without tokens get one row
    without a bin. Only ids and lengths move; they are dealt by hash into shards of about `shard` pieces, each packed
    on its own, so at most a few bins per shard are less full than global packing would leave them. Ties between equal
    lengths go by doc_id, nulls first. Equal rows are packed each; an empty table gives an empty result."""
    most = max(capacities)
    known = materialize(lengths.select("doc_id", F.greatest(F.coalesce("n", F.lit(0)), F.lit(0)).cast("long").alias("n")), "packing")
    pieces = known.select("doc_id", "n", F.explode(F.sequence(F.lit(0), F.greatest(F.expr(f"(n - 1) div {most}"), F.lit(0)))).alias("piece"))
    pieces = pieces.select("doc_id", F.col("piece").cast("int").alias("piece"), (F.col("piece") * most).alias("start"), F.least(F.col("n") - F.col("piece") * most, F.lit(most)).alias("n_tokens"))
    total = known.agg(F.sum(F.expr(f"greatest(n - 1, 0) div {most} + 1"))).first()[0] or 0
    shards = max(1, -(-int(total) // shard))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)))

    def run(key, table):
        table = table.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("n_tokens", "ascending")])
        n = table["n_tokens"].to_numpy()
        full = np.flatnonzero(n > 0)
        ids, offset, size = (np.zeros(len(n), np.int64) for _ in range(3))
        if len(full):
            ids[full], offset[full], size[full] = pack_lengths(n[full], capacities, overhead)
        none = n == 0
        cols = [table[c] for c in ("doc_id", "piece", "start", "n_tokens")]
        cols += [pa.array((key[0].as_py() << 32) + ids, mask=none), pa.array(offset, mask=none), pa.array(size.astype(np.int32), mask=none)]
        return pa.table(cols, names=["doc_id", "piece", "start", "n_tokens", "bin_id", "bin_offset", "bin_capacity"])

    schema = "doc_id long, piece int, start long, n_tokens long, bin_id long, bin_offset long, bin_capacity int"
    return dealt.groupBy("shard").applyInArrow(run, schema)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by words. Null and empty texts get one row without a bin, long ones are cut into pieces; ties go by
    doc_id; repeated rows are packed each; an empty table gives no rows; further columns are ignored."""
    return best_fit_packing(word_counts(spark.read.parquet(f"{sf_dir}/documents.parquet")))
