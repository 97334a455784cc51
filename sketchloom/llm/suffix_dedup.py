"""Removal of repeated passages: a depth-limited radix sort of the suffixes of all documents.

Every window of `length` bytes is a suffix cut at the threshold depth. The sort orders these only through that depth,
by digits from the most significant one, and drops what a digit leaves alone; the groups that are equal in all digits
are exactly the repeated windows.

First digit: the window's least 20-byte gram by hash, found in the window itself, so equal windows share it. Adjacent
windows mostly share the gram too, and travel together as one stretch of text (a record). A first pass finds the
grams that two documents share; only their records move. Further digits: the whole record where a gram has only one
(most copies end here), else the windows of its records by eight bytes at a time.

Chunks of documents send each distinct record once with their smallest doc_id, so a passage in a third of all rows
moves once per chunk, and each reply is a bit per window: whether a smaller doc_id elsewhere has it."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .chunks import CHUNK, open_chunk, text_chunks, with_replies
from .common import NULL_ID, batch_rows, bucket_cuts, bucketed, expand, materialize, mix, pack, shuffle_partitions, squeeze, trim, unpack

LENGTH, GRAM = 50, 20
BLOCK = 1 << 17
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _words(data: np.ndarray, dtype: str, n: int) -> np.ndarray:
    """The little-endian numbers that begin at each of the first n bytes."""
    return np.ndarray((n,), dtype, buffer=data, strides=(1,)).astype(np.uint64)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Non-zero hashes of the grams that begin at each byte."""
    n = len(data) - GRAM + 1
    eight = _words(data, "<u8", n + 8)
    h = eight[:n] * _ODD[0]
    h ^= h >> np.uint64(32)
    h += eight[8:]
    h *= _ODD[1]
    h ^= h >> np.uint64(29)
    h += _words(data[16:], "<u4", n)
    h *= _ODD[2]
    h ^= h >> np.uint64(32)
    h *= _ODD[0]
    h |= np.uint64(1)
    return h


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size, m = 1, x
    while 2 * size <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return np.minimum(m[: len(m) - (width - size)], m[width - size :]) if width > size else m


def records(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gram hash, first and last window of each record; windows that share their leftmost least gram, in one text."""
    span = length - GRAM + 1
    out = [[], [], []]
    ends = offsets[1:]
    for a in range(0, max(0, len(data) - length + 1), BLOCK):
        part = data[a : a + BLOCK + length - 1]
        h = gram_hashes(part)
        least = sliding_min(h, span)
        lo, hi = np.searchsorted(ends, [a, a + len(least) + length], "left")
        for e, s in zip(ends[lo : hi + 1].tolist(), offsets[lo : hi + 1].tolist()):
            least[max(e - length + 1, s, a) - a : max(0, e - a)] = 0
        cut = np.flatnonzero(least[1:] != least[:-1]) + 1
        first, last = np.r_[0, cut], np.r_[cut - 1, len(least) - 1]
        value = least[first]
        real = value > 0
        first, last, value = first[real], last[real], value[real]
        for turn in range(3):
            at = np.full(len(first), -1)
            todo = np.arange(len(first))
            for j in range(span):
                hit = h[first[todo] + j] == value[todo]
                at[todo[hit]] = first[todo[hit]] + j
                todo = todo[~hit]
                if not len(todo):
                    break
            upto = np.minimum(last, at)
            # least hashes are small numbers: scrambled again, they spread evenly over buckets
            for o, x in zip(out, (mix(value), first + a, upto + a)):
                o.append(x)
            more = at < last
            if not more.any():
                break
            first, last, value = at[more] + 1, last[more], value[more]
            if turn == 1:  # grams that repeat within one window: each window by itself
                size = last - first + 1
                first = np.repeat(first - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
                last, value = first, np.repeat(value, size)
    if not out[0]:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(out[0]), np.concatenate(out[1]), np.concatenate(out[2])


def _dense(*digits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of rows by the digits, starts of the groups in that order, and each row's group."""
    order = np.lexsort(digits[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for d in digits:
        s = d[order]
        new[1:] |= s[1:] != s[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), group


class Stretches:
    """Candidate records of a chunk: the distinct stretches of text among them, in an order that passes share."""

    def __init__(self, row: dict, length: int):
        self.ids, self.offsets, self.data = open_chunk(row)
        gram, first, last = records(self.data, self.offsets, length)
        keys, where = np.unique(gram, return_inverse=True)
        self.keys = keys
        self.doc = np.searchsorted(self.offsets, first, "right") - 1
        self.gram, self.first, self.last, self.where, self.length = gram, first, last, where, length

    def shared(self) -> np.ndarray:
        """Which of the distinct grams stand in texts of more than one doc_id of this chunk."""
        own = self.ids[self.doc]
        low, high = np.full(len(self.keys), np.iinfo(np.int64).max), np.full(len(self.keys), NULL_ID)
        np.minimum.at(low, self.where, own)
        np.maximum.at(high, self.where, own)
        return low < high

    def choose(self, bits: list[dict] | None) -> None:
        """Keep the records of grams that the replies name and find the distinct stretches."""
        named = np.concatenate([np.zeros(0, bool), *(np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=r["n"]).astype(bool) for r in bits or [])])
        keep = named[self.where]
        self.gram, self.first, self.last, self.doc = self.gram[keep], self.first[keep], self.last[keep], self.doc[keep]
        size = self.last - self.first + self.length
        wide = 2 * self.length - GRAM
        wide += -wide % 8
        text = np.zeros((len(size), wide), np.uint8)
        for i in range(0, len(size), 1 << 16):
            at = self.first[i : i + (1 << 16), None] + np.arange(wide)
            inside = np.arange(wide) < size[i : i + (1 << 16), None]
            text[i : i + (1 << 16)][inside] = self.data[at[inside]]
        order, starts, group = _dense(self.gram, size, *text.view(np.uint64).T)
        self.group = group
        head = order[starts]
        self.u_gram, self.u_size, self.u_text = self.gram[head], size[head], text[head]
        self.u_least = np.minimum.reduceat(self.ids[self.doc][order], starts) if len(order) else np.empty(0, np.int64)


def _name_grams(bucket: int, rows: list[dict]):
    """Reply to each chunk which of its grams two doc_ids share, in whatever chunks."""
    keys = [unpack(r["keys"], np.uint64, delta=True) for r in rows]
    flags = np.concatenate([np.unpackbits(np.frombuffer(r["flags"], np.uint8), count=len(k)) for r, k in zip(rows, keys)])
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")
    every = every[order]
    new = np.r_[True, every[1:] != every[:-1]]
    del every
    starts = np.flatnonzero(new)
    several = (np.diff(np.r_[starts, len(new)]) > 1) | (np.add.reduceat(flags[order], starts, dtype=np.int32) > 0)
    named = np.empty(len(new), bool)
    named[order] = np.repeat(several, np.diff(np.r_[starts, len(new)]))
    out = [{"chunk": r["chunk"], "bucket": bucket, "bits": np.packbits(part).tobytes(), "n": len(part)} for r, part in zip(rows, np.split(named, np.cumsum([len(k) for k in keys])[:-1]))]
    yield pa.RecordBatch.from_pylist(out)


def least_by_window(gram: np.ndarray, size: np.ndarray, text: np.ndarray, least: np.ndarray, length: int) -> np.ndarray:
    """The smallest doc_id that has each window of the given distinct stretches (rows; column: window)."""
    n_windows = size - length + 1
    found = np.repeat(least[:, None], int(n_windows.max(initial=1)), axis=1)
    _, starts, group = _dense(gram)
    mixed = np.flatnonzero(np.bincount(group, minlength=len(starts))[group] > 1)
    count = n_windows[mixed]
    row = np.repeat(mixed, count)
    at = np.arange(len(row)) - np.repeat(np.r_[0, np.cumsum(count)[:-1]], count) if len(row) else np.empty(0, np.int64)
    group, flat, wide = group[row], text.ravel(), text.shape[1]
    for depth in range(0, length, 8):
        # one digit: the next eight bytes of each window that is not alone yet
        width = min(8, length - depth)
        digit = np.zeros((len(row), 8), np.uint8)
        digit[:, :width] = flat[(row * wide + at + depth).astype(np.int32)[:, None] + np.arange(width, dtype=np.int32)]
        order, starts, group = _dense(group, digit.view(np.uint64).ravel())
        alone = np.bincount(group, minlength=len(starts))[group] < 2
        row, at, group = row[~alone], at[~alone], group[~alone]
    if len(row):
        order, starts, group = _dense(group)
        found[row, at] = np.minimum.reduceat(least[row][order], starts)[group]
    return found


#: Stretches of one bucket that are compared at a time; all stretches of a gram stay together.
SLICE = 8_000


def _name_windows(length: int):
    def reduce(bucket: int, rows: list[dict]):
        gram = np.concatenate([unpack(r["keys"], np.uint64, delta=True) for r in rows])
        sizes = [unpack(r["sizes"], np.uint8) for r in rows]
        n_windows, own = np.concatenate(sizes).astype(np.int64) + 1, np.concatenate([unpack(r["ids"], np.int64) for r in rows])
        raw = np.frombuffer(b"".join(expand(r["text"]) for r in rows), np.uint8)
        size = n_windows + length - 1
        start = np.cumsum(size) - size
        wide = 2 * length - GRAM
        wide += -wide % 8
        before = np.zeros((len(gram), int(n_windows.max())), bool)
        by_gram = np.argsort(gram, kind="stable")
        edge = np.flatnonzero(np.diff(gram[by_gram])) + 1
        cuts = [0]
        while cuts[-1] < len(gram):
            k = np.searchsorted(edge, cuts[-1] + SLICE)
            cuts.append(int(edge[k]) if k < len(edge) else len(gram))
        for i, j in zip(cuts, cuts[1:]):
            of = by_gram[i:j]
            inside = np.arange(wide) < size[of, None]
            text = np.zeros((len(of), wide), np.uint8)
            text[inside] = raw[(start[of, None] + np.arange(wide))[inside]]
            order, starts, group = _dense(gram[of], size[of], *text.view(np.uint64).T)
            head = order[starts]
            least = np.minimum.reduceat(own[of][order], starts)
            found = least_by_window(gram[of][head], size[of][head], text[head], least, length)
            before[of, : found.shape[1]] = found[group] < own[of, None]
        real = np.arange(before.shape[1]) < n_windows[:, None]
        i, out = 0, []
        for r, s in zip(rows, sizes):
            bits = before[i : i + len(s)][real[i : i + len(s)]]
            i += len(s)
            out.append({"chunk": r["chunk"], "bucket": bucket, "bits": np.packbits(bits).tobytes(), "n": len(bits)})
        yield pa.RecordBatch.from_pylist(out)

    return reduce


REPLY = "chunk long, bucket long, bits binary, n long"


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep_text: bool = False, chunk: int = CHUNK) -> DataFrame:
    """Remove each byte that a window of `length` bytes covers which also starts in a text of a smaller doc_id.

    doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, and kept (the remaining bytes) on demand.
    Windows never cross texts and are judged on the input. A null text is empty; texts below `length` bytes lose
    nothing; rows of one doc_id do not take from each other; a null doc_id counts as smaller than all others. An empty
    table gives an empty result; further columns are ignored. length: 24 to 255 bytes."""
    if not 24 <= length <= 255:
        raise ValueError("length must be 24 to 255")
    spark = docs.sparkSession
    buckets = shuffle_partitions(spark)
    chunks = text_chunks(docs, chunk)

    def send_grams(batches):
        for row in batch_rows(batches):
            s = Stretches(row, length)
            cuts, flags = bucket_cuts(s.keys, buckets).tolist(), s.shared()
            out = [{"bucket": b, "chunk": row["chunk"], "keys": pack(s.keys[i:j], delta=True), "flags": np.packbits(flags[i:j]).tobytes()} for b, (i, j) in enumerate(zip(cuts, cuts[1:])) if j > i]
            if out:
                yield pa.RecordBatch.from_pylist(out)
            del s, flags
            trim()

    grams = chunks.mapInArrow(send_grams, "bucket long, chunk long, keys binary, flags binary")
    named = materialize(bucketed(grams, "bucket", _name_grams, REPLY), "repeats-grams")

    def send_stretches(batches):
        for row in batch_rows(batches):
            s = Stretches(row, length)
            s.choose(row["r0"])
            cuts, out = bucket_cuts(s.u_gram, buckets).tolist(), []
            for b, (i, j) in enumerate(zip(cuts, cuts[1:])):
                if j > i:
                    text = s.u_text[i:j][np.arange(s.u_text.shape[1]) < s.u_size[i:j, None]]
                    out.append({"bucket": b, "chunk": row["chunk"], "keys": pack(s.u_gram[i:j], delta=True), "sizes": pack((s.u_size[i:j] - length).astype(np.uint8)), "ids": pack(s.u_least[i:j]), "text": squeeze(text.tobytes(), 3)})
            if out:
                yield pa.RecordBatch.from_pylist(out)
            del s
            trim()

    stretches = with_replies(chunks, named).mapInArrow(send_stretches, "bucket long, chunk long, keys binary, sizes binary, ids binary, text binary")
    repeated = materialize(bucketed(stretches, "bucket", _name_windows(length), REPLY), "repeats-windows")

    def finish(batches):
        for row in batch_rows(batches):
            s = Stretches(row, length)
            s.choose(row["r0"])
            bits = np.concatenate([np.zeros(0, bool), *(np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=r["n"]).astype(bool) for r in row["r1"] or [])])
            count = s.u_size - length + 1
            start = np.cumsum(count) - count
            later = s.ids[s.doc] > s.u_least[s.group]
            step = np.zeros(len(s.data) + 1, np.int32)
            for i in range(0, len(s.first), 1 << 15):
                # the windows of some records, and the reply's bit for each
                first, group = s.first[i : i + (1 << 15)], s.group[i : i + (1 << 15)]
                n = s.last[i : i + (1 << 15)] - first + 1
                inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                cut = np.repeat(first, n) + inner
                cut = cut[bits[np.repeat(start[group], n) + inner] | np.repeat(later[i : i + (1 << 15)], n)]
                step[cut] += 1
                np.subtract.at(step, cut + length, 1)
            gone = np.cumsum(step[:-1]) > 0
            total = np.r_[0, np.cumsum(gone, dtype=np.int32)]
            begin = gone.copy()
            begin[1:] &= ~gone[:-1]
            inner = s.offsets[:-1][s.offsets[:-1] < len(gone)]
            begin[inner] = gone[inner]
            spans = np.r_[0, np.cumsum(begin, dtype=np.int32)]
            a, b = s.offsets[:-1], s.offsets[1:]
            kept = [s.data[i:j][~gone[i:j]].tobytes() if total[j] > total[i] else s.data[i:j].tobytes() for i, j in zip(a.tolist(), b.tolist())]
            cols = [pa.array(s.ids, mask=s.ids == NULL_ID), pa.array(b - a), *(pa.array((x[b] - x[a]).astype(np.int64)) for x in (total, spans)), pa.array([hashlib.sha256(k).hexdigest() for k in kept])]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if keep_text:
                cols, names = [*cols, pa.array(kept, pa.binary())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(cols, names)
            trim()

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text
    return with_replies(chunks, named, repeated).mapInArrow(finish, schema)


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 50 bytes over all documents. A null or empty text has 0 bytes and the digest of nothing; repeated rows
    of a doc_id take nothing from each other; an empty table gives no rows; further columns are ignored."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
