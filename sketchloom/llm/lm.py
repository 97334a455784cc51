"""Deleted-interpolation language model: bigram, unigram and uniform estimates mixed by context frequency.

Counts of all training texts are gathered by key range. Chunks of documents send each distinct word or word pair once,
packed, and get its counts back in the same order; nothing that grows with the corpus is broadcast. The mixture
weights of each bucket of context counts come from expectation-maximisation on the counts of a held-out fold of the
training texts, against estimates from which that fold is deleted; the final model takes all training counts."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import CHUNK, chunk_numbers, with_replies
from .common import NULL_ID, batch_rows, bucket_cuts, bucketed, columns_or_null, materialize, materialize_bucketed, mix, pack, shuffle_partitions, text_groups, trim, unpack

#: doc_ids whose crc32 modulo FOLDS is TEST are scored only; those of fold DELETED are held out while weights are learned.
FOLDS, TEST, DELETED = 7, 2, 3
END, BEGIN = np.uint64(0), np.uint64(1)
#: Buckets of context counts: 0, then one per power of two.
BUCKETS = 40
ROUNDS = 12
CHUNKS = "chunk long, ids binary, lens binary, fold binary, words binary, tokens binary, train binary, deleted binary"


def folds(ids: np.ndarray) -> np.ndarray:
    return np.array([zlib.crc32(b"" if i == NULL_ID else str(i).encode()) % FOLDS for i in ids.tolist()], np.uint8)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys of the distinct tokens, the tokens as places among them, tokens of each text; each text ends with END."""
    lowered = [t.lower() for t in texts]
    joined = pa.array([t + b" " for t in lowered], pa.binary()).view(pa.string()) if lowered else pa.array([], pa.string())
    split = pc.ascii_split_whitespace(joined)
    at = np.asarray(split.offsets).astype(np.int64)
    flat = split.flatten()
    real = np.asarray(pc.binary_length(flat.view(pa.binary()))) > 0
    coded = flat.dictionary_encode()
    digest = xxhash.xxh64_intdigest
    keys = np.array([digest(w) for w in coded.dictionary.view(pa.binary()).to_pylist()], np.uint64)
    keys[keys < 2] += np.uint64(2)
    code = np.asarray(coded.indices)[real]
    count = np.diff(np.r_[0, np.cumsum(real)][at])
    lens = count + 1
    out = np.zeros(int(lens.sum()), np.int64)
    is_end = np.zeros(len(out), bool)
    is_end[np.cumsum(lens) - 1] = True
    out[~is_end] = code + 1
    all_keys = np.r_[np.array([END], np.uint64), keys]
    used = np.bincount(out, minlength=len(all_keys)) > 0
    words, place = np.unique(all_keys[used], return_inverse=True)
    back = np.zeros(len(all_keys), np.int32)
    back[used] = place
    return words, back[out], lens


def token_chunks(docs: DataFrame, size: int = CHUNK) -> DataFrame:
    """Chunks of tokenized documents, stored once in the shared folder."""

    def run(batches):
        for number, (ids, texts) in zip(chunk_numbers(), text_groups(batches, size)):
            words, token, lens = tokens(texts)
            fold = folds(ids)
            at = np.repeat(fold, lens)
            train = np.bincount(token[at != TEST], minlength=len(words)).astype(np.uint32)
            deleted = np.bincount(token[at == DELETED], minlength=len(words)).astype(np.uint32)
            yield pa.RecordBatch.from_pylist([{"chunk": number, "ids": pack(ids), "lens": pack(lens), "fold": pack(fold), "words": pack(words, delta=True), "tokens": pack(token.astype(np.uint32)), "train": pack(train), "deleted": pack(deleted)}])

    made = columns_or_null(docs, doc_id="long", text="binary").mapInArrow(run, CHUNKS)
    return materialize_bucketed(made, "tokens", "chunk", shuffle_partitions(docs.sparkSession))


SENT = "bucket long, chunk long, keys binary, train binary, deleted binary"
REPLY = "chunk long, bucket long, train binary, deleted binary, n_train long, v_train long, n_deleted long, v_kept long"


def sent(chunk: int, keys: np.ndarray, train: np.ndarray, deleted: np.ndarray, buckets: int):
    """What a chunk sends: its sorted keys and their counts, by bucket of key range."""
    cuts = bucket_cuts(keys, buckets).tolist()
    out = [{"bucket": b, "chunk": chunk, "keys": pack(keys[i:j], delta=True), "train": pack(train[i:j].astype(np.uint32)), "deleted": pack(deleted[i:j].astype(np.uint32))} for b, (i, j) in enumerate(zip(cuts, cuts[1:])) if j > i]
    if out:
        yield pa.RecordBatch.from_pylist(out)
    trim()


def _count(bucket: int, rows: list[dict]):
    """Sum the counts of each key over all chunks and reply to each chunk in its own order; the first reply has totals."""
    keys = [unpack(r["keys"], np.uint64, delta=True) for r in rows]
    distinct, where = np.unique(np.concatenate(keys), return_inverse=True)
    sums = [np.bincount(where, np.concatenate([unpack(r[c], np.uint32) for r in rows]), len(distinct)).astype(np.uint64) for c in ("train", "deleted")]
    total, cut = sums
    cuts, out, none = np.cumsum([len(k) for k in keys])[:-1], [], dict.fromkeys(("n_train", "v_train", "n_deleted", "v_kept"), 0)
    told = {"n_train": int(total.sum()), "v_train": int((total > 0).sum()), "n_deleted": int(cut.sum()), "v_kept": int((total > cut).sum())}
    for i, (r, w) in enumerate(zip(rows, np.split(where, cuts))):
        out.append({"chunk": r["chunk"], "bucket": bucket, "train": pack(total[w]), "deleted": pack(cut[w])} | (none if i else told))
    yield pa.RecordBatch.from_pylist(out)


def replied(rows: list[dict] | None) -> tuple[np.ndarray, np.ndarray]:
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate([unpack(r[c], np.uint64) for r in rows]).astype(np.int64) for c in ("train", "deleted"))


class Pairs:
    """Word pairs of a chunk: sorted keys, each token's place among them, and the words of each pair."""

    def __init__(self, row: dict):
        self.words, self.token = unpack(row["words"], np.uint64, delta=True), unpack(row["tokens"], np.uint32).astype(np.int64)
        self.ids, self.lens, self.fold = unpack(row["ids"], np.int64), unpack(row["lens"], np.int64), unpack(row["fold"], np.uint8)
        n = len(self.words)
        context = np.r_[n, self.token[:-1]]
        starts = np.r_[0, np.cumsum(self.lens)[:-1]]
        context[starts] = n
        local, where = np.unique(context * (n + 1) + self.token, return_inverse=True)
        self.h, self.w = local // (n + 1), local % (n + 1)
        keys = mix(mix(np.r_[self.words, BEGIN][self.h]) + self.words[self.w])
        order = np.argsort(keys, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.keys, self.h, self.w, self.where = keys[order], self.h[order], self.w[order], rank[where]
        self.fold_of = np.repeat(self.fold, self.lens)

    def counts(self, keep: np.ndarray) -> np.ndarray:
        return np.bincount(self.where[keep], minlength=len(self.keys))


def context_counts(counts: np.ndarray, n_docs: int) -> np.ndarray:
    """How often each word is a context: every word is followed by a token; BEGIN, the last, opens each text; END never is."""
    return np.r_[counts, n_docs]


def context_bucket(count: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(count.astype(float))[1], BUCKETS - 1)


def learn_weights(events: DataFrame, kept: int, uniform: float, rounds: int = ROUNDS) -> np.ndarray:
    """Weights (BUCKETS, 3) of the bigram, unigram and uniform estimates, by expectation-maximisation on held-out events
    (pair, context and word counts without the deleted fold, and the times n that the event is seen in it)."""
    weights = np.tile([0.4, 0.5, 0.1], (BUCKETS, 1))
    weights[0] = [0, 0.9, 0.1]
    bucket = F.least(F.when(F.col("h") > 0, F.floor(F.log2(F.col("h").cast("double"))) + 1).otherwise(0), F.lit(BUCKETS - 1)).cast("int")
    table = materialize(events.groupBy("hw", "h", "w").agg(F.sum("n").cast("double").alias("n")).withColumn("b", bucket), "lm-events")
    p2 = F.when(F.col("h") > 0, F.col("hw") / F.col("h")).otherwise(F.lit(0.0))
    p1 = F.col("w") / F.lit(float(max(kept, 1)))
    for _ in range(rounds):
        l2, l1, l0 = (F.element_at(F.array(*(F.lit(float(x)) for x in weights[:, k])), F.col("b") + 1) for k in range(3))
        parts = table.select("b", "n", (l2 * p2).alias("a2"), (l1 * p1).alias("a1"), (l0 * F.lit(uniform)).alias("a0"))
        share = [F.sum(F.col("n") * F.col(c) / (F.col("a2") + F.col("a1") + F.col("a0"))).alias(c) for c in ("a2", "a1", "a0")]
        for r in parts.groupBy("b").agg(*share).collect():
            total = r.a2 + r.a1 + r.a0
            # a little of the prior keeps every estimate of a bucket in play
            weights[r.b] = (np.array([r.a2 if r.b else 0, r.a1, r.a0]) + [1e-3 * (r.b > 0), 1e-3, 1e-3]) / (total + 2e-3 + 1e-3 * (r.b > 0))
    return weights


def score_documents(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; one row per document.

    Learns from the documents whose fold is not TEST. Tokens are lower-cased words and one end per text, so a null or
    empty text is one end. score: log10 probability under the mixture; base_score: add-one unigrams. A null doc_id
    takes the fold of an empty string. Repeated rows count each; without training texts every count is 0; an empty
    table gives an empty result; further columns are ignored."""
    buckets = shuffle_partitions(docs.sparkSession)
    chunks = token_chunks(docs, chunk)

    def send_words(batches):
        for r in batch_rows(batches):
            yield from sent(r["chunk"], unpack(r["words"], np.uint64, delta=True), unpack(r["train"], np.uint32), unpack(r["deleted"], np.uint32), buckets)

    words = chunks.select("chunk", "words", "train", "deleted").mapInArrow(send_words, SENT)
    word_counts = materialize(bucketed(words, "bucket", _count, REPLY), "lm-words")
    totals = word_counts.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n_train", "v_train", "n_deleted", "v_kept"))).first()
    n_train, v_train, n_deleted, v_kept = map(int, totals)
    word_counts = word_counts.select("chunk", "bucket", "train", "deleted")

    def send_pairs(batches):
        for r in batch_rows(batches):
            p = Pairs(r)
            yield from sent(r["chunk"], p.keys, p.counts(p.fold_of != TEST), p.counts(p.fold_of == DELETED), buckets)

    pairs = chunks.mapInArrow(send_pairs, SENT)
    pair_counts = materialize(bucketed(pairs, "bucket", _count, REPLY).select("chunk", "bucket", "train", "deleted"), "lm-pairs")
    told = with_replies(chunks, word_counts, pair_counts)
    # texts that a count of END stands for
    ends = docs_by_fold(chunks)

    def held_out(batches):
        for r in batch_rows(batches):
            p = Pairs(r)
            n = p.counts(p.fold_of == DELETED)
            use = np.flatnonzero(n)
            (w, wd), (hw, hwd) = replied(r["r0"]), replied(r["r1"])
            h = context_counts(w - wd, ends[0] - ends[1])
            event = np.stack([(hw - hwd)[use], h[p.h[use]], (w - wd)[p.w[use]]], axis=1)
            if len(event):
                kinds, where = np.unique(event, axis=0, return_inverse=True)
                times = np.bincount(where.ravel(), n[use]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*(pa.array(kinds[:, k]) for k in range(3)), pa.array(times)], ["hw", "h", "w", "n"])

    weights = learn_weights(told.mapInArrow(held_out, "hw long, h long, w long, n long"), n_train - n_deleted, 1 / (v_kept + 1))

    def finish(batches):
        for r in batch_rows(batches):
            p = Pairs(r)
            (w, _), (hw, _) = replied(r["r0"]), replied(r["r1"])
            h = context_counts(w, ends[0])[p.h]
            mixed = weights[context_bucket(h)]
            p2 = np.where(h > 0, hw / np.maximum(h, 1), 0)
            p1 = w[p.w] / max(n_train, 1)
            chance = np.log10(mixed[:, 0] * p2 + mixed[:, 1] * p1 + mixed[:, 2] / (v_train + 1))
            starts = np.r_[0, np.cumsum(p.lens)[:-1]]
            base = np.log10((w + 1) / (n_train + v_train + 1))
            sums = [np.add.reduceat(x, starts) if len(starts) else x for x in (base[p.token], chance[p.where], (w > 0)[p.token].astype(np.int64))]
            cols = [pa.array(p.ids, mask=p.ids == NULL_ID), pa.array(p.fold == TEST), pa.array(p.lens), pa.array(sums[2]), pa.array(np.full(len(p.ids), n_train)), pa.array(sums[0]), pa.array(sums[1])]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return told.mapInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def docs_by_fold(chunks: DataFrame) -> tuple[int, int]:
    """Texts in training, and those of them in the deleted fold."""

    def run(batches):
        for r in batch_rows(batches):
            fold = unpack(r["fold"], np.uint8)
            yield pa.RecordBatch.from_pylist([{"train": int((fold != TEST).sum()), "deleted": int((fold == DELETED).sum())}])

    r = chunks.select("fold").mapInArrow(run, "train long, deleted long").agg(F.sum("train"), F.sum("deleted")).first()
    return int(r[0] or 0), int(r[1] or 0)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, whole texts. A null or empty text is one end; repeated rows count each; a null doc_id takes the fold of
    an empty string; an empty table gives no rows; further columns are ignored. Words and pairs are told apart by 64-bit hashes."""
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
