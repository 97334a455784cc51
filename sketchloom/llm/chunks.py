"""Documents packed into chunks: rows of a table that several passes read alike, so their replies line up."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_or_null, expand, materialize_bucketed, pack, shuffle_partitions, squeeze, text_groups, unpack

#: Bytes of text in a chunk. A longer text is a chunk of its own. A pass sends a row per chunk and bucket, so larger
#: executors do well with larger chunks; at 1 MB a pass over a chunk takes some 100 MB of a worker.
CHUNK = 1 << 20
SCHEMA = "chunk long, ids binary, lens binary, data binary"


def chunk_numbers():
    """Numbers that no other task gives; a repeated attempt of a task gives the same ones."""
    at = TaskContext.get().partitionId() << 32
    while True:
        yield at
        at += 1


def text_chunks(docs: DataFrame, size: int = CHUNK) -> DataFrame:
    """Rows (chunk, ids, lens, data) of about `size` bytes of text each, stored once in the shared folder."""

    def run(batches):
        for number, (ids, texts) in zip(chunk_numbers(), text_groups(batches, size)):
            lens = np.fromiter(map(len, texts), np.int64, len(texts))
            yield pa.RecordBatch.from_pylist([{"chunk": number, "ids": pack(ids), "lens": pack(lens), "data": squeeze(b"".join(texts))}])

    made = columns_or_null(docs, doc_id="long", text="binary").mapInArrow(run, SCHEMA)
    return materialize_bucketed(made, "chunks", "chunk", shuffle_partitions(docs.sparkSession))


def open_chunk(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, offsets (one more than ids) and bytes of a chunk."""
    lens = unpack(row["lens"], np.int64)
    return unpack(row["ids"], np.int64), np.r_[0, np.cumsum(lens)], np.frombuffer(expand(row["data"]), np.uint8)


def with_replies(chunks: DataFrame, *replies: DataFrame) -> DataFrame:
    """Each chunk with what each of the replies (chunk, bucket, ...) says to it, as arrays r0, r1, ... by bucket."""
    for k, r in enumerate(replies):
        rest = [c for c in r.columns if c != "chunk"]
        own = r.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct(*rest))).alias(f"r{k}"))
        chunks = chunks.join(own, "chunk", "left")
    return chunks
