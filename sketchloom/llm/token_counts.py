"""Token counts of a unigram tokenizer, without its tokens: Aho-Corasick matches and count-only Viterbi."""

from __future__ import annotations

import os

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import columns_or_null

#: Where the vocabularies of public tokenizers are, unless a path is given.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
SPACE = "▁"
#: How far an unknown character scores below the least piece.
UNKNOWN = 10.0


def load_vocabulary(path: str | None = None) -> list[tuple[str, float]]:
    """Pieces and scores, by id, of a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or f"{TOKENIZERS}/piece_bpe_32k.model")
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter(dict):
    """Tokens of each segment (a space mark and what follows it), found once and then remembered.

    The tie rules are those of the Unigram model of the tokenizers library: a later start replaces the best path to a
    place only if its score is higher, so of equal paths the one whose last piece is longest stays; a character that
    is no piece is one unknown step, UNKNOWN below the least score, and counts as its UTF-8 bytes. Memory is bounded:
    the segments remembered are forgotten at `most`; that changes no count."""

    def __init__(self, vocabulary: list[tuple[str, float]], most: int = 300_000):
        super().__init__()
        self.automaton, self.most = ahocorasick.Automaton(), most
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN
        #: Where no piece holds a line end, paths never cross it, and what is between is remembered by itself.
        self.lines = not any("\n" in p for p, _ in vocabulary)
        if any(SPACE in p.lstrip(SPACE) for p, _ in vocabulary):
            raise ValueError("a piece of the vocabulary crosses a space")

    def __missing__(self, segment: str) -> int:
        if self.lines and "\n" in segment and len(segment) > 1:
            parts = segment.split("\n")
            return sum(self[p] for p in parts if p) + (len(parts) - 1) * self["\n"]
        if len(self) >= self.most:
            self.clear()
        n = self.viterbi(segment)
        if len(segment) < 64:
            self[segment] = n
        return n

    def viterbi(self, s: str) -> int:
        """Pieces on the best path through s."""
        n = len(s)
        score, count = [0.0] * (n + 1), [0] * (n + 1)
        at, found, single = 0, False, False
        unknown = self.unknown
        for end, (size, value) in self.automaton.iter(s):
            while at < end:  # places before this one are complete
                if not single and (not found or score[at] + unknown > score[at + 1]):
                    score[at + 1], count[at + 1] = score[at] + unknown, count[at] + len(s[at].encode())
                at, found, single = at + 1, False, False
            start = end + 1 - size
            new = score[start] + value
            if not found or new > score[end + 1]:
                score[end + 1], count[end + 1], found = new, count[start] + 1, True
            single = single or size == 1
        while at < n:
            if not single and (not found or score[at] + unknown > score[at + 1]):
                score[at + 1], count[at + 1] = score[at] + unknown, count[at] + len(s[at].encode())
            at, found, single = at + 1, False, False
        return count[n]

    def tokens(self, text: str) -> int:
        if not text:
            return 0
        marked = text.replace(" ", SPACE)
        if marked[0] != SPACE:
            marked = SPACE + marked
        if self.lines:
            first, *rest = marked.split(SPACE)
            return sum(map(self.__getitem__, [SPACE + w for w in rest]))
        return sum(map(self.__getitem__, [SPACE + w for w in marked.split(SPACE)[1:]]))


def token_counts(docs: DataFrame, vocabulary: list[tuple[str, float]] | None = None, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens) of each whole text. A null or empty text has none; equal rows count alike; long texts are
    cut only at spaces, which no piece crosses. An empty table gives an empty result; further columns are ignored.

    The vocabulary (bounded: a tokenizer's) is read once on the driver and travels with the tasks."""
    pieces = vocabulary or load_vocabulary(path)

    def run(batches):
        counter = Counter(pieces)
        for b in batches:
            n = [counter.tokens((t or b"").decode("utf-8", "replace")) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return columns_or_null(docs, doc_id="long", text="binary").mapInArrow(run, "doc_id long, n_tokens long")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, whole texts. A null or empty text has no tokens; repeated rows count alike; an empty table gives no
    rows; further columns are ignored."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
