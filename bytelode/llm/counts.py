"""Token counts of a unigram tokenizer without its tokens.

An Aho-Corasick automaton lists all vocabulary pieces in a word, by their ends, longest first. Dynamic
programming keeps for each end the best score and the number of pieces on its path. The rules are those
of the tokenizers library's unigram model: a piece replaces an earlier one only if its path scores
more, so of equal paths the one with the longest last piece stays; a character that is no piece costs
the vocabulary's least score less 10, and unknown characters in a row are one piece.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SPACE = "▁"
UNKNOWN_COST = 10.0
#: Words whose counts a worker remembers at most, and their longest.
REMEMBERED, LONGEST = 800_000, 64


def unigram_vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, log-probability) of a SentencePiece file's ordinary pieces after the unknown piece, which
    is the first. Files of merges give ranks for scores; a rank's probability follows Zipf's law."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    weights = [1 / (2.7 - model.get_score(i)) for i in ids]
    total = math.log(sum(weights))
    return [(model.id_to_piece(model.unk_id()), 0.0), *((model.id_to_piece(i), math.log(w) - total) for i, w in zip(ids, weights))]


class Counter:
    """Counts pieces of words under a vocabulary whose first piece is the unknown one."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for at, (piece, score) in enumerate(vocabulary):
            self.automaton.add_word(piece, (len(piece), score, at == 0))
        self.automaton.make_automaton()
        self.longest = max(len(piece) for piece, _ in vocabulary)
        self.unknown = min(score for _, score in vocabulary) - UNKNOWN_COST
        self.known: dict[bytes, int] = {}

    def pieces(self, text: str) -> int:
        """The number of pieces of one word, its leading space sign included.

        Only the last ends that a piece can reach back to are remembered, however long the word is.
        """
        n = len(text)
        ring = min(n, self.longest) + 1
        score, count, odd = [0.0] * ring, [0] * ring, [False] * ring
        matches = self.automaton.iter(text)
        at = next(matches, None)
        for end in range(1, n + 1):
            top, pieces, last, single = None, 0, False, False
            while at is not None and at[0] < end:
                length, own, unknown = at[1]
                start = (end - length) % ring
                if top is None or own + score[start] > top:
                    top, pieces, last = own + score[start], count[start] + (not (unknown and odd[start])), unknown
                single = length == 1
                at = next(matches, None)
            if not single:
                start = (end - 1) % ring
                if top is None or self.unknown + score[start] > top:
                    top, pieces, last = self.unknown + score[start], count[start] + (not odd[start]), True
            here = end % ring
            score[here], count[here], odd[here] = top, pieces, last
        return count[n % ring]

    def words(self, text: bytes) -> list[int]:
        """The number of pieces of each word between ASCII white space."""
        known, out = self.known, []
        for word in text.split():
            n = known.get(word)
            if n is None:
                n = self.pieces(SPACE + word.decode("utf-8", "replace"))
                if len(word) <= LONGEST:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[word] = n
            out.append(n)
        return out


_counters: dict[str, Counter] = {}


def _count_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _counters:
            _counters[path] = Counter(unigram_vocabulary(path))
        counter = _counters[path]
        for batch in batches:
            found = [counter.words(t.as_py() or b"") for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in found], pa.int64()), pa.array([sum(x) for x in found], pa.int64())], ["id", "n_words", "n_tokens"])

    return run


def token_counts(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_tokens) for every row, over its whole text.

    A word is a run of characters other than ASCII white space, with the space sign before it; nothing
    is normalised; bytes that are no UTF-8 count as replacement characters. Null, empty and blank texts have none. Repeated rows stay rows. An empty table gives no
    rows; other columns are not read.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_count_batches(path), "id long, n_words long, n_tokens long").withColumnRenamed("id", id_col)


def op7_viterbi_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
