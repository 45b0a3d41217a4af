"""Count-only Viterbi over a unigram vocabulary (operator 6)."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a space, before the word that follows it.
SPACE = "▁"
#: How far an unknown character's score lies below the least score of the vocabulary.
UNKNOWN_PENALTY = 10.0
MEMORY, REMEMBERED_CHARS, SLICE = 300_000, 64, 256


def load(path: str) -> tuple[list[tuple[str, float]], bool]:
    """The pieces of a vocabulary file with their scores, and whether it has a piece for each byte."""
    held = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(held.get_piece_size())
    pieces = [(held.id_to_piece(i), float(held.get_score(i))) for i in ids if not (held.is_control(i) or held.is_unknown(i) or held.is_byte(i))]
    return pieces, sum(held.is_byte(i) for i in ids) == 256


class Counter:
    """Number of pieces in the best segmentation of a text.

    A text's spaces become SPACE, one is put before it if it doesn't begin with one, and each run from a SPACE up
    to the next is segmented by itself. Of a run's segmentations into pieces the one with the highest sum of
    scores counts. Scores are added from left to right in double precision; of segmentations that end at the same
    place with equal scores, the one found first stays, that is the one whose last piece is longest. A character that is no
    piece may stand alone at the least score of all less UNKNOWN_PENALTY; it counts as its UTF-8 bytes if the vocabulary
    has a piece for each byte, else a run of such characters counts as one.
    """

    def __init__(self, pieces: list[tuple[str, float]], bytes_too: bool):
        self.bytes_too = bytes_too
        self.unknown = min((score for _, score in pieces), default=0.0) - UNKNOWN_PENALTY
        self.single = {piece for piece, _ in pieces if len(piece) == 1}
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece and not self.automaton.exists(piece):  # the first of equal pieces counts
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.recent: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def run(self, text: str) -> int:
        """Best score, pieces and whether the last is unknown, for each place; only the last is of interest."""
        n = len(text)
        score: list[float | None] = [0.0] + [None] * n
        count, strange = [0] * (n + 1), [False] * (n + 1)
        matches = iter(self.automaton.iter(text)) if len(self.automaton) else iter(())
        match = next(matches, None)
        for end in range(1, n + 1):
            best = None
            while match is not None and match[0] == end - 1:  # the longest piece that ends here comes first
                length, own = match[1]
                total = score[end - length] + own
                if best is None or total > best:
                    best, pieces = total, count[end - length] + 1
                match = next(matches, None)
            unknown = False
            if text[end - 1] not in self.single:
                total = score[end - 1] + self.unknown
                if best is None or total > best:
                    best, unknown = total, True
                    if self.bytes_too:
                        pieces = count[end - 1] + len(text[end - 1].encode("utf-8", "surrogatepass"))
                    else:
                        pieces = count[end - 1] + (not strange[end - 1])
            score[end], count[end], strange[end] = best, pieces, unknown
        return count[n]

    def _word(self, run: str) -> int:
        if (found := self.older.get(run)) is None:
            found = self.run(SPACE + run)
            if len(run) > REMEMBERED_CHARS:
                return found
        if len(self.recent) >= MEMORY:
            self.older, self.recent = self.recent, {}
        self.recent[run] = found
        return found

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        text = text.replace(SPACE, " ")
        runs = (text[1:] if text[0] == " " else text).split(" ")
        known = self.recent.get
        total = 0
        for run in runs:
            found = known(run)
            total += self._word(run) if found is None else found
        return total


_counters: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """``docs`` (doc_id, text, any other columns) to one row per row: doc_id, n_tokens.

    Whole texts are counted. Null and empty texts have no tokens; a null doc_id stays null; repeated rows get equal
    counts; other columns are ignored. Rows are independent: nothing is shuffled. What is sent to tasks is the vocabulary,
    whose size doesn't depend on the corpus.
    """
    if vocabulary_path is None:
        import public_tokenizers

        vocabulary_path = public_tokenizers.path("piece_bpe_32k.model")
    sent = docs.sparkSession.sparkContext.broadcast(load(vocabulary_path))
    name = str(vocabulary_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _counters:
            _counters.clear()
            _counters[name] = Counter(*sent.value)
        counter = _counters[name]
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([counter.count(t) for t in part.column(1).to_pylist()], pa.int64())], ["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op6_token_counts": op6_token_counts}
ORACLES: dict[str, str] = {}
