"""Token counts by a count-only Viterbi over a unigram vocabulary.

Words are what follows each space, with the space written as U+2581 before it
(a text that doesn't start with a space gets one); a U+2581 in the text counts
as a space.  An Aho-Corasick automaton
enumerates the vocabulary's matches that end at each character; dynamic
programming keeps, per character, the best score and the number of pieces of
the path that has it, no path itself.

Tie rules are those of the public ``tokenizers`` library: matches are tried
from the earliest start on, and a later one wins only with a greater score.  A
character that no piece of its own covers may be unknown, at 10 less than the
least score; with byte fallback it counts a piece for each UTF-8 byte, else a
run of unknown characters counts one.

Words repeat, so each worker keeps results for words of up to ``LONGEST``
characters, ``KEPT`` at most (then it starts anew).

Defined results: null texts are empty; an empty text has no pieces and score
0.  Every row of the table gives one row; columns other than the id and the
text aren't read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import env_path, ready, table, text_or_empty

KEPT = 800_000
LONGEST = 64
PENALTY = 10.0
SPACE = "▁"
MODEL = "piece_bpe_32k.model"
_MADE: dict = {}


class Unigram:
    """Counts pieces under a vocabulary of (piece, score)."""

    def __init__(self, vocab: list[tuple[str, float]], byte_fallback: bool = True):
        import ahocorasick

        self.auto = ahocorasick.Automaton()
        for piece, score in vocab:
            if piece:
                self.auto.add_word(piece, (len(piece), score))
        self.auto.make_automaton()
        self.unknown = min(s for _, s in vocab) - PENALTY
        self.bytes = byte_fallback and {f"<0x{b:02X}>" for b in range(256)} <= {p for p, _ in vocab}
        self.alone = frozenset(p for p, _ in vocab if len(p) == 1)
        self.kept: dict[str, tuple[int, float]] = {}

    def word(self, w: str) -> tuple[int, float]:
        """Of a word, without the space before it."""
        if (got := self.kept.get(w)) is not None:
            return got
        got = self._best(SPACE + w)
        if len(w) <= LONGEST:
            if len(self.kept) >= KEPT:
                self.kept.clear()
            self.kept[w] = got
        return got

    def _best(self, w: str) -> tuple[int, float]:
        n = len(w)
        if self.alone.issuperset(w):  # nothing can be unknown: matches come by end, the longest first
            best, count = [0.0] + [float("-inf")] * n, [0] * (n + 1)
            for end, (length, score) in self.auto.iter(w):
                end += 1
                at = best[end - length] + score
                if at > best[end]:
                    best[end], count[end] = at, count[end - length] + 1
            return count[n], best[n]
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for end, (length, score) in self.auto.iter(w):
            ends[end + 1].append((length, score))
        best, count, was = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for e in range(1, n + 1):
            top, pieces, unknown, alone = float("-inf"), 0, False, False
            for length, score in sorted(ends[e], reverse=True):
                at = best[e - length] + score
                if at > top:
                    top, pieces, unknown = at, count[e - length] + 1, False
                alone |= length == 1
            if not alone and best[e - 1] + self.unknown > top:
                top, unknown = best[e - 1] + self.unknown, True
                pieces = count[e - 1] + (len(w[e - 1].encode()) if self.bytes else not was[e - 1])
            best[e], count[e], was[e] = top, pieces, unknown
        return count[n], best[n]

    def count(self, text: str) -> tuple[int, float]:
        words = text.replace(SPACE, " ").split(" ")
        if not words[0]:
            words = words[1:]
        if len(words) == 1 and not text:
            return 0, 0.0
        pieces, total, kept = 0, 0.0, self.kept
        for w in words:
            n, s = kept.get(w) or self.word(w)
            pieces += n
            total += s
        return pieces, total


def pieces_of(path: str) -> list[tuple[str, float]]:
    """The pieces and scores of a sentencepiece model file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]


def count_tokens(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, n_tokens and score of every document."""
    ready(docs.sparkSession)

    def run(batches):
        if model_path not in _MADE:
            _MADE[model_path] = Unigram(pieces_of(model_path))
        model = _MADE[model_path]
        for b in batches:
            got, chars = [], []
            for x in b.column(1):
                t = x.as_py()
                chars.append(len(t))
                got.append(model.count(t))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(chars, pa.int64()), pa.array([n for n, _ in got], pa.int64()), pa.array([s for _, s in got], pa.float64())], ["doc_id", "n_chars", "n_tokens", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, "doc_id long, n_chars long, n_tokens long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), env_path("QUILLON_UNIGRAM", public_tokenizers.path(MODEL)))
