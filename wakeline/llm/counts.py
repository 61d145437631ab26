"""Token counts: count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates all pieces that end at each character; dynamic programming carries the best score
and its number of pieces, and never builds the segmentation. Tie rule of the unigram tokenizer: at each place the edge
that starts first (the longest piece) wins unless a later one is strictly better. Scores are the model file's, whole
numbers, so sums are exact. A character without a piece of its own costs the lowest score less 10 and counts its
bytes. No piece spans two words, so the best path of a text is made of those of its words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .pieces import MODEL, Vocabulary

#: A run of spaces with the word behind it; spaces before a line end or the text's end; a line end.
WORD = re.compile(r" *[^ \n]+| +|\n")
UNKNOWN_PENALTY = 10.0
CACHE = 400_000


class Counter:
    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score, _ in vocabulary.pieces:
            text = piece.decode()
            self.automaton.add_word(text, (len(text), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score, _ in vocabulary.pieces) - UNKNOWN_PENALTY
        self.known: dict[str, tuple[int, float]] = {}

    def word(self, text: str) -> tuple[int, float]:
        """Pieces and score of the best path of one word."""
        n = len(text)
        ending: list[list | None] = [None] * (n + 1)
        for last, edge in self.automaton.iter(text):  # at one place, longer pieces come first
            if ending[last + 1] is None:
                ending[last + 1] = [edge]
            else:
                ending[last + 1].append(edge)
        score, count = [0.0] * (n + 1), [0] * (n + 1)
        for e in range(1, n + 1):
            best, single = None, False
            for length, s in ending[e] or ():
                if best is None or score[e - length] + s > best:
                    best, fewest = score[e - length] + s, count[e - length] + 1
                single = single or length == 1
            if not single and (best is None or score[e - 1] + self.unknown > best):
                best, fewest = score[e - 1] + self.unknown, count[e - 1] + len(text[e - 1].encode("utf-8", "surrogatepass"))
            score[e], count[e] = best, fewest
        return count[n], score[n]

    def text(self, text: str | None) -> tuple[int, float]:
        """Pieces and score of a text, with the word mark in front (null and empty texts: none)."""
        if not text:
            return 0, 0.0
        known, total, score = self.known, 0, 0.0
        for w in WORD.findall(" " + text):
            got = known.get(w)
            if got is None:
                if len(known) >= CACHE:
                    known.clear()
                got = self.word(w)
                if len(w) <= 64:
                    known[w] = got
            total += got[0]
            score += got[1]
        return total, score


_counters: dict[str, Counter] = {}


def counter(vocabulary_of) -> Counter:
    """The one that a Python worker keeps, of the model in use."""
    path = vocabulary_of.value.path
    if path not in _counters:
        _counters.clear()
        _counters[path] = Counter(vocabulary_of.value)
    return _counters[path]


def counted(df: DataFrame, *, model: str = MODEL) -> DataFrame:
    """df with n_tokens (long) and best_score (double) added; an own column of that name is replaced.

    A null or empty text has 0 tokens and score 0. Texts are taken whole; repeated rows count alike; an empty table gives no
    rows; other columns stay.
    """
    df = df.drop("n_tokens", "best_score")
    vocabulary_of = df.sparkSession.sparkContext.broadcast(Vocabulary(model))  # the size of the model file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = counter(vocabulary_of)
        for batch in batches:
            done = [tool.text(x.as_py()) for x in batch.column(batch.schema.get_field_index("text"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([a for a, _ in done], pa.int64()), pa.array([b for _, b in done], pa.float64())], [*batch.schema.names, "n_tokens", "best_score"])

    return df.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), "n_tokens long", "best_score double"]))
