"""Token counts of a unigram vocabulary, without building the tokens.

An Aho-Corasick automaton enumerates every vocabulary match of a word; a Viterbi pass over the end
positions carries the best score and its number of pieces only. Ties go by the rule of the unigram
tokenizers: candidates for an end come in order of their start, and a later one wins only if its score is
strictly higher; a character that is no piece by itself may count as unknown, ten below the lowest score,
and then counts its bytes. Words start at spaces (``▁``), with one put before a text that has none. The
pieces and scores come from a sentencepiece model file; the reference is the ``tokenizers`` library's
Unigram model over the same entries, which the tests compare with.

Defined cases: a null or empty text has no tokens and score 0; a null identifier stays null; repeated rows
give repeated rows; further columns are ignored. A text of any length is counted whole; what a worker
remembers of chunks is held to a number of bytes after each text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm.common import Memory, rows, slim
from millrace.llm.pieces import SPACE, Vocabulary

COUNTS = "doc_id long, n_tokens long, n_words long, score double"
UNKNOWN_PENALTY = 10.0


class Counter:
    def __init__(self, model_path: str) -> None:
        v = Vocabulary(model_path)
        self.automaton = ahocorasick.Automaton()
        for piece, score in zip(v.pieces, v.scores, strict=True):
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(v.scores) - UNKNOWN_PENALTY
        self.bytes_known = len(v.byte_ids) == 256
        # sums of whole numbers don't depend on where a word is cut; of others they may
        whole = all(x == int(x) for x in v.scores)
        self.cut = v.chunker([x for x in v.pieces if SPACE not in x[1:]], "?") if whole else None
        self.known = Memory(self.best, 500_000, 48 << 20)

    def best(self, word: str) -> tuple[int, float]:
        """Pieces and score of the best segmentation."""
        n = len(word)
        score, count = [0.0] * (n + 1), [0] * (n + 1)
        found = self.automaton.iter(word)
        end, match = next(found, (n, None))
        for at in range(n):
            best, pieces, single = None, 0, False
            while end == at:  # of one end the longest comes first, so the earliest start
                size, own = match
                start = at + 1 - size
                single |= size == 1
                total = own + score[start]
                if best is None or total > best:
                    best, pieces = total, count[start] + 1
                end, match = next(found, (n, None))
            if not single and (best is None or self.unknown + score[at] > best):
                best, pieces = self.unknown + score[at], count[at] + (len(word[at].encode()) if self.bytes_known else 1)
            score[at + 1], count[at + 1] = best, pieces
        return count[n], score[n]

    def count(self, text: str) -> tuple[int, int, float]:
        """Pieces, words and score of a text."""
        if not text:
            return 0, 0, 0.0
        text = text.replace(" ", SPACE)
        text = text if text[0] == SPACE else SPACE + text
        chunks = self.cut(text) if self.cut else [SPACE + x for x in text[1:].split(SPACE)]
        pieces, score = map(sum, zip(*map(self.known.__getitem__, chunks), strict=True))
        return pieces, text.count(SPACE), score


@lru_cache(maxsize=2)
def counter(model_path: str) -> Counter:
    return Counter(model_path)


def token_counts(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, n_words and the best segmentation's score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(model_path)
        for batch in batches:
            found = []
            for _, text in rows(batch):
                found.append(c.count(text.decode("utf-8", "replace")))
                if c.known.held > c.known.size or len(c.known.new) > 20_000:
                    c.known.trim()
            tokens, words, score = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(tokens, pa.int64()), pa.array(words, pa.int64()), pa.array(score, pa.float64())], names=["doc_id", "n_tokens", "n_words", "score"])

    return slim(df, id_col, text_col).mapInArrow(run, COUNTS)
