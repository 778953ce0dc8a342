"""What the piece operators share: a vocabulary read from a sentencepiece model file, and where texts may be cut.

Two neighbouring characters that no piece holds side by side can't end up in one piece, so a text may be
cut between them and its chunks handled apart, with the same result. Chunks repeat a lot, so a Python
worker remembers the results of the latest ones, up to a fixed number and size (:class:`~millrace.llm.common.Memory`).
"""

from __future__ import annotations

import re
from collections.abc import Callable

import sentencepiece

SPACE = "▁"


class Vocabulary:
    def __init__(self, model_path: str) -> None:
        self.model_path = model_path
        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=model_path)
        every = range(lib.get_piece_size())
        self.pieces = [lib.id_to_piece(i) for i in every]
        self.scores = [lib.get_score(i) for i in every]
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in every if lib.is_byte(i)}
        self.normal = [i for i in every if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in self.normal}

    def chunker(self, among: list[str], spaces: str) -> Callable[[str], list[str]]:
        """A function that cuts a text with ``▁`` for its spaces, such that no piece of ``among`` spans a cut.

        ``spaces`` is ``*`` if a run of spaces stays together or ``?`` if each space starts a chunk.
        """
        side = {pair for piece in among for pair in zip(piece, piece[1:], strict=False)}
        if any("\n" in pair or pair[1] == SPACE and (pair[0] != SPACE or spaces == "?") for pair in side):
            return re.compile(r"(?s).+").findall
        touch = "".join(re.escape(x) for x in sorted({a for a, b in side if b in ".,"} | {SPACE}))
        s = SPACE
        return re.compile(rf"{s}{spaces}[^.,\n{touch}]+(?=[.,\n{s}]|\Z)|\n|[.,](?=[\n{s}]|\Z)|{s}{spaces}[^\n{s}]+|{s}{'+' if spaces == '*' else ''}").findall
