"""SentencePiece encoding and decoding for merge-type vocabularies.

Encoding keeps an agenda of adjacent symbol pairs: the pair whose piece scores highest is merged first,
the leftmost of equals before the others, and a symbol that is no piece at the end falls back to its
bytes. Within every Arrow batch the chunks not met before are checked against the sentencepiece library.
That chunks can be handled apart follows from the vocabulary (no piece holds the two characters beside a
cut) and is tested, not checked for each row. A text with a chunk that the library encodes otherwise gets
the library's identifiers of the whole text, and ``agreed`` is false. Every row's identifiers go through the
library's ``decode`` as a whole. Texts are processed whole.

Defined cases: a null or empty text has the end identifier only and decodes to the empty text; spaces and
literal ``▁`` are one symbol, as in the library; a null identifier stays null; repeated rows give repeated
rows; further columns are ignored. A text of any length is encoded and decoded whole in its task, its identifiers in memory.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm.common import Memory, rows, slim
from millrace.llm.pieces import SPACE, Vocabulary

ENCODED = "doc_id long, ids array<int>, agreed boolean"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, agreed boolean"


#: Symbols up to which the agenda is a list that is searched; longer chunks keep it as a heap.
SHORT = 48
_NONE = 1 << 60


def merge_by_agenda(chunk: str, order: dict[str, int]) -> list[str]:
    """The symbols left when no adjacent pair is a piece. ``order``: each piece's place by falling score, equal for equal scores."""
    return _by_list(chunk, order) if len(chunk) <= SHORT else _by_heap(chunk, order)


def _by_list(chunk: str, order: dict[str, int]) -> list[str]:
    """The agenda has a place for each adjacent pair of symbols, in the order of the text, so the first least one is the leftmost."""
    symbols, place = list(chunk), order.get
    agenda = [place(a + b, _NONE) for a, b in zip(symbols, symbols[1:], strict=False)]
    while agenda:
        top = min(agenda)
        if top == _NONE:
            break
        i = agenda.index(top)
        merged = symbols[i] = symbols[i] + symbols.pop(i + 1)
        del agenda[i]
        if i < len(agenda):
            agenda[i] = place(merged + symbols[i + 1], _NONE)
        if i:
            agenda[i - 1] = place(symbols[i - 1] + merged, _NONE)
    return symbols


def _by_heap(chunk: str, order: dict[str, int]) -> list[str]:
    n = len(chunk)
    symbols, after, before = list(chunk), list(range(1, n + 1)), list(range(-1, n - 1))
    agenda = [order[pair] << 40 | i for i in range(n - 1) if (pair := chunk[i : i + 2]) in order]
    heapq.heapify(agenda)
    while agenda:
        top = heapq.heappop(agenda)
        i = top & 0xFFFFFFFFFF
        j = after[i]
        if j >= n or not symbols[i] or order.get(pair := symbols[i] + symbols[j]) != top >> 40:
            continue  # one of the two has been merged since
        symbols[i], symbols[j] = pair, ""
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (right := pair + symbols[k]) in order:
                heapq.heappush(agenda, order[right] << 40 | i)
        h = before[i]
        if h >= 0 and (left := symbols[h] + pair) in order:
            heapq.heappush(agenda, order[left] << 40 | h)
    return [x for x in symbols if x]


class Codec:
    def __init__(self, model_path: str) -> None:
        self.vocabulary = v = Vocabulary(model_path)
        places = {score: k for k, score in enumerate(sorted({v.scores[i] for i in v.normal}, reverse=True))}
        self.order = {p: places[v.scores[i]] for p, i in v.ids.items()}
        self.cut = v.chunker(list(v.ids), "*")
        self.end = v.library.eos_id()
        self.known = Memory(self._ids, 500_000, 48 << 20)
        #: Of the chunks in memory those that the library encodes otherwise.
        self.differ: set[str] = set()

    def _ids(self, chunk: str) -> tuple[list[int], str]:
        """A chunk's identifiers, also joined by one space."""
        v, out = self.vocabulary, []
        for symbol in merge_by_agenda(chunk, self.order):
            found = v.ids.get(symbol)
            out += [found] if found is not None else [v.byte_ids[b] for b in symbol.encode()] if v.byte_ids else [v.library.unk_id()]
        return out, " ".join(map(str, out))

    def check(self) -> None:
        """Hold the chunks that are new against the library. A line break before each keeps the added first space apart."""
        lib, new = self.vocabulary.library, self.known.new
        lead = len(lib.encode("\n"))
        for chunk, ids in zip(new, lib.encode(["\n" + x.replace(SPACE, " ") for x in new], num_threads=1), strict=True):
            if ids[lead:] != self.known[chunk][0]:
                self.differ.add(chunk)

    def encode(self, texts: list[str]) -> Iterator[tuple[list[int], str, bool]]:
        """Per text: the identifiers with the end's, the same joined by one space, and whether the library agreed."""
        cut, known, end = self.cut, self.known.__getitem__, self.end
        chunks = [cut(SPACE + x.replace(" ", SPACE)) if x else [] for x in texts]
        found = [list(map(known, x)) for x in chunks]
        self.check()
        for text, parts, own in zip(texts, chunks, found, strict=True):
            if not self.differ or self.differ.isdisjoint(parts):
                yield [*chain.from_iterable([x for x, _ in own]), end], " ".join([*[x for _, x in own], str(end)]), True
            else:
                ids = [*self.vocabulary.library.encode(text), end]
                yield ids, " ".join(map(str, ids)), False
        self.known.trim()
        if not self.known:
            self.differ.clear()


@lru_cache(maxsize=2)
def codec(model_path: str) -> Codec:
    return Codec(model_path)


def _texts(batches: Iterator[pa.RecordBatch], size: int = 256) -> Iterator[tuple[list, list[str]]]:
    for batch in batches:
        for k in range(0, batch.num_rows, size):
            found = list(rows(batch.slice(k, size)))
            yield [x for x, _ in found], [x.decode("utf-8", "replace") for _, x in found]


def encode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (with the end identifier) and agreed, one row per row of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _texts(batches):
            found = list(codec(model_path).encode(texts))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([x for x, _, _ in found], pa.list_(pa.int32())), pa.array([x for _, _, x in found])], names=["doc_id", "ids", "agreed"])

    return slim(df, id_col, text_col).mapInArrow(run, ENCODED)


def decode(df: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the text that the library's ``decode`` gives for each list of identifiers; null lists give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = codec(model_path).vocabulary.library
        for batch in batches:
            texts = [lib.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return df.selectExpr(f"cast({id_col} as long) as doc_id", f"{ids_col} as ids").mapInArrow(run, "doc_id long, text string")


def codec_digests(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The round trip of every text as digests, without moving the identifiers out of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        decode = codec(model_path).vocabulary.library.decode
        for ids, texts in _texts(batches):
            found = [(len(x), sha(joined), sha(decode(x)), agreed) for x, joined, agreed in codec(model_path).encode(texts)]
            columns = zip(*found, strict=True) if found else [()] * 4
            types = (pa.int64(), pa.string(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(x, t) for x, t in zip(columns, types, strict=True))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "agreed"])

    return slim(df, id_col, text_col).mapInArrow(run, DIGESTS)
