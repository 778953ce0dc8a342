"""Two tokenizers' tokens of the same texts, aligned by the bytes they cover.

Tokens of both are the nodes of a graph in which two that share a byte are linked. Union-find over a batch of texts:
every token hooks onto the other side's token that covers its first byte, if that begins earlier (or is the first
side's and begins there too), and pointers are halved until they settle. A token whose first byte is no end of
both sides always has such a neighbour, so that one hook for each token leaves a tree per component with the first side's
first token as its root; a component is a smallest group of tokens that cover the same bytes on both sides. All pairs
within a group are links.

How many documents hold an identifier pair is counted over the whole corpus: a task numbers blocks of documents as it
goes, each block sends its distinct pairs once, with its own count, and gets the sums back the same way, so that
no document's pairs go through a shuffle one by one and a pair that every document has comes once a block. Nothing
is broadcast.

Defined cases: a null or empty text, and one whose tokens' bytes differ from a space and the text on either side, has no
tokens: zeros, and an empty ``groups_sha256``; strings of special tokens are ordinary text; a null identifier stays null; rows
that repeat are documents each; further columns are ignored; an empty table gives no rows. A text of any length is
encoded whole in its task; its tokens take about 100 bytes each there. Pairs of a large group are counted from its
distinct identifiers, not from its tokens.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import slim, written
from millrace.llm.packing import encoder
from millrace.llm.pieces import SPACE

#: Bytes of text that are aligned at once, pairs of a block, and the pairs of a group from which on it goes by distinct identifiers.
CHUNK, BLOCK, LARGE = 1 << 20, 1 << 20, 256
_DOCS = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
_ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class Vocabularies(NamedTuple):
    """The first side's byte-level ranks file and pattern, and the second side's sentencepiece model."""

    ranks: str
    pattern: str
    model: str


class Side(NamedTuple):
    """One tokenizer: its function from texts to arrays of identifiers, and every identifier's bytes."""

    encode: object
    raw: list[bytes]
    sizes: np.ndarray


@lru_cache(maxsize=2)
def sides(how: Vocabularies) -> tuple[Side, Side]:
    import base64

    with open(how.ranks, "rb") as lines:
        by_id = {int(b): base64.b64decode(a) for a, b in map(bytes.split, lines)}
    first = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
    one = encoder(how.ranks, how.pattern)
    library = sentencepiece.SentencePieceProcessor(model_file=how.model)
    second = [bytes([int(p[3:5], 16)]) if library.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in ((i, library.id_to_piece(i)) for i in range(library.get_piece_size()))]

    def other(texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.int64) for x in library.encode(texts, num_threads=1)]

    return tuple(Side(f, raw, np.fromiter(map(len, raw), np.int64, len(raw))) for f, raw in ((lambda texts: [one(" " + t).astype(np.int64) for t in texts], first), (other, second)))  # type: ignore[return-value]


def components(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group (from 0 on, in order) of every token of either side; both cover the same bytes."""
    starts_a, starts_b = (np.cumsum(x) - x for x in (a_sizes, b_sizes))
    n = len(a_sizes)
    at = np.searchsorted(starts_b, starts_a, "right") - 1
    parent = np.concatenate([np.where(starts_b[at] < starts_a, n + at, np.arange(n)), np.searchsorted(starts_a, starts_b, "right") - 1])
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            break
        parent = up
    number = np.cumsum(parent[:n] == np.arange(n)) - 1
    return number[parent[:n]], number[parent[n:]]


def _expanded(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, .. (count[0] of them), then those of first[1] and so on."""
    return np.arange(int(count.sum())) + np.repeat(first - (np.cumsum(count) - count), count)


class Aligner:
    """Aligns lists of texts."""

    def __init__(self, how: Vocabularies) -> None:
        self.a, self.b = sides(how)
        self.span = len(self.b.raw)
        most = max(len(self.a.raw), self.span)
        self.width = most
        self.written = [str(i).encode() + sep for sep in (b",", b"|", b";") for i in range(most)]

    def encoded(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Both sides' identifiers of each text; none where either side's bytes aren't a space and the text."""
        none = np.empty(0, np.int64)
        found = []
        for a, b, text in zip(self.a.encode(texts), self.b.encode(texts), texts, strict=True):
            raw = b" " + text.encode()
            good = bool(text) and all(b"".join(map(side.raw.__getitem__, ids.tolist())) == raw for side, ids in ((self.a, a), (self.b, b)))
            found.append((a, b) if good else (none, none))
        return [a for a, _ in found], [b for _, b in found]

    def align(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, str, np.ndarray, np.ndarray]]:
        """Per text: tokens of both, groups, links, the groups' digest, its distinct identifier pairs and how many links each has."""
        per_a, per_b = self.encoded(texts)
        ends_a, ends_b = (np.concatenate([[0], np.cumsum([len(x) for x in per])]).astype(np.int64) for per in (per_a, per_b))
        a, b = np.concatenate(per_a), np.concatenate(per_b)
        if not len(a):
            yield from ((0, 0, 0, 0, "", a, a) for _ in texts)
            return
        group_a, group_b = components(self.a.sizes[a], self.b.sizes[b])
        many = int(group_a[-1]) + 1
        in_a, in_b = np.bincount(group_a, minlength=many), np.bincount(group_b, minlength=many)
        upto_a, upto_b = np.cumsum(in_a), np.cumsum(in_b)
        # both sides' tokens, group after group, each with the mark that follows it
        order = np.empty(len(a) + len(b), np.int64)
        last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        last_a[upto_a - 1] = last_b[upto_b - 1] = True
        order[np.arange(len(a)) + (upto_b - in_b)[group_a]] = a + self.width * last_a
        order[np.arange(len(b)) + upto_a[group_b]] = b + 2 * self.width * last_b
        # links of small groups, token by token
        small = (in_a * in_b <= LARGE)[group_a]
        count = np.where(small, in_b[group_a], 0)
        pairs = np.repeat(a * self.span, count) + b[_expanded((upto_b - in_b)[group_a], count)]
        ends_pairs = np.concatenate([[0], np.cumsum(count)])[ends_a]
        groups_at = np.concatenate([[0], np.cumsum(in_a * in_b)])
        for k in range(len(texts)):
            n_a, n_b = int(ends_a[k + 1] - ends_a[k]), int(ends_b[k + 1] - ends_b[k])
            if not n_a:
                yield 0, 0, 0, 0, "", a[:0], a[:0]
                continue
            low, high = int(group_a[ends_a[k]]), int(group_a[ends_a[k + 1] - 1]) + 1
            whole = b"".join(map(self.written.__getitem__, order[ends_a[k] + ends_b[k] : ends_a[k + 1] + ends_b[k + 1]].tolist()))
            own, times = np.unique(pairs[ends_pairs[k] : ends_pairs[k + 1]], return_counts=True)
            large = np.flatnonzero(in_a[low:high] * in_b[low:high] > LARGE) + low
            if len(large):
                own, times = self.with_large(own, times, [(a[upto_a[g] - in_a[g] : upto_a[g]], b[upto_b[g] - in_b[g] : upto_b[g]]) for g in large])
            yield n_a, n_b, high - low, int(groups_at[high] - groups_at[low]), hashlib.sha256(whole[:-1]).hexdigest(), own, times

    def with_large(self, own: np.ndarray, times: np.ndarray, groups: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = [own], [times]
        for ids_a, ids_b in groups:
            (x, nx), (y, ny) = (np.unique(i, return_counts=True) for i in (ids_a, ids_b))
            keys.append((x[:, None] * self.span + y[None, :]).ravel())
            counts.append((nx[:, None] * ny[None, :]).ravel())
        found, where = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(found), np.int64)
        np.add.at(total, where, np.concatenate(counts))
        return found, total


def _chunks(texts: list[bytes]) -> Iterator[slice]:
    begin, held = 0, 0
    for k, text in enumerate(texts):
        held += len(text)
        if held >= CHUNK or k == len(texts) - 1:
            yield slice(begin, k + 1)
            begin, held = k + 1, 0


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*values, np.empty(0, np.int64)]), kind))


def documents_aligned(df: DataFrame, how: Vocabularies) -> DataFrame:
    """Per document: its block, counts, digest, distinct pairs (first identifier times the second vocabulary's size, plus the second) and links of each."""
    schema = pa.schema([*((c, pa.int64()) for c in ("block", "doc_id", "n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(how)
        block, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for part in _chunks(texts):
                found = list(zip(*aligner.align([t.decode("utf-8", "replace") for t in texts[part]]), strict=True))
                ids, n = batch.column("doc_id").slice(part.start, part.stop - part.start), part.stop - part.start
                counts = [pa.array(c, pa.int64()) for c in found[:4]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), ids, *counts, pa.array(found[4], pa.string()), _lists(found[5], pa.int64()), _lists(found[6], pa.int64())], schema=schema)
                held += sum(map(len, found[5]))
                if held >= BLOCK:
                    block, held = block + 1, 0

    return df.mapInArrow(run, _DOCS)


def block_pairs(docs: DataFrame) -> DataFrame:
    """(block, pair, n): the distinct pairs of each block and how many of its documents hold them; a block that tasks share comes from each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def out() -> Iterator[pa.RecordBatch]:
            pair, n = np.unique(np.concatenate(held), return_counts=True)
            if len(pair):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pair), now)), pa.array(pair), pa.array(n)], names=["block", "pair", "n"])

        for batch in batches:
            blocks, lists = batch.column("block").to_numpy(), batch.column("pairs")
            cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
            for x, y in zip(cuts, cuts[1:], strict=False):
                if x == y:
                    continue
                if held and blocks[x] != now:
                    yield from out()
                    held = []
                now = int(blocks[x])
                held.append(lists.slice(x, y - x).flatten().to_numpy())
        if held:
            yield from out()

    return docs.select("block", "pairs").mapInArrow(run, "block long, pair long, n long")


def _summed(docs: pa.Table, known: pa.Table) -> pa.Table:
    """The documents of one block with the corpus-wide counts of its pairs."""
    docs = docs.combine_chunks()
    lists = [docs.column(c).combine_chunks() if docs.num_rows else None for c in ("pairs", "times")]
    best, total = np.zeros(docs.num_rows, np.int64), np.zeros(docs.num_rows, np.int64)
    if docs.num_rows and known.num_rows:
        pair, count, top = (known.column(c).to_numpy() for c in ("pair", "count", "top"))
        order = np.argsort(pair)
        pair, count, top = pair[order], count[order], top[order]
        keys, times = (x.flatten().to_numpy() for x in lists)
        sizes = lists[0].value_lengths().to_numpy()
        row = np.repeat(np.arange(len(sizes)), sizes)
        at = np.searchsorted(pair, keys)
        np.add.at(best, row, times * (count[at] == top[at]))
        np.add.at(total, row, times * count[at])
    return docs.drop_columns(["block", "pairs", "times"]).append_column("n_best", pa.array(best)).append_column("count_sum", pa.array(total)).select([x.split()[0] for x in _ALIGNED.split(", ")])


def pair_counts(pairs: DataFrame, span: int) -> DataFrame:
    """(pair, count, top): in how many documents each pair is linked, and the highest such count of its first identifier."""
    counts = written(pairs.groupBy("pair").agg(F.sum("n").alias("count")), "pair-counts").withColumn("a", F.floor(F.col("pair") / span))
    return counts.join(counts.groupBy("a").agg(F.max("count").alias("top")), "a").select("pair", "count", "top")


def align(docs: DataFrame, how: Vocabularies, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256."""
    found = written(documents_aligned(slim(docs, id_col, text_col), how), "aligned")
    pairs = written(block_pairs(found), "block-pairs")
    span = sentencepiece.SentencePieceProcessor(model_file=how.model).get_piece_size()
    known = pairs.select("block", "pair").join(pair_counts(pairs, span), "pair")
    return found.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_summed, _ALIGNED)
