"""Brown class-based n-grams: words fall into classes by exchange clustering, and a text's probability is
the product of class transitions and word emissions.

Word counts cover the whole training text and stay a table. Bigrams of the most frequent words (a fixed
number) are counted by task and summed by a shuffle; each round of exchange is a job over them that moves
half of the words to the class that raises the likelihood of the class bigrams most, against the counts of
the round before, until rounds gain next to nothing. All other words of the training text then go, each by
the classes found beside it, to the class that raises the likelihood most, in one pass; they stay a table,
of which only a fixed number of words goes to the tasks and the others are joined. Class bigrams are counted
again with every word in its class. Words seen once give half of their occurrence to the class of unseen
words, which are one word; the end of a text is a class of its own.

Defined cases: a null or empty text is its end token only; a null identifier falls in the fold of the empty
text; without training texts every word has probability 1 in its class; rows that repeat count and score
each; further columns are ignored. A text of any length is tokenized whole in its task, and its tokens take some hundred
bytes each there; words of more than 256 bytes are counted and scored like others, but take no part in exchange.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import flat, id_fold, rows, slim, written

#: Distinct words or bigrams a task holds before it hands on their counts.
HELD = 1_500_000
#: Bytes of the longest word that goes to the tasks by its place; longer ones are joined by their bytes.
LONG = 256


@dataclass(frozen=True)
class Vocabulary:
    """The most frequent words and their counts, by falling count, and the totals of the training text."""

    words: tuple[bytes, ...]
    counts: np.ndarray
    tokens: int
    types: int
    texts: int


@dataclass(frozen=True)
class Model:
    """Logarithms to base 10. Word k < len(classes) has class ``classes[k]``; then come the shared class and the end's.

    The shared class holds all other words, with add-one emissions and a place for unseen words. ``table`` has the class bigrams.
    """

    vocabulary: Vocabulary
    classes: np.ndarray
    transitions: np.ndarray
    emissions: np.ndarray
    shared_total: float
    table: np.ndarray


def words_of(text: bytes) -> list[bytes]:
    """A-Z lower-cased, split at 0x20 and 0x09 to 0x0D: what bytes.lower and bytes.split do."""
    return text.lower().split()


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            words, counts = list(held), list(held.values())
            for k in range(0, len(words), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(words[k : k + 50_000], pa.binary()), pa.array(counts[k : k + 50_000], pa.int64())], names=["word", "n"])
            held.clear()

        for batch in batches:
            for text in batch.column("text").to_pylist():
                held.update(words_of(text))
                if len(held) > HELD // 2:
                    yield from out()
        yield from out()

    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary_of(counts: DataFrame, texts: int, head: int) -> Vocabulary:
    """Totals, and the ``head`` most frequent words; of equally frequent ones the first in byte order. Longer words than ``LONG`` are never among them."""
    step = F.floor(F.log2("n") * 64).cast("int")  # bounded, and equal counts fall together
    found = counts.groupBy(step.alias("step")).agg(F.count("*").alias("w"), F.sum("n").alias("t"), F.count_if(F.octet_length("word") <= LONG).alias("short")).collect()
    floor, n = 1 << 30, 0
    for row in sorted(found, key=lambda r: -r["step"]):  # the first steps that hold so many
        if n >= head:
            break
        floor, n = row["step"], n + row["short"]
    top = counts.filter((step >= floor) & (F.octet_length("word") <= LONG)).orderBy(F.desc("n"), "word").limit(head).toArrow()
    return Vocabulary(tuple(top.column("word").to_pylist()), top.column("n").to_numpy(), sum(r["t"] for r in found) + texts, sum(r["w"] for r in found) + (texts > 0), texts)


def bigrams(texts: DataFrame, clustered: tuple[bytes, ...]) -> DataFrame:
    """(a, b, n) over clustered words, the shared place of all others, and the end, which also stands before a text."""
    m = len(clustered)
    shared, end, width = m, m + 1, m + 2
    sent = texts.sparkSession.sparkContext.broadcast(clustered)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {w: k for k, w in enumerate(sent.value)}.get
        codes, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        waiting: list[np.ndarray] = []
        held = 0

        def merge() -> None:
            nonlocal codes, counts, held
            every = np.concatenate([codes, *waiting])
            weight = np.concatenate([counts, np.ones(len(every) - len(codes), np.int64)])
            codes, at = np.unique(every, return_inverse=True)
            counts = np.bincount(at, weight, minlength=len(codes)).astype(np.int64)
            waiting.clear()
            held = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array((codes // width).astype(np.int32)), pa.array((codes % width).astype(np.int32)), pa.array(counts)], names=["a", "b", "n"])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                ids = np.fromiter(map(place, words, repeat(shared)), np.int64, len(words))
                waiting.append(np.append(end, ids) * width + np.append(ids, end))
                held += len(words) + 1
                if held > HELD:
                    merge()
                    if len(codes) > HELD:
                        yield out()
                        codes, counts = codes[:0], counts[:0]
        if waiting:
            merge()
        yield out()

    return texts.mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def best_moves(own: np.ndarray, right: np.ndarray, left: np.ndarray, self_count: np.ndarray, table: np.ndarray, free: int) -> tuple[np.ndarray, np.ndarray]:
    """For each word the class among the first ``free`` it should be in, and the gain in log likelihood.

    ``right[w, c]`` and ``left[w, c]`` count the words of class c after and before w; ``table`` the class bigrams.
    """
    out, gains = own.copy(), np.zeros(len(own))
    rows_sum, columns_sum = table.sum(axis=1), table.sum(axis=0)
    for k, g in enumerate(own):
        r, l, s = right[k], left[k], self_count[k]
        base = table.copy()  # without the word
        base[g] -= r
        base[:, g] -= l
        base[g, g] += s
        a, b = rows_sum.copy(), columns_sum.copy()
        a[g] -= r.sum()
        b[g] -= l.sum()
        before, after = r.sum(), l.sum()
        r, l = r.copy(), l.copy()
        r[g] -= s  # the word beside itself moves with it: to the corner, below
        l[g] -= s
        # with the word in class h, only row h, column h and their sums differ from base
        row = _xlogx(base[:free] + r[None, :]) - _xlogx(base[:free])
        column = _xlogx(base[:, :free] + l[:, None]) - _xlogx(base[:, :free])
        h = np.arange(free)
        corner = base[h, h]
        value = row.sum(axis=1) - row[h, h] + column.sum(axis=0) - column[h, h] + _xlogx(corner + r[:free] + l[:free] + s) - _xlogx(corner)
        value -= _xlogx(a[:free] + before) - _xlogx(a[:free]) + _xlogx(b[:free] + after) - _xlogx(b[:free])
        best = int(value.argmax())
        if value[best] > value[g] + 1e-9:
            out[k], gains[k] = best, value[best] - value[g]
    return out, gains


def exchange(pairs: DataFrame, m: int, classes: int, rounds: int, tolerance: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the ``m`` clustered words and the class bigram counts (rows: before; then the shared class and the end).

    At least ``rounds`` half-rounds; then on while two of them gain more than ``tolerance`` of the whole gain.
    """
    width = classes + 2
    every = np.concatenate([np.arange(m) % classes, [classes, classes + 1]]).astype(np.int64)

    def table_of(assigned: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(width * width, np.int64)
            for batch in batches:
                a, b, n = (batch.column(x).to_numpy() for x in ("a", "b", "n"))
                total += np.bincount(assigned[a] * width + assigned[b], n, minlength=width * width).astype(np.int64)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["cell", "n"])

        found = pairs.mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        out = np.zeros(width * width, np.int64)
        out[found.column("cell").to_numpy()] = found.column("n").to_numpy()
        return out.reshape(width, width)

    def value(table: np.ndarray) -> float:
        return float(_xlogx(table).sum() - _xlogx(table.sum(axis=1)).sum() - _xlogx(table.sum(axis=0)).sum())

    table = table_of(every)
    start = value(table)
    best = (start, every, table)
    reached = [start]
    still = 0
    for t in count():
        if t >= max(rounds, 2) and reached[-1] - reached[-3] <= tolerance * (reached[-1] - start):
            break
        now, counts = every, table.astype(float)

        def decide(batches: Iterator[pa.RecordBatch], now=now, counts=counts, t=t) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                words, right, left, own = [], [], [], []
                for w, sides in zip(batch.column("w").to_pylist(), batch.column("sides").to_pylist(), strict=True):
                    vectors = np.zeros((2, width))
                    same = 0
                    for side in sides:
                        if side["side"] < 2:
                            vectors[side["side"], side["c"]] = side["n"]
                        else:
                            same = side["n"]
                    words.append(w)
                    right.append(vectors[0])
                    left.append(vectors[1])
                    own.append(same)
                if words:
                    classes_now = now[np.array(words)]
                    to, gain = best_moves(classes_now, np.array(right), np.array(left), np.array(own, float), counts, classes)
                    yield pa.RecordBatch.from_arrays([pa.array(words, pa.int32()), pa.array(to.astype(np.int32)), pa.array(gain)], names=["w", "to", "gain"])

        def sides(batches: Iterator[pa.RecordBatch], now=now, t=t) -> Iterator[pa.RecordBatch]:
            """Each task's counts of the classes beside the words whose turn it is, summed before the shuffle."""
            parts = [np.zeros((m + 2) * width, np.int64) for _ in range(2)]
            same = np.zeros(m + 2, np.int64)
            for batch in batches:
                a, b, n = (batch.column(x).to_numpy() for x in ("a", "b", "n"))
                parts[0] += np.bincount(a * width + now[b], n, minlength=(m + 2) * width).astype(np.int64)
                parts[1] += np.bincount(b * width + now[a], n, minlength=(m + 2) * width).astype(np.int64)
                same += np.bincount(a[a == b], n[a == b], minlength=m + 2).astype(np.int64)
            for side, total in enumerate([*parts, same]):
                each = width if side < 2 else 1
                at = np.flatnonzero(total)
                at = at[(at // each < m) & ((at // each + t) % 2 == 0)]
                yield pa.RecordBatch.from_arrays([pa.array((at // each).astype(np.int32)), pa.array(np.full(len(at), side, np.int32)), pa.array((at % each).astype(np.int32)), pa.array(total[at])], names=["w", "side", "c", "n"])

        stats = pairs.mapInArrow(sides, "w int, side int, c int, n long").groupBy("w", "side", "c").agg(F.sum("n").alias("n"))
        per_word = stats.groupBy("w").agg(F.collect_list(F.struct("side", "c", "n")).alias("sides"))  # two entries per class at most
        moves = per_word.mapInArrow(decide, "w int, to int, gain double").filter("gain > 0").toArrow()
        if not moves.num_rows:
            still += 1
            if still == 2:
                break
            reached.append(best[0])
            continue
        still = 0
        every = every.copy()
        every[moves.column("w").to_numpy()] = moves.column("to").to_numpy()
        table = table_of(every)
        if value(table) > best[0]:
            best = (value(table), every, table)
        reached.append(best[0])
    return best[1][:m], best[2]


def fit(texts: DataFrame, n_texts: int, counts: DataFrame, head: int = 150_000, clustered: int = 8192, classes: int = 64, rounds: int = 6, prior: float = 20.0) -> Model:
    """Fit on ``texts``. Bounds: ``head`` words go to the tasks, ``clustered`` of them fall into ``classes`` classes by exchange."""
    v = vocabulary_of(counts, n_texts, head)
    m = min(clustered, len(v.words))
    if m:
        pairs = written(bigrams(texts, v.words[:m]), "bigrams")
        own, table = exchange(pairs, m, classes, rounds)
    else:
        own, table = np.empty(0, np.int64), np.zeros((classes + 2, classes + 2), np.int64)
    total = table.sum(axis=0)
    unigram = (total + 0.5) / (total + 0.5).sum()
    transitions = (table + prior * unigram[None, :]) / (table.sum(axis=1, keepdims=True) + prior)
    size = np.bincount(own, v.counts[:m], minlength=classes + 2) if m else np.zeros(classes + 2)
    emissions = np.log10(v.counts[:m]) - np.log10(size[own]) if m else np.empty(0)
    shared_tokens, shared_types = v.tokens - v.texts - int(v.counts[:m].sum()), v.types - (v.texts > 0) - m
    return Model(v, own, np.log10(transitions), emissions, float(np.log10(shared_tokens + shared_types + 1)), table)


def best_classes(sides: np.ndarray, same: np.ndarray, table: np.ndarray, free: int) -> np.ndarray:
    """For each word of the shared class (number ``free``) the other class that gives the highest likelihood.

    ``sides[w, 0, c]`` and ``sides[w, 1, c]`` count the words of class c after and before w, ``same`` itself after
    itself. As in :func:`best_moves`, but only cells that the word touches are looked at.
    """
    n, h = len(sides), np.arange(free)
    out = np.empty(n, np.int64)
    rows_sum, columns_sum, diagonal = table.sum(axis=1)[:free], table.sum(axis=0)[:free], table[h, h]
    for k in range(0, n, 150):
        part, s = sides[k : k + 150], same[k : k + 150, None]
        moved = part.copy()
        moved[:, :, free] -= s  # the word beside itself moves with it
        total = part.sum(axis=2)
        value = _xlogx(diagonal + moved[:, 0, :free] + moved[:, 1, :free] + s) - _xlogx(diagonal)
        value -= _xlogx(rows_sum + total[:, :1]) - _xlogx(rows_sum) + _xlogx(columns_sum + total[:, 1:]) - _xlogx(columns_sum)
        w, side, c = np.nonzero(moved)
        if len(w):
            base = np.where(side[:, None] == 0, table[:free, c].T, table[c, :free])
            shared = c == free
            base[shared] -= part[w[shared], 1 - side[shared], :free]  # without the word
            gain = _xlogx(base + moved[w, side, c][:, None]) - _xlogx(base)
            own = np.flatnonzero(c < free)
            gain[own, c[own]] = 0  # in the diagonal
            first = np.flatnonzero(np.diff(w, prepend=-1))
            value[w[first]] += np.add.reduceat(gain, first)
        out[k : k + 150] = value.argmax(axis=1)
    return out


def _packed(values: np.ndarray, begins: np.ndarray) -> pa.Array:
    """Binary strings that hold ``values`` from each of ``begins`` to the next."""
    return pa.Array.from_buffers(pa.binary(), len(begins) - 1, [None, pa.py_buffer((begins * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def placed(texts: DataFrame, model: Model) -> DataFrame:
    """(id, word, class, n) of all words of ``texts`` without a class: the place in the vocabulary, or -1 and the word."""
    own, table = model.classes, model.table.astype(float)
    m, head, classes = len(own), len(model.vocabulary.words), len(table) - 2
    width, end = classes + 2, classes + 1
    cells = 2 * width + 1  # after, before, itself after itself
    sent = texts.sparkSession.sparkContext.broadcast(model.vocabulary.words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {w: k for k, w in enumerate(sent.value)}.get
        class_of = np.full(head + 1, classes)
        class_of[:m] = own
        local: dict[bytes, int] = {}
        codes, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        waiting: list[np.ndarray] = []
        held = 0

        def merge() -> None:
            nonlocal codes, counts, held
            every = np.concatenate([codes, *waiting])
            weight = np.concatenate([counts, np.ones(len(every) - len(codes), np.int64)])
            codes, at = np.unique(every, return_inverse=True)
            counts = np.bincount(at, weight, minlength=len(codes)).astype(np.int64)
            waiting.clear()
            held = 0

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal codes, counts
            merge()
            words = list(local)
            ids, cell = np.divmod(codes, cells)
            begins = np.append(np.flatnonzero(np.diff(ids, prepend=-1)), len(ids))  # of each word's cells
            for k in range(0, len(begins) - 1, 20_000):
                at = begins[k : k + 20_001]
                own, part = ids[at[:-1]], slice(at[0], at[-1])
                names = [words[x - head] if x >= head else b"" for x in own.tolist()]
                packed = [_packed(x[part], at - at[0]) for x in (cell.astype(np.int16), counts)]
                yield pa.RecordBatch.from_arrays([pa.array(np.where(own < head, own, -1).astype(np.int32)), pa.array(names, pa.binary()), *packed], names=["id", "word", "cells", "counts"])
            codes, counts = codes[:0], counts[:0]
            local.clear()

        for batch in batches:
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                ids = np.fromiter(map(place, words, repeat(-1)), np.int64, len(words))
                for k in np.flatnonzero(ids < 0).tolist():
                    ids[k] = local.setdefault(words[k], head + len(local))
                at = np.flatnonzero(ids >= m)
                if not len(at):
                    continue
                around = np.concatenate([[end], class_of[np.minimum(ids, head)], [end]])
                first = ids[at] * cells
                twice = first[np.append(ids, -1)[at + 1] == ids[at]]
                waiting += [first + around[at + 2], first + width + around[at], twice + 2 * width]
                held += 2 * len(at)
                if held > HELD:
                    merge()
                    if len(codes) > HELD:
                        yield from out()
                if len(local) > HELD // 2:
                    yield from out()
        yield from out()

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of a word, one of each task, stand together and are added up as they come."""
        held: tuple[pa.Array, pa.Array, np.ndarray] | None = None

        def chosen(ids: pa.Array, words: pa.Array, every: np.ndarray) -> pa.RecordBatch:
            sides = every[:, : 2 * width].reshape(-1, 2, width)
            to = best_classes(sides, every[:, -1], table, classes)
            return pa.RecordBatch.from_arrays([ids, words, pa.array(to.astype(np.int32)), pa.array(sides[:, 0].sum(axis=1).astype(np.int64))], names=["id", "word", "class", "n"])

        for batch in batches:
            for k in range(0, batch.num_rows, 5000):
                part = batch.slice(k, 5000)
                ids, words = part.column("id"), part.column("word")
                same = np.asarray(pc.and_(pc.equal(ids[1:], ids[:-1]), pc.equal(words[1:], words[:-1])).to_numpy(zero_copy_only=False), bool)
                group = np.append(0, np.cumsum(~same))
                raw, at = flat(part.column("cells"))
                cell, count = np.frombuffer(raw.tobytes(), np.int16), np.frombuffer(flat(part.column("counts"))[0].tobytes(), np.int64)
                n = int(group[-1]) + 1
                every = np.bincount(np.repeat(group, np.diff(at) // 2) * cells + cell, count, minlength=n * cells).reshape(n, cells)
                first = pa.array(np.append(0, np.flatnonzero(~same) + 1))
                ids, words = ids.take(first), words.take(first)
                if held and (held[0][0], held[1][0]) == (ids[0], words[0]):
                    every[0] += held[2][0]
                elif held:
                    yield chosen(*held)
                held = ids[-1:], words[-1:], every[-1:].copy()
                if n > 1:
                    yield chosen(ids[:-1], words[:-1], every[:-1])
        if held:
            yield chosen(*held)

    counted = texts.mapInArrow(run, "id int, word binary, cells binary, counts binary").repartition("id", "word").sortWithinPartitions("id", "word")
    return counted.mapInArrow(decide, "id int, word binary, class int, n long")


_ENCODED = "part int, row long, doc_id long, n_tokens long, n_known long, base double, weight double, labels binary, holes binary, rest array<binary>"
_LABELLED = "doc_id long, n_tokens long, n_known long, base double, weight double, labels binary"


def _weight(n: np.ndarray) -> np.ndarray:
    """Logarithm of the share of its class a word has: its count, or half of its only occurrence."""
    return np.log10(np.where(n == 1, 0.5, n))


def labelled(df: DataFrame, model: Model, words: DataFrame) -> DataFrame:
    """Texts as labels: a word's class, further on by the number of classes if it was seen once; and sums over the words.

    ``words`` as from :func:`placed`. The distinct words of a text that the tasks don't have are joined with it.
    """
    v, m, classes = model.vocabulary, len(model.classes), len(model.table) - 2
    head, width = len(v.words), classes + 2
    kind = np.min_scalar_type(2 * width)
    here = words.filter("id >= 0").select("id", "class").toArrow()  # ``head`` at most
    class_of = np.full(head + 1, classes)
    class_of[:m] = model.classes
    class_of[here.column("id").to_numpy()] = here.column("class").to_numpy()
    class_of[:head][v.counts == 1] += width
    sent = df.sparkSession.sparkContext.broadcast((v.words, v.counts, class_of))
    whole, end_base, with_end = np.log10(v.tokens + v.types + 1.0), np.log10(v.texts + 1.0), v.texts > 0

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row = TaskContext.get().partitionId(), 0
        words_sent, counts, class_of = sent.value
        place = {w: k for k, w in enumerate(words_sent)}.get
        plus_one, weight = np.append(np.log10(counts + 1.0), 0.0), np.append(_weight(counts), 0.0)
        types = [pa.int32(), *[pa.int64()] * 4, *[pa.float64()] * 2, *[pa.binary()] * 2, pa.list_(pa.binary())]
        for batch in batches:
            out = []
            for doc_id, text in rows(batch):
                words = words_of(text)
                ids = np.fromiter(map(place, words, repeat(head)), np.int64, len(words))
                rest: dict[bytes, int] = {}
                holes = [rest.setdefault(words[k], len(rest)) for k in np.flatnonzero(ids == head).tolist()]
                base = plus_one[ids].sum() + end_base - (len(words) + 1) * whole
                known = len(words) - len(holes) + with_end
                out.append((part, row, doc_id, len(words) + 1, known, float(base), float(weight[ids].sum()), class_of[ids].astype(kind).tobytes(), np.array(holes, np.int32).tobytes(), list(rest)))
                row += 1
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)] if out else [pa.array([], t) for t in types], names=[x.split()[0] for x in _ENCODED.split(", ")])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known, base, weight, labels = (batch.column(x).to_pylist() for x in ("n_known", "base", "weight", "labels"))
            holes, found = batch.column("holes").to_pylist(), batch.column("found")
            sizes = pc.fill_null(pc.list_value_length(found), 0).to_numpy(zero_copy_only=False)
            ends, every = np.cumsum(sizes), found.flatten()
            place, of, count = (every.field(x).to_numpy() for x in ("k", "class", "n"))
            for k in np.flatnonzero(sizes).tolist():
                own, at = slice(ends[k] - sizes[k], ends[k]), np.frombuffer(holes[k], np.int32)
                n, to = np.zeros(at.max() + 1, np.int64), np.full(at.max() + 1, classes)
                n[place[own]], to[place[own]] = count[own], of[own] + width * (count[own] == 1)
                n, to, line = n[at], to[at], np.frombuffer(labels[k], kind).copy()
                line[line == classes] = to
                labels[k] = line.tobytes()
                n = n[n > 0]
                known[k] += len(n)
                base[k] += float(np.log10(n + 1.0).sum())
                weight[k] += float(_weight(n).sum())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_tokens"), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(weight, pa.float64()), pa.array(labels, pa.binary())], names=[x.split()[0] for x in _LABELLED.split(", ")])

    partial = written(df.mapInArrow(encode, _ENCODED), "encoded")
    rest = partial.select("part", "row", F.posexplode("rest").alias("k", "word"))
    found = rest.join(words.filter("id < 0").drop("id"), "word").groupBy("part", "row").agg(F.collect_list(F.struct("k", "class", "n")).alias("found"))
    return partial.drop("rest").join(found, ["part", "row"], "left").mapInArrow(fill, _LABELLED)


def label_bigrams(texts: DataFrame, classes: int) -> np.ndarray:
    """Class bigrams of labelled texts: the mean of words seen once in their classes and in the class of unseen words."""
    width, end = classes + 2, classes + 1
    kind, each = np.min_scalar_type(2 * width), 2 * width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(each * each, np.int64)
        for batch in batches:
            for line in batch.column("labels").to_pylist():
                c = np.concatenate([[end], np.frombuffer(line, kind), [end]]).astype(np.int64)
                np.add.at(total, c[:-1] * each + c[1:], 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["cell", "n"])

    found = texts.select("labels").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    a, b = np.divmod(found.column("cell").to_numpy(), each)
    n, out = found.column("n").to_numpy(), np.zeros((width, width))
    for of in (np.arange(each) % width, np.where(np.arange(each) < width, np.arange(each), classes)):
        np.add.at(out, (of[a], of[b]), n / 2)
    return out


def class_scores(docs: DataFrame, modulus: int = 7, fold: int = 2, id_col: str = "doc_id", text_col: str = "text", prior: float = 20.0, **how: object) -> DataFrame:
    """Fit on the documents outside the held-out fold and score all: counts, the add-one unigram base, the model's score and perplexity."""
    every = slim(docs, id_col, text_col)
    held_out = id_fold("doc_id", modulus) == fold
    training = every.filter(~held_out)
    model = fit(training, training.count(), written(word_counts(training), "words"), prior=prior, **how)
    v, classes = model.vocabulary, len(model.table) - 2
    texts = written(labelled(every, model, written(placed(training, model), "placed")), "labels")

    table = label_bigrams(texts.filter(~held_out), classes)
    size = table.sum(axis=0)
    unigram = (size + 0.5) / (size + 0.5).sum()
    size[classes:] = 1  # the unseen word and the end are alone in their classes
    steps = np.log10((table + prior * unigram) / (table.sum(axis=1, keepdims=True) + prior)) - np.log10(np.maximum(size, 0.5))
    width, kind = classes + 2, np.min_scalar_type(2 * classes + 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            for weight, line in zip(batch.column("weight").to_pylist(), batch.column("labels").to_pylist(), strict=True):
                c = np.concatenate([[width - 1], np.frombuffer(line, kind) % width, [width - 1]]).astype(np.int64)
                scores.append(weight + float(steps[c[:-1], c[1:]].sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(scores, pa.float64())], names=["doc_id", "n_tokens", "n_known", "base", "score"])

    return (
        texts.select("doc_id", "n_tokens", "n_known", "base", "weight", "labels")
        .mapInArrow(run, "doc_id long, n_tokens long, n_known long, base double, score double")
        .select(
            "doc_id",
            held_out.alias("held_out"),
            "n_tokens",
            "n_known",
            F.lit(v.tokens).cast("long").alias("train_tokens"),
            F.col("base").alias("base_score"),
            "score",
            F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
        )
    )
