"""Language identification as inference of a mixture.

Each language has a distribution over hashed character n-grams, counted over training documents. A word's
likelihood under a language is that of its n-grams; a document is a mixture of languages over its words,
whose proportions expectation-maximisation estimates, from its distinct words and how often each occurs. Languages
enter the set one by one, by falling proportion, as long as the likelihood gains more than a penalty in the number of
words; the prediction is the largest proportion of the chosen set, the score its proportion when no language is left out.

All languages of the training documents are learned; each has a column of the n-gram tables, whose buckets are as many
as ``table_bytes`` allow. A text's mixture is inferred over the ``SHORT`` languages that most of its words are likeliest
in, and the one that all its words together are; with no more languages than that, over all of them.

The n-gram tables are fitted on a bounded sample (about ``most`` documents of each language); prediction takes every whole
text. Defined cases: ``und`` with score 0 if the text is null or has no letter, or if no language was learned; of equal
languages the alphabetically first; a null identifier falls in the fold of the empty text; rows that repeat give repeated
rows; further columns are ignored; an empty table gives no rows. A very long text is taken by parts of about a
megabyte, of which only the distinct words stay, and their likelihoods in the languages of the shortlist.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import chosen_rows, fold_of, id_fold, slim
from millrace.llm.sampling import bounded

UNKNOWN = "und"
#: Bytes per n-gram, and the most buckets of the table of each.
GRAMS, BUCKETS = (2, 4), 1 << 16
#: Words, and likelihoods of a word in a language, that a worker remembers, and likelihoods that are taken through expectation-maximisation at once.
WORDS, MEMORY, CHUNK = 150_000, 8_000_000, 400_000
#: Languages of a text's shortlist, and characters of a text that are split at once.
SHORT, PART = 16, 1 << 20
PREDICTIONS = "doc_id long, held_out boolean, lang_pred string, score double, languages array<struct<lang:string,share:double>>"
_EDGE = "\"'`()[]{}<>,;:-_*#…«»“”‘’¡¿.!?0123456789"


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    #: For each of GRAMS: log probabilities, buckets x languages.
    tables: tuple[np.ndarray, ...]

    @property
    def buckets(self) -> int:
        return len(self.tables[0])


def buckets_for(languages: int, table_bytes: int) -> int:
    """Buckets (a power of two) with which the tables of so many languages have at most ``table_bytes``."""
    most = table_bytes // (4 * len(GRAMS) * max(languages, 1))
    return max(256, min(BUCKETS, 1 << max(most.bit_length() - 1, 0)))


def grams_of(words: list[str], buckets: int = BUCKETS) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each n: the buckets of all n-grams of all words (a space before and after each), and where each word's begin."""
    shift = np.uint64(65 - buckets.bit_length())
    raw = [f" {w} ".encode() for w in words]
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    ends = np.cumsum(sizes)
    found, begins = [], []
    for n in GRAMS:
        key = np.zeros(max(len(data) - n + 1, 0), np.uint64)
        for k in range(n):
            key = (key << np.uint64(8)) | data[k : len(data) - n + 1 + k]
        key = ((key + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> shift
        each = np.maximum(sizes - n + 1, 0)
        keep = np.ones(len(key), bool)
        for k in range(1, n):  # n-grams that would reach into the next word
            at = ends[:-1] - k
            keep[at[(at >= 0) & (at < len(key))]] = False
        found.append(key[keep].astype(np.int64))
        begins.append(np.concatenate([[0], np.cumsum(each)]))
    return found, begins


def words_of(text: str) -> list[str]:
    return text.lower().split()


def _parts(text: bytes) -> Iterator[str]:
    """A text's pieces of about PART characters, cut at white space; a word of any length stays whole."""
    plain, at = text.decode("utf-8", "replace"), 0
    space = re.compile(r"\s")
    while at < len(plain):
        end = space.search(plain, at + PART)
        stop = end.start() if end else len(plain)
        yield plain[at:stop]
        at = stop


def letters_of(word: str) -> str:
    """The word without marks at its edges; empty if it has no letter."""
    word = word.strip(_EDGE)
    return word if any(map(str.isalpha, word)) else ""


def fit(docs: DataFrame, most: int = 3000, modulus: int = 4, fold: int = 2, smoothing: float = 0.5, table_bytes: int = 64 << 20) -> Model:
    """Count n-grams over about ``most`` documents of each language outside the held-out fold."""
    known = docs.filter(F.col("lang").isNotNull() & (id_fold("doc_id", modulus) != fold)).select("doc_id", "text", "lang")
    buckets = buckets_for(known.select("lang").distinct().count(), table_bytes)
    sample = bounded(known, "lang", most, F.col("doc_id")).select("lang", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, list[np.ndarray]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, own in tables.items():
                for k, table in enumerate(own):
                    at = np.flatnonzero(table)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), pa.array(table[at])], names=["lang", "k", "bucket", "n"])
            tables.clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for part in _parts(text):
                    words = [x for w in words_of(part) if (x := letters_of(w))]
                    if words:
                        own = tables.setdefault(lang, [np.zeros(buckets, np.int64) for _ in GRAMS])
                        for table, found in zip(own, grams_of(words, buckets)[0], strict=True):
                            table += np.bincount(found, minlength=buckets)
                if len(tables) * buckets > 1 << 23:
                    yield from out()
        yield from out()

    def column(entries: pa.Table) -> pa.Table:
        """One language's log probabilities, as bytes."""
        k, bucket, n = (entries.column(c).to_numpy() for c in ("k", "bucket", "n"))
        own = np.full((len(GRAMS), buckets), smoothing)
        own[k, bucket] += n
        return pa.table({"lang": entries.column("lang").slice(0, 1), "logs": pa.array([np.log(own / own.sum(axis=1, keepdims=True)).astype("<f4").tobytes()], pa.binary())})

    counts = sample.mapInArrow(count, "lang string, k int, bucket int, n long").groupBy("lang", "k", "bucket").agg(F.sum("n").alias("n"))
    rows = sorted(counts.groupBy("lang").applyInArrow(column, "lang string, logs binary").collect())  # table_bytes at most
    tables = np.empty((len(GRAMS), buckets, len(rows)), np.float32)
    for i, row in enumerate(rows):
        tables[:, :, i] = np.frombuffer(row.logs, "<f4").reshape(len(GRAMS), buckets)
    return Model(tuple(row.lang for row in rows), tuple(tables))


class Likelihoods:
    """Log likelihoods of words under each language; a word without letters has none. Remembers the latest words."""

    def __init__(self, model: Model) -> None:
        self.model, self.most = model, min(WORDS, MEMORY // max(len(model.languages), 1))
        self.clear()

    def clear(self) -> None:
        self.places: dict[str, int] = {}
        self.values = np.zeros((1 << 12, len(self.model.languages)), np.float32)
        self.informs = np.zeros(1 << 12, bool)

    def compute(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """words x languages, and which words have letters."""
        values, informs = np.zeros((len(words), len(self.model.languages)), np.float32), np.zeros(len(words), bool)
        plain = [letters_of(w) for w in words]
        informs[:] = [bool(w) for w in plain]
        lettered, step = np.flatnonzero(informs), max(1, CHUNK // (16 * max(len(self.model.languages), 1)))
        for k in range(0, len(lettered), step):
            some, total = lettered[k : k + step], 0
            for found, begin, table in zip(*grams_of([plain[i] for i in some], self.model.buckets), self.model.tables, strict=True):
                sums, full = np.zeros((len(some), len(self.model.languages))), np.diff(begin) > 0
                if full.any():
                    sums[full] = np.add.reduceat(table[found].astype(np.float64), begin[:-1][full], axis=0)
                total = total + sums
            values[some] = total / len(GRAMS)
        return values, informs

    def of(self, words: list[str]) -> np.ndarray:
        """The row of each word in ``values`` and ``informs``."""
        new = [w for w in dict.fromkeys(words) if w not in self.places]
        if new:
            first = len(self.places)
            while first + len(new) > len(self.values):
                self.values = np.concatenate([self.values, np.zeros_like(self.values)])
                self.informs = np.concatenate([self.informs, np.zeros_like(self.informs)])
            self.places.update(zip(new, range(first, first + len(new)), strict=True))
            self.values[first : first + len(new)], self.informs[first : first + len(new)] = self.compute(new)
        return np.fromiter(map(self.places.__getitem__, words), np.int64, len(words))


def _by_document(values: np.ndarray, of: np.ndarray, many: int) -> np.ndarray:
    """Sums of the rows of ``values`` by document; ``of`` ascends."""
    out = np.zeros((many, *values.shape[1:]))
    if len(of):
        first = np.concatenate([[0], np.flatnonzero(np.diff(of)) + 1])
        out[of[first]] = np.add.reduceat(values, first, axis=0)
    return out


def mixture(logs: np.ndarray, times: np.ndarray, of: np.ndarray, allowed: np.ndarray, steps: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log likelihood of each document's mixture over its ``allowed`` languages.

    ``logs``: words x languages, each word's largest about 0; ``times`` and ``of``: how often a word occurs, in which document
    (ascending, each with one word at least). Words are taken by blocks, so that only ``logs`` grows with them.
    """
    many, size = allowed.shape[0], max(1, CHUNK // allowed.shape[1])
    total = _by_document(times.astype(float), of, many)
    share = allowed / allowed.sum(axis=1, keepdims=True)
    for step in range(steps + 1):
        sums, value = np.zeros(allowed.shape), np.zeros(many)
        for k in range(0, len(of), size):
            own, n = of[k : k + size], times[k : k + size]
            r = np.exp(logs[k : k + size].astype(np.float64)) * share[own]
            whole = np.maximum(r.sum(axis=1), 1e-300)
            if step == steps:
                value += _by_document(n * np.log(whole), own, many)
            else:
                sums += _by_document(r * (n / whole)[:, None], own, many)
        share = sums / total[:, None] if step < steps else share
    return share, value


def infer(logs: np.ndarray, times: np.ndarray, of: np.ndarray, single: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """The chosen languages' proportions (0 for others) and those of the mixture of all, per document. ``single``: log likelihoods of one language alone."""
    n, many = single.shape
    everything, most = mixture(logs, times, of, np.ones((n, many)))
    chosen = np.zeros((n, many))
    chosen[np.arange(n), single.argmax(axis=1)] = 1
    best = single.max(axis=1)
    price = penalty * np.log(np.maximum(_by_document(times.astype(float), of, n), 2))
    order = np.argsort(-everything, axis=1, kind="stable")
    active = np.arange(n)
    for size in range(2, many + 1):
        active = active[most[active] - best[active] > price[active]]  # no larger set can gain more
        if not len(active):
            break
        rank = np.full(n, -1)
        rank[active] = np.arange(len(active))
        rows = slice(None) if len(active) == n else rank[of] >= 0
        allowed = np.zeros((len(active), many))
        np.put_along_axis(allowed, order[active, :size], 1, axis=1)
        share, value = mixture(logs[rows], times[rows], rank[of[rows]], allowed)
        better = value - best[active] > price[active]
        best[active[better]] = value[better]
        chosen[active[better]] = share[better]
        active = active[better]
    return chosen, everything


def shortlist(votes: np.ndarray, single: np.ndarray) -> np.ndarray:
    """Per document the places, ascending, of the languages that most words are likeliest in, with the one that all are likeliest in."""
    if single.shape[1] <= SHORT:
        return np.broadcast_to(np.arange(single.shape[1]), single.shape)
    ranked = votes + 0.5 / (1 + np.argsort(np.argsort(-single, axis=1, kind="stable"), axis=1, kind="stable"))  # of equally many words by the likelihood of all
    ranked[np.arange(len(single)), single.argmax(axis=1)] = np.inf
    return np.sort(np.argsort(-ranked, axis=1, kind="stable")[:, :SHORT], axis=1)


def predictor(model: Model, penalty: float = 2.0) -> Callable[[list[bytes]], tuple[list[str], list[float], list[list[dict]]]]:
    """For one task: a function from texts to their languages, scores and chosen languages' shares."""
    likely, many = Likelihoods(model), len(model.languages)

    def named(short: np.ndarray, logs: np.ndarray, times: np.ndarray, of: np.ndarray, single: np.ndarray) -> Iterator[tuple[str, float, list[dict]]]:
        chosen, everything = infer(logs, times, of, np.take_along_axis(single, short, axis=1), penalty)
        for own, all_of_it, places in zip(chosen, everything, short, strict=True):
            top = int(own.argmax())
            yield model.languages[places[top]], float(min(1.0, all_of_it[top])), [{"lang": model.languages[places[j]], "share": float(own[j])} for j in np.argsort(-own, kind="stable") if own[j] > 0]

    def several(found: list[np.ndarray]) -> list[tuple[str, float, list[dict]]]:
        """``found``: the rows in ``likely`` of each document's words."""
        out = [(UNKNOWN, 0.0, [])] * len(found)
        found = [x[likely.informs[x]] for x in found]
        held = [k for k, x in enumerate(found) if len(x)]
        if held and many:
            words, times = zip(*(np.unique(found[k], return_counts=True) for k in held), strict=True)
            of, times = np.repeat(np.arange(len(held)), [len(x) for x in words]), np.concatenate(times)
            logs = likely.values[np.concatenate(words)].astype(np.float64)
            logs -= logs.max(axis=1, keepdims=True)
            votes = np.bincount(of * many + logs.argmax(axis=1), times, len(held) * many).reshape(-1, many)
            single = _by_document(logs * times[:, None], of, len(held))
            short = shortlist(votes, single)
            for k, row in zip(held, named(short, logs if many <= SHORT else np.take_along_axis(logs, short[of], axis=1), times, of, single), strict=True):
                out[k] = row
        return out

    def one(text: bytes) -> tuple[str, float, list[dict]]:
        """A very long text: its distinct words, by parts that aren't remembered, twice."""
        counter: Counter[str] = Counter()
        for part in _parts(text):
            counter.update(words_of(part))
        words, size = list(counter), max(1, CHUNK // max(many, 1))
        times = np.fromiter(counter.values(), np.int64, len(words))
        del counter
        votes, single, informs = np.zeros((1, many)), np.zeros((1, many)), np.zeros(len(words), bool)

        def blocks() -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
            for k in range(0, len(words), size):
                values, told = likely.compute(words[k : k + size])
                logs = values[told].astype(np.float64)
                yield slice(k, k + size), told, logs - logs.max(axis=1, keepdims=True)

        if many:
            for at, told, logs in blocks():
                informs[at] = told
                if told.any():
                    n = times[at][told]
                    votes[0] += np.bincount(logs.argmax(axis=1), n, many)
                    single[0] += (logs * n[:, None]).sum(axis=0)
        if not informs.any():
            return UNKNOWN, 0.0, []
        short = shortlist(votes, single)
        logs = np.concatenate([found[:, short[0]].astype(np.float32) for _, _, found in blocks()])
        return next(named(short, logs, times[informs], np.zeros(len(logs), np.int64), single))

    def every(texts: list[bytes]) -> tuple[list[str], list[float], list[list[dict]]]:
        out, waiting, n = [], [], 0
        for k, text in enumerate(texts):
            long = len(text) > PART
            if not long:
                waiting.append(likely.of(words_of(text.decode("utf-8", "replace"))))
                n += len(waiting[-1]) * many
            if waiting and (long or n >= CHUNK or k == len(texts) - 1):
                out += several(waiting)
                waiting, n = [], 0
                if len(likely.places) > likely.most:
                    likely.clear()
            if long:
                out.append(one(text))
        pred, score, shares = zip(*out, strict=True) if out else ((), (), ())
        return list(pred), list(score), list(shares)

    return every


def _sent(docs: DataFrame, model: Model) -> Broadcast[Model]:
    """The model, of ``table_bytes`` at most, sent to each executor once."""
    return docs.sparkSession.sparkContext.broadcast(model)


def identify(docs: DataFrame, model: Model, penalty: float = 2.0, modulus: int = 4, fold: int = 2) -> DataFrame:
    """Predict every whole text's language: doc_id, held_out, lang_pred, score and the chosen languages' shares."""

    held_model = _sent(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = predictor(held_model.value, penalty)
        for batch in batches:
            pred, score, shares = of(batch.column("text").to_pylist())
            held = [fold_of(x, modulus) == fold for x in batch.column("doc_id").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(held, pa.bool_()), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(shares, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))],
                names=["doc_id", "held_out", "lang_pred", "score", "languages"],
            )

    return slim(docs).mapInArrow(run, PREDICTIONS)


def with_language(docs: DataFrame, model: Model, least_share: float, penalty: float = 2.0) -> DataFrame:
    """The rows of ``docs``, with all columns, that have a language with at least ``least_share`` of the words; each row by its own text."""

    held_model = _sent(docs, model)

    def keep() -> Callable[[list[bytes]], list[bool]]:
        of = predictor(held_model.value, penalty)

        def decide(texts: list[bytes]) -> list[bool]:
            pred, score, _ = of(texts)
            return [p != UNKNOWN and s >= least_share for p, s in zip(pred, score, strict=True)]

        return decide

    return chosen_rows(docs, keep)
