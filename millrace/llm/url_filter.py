"""URL filters: rules by host and path where one fits, and a ratio of two character models where none does.

The URLs that a rule allows and those that one blocks each train a Markov model of bytes of variable order: how
often a byte follows the 0 to ``ORDER`` bytes before it. The shorter contexts smooth the longer ones in the manner
of Witten and Bell, with as much weight as a context has different followers; a context that a model hasn't
seen is passed over. What tells the two apart is the difference of a URL's log-likelihoods over its length,
calibrated by a logistic curve on a fifth of the URLs with rules, kept out of the counts, in which both sides weigh alike.
A URL without a rule is allowed if its calibrated probability is one half or more.

Counts are over all URLs with rules, summed in tasks before they are shuffled. Every task gets those that were seen m times
or more, m the least power of two by which at most ``most_entries`` remain. The rarer ones stay in a table in the
shared folder, and a URL that needs some of them gets them by a join, so all counts decide, whatever their number. The list of rules is part of the program: :func:`judge` takes up
to ``MOST_RULES`` and says so if there are more.

Defined cases: a null URL, or one without ``://``, has an empty host and path and so no rule; a URL without characters has
difference 0; if either side has no URL to learn from, the difference is 0 for all, and those without a rule are allowed; of
rules of equal length the one of the longer host wins, then a blocking one; a null identifier stays null; rows that
repeat are judged each; further columns are ignored; an empty table gives no rows. A URL of any length is read whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import ROW, numbered, written

#: Bytes of the longest context; contexts of up to 6 fit in a key.
ORDER = 4
MOST_RULES = 100_000
#: Steps of the differences' histogram that the calibration reads: this many on each side of 0, each so wide.
_BINS, _WIDTH = 2000, 0.005
_VERDICTS = "page_id long, host string, path string, rule string, verdict string, probability double"
_U = np.uint64
_CONTEXT = 1 << 60
_ENTRIES = "key long, allowed long, blocked long, allowed_kinds long, blocked_kinds long"


class Rule(NamedTuple):
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


class Rules:
    """Finds the longest rule for a host and a path: a rule holds for its host and all hosts below it, and for paths that begin with its own."""

    def __init__(self, rules: list[Rule]) -> None:
        if len(rules) > MOST_RULES:
            raise ValueError(f"{len(rules)} rules; {MOST_RULES} at most go to every task")
        self.best: dict[tuple[str, str], Rule] = {}
        for rule in sorted(rules):  # of two with one host and path the blocking one stays
            self.best[rule.host, rule.path] = rule
        sizes: dict[str, set[int]] = {}
        for host, path in self.best:
            sizes.setdefault(host, set()).add(len(path))
        self.sizes = {host: sorted(found, reverse=True) for host, found in sizes.items()}

    def find(self, host: str, path: str) -> Rule | None:
        found, length = None, -1
        while host:
            for size in self.sizes.get(host, ()):
                if size <= len(path) and (host, path[:size]) in self.best:
                    if len(host) + size > length:  # longer hosts come first
                        found, length = self.best[host, path[:size]], len(host) + size
                    break
            host = host.partition(".")[2]
        return found


class Model(NamedTuple):
    """Counts of (context and byte) for allowed and blocked URLs, sums of the contexts, the calibrating line, and the table of the entries that are too rare to be held."""

    keys: np.ndarray
    counts: np.ndarray  # keys x 2
    contexts: np.ndarray
    totals: np.ndarray  # contexts x 2: how often each was seen
    kinds: np.ndarray  # contexts x 2: different bytes that followed it
    slope: float = 1.0
    shift: float = 0.0
    rest: DataFrame | None = None  # _ENTRIES; contexts have the bit _CONTEXT


def windows(urls: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For order 0 to ORDER the keys of all (context and byte) of all URLs, and where each URL's begin.

    A key holds the order and the bytes. A URL begins after ORDER zero bytes and ends with one.
    """
    raw = b"".join(b"\0" * ORDER + u + b"\0" for u in urls)
    data = np.frombuffer(raw, np.uint8).astype(_U)
    sizes = np.fromiter(map(len, urls), np.int64, len(urls))
    ends = np.cumsum(sizes + ORDER + 1)
    begins = np.concatenate([[0], np.cumsum(sizes + 1)])
    at = np.arange(begins[-1]) + np.repeat(ends - sizes - 1 - begins[:-1], sizes + 1)
    keys = np.empty((ORDER + 1, len(at)), _U)
    key = np.zeros(len(at), _U)
    for order in range(ORDER + 1):
        key = key | data[at - order] << _U(8 * order)
        keys[order] = key | _U(order) << _U(56)
    return keys, begins


def _contexts(keys: np.ndarray) -> np.ndarray:
    return keys >> _U(56) << _U(56) | (keys & _U((1 << 56) - 1)) >> _U(8)


def model_of(entries: pa.Table | pa.RecordBatch) -> Model:
    """A model of rows of ``_ENTRIES``, each key once."""
    column = lambda name: entries.column(name).to_numpy()
    keys = column("key").astype(_U)
    of_context = (keys & _U(_CONTEXT)) > 0
    sums = np.stack([column("allowed"), column("blocked")], axis=1).astype(np.float64)
    kinds = np.stack([column("allowed_kinds"), column("blocked_kinds")], axis=1).astype(np.float64)
    own, contexts = np.flatnonzero(~of_context), np.flatnonzero(of_context)
    own, contexts = own[np.argsort(keys[own])], contexts[np.argsort(keys[contexts])]
    return Model(keys[own], sums[own], keys[contexts] & ~_U(_CONTEXT), sums[contexts], kinds[contexts])


def _at(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where ``keys`` are in ``table``, and whether they are."""
    at = np.minimum(np.searchsorted(table, keys), max(len(table) - 1, 0))
    return at, table[at] == keys if len(table) else np.zeros(keys.shape, bool)


def _found(table: np.ndarray, values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The rows of ``values`` for ``keys``, zero where ``table`` has none."""
    at, there = _at(table, keys)
    return np.where(there[:, None], values[at], 0.0) if len(table) else np.zeros((len(keys), 2))


def missing(model: Model, urls: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The entries that ``urls`` would need beyond those that the model holds, each once for a URL: the URL's place and the key."""
    keys, begins = windows(urls)
    contexts = _contexts(keys)
    absent = np.concatenate([~_at(model.keys, keys)[1], ~_at(model.contexts, contexts)[1]])
    wanted = np.concatenate([keys, contexts | _U(_CONTEXT)])[absent]
    url = np.broadcast_to(np.repeat(np.arange(len(urls)), np.diff(begins)), absent.shape)[absent]
    order = np.lexsort((wanted, url))
    url, wanted = url[order], wanted[order]
    first = np.append(True, (url[1:] != url[:-1]) | (wanted[1:] != wanted[:-1]))[: len(url)]
    return url[first], wanted[first]


def differences(model: Model, urls: list[bytes], more: Model | None = None) -> np.ndarray:
    """Per URL: log-likelihood as an allowed one less that as a blocked one, over its number of bytes; 0 for one without any. ``more``: entries that the model doesn't hold."""
    if not urls or not len(model.keys) or not (model.counts.sum(axis=0) > 0).all():
        return np.zeros(len(urls))
    keys, begins = windows(urls)
    p = np.full((keys.shape[1], 2), 1 / 256)
    for order in range(ORDER + 1):
        context = _contexts(keys[order])
        n, d, c = _found(model.contexts, model.totals, context), _found(model.contexts, model.kinds, context), _found(model.keys, model.counts, keys[order])
        if more:  # an entry is in one of the two
            n, d, c = n + _found(more.contexts, more.totals, context), d + _found(more.contexts, more.kinds, context), c + _found(more.keys, more.counts, keys[order])
        p = np.where(n > 0, (c + d * p) / np.maximum(n + d, 1.0), p)
    logs = np.log(p)
    total = np.add.reduceat(logs[:, 0] - logs[:, 1], begins[:-1])
    size = np.diff(begins) - 1
    return np.where(size > 0, total / np.maximum(size, 1), 0.0)


def probabilities(model: Model, difference: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(model.slope * difference + model.shift, -700, 700)))


def parts(pages: DataFrame) -> DataFrame:
    """page_id, url, host (lower case) and path of every row."""
    url, shape = F.coalesce(F.col("url").cast("string"), F.lit("")), r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, shape, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), host.alias("host"), F.regexp_extract(url, shape, 2).alias("path"))


def _with_rest(urls: DataFrame, model: Model) -> DataFrame:
    """``urls`` with the rare entries that each needs, as a list ``more``; as they are if the model holds all."""
    if model.rest is None:
        return urls
    rows, held = numbered(urls), urls.sparkSession.sparkContext.broadcast(model._replace(rest=None))

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 2000):
                batch = whole.slice(k, 2000)
                url, keys = missing(held.value, [u.encode() for u in batch.column("url").to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(ROW).take(pa.array(url)), pa.array(keys.astype(np.int64))], names=[ROW, "key"])

    asked = rows.select(ROW, "url").mapInArrow(wanted, f"{ROW} long, key long")
    entry = F.struct(*(x.split()[0] for x in _ENTRIES.split(", ")))
    return rows.join(asked.join(model.rest, "key").groupBy(ROW).agg(F.collect_list(entry).alias("more")), ROW, "left").drop(ROW)  # a URL's own entries


def _more(batch: pa.RecordBatch) -> Model | None:
    """The rare entries that came with a batch's URLs."""
    if "more" not in batch.schema.names:
        return None
    entries = pa.Table.from_struct_array(batch.column("more").flatten())
    _, first = np.unique(entries.column("key").to_numpy(), return_index=True)
    return model_of(entries.take(pa.array(first)))


def _texts(batch: pa.RecordBatch, of: Rules) -> tuple[list[bytes], list[Rule | None]]:
    found = [of.find(h, p) for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)]
    return [u.encode() for u in batch.column("url").to_pylist()], found


def _labelled(urls: DataFrame, rules: list[Rule], held_out: bool, modulus: int, each: Callable) -> Callable:
    """A task's function: ``each(urls, allowed, more)`` for every batch of the URLs with a rule, of the fold that is held out or of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Rules(rules)
        for whole in batches:
            for k in range(0, whole.num_rows, 2000):
                batch = whole.slice(k, 2000)
                texts, found = _texts(batch, of)
                own = [(u, r.verdict == "allow") for u, r in zip(texts, found, strict=True) if r and (crc32(u) % modulus == 0) == held_out]
                if own:
                    yield each([u for u, _ in own], np.array([a for _, a in own]), _more(batch))

    return run


def _counts(urls: list[bytes], allowed: np.ndarray, _: Model | None) -> pa.RecordBatch:
    keys, begins = windows(urls)
    side = np.tile(np.repeat(allowed, np.diff(begins)), ORDER + 1)
    found, where = np.unique(keys.ravel(), return_inverse=True)
    n = [np.bincount(where[side == s], minlength=len(found)) for s in (True, False)]
    return pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(n[0]), pa.array(n[1])], names=["key", "allowed", "blocked"])


def calibrated(n: np.ndarray, value: np.ndarray, allowed: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and shift of the logistic curve through weighted differences, in which both sides weigh alike; 1 and 0 if one is missing."""
    if not n[allowed].sum() or not n[~allowed].sum():
        return 1.0, 0.0
    w = np.where(allowed, n / n[allowed].sum(), n / n[~allowed].sum()) / 2
    x = np.stack([value, np.ones(len(value))], axis=1)
    line, prior = np.array([1.0, 0.0]), np.diag([ridge, ridge])

    def loss(line: np.ndarray) -> float:
        z = x @ line
        return float((w * (np.logaddexp(0, z) - allowed * z)).sum() + line @ prior @ line / 2)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ line, -700, 700)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + prior, x.T @ (w * (p - allowed)) + prior @ line)
        scale = 1.0
        while scale > 1e-6 and loss(line - scale * step) > loss(line):
            scale /= 2
        line = line - scale * step
        if abs(scale * step).max() < 1e-10:
            break
    return float(line[0]), float(line[1])


def fit(pages: DataFrame, rules: list[Rule], most_entries: int = 1_000_000, modulus: int = 5) -> Model:
    """Count over all URLs with rules outside the fold that is held out, and calibrate on that one."""
    urls, spark = parts(pages).select("url", "host", "path"), pages.sparkSession
    counts = urls.mapInArrow(_labelled(urls, rules, False, modulus, _counts), "key long, allowed long, blocked long").groupBy("key").agg(F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked"))
    counts = written(counts, "contexts")
    order = F.shiftleft(F.shiftright("key", 56), 56)
    context = (order.bitwiseOR(F.shiftright(F.col("key") - order, 8)) + _CONTEXT).alias("key")
    of_contexts = counts.groupBy(context).agg(F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked"), F.count_if(F.col("allowed") > 0).alias("allowed_kinds"), F.count_if(F.col("blocked") > 0).alias("blocked_kinds"))
    entries = written(counts.select("*", F.lit(0).cast("long").alias("allowed_kinds"), F.lit(0).cast("long").alias("blocked_kinds")).unionByName(of_contexts), "entries")
    seen_times = F.col("allowed") + F.col("blocked")
    sizes = entries.groupBy(F.floor(F.log2(seen_times.cast("double"))).alias("power")).count().collect()  # 63 rows at most
    least, left = 0, sum(r["count"] for r in sizes)
    for power, n in sorted((r["power"], r["count"]) for r in sizes):
        if left <= most_entries:
            break
        least, left = power + 1, left - n
    often = (seen_times >= 1 << least) | (F.shiftright(F.col("key").bitwiseAND(_CONTEXT - 1), 56) == 0)
    model = model_of(entries.filter(often).toArrow())
    held = spark.sparkContext.broadcast(model)
    if least:
        model = model._replace(rest=entries.filter(~often))

    def places(urls: list[bytes], allowed: np.ndarray, more: Model | None) -> pa.RecordBatch:
        place = np.clip(np.rint(differences(held.value, urls, more) / _WIDTH), -_BINS, _BINS).astype(np.int64)
        found, n = np.unique(place * 2 + allowed, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], names=["place", "n"])

    seen = _with_rest(urls, model).mapInArrow(_labelled(urls, rules, True, modulus, places), "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).orderBy("place").toArrow()
    place, n = seen.column("place").to_numpy(), seen.column("n").to_numpy()
    slope, shift = calibrated(n.astype(float), (place >> 1) * _WIDTH, (place & 1).astype(bool))
    return model._replace(slope=slope, shift=shift)


def judge(pages: DataFrame, rules: list[Rule], model: Model) -> DataFrame:
    """Per row: page_id, host, path, the rule that holds, the verdict and the probability that the models give for ``allow``."""
    held = pages.sparkSession.sparkContext.broadcast(model._replace(rest=None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Rules(rules)
        for whole in batches:
            for k in range(0, whole.num_rows, 2000):
                batch = whole.slice(k, 2000)
                texts, found = _texts(batch, of)
                likely = probabilities(held.value, differences(held.value, texts, _more(batch)))
                verdict = [r.verdict if r else "allow" if p >= 0.5 else "block" for r, p in zip(found, likely, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("page_id"), batch.column("host"), batch.column("path"), pa.array([r and r.text for r in found], pa.string()), pa.array(verdict, pa.string()), pa.array(likely, pa.float64())],
                    names=["page_id", "host", "path", "rule", "verdict", "probability"],
                )

    return _with_rest(parts(pages), model).mapInArrow(run, _VERDICTS)
