"""Toxicity as multiple-instance learning: a document is toxic if one of its sentences is.

A sentence has a logistic score over its words and their first letters; a document's score is the noisy-or
of its sentences, 1 minus the product of (1 - p); a sentence with no word of known weight has p = 0, so a
text's length alone never makes it toxic. Only documents carry labels; the gradient goes through
the noisy-or, so it is the model that finds which sentences offend. Features are chosen by their
association with the label and the model is fitted on a bounded sample of labelled documents (``most``
of each label and ``most_bytes`` of their texts, weighted to stand for all); scoring takes every whole text.

A sentence is what lies between two of ``.!?`` and line breaks and isn't blank. Defined cases: a null, empty or
blank text has no sentence and scores 0; with no toxic or no other example all scores are 0; a null identifier
falls in the fold of the empty text; labels that repeat for a document count as their largest, and any label over
0 is toxic; rows that repeat give repeated rows; further columns are ignored; an empty table gives no rows. A text of any
length is scored whole, sentence by sentence; one that exceeds a sixteenth of ``most_bytes`` isn't learned from.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Memory, chosen_rows, fold_of, id_fold, slim, written
from millrace.llm.sampling import bounded

_SPLIT = re.compile(r"[.!?\n]+")
_SENTENCE = re.compile(r"[^.!?\n]+")
_EDGE = "\"'`()[]{}<>,;:-_*#…«»“”‘’¡¿"
#: Lengths of word beginnings that are features beside the whole word.
PREFIXES = (4, 5, 6)
SCORES = "doc_id long, held_out boolean, score double, predicted int, n_sentences long, offending array<struct<start:int,end:int,score:double>>"


def word_features(word: str) -> list[str]:
    word = word.strip(_EDGE)
    return [word + "$", *(word[:k] for k in PREFIXES if len(word) >= k)] if word else []


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float

    def word_weight(self, word: str) -> float | None:
        """The sum of the word's known features; None if there is none."""
        found = [self.weights[f] for f in word_features(word) if f in self.weights]
        return sum(found) if found else None


def training_rows(docs: DataFrame, labels: DataFrame, most: int, most_bytes: int, modulus: int = 4, fold: int = 2) -> DataFrame:
    """doc_id, text, toxic and weight of the bounded sample outside the held-out fold.

    About ``most`` documents of each label, and of these, by a hash, as many as fill about ``most_bytes``;
    a document with more than a sixteenth of that is never among them.
    """
    known = labels.filter("toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic").cast("int") > 0).cast("int").alias("toxic")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = bounded(known.filter(id_fold("doc_id", modulus) != fold), "toxic", most, F.col("doc_id"))
    # at most about 2 * most rows, whatever the size of the tables
    found = written(slim(docs).join(F.broadcast(chosen), "doc_id"), "labelled")
    sizes = found.groupBy("doc_id", "toxic", "weight").agg(F.sum(F.octet_length("text")).alias("n_bytes"))
    short = sizes.filter(F.col("n_bytes") <= most_bytes // 16)
    share = F.broadcast(short.groupBy("toxic").agg(F.least(F.lit(1.0), F.lit(float(most_bytes)) / F.sum("n_bytes")).alias("share")))  # two rows
    place = F.xxhash64(F.lit("bytes"), "doc_id") / F.lit(2.0**64) + F.lit(0.5)
    fits = short.join(share, "toxic").filter((F.col("share") >= 1) | (place < F.col("share")))
    all_of, kept_of = sizes.groupBy("toxic").agg(F.sum("weight").alias("all")), fits.groupBy("toxic").agg(F.sum("weight").alias("kept"))
    scale = all_of.join(F.broadcast(kept_of), "toxic").select("toxic", (F.col("all") / F.col("kept")).alias("scale"))
    kept = fits.select("doc_id", "toxic").join(F.broadcast(scale), "toxic").select("doc_id", "scale")
    return found.join(F.broadcast(kept), "doc_id").select("doc_id", "text", "toxic", (F.col("weight") * F.col("scale")).alias("weight"))


def _associations(sample: DataFrame) -> DataFrame:
    """Per feature: the weight of toxic and of other documents that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Memory(word_features)
        counts: dict[str, list[float]] = {}
        for batch in batches:
            for text, toxic, weight in zip(*(batch.column(x).to_pylist() for x in ("text", "toxic", "weight")), strict=True):
                for f in {f for w in set(_SPLIT.sub(" ", text.decode("utf-8", "replace").lower()).split()) for f in memory[w]}:
                    counts.setdefault(f, [0.0, 0.0])[toxic] += weight
            memory.trim()
        names = list(counts)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([counts[x][0] for x in names], pa.float64()), pa.array([counts[x][1] for x in names], pa.float64())], names=["feature", "others", "toxics"])

    return sample.mapInArrow(run, "feature string, others double, toxics double").groupBy("feature").agg(F.sum("others").alias("others"), F.sum("toxics").alias("toxics"))


def chosen_features(sample: DataFrame, totals: tuple[float, float], most: int, least_documents: float, lift: float) -> dict[str, float]:
    """The features most associated with toxic documents, by the G-test's leading term, and the log of their lift."""
    others, toxics = totals
    p, q = F.col("toxics") / toxics, (F.col("others") + 0.5) / (others + 1)
    found = _associations(sample).filter((F.col("toxics") >= least_documents) & (p > lift * q)).withColumn("log_lift", F.log(p / q)).withColumn("gain", F.col("toxics") * F.col("log_lift"))
    return {r["feature"]: r["log_lift"] for r in found.orderBy(F.desc("gain"), "feature").limit(most).collect()}


def _bags(sample: DataFrame, features: list[str]) -> DataFrame:
    """Per document: its label and weight, and the features of each sentence that has some."""
    places = {f: k for k, f in enumerate(features)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Memory(lambda w: [places[f] for f in word_features(w) if f in places])
        for batch in batches:
            held = []
            for text in batch.column("text").to_pylist():
                bags = [[f for w in s.split() for f in memory[w]] for s in _SPLIT.split(text.decode("utf-8", "replace").lower())]
                held.append([b for b in bags if b])
            memory.trim()
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), batch.column("weight"), pa.array(held, pa.list_(pa.list_(pa.int32())))], names=["toxic", "weight", "bags"])

    return sample.mapInArrow(run, "toxic int, weight double, bags array<array<int>>")


def fit(docs: DataFrame, labels: DataFrame, most: int = 10_000, most_bytes: int = 128 << 20, features: int = 4096, least_documents: float = 4.0, lift: float = 4.0, steps: int = 400, rate: float = 0.1, pull: float = 3e-4) -> Model:
    """Fit the sentence model on at most about ``most`` documents, and ``most_bytes``, of each label.

    Weights start at, and are pulled (by ``pull``) towards, the features' log lift shared among a word's
    features: a word that always comes with a stronger one would else be left without a weight.
    """
    sample = written(training_rows(docs, labels, most, most_bytes), "toxicity")
    totals = {r["toxic"]: r["w"] for r in sample.groupBy("toxic").agg(F.sum("weight").alias("w")).collect()}
    if not totals.get(0) or not totals.get(1):
        return Model({}, -np.inf)
    prior = chosen_features(sample, (totals[0], totals[1]), features, least_documents, lift)
    names = list(prior)
    table = _bags(sample, names).toArrow()
    label, weight = (table.column(x).to_numpy().astype(float) for x in ("toxic", "weight"))
    per_doc = table.column("bags").combine_chunks()
    per_sentence = per_doc.flatten()
    feature = per_sentence.flatten().to_numpy().astype(int)
    n = len(per_sentence)
    docs_of = np.repeat(np.arange(len(label)), pc.list_value_length(per_doc).to_numpy().astype(int))
    sentence = np.repeat(np.arange(n), pc.list_value_length(per_sentence).to_numpy().astype(int))
    start = np.append(np.array([prior[x] for x in names]) / (1 + len(PREFIXES)), -6.0)
    theta = start.copy()
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    weight = weight / weight.sum()
    for t in range(1, steps + 1):
        bias = theta[-1]
        z = bias + np.bincount(sentence, theta[feature], minlength=n)
        s = np.bincount(docs_of, np.logaddexp(0, z), minlength=len(label))
        # of -y*log(1-exp(-s)) + (1-y)*s by s, then by each sentence's z
        slope = weight * np.where(label > 0, -1 / np.expm1(np.clip(s, 1e-9, 500)), 1.0)
        by_z = slope[docs_of] / (1 + np.exp(-z))
        grad = np.append(np.bincount(feature, by_z[sentence], minlength=len(names)), by_z.sum()) + pull * np.append(theta[:-1] - start[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(dict(zip(names, theta[:-1].tolist(), strict=True)), float(theta[-1]))


def score_text(text: str, weight_of: Memory, bias: float, threshold: float) -> tuple[float, int, list[dict]]:
    """Noisy-or score, sentences, and the spans (in code points) of the sentences that reach the threshold."""
    words = [x for s in _SPLIT.split(text.lower()) if (x := s.split())]
    if bias == -np.inf:
        return 0.0, len(words), []
    known = [w for s in words if (w := [x for x in map(weight_of.__getitem__, s) if x is not None])]
    z = np.array([sum(x) for x in known]) + bias
    found, least = [], np.log(threshold / (1 - threshold))
    if len(z) and z.max() >= least:
        for span in _SENTENCE.finditer(text):
            w = [x for x in map(weight_of.__getitem__, span[0].lower().split()) if x is not None]
            if w and bias + sum(w) >= least:
                found.append({"start": span.start(), "end": span.end(), "score": float(1 / (1 + np.exp(-bias - sum(w))))})
    return float(-np.expm1(-np.logaddexp(0, z).sum())), len(words), found


def scorer(model: Model, threshold: float) -> Callable[[list[bytes]], list[tuple[float, int, list[dict]]]]:
    """For one task: a function from texts to what :func:`score_text` says of each."""
    memory = Memory(model.word_weight)

    def score(texts: list[bytes]) -> list[tuple[float, int, list[dict]]]:
        out = []
        for text in texts:
            out.append(score_text(text.decode("utf-8", "replace"), memory, model.bias, threshold))
            memory.trim()
        return out

    return score


def toxicity(docs: DataFrame, model: Model, threshold: float = 0.3, modulus: int = 4, fold: int = 2) -> DataFrame:
    """Score every whole text: doc_id, held_out, score, predicted, n_sentences and the offending sentences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = scorer(model, threshold)
        for batch in batches:
            ids = batch.column("doc_id")
            score, n, spans = zip(*found, strict=True) if (found := of(batch.column("text").to_pylist())) else ((), (), ())
            held = [fold_of(x, modulus) == fold for x in ids.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(held, pa.bool_()), pa.array(score, pa.float64()), pa.array([int(x >= threshold) for x in score], pa.int32()), pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))],
                names=["doc_id", "held_out", "score", "predicted", "n_sentences", "offending"],
            )

    return slim(docs).mapInArrow(run, SCORES)


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, with all columns, that score below ``threshold``; each row by its own text, whatever its identifier."""

    def keep() -> Callable[[list[bytes]], list[bool]]:
        of = scorer(model, threshold)
        return lambda texts: [x < threshold for x, _, _ in of(texts)]

    return chosen_rows(docs, keep)
