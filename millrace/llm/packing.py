"""Packing of documents into sequences of a fixed number of tokens, planned as a cutting-stock problem.

One pass turns every whole text into identifiers and keeps, per document, only its length and check sums:
of each full sequence it fills by itself, and of the rest up to every grid position. The histogram of the
rests' lengths (a fixed number of classes) is planned on the driver by
:mod:`~millrace.llm.cutting_stock`; the plan has a bounded number of runs and is the one thing broadcast.
Every rest gets its rank within its class from counts per task, and so its place in the plan without a
sort of the class; cut pieces get their check sums by combining those at the grid positions.

Rests of up to ``SHORT`` tokens are planned by their exact lengths and fill sequences of their own, as pieces that small
leave next to nothing empty; a longer one reserves its length rounded up to ``UNIT`` tokens, under 3 % of it.

Defined cases: a null or empty text has the end identifier only; strings of special tokens such as
``<|endoftext|>`` are ordinary text; a null identifier stays null; rows that repeat are packed each; further
columns are ignored; an empty table gives no pieces. A text of any length is encoded whole in its task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import rows, slim, written
from millrace.llm.cutting_stock import plan

#: Tokens per class of the histogram, tokens between positions where a rest may be cut, and rests whose lengths are classes of their own.
UNIT, GRID, SHORT = 8, 64, 256
_LENGTHS = "doc_id long, doc_tokens long, part int, full_first long, full_crcs array<long>, class int, class_index long, rest_crcs array<long>"
_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long"


class Packing(NamedTuple):
    """A tokenizer by its vocabulary file (a ``tokenizers`` JSON or the same vocabulary as tiktoken ranks), the identifier that ends a document and the tokens of a sequence."""

    vocabulary: str
    pattern: str
    end_id: int = 1
    tokens: int = 2048


@lru_cache(maxsize=2)
def encoder(vocabulary: str, pattern: str):
    """A function from a text to its identifiers as an array; strings of special tokens are ordinary text."""
    if vocabulary.endswith(".json"):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(vocabulary)
        library.encode_special_tokens = True
        return lambda text: np.array(library.encode(text, add_special_tokens=False).ids, np.uint32)
    import base64

    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("millrace", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return lambda text: library.encode_to_numpy(text, disallowed_special=())


def _ids(text: bytes, how: Packing) -> np.ndarray:
    return np.append(encoder(how.vocabulary, how.pattern)(text.decode("utf-8", "replace")), how.end_id).astype("<u4")


def class_of(length: int) -> int:
    """0 for none, the length of a short rest, or SHORT more than the units of a longer one."""
    return length if length <= SHORT else SHORT - (-length // UNIT)


def lengths(df: DataFrame, how: Packing) -> DataFrame:
    """Per document: tokens, check sums of its full sequences, and of its rest up to each grid position and its end.

    ``part`` is the task, ``class_index`` and ``full_first`` count the rests of a class and the full sequences
    before this document in its task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, full = TaskContext.get().partitionId(), {}, 0
        schema = pa.schema([("doc_id", pa.int64()), ("doc_tokens", pa.int64()), ("part", pa.int32()), ("full_first", pa.int64()), ("full_crcs", pa.list_(pa.int64())), ("class", pa.int32()), ("class_index", pa.int64()), ("rest_crcs", pa.list_(pa.int64()))])
        for batch in batches:
            out = []
            for doc_id, text in rows(batch):
                ids = _ids(text, how)
                n = len(ids)
                whole = [zlib.crc32(ids[k : k + how.tokens]) for k in range(0, n - how.tokens + 1, how.tokens)]
                rest, crc, crcs = ids[len(whole) * how.tokens :], 0, []
                for k in range(0, len(rest), GRID):
                    crc = zlib.crc32(rest[k : k + GRID], crc)
                    crcs.append(crc)
                size = class_of(len(rest))
                index = seen[size] = seen.get(size, -1) + 1
                out.append((doc_id, n, part, full, whole, size, index, crcs))
                full += len(whole)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)] if out else [pa.array([], f.type) for f in schema], schema=schema)

    return df.mapInArrow(run, _LENGTHS)


def _times_x(b: np.ndarray) -> np.ndarray:
    return (b >> np.uint64(1)) ^ np.where(b & np.uint64(1), np.uint64(0xEDB88320), np.uint64(0))


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials over GF(2) modulo that of crc32, bit-reflected."""
    out = np.zeros(np.broadcast(a, b).shape, np.uint64)
    for bit in range(31, -1, -1):
        out ^= np.where(a >> np.uint64(bit) & np.uint64(1), b, np.uint64(0))
        b = _times_x(b)
    return out


@lru_cache(maxsize=2)
def _powers(tokens: int) -> np.ndarray:
    """What moves a crc32 past 0 .. ``tokens`` identifiers of four bytes."""
    step = np.array([1 << 31], np.uint64)
    for _ in range(32):
        step = _times_x(step)
    out = [np.array([1 << 31], np.uint64)]
    for _ in range(tokens):
        out.append(_product(out[-1], step))
    return np.concatenate(out)


def crc_between(before: np.ndarray, upto: np.ndarray, tokens: np.ndarray, most: int) -> np.ndarray:
    """crc32 of the last ``tokens`` identifiers, from the crc32 of what stands before them and of both together."""
    return _product(_powers(most)[tokens], before.astype(np.uint64)) ^ upto.astype(np.uint64)


def _offsets(counts: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """The sum of ``value`` over the tasks before each, within ``by``: a few rows per task, not per document."""
    before = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(*by, "part", F.coalesce(F.sum(value).over(before), F.lit(0)).alias(name))


def pieces(docs: DataFrame, how: Packing, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset. Every identifier lies in one piece."""
    spark = docs.sparkSession
    found = written(lengths(slim(docs, id_col, text_col), how), "packing")
    rest = found.filter("class > 0")
    per_task = rest.groupBy("class", "part").count()
    counts = np.zeros(SHORT + how.tokens // UNIT + 1, np.int64)
    for row in per_task.groupBy("class").agg(F.sum("count").alias("n")).collect():  # a row for each class
        counts[row["class"]] = row["n"]
    longer, sequences = plan(counts[SHORT + 1 :], how.tokens // UNIT, GRID // UNIT)
    short, more = plan(counts[1 : SHORT + 1], how.tokens, how.tokens, most_steps=600)
    runs = [(SHORT + p.run.origin, p, UNIT, 0) for p in longer] + [(p.run.origin, p, 1, sequences) for p in short]
    sequences += more
    runs = spark.createDataFrame(
        [(of, p.run.first, p.run.first + p.run.count, p.run.start * unit, (p.run.start + p.run.size) * unit, p.run.start + p.run.size == p.run.origin, base + p.sequence, p.times, p.index, p.slot) for of, p, unit, base in runs],
        "class int, rank_from long, rank_to long, cut_from int, cut_to int, last boolean, sequence long, times long, item long, slot long",
    )
    ranked = rest.join(_offsets(per_task, ["class"], "count", "before"), ["class", "part"]).withColumn("rank", F.col("before") + F.col("class_index"))
    item = F.col("item") + F.col("rank") - F.col("rank_from")
    size = F.col("doc_tokens") % how.tokens
    ends = F.when(F.col("last"), size).otherwise(F.col("cut_to")).cast("int")
    crc_at = lambda at: F.when(at == 0, F.lit(0)).otherwise(F.element_at("rest_crcs", F.ceil(at / GRID).cast("int")))
    cut = (
        ranked.join(F.broadcast(runs), (ranked["class"] == runs["class"]) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
        .select(
            "doc_id",
            (F.col("doc_tokens") - size + F.col("cut_from")).alias("start"),
            (ends - F.col("cut_from")).cast("long").alias("length"),
            crc_at(F.col("cut_from")).alias("crc_before"),
            crc_at(ends).alias("crc_upto"),
            "doc_tokens",
            (F.col("sequence") + F.pmod(item, F.col("times"))).alias("sequence_id"),
            (F.col("slot") + F.floor(item / F.col("times"))).alias("slot"),
        )
    )

    def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in ("crc_before", "crc_upto", "length")}
            crc = crc_between(at["crc_before"], at["crc_upto"], at["length"], how.tokens).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("doc_id", "start", "length")), pa.array(crc), *(batch.column(n) for n in ("doc_tokens", "sequence_id", "slot"))], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "slot"])

    # a sequence has at most as many pieces as tokens, so this window never holds a large group
    before = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    packed = cut.mapInArrow(combined, _PIECE + ", slot long").withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).drop("slot")

    per_full = found.groupBy("part").agg(F.sum(F.size("full_crcs")).alias("fulls"))
    base = _offsets(per_full.withColumn("all", F.lit(0)), ["all"], "fulls", "before").drop("all")
    whole = found.filter(F.size("full_crcs") > 0).join(base, "part").select("doc_id", "doc_tokens", (F.col("before") + F.col("full_first")).alias("first"), F.posexplode("full_crcs").alias("k", "ids_crc32"))
    whole = whole.select(
        "doc_id", (F.col("k") * how.tokens).cast("long").alias("start"), F.lit(how.tokens).cast("long").alias("length"), "ids_crc32", "doc_tokens", (F.lit(sequences) + F.col("first") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    return packed.unionByName(whole)


def sequences(docs: DataFrame, packed: DataFrame, how: Packing, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """sequence_id and ids of every sequence of ``packed``: its pieces' identifiers in order. Identifiers of documents must be unique here."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_ids(text, how)[a : a + n].astype(np.int32) for text, a, n in zip(*(batch.column(x).to_pylist() for x in ("text", "start", "length")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("sequence_id"), batch.column("offset"), pa.array(out, pa.list_(pa.int32()))], names=["sequence_id", "offset", "ids"])

    joined = slim(docs, id_col, text_col).join(packed.select("doc_id", "start", "length", "sequence_id", "offset"), "doc_id")
    parts = joined.select("text", "start", "length", "sequence_id", "offset").mapInArrow(cut, "sequence_id long, offset long, ids array<int>")
    return parts.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
