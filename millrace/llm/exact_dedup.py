"""Exact deduplication by Patricia-trie owners.

Texts are equal when their bytes are identical after A-Z is lower-cased. Each input task first merges its
own copies in a trie, so a group with a third of all rows leaves one row per task; the distinct strings
are then dealt out by length and content hash, and each partition inserts the full strings into tries
whose terminal nodes own the group. A row finds its owner by a join on length and digest, which adaptive
execution can split where one group is hot.

Defined cases: a null text equals the empty text; a null identifier never owns a group that has another
identifier, and owns alone (as null) otherwise; rows that repeat an identifier and its text count as
copies of one another and share their ``kept``; further columns are ignored; an empty table gives no rows.
A text of any length is inserted whole; a few of the longest have to fit in a task's memory, the rest spills
to a file of the task, which is lost and made again with it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import ROW, numbered, rows, slim, slices
from millrace.llm.patricia import PatriciaTrie

_PART = "n_bytes long, content_hash long, text binary, owner long, copies long"
_OWNER = "n_bytes long, text_sha256 string, keep_id long, group_size long"
_KEY = "doc_id long, n_bytes long, text_sha256 string"
_ARROW = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
#: Bytes of strings that leave a task in one batch.
BATCH_BYTES = 8 << 20


def _arrow(ddl: str) -> pa.Schema:
    return pa.schema([(n, _ARROW[t]) for n, t in (x.split() for x in ddl.split(", "))])


def owners(df: DataFrame, keep: str = "min", trie_bytes: int = 96 << 20) -> DataFrame:
    """One row per distinct normalised text: its length and digest, the identifier that stays and the group's size.

    ``df`` has doc_id and text (binary) as :func:`~millrace.llm.common.slim` makes them; ``keep`` is ``min`` or ``max``.
    """
    choose = {"min": min, "max": max}[keep]

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, trie = _arrow(_PART), PatriciaTrie(choose, trie_bytes)
        for batch in batches:
            for doc_id, text in rows(batch):
                trie.insert(text.lower(), doc_id)  # bytes.lower() changes A-Z only
        out, size = {n: [] for n in schema.names}, 0
        for text, owner, copies in trie.groups():
            key = int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)
            for name, value in zip(schema.names, (len(text), key, text, owner, copies), strict=True):
                out[name].append(value)
            size += len(text)
            if size > BATCH_BYTES:
                yield from slices(out, schema)
                out, size = {n: [] for n in schema.names}, 0
        yield from slices(out, schema)

    def resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, trie = _arrow(_OWNER), PatriciaTrie(choose, trie_bytes)
        for batch in batches:
            for text, owner, copies in zip(*(batch.column(x).to_pylist() for x in ("text", "owner", "copies")), strict=True):
                trie.insert(text, owner, copies)
        out = {n: [] for n in schema.names}
        for text, owner, copies in trie.groups():
            for name, value in zip(schema.names, (len(text), hashlib.sha256(text).hexdigest(), owner, copies), strict=True):
                out[name].append(value)
            if len(out["keep_id"]) == 10_000:
                yield from slices(out, schema, 10_000)
                out = {n: [] for n in schema.names}
        yield from slices(out, schema, 10_000)

    parts = df.mapInArrow(merged, _PART)
    return parts.repartition("n_bytes", "content_hash").mapInArrow(resolved, _OWNER)


def keys(df: DataFrame) -> DataFrame:
    """The length and digest of each row's normalised text."""

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _arrow(_KEY)
        for batch in batches:
            texts = [x.lower() for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) for x in texts], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in texts])], schema=schema)

    return df.mapInArrow(digested, _KEY)


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", trie_bytes: int = 96 << 20) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept and text_sha256 of the normalised text."""
    texts = slim(df, id_col, text_col)
    found = keys(texts).join(owners(texts, keep, trie_bytes), ["n_bytes", "text_sha256"])
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, keep: str = "min") -> DataFrame:
    """One row of ``docs`` for each text, with all columns: the owner's, and of several such rows the first as they were written."""
    each = numbered(docs)
    found = keys(slim(each, ROW)).withColumnRenamed("doc_id", ROW)
    owned = found.join(each.select(ROW, F.col("doc_id").cast("long").alias("doc_id")), ROW).join(owners(slim(each), keep), ["n_bytes", "text_sha256"])
    first = owned.filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("n_bytes", "text_sha256").agg(F.min(ROW).alias(ROW))
    return each.join(first.select(ROW), ROW, "left_semi").drop(ROW)
