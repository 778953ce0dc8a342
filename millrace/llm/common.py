"""Helpers shared by the corpus operators: shared folders, column hygiene and Arrow access to texts."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or on a single machine (tests) one of our own where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own_dirs:
            _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="millrace-")
            spark.sparkContext.setCheckpointDir(_own_dirs[app])
        found = _own_dirs[app]
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/millrace-{name}-{uuid.uuid4().hex}"


#: Fewest files that a table of few rows is written as, and rows (of a few numbers each) of one such file at most.
FILES, FILE_ROWS = 16, 1 << 18


def written(df: DataFrame, name: str, most_rows: int | None = None) -> DataFrame:
    """Cut the lineage of ``df``: write it once as Parquet in the shared folder and read it back.

    ``most_rows``, where it is given, is the most rows (of a few numbers each, or what weighs as much) that ``df`` can have: many small
    partitions are then written as few files, as each costs its executor new processes on a local file system, and requests on others.
    """
    if most_rows is not None:
        df = df.coalesce(max(FILES, -(-most_rows // FILE_ROWS)))
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = 500_000) -> DataFrame:
    """``df`` written, and broadcast if it has at most ``most`` rows (of a few numbers each); beyond that it is joined by shuffles."""
    out = written(df, "small")
    return F.broadcast(out) if out.limit(most + 1).count() <= most else out


#: The column of :func:`numbered`.
ROW = "__row"


def numbered(docs: DataFrame) -> DataFrame:
    """``docs``, written with a number for each row, so that decisions can be taken for rows whose identifiers repeat or are null."""
    return written(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")


def chosen_rows(docs: DataFrame, keep: Callable[[], Callable[[list[bytes]], list[bool]]], text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, whose texts ``keep`` says yes to; null texts are empty. ``keep()`` makes a task's function."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decide = keep()
        for batch in batches:
            texts = [b"" if x is None else x.encode() if isinstance(x, str) else x for x in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(decide(texts), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def slim(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the identifier (long) and the text's UTF-8 bytes; a null text becomes empty."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))


class Memory(dict):
    """Results by key (a word or chunk), for one worker; a missing one is computed, and listed in ``new``."""

    def __init__(self, compute: Callable, entries: int = 250_000, size: int = 16 << 20) -> None:
        """It starts anew beyond ``entries`` or ``size`` bytes of keys; the results are of the order of their keys."""
        super().__init__()
        self.compute, self.entries, self.size, self.new, self.held = compute, entries, size, [], 0

    def __missing__(self, key: str):
        found = self[key] = self.compute(key)
        self.new.append(key)
        self.held += len(key)
        return found

    def trim(self) -> None:
        """To be called between texts: what a text has brought is held until then."""
        self.new.clear()
        if len(self) > self.entries or self.held > self.size:
            self.clear()
            self.held = 0


def id_fold(id_col: str | Column, modulus: int) -> Column:
    """crc32 of the identifier written in decimal, modulo ``modulus``; a null identifier counts as empty text."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % modulus


def fold_of(doc_id: int | None, modulus: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column, end to end, and its n+1 offsets; no copy of the payload. Nulls have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def rows(batch: pa.RecordBatch) -> Iterator[tuple[int | None, bytes]]:
    """(doc_id, text bytes) of a batch made by :func:`slim`."""
    yield from zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)


def slices(columns: dict[str, list], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    """Record batches of at most ``size`` rows from equally long lists."""
    n = len(next(iter(columns.values())))
    for k in range(0, n, size):
        yield pa.RecordBatch.from_arrays([pa.array(columns[f.name][k : k + size], f.type) for f in schema], schema=schema)
