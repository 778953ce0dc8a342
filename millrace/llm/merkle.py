"""A Merkle manifest of a dataset: a tree of digests for each language, one over their roots, and a proof for every row.

Leaves are put in order by ranges, each range a sorted run whose rows count themselves; a few numbers per run
give every leaf its coordinate. From there on a tree is worked on in blocks of ``2 ** STEP`` neighbours: a
task streams its blocks in order, makes each level from the one before it and writes the nodes by level as
Parquet. What is left of a block, one node, is a leaf of the next round, so a tree of any size takes
``log2(n) / STEP`` rounds. Proofs come down the same way: a block's stored nodes, sorted by level and
coordinate, meet the one path from the block's top to the root, and the siblings of every row below are read off.
No task holds more than a block, whatever a language's share of the rows.

A digest is the lower-case hex sha256 of its inputs one after the other, digests as hex text. Two neighbours make
a node; a last one alone is digested alone; a tree of one leaf is that leaf. A row's leaf is made of doc_id, source,
lang, n_chars and text, each ``-`` if null, else its number of UTF-8 bytes, ``:`` and the value.

Defined cases: rows of a null lang are a tree of their own, the first; within a tree a null doc_id comes first, and
rows of one doc_id go by their leaves, so rows that repeat have neighbouring places; a null doc_id counts as empty
text where crc32 chooses rows to tamper with; further columns are ignored; an empty table gives no rows. A
text of any length is digested by the JVM without leaving its row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import id_fold, scratch, small, written

#: Levels of a tree that one round makes.
STEP = 10
_NODE = "key string, n long, level int, pos long, hash binary"
_PATH = "key string, pos long, path array<binary>"
_PROOF = "doc_id long, lang string, leaf string, subroot string, proof_sha256 string, folded_root string, proof array<string>"


def joined(*parts: bytes) -> bytes:
    """The digest of digests, which enter as hex text."""
    return hashlib.sha256("".join(x.hex() for x in parts).encode()).digest()


def height(n: int) -> int:
    """Levels above ``n`` leaves until one node remains."""
    return (n - 1).bit_length()


def fold(leaf: bytes, path: list[bytes]) -> bytes:
    """The root that ``leaf`` leads to. A step of a path is ``L`` or ``R`` and the sibling at that side, empty where there is none, or ``=`` and the digest that a subtree's root should be."""
    for step in path:
        side = step[:1]
        if side != b"=":
            leaf = joined(step[1:], leaf) if side == b"L" else joined(leaf, step[1:]) if side else joined(leaf)
    return leaf


def leaf_of(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """The leaf's digest, as bytes."""

    def field(c: Column) -> Column:
        c = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*map(field, (doc_id, source, lang, n_chars, text))).cast("binary"), 256))


def leaves(docs: DataFrame, modulus: int = 7) -> DataFrame:
    """Per row: doc_id, lang, the leaf, and the leaf of the tampered row (1 added to n_chars) where ``modulus`` divides crc32 of doc_id."""
    doc_id, source, lang, n_chars, text = (F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))
    touched = (id_fold("doc_id", modulus) == 0) & n_chars.isNotNull()
    return docs.select(
        doc_id.cast("long").alias("doc_id"),
        lang.cast("string").alias("lang"),
        F.coalesce(F.concat(F.lit("="), lang.cast("string")), F.lit("-")).alias("key"),  # null first, then by bytes
        leaf_of(doc_id, source, lang, n_chars, text).alias("hash"),
        F.when(touched, leaf_of(doc_id, source, lang, n_chars + 1, text)).alias("tampered"),
    )


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, the place among those of their ``key`` by ``order``, and ``n``, how many these are."""
    runs = rows.repartitionByRange("key", *order).sortWithinPartitions("key", *order)
    runs = written(runs.withColumns({"run": F.spark_partition_id(), "at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "runs")
    by_run = runs.groupBy("key", "run").agg(F.min("at").alias("first"), F.count("*").alias("c"))  # a row for each run, and for each key within it
    before = Window.partitionBy("key").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_run.select("key", "run", (F.coalesce(F.sum("c").over(before), F.lit(0)) - F.col("first")).alias("add"), F.sum("c").over(Window.partitionBy("key")).alias("n"))
    return runs.join(small(starts), ["key", "run"]).withColumn("pos", F.col("at") + F.col("add")).drop("run", "at", "add")


def _in_blocks(nodes: DataFrame, *order: str) -> DataFrame:
    return nodes.repartition("key", "block").sortWithinPartitions("key", "block", *order)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _out(rows: Iterator[tuple], schema: pa.Schema, size: int = 4000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _levels(base: int, step: int) -> Callable:
    """A task's function from blocks of level ``base`` in order (key, block, n, pos, hash) to the nodes of the levels above, of one block after the other."""
    schema = pa.schema([("key", pa.string()), ("n", pa.int64()), ("level", pa.int32()), ("pos", pa.int64()), ("hash", pa.binary())])

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (key, block, n), rows in groupby(_rows(batches), lambda r: r[:3]):
            now = [r[4] for r in rows]
            for level in range(base + 1, min(base + step, height(n)) + 1):
                now = [joined(*now[k : k + 2]) for k in range(0, len(now), 2)]
                first = block << (base + step - level)
                yield from ((key, n, level, first + k, x) for k, x in enumerate(now))

    return lambda batches: _out(nodes(batches), schema)


class Tree:
    """The stored nodes of trees whose leaves are rows of (key, n, pos, hash, ...): each round's levels are written, by level, below ``store``."""

    def __init__(self, leaves: DataFrame, step: int = STEP) -> None:
        self.spark: SparkSession = leaves.sparkSession
        self.step = step
        self.store = scratch(self.spark, "nodes")
        self.leaves = leaves.withColumn("level", F.lit(0))
        self.height = height(leaves.agg(F.max("n")).first()[0] or 1)
        now = self.leaves
        for base in range(0, self.height, step):
            several = now.filter(F.col("n") > (1 << base)).select("key", F.shiftright("pos", step).alias("block"), "n", "pos", "hash")
            _in_blocks(several, "pos").mapInArrow(_levels(base, step), _NODE).write.partitionBy("level").parquet(self._place(base))
            now = self.level(base + step)

    def _place(self, base: int) -> str:
        return f"{self.store}/from={base}"

    def _above(self, base: int) -> DataFrame:
        """The levels that the round from level ``base`` has made."""
        return self.spark.read.schema(_NODE).parquet(self._place(base)).select("key", "n", "level", "pos", "hash")

    def level(self, level: int) -> DataFrame:
        return self._above((level - 1) // self.step * self.step).filter(F.col("level") == level) if level else self.leaves

    def from_level(self, base: int) -> DataFrame:
        """The nodes of one round: level ``base`` and those above it, up to the next round's."""
        here = self.level(base)
        return here.unionByName(self._above(base).filter(F.col("level") < base + self.step), allowMissingColumns=True) if base < self.height else here

    def roots(self) -> DataFrame:
        """(key, hash) of each tree's last node."""
        found = self.leaves.filter("n = 1").select("key", "hash")
        for base in range(0, self.height, self.step):
            found = found.union(self._above(base).filter("n > 1 and pos = 0 and level = length(bin(n - 1))").select("key", "hash"))
        return found

    def paths(self, above: DataFrame | None = None) -> DataFrame:
        """(key, pos, path): for each block of leaves the way from its top to the root, and on along the path of ``above`` (key, path)."""
        trees = self.leaves.filter("pos = 0").select("key", "n")
        now = trees.withColumn("path", F.array().cast("array<binary>")) if above is None else trees.join(above, "key")
        now = now.select("key", F.lit(0).cast("long").alias("pos"), "path")
        for base in range((self.height - 1) // self.step * self.step, 0, -self.step):
            reach = trees.filter(F.col("n") > (1 << base)).select("key")  # lower trees hand their path on
            met = _meet(self.from_level(base).filter(F.col("n") > (1 << base)), base + self.step, now.join(reach, "key", "left_semi"))
            down = met.mapInArrow(_walk(base, self.step, lambda row, path: (row[0], row[3], path), _PATH_FIELDS), _PATH)
            now = written(down.union(now.join(reach, "key", "left_anti")), "paths")
        return now


def _meet(nodes: DataFrame, top: int, paths: DataFrame, **extra: str) -> DataFrame:
    """Nodes below level ``top``, that of their blocks' tops, with the paths of these, block by block: the path first, then the nodes by falling level and place."""
    none = {"path": "array<binary>", "hash": "binary", "n": "long", "level": "int", **extra}
    order = ["key", "block", "level", "pos", "n", "hash", "path", *extra]
    nodes = nodes.withColumns({"block": F.expr(f"shiftright(pos, {top} - level)"), "path": F.lit(None).cast(none["path"])})
    tops = paths.withColumns({"block": F.col("pos"), **{c: F.lit(None).cast(t) for c, t in none.items() if c != "path"}})
    return _in_blocks(nodes.select(*order).union(tops.select(*order)), F.desc_nulls_first("level"), "pos")


_PATH_FIELDS = [("key", pa.string()), ("pos", pa.int64()), ("path", pa.list_(pa.binary()))]


def _walk(base: int, step: int, each: Callable[[tuple, list[bytes]], tuple], fields: list) -> Callable:
    """A task's function over what :func:`_meet` makes: ``each(row, path)`` for every node of level ``base``."""
    schema = pa.schema(fields)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (_, block), rows in groupby(_rows(batches), lambda r: r[:2]):
            above: list[bytes] = next(rows)[6]
            levels: dict[int, list[bytes]] = {}
            here: list[tuple] = []
            for row in rows:
                levels.setdefault(row[2], []).append(row[5])
                if row[2] == base:
                    here.append(row)
            for row in here:
                path = []
                for level in range(base, min(base + step, height(row[4]))):
                    at = (row[3] >> (level - base)) - (block << (base + step - level))
                    mates = levels[level]
                    path.append((b"L" if at & 1 else b"R") + mates[at ^ 1] if at ^ 1 < len(mates) else b"")
                yield each(row, path + above)

    return lambda batches: _out(found(batches), schema)


def _proof(row: tuple, path: list[bytes]) -> tuple:
    key, leaf, doc_id, tampered = row[0], row[5], row[7], row[8]
    subroot = next(step[1:] for step in path if step[:1] == b"=")
    siblings = hashlib.sha256("".join(step[1:].hex() for step in path if step[:1] in (b"L", b"R")).encode())
    folded = fold(leaf if tampered is None else tampered, path)
    return doc_id, None if key == "-" else key[1:], leaf.hex(), subroot.hex(), siblings.hexdigest(), folded.hex(), [step[:1].decode() + step[1:].hex() for step in path]


def manifest(docs: DataFrame, modulus: int = 7, step: int = STEP) -> DataFrame:
    """Per row: doc_id, lang, leaf, subroot, root, proof_sha256, folded_root, verified, and the proof itself.

    The proof's steps, from the leaf to the root, are ``L`` or ``R`` and the sibling's digest, empty where a node has none, and ``=``
    with the subroot where a language's tree ends. folded_root is what they make of the tampered leaf, or of the leaf itself.
    """
    tree = Tree(written(placed(written(leaves(docs, modulus), "leaves"), ["doc_id", "hash"]), "placed"), step)
    subroots = written(tree.roots().select(F.lit("").alias("key"), F.col("key").alias("name"), "hash"), "subroots")
    over = Tree(written(placed(subroots, ["name"]), "placed"), step)
    root = over.roots().first()
    fields = [("key", pa.string()), ("path", pa.list_(pa.binary()))]
    upper = _meet(over.from_level(0), step, over.paths(), name="string").mapInArrow(_walk(0, step, lambda row, path: (row[7], [b"=" + row[5], *path]), fields), "key string, path array<binary>")
    kinds = [("doc_id", pa.int64()), *((c, pa.string()) for c in ("lang", "leaf", "subroot", "proof_sha256", "folded_root")), ("proof", pa.list_(pa.string()))]
    met = _meet(tree.from_level(0), step, tree.paths(written(upper, "upper")), doc_id="long", tampered="binary")
    found = met.mapInArrow(_walk(0, step, _proof, kinds), _PROOF)
    whole = F.lit(root.hash.hex() if root else None).cast("string")
    return found.withColumns({"root": whole, "verified": F.col("folded_root") == whole})
