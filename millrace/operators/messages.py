"""Digests and messages: sections with a shared budget, and blocks packed into messages."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType


def digest_sections(df: DataFrame, section: str, order: list, cap: int, shared: int, place: str) -> DataFrame:
    """At most ``cap`` rows per section, and which of them are among the first ``shared`` over the sections in their order.

    Both are limits of the report itself. Sections are cut by a ranked top-k, so only the report's rows meet.
    """
    top = df.withColumn("rank", F.row_number().over(Window.partitionBy(section).orderBy(*order))).filter(F.col("rank") <= cap)
    overall = Window.orderBy(F.col(place), "rank")  # at most cap rows of each section
    return top.withColumn("shown", F.row_number().over(overall) <= shared)


def section_blocks(digest: DataFrame, section: str, heading: Column, line: Column) -> DataFrame:
    """section and block: a heading with the number of a section's rows, its shown rows' lines in rank order, and how many more there are.

    digest: as :func:`digest_sections` makes it, so a section has as many rows as its cap at most.
    """
    listed = F.array_sort(F.collect_list(F.when(F.col("shown"), F.struct("rank", line.alias("text")))))
    found = digest.groupBy(section).agg(F.min(heading).alias("_heading"), F.count("*").alias("_n"), listed.alias("_lines"))
    hidden = F.col("_n") - F.size("_lines")
    lines = F.transform("_lines", lambda x: F.concat(F.lit("- "), x["text"]))
    more = F.when(hidden > 0, F.array(F.concat(F.lit("and "), hidden.cast("string"), F.lit(" more")))).otherwise(F.array().cast("array<string>"))
    return found.select(section, F.array_join(F.concat(F.array(F.concat("_heading", F.lit(" ("), F.col("_n").cast("string"), F.lit(")"))), lines, more), "\n").alias("block"))


def _parts(block: str, limit: int) -> Iterator[tuple[int, int]]:
    """Where the parts of a block begin and end: at most ``limit`` characters each, cut at line ends where there are some."""
    at = 0
    while len(block) - at > limit:
        cut = block.rfind("\n", at + 1, at + limit + 1)
        cut = cut if cut > 0 else at + limit
        yield at, cut
        at = cut + (block[cut] == "\n")
    yield at, len(block)


def split_oversized(block: str, limit: int) -> list[str]:
    """A block in parts of at most ``limit`` characters."""
    return [block[a:b] for a, b in _parts(block, limit)]


def pack_blocks(blocks: list[str], limit: int) -> list[str]:
    """Messages of whole blocks in order, an empty line between, none longer than ``limit``."""
    out: list[list[str]] = []
    size = 0
    for block in (part for b in blocks for part in split_oversized(b, limit)):
        if out and size + 2 + len(block) <= limit:
            out[-1].append(block)
            size += 2 + len(block)
        else:
            out.append([block])
            size = len(block)
    return ["\n\n".join(x) for x in out]


def message_sizes(df: DataFrame, key: str, order: str, text: str, limit: int = 4096) -> DataFrame:
    """key, message, blocks and chars of the messages that a key's texts fill in order.

    Texts are cut where they are read, and only the parts' lengths move; of a key's sequence the open message is held.
    """

    @F.pandas_udf(ArrayType(LongType()))
    def lengths(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [b - a for a, b in _parts(t, limit)])

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, number, blocks, chars = object(), 0, 0, 0
        for part in parts:
            out = []
            for k, sizes in zip(part["key"], part["sizes"], strict=True):
                if k != now:
                    if blocks:
                        out.append((now, number, blocks, chars))
                    now, number, blocks, chars = k, 0, 0, 0
                for size in sizes:
                    if blocks and chars + 2 + size > limit:
                        out.append((now, number, blocks, chars))
                        number, blocks, chars = number + 1, 0, 0
                    chars += size + (2 if blocks else 0)
                    blocks += 1
            yield pd.DataFrame(out, columns=["key", "message", "blocks", "chars"])
        if blocks:
            yield pd.DataFrame([(now, number, blocks, chars)], columns=["key", "message", "blocks", "chars"])

    content = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(key).cast("string").alias("key"), F.col(order).alias("o"), F.xxhash64(content).alias("tie"), lengths(content).alias("sizes"))
    return rows.repartition("key").sortWithinPartitions("key", "o", "tie").select("key", "sizes").mapInPandas(fold, "key string, message long, blocks long, chars long")


def golden_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Lines that one side has more often than the other, with the side: a comparison of multisets."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def line_diff(left: DataFrame, right: DataFrame, text: str = "text") -> DataFrame:
    """(line, side, n): whole lines of all texts that one side has n times more often; a null text is one empty line.

    Lines are counted before they are joined, so a frequent line is one row on each side.
    """
    lines = lambda df, n: df.select(F.explode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line")).groupBy("line").agg(F.count("*").alias(n))
    surplus = F.coalesce("a", F.lit(0)) - F.coalesce("b", F.lit(0))
    found = lines(left, "a").join(lines(right, "b"), "line", "full").withColumn("n", surplus).filter("n <> 0")
    return found.select("line", F.when(F.col("n") > 0, "left").otherwise("right").alias("side"), F.abs("n").alias("n"))
