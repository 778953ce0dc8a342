"""A stream over the pages that walks leave behind, which goes on where each walk's reading has got to.

A walk (a slice) is a folder; a page is a file ``<start>-<next>.jsonl`` in it with one card per line, where ``start`` is how many
cards come before it and ``next`` where the page after it starts. The stream's offset is the next start of every slice. It
is kept in the query's checkpoint with each batch, so a query that was stopped or killed goes on at the page that it had reached.

A slice is read in order: a page is taken when it starts where the slice's offset is, and a gap waits for the page that is
missing. Of several pages with one start the longest counts (a page that was fetched again); empty pages don't move on and are
left out. Lines that are no JSON object are skipped, and count towards nothing.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from millrace.sources.shared_files import names, opened

SCHEMA = "slice string, start long, place int, card string"
_PAGE = re.compile(r"(\d+)-(\d+)\.jsonl")


def pages_of(listed: list[str]) -> dict[int, tuple[int, str]]:
    """Of a slice's file names: by start, where the page ends and its file."""
    found: dict[int, tuple[int, str]] = {}
    for name in listed:
        if (m := _PAGE.fullmatch(name)) and int(m[2]) > int(m[1]):
            found[int(m[1])] = max(found.get(int(m[1]), (0, "")), (int(m[2]), name))
    return found


def reached(pages: dict[int, tuple[int, str]], start: int, most: int | None = None) -> Iterator[tuple[int, str]]:
    """(start, file) of the pages that follow one another from ``start`` on, at most ``most``."""
    while start in pages and most != 0:
        end, name = pages[start]
        yield start, name
        start, most = end, None if most is None else most - 1


#: Most tasks of a batch; each reads as many pages as the others.
MOST_PARTS = 256


class _Pages(InputPartition):
    """Pages that one task reads: slice, start and file name."""

    def __init__(self, pages: list[tuple[str, int, str]]) -> None:
        self.pages = pages


class _Reader(DataSourceStreamReader):
    def __init__(self, options: Mapping[str, str]) -> None:
        self.root = options["path"]
        self.most = int(options["pagesPerBatch"]) if options.get("pagesPerBatch") else None
        self.checkpoint = options.get("checkpoint")
        #: Where the latest batch ends; unknown until the query's checkpoint has been looked at.
        self.at: dict[str, int] | None = None
        #: What the latest offset was made from.
        self.seen: dict[str, dict[int, tuple[int, str]]] | None = None

    def _listed(self) -> dict[str, dict[int, tuple[int, str]]]:
        """The pages of all slices, from one listing."""
        files, root = opened(self.root)
        found: dict[str, list[str]] = {}
        for x in files.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True)):
            parts = x.path.rsplit("/", 2)
            if x.type == fs.FileType.File and parts[0].rstrip("/") == root.rstrip("/"):
                found.setdefault(parts[1], []).append(parts[2])
        return {s: pages_of(listed) for s, listed in sorted(found.items())}

    def _planned(self) -> dict[str, int] | None:
        """The offset that the query's checkpoint has last; none in a new query, None if it isn't known where the checkpoint is."""
        if not self.checkpoint:
            return None
        files, root = opened(self.checkpoint)
        numbers = [int(x) for x in names(files, f"{root}/offsets", fs.FileType.File) if x.isdigit()]
        if not numbers:
            return {}
        with files.open_input_stream(f"{root}/offsets/{max(numbers)}") as log:
            return json.loads(log.read().decode().splitlines()[-1])

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """The end of the next batch. Spark doesn't tell a source where its query stands: that is read in the checkpoint, and without it a query's first batch goes to the end of each chain."""
        known = self._planned() if self.at is None else self.at
        now = dict(known or {})
        self.seen = self._listed()
        for slice_, pages in self.seen.items():
            start = now.get(slice_, 0) if known is not None else min(pages, default=0)
            for begin, _ in reached(pages, start, self.most if known is not None else None):
                now[slice_] = pages[begin][0]
        self.at = now
        return now

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        # a batch that runs again may be asked for before anything was listed
        listed, found = self._listed() if self.seen is None else self.seen, []
        for slice_, last in end.items():
            if start.get(slice_, 0) < last:
                found += [(slice_, begin, name) for begin, name in reached(listed.get(slice_, {}), start.get(slice_, 0)) if begin < last]
        size = max(1, -(-len(found) // MOST_PARTS))
        return [_Pages(found[k : k + size]) for k in range(0, max(len(found), 1), size)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        assert isinstance(partition, _Pages)
        files, root = opened(self.root)
        held: list[tuple[str, int, int, str]] = []
        for slice_, start, name in partition.pages:
            with files.open_input_stream(f"{root}/{slice_}/{name}") as page:
                lines = page.read().decode("utf-8", "replace").splitlines()
            held += [(slice_, start, place, line) for place, line in enumerate(lines) if _is_card(line)]
            if len(held) >= 5_000:
                yield _batch(held)
                held = []
        if held:
            yield _batch(held)

    def commit(self, end: dict) -> None:
        pass  # the checkpoint holds the offset; pages stay where they are


def _batch(cards: list[tuple[str, int, int, str]]) -> pa.RecordBatch:
    types = (pa.string(), pa.int64(), pa.int32(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*cards, strict=True), types, strict=True)], names=["slice", "start", "place", "card"])


def _is_card(line: str) -> bool:
    try:
        return isinstance(json.loads(line), dict)
    except ValueError:
        return False


class WalkPages(DataSource):
    """``spark.readStream.format("walk_pages").option("path", folder)``; ``pagesPerBatch``: the most of each slice in a batch; ``checkpoint``: the query's checkpoint, so that its first batch keeps to that too."""

    @classmethod
    def name(cls) -> str:
        return "walk_pages"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Reader(self.options)


def walk_cards(spark: SparkSession, path: str, pages_per_batch: int | None = None, checkpoint: str | None = None) -> DataFrame:
    """The stream of all cards below ``path``: slice, start of the page, place on it, and the card as JSON."""
    spark.dataSource.register(WalkPages)
    given = {"path": path, "pagesPerBatch": pages_per_batch, "checkpoint": checkpoint}
    return spark.readStream.format("walk_pages").options(**{k: v for k, v in given.items() if v is not None}).load()
