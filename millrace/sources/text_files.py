"""Text files written by Spark: a sink that puts each row's text into the file that the row names, all or nothing.

Tasks write below a folder of the job, out of sight; the commit moves the files to their places, and an abort (or a task that fails)
leaves nothing behind. What stood in a place before is replaced by a rename, so a reader sees the old file or the new one, and running
a job again gives the same bytes. A file's rows are written in order by one task as they come, so a file may be longer than memory.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from millrace.sources.shared_files import below, opened


@dataclass
class _Staged(WriterCommitMessage):
    """Where a task has put the files of its paths."""

    folder: str
    paths: list[str]


class _Writer(DataSourceArrowWriter):
    def __init__(self, root: str) -> None:
        self.root, self.stage = root, f".stage-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        files, root = opened(self.root)
        folder = posixpath.join(root, self.stage, uuid.uuid4().hex)  # an attempt that runs again writes elsewhere
        paths, known, out = [], set(), None
        try:
            for batch in iterator:
                for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    if not paths or path != paths[-1]:
                        if path in known:
                            raise ValueError(f"rows of {path!r} don't follow one another")
                        place = below(folder, path or "")
                        paths.append(path)
                        known.add(path)
                        if out:
                            out.close()
                        files.create_dir(posixpath.dirname(place))
                        out = files.open_output_stream(place)
                    out.write((text or "").encode())
        finally:
            if out:
                out.close()
        return _Staged(folder, paths)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, root = opened(self.root)
        staged = [(m.folder, p) for m in messages if isinstance(m, _Staged) for p in m.paths]
        clean = [posixpath.normpath(p) for _, p in staged]
        if len(set(clean)) < len(clean):
            raise ValueError("several tasks have rows of one path")

        def put(folder: str, path: str) -> None:
            place = below(root, path)
            files.create_dir(posixpath.dirname(place))
            files.move(below(folder, path), place)

        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda x: put(*x), staged))
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        files, root = opened(self.root)
        stage = posixpath.join(root, self.stage)
        if files.get_file_info(stage).type.name == "Directory":
            files.delete_dir(stage)


class TextFiles(DataSource):
    """The sink ``text_files``; option ``path`` is the folder."""

    @classmethod
    def name(cls) -> str:
        return "text_files"

    def schema(self) -> str:
        return "path string, text string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"])


def write_files(parts: DataFrame, root: str) -> None:
    """Write ``parts`` (path, n, text): the file ``path`` below ``root`` has its texts one after the other by ``n``, which leaves no ties."""
    parts.sparkSession.dataSource.register(TextFiles)
    in_order = parts.select("path", "n", "text").repartition("path").sortWithinPartitions("path", "n").select("path", "text")
    in_order.write.format("text_files").mode("append").option("path", root).save()
