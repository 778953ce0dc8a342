"""Media columns: lossless 8-bit samples in archives, read by byte range through a Python data source.

``store`` writes each task's payloads as WAV members (8-bit mono) of ZIP archives in a shared folder. An
archive takes its final name when it is complete, and that name depends on the partition only, so an
attempt that is run again replaces the same bytes. ``ArchiveSource`` lists the archives on the driver,
plans ranges of bytes over them, and leaves each archive's directory to the tasks: a task takes the
members whose offset lies in its range and streams their bytes as Arrow batches. A member that can't be
read is tried again alone, from its own offset.

Defined cases: a null text is the empty text, whose payload is 64 zero bytes; a null identifier stays
null; repeated rows give repeated members; further columns are ignored; an empty table gives no rows. A text has to fit
in its task's memory; one of 4 GiB or more, which a WAV file's sizes can't tell, ends the job with an error.
"""

from __future__ import annotations

import hashlib
import io
import struct
import time
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from millrace.llm.common import rows, scratch, slim

UNIT = 64
RATE = 8000
_WAV = struct.Struct("<4sI4s4sIHHIIHH4sI")
FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def payload_of(text: bytes) -> bytes:
    """The text's bytes and zeros up to a positive multiple of 64."""
    return text + bytes(-len(text) % UNIT if text else UNIT)


def encode_wav(samples: bytes) -> bytes:
    """8-bit mono PCM; the sample count is even here, so the data chunk needs no padding byte."""
    n = len(samples)
    return _WAV.pack(b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n) + samples


def decode_wav(media: bytes) -> bytes:
    riff, _, wave, fmt, _, kind, channels, _, _, _, bits, data, n = _WAV.unpack_from(media)
    if (riff, wave, fmt, data, kind, channels, bits) != (b"RIFF", b"WAVE", b"fmt ", b"data", 1, 1, 8) or len(media) != _WAV.size + n:
        raise ValueError("not an 8-bit mono WAV member")
    return media[_WAV.size :]


def store(df: DataFrame, folder: str, archive_bytes: int = 64 << 20) -> DataFrame:
    """Write the payloads of ``df`` (doc_id, text as bytes) as archives in ``folder``; one row per archive written."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        files, base = pafs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        out = {"path": [], "members": [], "n_bytes": []}
        sink = archive = None
        part = held = count = 0

        def close() -> None:
            nonlocal sink, archive, part, held, count
            if archive is None:
                return
            archive.close()
            size = sink.tell()
            sink.close()
            final = f"{base}/part-{task.partitionId():06d}-{part:05d}.zip"
            files.move(f"{base}/_attempt-{task.taskAttemptId()}-{part:05d}", final)
            for name, value in (("path", final), ("members", count), ("n_bytes", size)):
                out[name].append(value)
            sink = archive = None
            part, held, count = part + 1, 0, 0

        for batch in batches:
            for doc_id, text in rows(batch):
                if archive is None:
                    sink = files.open_output_stream(f"{base}/_attempt-{task.taskAttemptId()}-{part:05d}")
                    archive = zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED, compresslevel=1)
                member = zipfile.ZipInfo(f"{'null' if doc_id is None else doc_id}/{len(text)}/{count}.wav", (1980, 1, 1, 0, 0, 0))
                member.compress_type = zipfile.ZIP_DEFLATED
                media = encode_wav(payload_of(text))
                archive.writestr(member, media, compresslevel=1)
                held, count = held + len(media), count + 1
                if held >= archive_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array(out["path"], pa.string()), pa.array(out["members"], pa.int64()), pa.array(out["n_bytes"], pa.int64())], names=list(out))

    return df.mapInArrow(write, "path string, members long, n_bytes long")


class ByteRange(InputPartition):
    def __init__(self, path: str, start: int, end: int) -> None:
        self.path, self.start, self.end = path, start, end


def read_member(files: pafs.FileSystem, path: str, member: zipfile.ZipInfo, tries: int = 3, wait_s: float = 0.2) -> bytes:
    """One member's bytes from its own offset, checked against its CRC; each try opens the archive anew."""
    for left in range(tries - 1, -1, -1):
        try:
            with files.open_input_file(path) as source:
                source.seek(member.header_offset)
                head = source.read(30)
                names = int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little")
                source.seek(member.header_offset + 30 + names)
                raw = source.read(member.compress_size)
            data = zlib.decompress(raw, -15) if member.compress_type == zipfile.ZIP_DEFLATED else raw
            if head[:4] != b"PK\3\4" or len(data) != member.file_size or zlib.crc32(data) != member.CRC:
                raise OSError(f"{path}: the member at {member.header_offset} is damaged")
            return data
        except (OSError, zlib.error):
            if not left:
                raise
            time.sleep(wait_s)
    raise AssertionError


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder = options["path"]
        self.range_bytes = int(options.get("rangeBytes", 16 << 20))
        self.batch_bytes = int(options.get("batchBytes", 8 << 20))
        self.tries = int(options.get("tries", 3))

    def partitions(self) -> list[ByteRange]:
        """Ranges of at most ``rangeBytes`` over the archives of the folder; only names and sizes are read here."""
        files, base = pafs.FileSystem.from_uri(self.folder)
        found = [x for x in files.get_file_info(pafs.FileSelector(base, allow_not_found=True)) if x.base_name.endswith(".zip")]
        return [ByteRange(x.path, k, k + self.range_bytes) for x in sorted(found, key=lambda x: x.path) for k in range(0, x.size, self.range_bytes)] or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        files, _ = pafs.FileSystem.from_uri(self.folder)
        with files.open_input_file(partition.path) as source:
            members = [x for x in zipfile.ZipFile(source).infolist() if partition.start <= x.header_offset < partition.end]
        ids, sizes, media, held = [], [], [], 0
        for member in members:
            doc_id, size, _ = member.filename.split("/")
            ids.append(None if doc_id == "null" else int(doc_id))
            sizes.append(int(size))
            media.append(read_member(files, partition.path, member, self.tries))
            held += len(media[-1])
            if held >= self.batch_bytes:
                yield self._batch(ids, sizes, media)
                ids, sizes, media, held = [], [], [], 0
        if ids:
            yield self._batch(ids, sizes, media)

    @staticmethod
    def _batch(ids: list, sizes: list, media: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


class ArchiveSource(DataSource):
    """``spark.read.format("media_archive").load(folder)``: doc_id, n_bytes and the stored bytes of each member."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "doc_id long, n_bytes long, media binary"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def load(spark: SparkSession, folder: str, **options: object) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    reader = spark.read.format("media_archive")
    for name, value in options.items():
        reader = reader.option(name, str(value))
    return reader.load(folder)


def feature_of(samples: bytes) -> str:
    """Mean, root mean square, zero crossings about 128 and entropy in bits of the samples."""
    x = np.frombuffer(samples, np.uint8)
    counts = np.bincount(x, minlength=256)
    levels, n = np.arange(256), len(x)
    mean, power = int(counts @ levels) / n, int(counts @ (levels * levels)) / n
    high = x >= 128
    p = counts[counts > 0] / n
    return f"mean={mean:.4f};rms={power**0.5:.4f};crossings={int(np.count_nonzero(high[1:] != high[:-1]))};entropy={float(-(p * np.log2(p)).sum()) + 0.0:.4f}"


def features(media: DataFrame) -> DataFrame:
    """Digests and features of the members' decoded samples."""

    def computed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stored = batch.column("media").to_pylist()
            samples = [decode_wav(x) for x in stored]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("n_bytes"),
                    pa.array([len(x) for x in samples], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in samples]),
                    pa.array([zlib.crc32(x[-UNIT:]) for x in samples], pa.int64()),
                    pa.array([len(x) for x in stored], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in stored]),
                    pa.array([feature_of(x) for x in samples]),
                ],
                names=[x.split()[0] for x in FEATURES.split(", ")],
            )

    return media.mapInArrow(computed, FEATURES)


def media_features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as media, read the archives back and return digests and features per row."""
    spark = df.sparkSession
    folder = scratch(spark, "media")
    store(slim(df, id_col, text_col), folder).write.format("noop").mode("overwrite").save()
    return features(load(spark, folder))
