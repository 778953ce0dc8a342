"""Line files: event logs as CSV, queues and telemetry as JSON lines, hashes and notes as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

EVENTS = "id long, at timestamp, service string, kind string, outcome string, status int, factor double, requests_today int, spacing_seconds double, wait_seconds double"


def event_csv(spark: SparkSession, path: str) -> DataFrame:
    """A recorded request log; times carry an offset. ``result`` is clean, refused or neutral."""
    found = spark.read.csv(path, header=True, schema=EVENTS, timestampFormat="yyyy-MM-dd HH:mm:ss[.SSSSSS]X")
    return found.withColumn("result", F.when(F.col("outcome") == "ok", "clean").when(F.col("outcome") == "refused", "refused").otherwise("neutral"))


def json_lines(spark: SparkSession, path: str, schema: str, required: list[str]) -> DataFrame:
    """Well-formed lines that have their required fields; torn and mistyped ones are left out."""
    known = StructType.fromDDL(schema)
    read = StructType([*known.fields, StructField("_bad", StringType())])
    found = spark.read.schema(read).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    keep = F.col("_bad").isNull()
    for name in required:
        keep &= F.col(name).isNotNull()
    return found.filter(keep).drop("_bad")


def used_today(usage: DataFrame, stage: str, day: str, field: str) -> DataFrame:
    """The sum of a field over a stage's lines of a UTC day; 0 without any."""
    return usage.filter((F.col("stage") == stage) & (F.to_date("timestamp") == F.lit(day).cast("date"))).agg(F.coalesce(F.sum(field), F.lit(0)).alias(field))


def seen_hashes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("link_hash")).filter(F.col("link_hash").rlike("^[0-9a-f]{32}$")).distinct()


def notes(spark: SparkSession, path: str) -> DataFrame:
    """Markdown notes: the fields of their front matter, the first heading and the body below it."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    front = F.regexp_extract("value", r"(?s)^---\n(.*?)\n---\n", 1)
    lines = F.filter(F.split(front, "\n"), lambda x: x.contains(": "))
    fields = F.map_from_entries(F.transform(lines, lambda x: F.struct(F.trim(F.split_part(x, F.lit(": "), F.lit(1))), F.trim(F.regexp_replace(x, r"^[^:]*: ", "")))))
    rest = F.regexp_replace("value", r"(?s)^---\n.*?\n---\n", "")
    return raw.select("file", fields.alias("fields"), F.regexp_extract(rest, r"(?m)^# (.*)$", 1).alias("heading"), F.regexp_replace(F.regexp_replace(rest, r"^\s*# [^\n]*", ""), r"^\s+|\s+$", "").alias("body"))


def sample(df: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """``n`` rows chosen by a hash of their key: the same for the same seed, whatever the partitioning."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)
