"""Labels on postings: the latest of each, what they resolve to, and gaps filled later."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import note_number, slugify


def current_labels(log: DataFrame) -> DataFrame:
    """The label in force per posting key: the latest replaces its opposite; a job found once stays known.

    log: posting_key, label, job_id, labeled_at, seq.
    """
    last = F.max(F.struct("labeled_at", "seq", "label"))
    known = F.max(F.when(F.col("job_id").isNotNull(), F.struct("labeled_at", "seq", "job_id")))
    return log.groupBy("posting_key").agg(last.alias("l"), known.alias("k")).select("posting_key", F.col("l.label").alias("label"), F.col("k.job_id").alias("job_id"), F.col("l.labeled_at").alias("labeled_at"))


def resolve_by_priority(labels: DataFrame, lookups: list[DataFrame], key: str = "posting_key") -> DataFrame:
    """labels with job_id: that of the first lookup (key, job_id) that knows the key, its smallest if it has several."""
    ranked = None
    for rank, table in enumerate(lookups):
        part = table.select(key, F.struct(F.lit(rank).alias("rank"), F.col("job_id")).alias("m"))
        ranked = part if ranked is None else ranked.unionByName(part)
    best = ranked.groupBy(key).agg(F.min("m").alias("m")).select(key, F.col("m.job_id").alias("_found"))
    return labels.join(best, key, "left").withColumn("job_id", F.coalesce("job_id", "_found")).drop("_found")


def by_note(labels: DataFrame, jobs: DataFrame, key: str = "posting_key") -> DataFrame:
    """A lookup (key, job_id) by the note number that a label's file name ends with, if the name's words are the job's as well.

    labels: key, file; jobs: id, note_no, title. Numbers are used anew now and then, so a number alone proves nothing.
    """
    stem = F.regexp_replace("file", r"_?[0-9]+\.[A-Za-z]+$", "")
    asked = labels.select(key, note_number(F.col("file")).alias("note_no"), stem.alias("stem"))
    return asked.join(jobs.select(F.col("id").alias("job_id"), "note_no", slugify(F.col("title")).alias("slug")), "note_no").filter("slug = stem").select(key, "job_id")


def missing_share(labels: DataFrame) -> DataFrame:
    return labels.groupBy("label").agg(F.count("*").alias("labels"), F.count_if(F.col("job_id").isNull()).alias("without_job"))
