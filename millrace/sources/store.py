"""Keyed tables on Parquet: upserts as new states, archive copies, and a swap of whole tables.

Parquet has no row updates, so each mutation is a transform from a state and news to the next state, to be
written where the caller keeps versions.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_path(spark: SparkSession, name: str = "table") -> str:
    """A new place in the folder executors share (``spark.checkpoint.dir``; on a single machine our own where it is unset)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="millrace-"))
    return f"{base.rstrip('/')}/millrace-{name}-{uuid.uuid4().hex}"


def shared_table(df: DataFrame, spark: SparkSession) -> DataFrame:
    """Write ``df`` once in the folder executors share and read it back."""
    path = shared_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def replace_upsert(state: DataFrame, news: DataFrame, keys: list[str]) -> DataFrame:
    """News win over the state, column by column of ``state``; news must have one row per key."""
    rest = [c for c in state.columns if c not in keys]
    tagged = state.withColumn("_new", F.lit(0)).unionByName(news.select(*state.columns).withColumn("_new", F.lit(1)))
    top = F.max_by(F.struct(*rest), "_new").alias("_row") if rest else F.count("*").alias("_row")
    found = tagged.groupBy(*keys).agg(top)
    return found.select(*keys, *(F.col("_row")[c].alias(c) for c in rest)).select(*state.columns)


def ignore_upsert(state: DataFrame, news: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The state, and the news whose key it doesn't have: of several the first by ``order``, which must leave no ties."""
    rest = [c for c in state.columns if c not in keys]
    first = news.groupBy(*keys).agg(F.min_by(F.struct(*rest, F.lit(0)), F.struct(*order)).alias("_row"))
    fresh = first.join(state.select(*keys), keys, "left_anti").select(*keys, *(F.col("_row")[c].alias(c) for c in rest))
    return state.unionByName(fresh.select(*state.columns))


def refresh_upsert(state: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Sightings by natural key: first and last time and count of what was known and what was seen now.

    state: keys, first_seen, last_seen, seen_count; seen: keys, at.
    """
    now = seen.groupBy(*keys).agg(F.min("at").alias("first_seen"), F.max("at").alias("last_seen"), F.count("*").alias("seen_count"))
    both = state.select(*keys, "first_seen", "last_seen", "seen_count").unionByName(now)
    return both.groupBy(*keys).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("seen_count").alias("seen_count"))


def patched(map_col: Column, patch: Column | None = None, drop: list[str] | None = None) -> Column:
    """A map with the entries of ``patch`` (which win) and without the keys of ``drop``; null maps count as empty."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    base, news = F.coalesce(map_col, empty), F.coalesce(patch, empty) if patch is not None else empty
    kept = F.map_filter(base, lambda k, _: ~F.coalesce(F.array_contains(F.map_keys(news), k), F.lit(False)))
    gone = F.array(*map(F.lit, drop or [])).cast("array<string>")
    return F.map_filter(F.map_concat(kept, news), lambda k, _: ~F.array_contains(gone, k))


def turn_clocks(state: DataFrame, picks: DataFrame) -> DataFrame:
    """Per tier: when its turn last was and how many picks it had, after new picks. state: tier, turn_at, picks_done; picks: tier, at."""
    news = picks.groupBy("tier").agg(F.max("at").alias("turn_at"), F.count("*").alias("picks_done"))
    return state.select("tier", "turn_at", "picks_done").unionByName(news).groupBy("tier").agg(F.max("turn_at").alias("turn_at"), F.sum("picks_done").alias("picks_done"))


def unknown_keys(spec: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of a specification that the lists it refers to don't have."""
    return spec.select(*keys).distinct().join(known.select(*keys), keys, "left_anti")


def sync_catalog(table: DataFrame, spec: DataFrame, keys: list[str], known: DataFrame | None = None) -> DataFrame:
    """keys, action (added, updated, deactivated, kept) and interval of a catalogue after a new specification.

    table: keys, base, interval, active; spec: keys, base. An interval at the old base follows the base. With
    ``known``, a key of the specification that isn't in it raises.
    """
    if known is not None and (wrong := unknown_keys(spec, known, keys).limit(5).collect()):
        raise ValueError(f"unknown keys: {[tuple(r) for r in wrong]}")
    t = table.select(*keys, F.col("base").alias("old_base"), "interval", "active")
    found = t.join(spec.select(*keys, F.col("base").alias("new_base")), keys, "fullouter")
    action = (
        F.when(F.col("old_base").isNull(), "added")
        .when(F.col("new_base").isNull(), F.when(F.col("active"), "deactivated").otherwise("kept"))
        .when((F.col("old_base") != F.col("new_base")) | ~F.col("active"), "updated")
        .otherwise("kept")
    )
    interval = F.when(F.col("new_base").isNull(), F.col("interval")).when(F.col("old_base").isNull() | (F.col("interval") == F.col("old_base")), F.col("new_base")).otherwise(F.least("interval", "new_base"))
    return found.select(*keys, action.alias("action"), interval.alias("interval"))


def archive_batch(rows: DataFrame, finished: Column, order: list[str], n: int, columns: list[str]) -> DataFrame:
    """The oldest ``n`` finished rows that are not archived yet, in the archive's columns."""
    return rows.filter(finished & F.col("archived_at").isNull()).orderBy(*order).limit(n).select(*columns)


def replaced_children(archived: DataFrame, children: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """The archive's children after a batch of parents was copied: theirs are the ones of now, so stale ones go; others stay."""
    ids = batch.select(key).distinct()
    return archived.join(ids, key, "left_anti").unionByName(children.join(ids, key, "left_semi").select(*archived.columns))


def append_log(df: DataFrame, path: str, at: str) -> None:
    """Append rows to a log that is kept by UTC day."""
    df.withColumn("day", F.to_date(at)).write.mode("append").partitionBy("day").parquet(path)


def first_wins(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key, the first by ``order``, which must leave no ties; an aggregate with partial results, for hot keys."""
    rest = [c for c in df.columns if c != key]
    found = df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return found.select(key, *(F.col("_row")[c].alias(c) for c in rest)).select(*df.columns)


def not_known(df: DataFrame, known: DataFrame, key: Column) -> DataFrame:
    """Rows of ``df`` whose key isn't in the first column of ``known``."""
    k = known.select(F.col(known.columns[0]).alias("_key")).distinct()
    return df.join(k, key == F.col("_key"), "left_anti")


def deferred_queue(previous: DataFrame, now_failed: DataFrame, now: Column) -> DataFrame:
    """The retry queue after a run: a link that was queued before keeps its time. Both: link; previous: queued_at."""
    return now_failed.join(previous.select("link", "queued_at"), "link", "left").withColumn("queued_at", F.coalesce("queued_at", now))


def live_deferred(queue: DataFrame, now: Column, scoring_days: int = 3, throttled_days: int = 2, zone: str = "UTC") -> DataFrame:
    """Queued rows not expired: scoring ones by elapsed time, throttled ones by calendar days."""
    local = lambda c: F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), c))
    live = F.when(F.col("kind") == "throttled", F.datediff(local(now), local(F.col("queued_at"))) < throttled_days).otherwise(F.col("queued_at") > now - F.make_dt_interval(days=F.lit(scoring_days)))
    return queue.filter(live)


def todays_copy_wins(fresh: DataFrame, queued: DataFrame) -> DataFrame:
    """One row per link: the fresh copy where it has a description, or else the queued one, or else the fresh one."""
    both = fresh.withColumn("_q", F.lit(0)).unionByName(queued.withColumn("_q", F.lit(1)))
    rank = F.struct(F.coalesce(F.col("description") == "", F.lit(True)), F.col("_q"))
    rest = [c for c in fresh.columns if c != "link"]
    return both.groupBy("link").agg(F.min_by(F.struct(*rest), rank).alias("_row")).select("link", *(F.col("_row")[c].alias(c) for c in rest))


def file_system(spark: SparkSession, path: str):
    """The file system of ``path``, and the path, as Hadoop knows them."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def current(spark: SparkSession, path: str) -> DataFrame:
    """The table that :func:`swap` last put at ``path``."""
    files, pointer = file_system(spark, f"{path.rstrip('/')}/CURRENT")
    if not files.exists(pointer):
        raise FileNotFoundError(path)
    return spark.read.parquet(f"{path.rstrip('/')}/{spark.read.text(pointer.toString()).first()[0]}")


def swap(df: DataFrame, path: str) -> None:
    """Replace the table at ``path`` in one step, on any file system Hadoop knows.

    Each state is a folder of its own below ``path``, and the file CURRENT names the one in force. A new state is
    written first, then a new pointer replaces the old one by a rename that overwrites, which is atomic on HDFS
    and local disks; a crash before it leaves the old table, one after it the new. States before the last go.
    """
    spark, root = df.sparkSession, path.rstrip("/")
    name = f"state-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{name}")
    files, pointer = file_system(spark, f"{root}/CURRENT")
    before = spark.read.text(pointer.toString()).first()[0] if files.exists(pointer) else None
    beside = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/CURRENT.next-{uuid.uuid4().hex}")
    out = files.create(beside, True)
    out.write(bytearray(name, "ascii"))
    out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    overwrite = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = overwrite
    context.rename(files.makeQualified(beside), files.makeQualified(pointer), options)
    for old in files.listStatus(pointer.getParent()):
        if old.isDirectory() and old.getPath().getName() not in (name, before):
            files.delete(old.getPath(), True)
