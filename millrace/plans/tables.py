"""The star-schema tables in the roles the operators know, as DataFrames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.requests import outcome_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a request log: event_type is the source, user_id the host, the last digit of props.k stands for a status."""
    k = F.get_json_object("props", "$.k").cast("int") % 10
    status = F.when(k == 0, 403).when(k == 1, 429).when(k == 2, 503).when(k.isin(3, 4), F.lit(None)).otherwise(200).cast("int")
    outcome = F.when(k == 4, "ok").otherwise(outcome_of(status))
    return table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("at"), F.col("event_type").alias("source"), F.col("user_id").alias("host"), "value", k.alias("digit"), status.alias("status"), outcome.alias("outcome"))


REQUEST_LOG = """
    log AS (
        SELECT *, CASE WHEN digit = 4 THEN 'ok' WHEN status IN (403, 429) THEN 'refused' WHEN status = 200 THEN 'ok' ELSE 'error' END AS outcome
        FROM (SELECT *, CASE digit WHEN 0 THEN 403 WHEN 1 THEN 429 WHEN 2 THEN 503 WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE 200 END AS status
              FROM (SELECT event_id, ts AS seen_at, event_type AS source, user_id AS host, value,
                           CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 AS digit FROM events))
    )"""


def call_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a log of model calls: event_type is the stage, the digit picks model and outcome, value is the latency."""
    model = F.when(F.col("digit") <= 2, F.lit(None)).when(F.col("digit") >= 8, "fallback-m").otherwise("primary-m")
    outcome = F.when(F.col("digit") == 0, "timeout").when(F.col("digit") == 1, "rate_limited").when(F.col("digit") == 2, "error").otherwise("ok")
    return request_log(spark, sf_dir).select("event_id", "at", F.col("source").alias("stage"), "host", F.col("value").alias("latency"), F.floor(F.col("value") * 10).cast("long").alias("tokens"), model.alias("model"), outcome.alias("outcome"))


CALL_LOG = REQUEST_LOG + """, calls AS (
        SELECT event_id, seen_at, source AS stage, host, value AS latency, CAST(floor(value * 10) AS BIGINT) AS tokens,
               CASE WHEN digit <= 2 THEN NULL WHEN digit >= 8 THEN 'fallback-m' ELSE 'primary-m' END AS model,
               CASE digit WHEN 0 THEN 'timeout' WHEN 1 THEN 'rate_limited' WHEN 2 THEN 'error' ELSE 'ok' END AS outcome
        FROM log
    )"""


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as postings: o_custkey is the company, the priority's digit the class, o_totalprice the score, o_orderdate first seen."""
    o = table(spark, sf_dir, "orders")
    rank = F.substring("o_orderpriority", 1, 1).cast("int")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("company"), rank.alias("class"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.col("o_orderdate").alias("first_seen"))


POSTINGS = """
    postings AS (
        SELECT o_orderkey AS id, o_custkey AS company, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS class,
               o_orderstatus AS status, o_totalprice AS price, o_orderdate AS first_seen FROM orders
    )"""
