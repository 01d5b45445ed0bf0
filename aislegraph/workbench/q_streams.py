"""Streaming jobs over the given tables, each checked against its batch SQL."""

import uuid

from pyspark.sql import functions as F

from aislegraph.operators import cache
from aislegraph.session import ensure_checkpoint_dir
from aislegraph.streaming import jobs
from aislegraph.workbench.registry import query
from aislegraph.workbench.tables import VIEWS, load, with_views


def workspace(spark):
    """A fresh folder under the session's shared checkpoint directory."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"


def captures(spark, sf):
    """Line items as a stream of price captures."""
    schema = load(spark, sf, "lineitem").schema
    lines = jobs.read_stream(spark, f"{sf}/lineitem.parquet", schema)
    sql = VIEWS["captures"][1].replace("FROM lineitem", "FROM {lineitem}")
    return spark.sql(sql, lineitem=lines)


@query("stream_price_upsert", with_views("captures", """
    SELECT listing_id, cast(scraped_date AS VARCHAR) AS scraped_date, seq, price_piece FROM captures
    QUALIFY row_number() OVER (PARTITION BY listing_id, scraped_date ORDER BY seq DESC) = 1"""))
def stream_price_upsert(spark, sf):
    folder = workspace(spark)
    rows = captures(spark, sf).select(
        "listing_id", "scraped_date", "seq", "price_piece", "price_unit", "unit_label")
    jobs.stream_price_upsert(rows, f"{folder}/history", f"{folder}/ckpt").awaitTermination()
    return jobs.read_prices(spark, f"{folder}/history").select(
        "listing_id", F.date_format("scraped_date", "yyyy-MM-dd").alias("scraped_date"), "seq", "price_piece")


@query("stream_daily_min", with_views("captures", """
    SELECT product_id, cast(scraped_date AS VARCHAR) AS scraped_date, min(price_piece) AS price
    FROM captures WHERE price_piece IS NOT NULL GROUP BY ALL"""))
def stream_daily_min(spark, sf):
    folder = workspace(spark)
    rows = captures(spark, sf).select(
        "product_id", F.col("scraped_at").cast("timestamp").alias("scraped_at"), "price_piece")
    jobs.stream_daily_min(rows, f"{folder}/daily", f"{folder}/ckpt").awaitTermination()
    return jobs.read_daily_min(spark, f"{folder}/daily").select(
        "product_id", F.date_format("scraped_date", "yyyy-MM-dd").alias("scraped_date"), "price")


@query("stream_first_wins", """
    SELECT md5(text) AS content, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source
    FROM documents GROUP BY 1""")
def stream_first_wins(spark, sf):
    folder = workspace(spark)
    schema = load(spark, sf, "documents").schema
    rows = jobs.read_stream(spark, f"{sf}/documents.parquet", schema).select(
        F.md5("text").alias("content"), "doc_id", "source")
    jobs.stream_first_wins(rows, ["content"], ["doc_id"], f"{folder}/first", f"{folder}/ckpt").awaitTermination()
    return jobs.read_first_wins(spark, f"{folder}/first", ["content"])


def lookups(frame):
    return frame.select(
        F.col("user_id").alias("key"), "ts", F.col("event_id").alias("seq"),
        (F.col("event_type") != "error").alias("found"))


# Writes of a key form a chain; each recursive step takes the first lookup after expiry.
TTL = """WITH RECURSIVE l AS (
    SELECT user_id AS key, ts, event_id AS seq, event_type <> 'error' AS found FROM events
), chain AS (
    (SELECT key, ts, seq, found FROM l QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts, seq) = 1)
    UNION ALL
    (SELECT n.key, n.ts, n.seq, n.found FROM (
        SELECT l.*, row_number() OVER (PARTITION BY l.key ORDER BY l.ts, l.seq) AS rn
        FROM chain c JOIN l ON l.key = c.key
         AND l.ts >= c.ts + CASE WHEN c.found THEN INTERVAL 90 DAY ELSE INTERVAL 14 DAY END
         AND (l.found OR NOT c.found)) n WHERE rn = 1)
), judged AS (
    SELECT l.seq, l.ts, l.key, arg_max(c.ts, {'t': c.ts, 's': c.seq}) AS w_ts,
           arg_max(c.found, {'t': c.ts, 's': c.seq}) AS w_found
    FROM l LEFT JOIN chain c ON c.key = l.key AND (c.ts < l.ts OR (c.ts = l.ts AND c.seq < l.seq))
    GROUP BY ALL)
    SELECT key, seq, CASE WHEN w_ts IS NULL THEN 'miss'
           WHEN ts < w_ts + CASE WHEN w_found THEN INTERVAL 90 DAY ELSE INTERVAL 14 DAY END THEN 'hit'
           ELSE 'expired' END AS outcome FROM judged"""


@query("stream_ttl_cache", TTL)
def stream_ttl_cache(spark, sf):
    folder = workspace(spark)
    rows = lookups(jobs.read_stream(spark, f"{sf}/events.parquet", load(spark, sf, "events").schema))
    jobs.stream_ttl_cache(rows, f"{folder}/cache", f"{folder}/ckpt").awaitTermination()
    return spark.read.parquet(f"{folder}/cache/outcomes").select("key", "seq", "outcome")


@query("ttl_cache_batch", TTL)
def ttl_cache_batch(spark, sf):
    rows = lookups(load(spark, sf, "events"))
    empty = rows.limit(0).select("key", F.col("ts").alias("cached_at"), "found")
    return cache.cache_outcomes(rows, empty, cache.cache_writes(rows, empty)).select("key", "seq", "outcome")
