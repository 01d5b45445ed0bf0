"""Structured Streaming jobs that end in the same tables as their batch twins.

Sinks are written per batch id, so a batch replayed after a lost executor or a
restart replaces its own output and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from aislegraph.operators import cache
from aislegraph.sources.stores import PriceStore


def _file_status(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.getFileStatus(hadoop) if files.exists(hadoop) else None


def _exists(spark: SparkSession, path: str) -> bool:
    return _file_status(spark, path) is not None


def read_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 64) -> DataFrame:
    """A table folder (or one table file) as a stream of its files."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    status = _file_status(spark, path)
    if status is not None and status.isFile():
        folder, name = path.rsplit("/", 1)
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def _start(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str) -> StreamingQuery:
    return (
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).foreachBatch(each).start()
    )


def stream_price_upsert(captures: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Late or repeated captures of a (listing, day) replace the earlier one. A batch writes its own
    rows only (see ``PriceStore``); ``read_prices`` merges and ``PriceStore.compact`` is a job of its own."""

    def append(batch: DataFrame, batch_id: int) -> None:
        PriceStore(batch.sparkSession, table).append(batch, batch_id)

    return _start(captures, append, checkpoint, "append")


def read_prices(spark: SparkSession, table: str) -> DataFrame:
    return PriceStore(spark, table).read()


def _replace_batch(table: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    return write


def stream_daily_min(captures: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Lowest piece price per product and day. Minima fold, so each batch writes its own and
    ``read_daily_min`` takes the lowest: no state is kept and no late row is lost."""

    def minima(batch: DataFrame, batch_id: int) -> None:
        daily = batch.filter(F.col("price_piece").isNotNull()).groupBy(
            "product_id", F.to_date("scraped_at").alias("scraped_date")
        ).agg(F.min("price_piece").alias("price"))
        _replace_batch(table)(daily, batch_id)

    return _start(captures, minima, checkpoint, "append")


def read_daily_min(spark: SparkSession, table: str) -> DataFrame:
    return spark.read.parquet(table).groupBy("product_id", "scraped_date").agg(F.min("price").alias("price"))


def stream_first_wins(
    rows: DataFrame, keys: list[str], order: list[str], table: str, checkpoint: str
) -> StreamingQuery:
    """First row per key in source order, whichever batch or task it arrives in."""
    rest = [c for c in rows.columns if c not in keys]
    first = F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("_first")

    def firsts(batch: DataFrame, batch_id: int) -> None:
        _replace_batch(table)(batch.groupBy(*keys).agg(first), batch_id)

    return _start(rows, firsts, checkpoint, "append")


def read_first_wins(spark: SparkSession, table: str, keys: list[str]) -> DataFrame:
    folded = spark.read.parquet(table).groupBy(*keys).agg(F.min("_first").alias("_first"))
    return folded.select(*keys, "_first.*")


def stream_ttl_cache(lookups: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """hit, expired or miss per lookup with a time to live by outcome.

    Batch n reads the cache state that batch n - 1 left and writes its own, so a
    replay starts from the same state.
    """

    def judge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = f"{table}/state/{batch_id - 1}"
        if batch_id > 0 and _exists(spark, before):
            state = spark.read.parquet(before)
        else:
            kinds = dict(batch.dtypes)
            state = spark.createDataFrame([], f"key {kinds['key']}, cached_at {kinds['ts']}, found boolean")
        writes = cache.cache_writes(batch, state)
        outcomes = cache.cache_outcomes(batch, state, writes)
        outcomes.write.mode("overwrite").parquet(f"{table}/outcomes/batch={batch_id}")
        cache.state_after(state, writes).write.mode("overwrite").parquet(f"{table}/state/{batch_id}")

    return _start(lookups, judge, checkpoint, "append")
