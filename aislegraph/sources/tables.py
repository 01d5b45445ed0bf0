"""Reads of the model tables with a fixed schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from aislegraph.operators.prices import listing_product_join


def scan_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A model table from parquet: declared schema, no inference pass."""
    return spark.read.schema(schema).parquet(path)


def conform(frame: DataFrame, schema: StructType) -> DataFrame:
    """Project a frame onto a model schema."""
    return frame.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def scan_targets(listings: DataFrame, products: DataFrame) -> DataFrame:
    """The driving table of every refresh: tracked listings in product context."""
    return listing_product_join(listings, products)
