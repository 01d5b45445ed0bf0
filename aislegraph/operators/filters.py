"""Row predicates of the boards and searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aislegraph.functions import text
from aislegraph.model import RETAILER_IDS


def text_filter(products: DataFrame, query: str) -> DataFrame:
    """Case-insensitive substring over brand and title; a blank query keeps all."""
    needle = query.strip().lower()
    if not needle:
        return products
    shown = F.lower(F.concat_ws(" ", "brand", "title"))
    return products.filter(F.contains(shown, F.lit(needle)))


def retailer_filter(listings: DataFrame, wanted: list[str]) -> DataFrame:
    """Keep listings of the selected known retailers; products left with none go."""
    return listings.filter(F.col("retailer").isin([r for r in wanted if r in RETAILER_IDS]))


def ean_valid(col: Column) -> Column:
    return F.coalesce(text.is_ean(col), F.lit(False))


def barcode_contains(catalog: DataFrame, wanted: DataFrame) -> DataFrame:
    """Catalog rows whose barcode list holds a wanted barcode exactly."""
    exploded = catalog.select("*", F.explode(F.array_distinct("barcodes")).alias("wanted_ean"))
    return exploded.join(
        wanted.select(F.col("ean").alias("wanted_ean")).distinct(), "wanted_ean"
    )


def contains_all(hay: Column, terms: Column) -> Column:
    """Every term is a literal substring."""
    return (F.size(terms) > 0) & F.forall(terms, lambda t: F.contains(hay, t))


def long_enough(col: Column, least: int) -> Column:
    return F.length(text.full_trim(col)) >= least


def has_price(piece: Column, unit: Column) -> Column:
    return piece.isNotNull() | unit.isNotNull()
