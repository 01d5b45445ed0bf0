"""The daily refresh: tracked listings to prices, checks, history and summary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aislegraph.model import CATALOG_PRICED
from aislegraph.operators import maintenance, quality

PRICE_FIELDS = ["price_piece", "price_unit", "unit_label", "image_url"]


def catalog_price_join(targets: DataFrame, catalog: DataFrame) -> DataFrame:
    """Price tracked listings from the catalog by sku; misses keep a null ``hit``.

    Of duplicate skus in a crawl the last one counts.
    """
    last = maintenance.last_wins(
        catalog.select("retailer", F.col("sku").alias("retailer_sku"), "pos", *PRICE_FIELDS),
        ["retailer", "retailer_sku"], ["pos"],
    ).drop("pos").withColumn("hit", F.lit(True))
    return targets.join(last, ["retailer", "retailer_sku"], "left")


def catalog_misses(targets: DataFrame, catalog: DataFrame) -> DataFrame:
    """Tracked listings the catalog does not carry (delisted or not crawled)."""
    keys = catalog.select("retailer", F.col("sku").alias("retailer_sku"))
    return targets.join(keys, ["retailer", "retailer_sku"], "left_anti")


@dataclass
class Refresh:
    outcomes: DataFrame
    history: DataFrame
    products: DataFrame
    summary: DataFrame
    messages: DataFrame


def daily_refresh(
    targets: DataFrame, products: DataFrame, history: DataFrame, catalog: DataFrame,
    pages: DataFrame, scraped_date, scraped_at, seq,
) -> Refresh:
    """Refresh all tracked listings.

    ``targets`` come from ``scan_targets``; catalog-priced chains read
    ``catalog``, the others the captured ``pages(listing_id, status, price...)``.
    """
    priced_by_catalog = F.col("retailer").isin(CATALOG_PRICED)
    joined = catalog_price_join(targets.filter(priced_by_catalog), catalog)
    plain = [c for c in joined.columns if c not in ("hit", *PRICE_FIELDS)]
    from_catalog = joined.filter("hit").drop("hit").withColumn("status", F.lit(200))
    # Catalog misses fall back on their page; a listing without any page stays, as failed.
    rest = targets.filter(~priced_by_catalog).unionByName(joined.filter("hit IS NULL").select(*plain), allowMissingColumns=True)
    live = rest.join(pages.withColumnRenamed("listing_id", "id"), "id", "left").withColumn(
        "status", F.coalesce("status", F.lit(0))
    )
    resolved = from_catalog.unionByName(live.select(*from_catalog.columns)).withColumnRenamed(
        "id", "listing_id"
    )
    outcomes = quality.unit_price_sanity(quality.outcome_classify(resolved))
    priced = outcomes.filter(F.col("outcome") == "priced").select(
        "listing_id", "product_id", scraped_date.alias("scraped_date"),
        scraped_at.alias("scraped_at"), seq.alias("seq"), *PRICE_FIELDS,
    )
    images = priced.select("product_id", F.col("listing_id").alias("seq"), "image_url")
    return Refresh(
        outcomes=outcomes,
        history=maintenance.upsert_daily_price(history, priced),
        products=maintenance.image_backfill(products, images),
        summary=quality.run_summary(outcomes),
        messages=quality.run_messages(outcomes),
    )
