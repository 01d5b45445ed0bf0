"""Price analytics over products, listings and daily price history.

Latest/first/cheapest picks are ``max``/``min`` over structs rather than windows:
both combine before the shuffle, so one listing or product with a huge share of
the rows still reaches its reducer as one row per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aislegraph.model import HISTORY_BARS, STALE_AFTER_DAYS

PRICE_FIELDS = ["scraped_date", "price_piece", "price_unit", "unit_label"]


def latest_price(history: DataFrame) -> DataFrame:
    """Newest capture per listing (the later write wins inside a day)."""
    newest = F.max(F.struct("scraped_date", "seq", "price_piece", "price_unit", "unit_label"))
    return (
        history.groupBy("listing_id")
        .agg(newest.alias("p"))
        .select("listing_id", *[F.col(f"p.{c}").alias(c) for c in PRICE_FIELDS])
    )


def listing_product_join(listings: DataFrame, products: DataFrame) -> DataFrame:
    """Tracked listings with their product context."""
    context = products.select(
        F.col("id").alias("product_id"), F.col("brand").alias("product_brand"),
        F.col("title").alias("product_title"), F.col("image_url").alias("product_image"),
    )
    return listings.join(context, "product_id")


def listing_latest(listings: DataFrame, history: DataFrame) -> DataFrame:
    """Every listing with its latest price; listings without history stay."""
    latest = latest_price(history)
    return listings.join(latest, listings.id == latest.listing_id, "left").drop("listing_id")


def history_of(history: DataFrame, listings: DataFrame) -> DataFrame:
    links = listings.select(
        F.col("id").alias("listing_id"), "product_id", "retailer"
    )
    return history.drop("product_id", "retailer").join(links, "listing_id")


def _priced(board: DataFrame) -> DataFrame:
    return board.filter(F.col("price_piece").isNotNull())


def cheapest_listing(board: DataFrame) -> DataFrame:
    """Lowest piece price per product; ties go to the first listing."""
    best = F.min(F.struct("price_piece", "id", "retailer")).alias("b")
    return (
        _priced(board).groupBy("product_id").agg(best)
        .select("product_id", F.col("b.price_piece").alias("price_piece"),
                F.col("b.id").alias("listing_id"), F.col("b.retailer").alias("retailer"))
    )


def price_range(board: DataFrame) -> DataFrame:
    """min/max piece price of every product, null when it has none."""
    return board.groupBy("product_id").agg(
        F.min("price_piece").alias("min_price"), F.max("price_piece").alias("max_price")
    )


def saving(low: Column, high: Column) -> Column:
    """Spread used as a sort key: products without a price sort last."""
    return F.coalesce(high - low, F.lit(-1.0))


def price_board(products: DataFrame, listings: DataFrame, history: DataFrame) -> DataFrame:
    """One row per tracked product: cheapest store, range and possible saving."""
    board = listing_latest(listings, history)
    summary = board.groupBy("product_id").agg(
        F.min(F.when(F.col("price_piece").isNotNull(),
                     F.struct("price_piece", "id", "retailer"))).alias("b"),
        F.max("price_piece").alias("max_price"),
        F.count("id").alias("listings"),
    )
    low = F.col("b.price_piece")
    return summary.join(products, summary.product_id == products.id).select(
        "product_id", "brand", "title", "listings",
        F.col("b.id").alias("best_listing_id"), F.col("b.retailer").alias("best_retailer"),
        low.alias("min_price"), "max_price", saving(low, F.col("max_price")).alias("saving"),
    )


def sort_board(rows: DataFrame, sort: str) -> DataFrame:
    """Board order: ``price`` (unpriced last), ``saving`` or ``name`` (Greek order)."""
    keys = {
        "price": [F.col("min_price").asc_nulls_last()],
        "saving": [F.col("saving").desc()],
        "name": [F.collate(F.col("title"), "el")],
    }[sort]
    return rows.orderBy(*keys, "product_id")


def biggest_saving(rows: DataFrame) -> DataFrame:
    spread = F.max(F.col("max_price") - F.col("min_price"))
    return rows.agg(F.when(spread > 0, spread).alias("biggest_saving"))


def cheapest_product(rows: DataFrame, *order: Column) -> DataFrame:
    """Product with the lowest minimum; ties follow the board's current order."""
    key = F.struct(F.col("min_price"), *order, F.col("product_id"))
    return (
        rows.filter(F.col("min_price").isNotNull()).agg(F.min(key).alias("k"))
        .select(F.col("k.product_id").alias("product_id"), F.col("k.min_price").alias("min_price"))
    )


def store_stats(board: DataFrame, retailers: DataFrame) -> DataFrame:
    """Listings and cheapest-product counts for every retailer, zero-filled."""
    tracked = board.groupBy("retailer").agg(F.count("*").alias("listings"))
    cheapest = cheapest_listing(board).groupBy("retailer").agg(F.count("*").alias("cheapest"))
    return (
        retailers.join(tracked, "retailer", "left").join(cheapest, "retailer", "left")
        .select("ordinal", "retailer", "label",
                F.coalesce("listings", F.lit(0)).alias("listings"),
                F.coalesce("cheapest", F.lit(0)).alias("cheapest"))
        .orderBy(F.desc("listings"), "ordinal")
    )


def coverage_summary(products: DataFrame, listings: DataFrame, retailers: DataFrame) -> DataFrame:
    stores = retailers.join(listings, "retailer", "left_semi").agg(F.count("*").alias("active_stores"))
    return (
        products.agg(F.count("*").alias("products"))
        .crossJoin(listings.agg(F.count("*").alias("listings")))
        .crossJoin(stores)
        .crossJoin(retailers.agg(F.count("*").alias("all_stores")))
    )


def retailer_count(listings: DataFrame) -> DataFrame:
    return listings.agg(F.countDistinct("retailer").alias("retailers"))


def tracked_retailers(listings: DataFrame, retailers: DataFrame) -> DataFrame:
    return retailers.join(listings, "retailer", "left_semi").orderBy("ordinal")


def daily_min_price(history: DataFrame) -> DataFrame:
    return (
        history.filter(F.col("price_piece").isNotNull())
        .groupBy("product_id", "scraped_date").agg(F.min("price_piece").alias("price"))
    )


def last_n_dates(daily: DataFrame, n: int = HISTORY_BARS) -> DataFrame:
    """The newest n dates of each product. The window limit is applied before
    the shuffle, and its input is already one row per product and day."""
    newest_first = Window.partitionBy("product_id").orderBy(F.desc("scraped_date"))
    return (
        daily.withColumn("rn", F.row_number().over(newest_first))
        .filter(F.col("rn") <= n).drop("rn")
    )


def price_change(daily: DataFrame) -> DataFrame:
    """First-to-last change over the shown dates; flat when under half a percent."""
    shown = last_n_dates(daily).groupBy("product_id").agg(
        F.count("*").alias("points"),
        F.min(F.struct("scraped_date", "price")).alias("first"),
        F.max(F.struct("scraped_date", "price")).alias("last"),
    )
    first, last = F.col("first.price"), F.col("last.price")
    usable = (F.col("points") >= 2) & (first != 0)
    change = F.when(usable, (last - first) / first * 100)
    trend = (
        F.when(change.isNull(), F.lit(None).cast("string"))
        .when(F.abs(change) < 0.5, "stable").when(change < 0, "down").otherwise("up")
    )
    return shown.select("product_id", "points", change.alias("change_pct"), trend.alias("trend"))


def freshness(board: DataFrame, as_of: Column) -> DataFrame:
    """Age of the shown price in days, staleness flag and age class."""
    age = F.datediff(as_of, F.col("scraped_date"))
    label = (
        F.when(age <= 0, "today").when(age == 1, "yesterday")
        .when(age.isNotNull(), F.concat(age.cast("string"), F.lit(" days")))
    )
    return board.select(
        "*", age.alias("age_days"),
        F.coalesce(age > STALE_AFTER_DAYS, F.lit(False)).alias("is_stale"),
        label.alias("age_class"),
    )


def local_date(utc: Column, zone: str = "Europe/Athens") -> Column:
    """Calendar date in ``zone`` of a zone-less UTC clock reading."""
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), utc.cast("timestamp_ntz")))


def nest_listings(board: DataFrame) -> DataFrame:
    """One row per listing with its null-safe latest price as a struct.

    Rows are ordered by (product, listing) across range partitions, so a product's listings
    stand next to each other and no product, however many it has, is gathered in one row.
    """
    point = F.when(F.col("scraped_date").isNotNull(), F.struct(*PRICE_FIELDS))
    return board.select(
        "product_id", "id", "retailer", "retailer_sku", "url", point.alias("latest_price")
    ).orderBy("product_id", "id")


def nest_picked(board: DataFrame, product_ids: list[int]) -> DataFrame:
    """The listings of the products a caller picked, nested under each."""
    rows = nest_listings(board.filter(F.col("product_id").isin(product_ids)))
    item = F.struct("id", "retailer", "retailer_sku", "url", "latest_price")
    return rows.groupBy("product_id").agg(F.array_sort(F.collect_list(item)).alias("listings"))


def sort_listings(board: DataFrame) -> DataFrame:
    """Listings of each product from cheap to dear, unpriced last."""
    return board.orderBy("product_id", F.col("price_piece").asc_nulls_last(), "id")


def trending_head(products: DataFrame, n: int = 6) -> DataFrame:
    return products.orderBy("id").limit(n)
