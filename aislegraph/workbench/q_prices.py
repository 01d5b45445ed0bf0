"""Price boards, history and store statistics over the mapped tables."""

from pyspark.sql import functions as F

from aislegraph.functions import numbers
from aislegraph.model import LISTINGS, PRODUCTS, retailer_dim
from aislegraph.operators import filters, prices
from aislegraph.sources import tables as sources
from aislegraph.workbench.registry import query
from aislegraph.workbench.tables import view, with_views

LATEST = """latest AS (
    SELECT listing_id, scraped_date, price_piece, price_unit, unit_label
    FROM captures
    QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY scraped_date DESC, seq DESC) = 1
)"""
BOARD = LATEST + """, board AS (
    SELECT l.id, l.product_id, l.retailer, l.retailer_sku, l.url,
           p.scraped_date, p.price_piece, p.price_unit, p.unit_label
    FROM listings l LEFT JOIN latest p ON p.listing_id = l.id
)"""
RANGES = BOARD + """, ranges AS (
    SELECT product_id, min(price_piece) AS min_price, max(price_piece) AS max_price,
           count(*) AS listings
    FROM board GROUP BY product_id
), best AS (
    SELECT product_id, id AS best_listing_id, retailer AS best_retailer, price_piece
    FROM board WHERE price_piece IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY price_piece, id) = 1
), rows AS (
    SELECT r.product_id, p.brand, p.title, r.listings, b.best_listing_id, b.best_retailer,
           r.min_price, r.max_price, coalesce(r.max_price - r.min_price, -1) AS saving
    FROM ranges r JOIN products p ON p.id = r.product_id LEFT JOIN best b USING (product_id)
)"""
DAILY = """daily AS (
    SELECT product_id, scraped_date, min(price_piece) AS price FROM captures
    WHERE price_piece IS NOT NULL GROUP BY ALL
), shown AS (
    SELECT * FROM daily
    QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY scraped_date DESC) <= 14
)"""
DIM = """dim(ordinal, retailer, label) AS (VALUES
    (0, 'sklavenitis', 'Sklavenitis'), (1, 'ab', 'AB Vassilopoulos'), (2, 'lidl', 'Lidl'),
    (3, 'masoutis', 'Masoutis'), (4, 'mymarket', 'My Market'), (5, 'kritikos', 'Kritikos'),
    (6, 'galaxias', 'Galaxias'))"""


def day(col="scraped_date"):
    return F.date_format(col, "yyyy-MM-dd").alias(col)


def board(spark, sf):
    return prices.listing_latest(view(spark, sf, "listings"), view(spark, sf, "captures"))


def rows(spark, sf):
    return prices.price_board(
        view(spark, sf, "products"), view(spark, sf, "listings"), view(spark, sf, "captures")
    )


@query("scan_model", with_views("products", """
    SELECT id, ean, brand, title, size_value, size_unit, image_url FROM products"""))
def scan_model(spark, sf):
    return sources.conform(view(spark, sf, "products"), PRODUCTS)


@query("scan_targets", with_views("products listings", """
    SELECT l.id, l.product_id, l.retailer, l.retailer_sku, l.url,
           p.brand AS product_brand, p.title AS product_title, p.image_url AS product_image
    FROM listings l JOIN products p ON p.id = l.product_id"""))
def scan_targets(spark, sf):
    return sources.scan_targets(
        sources.conform(view(spark, sf, "listings"), LISTINGS), view(spark, sf, "products")
    )


@query("listing_product_join", with_views("products listings", """
    SELECT p.brand AS product_brand, l.retailer, count(*) AS listings
    FROM listings l JOIN products p ON p.id = l.product_id GROUP BY ALL"""))
def listing_product_join(spark, sf):
    joined = prices.listing_product_join(view(spark, sf, "listings"), view(spark, sf, "products"))
    return joined.groupBy("product_brand", "retailer").agg(F.count("*").alias("listings"))


@query("listing_latest_left_join", with_views("listings captures", f""", {BOARD}
    SELECT id, product_id, retailer, cast(scraped_date AS VARCHAR) AS scraped_date,
           price_piece, price_unit, unit_label FROM board"""))
def listing_latest_left_join(spark, sf):
    return board(spark, sf).select(
        "id", "product_id", "retailer", day(), "price_piece", "price_unit", "unit_label"
    )


@query("history_join", with_views("listings captures", """
    SELECT c.listing_id, l.product_id, l.retailer, cast(c.scraped_date AS VARCHAR) AS scraped_date,
           c.seq, c.price_piece, c.price_unit
    FROM captures c JOIN listings l ON l.id = c.listing_id
    ORDER BY l.product_id, c.scraped_date"""))
def history_join(spark, sf):
    joined = prices.history_of(view(spark, sf, "captures"), view(spark, sf, "listings"))
    return joined.select(
        "listing_id", "product_id", "retailer", day(), "seq", "price_piece", "price_unit"
    ).orderBy("product_id", "scraped_date")


@query("latest_price", with_views("captures", f""", {LATEST}
    SELECT listing_id, cast(scraped_date AS VARCHAR) AS scraped_date, price_piece, price_unit,
           unit_label FROM latest"""))
def latest_price(spark, sf):
    return prices.latest_price(view(spark, sf, "captures")).select(
        "listing_id", day(), "price_piece", "price_unit", "unit_label"
    )


@query("cheapest_listing", with_views("listings captures", f""", {BOARD}
    SELECT product_id, price_piece, id AS listing_id, retailer FROM board
    WHERE price_piece IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY price_piece, id) = 1"""))
def cheapest_listing(spark, sf):
    return prices.cheapest_listing(board(spark, sf))


@query("price_range", with_views("listings captures", f""", {BOARD}
    SELECT product_id, min(price_piece) AS min_price, max(price_piece) AS max_price
    FROM board GROUP BY product_id"""))
def price_range(spark, sf):
    return prices.price_range(board(spark, sf))


@query("product_saving", with_views("products listings captures", f""", {RANGES}
    SELECT product_id, saving FROM rows"""))
def product_saving(spark, sf):
    return rows(spark, sf).select("product_id", "saving")


@query("biggest_saving", with_views("products listings captures", f""", {RANGES}
    SELECT CASE WHEN max(max_price - min_price) > 0 THEN max(max_price - min_price) END
           AS biggest_saving FROM rows"""))
def biggest_saving(spark, sf):
    return prices.biggest_saving(rows(spark, sf))


@query("cheapest_product", with_views("products listings captures", f""", {RANGES}
    SELECT product_id, min_price FROM rows WHERE min_price IS NOT NULL
    ORDER BY min_price, saving DESC, product_id LIMIT 1"""))
def cheapest_product(spark, sf):
    return prices.cheapest_product(rows(spark, sf), (-F.col("saving")).alias("s"))


@query("store_stats", with_views("listings captures", f""", {BOARD}, {DIM}, best AS (
    SELECT retailer FROM board WHERE price_piece IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY price_piece, id) = 1)
    SELECT ordinal, retailer, label,
           (SELECT count(*) FROM board b WHERE b.retailer = dim.retailer) AS listings,
           (SELECT count(*) FROM best b WHERE b.retailer = dim.retailer) AS cheapest
    FROM dim"""))
def store_stats(spark, sf):
    return prices.store_stats(board(spark, sf), retailer_dim(spark))


@query("coverage_summary", with_views("products listings", """
    SELECT (SELECT count(*) FROM products) AS products, count(*) AS listings,
           count(DISTINCT retailer) AS active_stores, cast(7 AS BIGINT) AS all_stores
    FROM listings"""))
def coverage_summary(spark, sf):
    return prices.coverage_summary(
        view(spark, sf, "products"), view(spark, sf, "listings"), retailer_dim(spark)
    )


@query("retailer_count", with_views("listings", """
    SELECT count(DISTINCT retailer) AS retailers FROM listings"""))
def retailer_count(spark, sf):
    return prices.retailer_count(view(spark, sf, "listings"))


@query("tracked_retailers", with_views("listings", f""", {DIM}
    SELECT ordinal, retailer FROM dim WHERE retailer IN (SELECT retailer FROM listings)
    ORDER BY ordinal"""))
def tracked_retailers(spark, sf):
    return prices.tracked_retailers(view(spark, sf, "listings"), retailer_dim(spark)).select(
        "ordinal", "retailer"
    )


@query("daily_min_price", with_views("captures", f""", {DAILY}
    SELECT product_id, cast(scraped_date AS VARCHAR) AS scraped_date, price FROM daily"""))
def daily_min_price(spark, sf):
    return prices.daily_min_price(view(spark, sf, "captures")).select("product_id", day(), "price")


@query("last_n_dates", with_views("captures", f""", {DAILY}
    SELECT product_id, cast(scraped_date AS VARCHAR) AS scraped_date, price FROM shown"""))
def last_n_dates(spark, sf):
    daily = prices.daily_min_price(view(spark, sf, "captures"))
    return prices.last_n_dates(daily).select("product_id", day(), "price")


@query("price_change", with_views("captures", f""", {DAILY}, ends AS (
    SELECT product_id, count(*) AS points, arg_min(price, scraped_date) AS f,
           arg_max(price, scraped_date) AS l FROM shown GROUP BY product_id
    ), changes AS (
    SELECT product_id, points, CASE WHEN points >= 2 AND f <> 0 THEN (l - f) / f * 100 END AS c
    FROM ends)
    SELECT product_id, points, floor(c * 1000000 + 0.5) / 1000000 AS change_pct,
           CASE WHEN c IS NULL THEN NULL WHEN abs(c) < 0.5 THEN 'stable'
                WHEN c < 0 THEN 'down' ELSE 'up' END AS trend FROM changes"""))
def price_change(spark, sf):
    daily = prices.daily_min_price(view(spark, sf, "captures"))
    return prices.price_change(daily).withColumn("change_pct", numbers.round6(F.col("change_pct")))


@query("freshness", with_views("listings captures", f""", {BOARD}, aged AS (
    SELECT id, datediff('day', scraped_date, (SELECT max(scraped_date) FROM captures)) AS age
    FROM board)
    SELECT id, age AS age_days, coalesce(age > 2, false) AS is_stale,
           CASE WHEN age <= 0 THEN 'today' WHEN age = 1 THEN 'yesterday'
                WHEN age IS NOT NULL THEN cast(age AS VARCHAR) || ' days' END AS age_class
    FROM aged"""))
def freshness(spark, sf):
    # The as-of date is a one-row aggregate, attached as a scalar.
    as_of = view(spark, sf, "captures").agg(F.max("scraped_date").alias("as_of"))
    aged = prices.freshness(board(spark, sf).crossJoin(F.broadcast(as_of)), F.col("as_of"))
    return aged.select("id", F.col("age_days").cast("bigint").alias("age_days"), "is_stale", "age_class")


@query("local_date", """
    SELECT event_id, cast(cast(timezone('Europe/Athens', timezone('UTC', ts)) AS DATE) AS VARCHAR)
           AS local_date FROM events""")
def local_date(spark, sf):
    return view(spark, sf, "events").select(
        "event_id", F.date_format(prices.local_date(F.col("ts")), "yyyy-MM-dd").alias("local_date")
    )


@query("nest_listings", with_views("listings captures", f""", {BOARD}
    SELECT product_id, id AS listing_id, retailer, scraped_date IS NOT NULL AS has_latest,
           price_piece, price_unit FROM board"""))
def nest_listings(spark, sf):
    latest = F.col("latest_price")
    return prices.nest_listings(board(spark, sf)).select(
        "product_id", F.col("id").alias("listing_id"), "retailer", latest.isNotNull().alias("has_latest"),
        latest["price_piece"].alias("price_piece"), latest["price_unit"].alias("price_unit"),
    )


@query("sort_results", with_views("products listings captures", f""", {RANGES}
    SELECT * FROM rows ORDER BY saving DESC, product_id"""))
def sort_results(spark, sf):
    return prices.sort_board(rows(spark, sf), "saving")


@query("sort_results_by_name", with_views("products listings captures", f""", {RANGES}
    SELECT product_id, title, min_price FROM rows"""))
def sort_results_by_name(spark, sf):
    return prices.sort_board(rows(spark, sf), "name").select("product_id", "title", "min_price")


@query("sort_listings_by_price", with_views("listings captures", f""", {BOARD}
    SELECT product_id, id, price_piece FROM board
    ORDER BY product_id, price_piece NULLS LAST, id"""))
def sort_listings_by_price(spark, sf):
    return prices.sort_listings(board(spark, sf)).select("product_id", "id", "price_piece")


@query("trending_head", with_views("products", """
    SELECT id, brand, title FROM products ORDER BY id LIMIT 6"""))
def trending_head(spark, sf):
    return prices.trending_head(view(spark, sf, "products")).select("id", "brand", "title")


@query("text_filter", with_views("products", """
    SELECT id, brand, title FROM products
    WHERE contains(lower(brand || ' ' || title), 'γάλα')"""))
def text_filter(spark, sf):
    return filters.text_filter(view(spark, sf, "products"), " ΓΆΛΑ ").select("id", "brand", "title")


@query("retailer_filter", with_views("listings", """
    SELECT id, product_id, retailer FROM listings WHERE retailer IN ('lidl', 'ab')"""))
def retailer_filter(spark, sf):
    return filters.retailer_filter(view(spark, sf, "listings"), ["lidl", "ab", "unknown"]).select(
        "id", "product_id", "retailer"
    )


@query("has_price", with_views("captures", """
    SELECT listing_id, seq, price_piece IS NOT NULL OR price_unit IS NOT NULL AS has_price
    FROM captures"""))
def has_price(spark, sf):
    return view(spark, sf, "captures").select(
        "listing_id", "seq",
        filters.has_price(F.col("price_piece"), F.col("price_unit")).alias("has_price"),
    )


@query("display_labels", with_views("products captures", """
    SELECT c.listing_id, c.seq,
           CASE WHEN p.size_value IS NOT NULL
                THEN cast(cast(p.size_value AS BIGINT) AS VARCHAR) || p.size_unit END AS size_label,
           CASE WHEN c.price_unit IS NOT NULL
                THEN replace(replace(replace(format('{:,.2f}', c.price_unit), ',', '#'), '.', ','),
                             '#', '.') || ' €/' || c.unit_label END AS unit_price_label
    FROM captures c JOIN products p ON p.id = c.product_id"""))
def display_labels(spark, sf):
    joined = view(spark, sf, "captures").join(
        view(spark, sf, "products").select(F.col("id").alias("product_id"), "size_value", "size_unit"),
        "product_id",
    )
    return joined.select(
        "listing_id", "seq",
        numbers.size_label(F.col("size_value"), F.col("size_unit")).alias("size_label"),
        numbers.unit_price_label(F.col("price_unit"), F.col("unit_label")).alias("unit_price_label"),
    )
