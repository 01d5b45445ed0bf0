"""Quality checks and the daily refresh over the mapped tables."""

from pyspark.sql import functions as F

from aislegraph.functions import numbers
from aislegraph.operators import quality
from aislegraph.plans import refresh
from aislegraph.sources.tables import scan_targets
from aislegraph.workbench import duck
from aislegraph.workbench.registry import query
from aislegraph.workbench.tables import load, view, with_views


def captured(spark, sf):
    """Price captures as resolved pages, with a status derived from the line."""
    titles = view(spark, sf, "products").select(
        F.col("id").alias("product_id"), F.col("title").alias("product_title")
    )
    return view(spark, sf, "captures").withColumn(
        "status", F.when(F.col("seq") % 29 == 0, 404).when(F.col("seq") % 31 == 0, 410)
        .when(F.col("seq") % 37 == 0, 500).otherwise(200)
    ).join(titles, "product_id")


STATUS = """CASE WHEN seq % 29 = 0 THEN 404 WHEN seq % 31 = 0 THEN 410 WHEN seq % 37 = 0 THEN 500
                 ELSE 200 END"""
OUTCOMES = f""", resolved AS (
    SELECT c.*, p.title, {STATUS} AS status, p_size_value, p_size_unit FROM captures c JOIN (
        SELECT id, title, {duck.size_columns('title').replace('AS size_', 'AS p_size_')} FROM products
    ) p ON p.id = c.product_id
), outcomes AS (
    SELECT *, CASE WHEN status IN (404, 410) THEN 'gone' WHEN status <> 200 THEN 'failed'
                   WHEN price_piece IS NULL AND price_unit IS NULL THEN 'no_price'
                   ELSE 'priced' END AS outcome FROM resolved
)"""


@query("missing_price_errors", with_views("captures", """
    SELECT listing_id, seq, 'listing ' || cast(listing_id AS VARCHAR) || ' (' || retailer ||
           '): no price on the page' AS error
    FROM captures WHERE price_piece IS NULL AND price_unit IS NULL"""))
def missing_price_errors(spark, sf):
    return quality.missing_price_errors(view(spark, sf, "captures")).select("listing_id", "seq", "error")


@query("unit_price_sanity", with_views("captures products", f"""{OUTCOMES}, checked AS (
    SELECT *, CASE WHEN price_piece IS NOT NULL AND price_unit IS NOT NULL AND p_size_value <> 0
                    AND ((unit_label = 'κιλό' AND p_size_unit = 'g')
                         OR (unit_label = 'λίτρο' AND p_size_unit = 'ml'))
                   THEN price_piece / p_size_value * 1000 END AS computed FROM resolved)
    SELECT listing_id, seq, floor(computed * 1000000 + 0.5) / 1000000 AS computed_unit,
           coalesce(abs(computed - price_unit) / price_unit > 0.2, false) AS diverges FROM checked"""))
def unit_price_sanity(spark, sf):
    checked = quality.unit_price_sanity(captured(spark, sf))
    return checked.select(
        "listing_id", "seq", numbers.round6(F.col("computed_unit")).alias("computed_unit"), "diverges"
    )


@query("outcome_classify", with_views("captures products", f"""{OUTCOMES}
    SELECT listing_id, seq, status, outcome,
           CASE outcome WHEN 'gone' THEN 'warning' WHEN 'priced' THEN 'ok' ELSE 'error' END AS severity
    FROM outcomes"""))
def outcome_classify(spark, sf):
    return quality.outcome_classify(captured(spark, sf)).select(
        "listing_id", "seq", "status", "outcome", "severity"
    )


@query("run_summary", with_views("captures products", f"""{OUTCOMES}
    SELECT retailer, count(*) FILTER (outcome IN ('priced', 'gone')) AS ok,
           count(*) FILTER (outcome IN ('failed', 'no_price')) AS failed,
           count(*) FILTER (outcome = 'gone') AS warned FROM outcomes GROUP BY retailer"""))
def run_summary(spark, sf):
    return quality.run_summary(quality.outcome_classify(captured(spark, sf)))


MESSAGE = """retailer || ' ' || cast(listing_id AS VARCHAR) || ': ' || CASE outcome
    WHEN 'gone' THEN 'page no longer there' WHEN 'no_price' THEN 'no price on the page'
    ELSE 'status ' || cast(status AS VARCHAR) END"""


@query("run_messages", with_views("captures products", f"""{OUTCOMES}
    SELECT listing_id, retailer, CASE outcome WHEN 'gone' THEN 'warning' ELSE 'error' END AS severity,
           outcome AS code, {MESSAGE} AS message FROM outcomes WHERE outcome <> 'priced'"""))
def run_messages(spark, sf):
    return quality.run_messages(quality.outcome_classify(captured(spark, sf)))


@query("error_dedupe", with_views("captures products", f"""{OUTCOMES}
    SELECT DISTINCT {MESSAGE} AS message FROM outcomes WHERE outcome <> 'priced'"""))
def error_dedupe(spark, sf):
    return quality.error_dedupe(quality.run_messages(quality.outcome_classify(captured(spark, sf))))


def crawl_pages(spark, sf):
    """Order months as crawl runs, customers' orders as their pages; first pages announce 30 to 49 pages or nothing."""
    key = F.col("o_orderkey")
    orders = load(spark, sf, "orders")
    return orders.select(
        F.when(key % 2 == 0, "ab").otherwise("sklavenitis").alias("retailer"),
        F.date_format("o_orderdate", "yyyy-MM").alias("run_id"),
        (key % 40).cast("int").alias("page_no"),
        (F.col("o_orderpriority") != "5-LOW").alias("ok"),
        F.when((key % 40 == 0) & (key % 3 != 0), 30 + key % 20).cast("int").alias("announced"),
    )


@query("crawl_completeness", """WITH once AS (
    SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'ab' ELSE 'sklavenitis' END AS retailer,
           strftime(o_orderdate, '%Y-%m') AS run_id, o_orderkey % 40 AS page_no,
           bool_or(o_orderpriority <> '5-LOW') AS ok,
           max(30 + o_orderkey % 20) FILTER (o_orderkey % 40 = 0 AND o_orderkey % 3 <> 0
                                             AND o_orderpriority <> '5-LOW') AS announced
    FROM orders GROUP BY ALL
), runs AS (
    SELECT retailer, run_id, coalesce(bool_or(ok AND page_no = 0), false) AND retailer = 'ab' AS started,
           coalesce(max(announced), 1) AS expected, count(*) AS seen, count(*) FILTER (ok) AS good,
           list(page_no) FILTER (ok) AS numbers FROM once GROUP BY retailer, run_id
), judged AS (
    SELECT retailer, run_id, CASE WHEN retailer = 'ab' THEN expected ELSE seen END AS pages, started,
           CASE WHEN retailer = 'ab' THEN expected - len(list_filter(coalesce(numbers, []), lambda p: p < expected))
                ELSE seen - good END AS failed FROM runs)
    SELECT *, (started OR retailer <> 'ab') AND failed <= CASE WHEN retailer = 'ab' THEN 12 ELSE 20 END
           AS accepted FROM judged""")
def crawl_completeness(spark, sf):
    return quality.crawl_completeness(crawl_pages(spark, sf))


@query("category_pages", """WITH pages AS (
    SELECT strftime(o_orderdate, '%Y-%m') AS run_id, o_custkey % 10 AS category, o_orderkey AS page_no,
           o_orderpriority <> '5-LOW' AS ok,
           CASE WHEN o_orderstatus = 'P' THEN 3 ELSE 24 END AS rows FROM orders
), stops AS (
    SELECT run_id, category, min(page_no) AS stop FROM pages WHERE NOT ok OR rows < 24 GROUP BY ALL)
    SELECT p.run_id, p.category, p.page_no FROM pages p LEFT JOIN stops s USING (run_id, category)
    WHERE stop IS NULL OR page_no <= stop""")
def category_pages(spark, sf):
    pages = load(spark, sf, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM").alias("run_id"), (F.col("o_custkey") % 10).alias("category"),
        F.col("o_orderkey").alias("page_no"), (F.col("o_orderpriority") != "5-LOW").alias("ok"),
        F.when(F.col("o_orderstatus") == "P", 3).otherwise(24).alias("rows"),
    )
    return quality.category_pages(pages).select("run_id", "category", "page_no")


@query("confusion_metrics", """WITH m AS (
    SELECT count(*) FILTER (quality = 1 AND toxic = 0) AS tp, count(*) FILTER (quality = 0 AND toxic = 0) AS fp,
           count(*) FILTER (quality = 1 AND toxic = 1) AS fn, count(*) FILTER (quality = 0 AND toxic = 1) AS tn
    FROM labels)
    SELECT *, floor(CASE WHEN tp + fp = 0 THEN 1 ELSE tp / (tp + fp) END * 1000000 + 0.5) / 1000000 AS precision,
           floor(CASE WHEN tp + fn = 0 THEN 1 ELSE tp / (tp + fn) END * 1000000 + 0.5) / 1000000 AS recall
    FROM m""")
def confusion_metrics(spark, sf):
    made = quality.confusion_metrics(
        load(spark, sf, "labels"), F.col("quality") == 1, F.col("toxic") == 0
    )
    return made.withColumns({
        "precision": numbers.round6(F.col("precision")), "recall": numbers.round6(F.col("recall"))
    })


def price_catalog(spark, sf):
    """Crawled catalog: every capture that loaded, in capture order."""
    return captured(spark, sf).filter("status = 200").select(
        "retailer", F.col("listing_id").cast("string").alias("sku"), F.col("seq").alias("pos"),
        "price_piece", "price_unit", "unit_label",
        F.concat(F.lit("https://img.example.com/c/"), F.col("listing_id").cast("string")).alias("image_url"),
    )


def targets(spark, sf):
    return scan_targets(view(spark, sf, "listings"), view(spark, sf, "products"))


@query("catalog_price_join", with_views("listings captures", f""", cat AS (
    SELECT retailer, cast(listing_id AS VARCHAR) AS sku, price_piece, price_unit FROM captures
    WHERE {STATUS} = 200
    QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY seq DESC, price_piece DESC NULLS LAST) = 1)
    SELECT l.id, l.retailer, c.price_piece, c.price_unit, c.sku IS NOT NULL AS hit
    FROM listings l LEFT JOIN cat c ON c.retailer = l.retailer AND c.sku = l.retailer_sku"""))
def catalog_price_join(spark, sf):
    joined = refresh.catalog_price_join(targets(spark, sf), price_catalog(spark, sf))
    return joined.select(
        "id", "retailer", "price_piece", "price_unit", F.coalesce("hit", F.lit(False)).alias("hit")
    )


@query("catalog_misses", with_views("listings captures", f"""
    SELECT id, retailer FROM listings WHERE id NOT IN (
        SELECT listing_id FROM captures WHERE {STATUS} = 200)"""))
def catalog_misses(spark, sf):
    return refresh.catalog_misses(targets(spark, sf), price_catalog(spark, sf)).select("id", "retailer")


def refreshed(spark, sf):
    pages = captured(spark, sf).groupBy("listing_id").agg(
        F.max(F.struct("seq", "status", "price_piece", "price_unit", "unit_label")).alias("p")
    ).select("listing_id", "p.status", "p.price_piece", "p.price_unit", "p.unit_label",
             F.lit(None).cast("string").alias("image_url"))
    history = view(spark, sf, "captures").select(
        "listing_id", "scraped_date", F.col("scraped_at").cast("timestamp_ntz").alias("scraped_at"), "seq",
        "price_piece", "price_unit", "unit_label",
    )
    return refresh.daily_refresh(
        targets(spark, sf), view(spark, sf, "products"), history, price_catalog(spark, sf), pages,
        F.lit("2002-01-01").cast("date"), F.lit("2002-01-01 07:15:00").cast("timestamp_ntz"),
        F.lit(10**12).cast("bigint"),
    )


REFRESH = f""", cat AS (
    SELECT listing_id, 200 AS status, price_piece, price_unit, unit_label FROM captures
    WHERE {STATUS} = 200
    QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY seq DESC, price_piece DESC NULLS LAST) = 1
), live AS (
    SELECT listing_id, {STATUS} AS status, price_piece, price_unit, unit_label FROM captures
    QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY seq DESC, price_piece DESC NULLS LAST) = 1
), resolved AS (
    SELECT l.id AS listing_id, l.product_id, l.retailer, coalesce(c.status, p.status, 0) AS status,
           CASE WHEN c.status IS NULL THEN p.price_piece ELSE c.price_piece END AS price_piece,
           CASE WHEN c.status IS NULL THEN p.price_unit ELSE c.price_unit END AS price_unit
    FROM listings l LEFT JOIN cat c ON c.listing_id = l.id LEFT JOIN live p ON p.listing_id = l.id
    WHERE l.retailer IN ('ab', 'kritikos') UNION ALL
    SELECT l.id, l.product_id, l.retailer, coalesce(p.status, 0), p.price_piece, p.price_unit
    FROM listings l LEFT JOIN live p ON p.listing_id = l.id WHERE l.retailer NOT IN ('ab', 'kritikos')
), outcomes AS (
    SELECT *, CASE WHEN status IN (404, 410) THEN 'gone' WHEN status <> 200 THEN 'failed'
                   WHEN price_piece IS NULL AND price_unit IS NULL THEN 'no_price'
                   ELSE 'priced' END AS outcome FROM resolved
)"""


@query("daily_refresh", with_views("listings captures", f"""{REFRESH}
    SELECT retailer, count(*) FILTER (outcome IN ('priced', 'gone')) AS ok,
           count(*) FILTER (outcome IN ('failed', 'no_price')) AS failed,
           count(*) FILTER (outcome = 'gone') AS warned FROM outcomes GROUP BY retailer"""))
def daily_refresh(spark, sf):
    return refreshed(spark, sf).summary


@query("daily_refresh_history", with_views("listings captures", f"""{REFRESH}
    SELECT listing_id, cast(scraped_date AS VARCHAR) AS scraped_date, price_piece, price_unit FROM (
        SELECT listing_id, scraped_date, price_piece, price_unit FROM captures
        QUALIFY row_number() OVER (PARTITION BY listing_id, scraped_date ORDER BY seq DESC) = 1)
    UNION ALL
    SELECT listing_id, '2002-01-01', price_piece, price_unit FROM outcomes WHERE outcome = 'priced'"""))
def daily_refresh_history(spark, sf):
    return refreshed(spark, sf).history.select(
        "listing_id", F.date_format("scraped_date", "yyyy-MM-dd").alias("scraped_date"), "price_piece",
        "price_unit",
    )
