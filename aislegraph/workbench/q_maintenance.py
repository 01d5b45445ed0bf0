"""Sinks over old and new batches of the given tables."""

from pyspark.sql import functions as F

from aislegraph.model import RETAILER_IDS, retailer_dim
from aislegraph.operators import maintenance as m
from aislegraph.session import shared_folder
from aislegraph.sources.stores import CatalogStore, PriceStore
from aislegraph.workbench.registry import query
from aislegraph.workbench.tables import load, view, with_views

HISTORY = ["listing_id", "scraped_date", "seq", "price_piece", "price_unit", "unit_label"]


def day(col="scraped_date"):
    return F.date_format(col, "yyyy-MM-dd").alias(col)


def history(spark, sf):
    return view(spark, sf, "captures").select(*HISTORY, "l_linenumber")


def split_history(spark, sf):
    rows = history(spark, sf)
    return (
        rows.filter("l_linenumber <= 3").drop("l_linenumber"),
        rows.filter("l_linenumber > 3").drop("l_linenumber"),
    )


UPSERT = """SELECT listing_id, cast(scraped_date AS VARCHAR) AS scraped_date, seq, price_piece,
       price_unit FROM captures
QUALIFY row_number() OVER (PARTITION BY listing_id, scraped_date ORDER BY seq DESC) = 1"""


@query("upsert_daily_price", with_views("captures", UPSERT))
def upsert_daily_price(spark, sf):
    old, new = split_history(spark, sf)
    return m.upsert_daily_price(old, new).select(
        "listing_id", day(), "seq", "price_piece", "price_unit"
    )


@query("ordered_last_wins", with_views("captures", """
    SELECT product_id, retailer, seq, price_piece FROM captures
    QUALIFY row_number() OVER (PARTITION BY product_id, retailer
                                 ORDER BY seq DESC, price_piece DESC NULLS LAST) = 1"""))
def ordered_last_wins(spark, sf):
    rows = view(spark, sf, "captures").select("product_id", "retailer", "seq", "price_piece")
    return m.last_wins(rows, ["product_id", "retailer"], ["seq"])


@query("first_wins_dedupe", """
    SELECT md5(text) AS content, min(doc_id) AS doc_id FROM documents GROUP BY 1""")
def first_wins_dedupe(spark, sf):
    docs = load(spark, sf, "documents").select(F.md5("text").alias("content"), "doc_id")
    return m.first_wins(docs, ["content"], ["doc_id"])


# Every capture is history except those of the last day of a listing's product at a retailer, which seed.
@query("seed_price", with_views("captures listings", """, days AS (
    SELECT *, scraped_date = max(scraped_date) OVER (PARTITION BY product_id, retailer) AS last_day FROM captures
    ), rows_ AS (
    SELECT listing_id, scraped_date, seq, price_piece, price_unit FROM days WHERE NOT last_day
    UNION ALL
    SELECT l.id, DATE '2002-01-01', c.seq + 1000000000000, c.price_piece, c.price_unit
    FROM days c JOIN listings l ON l.product_id = c.product_id AND l.retailer = c.retailer
         AND l.retailer_sku = cast(c.listing_id AS VARCHAR)
    WHERE c.last_day AND (c.price_piece IS NOT NULL OR c.price_unit IS NOT NULL))
    SELECT listing_id, cast(scraped_date AS VARCHAR) AS scraped_date, seq, price_piece, price_unit FROM rows_
    QUALIFY row_number() OVER (PARTITION BY listing_id, scraped_date ORDER BY seq DESC) = 1"""))
def seed_price(spark, sf):
    captured = view(spark, sf, "captures")
    pair = ["product_id", "retailer"]
    last = captured.groupBy(*pair).agg(F.max("scraped_date").alias("last_day"))
    dated = captured.join(last, pair)
    seeds = dated.filter("scraped_date = last_day").select(
        *pair, F.col("listing_id").cast("string").alias("retailer_sku"),
        F.lit("2002-01-01").cast("date").alias("scraped_date"),
        (F.col("seq") + F.lit(1000000000000)).alias("seq"),
        "price_piece", "price_unit", "unit_label",
    )
    old = dated.filter("scraped_date < last_day").select(*HISTORY)
    return m.seed_price(view(spark, sf, "listings"), seeds, old).select(
        "listing_id", day(), "seq", "price_piece", "price_unit"
    )


def accepted(spark):
    return retailer_dim(spark).filter(F.col("retailer") != "galaxias").select("retailer")


SNAPSHOT = """, snapshot AS (
    SELECT * FROM catalog_old WHERE retailer IN ('galaxias', 'lidl') UNION ALL
    SELECT * FROM catalog_new WHERE retailer NOT IN ('galaxias', 'lidl'))"""


@query("catalog_upsert_prune", with_views("catalog_old catalog_new", f"""{SNAPSHOT}
    SELECT retailer, sku, price_piece FROM snapshot"""))
def catalog_upsert_prune(spark, sf):
    return m.catalog_upsert_prune(
        view(spark, sf, "catalog_old"), view(spark, sf, "catalog_new"), accepted(spark)
    )


@query("catalog_store_swap", with_views("catalog_old catalog_new", f"""{SNAPSHOT}
    SELECT retailer, sku, price_piece FROM snapshot"""))
def catalog_store_swap(spark, sf):
    """The same snapshot, as two stored versions and a manifest."""
    store = CatalogStore(spark, shared_folder(spark, "catalog"))
    store.replace(view(spark, sf, "catalog_old"))
    store.replace(view(spark, sf, "catalog_new").join(F.broadcast(accepted(spark)), "retailer", "left_semi"))
    return store.read().select("retailer", "sku", "price_piece")


@query("price_store_merge", with_views("captures", UPSERT))
def price_store_merge(spark, sf):
    """All captures as three batches with a compaction between."""
    store = PriceStore(spark, shared_folder(spark, "prices"))
    rows = history(spark, sf).drop("l_linenumber")
    for batch_id in range(3):
        store.append(rows.filter(F.pmod(F.xxhash64("seq"), F.lit(3)) == batch_id), batch_id)
        if batch_id == 1:
            store.compact()
    return store.read().select("listing_id", day(), "seq", "price_piece", "price_unit")


@query("catalog_diff", with_views("catalog_old catalog_new", f"""{SNAPSHOT}
    SELECT coalesce(o.retailer, n.retailer) AS retailer,
           CASE WHEN o.sku IS NULL THEN 'inserted' WHEN n.sku IS NULL THEN 'pruned'
                WHEN o.price_piece IS NOT DISTINCT FROM n.price_piece THEN 'unchanged'
                ELSE 'updated' END AS change, count(*) AS rows
    FROM catalog_old o FULL JOIN snapshot n ON o.retailer = n.retailer AND o.sku = n.sku
    GROUP BY ALL"""))
def catalog_diff(spark, sf):
    old = view(spark, sf, "catalog_old")
    new = m.catalog_upsert_prune(old, view(spark, sf, "catalog_new"), accepted(spark))
    return m.catalog_diff(old, new)


@query("prune_difference", with_views("catalog_old catalog_new", """
    SELECT o.retailer, o.sku, o.price_piece FROM catalog_old o
    ANTI JOIN catalog_new n ON o.retailer = n.retailer AND o.sku = n.sku"""))
def prune_difference(spark, sf):
    return m.prune_difference(view(spark, sf, "catalog_old"), view(spark, sf, "catalog_new"))


def tracked(spark, sf):
    return view(spark, sf, "listings").filter("id % 3 <> 0")


def link_batch(spark, sf):
    return view(spark, sf, "captures").select(
        F.col("listing_id").alias("id"), "product_id", "retailer",
        F.col("listing_id").cast("string").alias("retailer_sku"),
        F.concat(F.lit("u"), F.col("seq").cast("string")).alias("url"), "seq",
    )


@query("insert_ignore_listings", with_views("listings captures", """
    SELECT id, product_id, retailer, retailer_sku, url FROM listings WHERE id % 3 <> 0
    UNION ALL
    SELECT listing_id, product_id, retailer, cast(listing_id AS VARCHAR),
           'u' || cast(min(seq) AS VARCHAR)
    FROM captures WHERE listing_id % 3 = 0 GROUP BY ALL"""))
def insert_ignore_listings(spark, sf):
    return m.insert_ignore_listings(tracked(spark, sf), link_batch(spark, sf))


@query("image_backfill", with_views("products captures", """, seen AS (
    SELECT product_id, 'https://cdn.example.com/' || cast(arg_min(listing_id, seq) AS VARCHAR)
           AS image FROM captures WHERE l_linenumber % 4 = 0 GROUP BY product_id)
    SELECT p.id, coalesce(p.image_url, s.image) AS image_url
    FROM products p LEFT JOIN seen s ON s.product_id = p.id"""))
def image_backfill(spark, sf):
    shown = F.when(
        F.col("l_linenumber") % 4 == 0,
        F.concat(F.lit("https://cdn.example.com/"), F.col("listing_id").cast("string")),
    )
    observed = view(spark, sf, "captures").select("product_id", "seq", shown.alias("image_url"))
    return m.image_backfill(view(spark, sf, "products"), observed).select("id", "image_url")


def patches(spark, sf):
    flat = view(spark, sf, "patches")

    def part(flag, *pairs):
        entries = [F.struct(F.lit(k).alias("key"), F.col(c).alias("value")) for k, c in pairs]
        return F.when(F.col(flag), F.array(*entries)).otherwise(
            F.array().cast("array<struct<key:string,value:string>>")
        )

    sent = F.map_from_entries(F.concat(
        part("has_title", ("title", "title")), part("has_brand", ("brand", "brand")),
        part("has_ean", ("ean", "ean")),
        part("has_size", ("sizeValue", "size_value"), ("sizeUnit", "size_unit")),
        part("has_image", ("imageUrl", "image_url")),
    ))
    return flat.select("seq", "product_id", sent.alias("sent"))


PATCHED = """, checked AS (
    SELECT c.*, p.id IS NOT NULL AS known,
           CASE WHEN has_ean AND c.ean IS NOT NULL AND NOT regexp_full_match(c.ean, '[0-9]{8,14}')
                     THEN 'bad_ean'
                WHEN has_brand AND coalesce(trim(c.brand), '') = ''
                     THEN 'empty_brand'
                WHEN has_title AND coalesce(trim(c.title), '') = ''
                     THEN 'empty_title'
                WHEN has_size AND try_cast(c.size_value AS DOUBLE) IS NULL
                     THEN 'bad_size'
                WHEN NOT (has_ean OR has_brand OR has_title OR has_size OR has_image)
                     THEN 'nothing_to_edit' END AS problem
    FROM patches c LEFT JOIN products p ON p.id = c.product_id
), claims AS (
    SELECT ean, -1 AS seq, id FROM products WHERE ean IS NOT NULL UNION ALL
    SELECT ean, seq, product_id FROM checked
    WHERE problem IS NULL AND known AND has_ean AND ean IS NOT NULL
), owners AS (
    SELECT ean, id AS owner FROM claims
    QUALIFY row_number() OVER (PARTITION BY ean ORDER BY seq, id) = 1
), report AS (
    SELECT c.*, CASE WHEN problem IS NOT NULL THEN 'invalid' WHEN NOT known THEN 'not_found'
                     WHEN has_ean AND o.owner <> product_id THEN 'conflict' ELSE 'applied'
                END AS status
    FROM checked c LEFT JOIN owners o ON o.ean = c.ean AND c.has_ean
)"""


@query("sparse_patch_report", with_views("products patches", f"""{PATCHED}
    SELECT seq, product_id, status, problem FROM report"""))
def sparse_patch_report(spark, sf):
    return m.sparse_patch_report(view(spark, sf, "products"), patches(spark, sf)).drop("sent")


@query("sparse_patch", with_views("products patches", f"""{PATCHED}, lasts AS (
    SELECT product_id, max(seq) FILTER (has_ean) AS e, max(seq) FILTER (has_brand) AS b,
           max(seq) FILTER (has_title) AS t, max(seq) FILTER (has_size) AS s,
           max(seq) FILTER (has_image) AS i
    FROM report WHERE status = 'applied' GROUP BY product_id)
    SELECT p.id, CASE WHEN e IS NULL THEN p.ean ELSE re.ean END AS ean,
           CASE WHEN b IS NULL THEN p.brand ELSE trim(rb.brand) END AS brand,
           CASE WHEN t IS NULL THEN p.title ELSE trim(rt.title) END AS title,
           CASE WHEN s IS NULL THEN p.size_value ELSE cast(rs.size_value AS DOUBLE) END
               AS size_value,
           CASE WHEN s IS NULL THEN p.size_unit ELSE nullif(trim(rs.size_unit), '') END
               AS size_unit,
           CASE WHEN i IS NULL THEN p.image_url ELSE ri.image_url END AS image_url
    FROM products p LEFT JOIN lasts l ON l.product_id = p.id
    LEFT JOIN report re ON re.seq = e LEFT JOIN report rb ON rb.seq = b
    LEFT JOIN report rt ON rt.seq = t LEFT JOIN report rs ON rs.seq = s
    LEFT JOIN report ri ON ri.seq = i"""))
def sparse_patch(spark, sf):
    return m.sparse_patch(view(spark, sf, "products"), patches(spark, sf))


def creation_requests(spark, sf):
    """Requests to create a product for every customer, some malformed."""
    c = F.col("c_custkey")
    link = F.struct(
        F.when(c % 13 != 0, F.element_at(F.array(*map(F.lit, RETAILER_IDS)), (c % 7 + 1).cast("int")))
        .alias("retailer"),
        c.cast("string").alias("retailer_sku"),
        F.concat(F.lit("https://x.example.com/"), c.cast("string")).alias("url"),
        F.col("c_acctbal").alias("price_piece"),
    )
    return load(spark, sf, "customer").select(
        (c + 1).alias("seq"),
        F.when(c % 11 == 0, "  ").otherwise(F.concat(F.lit(" "), F.col("c_mktsegment"))).alias("brand"),
        F.col("c_name").alias("title"),
        F.when(c % 17 == 0, "12").when(c % 2 == 0, (F.lit(5200000000000) + c % 500).cast("string"))
        .alias("ean"),
        F.lit(None).cast("double").alias("size_value"), F.lit(None).cast("string").alias("size_unit"),
        F.lit("").alias("image_url"), F.array(link).alias("listings"),
    )


CREATION = """, requests AS (
    SELECT c_custkey + 1 AS seq, CASE WHEN c_custkey % 11 = 0 THEN '  ' ELSE c_mktsegment END AS brand,
           c_name AS title, c_custkey % 13 = 0 AS bad_link,
           CASE WHEN c_custkey % 17 = 0 THEN '12' WHEN c_custkey % 2 = 0
                THEN cast(5200000000000 + c_custkey % 500 AS VARCHAR) END AS ean
    FROM customer
), checked AS (
    SELECT *, CASE WHEN trim(brand) = '' THEN 'missing_brand'
                   WHEN ean = '12' THEN 'bad_ean'
                   WHEN bad_link THEN 'incomplete_listing'
              END AS problem FROM requests
), report AS (
    SELECT c.seq, c.brand, c.title, c.ean,
           coalesce(problem, CASE WHEN c.ean IN (SELECT ean FROM products WHERE ean IS NOT NULL)
               OR c.seq > (SELECT min(d.seq) FROM checked d WHERE d.ean = c.ean AND d.problem IS NULL)
               THEN 'ean_taken' END) AS reason
    FROM checked c
)"""


@query("create_product_checked", with_views("products", f"""{CREATION}
    SELECT seq, brand, title, reason,
           CASE WHEN reason IS NULL THEN seq + (SELECT max(id) FROM products) END AS new_id
    FROM report"""))
def create_product_checked(spark, sf):
    report = m.create_product_report(view(spark, sf, "products"), creation_requests(spark, sf))
    brand = F.when(F.trim("brand") != "", F.trim("brand")).otherwise(F.col("brand"))
    return report.select("seq", brand.alias("brand"), "title", "reason", "new_id")


@query("create_product_links", with_views("products listings", f"""{CREATION}
    SELECT seq + (SELECT max(id) FROM products) AS product_id, cast(seq - 1 AS VARCHAR)
           AS retailer_sku FROM report WHERE reason IS NULL AND NOT EXISTS (
        SELECT 1 FROM listings l WHERE l.retailer_sku = cast(report.seq - 1 AS VARCHAR)
        AND l.retailer = ['sklavenitis', 'ab', 'lidl', 'masoutis', 'mymarket', 'kritikos',
                          'galaxias'][(report.seq - 1) % 7 + 1])"""))
def create_product_links(spark, sf):
    report = m.create_product_report(view(spark, sf, "products"), creation_requests(spark, sf))
    batch = m.created_links(report)
    return m.listings_to_add(view(spark, sf, "listings"), batch).select("product_id", "retailer_sku")


DOOMED = "SELECT p_partkey FROM part WHERE p_size <= 5"


@query("delete_cascade", with_views("products listings captures", f"""
    SELECT 'products' AS part, count(*) AS rows, cast(sum(id) AS BIGINT) AS id_sum
    FROM products WHERE id NOT IN ({DOOMED})
    UNION ALL SELECT 'listings', count(*), cast(sum(product_id) AS BIGINT) FROM listings
    WHERE product_id NOT IN ({DOOMED})
    UNION ALL SELECT 'history', count(*), cast(sum(seq) AS BIGINT) FROM captures
    WHERE product_id NOT IN ({DOOMED})"""))
def delete_cascade(spark, sf):
    doomed = load(spark, sf, "part").filter("p_size <= 5").select(F.col("p_partkey").alias("product_id"))
    left = m.delete_cascade(
        view(spark, sf, "products"), view(spark, sf, "listings"), view(spark, sf, "captures"), doomed
    )

    def tally(name, frame, col):
        return frame.agg(F.lit(name).alias("part"), F.count("*").alias("rows"),
                         F.sum(col).alias("id_sum"))

    products, listings, captures = left
    return (
        tally("products", products, "id").unionByName(tally("listings", listings, "product_id"))
        .unionByName(tally("history", captures, "seq"))
    )


@query("unlink_listing", with_views("listings captures", """
    SELECT c.listing_id, c.seq FROM captures c
    WHERE NOT (c.listing_id % 5 = 0 AND c.product_id % 2 = 0)"""))
def unlink_listing(spark, sf):
    # Requests name every fifth listing; those of odd products name a wrong product.
    wrong = F.when(F.col("product_id") % 2 == 0, F.col("product_id")).otherwise(F.lit(-1))
    requests = view(spark, sf, "listings").filter("id % 5 = 0").select(
        F.col("id").alias("listing_id"), wrong.alias("product_id")
    )
    _, history_left = m.unlink_listing(view(spark, sf, "listings"), view(spark, sf, "captures"), requests)
    return history_left.select("listing_id", "seq")


@query("semi_join_delete", with_views("listings captures", """
    SELECT listing_id, seq FROM captures
    WHERE listing_id IN (SELECT id FROM listings WHERE retailer = 'ab')"""))
def semi_join_delete(spark, sf):
    chain = view(spark, sf, "listings").filter("retailer = 'ab'").select(F.col("id").alias("listing_id"))
    return view(spark, sf, "captures").join(chain, "listing_id", "left_semi").select("listing_id", "seq")


@query("cache_write", """
    SELECT user_id, arg_max(event_id, ts) AS event_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS cached_at
    FROM events WHERE event_type <> 'error' GROUP BY user_id""")
def cache_write(spark, sf):
    events = load(spark, sf, "events").select("user_id", "event_id", F.col("ts").alias("cached_at"),
                                              (F.col("event_type") == "error").alias("failed"))
    cut = F.lit("2024-01-15").cast("timestamp_ntz")
    cache = events.filter((F.col("cached_at") < cut) & ~F.col("failed")).drop("failed")
    cache = m.last_wins(cache, ["user_id"], ["cached_at"])
    late = events.filter(F.col("cached_at") >= cut)
    written = m.cache_write(cache, late, ["user_id"])
    return written.select("user_id", "event_id", F.date_format("cached_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("cached_at"))
