"""Payload extraction: storefront payloads are written from the given tables, in
each chain's own shape, and read back; pages and addresses also run as given."""

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aislegraph.functions import text
from aislegraph.operators import linking
from aislegraph.sources import pages, payloads, urls
from aislegraph.workbench.registry import query
from aislegraph.workbench.tables import load, view, with_views


def offers(spark, sf):
    """Offers with a double price and some awkward cases by style."""
    return view(spark, sf, "offers").withColumns({
        "n": F.col("sku").cast("bigint"), "unit": F.floor(F.col("price_piece") * 200 + 0.5) / 100,
    })


def comma(col):
    return F.translate(F.format_string("%.2f", col), ".", ",")


#: Offers on a captured page, on average.
PAGE_ROWS = 40


def paged(rows):
    """Offers dealt by their sku over as many pages as the whole table needs, so that no product, however
    many offers it has, fills a page."""
    pages_needed = rows.agg(F.ceil(F.greatest(F.count("*"), F.lit(1)) / PAGE_ROWS).alias("pages_needed"))
    return rows.crossJoin(F.broadcast(pages_needed)).withColumn("page", F.pmod(F.xxhash64("sku"), F.col("pages_needed")))


def bundle(rows, item, wrap):
    """One payload per page of offers."""
    packed = paged(rows).select("page", item.alias("item"))
    return packed.groupBy("page").agg(F.collect_list("item").alias("items")).select(
        F.concat_ws("/", F.lit("capture"), "page").alias("url"),
        F.to_json(wrap(F.col("items"))).alias("payload"),
    )


def nested(*path):
    def wrap(items):
        out = items
        for name in reversed(path):
            out = F.struct(out.alias(name))
        return out
    return wrap


UNIT = "floor(price_piece * 200 + 0.5) / 100"


def kritikos_payloads(spark, sf):
    item = F.struct(
        F.when(F.col("style") != 5, F.col("sku")).alias("sku"),
        F.concat(F.lit(" "), F.replace("title", F.lit(" "), F.lit("   "))).alias("name"),
        F.when(F.col("style") != 4, F.concat(F.lit("products/x-"), "sku")).alias("slug"),
        (F.col("n") % 5 == 0).alias("isWeighed"),
        F.floor(F.col("price_piece") * 100 + 0.5).alias("finalPrice"),
        F.when(F.col("n") % 3 == 0, F.floor(F.col("unit") * 100 + 0.5)).otherwise(F.lit(0))
        .alias("unitOfMeasurementFinalPrice"),
        F.when(F.col("n") % 2 == 0, "ΚΙΛ").otherwise("ΛΙΤ").alias("unitOfMeasurement"),
        F.array_compact(F.array("product_ean")).alias("barcodes"),
        F.struct(F.concat(F.lit("/"), "sku").alias("primary"), F.lit("https://cdn.example.com").alias("baseUrl"))
        .alias("images"),
        F.struct(text.transliterate(F.col("title")).alias("name"), F.col("sku")).alias("searchTerms"),
    )
    return bundle(offers(spark, sf), item, nested("payload", "products"))


@query("flatten_catalog_kritikos", with_views("offers", f"""
    SELECT sku, 'https://kritikos-sm.gr/products/x-' || sku || '/' AS url, product_ean AS ean,
           trim(title) AS title,
           CASE WHEN cast(sku AS BIGINT) % 5 <> 0 THEN price_piece END AS price_piece,
           CASE WHEN cast(sku AS BIGINT) % 5 = 0 THEN price_piece
                WHEN cast(sku AS BIGINT) % 3 = 0 THEN {UNIT} END AS price_unit,
           CASE WHEN cast(sku AS BIGINT) % 2 = 0 THEN 'κιλό' ELSE 'λίτρο' END AS unit_label,
           'https://cdn.example.com/' || sku AS image_url, len(list_filter([product_ean],
           lambda e: e IS NOT NULL)) AS barcodes
    FROM offers WHERE style NOT IN (4, 5)"""))
def flatten_catalog_kritikos(spark, sf):
    return payloads.flatten_catalog_kritikos(kritikos_payloads(spark, sf)).select(
        "sku", "url", "ean", "title", "price_piece", "price_unit", "unit_label", "image_url",
        F.size("barcodes").cast("bigint").alias("barcodes"),
    )


def ab_item():
    def shot(kind, fmt, prefix):
        return F.struct(F.lit(kind).alias("imageType"), fmt.alias("format"),
                        F.concat(F.lit(prefix), "sku").alias("url"))

    return F.struct(
        F.when(F.col("style") != 5, F.col("sku")).alias("code"), F.col("title").alias("name"),
        F.when(F.col("style") != 1, F.concat(F.lit("/el/eshop/x/p/"), "sku")).alias("url"),
        F.coalesce("brand", F.lit("")).alias("manufacturerName"),
        F.struct(F.col("price_piece").alias("value"),
                 F.concat(comma(F.col("unit")), F.when(F.col("n") % 2 == 0, " €/ κιλ").otherwise(" €/ λιτ"))
                 .alias("supplementaryPriceLabel1")).alias("price"),
        F.array(shot("GALLERY", F.lit("small"), "/g/"), shot("PRIMARY", F.lit("zoom"), "/z/"),
                shot("PRIMARY", F.when(F.col("n") % 2 == 0, "small").otherwise("odd"), "https://i.example.com/s/"))
        .alias("images"),
    )


def ab_payloads(spark, sf):
    return bundle(offers(spark, sf), ab_item(), nested("data", "productSearch", "products"))


@query("flatten_catalog_ab", with_views("offers", f"""
    SELECT sku, title, 'https://www.ab.gr/el/eshop/' || CASE WHEN style <> 1 THEN 'x/' ELSE '' END
           || 'p/' || sku AS url, brand, price_piece, {UNIT} AS price_unit,
           CASE WHEN cast(sku AS BIGINT) % 2 = 0 THEN 'κιλό' ELSE 'λιτ' END AS unit_label
    FROM offers WHERE style <> 5"""))
def flatten_catalog_ab(spark, sf):
    return payloads.flatten_catalog_ab(ab_payloads(spark, sf)).select(
        "sku", "title", "url", "brand", "price_piece", "price_unit", "unit_label"
    )


@query("primary_image", with_views("offers", """
    SELECT sku, CASE WHEN cast(sku AS BIGINT) % 2 = 0 THEN 'https://i.example.com/s/' || sku
                ELSE 'https://www.ab.gr/z/' || sku END AS image_url FROM offers WHERE style <> 5"""))
def primary_image(spark, sf):
    return payloads.flatten_catalog_ab(ab_payloads(spark, sf)).select("sku", "image_url")


# Bodies of the wrong shape at every chain; every third tells an error, lidl's redirects are none.
@query("rejected_payloads", """WITH bodies AS (
    SELECT cast(event_id AS VARCHAR) AS url, user_id, event_type,
           ['ab', 'galaxias', 'kritikos', 'lidl', 'masoutis'][event_id % 5 + 1] AS retailer FROM events)
    SELECT url, retailer, CASE WHEN event_type = 'error' AND retailer IN ('ab', 'galaxias') THEN 'failed ' || user_id
           ELSE 'no_item_list' END AS reason FROM bodies WHERE retailer <> 'lidl' OR event_type <> 'view'""")
def rejected_payloads(spark, sf):
    message = F.array(F.struct(F.concat(F.lit("failed "), F.col("user_id")).alias("message")))
    body = F.when(F.col("event_type") == "error", F.to_json(F.struct(message.alias("errors")))).when(
        F.col("event_type") == "view", F.lit('{"type":"redirect"}'))
    rows = load(spark, sf, "events").select(
        "event_id", F.col("event_id").cast("string").alias("url"), F.coalesce(body, F.col("props")).alias("payload")
    )
    chains = ["ab", "galaxias", "kritikos", "lidl", "masoutis"]
    parts = [payloads.rejected(rows.filter(F.col("event_id") % 5 == i), chain) for i, chain in enumerate(chains)]
    return functools.reduce(DataFrame.unionByName, parts)


@query("announced_pages", """
    SELECT cast(event_id AS VARCHAR) AS url, CASE WHEN event_type = 'click' THEN user_id % 7 + 1 ELSE 1 END AS announced
    FROM events""")
def announced_pages(spark, sf):
    total = F.when(F.col("event_type") == "click", (F.col("user_id") % 7 + 1).cast("string")).when(F.col("event_type") == "view", '"5"').otherwise("-3")
    body = F.concat(F.lit('{"data":{"productSearch":{"pagination":{"totalPages":'), total, F.lit("}}}}"))
    rows = load(spark, sf, "events").select(F.col("event_id").cast("string").alias("url"), body.alias("payload"))
    return payloads.announced_pages(rows).select("url", F.col("announced").cast("bigint"))


def galaxias_item():
    def rule(action, amount, tag):
        return F.struct(F.lit(action).alias("action_name"), F.struct(F.lit(amount).alias("amount")).alias("actions"),
                        F.array(F.lit(tag)).alias("tags"))

    quarter, one = rule("percent", "25", "ΦΥΛΛΑΔΙΟ"), rule("fixed", "1", "ΦΥΛΛΑΔΙΟ")
    hidden, tenth = rule("fixed", "2", "aDiscount:x"), rule("percent", "10", "ΦΥΛΛΑΔΙΟ")
    rules = (
        F.when(F.col("style") == 1, F.array(quarter)).when(F.col("style") == 2, F.array(one))
        .when(F.col("style") == 3, F.array(hidden, rule("fixed", "900", "ΦΥΛΛΑΔΙΟ")))
        .when(F.col("style") == 4, F.array(tenth, one, hidden))
    )
    return F.struct(
        F.when(F.col("style") != 5, F.col("sku")).otherwise(F.concat(F.lit("x-"), "sku")).alias("sku"),
        F.col("title").alias("name"),
        F.when(F.col("n") % 2 == 0, "Κιλό").alias("unit_measurement"),
        F.format_string("%.6f", F.col("price_piece") * 3).alias("cost_per_unit"),
        F.struct(F.concat(F.when(F.col("n") % 3 == 0, "https://i.example.com/placeholder/").otherwise(
            "https://i.example.com/p/"), F.col("sku")).alias("url")).alias("small_image"),
        F.struct(F.struct(F.struct(F.col("price_piece").alias("value")).alias("final_price"))
                 .alias("minimum_price")).alias("price_range"),
        rules.alias("catalog_rules"),
    )


def galaxias_payloads(spark, sf):
    return bundle(offers(spark, sf), galaxias_item(), nested("data", "products", "items"))


PROMO = """CASE style
    WHEN 1 THEN floor(100 * (price_piece - price_piece * (25::DOUBLE / 100)) + 1e-8) / 100
    WHEN 2 THEN price_piece - 1 WHEN 3 THEN price_piece - 900
    WHEN 4 THEN floor(100 * (price_piece - price_piece * (10::DOUBLE / 100)) + 1e-8) / 100 - 1
    ELSE price_piece END"""
PROMO = f"greatest(0, floor(({PROMO}) * 100 + 0.5) / 100)"


@query("flatten_catalog_galaxias", with_views("offers", """
    SELECT CASE WHEN style <> 5 THEN sku ELSE 'x-' || sku END AS sku, title,
           'https://galaxias.shop/product/' || CASE WHEN style <> 5 THEN sku ELSE 'x-' || sku END AS url,
           CASE WHEN style <> 5 AND length(sku) BETWEEN 8 AND 14 THEN sku END AS ean,
           CASE WHEN cast(sku AS BIGINT) % 2 = 0 THEN 'κιλό' END AS unit_label,
           CASE WHEN cast(sku AS BIGINT) % 3 <> 0 THEN 'https://i.example.com/p/' || sku END AS image_url
    FROM offers"""))
def flatten_catalog_galaxias(spark, sf):
    return payloads.flatten_catalog_galaxias(galaxias_payloads(spark, sf)).select(
        "sku", "title", "url", "ean", "unit_label", "image_url"
    )


@query("promo_price_rules", with_views("offers", f"""
    SELECT CASE WHEN style <> 5 THEN sku ELSE 'x-' || sku END AS sku, {PROMO} AS price_piece FROM offers"""))
def promo_price_rules(spark, sf):
    return payloads.flatten_catalog_galaxias(galaxias_payloads(spark, sf)).select("sku", "price_piece")


@query("rescale_unit_price", with_views("offers", f"""
    SELECT sku, floor((raw * CASE WHEN price_piece > 0 THEN {PROMO} / price_piece ELSE 1 END) * 100 + 0.5)
           / 100 AS price_unit
    FROM (SELECT *, cast(printf('%.6f', price_piece * 3) AS DOUBLE) AS raw FROM offers)
    WHERE style <> 5"""))
def rescale_unit_price(spark, sf):
    rows = payloads.flatten_catalog_galaxias(galaxias_payloads(spark, sf))
    return rows.filter(~F.startswith("sku", F.lit("x-"))).select("sku", "price_unit")


def lidl_payloads(spark, sf):
    data = F.struct(
        F.when(F.col("style") != 5, F.col("sku")).alias("erpNumber"), F.col("title").alias("fullTitle"),
        F.concat(F.lit("/p/x/p"), "sku").alias("canonicalUrl"),
        F.struct(F.coalesce("brand", F.lit("")).alias("name")).alias("brand"),
        F.struct(F.col("price_piece").alias("price"), F.struct(
            F.concat(F.when(F.col("n") % 2 == 0, "1 Kg = Από 99,90€ σε ").otherwise("1 Lt = "),
                     comma(F.col("unit")), F.lit("€")).alias("text")).alias("basePrice")).alias("price"),
    )
    item = F.struct(F.when(F.col("style") != 4, F.struct(data.alias("data"))).alias("gridbox"))
    empty = load(spark, sf, "part").select(
        F.concat(F.lit("empty/"), F.col("p_partkey")).alias("url"), F.lit('{"type":"redirect"}').alias("payload")
    )
    return bundle(offers(spark, sf), item, nested("items")).unionByName(empty)


@query("flatten_search_lidl", with_views("offers", f"""
    SELECT sku, title, 'https://www.lidl-hellas.gr/p/x/p' || sku AS url, brand, price_piece,
           {UNIT} AS price_unit, CASE WHEN cast(sku AS BIGINT) % 2 = 0 THEN 'κιλό' ELSE 'λίτρο' END
           AS unit_label FROM offers WHERE style NOT IN (4, 5)"""))
def flatten_search_lidl(spark, sf):
    return payloads.flatten_search_lidl(lidl_payloads(spark, sf)).select(
        "sku", "title", "url", "brand", "price_piece", "price_unit", "unit_label"
    )


def masoutis_item():
    return F.struct(
        F.when(F.col("style") != 5, F.col("sku")).otherwise("").alias("Itemcode"),
        F.concat("title", F.lit(" ")).alias("ItemDescr"), F.col("price_piece").alias("PosPrice"),
        F.concat(F.format_string("%.3f", F.col("unit")), F.lit("€/"),
                 F.when(F.col("n") % 2 == 0, "κιλ").otherwise("λιτ")).alias("ItemVolume"),
        F.coalesce("brand", F.lit("")).alias("BrandNameDesciption"),
        F.when(F.col("style") == 0, F.concat(F.lit("https://www.masoutis.gr/categories/item/x?"), "sku"))
        .when(F.col("style") == 1, F.lit("slug")).when(F.col("style") == 2, F.concat(F.lit("slug?"), "sku"))
        .alias("ItemDescrLink"),
    )


MASOUTIS = f"""trim(title) AS title, price_piece, {UNIT} AS price_unit,
    CASE WHEN cast(sku AS BIGINT) % 2 = 0 THEN 'κιλό' ELSE 'λίτρο' END AS unit_label"""


@query("flatten_search_masoutis", with_views("offers", f"""
    SELECT sku, brand, {MASOUTIS}, 'https://www.masoutis.gr/categories/item/' || CASE style
           WHEN 0 THEN 'x?' || sku WHEN 1 THEN 'slug?' || sku || '=' WHEN 2 THEN 'slug?' || sku || '='
           ELSE '?' || sku || '=' END AS url FROM offers WHERE style <> 5"""))
def flatten_search_masoutis(spark, sf):
    rows = bundle(offers(spark, sf), masoutis_item(), lambda items: items)
    return payloads.flatten_search_masoutis(rows).select(
        "sku", "brand", "title", "price_piece", "price_unit", "unit_label", "url"
    )


@query("item_detail_masoutis", with_views("offers", f"""
    SELECT CASE WHEN style <> 3 THEN CASE WHEN style = 5 THEN '' ELSE sku END
                ELSE lpad(cast(cast(sku AS BIGINT) % 10000000 AS VARCHAR), 7, '0') END AS sku, {MASOUTIS}
    FROM offers"""))
def item_detail_masoutis(spark, sf):
    code = F.lpad((F.col("n") % 10000000).cast("string"), 7, "0")
    rows = offers(spark, sf).withColumn("item", masoutis_item())
    body = F.when(F.col("style") == 3, F.col("item").dropFields("Itemcode").alias("item"))
    rows = rows.select(
        F.concat(F.lit("https://www.masoutis.gr/categories/item/x?"), code, F.lit("=")).alias("url"),
        F.when(body.isNotNull(), F.to_json(body)).otherwise(F.to_json("item")).alias("payload"),
    )
    return payloads.item_detail_masoutis(rows).select("sku", "title", "price_piece", "price_unit", "unit_label")


def html_pages(rows, fragment):
    """One page of fragments in sku order per page of offers."""
    packed = paged(rows).select("page", F.struct("n", fragment.alias("h")).alias("f"))
    made = packed.groupBy("page").agg(F.array_sort(F.collect_list("f")).alias("fs"))
    return made.select(F.col("page").cast("string").alias("url"), F.array_join(F.col("fs.h"), "\n").alias("html"))


def escaped(col):
    return F.replace(col, F.lit("&"), F.lit("&amp;"))


@query("extract_tiles_sklavenitis", with_views("offers", """
    SELECT CASE WHEN style IN (0, 1) THEN '100000' || sku ELSE sku END AS sku, trim(title) AS title
    FROM offers WHERE style <> 4"""))
def extract_tiles_sklavenitis(spark, sf):
    # Styles 0 and 1 carry the code in the slug, 2, 3 and 5 in the wishlist icon
    # before the title, 4 nowhere; every tile appears twice.
    slug = F.when(F.col("style") <= 1, F.concat(F.lit("/c/x-100000"), "sku", F.lit("/"))).otherwise("/c/x/")
    icon = F.when(F.col("style").isin(2, 3, 5), F.concat(F.lit('<i data-productsku="'), "sku", F.lit('"></i>')))
    tile = F.concat(
        F.coalesce(icon, F.lit("")), F.lit('<h4 class="product__title">\n<a href="'), slug, F.lit('" class="a"> <b>'),
        escaped(F.col("title")), F.lit("</b> </a></h4>"),
    )
    rows = html_pages(offers(spark, sf), F.concat(tile, F.lit("\n"), tile))
    return pages.extract_tiles_sklavenitis(rows).select("sku", "title")


@query("extract_tiles_mymarket", with_views("offers", """
    SELECT sku, title, 'https://www.mymarket.gr/x-' || sku AS url, brand, price_piece FROM offers
    WHERE style NOT IN (3, 5)"""))
def extract_tiles_mymarket(spark, sf):
    body = F.to_json(F.struct(
        F.when(F.col("style") != 5, F.col("sku")).alias("id"), F.col("title").alias("name"),
        F.format_string("%.2f", "price_piece").alias("price"), F.coalesce("brand", F.lit("")).alias("brand"),
    ))
    body = F.when(F.col("style") == 3, F.lit("{broken")).otherwise(body)
    encoded = F.replace(F.replace(body, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;"))
    tile = F.concat(
        F.lit('<a href="https://www.mymarket.gr/x-'), "sku", F.lit('" rel="bookmark" data-action="click->x"\n'),
        F.lit(' data-google-analytics-item-param="'), encoded, F.lit('">t</a>'),
    )
    return pages.extract_tiles_mymarket(html_pages(offers(spark, sf), F.concat(tile, tile))).select(
        "sku", "title", "url", "brand", "price_piece"
    )


def one_page_each(spark, sf, html):
    return offers(spark, sf).select("sku", F.col("sku").alias("url"), html.alias("html"))


@query("extract_page_sklavenitis", with_views("offers", f"""
    SELECT sku AS url, CASE WHEN style <> 5 THEN sku END AS sku, trim(title) AS title,
           CASE WHEN style <> 3 THEN price_piece END AS price_piece, {UNIT} AS price_unit,
           'κιλό' AS unit_label FROM offers"""))
def extract_page_sklavenitis(spark, sf):
    code = F.when(F.col("style") != 5, F.concat(F.lit("<p>Κωδικός: <strong>"), "sku", F.lit("</strong></p>")))
    piece = F.when(F.col("style") != 3, F.concat(
        comma(F.col("price_piece") + 1), F.lit(" €/τεμ.</b><i>"), comma(F.col("price_piece")),
        F.lit(" €<span>/τεμ.</span></i>")))
    html = F.concat(
        F.lit("<h1 class='t'><b>"), escaped(F.col("title")), F.lit("</b> </h1><b>"), comma(F.col("unit")),
        F.lit(" €<span>/κιλό;</span>"), F.coalesce(piece, F.lit("")), F.coalesce(code, F.lit("")),
    )
    return pages.extract_page_sklavenitis(one_page_each(spark, sf, html)).select(
        "url", "sku", "title", "price_piece", "price_unit", "unit_label"
    )


def ld(body):
    return F.concat(F.lit('<script type="application/ld+json">'), body, F.lit("</script>"))


def image_json():
    address = F.concat(F.lit('"https://i.example.com/'), "sku", F.lit('"'))
    return (
        F.when(F.col("style") % 3 == 0, address)
        .when(F.col("style") % 3 == 1, F.concat(F.lit("["), address, F.lit("]")))
        .otherwise(F.concat(F.lit('{"url":'), address, F.lit("}")))
    )


def lidl_pages(spark, sf):
    code = F.concat(F.lit('"'), "product_ean", F.lit('"'))
    code = F.when(F.col("product_ean").isNull(), F.lit("null")).when(
        F.col("n") % 2 == 0, F.concat(F.lit("["), code, F.lit("]"))).otherwise(code)
    product = F.concat(
        F.lit('{"@type":"Product","sku":"'), "sku", F.lit('","name":"'), "title", F.lit('","gtin13":'), code,
        F.lit(',"image":'), image_json(), F.lit(',"offers":[{"price":'), F.format_string("%.2f", "price_piece"),
        F.lit("}]}"),
    )
    html = F.concat(
        ld(F.lit('{"@type":"Organization"}')), ld(F.lit("{broken")), ld(product), F.lit("<b>1 kg = Από 99,00€ σε "),
        comma(F.col("unit")), F.lit("€<br>"),
    )
    return pages.extract_page_lidl(one_page_each(spark, sf, html))


@query("extract_page_lidl", with_views("offers", f"""
    SELECT sku, title, product_ean AS ean, price_piece, {UNIT} AS price_unit, 'κιλό' AS unit_label
    FROM offers"""))
def extract_page_lidl(spark, sf):
    return lidl_pages(spark, sf).select("sku", "title", "ean", "price_piece", "price_unit", "unit_label")


@query("extract_ldjson_image", with_views("offers", """
    SELECT sku, 'https://i.example.com/' || sku AS image_url FROM offers"""))
def extract_ldjson_image(spark, sf):
    return lidl_pages(spark, sf).select("sku", "image_url")


@query("extract_page_mymarket", with_views("offers", f"""
    SELECT sku AS url, CASE WHEN style <> 4 THEN sku END AS sku,
           CASE WHEN style <> 4 THEN title || CASE WHEN style = 2 THEN ' ΤΙΜΉ κιλού' ELSE '' END END AS title,
           CASE WHEN style NOT IN (2, 4) THEN price_piece END AS price_piece,
           CASE WHEN style <> 4 THEN {UNIT} END AS price_unit,
           CASE WHEN style <> 4 THEN 'κιλό' END AS unit_label FROM offers"""))
def extract_page_mymarket(spark, sf):
    weighed = F.when(F.col("style") == 2, " ΤΙΜΉ κιλού").otherwise("")
    kind = F.when(F.col("style") == 4, "Thing").otherwise("Product")
    price = F.when(F.col("style") == 0, F.format_string("%.2f", "price_piece")).otherwise(
        F.concat(F.lit('"'), F.format_string("%.2f", "price_piece"), F.lit('"')))
    body = F.concat(
        F.lit('{"@graph":[{"@type":"'), kind, F.lit('","sku":"'), "sku", F.lit('","name":"'), "title", weighed,
        F.lit('","offers":{"price":'), price, F.lit("}}]}"),
    )
    html = F.concat(
        ld(F.lit('{"@type":"Product"}')), ld(body), F.lit('<div class="measure-label-wrapper">\n'),
        F.lit('<span class="font-semibold">'), comma(F.col("unit")), F.lit("€</span> <span>Τιμή κιλού</span></div>"),
    )
    return pages.extract_page_mymarket(one_page_each(spark, sf, html)).select(
        "url", "sku", "title", "price_piece", "price_unit", "unit_label"
    )


@query("extract_page_kritikos", with_views("offers", """
    SELECT sku, title, CASE WHEN cast(sku AS BIGINT) % 5 <> 0 THEN price_piece END AS price_piece,
           CASE WHEN cast(sku AS BIGINT) % 5 = 0 THEN price_piece END AS price_unit
    FROM offers WHERE style <> 3"""))
def extract_page_kritikos(spark, sf):
    product = F.struct(
        F.col("sku"), F.replace("title", F.lit(" "), F.lit("  ")).alias("name"),
        (F.col("n") % 5 == 0).alias("isWeighed"), F.floor(F.col("price_piece") * 100 + 0.5).alias("finalPrice"),
        F.lit(0).alias("unitOfMeasurementFinalPrice"), F.lit("ΚΙΛ").alias("unitOfMeasurement"),
    )
    body = F.to_json(nested("props", "pageProps", "productSelected")(product))
    html = F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json">'),
                    F.when(F.col("style") == 3, F.lit('{"props":{}}')).otherwise(body), F.lit("</script>"))
    return pages.extract_page_kritikos(one_page_each(spark, sf, html)).select(
        "sku", "title", "price_piece", "price_unit"
    )


@query("page_headings", r"""
    SELECT page_id, trim(replace(replace(replace(replace(replace(replace(regexp_replace(
           regexp_extract(html, '<h1[^>]*>((?s:.*?))</h1>', 1), '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'),
           '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')) AS title FROM pages""")
def page_headings(spark, sf):
    given = load(spark, sf, "pages").select(F.col("page_id").cast("string").alias("url"), "html")
    return pages.extract_page_sklavenitis(given).select(F.col("url").cast("bigint").alias("page_id"), "title")


@query("leaf_category_urls", r"""WITH links AS (
    SELECT DISTINCT page_id, url FROM pages)
    SELECT regexp_replace(url, '#.*$', '') AS url FROM links
    WHERE page_id % 3 <> 0 AND len(list_filter(string_split(regexp_extract(
          url, '^https?://[^/]+([^?#]*)', 1), '/'), lambda s: s <> '')) >= 2""")
def leaf_category_urls(spark, sf):
    # Every page address is a category of its own child sitemap; the index names
    # two thirds of the sitemaps.
    given = load(spark, sf, "pages")
    named = F.concat(F.lit("https://s.example.com/"), F.col("page_id"), F.lit(".xml"))
    child = given.select(named.alias("url"), F.concat(
        F.lit("<urlset><loc>"), F.replace(urls.strip_fragment(F.col("url")), F.lit("&"), F.lit("%26")),
        F.lit("</loc></urlset>")).alias("xml"))
    index = given.filter("page_id % 3 <> 0").select(
        F.concat(F.lit("<index><loc>"), named, F.lit("</loc></index>")).alias("xml"))
    return urls.leaf_category_urls(index, child, depth=2).select(
        F.replace("url", F.lit("%26"), F.lit("&")).alias("url"))


@query("leaf_category_urls_of_links", with_views("listings", """
    SELECT url FROM listings WHERE retailer IN ('ab', 'masoutis', 'lidl')"""))
def leaf_category_urls_of_links(spark, sf):
    links = view(spark, sf, "listings")
    sitemap = F.concat(F.lit("https://s.example.com/"), "retailer", F.lit(".xml"))
    children = links.select(sitemap.alias("url"), F.concat(F.lit("<loc>"), "url", F.lit("</loc>")).alias("xml"))
    index = links.select(F.concat(F.lit("<loc>"), sitemap, F.lit("</loc>")).alias("xml")).distinct()
    return urls.leaf_category_urls(index, children)


@query("normalize_barcode_payload", with_views("products", """
    SELECT cast(id AS VARCHAR) AS ean, CASE WHEN id % 4 <> 0 THEN CASE WHEN id % 3 = 0 THEN title ELSE brand END
           END AS name, CASE WHEN id % 4 <> 0 THEN brand END AS brand,
           CASE WHEN id % 4 <> 0 THEN image_url END AS image_url FROM products"""))
def normalize_barcode_payload(spark, sf):
    product = F.struct(
        F.when(F.col("id") % 3 == 0, F.col("title")).otherwise("  ").alias("product_name_el"),
        F.concat(F.lit(" "), "brand").alias("product_name"),
        F.concat("brand", F.lit(" , Other")).alias("brands"), F.lit("").alias("quantity"),
        F.lit(" ").alias("image_front_small_url"), F.col("image_url"),
    )
    rows = view(spark, sf, "products").select(
        F.col("id").cast("string").alias("ean"),
        F.to_json(F.struct(F.when(F.col("id") % 4 == 0, 0).otherwise(1).alias("status"), product.alias("product")))
        .alias("payload"),
    )
    return payloads.normalize_barcode_payload(rows).select("ean", "name", "brand", "image_url")


@query("route_url", with_views("listings", r"""
    SELECT url, retailer FROM listings UNION ALL
    SELECT regexp_replace(url, '#.*$', ''), NULL FROM pages"""))
def route_url(spark, sf):
    given = view(spark, sf, "listings").select(F.concat("url", F.lit("#frag")).alias("url")).unionByName(
        load(spark, sf, "pages").select("url"))
    return given.select(urls.strip_fragment(F.col("url")).alias("url"),
                        urls.route_url(F.col("url")).alias("retailer"))


@query("sku_from_url", with_views("listings", r"""
    SELECT url, CASE retailer WHEN 'ab' THEN retailer_sku WHEN 'kritikos' THEN retailer_sku
           WHEN 'galaxias' THEN retailer_sku
           WHEN 'masoutis' THEN CASE WHEN length(retailer_sku) >= 6 THEN substr(retailer_sku, 1, 8) END
           WHEN 'sklavenitis' THEN CASE WHEN length(retailer_sku) >= 6 THEN retailer_sku END END AS sku
    FROM listings"""))
def sku_from_url(spark, sf):
    return view(spark, sf, "listings").select(
        "url", urls.sku_from_url(F.col("retailer"), F.col("url")).alias("sku"))


def url_requests(spark, sf):
    links = view(spark, sf, "captures").join(
        view(spark, sf, "listings").select(F.col("id").alias("listing_id"), "url"), "listing_id")
    return links.select("seq", (F.col("product_id") + F.col("seq") % 2).alias("product_id"), "url",
                        "listing_id")


def known_catalog(spark, sf):
    return view(spark, sf, "listings").filter("id % 4 <> 0").select(
        "retailer", F.col("retailer_sku").alias("sku"), F.col("url").alias("name"),
        (F.col("id") % 100 / 10).alias("price_piece"), F.lit(None).cast("double").alias("price_unit"),
        F.lit(None).cast("string").alias("unit_label"))


RESOLVED = """, requests AS (
    SELECT c.seq, c.product_id + c.seq % 2 AS product_id, l.url, l.retailer, l.retailer_sku, l.id
    FROM captures c JOIN listings l ON l.id = c.listing_id
), resolved AS (
    SELECT *, CASE WHEN retailer NOT IN ('ab', 'kritikos') THEN 'page has to be captured'
                   WHEN id % 4 = 0 THEN 'product not in the catalog index' END AS reason FROM requests
)"""


@query("catalog_sku_resolve", with_views("listings captures", f"""{RESOLVED}
    SELECT seq, retailer, CASE WHEN retailer IN ('ab', 'kritikos') THEN retailer_sku END AS sku,
           CASE WHEN reason IS NULL THEN id % 100 / 10 END AS price_piece, reason FROM resolved"""))
def catalog_sku_resolve(spark, sf):
    return urls.catalog_sku_resolve(url_requests(spark, sf), known_catalog(spark, sf)).select(
        "seq", "retailer", "sku", "price_piece", "reason")


@query("link_by_url", with_views("listings captures", f"""{RESOLVED}, ok AS (
    SELECT * FROM resolved WHERE reason IS NULL), judged AS (
    SELECT seq, product_id, retailer, retailer_sku,
           EXISTS (SELECT 1 FROM listings l WHERE l.id % 7 <> 0 AND l.product_id = ok.product_id
                   AND l.retailer = ok.retailer) AS taken,
           min(seq) OVER (PARTITION BY product_id, retailer) = seq AS first FROM ok)
    SELECT seq, product_id, retailer, retailer_sku, NOT taken AND first AS linked FROM judged"""))
def link_by_url(spark, sf):
    resolved = urls.catalog_sku_resolve(url_requests(spark, sf), known_catalog(spark, sf)).filter(
        "reason IS NULL").withColumnRenamed("sku", "retailer_sku")
    added, refused = linking.link_by_url(resolved.drop("reason"), view(spark, sf, "listings").filter("id % 7 <> 0"))
    columns = ["seq", "product_id", "retailer", "retailer_sku"]
    return added.select(*columns, F.lit(True).alias("linked")).unionByName(
        refused.select(*columns, F.lit(False).alias("linked")))
