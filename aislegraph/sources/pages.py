"""Captured HTML pages to offer rows: listing tiles and product pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aislegraph.functions import numbers, text
from aislegraph.model import BASE_URL, EAN_REGEX
from aislegraph.operators.maintenance import first_wins
from aislegraph.session import worked_out
from aislegraph.sources import variants as v
from aislegraph.sources.payloads import _offers, kritikos_image, kritikos_prices



def up_to(end: str) -> str:
    """Everything before the next ``end``, a closing tag: in runs without ``<``, never taken back."""
    return rf"(?:[^<]++|<(?!{end[1:]}))*+"


# The markup each storefront serves.
TILE_REGEX = (
    r'data-productsku="(\d+)"|'
    rf'<h4 class="product__title">\s*<a href="([^"]+)"[^>]*>({up_to("</a>")})</a>'
)
SLUG_SKU_REGEX = r"-(\d{6,})/?$"
PRICE_REGEX = r'(\d[\d.]*,\d{2})\s*€\s*(?:<[^>]*>\s*)*/\s*([^\s<&"]+)'
H1_REGEX = rf"<h1[^>]*>({up_to('</h1>')})</h1>"
CODE_REGEX = r"Κωδικός:\s*(?:<[^>]+>\s*)*(\d+)"
ANALYTICS_TILE_REGEX = (
    r'<a href="(https://www\.mymarket\.gr/[^"]+)"\s+rel="bookmark"'
    r'(?:[^>"]*+"[^"]*+")*?[^>"]*?data-google-analytics-item-param="([^"]+)"'
)
LD_JSON_REGEX = rf'<script type="application/ld\+json">({up_to("</script>")})</script>'
NEXT_DATA_REGEX = rf'<script id="__NEXT_DATA__" type="application/json">({up_to("</script>")})</script>'
MEASURE_REGEX = (
    r'measure-label-wrapper">\s*<span class="font-semibold">([\d.,]+)\s*€</span>\s*'
    r"<span>Τιμή\s+(\S+)</span>"
)
WEIGHED_REGEX = r"(?iu)Τιμή\s+(Κιλού|Λίτρου)"


def _found(hit: Column) -> Column:
    return F.when(hit != "", hit)


def extract_tiles_sklavenitis(pages: DataFrame) -> DataFrame:
    """Product tiles in page order, first of equal skus per page.

    A wishlist code belongs to the title right after it, so it is the element
    before the title in the list of matches.
    """
    # A page is searched once; what a tile holds is taken out of the tile.
    found = worked_out(pages, "url", hits=F.regexp_extract_all("html", F.lit(TILE_REGEX), 0))
    # Shift the list by one instead of looking back by index: linear in the page.
    before = F.concat(F.array(F.lit("")), F.slice("hits", 1, F.greatest(F.size("hits") - 1, F.lit(0))))
    paired = F.arrays_zip(F.col("hits").alias("tile"), before.alias("before"))
    tiles = found.select(F.col("url").alias("page_url"), F.posexplode(paired).alias("pos", "t")).filter(
        F.startswith("t.tile", F.lit("<h4")))
    # A tile's address is the fourth of its parts between quotes.
    parts = worked_out(
        tiles, "page_url", "pos", tile=F.col("t.tile"), href=F.split_part("t.tile", F.lit('"'), F.lit(4)),
        marked=F.regexp_extract("t.before", r'^data-productsku="(\d+)"', 1),
    )
    coded = worked_out(
        parts, "page_url", "pos", "href", "tile",
        sku=F.coalesce(_found(F.regexp_extract("href", SLUG_SKU_REGEX, 1)), _found(F.col("marked"))),
    ).filter(F.col("sku").isNotNull())
    # A tile shown again is dropped before its title is taken out and cleaned.
    firsts = first_wins(coded, ["page_url", "sku"], ["pos"])
    title = text.full_trim(text.decode_entities(text.strip_tags(F.regexp_extract("tile", TILE_REGEX, 3))))
    return _offers(
        firsts, "sklavenitis", ["page_url", "pos"], sku=F.col("sku"), title=title,
        url=F.concat(F.lit(BASE_URL["sklavenitis"]), "href"),
    )


def extract_tiles_mymarket(pages: DataFrame) -> DataFrame:
    """Tiles carrying entity-encoded JSON in an attribute; broken ones are skipped."""
    hits = F.regexp_extract_all("html", F.lit(ANALYTICS_TILE_REGEX), 0)
    tiles = pages.select(F.col("url").alias("page_url"), F.posexplode(hits).alias("pos", "tile"))
    # Between quotes: the address is the second part of a tile, the attribute the last one.
    cut = worked_out(
        tiles, "page_url", "pos", href=F.split_part("tile", F.lit('"'), F.lit(2)),
        param=F.split_part("tile", F.lit('"'), F.lit(-2)),
    )
    parsed = worked_out(cut, "page_url", "pos", "href", item=v.parse(text.decode_entities(F.col("param"), text.TILE_ENTITIES)))
    item = F.col("item")
    read = worked_out(
        parsed, "page_url", "pos", "href", sku=v.text_at(item, "$.id"), title=v.text_at(item, "$.name"),
        brand=v.filled_at(item, "$.brand"), price=v.text_at(item, "$.price"),
    )
    usable = read.filter(F.col("sku").isNotNull() & F.col("title").isNotNull())
    firsts = first_wins(usable, ["page_url", "sku"], ["pos"])
    return _offers(
        firsts, "mymarket", ["page_url", "pos"], sku=F.col("sku"), title=F.col("title"), url=F.col("href"),
        brand=F.col("brand"), price_piece=numbers.greek_number(F.col("price")),
    )


def extract_page_sklavenitis(pages: DataFrame) -> DataFrame:
    """Name, code and the lowest piece and unit price of a product page."""
    amounts = F.regexp_extract_all("html", F.lit(PRICE_REGEX), 1)
    labels = F.regexp_extract_all("html", F.lit(PRICE_REGEX), 2)
    prices = F.transform(
        F.arrays_zip(amounts.alias("amount"), labels.alias("label")),
        lambda p: F.struct(
            numbers.greek_number(p["amount"]).alias("value"),
            F.regexp_replace(text.decode_entities(p["label"]), "[.,;]+$", "").alias("label"),
        ),
    )
    rows = pages.withColumn("prices", F.filter(prices, lambda p: p["value"].isNotNull()))
    piece = F.filter("prices", lambda p: F.startswith(p["label"], F.lit("τεμ")))
    unit = F.filter("prices", lambda p: ~F.startswith(p["label"], F.lit("τεμ")))
    heading = F.regexp_extract("html", H1_REGEX, 1)
    title = text.full_trim(text.decode_entities(text.strip_tags(heading)))
    return _offers(
        rows, "sklavenitis", url=F.col("url"), sku=_found(F.regexp_extract("html", CODE_REGEX, 1)),
        title=F.when(F.col("html").rlike(H1_REGEX), title),
        price_piece=F.array_min(piece["value"]), price_unit=F.array_min(unit["value"]),
        unit_label=F.try_element_at(unit, F.lit(1))["label"],
    )


def ldjson_blocks(html: Column) -> Column:
    """JSON-LD blocks of a page as variants; broken ones become null."""
    return F.transform(F.regexp_extract_all(html, F.lit(LD_JSON_REGEX), 1), v.parse)


def extract_ldjson_image(item: Column) -> Column:
    """An image given as a string, a list of them or an object with a url."""
    listed = kind_is_list(item, "$.image")
    first = F.coalesce(v.filled_at(item, "$.image[0]"), v.filled_at(item, "$.image[0].url"))
    single = F.coalesce(v.filled_at(item, "$.image"), v.filled_at(item, "$.image.url"))
    return F.when(listed, first).otherwise(single)


def kind_is_list(item: Column, path: str) -> Column:
    return F.coalesce(F.startswith(v.kind(item, path), F.lit("ARRAY")), F.lit(False))


def extract_page_lidl(pages: DataFrame) -> DataFrame:
    """First JSON-LD product block plus the base price printed on the page."""
    found = F.filter(ldjson_blocks(F.col("html")), lambda b: v.text_at(b, "$['@type']") == "Product")
    rows = pages.withColumn("item", F.try_element_at(found, F.lit(1)))
    item = F.col("item")
    price, label = numbers.base_price_text(F.col("html"))
    code = F.when(kind_is_list(item, "$.gtin13"), v.text_at(item, "$.gtin13[0]")).otherwise(
        v.text_at(item, "$.gtin13"))
    return _offers(
        rows, "lidl", url=F.col("url"), sku=v.text_at(item, "$.sku"), title=v.text_at(item, "$.name"),
        ean=F.when(code.rlike(EAN_REGEX), code), price_piece=v.number_at(item, "$.offers[0].price"),
        price_unit=F.when(item.isNotNull(), price), unit_label=F.when(item.isNotNull(), label),
        image_url=extract_ldjson_image(item),
    )


def extract_page_mymarket(pages: DataFrame) -> DataFrame:
    """First JSON-LD block whose graph starts with a product; goods sold by weight
    keep only their unit price."""
    found = F.filter(ldjson_blocks(F.col("html")), lambda b: v.text_at(b, "$['@graph'][0]['@type']") == "Product")
    rows = pages.withColumn(
        "item", F.try_variant_get(F.try_element_at(found, F.lit(1)), "$['@graph'][0]", "variant")
    )
    item = F.col("item")
    name = v.text_at(item, "$.name")
    price = F.coalesce(
        v.number_at(item, "$.offers.price"), numbers.greek_number(v.text_at(item, "$.offers.price"))
    )
    amount = _found(F.regexp_extract("html", MEASURE_REGEX, 1))
    label = numbers.unit_label_mymarket(_found(F.regexp_extract("html", MEASURE_REGEX, 2)))
    known = item.isNotNull()
    return _offers(
        rows, "mymarket", url=F.col("url"), sku=v.text_at(item, "$.sku"), title=name,
        price_piece=F.when(~F.coalesce(name.rlike(WEIGHED_REGEX), F.lit(False)), price),
        price_unit=F.when(known, numbers.greek_number(amount)), unit_label=F.when(known, label),
        image_url=extract_ldjson_image(item),
    )


def extract_page_kritikos(pages: DataFrame) -> DataFrame:
    """Product state embedded in the page; pages without it are left out."""
    body = v.parse(F.regexp_extract("html", NEXT_DATA_REGEX, 1))
    rows = worked_out(pages, "url", item=F.try_variant_get(body, "$.props.pageProps.productSelected", "variant"))
    item = F.col("item")
    return _offers(
        rows.filter(item.isNotNull()), "kritikos", url=F.col("url"), sku=v.text_at(item, "$.sku"),
        title=text.clean_name(v.text_at(item, "$.name")), image_url=kritikos_image(item),
        **kritikos_prices(item),
    )
