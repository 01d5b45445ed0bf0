"""Addresses: routing to a retailer, the sku inside a link, category sitemaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aislegraph.model import CATALOG_PRICED, RETAILERS

# Where each storefront's addresses carry the sku.
SKU_PATTERNS = {
    "ab": r"/p/(\d+)",
    "kritikos": r"-(\d+)/?(?:[?#]|$)",
    "masoutis": r"[?&](\d{6,8})(?=[=&]|$)",
    "galaxias": r"/product/([A-Za-z0-9_-]+)",
    "sklavenitis": r"-(\d{6,})/?$",
}


def host_of(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def route_url(url: Column) -> Column:
    """Retailer of an address by host or host suffix, null when none fits."""
    host, out = host_of(url), None
    for name, _, suffix, _ in RETAILERS:
        fits = (host == suffix) | F.endswith(host, F.lit("." + suffix))
        out = F.when(fits, name) if out is None else out.when(fits, name)
    return out


def strip_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def sku_from_url(retailer: Column, url: Column) -> Column:
    out = None
    for name, pattern in SKU_PATTERNS.items():
        sku = F.nullif(F.regexp_extract(url, pattern, 1), F.lit(""))
        out = F.when(retailer == name, sku) if out is None else out.when(retailer == name, sku)
    return out


def catalog_sku_resolve(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """Pasted addresses resolved from the catalog, each with a reason when not.

    ``requests(seq, url, ...)``; only chains whose catalog carries prices resolve.
    """
    clean = strip_fragment(F.col("url"))
    routed = requests.withColumn("url", clean).withColumn("retailer", route_url(F.col("url")))
    routed = routed.withColumn("sku", F.when(
        F.col("retailer").isin(CATALOG_PRICED), sku_from_url(F.col("retailer"), F.col("url"))
    ))
    rows = catalog.select(
        "retailer", "sku", "name", "price_piece", "price_unit", "unit_label", F.lit(True).alias("_hit")
    )
    joined = routed.join(rows, ["retailer", "sku"], "left")
    reason = (
        F.when(host_of(F.col("url")).isNull(), "not a valid URL")
        .when(F.col("retailer").isNull(), "no adapter for host")
        .when(~F.col("retailer").isin(CATALOG_PRICED), "page has to be captured")
        .when(F.col("_hit").isNull(), "product not in the catalog index")
    )
    return joined.withColumn("reason", reason).drop("_hit")


def locs(xml: Column) -> Column:
    return F.regexp_extract_all(xml, F.lit("<loc>([^<]+)</loc>"), 1)


def is_leaf_category(url: Column, depth: int = 3) -> Column:
    """A category page deep enough to list products; broken addresses are not."""
    segments = F.filter(F.split(F.try_parse_url(url, F.lit("PATH")), "/"), lambda s: s != "")
    return host_of(url).isNotNull() & (F.size(segments) >= depth)


def leaf_category_urls(index: DataFrame, children: DataFrame, depth: int = 3) -> DataFrame:
    """Leaf addresses (``depth`` segments at least) of a two-level sitemap: ``index(xml)``, ``children(url, xml)``."""
    named = index.select(F.explode(locs(F.col("xml"))).alias("url")).distinct()
    listed = children.join(named, "url", "left_semi").select(F.explode(locs(F.col("xml"))).alias("url"))
    return listed.filter(is_leaf_category(F.col("url"), depth))
