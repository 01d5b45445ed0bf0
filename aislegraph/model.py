"""Data model: table schemas, the retailer dimension and the fixed thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_TYPES = {
    "bigint": T.LongType(), "string": T.StringType(), "double": T.DoubleType(),
    "date": T.DateType(), "timestamp": T.TimestampType(), "boolean": T.BooleanType(),
    "array<string>": T.ArrayType(T.StringType()),
}


def _schema(fields: str) -> T.StructType:
    """``name type, ...`` to a StructType (usable before any session exists)."""
    pairs = (field.split() for field in fields.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


PRODUCTS = _schema(
    "id bigint, ean string, brand string, title string, size_value double, "
    "size_unit string, image_url string"
)
LISTINGS = _schema(
    "id bigint, product_id bigint, retailer string, retailer_sku string, url string"
)
PRICE_HISTORY = _schema(
    "listing_id bigint, scraped_date date, scraped_at timestamp, seq bigint, "
    "price_piece double, price_unit double, unit_label string"
)
BARCODE_CACHE = _schema(
    "ean string, name string, brand string, quantity string, image_url string, "
    "source string, found boolean, cached_at timestamp"
)
SEARCH_CACHE = _schema(
    "retailer string, query string, ean string, results array<string>, cached_at timestamp"
)
#: The common row every payload extractor emits.
OFFER = _schema(
    "retailer string, sku string, title string, url string, brand string, ean string, "
    "price_piece double, price_unit double, unit_label string, image_url string"
)
OFFER_COLUMNS = OFFER.fieldNames()
CATALOG = _schema(
    "retailer string, sku string, name string, url string, haystack string, brand string, "
    "barcodes array<string>, ean string, price_piece double, price_unit double, "
    "unit_label string, image_url string"
)

# The closed retailer list in its display order, with host
# suffixes and base addresses.
RETAILERS = [
    ("sklavenitis", "Sklavenitis", "sklavenitis.gr", "https://www.sklavenitis.gr"),
    ("ab", "AB Vassilopoulos", "ab.gr", "https://www.ab.gr"),
    ("lidl", "Lidl", "lidl-hellas.gr", "https://www.lidl-hellas.gr"),
    ("masoutis", "Masoutis", "masoutis.gr", "https://www.masoutis.gr"),
    ("mymarket", "My Market", "mymarket.gr", "https://www.mymarket.gr"),
    ("kritikos", "Kritikos", "kritikos-sm.gr", "https://kritikos-sm.gr"),
    ("galaxias", "Galaxias", "galaxias.shop", "https://galaxias.shop"),
]
RETAILER_IDS = [row[0] for row in RETAILERS]
BASE_URL = {row[0]: row[3] for row in RETAILERS}
EAN_CAPABLE = ["galaxias", "kritikos", "lidl", "masoutis", "mymarket"]
IDENTITY_CHAINS = ["galaxias", "mymarket", "masoutis"]
CATALOG_PRICED = ["ab", "kritikos"]

# Thresholds and limits.
SUGGESTION_THRESHOLD = 0.45
EAN_DISCOVERY_THRESHOLD = 0.6
AUTO_PICK_THRESHOLD = 0.8
SIZE_MATCH_BONUS = 0.2
SIZE_UNVERIFIED_PENALTY = 0.1
BRAND_MISS_PENALTY = 0.5
SEARCH_ROW_CAP = 100
MAX_CANDIDATES = 5
UNIT_PRICE_DIVERGENCE = 0.2
STALE_AFTER_DAYS = 2
HISTORY_BARS = 14
SEARCH_CACHE_TTL_HOURS = 6
BARCODE_HIT_TTL_DAYS = 90
BARCODE_MISS_TTL_DAYS = 14
FAILED_PAGE_BUDGET = {"ab": 12, "sklavenitis": 20}
#: Chains whose first catalog page announces how many there are, and its number.
FIRST_PAGE = {"ab": 0}
MAX_PAGES = 1000
EAN_REGEX = r"^\d{8,14}$"


def retailer_dim(spark: SparkSession) -> DataFrame:
    """The seven-row retailer dimension (bounded by construction)."""
    values = ", ".join(
        f"({i}, '{rid}', '{label}', '{host}', '{base}')"
        for i, (rid, label, host, base) in enumerate(RETAILERS)
    )
    return spark.sql(
        f"SELECT * FROM VALUES {values} AS dim(ordinal, retailer, label, host, base_url)"
    )
