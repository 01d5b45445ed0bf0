"""The given tables seen as the price model.

Each view below is plain SQL that Spark and DuckDB both read, so a query and its
check start from the same rows: parts are products, (part, supplier) pairs are
retailer listings, line items are daily price captures.
"""

from __future__ import annotations

import re
from zlib import crc32

from pyspark.sql import DataFrame, SparkSession

from aislegraph.model import BASE_URL, RETAILER_IDS

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _case(expr: str, values: list[str]) -> str:
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values[:-1]))
    return f"CASE {expr} {arms} ELSE '{values[-1]}' END"


_BRAND_ROOT = _case(
    "cast(substr(p_brand, 7) AS int) % 5", ["ΝΟΥΝΟΥ", "FAGE", "Όλυμπος", "Coca-Cola", "Ήλιος"]
)
_ADJECTIVE = (
    "CASE split_part(p_name, ' ', 1) WHEN 'blue' THEN 'Φρέσκο' WHEN 'cold' THEN 'Ελαφρύ' "
    "WHEN 'hot' THEN 'Πλήρες' WHEN 'large' THEN 'Παραδοσιακό' WHEN 'new' THEN 'Νέο' "
    "WHEN 'old' THEN 'Κατσικίσιο' WHEN 'red' THEN 'Αγελαδινό' ELSE 'Μικρό' END"
)
_NOUN = (
    "CASE split_part(p_name, ' ', 2) WHEN 'anvil' THEN 'Γάλα' WHEN 'bolt' THEN "
    "'Γιαούρτι Στραγγιστό' WHEN 'gear' THEN 'Φυστίκια Αιγίνης' WHEN 'gizmo' THEN "
    "'Καφές Αλεσμένος' WHEN 'plate' THEN 'Μακαρόνια με Σάλτσα' WHEN 'ring' THEN "
    "'Δημητριακά Βρώμης' WHEN 'rod' THEN 'Νερό Ανθρακούχο' ELSE 'Σοκολάτα & Φουντούκι' END"
)
_RETAILER = _case("l_suppkey % 7", RETAILER_IDS)
_LISTING_ID = "(l_partkey * 100000000 + l_suppkey)"
_URL = (
    "CASE retailer "
    f"WHEN 'ab' THEN '{BASE_URL['ab']}/el/eshop/x/p/' || retailer_sku "
    f"WHEN 'kritikos' THEN '{BASE_URL['kritikos']}/products/x-' || retailer_sku || '/' "
    f"WHEN 'galaxias' THEN '{BASE_URL['galaxias']}/product/' || retailer_sku "
    f"WHEN 'masoutis' THEN '{BASE_URL['masoutis']}/categories/item/x?' || "
    "substr(retailer_sku, 1, 8) || '=' "
    f"WHEN 'mymarket' THEN '{BASE_URL['mymarket']}/x-' || retailer_sku "
    f"WHEN 'sklavenitis' THEN '{BASE_URL['sklavenitis']}/c/x-' || retailer_sku || '/' "
    f"ELSE '{BASE_URL['lidl']}/p/x/p' || retailer_sku END"
)

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def _view(name: str, needs: str, sql: str) -> None:
    VIEWS[name] = (tuple(needs.split()), sql)


_view("product_parts", "part", f"""
    SELECT p_partkey AS id, p_size,
           CASE WHEN p_partkey % 3 = 0
                THEN cast(5200000000000 + p_partkey AS string) END AS ean,
           {_BRAND_ROOT} || ' ' || substr(p_brand, 7) AS brand,
           {_ADJECTIVE} AS adjective, {_NOUN} AS noun,
           CASE WHEN p_partkey % 4 = 0
                THEN ' ' || cast(1 + p_partkey % 3 AS string) || ',5%' ELSE '' END AS pct,
           CASE p_partkey % 5
                WHEN 0 THEN ''
                WHEN 1 THEN ' ' || cast(p_size * 50 AS string) || 'g'
                WHEN 2 THEN ' ' || cast(p_size AS string) || ',5 lt'
                WHEN 3 THEN ' ' || cast(p_size AS string) || 'kg'
                ELSE ' 4x' || cast(p_size * 10 AS string) || 'ml' END AS size_text,
           CASE p_partkey % 5
                WHEN 1 THEN ' ' || cast(p_size * 50 AS string) || 'γρ.'
                WHEN 3 THEN ' ' || cast(p_size * 1000 AS string) || 'gr'
                WHEN 4 THEN ' 4*' || cast(p_size * 10 AS string) || 'ML'
                WHEN 2 THEN ' ' || cast(p_size AS string) || '.5lt'
                ELSE '' END AS size_alt
    FROM part
""")
_view("products", "product_parts", """
    SELECT id, ean, brand, adjective || ' ' || noun || pct || size_text AS title,
           CASE WHEN id % 10 = 0 THEN cast(p_size * 50 AS double) END AS size_value,
           CASE WHEN id % 10 = 0 THEN 'g' END AS size_unit,
           CASE WHEN id % 6 = 0 THEN 'https://img.example.com/' || cast(id AS string) || '.jpg'
           END AS image_url
    FROM product_parts
""")
_view("listings", "lineitem", f"""
    SELECT id, product_id, retailer, retailer_sku, {_URL} AS url
    FROM (SELECT DISTINCT {_LISTING_ID} AS id, l_partkey AS product_id, {_RETAILER} AS retailer,
                 cast({_LISTING_ID} AS string) AS retailer_sku
          FROM lineitem) AS pairs
""")
_view("captures", "lineitem", f"""
    SELECT {_LISTING_ID} AS listing_id, l_partkey AS product_id, {_RETAILER} AS retailer,
           cast(l_shipdate AS date) AS scraped_date, l_shipdate AS scraped_at,
           l_orderkey * 10 + l_linenumber AS seq, l_linenumber,
           CASE WHEN l_linenumber <> 7
                THEN floor(l_extendedprice / l_quantity + 0.5) / 100 END AS price_piece,
           CASE WHEN l_linenumber % 3 = 0 OR (l_linenumber = 7 AND l_returnflag <> 'R')
                THEN floor(l_extendedprice / l_quantity * 2 + 0.5) / 100 END AS price_unit,
           CASE l_suppkey % 3 WHEN 0 THEN 'κιλό' WHEN 1 THEN 'λίτρο' ELSE 'τεμ.' END
               AS unit_label
    FROM lineitem
""")
# What a retailer's search shows for a listing: re-cased, re-ordered, re-spelled,
# re-sized or size-less titles, with or without a brand field.
_view("offers", "lineitem product_parts", f"""
    SELECT l.product_id, l.retailer, l.sku, p.ean AS product_ean,
           CASE l.style
             WHEN 0 THEN p.brand || ' ' || p.adjective || ' ' || p.noun || p.pct || p.size_text
             WHEN 1 THEN upper(p.brand || ' ' || p.noun || ' ' || p.adjective || p.pct
                               || p.size_alt)
             WHEN 2 THEN p.noun || ' ' || p.brand || ' ' || p.adjective || p.pct || p.size_alt
             WHEN 3 THEN p.brand || ' ' || replace(replace(replace(p.adjective || ' ' || p.noun,
                         'Φυστίκια', 'Φιστίκια'), 'Στραγγιστό', 'Στραγγισμένο'),
                         'Ανθρακούχο', 'Αεριούχο') || ' -20%' || p.pct || p.size_text
             WHEN 4 THEN p.brand || ' ' || p.adjective || ' ' || p.noun
             ELSE replace(p.adjective, 'ό', 'ο') || ' ' || replace(p.noun, 'κο', 'κκο')
                  || p.pct || p.size_text END AS title,
           CASE WHEN l.style IN (0, 5) THEN replace(p.brand, 'FAGE', 'ΦΑΓΕ') END AS brand,
           CASE WHEN l.retailer IN ('galaxias', 'kritikos') THEN p.ean END AS ean,
           l.price_piece, l.style
    FROM (SELECT l_partkey AS product_id, {_RETAILER} AS retailer,
                 cast({_LISTING_ID} AS string) AS sku, l_suppkey % 6 AS style,
                 min(floor(l_extendedprice / l_quantity + 0.5) / 100) AS price_piece
          FROM lineitem GROUP BY l_partkey, l_suppkey) AS l
    JOIN product_parts AS p ON p.id = l.product_id
""")


def _closure(names: tuple[str, ...]) -> list[str]:
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in VIEWS and name not in ordered:
            for need in VIEWS[name][0]:
                visit(need)
            ordered.append(name)

    for name in names:
        visit(name)
    return ordered


def with_views(names: str, body: str) -> str:
    """Oracle SQL: the needed views as common table expressions before ``body``."""
    ctes = ", ".join(f"{name} AS ({VIEWS[name][1]})" for name in _closure(tuple(names.split())))
    return f"WITH RECURSIVE {ctes} {body}"


_BUILT: dict[tuple[str, str, str], DataFrame] = {}
#: Views that grow with the products: joins with them are by sorting, never by a broadcast.
PRODUCT_VIEWS = ("product_parts", "products")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the views (or given tables) as a Spark DataFrame.

    A view is analysed once per application and folder; its inputs are named
    temporary views so that the SQL text stays the one DuckDB reads.
    """
    if name not in VIEWS:
        return load(spark, sf_dir, name)
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _BUILT:
        needs, text = VIEWS[name]
        for need in needs:
            named = f"v{crc32(sf_dir.encode()):08x}_{need}"
            view(spark, sf_dir, need).createOrReplaceTempView(named)
            text = re.sub(rf"\b(FROM|JOIN) {need}\b", rf"\1 {named}", text)
        built = spark.sql(text)
        # Spark takes these rows for as large as the part file, a small share of what titles, stems and gates weigh.
        _BUILT[key] = built.hint("merge") if name in PRODUCT_VIEWS else built
    return _BUILT[key]


_view("patches", "events", """
    SELECT event_id AS seq, user_id * 13 + k AS product_id,
           event_type = 'view' AS has_title,
           CASE WHEN event_id % 9 = 0 THEN NULL
                ELSE ' Νέος τίτλος ' || cast(event_id AS string) END AS title,
           event_type = 'click' AS has_brand,
           CASE WHEN event_id % 5 = 0 THEN '   ' ELSE ' Brand ' || cast(k AS string) END AS brand,
           event_type = 'purchase' AS has_ean,
           CASE WHEN event_id % 7 = 0 THEN 'bad' WHEN event_id % 8 = 0 THEN NULL
                ELSE cast(5200000000000 + k * 20 + event_id % 3 AS string) END AS ean,
           event_type = 'signup' AS has_size,
           CASE WHEN event_id % 6 = 0 THEN 'x' ELSE cast(event_id % 900 AS string) END AS size_value,
           CASE WHEN event_id % 4 = 0 THEN '  ' ELSE ' ml ' END AS size_unit,
           event_type = 'view' AND event_id % 2 = 0 AS has_image,
           CASE WHEN event_id % 3 = 0 THEN 'https://i.example.com/' || cast(k AS string) END
               AS image_url
    FROM (SELECT event_id, user_id, event_type,
                 cast(regexp_extract(props, '([0-9]+)', 1) AS bigint) AS k FROM events) AS keyed
""")
_view("catalog_old", "lineitem", f"""
    SELECT {_RETAILER} AS retailer, cast({_LISTING_ID} AS string) AS sku,
           min(floor(l_extendedprice / l_quantity + 0.5) / 100) AS price_piece
    FROM lineitem WHERE l_linenumber <= 4 GROUP BY 1, 2
""")
# One chain's crawl came back empty and one was rejected.
_view("catalog_new", "lineitem", f"""
    SELECT {_RETAILER} AS retailer, cast({_LISTING_ID} AS string) AS sku,
           min(floor(l_extendedprice / l_quantity + 0.5) / 100) AS price_piece
    FROM lineitem WHERE l_linenumber >= 2 AND l_suppkey % 7 <> 2 GROUP BY 1, 2
""")
