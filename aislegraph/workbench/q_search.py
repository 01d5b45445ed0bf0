"""Search over the listings catalog and over whole documents."""

from pyspark.sql import functions as F

from aislegraph.functions import numbers, text
from aislegraph.operators import filters, postings, search, substrings
from aislegraph.workbench import duck
from aislegraph.workbench.registry import query
from aislegraph.session import shared_folder, stored
from aislegraph.workbench.tables import load, view, with_views


def documents(spark, sf):
    """Documents as a searchable catalog, one per source."""
    return load(spark, sf, "documents").select(
        F.col("source").alias("retailer"), F.col("doc_id").cast("string").alias("sku"),
        text.haystack(F.col("text")).alias("haystack"),
    )


def passages(spark, sf):
    return load(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def offers_catalog(spark, sf):
    shown = F.concat_ws(" ", "brand", "title")
    return view(spark, sf, "offers").select(
        "retailer", "sku", text.haystack(shown).alias("haystack"), "product_ean",
        F.array_compact(F.array("product_ean")).alias("barcodes"),
    )


def product_queries(spark, sf):
    return view(spark, sf, "products").select(
        F.col("id").alias("query_id"), "ean", "brand", "title",
        F.concat_ws(" ", "brand", "title").alias("text"),
    )


_STORED: dict[tuple[str, str, str], str] = {}


def stored_index(spark, sf, name, catalog) -> postings.SearchIndex:
    """The index of a catalog, written once per application and folder."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _STORED:
        folder = shared_folder(spark, f"index-{name}")
        postings.write_search_index(catalog(spark, sf), folder)
        _STORED[key] = folder
    return postings.open_search_index(spark, _STORED[key])


def terms_of(queries):
    return search.query_terms(queries, text.query_terms(F.col("text")))


def _stems(x):
    return f"list_transform({duck.words(duck.norm(x))}, lambda w: {duck.stem('w')})"


DOCS = f"""docs AS (
    SELECT source AS retailer, cast(doc_id AS VARCHAR) AS sku,
           {duck.words(duck.fold(duck.norm('text')))} AS words FROM documents
), postings AS (
    SELECT retailer, sku, term, count(*) AS tf, any_value(dl) AS dl
    FROM (SELECT retailer, sku, len(words) AS dl, unnest(words) AS term FROM docs) GROUP BY ALL
)"""
PASSAGE_TERMS = f"""terms AS (
    SELECT item_id AS query_id, unnest({_stems('text')}) AS prefix,
           len({_stems('text')}) AS n_terms FROM benchmark
)"""


@query("build_search_index", f"""WITH {DOCS}
    SELECT retailer, sku, term, tf, dl FROM postings""")
def build_search_index(spark, sf):
    index = stored_index(spark, sf, "documents", documents)
    return postings.postings(index).select(
        "retailer", "sku", "term", F.col("tf").cast("bigint").alias("tf"), F.col("dl").cast("bigint").alias("dl")
    )


@query("corpus_stats", f"""WITH {DOCS}
    SELECT retailer, count(*) AS n_docs, floor(avg(len(words)) * 1000000 + 0.5) / 1000000 AS avgdl
    FROM docs GROUP BY retailer""")
def corpus_stats(spark, sf):
    stats = stored_index(spark, sf, "documents", documents).stats
    return stats.withColumn("avgdl", numbers.round6(F.col("avgdl")))


SEARCHED = f"""WITH {DOCS}, {PASSAGE_TERMS}, prefixes AS (SELECT DISTINCT prefix FROM terms),
vocabulary AS (SELECT DISTINCT term FROM postings),
expanded AS (SELECT prefix, term FROM prefixes JOIN vocabulary ON starts_with(term, prefix)),
hits AS (
    SELECT retailer, prefix, sku, sum(tf) AS tf, any_value(dl) AS dl
    FROM postings JOIN expanded USING (term) GROUP BY ALL
), counts AS (SELECT retailer, prefix, count(*) AS n FROM hits GROUP BY ALL),
stats AS (SELECT retailer, count(*) AS n_docs, avg(len(words)) AS avgdl FROM docs GROUP BY retailer),
matched AS (
    SELECT query_id, retailer, sku, n_terms, count(*) AS met,
           sum(CASE WHEN ln((n_docs - n + 0.5) / (n + 0.5)) > 0 THEN ln((n_docs - n + 0.5) / (n + 0.5))
               ELSE 1e-6 END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS bm25
    FROM terms JOIN hits USING (prefix) JOIN counts USING (retailer, prefix) JOIN stats USING (retailer)
    GROUP BY ALL HAVING count(*) = n_terms
)"""


@query("prefix_and_search", SEARCHED + " SELECT query_id, retailer, sku FROM matched")
def prefix_and_search(spark, sf):
    terms = terms_of(passages(spark, sf))
    found = search.stored_and_search(terms, stored_index(spark, sf, "documents", documents))
    return found.select("query_id", "retailer", "sku")


@query("bm25_documents", SEARCHED + """
    SELECT query_id, retailer, sku, floor(bm25 * 1000000 + 0.5) / 1000000 AS bm25 FROM matched""")
def bm25_documents(spark, sf):
    index = stored_index(spark, sf, "documents", documents)
    found = search.bm25_search(terms_of(passages(spark, sf)), index, cap=None)
    return found.select("query_id", "retailer", "sku", numbers.round6(F.col("bm25")).alias("bm25"))


CATALOG = f"""cat AS (
    SELECT retailer, sku, product_ean,
           {duck.words(duck.fold(duck.norm("coalesce(brand || ' ', '') || title")))} AS words FROM offers
), postings AS (
    SELECT retailer, sku, term, count(*) AS tf, any_value(dl) AS dl
    FROM (SELECT retailer, sku, len(words) AS dl, unnest(words) AS term FROM cat) GROUP BY ALL
), terms AS (
    SELECT id AS query_id, unnest({_stems("brand || ' ' || title")}) AS prefix,
           len({_stems("brand || ' ' || title")}) AS n_terms FROM products
), prefixes AS (SELECT DISTINCT prefix FROM terms),
vocabulary AS (SELECT DISTINCT term FROM postings),
expanded AS (SELECT prefix, term FROM prefixes JOIN vocabulary ON starts_with(term, prefix)),
hits AS (
    SELECT retailer, prefix, sku, sum(tf) AS tf, any_value(dl) AS dl
    FROM postings JOIN expanded USING (term) GROUP BY ALL
), counts AS (SELECT retailer, prefix, count(*) AS n FROM hits GROUP BY ALL),
stats AS (SELECT retailer, count(*) AS n_docs, avg(len(words)) AS avgdl FROM cat GROUP BY retailer),
rare AS (
    SELECT query_id, retailer, n_terms, arg_min(prefix, n) AS driver FROM terms JOIN counts USING (prefix)
    GROUP BY ALL HAVING count(*) = n_terms
), started AS (
    SELECT query_id, r.retailer, h.sku, n_terms FROM rare r
    JOIN hits h ON h.retailer = r.retailer AND h.prefix = r.driver
), matched AS (
    SELECT s.query_id, s.retailer, s.sku,
           sum(CASE WHEN ln((n_docs - n + 0.5) / (n + 0.5)) > 0 THEN ln((n_docs - n + 0.5) / (n + 0.5))
               ELSE 1e-6 END * h.tf * 2.2 / (h.tf + 1.2 * (0.25 + 0.75 * h.dl / avgdl))) AS bm25
    FROM started s JOIN terms t ON t.query_id = s.query_id
    JOIN hits h ON h.retailer = s.retailer AND h.prefix = t.prefix AND h.sku = s.sku
    JOIN counts c ON c.retailer = s.retailer AND c.prefix = t.prefix
    JOIN stats ON stats.retailer = s.retailer
    GROUP BY s.query_id, s.retailer, s.sku, s.n_terms HAVING count(*) = s.n_terms
), top AS (
    SELECT *, row_number() OVER (PARTITION BY query_id, retailer
                                 ORDER BY floor(bm25 * 1e9 + 0.5) DESC, sku) AS rank
    FROM matched QUALIFY rank <= 100
)"""


def coded_offers(spark, sf):
    return view(spark, sf, "offers").select("retailer", "sku", "title", "brand", F.col("product_ean").alias("ean"))


def catalog_lists(spark, sf):
    """The stored rows of the offers and what each product's text finds among them."""
    rows, texts = search.shown_texts(coded_offers(spark, sf))
    asked = product_queries(spark, sf).select("query_id", "ean", "text")
    return rows, search.listed_search(asked, rows, texts, search.SEARCH_ROW_CAP)


@query("bm25_search", with_views("offers products", f""", {CATALOG}
    SELECT query_id, retailer, sku, rank, floor(bm25 * 1000000 + 0.5) / 1000000 AS bm25 FROM top"""))
def bm25_search(spark, sf):
    _, listed = catalog_lists(spark, sf)
    ranked = listed.select("query_id", "retailer", F.posexplode("rows").alias("n", "r"))
    return ranked.select(
        "query_id", "retailer", "r.sku", (F.col("n") + 1).cast("bigint").alias("rank"), numbers.round6(F.col("r.bm25")).alias("bm25")
    )


@query("ean_first_search", with_views("offers products", f""", {CATALOG}, exact AS (
    SELECT p.id AS query_id, c.retailer, c.sku, p.ean FROM products p
    JOIN cat c ON c.product_ean = p.ean)
    SELECT query_id, retailer, sku, ean, 0 AS priority FROM exact UNION ALL
    SELECT query_id, retailer, sku, cat.product_ean, 1 FROM top JOIN cat USING (retailer, sku)
    ANTI JOIN exact USING (query_id, retailer, sku)"""))
def ean_first_search(spark, sf):
    rows, listed = catalog_lists(spark, sf)
    return search.ean_first_search(product_queries(spark, sf), rows, listed)


@query("barcode_contains", with_views("offers products", """
    SELECT o.retailer, o.sku, o.product_ean AS ean FROM offers o
    WHERE o.product_ean IN (SELECT ean FROM products WHERE ean IS NOT NULL AND id % 2 = 0)"""))
def barcode_contains(spark, sf):
    wanted = view(spark, sf, "products").filter("ean IS NOT NULL AND id % 2 = 0")
    return filters.barcode_contains(offers_catalog(spark, sf), wanted).select(
        "retailer", "sku", F.col("wanted_ean").alias("ean")
    )


# Up to three short words of every benchmark item, as typed into a search box.
@query("like_and_filter", """WITH asked AS (
    SELECT item_id, list_slice(regexp_extract_all(text, '(?:^|[ \\n])([A-Za-z]{2,5})', 1), 1, 3) AS terms FROM benchmark
    ) SELECT item_id, doc_id FROM asked JOIN documents
    ON len(terms) > 0 AND len(list_filter(terms, lambda t: NOT contains(text, t))) = 0""")
def like_and_filter(spark, sf):
    typed = F.slice(F.regexp_extract_all("text", F.lit(r"(?:^|[ \n])([A-Za-z]{2,5})"), F.lit(1)), 1, 3)
    asked = load(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), typed.alias("terms"))
    found = substrings.substring_and_search(asked, F.col("terms"), load(spark, sf, "documents"), "text", ["doc_id"])
    return found.select(F.col("query_id").alias("item_id"), "doc_id")


# Every product's title against every catalog row; the check looks at distinct texts only.
@query("substring_and_search", with_views("offers products", f""", hays AS (
    SELECT retailer, sku, {duck.fold(duck.norm("coalesce(brand || ' ', '') || title"))} AS hay FROM offers
    ), asked AS (SELECT id, list_distinct({_stems("title")}) AS terms FROM products
    ), met AS (
    SELECT terms, hay FROM (SELECT DISTINCT list_sort(terms) AS terms FROM asked) t JOIN (SELECT DISTINCT hay FROM hays) h
    ON len(terms) > 0 AND len(list_filter(terms, lambda t: NOT contains(hay, t))) = 0)
    SELECT id AS product_id, retailer, sku FROM asked JOIN met ON met.terms = list_sort(asked.terms) JOIN hays USING (hay)"""))
def substring_and_search(spark, sf):
    asked = view(spark, sf, "products").select(F.col("id").alias("query_id"), text.query_terms(F.col("title")).alias("terms"))
    # Stored, so that the offers' shuffles are gone before they are searched; they are read twice.
    rows = stored(offers_catalog(spark, sf).select("retailer", "sku", "haystack"), "rows")
    found = substrings.substring_and_search(asked, F.col("terms"), rows, "haystack", ["retailer", "sku"])
    return found.select(F.col("query_id").alias("product_id"), "retailer", "sku")


@query("unique_hit_ean_stamp", with_views("offers products", """, found AS (
    SELECT p.id AS query_id, o.retailer, o.sku, p.ean AS query_ean FROM products p
    JOIN offers o ON o.product_ean = p.ean WHERE o.retailer IN ('masoutis', 'mymarket'))
    SELECT query_id, retailer, sku,
           CASE WHEN count(*) OVER (PARTITION BY query_id, retailer) = 1 THEN query_ean END AS ean
    FROM found"""))
def unique_hit_ean_stamp(spark, sf):
    rows = view(spark, sf, "offers").filter(F.col("retailer").isin("masoutis", "mymarket"))
    asked = view(spark, sf, "products").select(
        F.col("id").alias("query_id"), F.col("ean").alias("query_ean")
    )
    hits = rows.join(asked, rows.product_ean == asked.query_ean).select(
        "query_id", "retailer", "sku", "query_ean", "ean"
    )
    return search.unique_hit_ean_stamp(hits).select("query_id", "retailer", "sku", "ean")


@query("priority_union", with_views("offers", """
    SELECT retailer, sku, 0 AS priority FROM offers WHERE ean IS NOT NULL UNION ALL
    SELECT retailer, sku, 1 FROM offers WHERE style <> 1 AND ean IS NULL"""))
def priority_union(spark, sf):
    offers = view(spark, sf, "offers")
    return search.priority_union(
        offers.filter("ean IS NOT NULL").select("retailer", "sku"),
        offers.filter("style <> 1").select("retailer", "sku"), ["retailer", "sku"],
    )


# Catalog chains answer from their offers, the others from their listings; some captures stand for failed calls.
@query("merge_chain_results", with_views("offers listings captures", """, responses AS (
    SELECT product_id AS query_id, retailer, cast(sku AS BIGINT) AS pos, sku, CAST(NULL AS VARCHAR) AS error FROM offers
    WHERE retailer IN ('ab', 'kritikos', 'galaxias') UNION ALL
    SELECT product_id, retailer, id % 10, retailer_sku, NULL FROM listings
    WHERE retailer NOT IN ('ab', 'kritikos', 'galaxias') UNION ALL
    SELECT product_id, retailer, CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), 'no answer from ' || retailer FROM captures WHERE seq % 10 = 7)
    SELECT query_id, retailer, sku, min(pos) AS pos, NULL AS error FROM responses WHERE sku IS NOT NULL
    GROUP BY ALL UNION ALL
    SELECT DISTINCT query_id, NULL, NULL, NULL, error FROM responses WHERE error IS NOT NULL"""))
def merge_chain_results(spark, sf):
    priced = F.col("retailer").isin("ab", "kritikos", "galaxias")
    indexed = view(spark, sf, "offers").filter(priced).select(
        F.col("product_id").alias("query_id"), "retailer", F.col("sku").cast("bigint").alias("pos"), "sku")
    live = view(spark, sf, "listings").filter(~priced).select(
        F.col("product_id").alias("query_id"), "retailer", (F.col("id") % 10).alias("pos"), F.col("retailer_sku").alias("sku"))
    failed = view(spark, sf, "captures").filter("seq % 10 = 7").select(
        F.col("product_id").alias("query_id"), "retailer", F.concat(F.lit("no answer from "), "retailer").alias("error"))
    results, errors = search.merge_chain_results(indexed, live, failed)
    return results.unionByName(errors, allowMissingColumns=True)


NOW = "TIMESTAMP '2024-01-30 00:00:00'"


def lookups(spark, sf):
    return load(spark, sf, "events").select(
        "event_id", F.col("event_type").alias("retailer"), F.col("user_id").cast("string").alias("query"),
        F.when(F.col("event_id") % 2 == 0, F.get_json_object("props", "$.k")).alias("ean"),
        F.col("ts").alias("cached_at"),
    )


@query("search_cache_reuse", f"""WITH l AS (
    SELECT event_id, event_type AS retailer, cast(user_id AS VARCHAR) AS query,
           CASE WHEN event_id % 2 = 0 THEN json_extract_string(props, '$.k') ELSE '' END AS ean, ts
    FROM events
), cache AS (
    SELECT retailer, query, ean, max(ts) AS cached_at, arg_max(event_id, ts) AS result FROM l
    WHERE ts <= {NOW} GROUP BY ALL)
    SELECT l.event_id, c.result, c.result IS NOT NULL AS cached FROM l LEFT JOIN cache c
    ON c.retailer = l.retailer AND c.query = l.query AND c.ean = l.ean
       AND c.cached_at > {NOW} - INTERVAL 6 HOUR""")
def search_cache_reuse(spark, sf):
    from aislegraph.operators.maintenance import last_wins

    now = F.expr("TIMESTAMP_NTZ '2024-01-30 00:00:00'")
    asked = lookups(spark, sf)
    stored = asked.filter(F.col("cached_at") <= now).select(
        "retailer", "query", F.coalesce("ean", F.lit("")).alias("ean"), "cached_at",
        F.col("event_id").alias("result"),
    )
    cache = last_wins(stored, ["retailer", "query", "ean"], ["cached_at"])
    return search.search_cache_reuse(asked.drop("cached_at"), cache, now).select(
        "event_id", "result", "cached"
    )


@query("barcode_cache_ttl", f"""WITH e AS (
    SELECT cast(user_id AS VARCHAR) AS ean, event_id, ts, event_type <> 'error' AS found,
           CASE WHEN event_type <> 'error' THEN event_type END AS name FROM events
), cache AS (
    SELECT * FROM e WHERE ts < TIMESTAMP '2024-01-12'
    QUALIFY row_number() OVER (PARTITION BY ean ORDER BY ts DESC) = 1
), looked AS (
    SELECT * FROM e WHERE ts >= TIMESTAMP '2024-01-12'
    QUALIFY row_number() OVER (PARTITION BY ean ORDER BY ts DESC) = 1
), both_ AS (
    SELECT coalesce(c.ean, l.ean) AS ean, c.ean IS NULL AS no_old, l.ean IS NULL AS no_new,
           c.name AS old_name, l.name AS new_name, c.event_id AS old_id, l.event_id AS new_id,
           c.ts > {NOW} - CASE WHEN c.found THEN INTERVAL 90 DAY ELSE INTERVAL 14 DAY END AS fresh
    FROM cache c FULL JOIN looked l ON l.ean = c.ean)
    SELECT ean, CASE WHEN no_old THEN 'miss' WHEN fresh THEN 'hit' ELSE 'expired' END AS state,
           CASE WHEN keep THEN old_name ELSE new_name END AS name,
           CASE WHEN keep THEN old_id ELSE new_id END AS event_id
    FROM (SELECT *, no_new OR coalesce(fresh, false)
                 OR (new_name IS NULL AND old_name IS NOT NULL) AS keep FROM both_)""")
def barcode_cache_ttl(spark, sf):
    from aislegraph.operators.maintenance import last_wins

    seen = load(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("ean"), "event_id", F.col("ts").alias("cached_at"),
        (F.col("event_type") != "error").alias("found"),
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("name"),
    )
    cut = F.expr("TIMESTAMP_NTZ '2024-01-12 00:00:00'")
    cache = last_wins(seen.filter(F.col("cached_at") < cut), ["ean"], ["cached_at"])
    looked = last_wins(seen.filter(F.col("cached_at") >= cut), ["ean"], ["cached_at"])
    now = F.expr("TIMESTAMP_NTZ '2024-01-30 00:00:00'")
    return search.barcode_cache_refresh(cache, looked, now).select("ean", "state", "name", "event_id")
