"""Multi-pass search and ranking for a whole product table in one plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aislegraph.functions import text
from aislegraph.operators import linking, search
from aislegraph.operators.postings import write_search_index
from aislegraph.session import release, shared_folder, stored


def multi_pass_search(
    products: DataFrame, catalog: DataFrame, retailers: DataFrame, cap: int | None
) -> tuple[DataFrame, DataFrame]:
    """Search every product at every retailer with progressively looser queries.

    ``catalog`` holds one row per (retailer, sku) with title, brand, ean, pos and
    retailer_no. Only (product, retailer) targets still below the suggestion
    threshold run the next pass; passes merge per sku, the best score staying. Each text search
    returns its best ``cap`` rows per chain (all with None). Products with a barcode also get
    the rows of barcode-capable chains that carry it, whatever those rows' titles.
    Products without a barcode then adopt one from a strong match and search the
    barcode-capable chains that still lack one. Returns the merged rows (product_id, retailer, sku, pos,
    retailer_no, ean, score, size_unverified, pass) and the discovered barcodes.

    The catalog is worked out once. Its distinct texts are indexed, searched and compared; rows are
    only told the outcome. Every query of every pass is searched in one go.
    """
    spark = products.sparkSession
    rows, texts = search.shown_texts(catalog)
    documents = texts.select(F.lit("").alias("retailer"), F.col("text_id").cast("string").alias("sku"), "haystack")
    index = write_search_index(documents, shared_folder(spark, "search-index"))

    # Texts of offers, of products and of queries are numbered; what moves with pairs are numbers.
    own = linking.own_texts(products)
    owns = stored(own.select("own").distinct().select(F.monotonically_increasing_id().alias("own_id"), "own"), "own")
    own = stored(own.join(owns.hint("merge"), "own").drop("own"), "products")
    listed = linking.pass_queries(products)
    asked = stored(listed.select("query").distinct().select(F.monotonically_increasing_id().alias("query_id"), "query"), "asked")
    queries = stored(listed.join(asked.hint("merge"), "query").drop("query"), "queries")
    terms = stored(search.query_terms(asked, text.query_terms(F.col("query"))), "terms")
    best = stored(search.text_search(terms, index, texts, cap), "best")
    hits = stored(search.rows_of_texts(best, rows, cap), "hits")

    offer = ["retailer", "sku", "pos", "retailer_no", "ean"]

    def compared(pairs: DataFrame) -> DataFrame:
        named = pairs.join(texts.select("text_id", "shown").hint("merge"), "text_id").join(owns.hint("merge"), "own_id")
        return linking.compare_texts(named).drop("shown", "own")

    targets = products.select(F.col("id").alias("product_id")).crossJoin(
        F.broadcast(retailers.select("retailer"))
    )
    open_targets, parts = targets, []
    for number in range(4):
        asking = queries.filter(F.col("pass") == number).drop("pass").join(open_targets, "product_id").join(own, "product_id")
        wanted = asking.join(hits, ["query_id", "retailer"])
        both = ["own_id", "text_id"]
        told = stored(compared(wanted.select(*both).distinct()), "compared")
        found = wanted.join(told, both).select(
            "product_id", "_product_ean", "retailer", "_passes", "_one", "_fuzzy", F.inline("rows")
        )
        scored = linking.final_scores(found, "product_id", *offer)
        if number == 0:
            known = own.filter(F.length("_product_ean") > 0).select("product_id", F.col("_product_ean").alias("ean"))
            coded = rows.filter(F.col("retailer").isin(linking.EAN_CAPABLE)).join(known, "ean")
            scored = scored.unionByName(coded.select(
                "product_id", *offer, F.lit(1.0).alias("score"), F.lit(False).alias("size_unverified")
            ))
        parts.append(stored(scored.withColumn("pass", F.lit(number)), f"pass-{number}"))
        # A target that a pass has closed gets no rows from later ones.
        open_targets = stored(linking.weak_chains(open_targets, parts[-1]), "open")

    every = reduce(DataFrame.unionByName, parts)
    unknown = products.filter(F.col("ean").isNull()).select(F.col("id").alias("product_id"))
    # A row's score is the same in every pass, so weaker rows cannot change what is found.
    strong = every.filter(linking.strong_code()).join(unknown, "product_id", "left_semi")
    discovered = stored(linking.discovered_ean(linking.merge_best_score(strong)), "discovered")
    near = targets.join(discovered, "product_id", "left_semi")
    retry = linking.ean_pass_targets(near, every.join(discovered, "product_id", "left_semi"), discovered)
    by_code = rows.join(
        retry.select("product_id", "retailer", F.col("discovered_ean").alias("ean")), ["retailer", "ean"]
    ).join(own.select("product_id", "own_id"), "product_id").withColumn("_product_ean", F.col("ean"))
    exact = by_code.join(stored(compared(by_code.select(*both).distinct()), "compared"), both)
    last = linking.final_scores(exact, "product_id", *offer).withColumn("pass", F.lit(4))
    return linking.merge_best_score(every.unionByName(last)), discovered


def discovered_barcodes(
    products: DataFrame, catalog: DataFrame, retailers: DataFrame, cap: int | None
) -> DataFrame:
    """The barcodes that ``multi_pass_search`` discovers, without its rows: (product_id, discovered_ean).

    A chain that shows no barcode at all has none to give, and what a chain is asked, finds and
    closes hangs on its own rows alone, so only chains with a barcode are searched. Products without one that read alike
    ask and find the same, so they are searched once. Of each target that is
    still open a pass keeps the best score and the best row with a barcode.
    """
    spark = products.sparkSession
    # At most one row a retailer.
    coded = catalog.filter(F.col("ean").isNotNull()).select("retailer").distinct()
    chains = [r[0] for r in retailers.select("retailer").distinct().join(coded, "retailer").collect()]
    release(spark)
    rows, texts = search.shown_texts(catalog.filter(F.col("retailer").isin(chains)))
    documents = texts.select(F.lit("").alias("retailer"), F.col("text_id").cast("string").alias("sku"), "haystack")
    index = write_search_index(documents, shared_folder(spark, "search-index"))

    named = products.filter(F.col("ean").isNull()).select("id", F.struct("brand", "title").alias("named"))
    alike = stored(named.groupBy("named").agg(F.min("id").alias("id")).select("id", "named"), "alike")
    readers = alike.select("id", "named.*", F.lit(None).cast("string").alias("ean"))
    own = stored(linking.own_texts(readers).drop("_product_ean"), "own")
    queries = stored(linking.pass_queries(readers), "queries")
    open_targets = stored(readers.select(F.col("id").alias("product_id")).crossJoin(
        F.broadcast(retailers.select("retailer").filter(F.col("retailer").isin(chains)).distinct())
    ), "open")

    parts = []
    # The looser passes are asked together, and only for targets that the first one left open.
    for passes in ([0], [1, 2, 3]):
        asking = stored(queries.filter(F.col("pass").isin(passes)).join(open_targets, "product_id"), "asking")
        if asking.isEmpty():
            break
        asked = stored(asking.select("query").distinct().select(F.monotonically_increasing_id().alias("query_id"), "query"), "asked")
        terms = stored(search.query_terms(asked, text.query_terms(F.col("query"))), "terms")
        best = stored(search.text_search(terms, index, texts, cap), "best")
        # Rows of one text score alike: the last of those with a barcode is the one that counts.
        last = F.array_max(F.transform(
            F.filter("rows", lambda r: r["ean"].isNotNull()), lambda r: F.struct(r["retailer_no"], r["pos"], r["ean"])
        ))
        hits = stored(search.rows_of_texts(best, rows, cap).select("query_id", "retailer", "text_id", last.alias("last")), "hits")
        numbered = asking.join(asked.hint("merge"), "query").drop("query")
        for number in passes:
            still = numbered.filter(F.col("pass") == number).join(open_targets, ["product_id", "retailer"], "left_semi")
            wanted = still.drop("pass").join(hits, ["query_id", "retailer"]).drop("query_id")
            both = ["product_id", "text_id"]
            pairs = wanted.select(*both).distinct().join(texts.select("text_id", "shown").hint("merge"), "text_id")
            told = linking.compare_texts(pairs.join(own.hint("merge"), "product_id"))
            scored = wanted.join(stored(told.select(*both, F.col("_fuzzy").alias("score")), "compared"), both).select(
                "product_id", "retailer", "score", "last.*"
            )
            key = F.struct("score", "retailer_no", F.lit(number).alias("pass"), "pos", "ean")
            parts.append(stored(scored.groupBy("product_id", "retailer").agg(
                F.max("score").alias("score"), F.max(F.when(linking.strong_code(), key)).alias("k")
            ), f"pass-{number}"))
            open_targets = stored(linking.weak_chains(open_targets, parts[-1]), "open")
    if not parts:
        return products.limit(0).select(F.col("id").alias("product_id"), F.col("ean").alias("discovered_ean"))
    # A target that holds such a row is closed by its pass, so no later pass shows the row again.
    found = reduce(DataFrame.unionByName, parts).groupBy("product_id").agg(F.max("k").alias("k")).filter("k IS NOT NULL")
    told = alike.join(found.select(F.col("product_id").alias("id"), F.col("k.ean").alias("discovered_ean")), "id").drop("id")
    return named.join(told, "named").select(F.col("id").alias("product_id"), "discovered_ean")
