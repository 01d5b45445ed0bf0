import datetime as dt

from pyspark.sql import functions as F

from aislegraph.operators import cache, maintenance, prices, quality
from aislegraph.sources import pages, payloads, urls
from aislegraph.streaming import jobs

HISTORY = "listing_id bigint, scraped_date date, seq bigint, price_piece double, price_unit double, unit_label string"


def day(n):
    return dt.date(2024, 1, n)


def test_upsert_is_idempotent_and_last_write_wins(spark):
    old = spark.createDataFrame([(1, day(1), 1, 2.0, None, None), (1, day(2), 2, 2.1, None, None)], HISTORY)
    new = spark.createDataFrame([(1, day(2), 5, 1.9, None, None), (1, day(2), 4, 9.9, None, None)], HISTORY)
    once = maintenance.upsert_daily_price(old, new)
    twice = maintenance.upsert_daily_price(once, new)
    want = [(1, 1, 2.0), (1, 5, 1.9)]
    for table in (once, twice):
        assert [(r.listing_id, r.seq, r.price_piece) for r in table.orderBy("seq").collect()] == want


def test_stream_upsert_over_several_batches_equals_batch(spark, tmp_path):
    rows = [(i % 7, day(1 + i % 5), i, float(i), None, None) for i in range(60)]
    frame = spark.createDataFrame(rows, HISTORY)
    for k in range(3):
        frame.filter(F.col("seq") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = jobs.read_stream(spark, str(tmp_path / "in"), frame.schema, files_per_batch=1)
    jobs.stream_price_upsert(stream, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
    got = jobs.read_prices(spark, str(tmp_path / "out")).select(*frame.columns)
    want = maintenance.last_wins(frame, maintenance.HISTORY_KEY, ["seq"])
    assert sorted(got.collect()) == sorted(want.collect())


def _replay(rows):
    """Lookup outcomes of one key, step by step."""
    held, out = None, []
    for ts, found in rows:
        ttl = None if held is None else dt.timedelta(days=90 if held[1] else 14)
        state = "miss" if held is None else ("hit" if ts < held[0] + ttl else "expired")
        out.append(state)
        if state == "miss" or (state == "expired" and (found or not held[1])):
            held = (ts, found)
    return out


def test_ttl_stream_equals_replay(spark, tmp_path):
    import random

    rng, rows = random.Random(5), []
    for key in range(6):
        ts = dt.datetime(2024, 1, 1)
        for _ in range(25):
            ts += dt.timedelta(days=rng.randint(0, 20), seconds=1)
            rows.append((key, ts, len(rows), rng.random() < 0.3))
    frame = spark.createDataFrame(rows, "key bigint, ts timestamp, seq bigint, found boolean")
    cut = F.lit("2024-05-01").cast("timestamp")
    frame.filter(F.col("ts") < cut).coalesce(1).write.parquet(str(tmp_path / "in"))
    for part in ("in",):
        stream = jobs.read_stream(spark, str(tmp_path / part), frame.schema)
        jobs.stream_ttl_cache(stream, str(tmp_path / "c"), str(tmp_path / "k")).awaitTermination()
    frame.filter(F.col("ts") >= cut).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = jobs.read_stream(spark, str(tmp_path / "in"), frame.schema)
    jobs.stream_ttl_cache(stream, str(tmp_path / "c"), str(tmp_path / "k")).awaitTermination()
    got = {r.seq: r.outcome for r in spark.read.parquet(str(tmp_path / "c" / "outcomes")).collect()}
    for key in range(6):
        mine = [r for r in rows if r[0] == key]
        assert [got[r[2]] for r in mine] == _replay([(r[1], r[3]) for r in mine])
    assert {"hit", "expired", "miss"} == set(got.values())
    assert cache.STATE == ["key", "cached_at", "found"]


def test_nested_listings_have_one_shape(spark):
    board = spark.range(5000).select(
        "id", F.when(F.col("id") < 4990, 1).otherwise(2).alias("product_id"), F.lit("ab").alias("retailer"), F.lit("s").alias("retailer_sku"),
        F.lit("u").alias("url"), F.when(F.col("id") % 2 == 0, F.lit("2001-01-01").cast("date")).alias("scraped_date"),
        F.lit(1.0).alias("price_piece"), F.lit(None).cast("double").alias("price_unit"),
        F.lit(None).cast("string").alias("unit_label"))
    rows = prices.nest_listings(board).collect()
    assert [(r.product_id, r.id) for r in rows] == sorted((1 if i < 4990 else 2, i) for i in range(5000))
    assert all((r.latest_price is None) == (r.id % 2 == 1) for r in rows)
    picked = prices.nest_picked(board, [2]).collect()
    assert len(picked) == 1 and [x.id for x in picked[0].listings] == list(range(4990, 5000))


def test_streams_equal_their_batch_twins_in_any_order(spark, tmp_path):
    import datetime
    import random

    from aislegraph.streaming import jobs

    rng = random.Random(1)
    rows = [(rng.randrange(40), datetime.datetime(2001, 1, 1) + datetime.timedelta(days=rng.randrange(200)), float(rng.randrange(90)), i) for i in range(600)]
    schema = "product_id bigint, scraped_at timestamp, price_piece double, seq bigint"
    for k in range(3):
        spark.createDataFrame(rows[k::3], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = jobs.read_stream(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema, files_per_batch=1)
    jobs.stream_daily_min(stream, f"{tmp_path}/daily", f"{tmp_path}/c1").awaitTermination()
    got = {(r.product_id, r.scraped_date): r.price for r in jobs.read_daily_min(spark, f"{tmp_path}/daily").collect()}
    want = {}
    for p, at, price, _ in rows:
        want[p, at.date()] = min(price, want.get((p, at.date()), price))
    assert got == want
    jobs.stream_first_wins(stream, ["product_id"], ["seq"], f"{tmp_path}/first", f"{tmp_path}/c2").awaitTermination()
    firsts = {r.product_id: r.seq for r in jobs.read_first_wins(spark, f"{tmp_path}/first", ["product_id"]).collect()}
    assert firsts == {p: min(r[3] for r in rows if r[0] == p) for p in {r[0] for r in rows}}


def test_ties_go_to_the_first(spark):
    board = spark.createDataFrame([(7, 1, "ab", 2.0), (3, 1, "lidl", 2.0), (1, 1, "ab", None)],
                                  "id bigint, product_id bigint, retailer string, price_piece double")
    assert prices.cheapest_listing(board).first().listing_id == 3


def test_promo_prices(spark):
    def item(price, *rules):
        return ('{"data":{"products":{"items":[{"sku":"5202535179175","name":"X","cost_per_unit":"12.771428571429",'
                '"price_range":{"minimum_price":{"final_price":{"value":%s}}},"catalog_rules":[%s]}]}}}'
                % (price, ",".join('{"action_name":"%s","actions":{"amount":"%s"},"tags":["%s"]}' % r for r in rules)))

    rows = [("a", item(4.47, ("percent", 25, "F"))), ("b", item(5, ("fixed", 1, "F"), ("fixed", 2, "aDiscount:x"))),
            ("c", item(5, ("fixed", 9, "F"))), ("d", '{"errors":[{"message":"boom"}]}'), ("e", "{broken")]
    made = payloads.flatten_catalog_galaxias(spark.createDataFrame(rows, "url string, payload string"))
    assert [r.price_piece for r in made.orderBy(F.desc("price_unit")).collect()] == [4.0, 3.35, 0.0]
    assert made.filter("price_piece = 3.35").first().price_unit == 9.57
    lost = payloads.rejected(spark.createDataFrame(rows, "url string, payload string"), "galaxias")
    assert dict((r.url, r.reason) for r in lost.collect()) == {"d": "boom", "e": "no_item_list"}


def test_values_of_another_type_are_not_read(spark):
    body = ('{"payload":{"products":[{"sku":"1","name":"Α  Β","slug":"s-1","finalPrice":148,"barcodes":["520"]},'
            '{"sku":2,"name":"x","slug":"y"},7,{"name":"no sku"}]}}')
    made = payloads.flatten_catalog_kritikos(spark.createDataFrame([("u", body)], "url string, payload string"))
    (row,) = made.collect()
    assert (row.sku, row.title, row.price_piece, row.ean) == ("1", "Α Β", 1.48, "520")


def test_product_pages(spark):
    lidl = ('<script type="application/ld+json">{"@type":"Product","sku":"11145712","gtin13":["4056489893011"],'
            '"name":"Λαζάνια","offers":[{"price":1.79}]}</script><br>1 Kg = 3,58€<br>')
    page = spark.createDataFrame([("u", lidl)], "url string, html string")
    row = pages.extract_page_lidl(page).first()
    assert (row.title, row.sku, row.price_piece, row.price_unit, row.unit_label, row.ean) == (
        "Λαζάνια", "11145712", 1.79, 3.58, "κιλό", "4056489893011")
    shop = ('<h1>X 350g</h1><s>4,10 €/τεμ.</s><b>3,49 €<span>/τεμ.</span></b><i>8,97 €<span>/κιλό</span></i>'
            "<p>Κωδικός: <strong>1599382</strong></p>")
    row = pages.extract_page_sklavenitis(spark.createDataFrame([("u", shop)], "url string, html string")).first()
    assert (row.title, row.sku, row.price_piece, row.price_unit, row.unit_label) == ("X 350g", "1599382", 3.49, 8.97, "κιλό")


def test_unit_price_check(spark):
    rows = [(1, 3.14, 8.97, "κιλό"), (2, 3.14, 15.0, "κιλό"), (3, None, 8.97, "κιλό"), (4, 3.14, 8.97, "τεμ."),
            (5, 3.14, 0.0, "κιλό")]
    frame = spark.createDataFrame(rows, "listing_id bigint, price_piece double, price_unit double, unit_label string")
    made = quality.unit_price_sanity(frame.withColumns({"product_title": F.lit("G 350g"), "retailer": F.lit("ab")}))
    assert [r.diverges for r in made.orderBy("listing_id").collect()] == [False, True, False, False, True]
    warned = made.withColumn("w", quality.sanity_warning()).filter("listing_id = 2").first().w
    assert warned.startswith("unit price 15.00 per κιλό stated, 8.97 implied by 3.14")
    outcomes = quality.outcome_classify(made.withColumn("status", F.when(F.col("listing_id") == 1, 404).when(F.col("listing_id") > 1, 200)))
    messages = {(r.listing_id, r.code, r.severity) for r in quality.run_messages(outcomes).collect()}
    assert {(2, "unit_price", "warning"), (1, "gone", "warning")} <= messages


def test_crawl_budget(spark):
    rows = [("ab", "r1", i, i != 3, 5) for i in range(5)] + [("ab", "r2", i, i != 0, 5) for i in range(5)] + [
        ("ab", "r3", i, i == 0, 14) for i in range(14)] + [("ab", "r4", 0, True, 40)] + [("ab", "r5", 0, True, 13)] + [
        ("ab", "r6", 0, True, None), ("ab", "r7", 0, False, 1), ("ab", "r7", 0, True, 1), ("lidl", "r8", 7, True, None), ("lidl", "r9", 7, False, None)]
    frame = spark.createDataFrame(rows, "retailer string, run_id string, page_no int, ok boolean, announced int")
    got = {r.run_id: (r.pages, r.failed, r.accepted) for r in quality.crawl_completeness(frame).collect()}
    assert got == {
        "r1": (5, 1, True), "r2": (1, 1, False), "r3": (14, 13, False), "r4": (40, 39, False), "r5": (13, 12, True),
        "r6": (1, 0, True), "r7": (1, 0, True), "r8": (1, 0, True), "r9": (1, 1, False),
    }


def test_rejected_bodies(spark):
    bodies = [("list", "[]"), ("object", "{}"), ("typed", '{"type":"empty"}'), ("items", '{"items":[]}'), ("odd", '{"items":{"a":1}}'), ("text", '"x"'), ("broken", "{"), ("none", None), ("silent", '{"errors":[{}]}')]
    frame = spark.createDataFrame(bodies, "url string, payload string")
    lost = lambda chain: {r.url: r.reason for r in payloads.rejected(frame, chain).collect()}
    assert set(lost("lidl")) == {"list", "object", "odd", "text", "broken", "none", "silent"}
    assert set(lost("masoutis")) == {u for u, _ in bodies} - {"list"}
    assert lost("galaxias")["silent"] == "errors_reported" and lost("kritikos")["silent"] == "no_item_list"


def test_routes(spark):
    rows = [("https://www.ab.gr/x/p/12",), ("https://ab.gr/x",), ("https://notab.gr/x",), ("nonsense",)]
    frame = spark.createDataFrame(rows, "u string")
    assert [r[0] for r in frame.select(urls.route_url(F.col("u"))).collect()] == ["ab", "ab", None, None]


def test_expiry_chains_in_few_rounds(spark, monkeypatch):
    """A key with most lookups over thirty years, and many small ones, against a replay in order."""
    import random

    rng = random.Random(8)
    rows = [("hot", i * 3, i, rng.random() < 0.1) for i in range(3_500)]
    rows += [(f"k{rng.randrange(200)}", rng.randrange(900), 10_000 + i, rng.random() < 0.6) for i in range(2_000)]
    start = dt.datetime(2000, 1, 1)
    at = lambda days: start + dt.timedelta(days=days)
    held = {"hot": (at(-20), False), "k3": (at(100), True), "unseen": (at(1), True)}
    want, entries = set(), dict(held)
    for key, day_, seq, found in sorted(rows, key=lambda r: (r[1], r[2])):
        old = entries.get(key)
        due = old is None or (at(day_) >= old[0] + dt.timedelta(days=90 if old[1] else 14) and (found or not old[1]))
        if due:
            entries[key] = (at(day_), found)
            want.add((key, seq))
    lookups = spark.createDataFrame([(k, at(d), s, f) for k, d, s, f in rows] + [(None, at(1), 99_999, True)], "key string, ts timestamp_ntz, seq bigint, found boolean").repartition(6)
    state = spark.createDataFrame([(k, *v) for k, v in held.items()], "key string, cached_at timestamp_ntz, found boolean")
    stored, keep = [], cache.cut_lineage
    monkeypatch.setattr(cache, "cut_lineage", lambda frame: stored.append(1) or keep(frame))
    got = {(r.key, r.seq) for r in cache.cache_writes(lookups, state).collect()}
    assert got == want and len([k for k, _ in want if k == "hot"]) > 60
    assert len(stored) < 3 * 12


def test_first_known_reads_each_row_once(spark):
    from aislegraph.operators.ordering import first_known

    rows = [(k, i, i if i % 5 == k else None) for k in range(3) for i in range(40)]
    frame = spark.createDataFrame(rows, "k int, i int, v int").withColumn("v", F.col("v") + F.col("k") * 100)
    told = first_known(frame, [F.col("k"), F.col("i")], {"next": "v"})
    # A frame that is open at its end is added up once for every row of a task.
    assert "unboundedfollowing" not in told._jdf.queryExecution().toString().lower()
    values = sorted(k * 100 + v for k, _, v in rows if v is not None)
    for r in told.collect():
        at = r.k * 100 + r.i
        assert r.next == next((v for v in values if v >= at), None)


def test_pages_and_items_are_read_once(spark):
    """Filters on what was read are not merged with the reading (each was searched or parsed two to six times)."""
    tile = ('<i data-productsku="77"></i><h4 class="product__title">\n<a href="/c/x/" class="a"> <b>A &amp; B</b> <i></i></a></h4>'
            '<h4 class="product__title"><a href="/c/y-123456/">C<b></a></h4><h4 class="product__title"><a href="/c/z/">no end')
    state = '<script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"productSelected":{"sku":"<s>"}}}}</script></script>'
    shop = '<a href="https://www.mymarket.gr/x-1" rel="bookmark" title="a" data-google-analytics-item-param="{&quot;id&quot;:&quot;1&quot;,&quot;name&quot;:&quot;N&quot;}">t</a>'
    body = '{"data":{"productSearch":{"products":[{"code":"1","name":"N","price":{"value":2,"supplementaryPriceLabel1":"1.234,50 €/ κιλ"}},{"code":2,"name":"N"}]}}}'

    def made(html, name):
        return spark.range(1).select(F.col("id").cast("string").alias("url"), F.concat(F.lit(html), F.col("id")).alias(name))

    def times(frame, what):
        return frame._jdf.queryExecution().optimizedPlan().toString().count(what)

    tiles = pages.extract_tiles_sklavenitis(made(tile + tile, "html")).select("sku", "title", "pos")
    assert sorted(map(tuple, tiles.collect())) == [("123456", "C", 2), ("77", "A & B", 1)]
    assert times(tiles, "regexp_extract_all(") == 1
    found = pages.extract_page_kritikos(made(state, "html")).select("sku", "title")
    assert [tuple(r) for r in found.collect()] == [("<s>", None)] and times(found, "parseJson") == 1
    offers = pages.extract_tiles_mymarket(made(shop, "html")).select("sku", "title", "url", "price_piece")
    assert [tuple(r) for r in offers.collect()] == [("1", "N", "https://www.mymarket.gr/x-1", None)]
    assert times(offers, "regexp_extract_all(") == 1 and times(offers, "parseJson") == 1
    rows = payloads.flatten_catalog_ab(spark.range(1).select(
        F.col("id").cast("string").alias("url"), F.concat(F.lit(body), F.repeat(F.lit(" "), F.col("id").cast("int"))).alias("payload")))
    read = rows.select("sku", "price_piece", "price_unit", "unit_label", "url")
    assert [tuple(r) for r in read.collect()] == [("1", 2.0, 1234.5, "κιλό", "https://www.ab.gr/el/eshop/p/1")]
    assert times(read, "$.code, StringType") == 1


def test_patches_without_barcode_are_dealt_over_all_tasks(spark):
    products = spark.createDataFrame(
        [(1, "4", "b", "t", None, None, None), (2, None, "b", "t", None, None, None)],
        "id bigint, ean string, brand string, title string, size_value double, size_unit string, image_url string")
    sent = F.when(F.col("id") == 5, F.create_map(F.lit("ean"), F.lit("52000001"))).otherwise(F.create_map(F.lit("title"), F.lit("T")))
    patches = spark.range(200).select(F.col("id").alias("seq"), F.lit(2).cast("bigint").alias("product_id"), sent.alias("sent"))
    held = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {name: spark.conf.get(name) for name in held}
    try:
        for name, value in held.items():
            spark.conf.set(name, value)
        rows = maintenance.sparse_patch_report(products, patches).select("status", F.spark_partition_id().alias("task")).collect()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert [r.status for r in rows] == ["applied"] * 200  # seq 4 is no claim of barcode 4, which product 1 holds
    tasks = [r.task for r in rows]
    assert max(map(tasks.count, set(tasks))) < 150
