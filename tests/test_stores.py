from datetime import date

import pytest
from pyspark.sql import functions as F

from aislegraph.operators import maintenance
from aislegraph.sources.stores import CatalogStore, PriceStore

HISTORY = "listing_id bigint, scraped_date date, seq bigint, price_piece double"


def prices(spark, rows):
    return spark.createDataFrame([(i, date(2024, m, d), s, float(p)) for i, m, d, s, p in rows], HISTORY)


def as_prices(frame):
    return sorted((r.listing_id, r.scraped_date, r.seq, r.price_piece) for r in frame.collect())


def test_price_store_appends_and_folds(spark, tmp_path):
    store = PriceStore(spark, str(tmp_path / "prices"))
    assert store.read() is None and store.compact().number == 0
    batches = [
        [(1, 1, 1, 5, 2.0), (1, 1, 1, 4, 1.0), (2, 2, 1, 6, 3.0)],
        [(1, 1, 1, 7, 9.0), (3, 1, 2, 8, 1.5)],
        [(2, 2, 1, 1, 0.5), (4, 3, 3, 9, 4.0)],
    ]
    every = prices(spark, [r for b in batches for r in b])
    want = as_prices(maintenance.upsert_daily_price(every.limit(0), every))
    store.append(prices(spark, batches[0]), 0)
    first = store.log.latest()
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "prices").rglob("*.parquet")}
    store.append(prices(spark, batches[1]), 1)
    store.append(prices(spark, batches[1]), 1)  # a replay
    assert all(p.stat().st_mtime_ns == t for p, t in files.items())  # a batch writes its own rows only
    store.compact()
    store.append(prices(spark, batches[0]), 0)  # a replay of a folded batch
    store.append(prices(spark, batches[2]), 2)
    assert as_prices(store.read()) == want
    store.compact()
    assert as_prices(store.read()) == want and len(store.log.latest().parts) == 2
    assert as_prices(store.read(first)) == as_prices(maintenance.upsert_daily_price(every.limit(0), prices(spark, batches[0])))


def test_price_store_survives_a_stop_within_compaction(spark, tmp_path):
    store = PriceStore(spark, str(tmp_path / "prices"))
    store.append(prices(spark, [(1, 1, 1, 1, 1.0)]), 0)
    store.append(prices(spark, [(2, 1, 1, 2, 2.0)]), 1)
    before = as_prices(store.read())
    store.folded(store.log.latest())  # the new base is there, its manifest is not
    assert as_prices(store.read()) == before
    late = PriceStore(spark, str(tmp_path / "prices"))
    fold = store.folded

    def fold_and_append(manifest):
        folder = fold(manifest)
        late.append(prices(spark, [(3, 1, 1, 3, 3.0), (1, 1, 1, 4, 4.0)]), 2)
        return folder

    store.folded = fold_and_append
    store.compact()
    assert [r[0] for r in as_prices(store.read())] == [1, 2, 3] and as_prices(store.read())[0][3] == 4.0


def test_catalog_versions_swap_at_once(spark, tmp_path):
    store = CatalogStore(spark, str(tmp_path / "catalog"))
    schema = "retailer string, sku string, price_piece double"
    old = spark.createDataFrame([("ab", "1", 1.0), ("ab", "2", 2.0), ("lidl", "1", 3.0), (None, "n", 0.0), ("007", "x", 1.0)], schema)
    assert store.read() is None
    first = store.replace(old)
    as_set = lambda frame: {tuple(r) for r in frame.select("retailer", "sku", "price_piece").collect()}
    assert as_set(store.read()) == as_set(old)
    assert store.replace(old.limit(0)).number == first.number
    boom = F.udf(lambda sku: 1.0 if sku == "1" else 1 / 0, "double")
    with pytest.raises(Exception):
        store.replace(old.withColumn("price_piece", boom("sku")))
    assert as_set(store.read()) == as_set(old)
    held = store.read()
    store.replace(spark.createDataFrame([("ab", "9", 9.0)], schema))
    assert as_set(store.read()) == {("ab", "9", 9.0), ("lidl", "1", 3.0), (None, "n", 0.0), ("007", "x", 1.0)}
    assert as_set(held) == as_set(old)  # a reader of the version before
    stale = store.log.commit(first, {"ab": "elsewhere"})
    assert stale is None and as_set(store.read(first)) == as_set(old)
