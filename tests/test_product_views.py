import json

import pytest
from pyspark.sql import functions as F

from cartloom.operators.product_ids import nested_ids
from cartloom.operators.product_views import normalize_product_views
from cartloom.sources import registry as reg
from cartloom.sources.events import parse_product_views
from cartloom.streaming.jobs import stream_normalize_views

URLS = [
    "https://www.target.com/p/x/-/A-10000001", "http://shop.example.com/product/prod-100000?utm_source=a", "https://oldnavy.gap.com/browse/product.do?pid=1000001",
    "not a url", "www.example.co.uk/a/100000.html", "https://münchen.example/p-1234567", "https://example.com/item?sku=10000&ref=z", "https://x.example:99999/p-123456", "",
]


def events():
    out = []
    for i, url in enumerate(URLS):
        other = URLS[(i + 3) % len(URLS)]
        out.append({"store_id": ["5246", 9999, None][i % 3], "name": ["A", "B"], "url": url, "urlToSku": {url: ["S1", "S2"], other: "S3"}})
        out.append({"name": "C", "url": [url, other, url], "sku": ["1", "2", "3"], "price": [1, "2.5", {"amount": "3", "currency": "EUR"}]})
        out.append({"name": "D", "offers": [{"sku": "o1", "url": other, "price": 3.5}, {"sku": "o1", "url": url}, {"sku": "o2"}]})
    out += [{}, {"name": None, "urlToSku": {}}, {"store_id": "", "sku": []}]
    return [(i, json.dumps(e)) for i, e in enumerate(out)] + [(900, None), (901, "{broken"), (902, "")]


def parsed(spark):
    return parse_product_views(spark.createDataFrame(events(), "event_id long, raw string"), "raw")


def shape(df):
    return sorted((r.event_id, [(v.sku, v.url, v.extracted_ids) for v in r.variants], r.extracted_ids) for r in df.collect())


def test_ids_within_the_row_equal_the_joined_ones(spark, monkeypatch):
    registry = reg.builtin_registry(spark)
    inside = normalize_product_views(parsed(spark), registry)
    assert "Exchange hashpartitioning(event_id" not in inside._jdf.queryExecution().executedPlan().toString()
    found = shape(inside)
    assert sum(bool(v[2]) for r in found for v in r[1]) > 20
    monkeypatch.setattr(reg, "MOST_ENTRIES", 3)
    joined = normalize_product_views(parsed(spark), registry)
    assert "Exchange hashpartitioning(event_id" in joined._jdf.queryExecution().executedPlan().toString()
    assert shape(joined) == found


def test_a_stream_gives_the_batch_result(spark, tmp_path, monkeypatch):
    registry = reg.builtin_registry(spark)
    rows = spark.createDataFrame(events(), "event_id long, raw string").repartition(3)
    rows.write.parquet(f"{tmp_path}/in")
    source = lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = stream_normalize_views(source(), registry)
    out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert shape(spark.read.schema(out.schema).parquet(f"{tmp_path}/out")) == shape(normalize_product_views(parsed(spark), registry))
    monkeypatch.setattr(reg, "MOST_ENTRIES", 3)
    with pytest.raises(ValueError, match="registry"):
        stream_normalize_views(source(), registry)


def test_lists_keep_their_order_and_empty_ones(spark):
    rows = spark.createDataFrame([(1, [URLS[0], None, URLS[3], URLS[0]], None), (2, [], "x"), (3, None, None)], "i int, urls array<string>, store string")
    found = rows.select("i", nested_ids(F.col("urls"), F.col("store"), reg.builtin_registry(spark)).alias("ids")).collect()
    assert {r.i: r.ids for r in found} == {1: [["10000001"], [], [], ["10000001"]], 2: [], 3: None}
    assert rows.limit(0).select(nested_ids(F.col("urls"), F.col("store"), reg.builtin_registry(spark))).collect() == []
