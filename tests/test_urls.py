import pytest
from pyspark.sql import functions as F

from cartloom.functions.urls import domain_of, with_url_components
from cartloom.operators.product_ids import url_analysis
from cartloom.sources.registry import builtin_registry, dim_store_by_id
from cartloom.sources.store_rules import STORES

NORMALIZED = [
    ("https://www.lamps.test.com/desk?color=red#top", "https://lamps.test.com/desk?color=red", "test.com"),
    ("http://www.lamps.com:443/Desk/?utm_campaign=may&size=4#x", "https://lamps.com/Desk?size=4", "lamps.com"),
    ("https://lamps.com//desk////tall", "https://lamps.com/desk/tall", "lamps.com"),
    ("https://lamps.com/tall%20oak", "https://lamps.com/tall%20oak", "lamps.com"),
    ("https://lamps.com/tall oak|dark", "https://lamps.com/tall%20oak|dark", "lamps.com"),
    ("https://lamps.com/new/../sale/./desk/", "https://lamps.com/sale/desk", "lamps.com"),
    ("https://lamps.com/l?w=9&h=7&d=8&gclid=k", "https://lamps.com/l?d=8&h=7&w=9", "lamps.com"),
    ("www.cups.lamps.co.uk/q", "https://cups.lamps.co.uk/q", "lamps.co.uk"),
    ("https://www.m.athleta.gap.com/q", "https://m.athleta.gap.com/q", "athleta.gap.com"),
    ("https://www.grün.de/wald", "https://xn--grn-ioa.de/wald", "xn--grn-ioa.de"),
    ("https://198.51.100.7:8443/q", "https://198.51.100.7/q", "198.51.100.7"),
    ("https://alpha.com.gr/l/1", "https://alpha.com.gr/l/1", "alpha.com.gr"),
    ("https://www.m.beta.co.hu/l/1", "https://m.beta.co.hu/l/1", "beta.co.hu"),
]
IDS = [
    ("https://lamps.com/product/p700800900", ["700800900", "p700800900"]),
    ("https://lamps.com/product/p70080", []),
    ("https://lamps.com/oak/700800.html", ["700800"]),
    ("https://lamps.com/700800", []),
    ("https://lamps.com/PRD-700800900/prod44556677", ["44556677", "700800900", "prd-700800900", "prod44556677"]),
    ("https://www.target.com/p/lamp/-/A-55667788?sku=oak7", ["55667788", "oak7"]),
    ("https://www.samsclub.com/p/lamp/P7008009", ["7008009"]),
    ("https://www.ikea.com/se/p/lampa-s70123", ["70123"]),
    ("https://www.love-scent.com/p-77.html", ["sku-77"]),
    ("https://lamps.com/l?id=" + "&id=".join(f"{7000 + i}" for i in range(20)), [f"{7000 + i}" for i in range(12)]),
]


def test_registry_sizes():
    assert len(STORES) == 97
    assert sum(s[0] is None for s in STORES) == 4
    assert sum(len(s[2]) for s in STORES) == 101 and sum(len(s[3]) for s in STORES) == 7
    assert sum(len(s[4].get("aliases", [])) for s in STORES) == 20


def test_components(spark):
    df = spark.createDataFrame([(i, u) for i, (u, _, _) in enumerate(NORMALIZED)], "i int, url string")
    got = [(r.href, r.domain) for r in with_url_components(df).orderBy("i").collect()]
    assert got == [(h, d) for _, h, d in NORMALIZED]


@pytest.mark.parametrize("url", ["", "lamps", "gopher://lamps.com/q", "data:text/plain,q", "https://300.2.2.2/", "https://lamps.com:70001/"])
def test_invalid_urls_fail(spark, url):
    row = with_url_components(spark.createDataFrame([(url,)], "url string")).first()
    assert row.error == "InvalidUrlError" and row.href is None


def test_product_ids(spark):
    df = spark.createDataFrame([(i, u, None) for i, (u, _) in enumerate(IDS)], "i int, url string, store_id string")
    rows = url_analysis(df, builtin_registry(spark)).orderBy("i").collect()
    assert [r.product_ids for r in rows] == [ids for _, ids in IDS]


def test_unknown_store_id_turns_off_domain_rules_and_long_ids_fail(spark):
    rows = [("https://www.target.com/p/A-55667788/lamp", "nobody"), ("https://coachoutlet.com/lamp?pid=" + "k" * 26, None)]
    unknown, long_id = url_analysis(spark.createDataFrame(rows, "url string, store_id string"), builtin_registry(spark)).orderBy(F.desc("url")).collect()
    assert unknown.store_id is None and unknown.product_ids == []
    assert long_id.error == "ZodError" and not long_id.success


def test_last_entry_of_a_repeated_id_wins(spark):
    row = dim_store_by_id(builtin_registry(spark)).where("store_id = '16829'").first()
    assert row.primary_domain == "costco.com"


def test_suffix_rules(spark):
    hosts = {"a.b.shop.ck": "b.shop.ck", "www.ck": "www.ck", "x.y.free.host.net": "y.free.host.net", "free.host.net": "free.host.net", "one.com.gr": "one.com.gr", "shop.ck": "shop.ck"}
    rules = ["*.ck", "!www.ck", "free.host.net"]
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    assert {r.host: r.d for r in df.select("host", domain_of(F.col("host"), rules).alias("d")).collect()} == hosts


def test_shops_of_unlisted_countries_keep_their_own_keys(spark):
    df = spark.createDataFrame([("https://alpha.com.gr/l/1",), ("https://beta.com.gr/l/1",), ("https://beta.com.kw/l/1",)], "url string")
    assert len({r.key for r in with_url_components(df).collect()}) == 3
