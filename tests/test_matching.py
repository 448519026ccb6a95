"""Matching on hand-written sessions, and blocking against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from cartloom.functions.text import comparable_title, with_title_similarity, with_title_parts
from cartloom.operators.enrichment import enrich_cart, enrichment_summary, store_mismatch_guard
from cartloom.operators.matching import title_hits
from cartloom.operators.sessions import title_similarity_best
from cartloom.operators.title_pairs import similarity_keys, title_elements, title_pairs

VARIANT = "struct<sku: string, url: string, image_url: string, price: bigint, currency: string, color: string, extracted_ids: array<string>>"
IDS = "product_ids array<string>, extracted_ids array<string>, skus array<string>, gtins array<string>, mpns array<string>"
CART = f"session_id bigint, item_pos int, title string, url string, image_url string, store_id string, price bigint, quantity bigint, line_total bigint, {IDS}"
PRODUCT = (
    "session_id bigint, product_pos int, title string, url string, image_url string, store_id string, brand string, description string, "
    f"category string, rating double, price bigint, currency string, color string, {IDS}, variants array<{VARIANT}>"
)


def cart(spark, *lines):
    keys = [c.split(" ")[0] for c in CART.split(", ")]
    return spark.createDataFrame([tuple(dict({"session_id": 1, "store_id": "9", "product_ids": [], "extracted_ids": []}, **x).get(k) for k in keys) for x in lines], CART)


def products(spark, *rows):
    keys = ["session_id", "product_pos", "title", "url", "image_url", "store_id", "brand", "description", "category", "rating", "price", "currency", "color", "product_ids", "extracted_ids", "skus", "gtins", "mpns", "variants"]
    return spark.createDataFrame([tuple(dict({"session_id": 1, "store_id": "9", "product_ids": [], "extracted_ids": [], "variants": []}, **x).get(k) for k in keys) for x in rows], PRODUCT)


def test_strategies_and_merge(spark):
    c = cart(
        spark,
        {"item_pos": 0, "title": "Cap - Red", "image_url": "https://i/x/ABC12_1.jpg", "price": 1000},
        {"item_pos": 1, "url": "https://S.com/b/", "price": 5},
        {"item_pos": 2, "title": "Nothing like it", "price": 1},
        {"item_pos": 3, "title": "Wool scarf long", "extracted_ids": ["777"], "price": 2050},
    )
    p = products(
        spark,
        {"product_pos": 0, "title": "Cap", "color": "red", "brand": "B", "price": 1050, "skus": ["ABC12"]},
        {"product_pos": 1, "title": "Bag", "url": "https://s.com/b", "price": 0},
        {"product_pos": 2, "title": "Wool scarf", "variants": [("777", "u", "v.png", 2000, "EUR", "blue", None)], "price": 10},
    )
    rows = {r.item_pos: r for r in enrich_cart(c, p, "low").collect()}
    assert [s.method for s in rows[0].matched_signals] == ["image_sku", "title_color", "title", "price"]
    assert rows[0].brand == "B" and rows[0].sources.brand == "product" and rows[0].skus == ["ABC12"]
    assert rows[1].match_method == "url" and rows[1].title == "Bag" and rows[1].sources.title == "product"
    assert not rows[2].was_viewed and rows[2].matched_signals == [] and rows[2].match_confidence == "none"
    assert rows[3].match_method == "extracted_id_sku" and rows[3].matched_variant.color == "blue" and rows[3].image_url == "v.png"
    assert [(s.method, s.exact) for s in rows[3].matched_signals] == [("extracted_id_sku", True), ("title", False), ("price", False)]
    summary = enrichment_summary(enrich_cart(c, p)).first()
    assert (summary.matched_items, summary.unmatched_items, summary.match_rate) == (2, 2, 50.0)


def test_store_mismatch_is_rejected(spark):
    c, p = cart(spark, {"item_pos": 0, "title": "x"}), products(spark, {"product_pos": 0, "title": "x", "store_id": "8"})
    assert store_mismatch_guard(c, p).count() == 1
    assert enrich_cart(c, p, "low").count() == 0


def test_cart_title_forms(spark):
    titles = ["Tee Navy M:- Navy, M", "Tee – Red", "A - B - C", "Plain tee"]
    rows = with_title_parts(spark.createDataFrame([(t,) for t in titles], "title string")).collect()
    assert [(r.title_base, r.title_color) for r in rows] == [("Tee", "Navy M"), ("Tee", "Red"), ("A - B", "C"), ("Plain tee", None)]


def random_titles(seed, n):
    rng = random.Random(seed)
    stems = ["red wool cap", "red wool caps", "blue cotton tee", "aaaaaaaa", "aaaaaaab", "x", "ab", "tea pot large", "teapot large", "green tea pot large set"]
    out = []
    for _ in range(n):
        t = list(rng.choice(stems))
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = rng.choice("abcdert ")
        out.append("".join(t))
    return out


SHORT = ["abcde", "abc", "axcye", "axc", "a", "b", "ab", "ba", "aab", "abb c", "c abb", "xyz", "x y z"]


@pytest.mark.parametrize(("threshold", "small"), [(t, 0) for t in (0, 0.3, 0.5, 0.55, 0.6, 0.66, 0.8, 0.95)] + [(0.3, 1000), (0.8, 1000)])
def test_titles_equal_brute_force(spark, threshold, small):
    c = cart(spark, *[{"item_pos": i, "title": t} for i, t in enumerate(random_titles(1, 40) + SHORT)])
    p = products(spark, *[{"product_pos": i, "title": t} for i, t in enumerate(random_titles(2, 40) + SHORT[1::2])])
    a = c.select("item_pos", comparable_title(F.col("title")).alias("a"))
    b = p.select("product_pos", comparable_title(F.col("title")).alias("b"))
    best = (
        with_title_similarity(a.crossJoin(b), "a", "b").where(f"score >= {threshold}").groupBy("a").agg(F.min(F.struct((-F.col("score")).alias("s"), "product_pos")).alias("m"))
    )
    want = {(r.a, r.m.product_pos) for r in best.collect()}
    assert {(r.key, r.hit.product_pos) for r in title_hits(c, p, threshold, small_session=small).collect()} == want


def test_titles_that_share_a_brand_dont_all_meet(spark):
    rng = random.Random(5)
    title = lambda: "zephyrion " + " ".join("".join(rng.choice("abcdefghijklmnopqrstuvw") for _ in range(7)) for _ in range(3))
    c, p = ([(1, title(), i) for i in range(400)] for _ in range(2))
    carts, names = spark.createDataFrame(c, "session_id long, title string, n int").drop("n"), spark.createDataFrame(p, "session_id long, title string, product_pos int")
    # what meets by chance are rare character pairs, not the brand
    assert title_pairs(carts, names, similarity_keys(0.8), title_elements).count() < 60_000


def test_blocked_containment_equals_direct(spark):
    views = spark.createDataFrame(
        [(1, f"{i:03d}", "9", "S", t, f"https://s.com/{i}", None, None, "5.00") for i, t in enumerate(random_titles(3, 50))],
        "session_id bigint, view_pos string, store_id string, store_name string, name string, url string, color_list array<string>, sku_list array<string>, amount string",
    )
    items = spark.createDataFrame(
        [(1, f"{i:03d}", 0, None, "9", "S", t, None, None, 500, 1, 500) for i, t in enumerate(random_titles(4, 50))],
        "session_id bigint, item_pos string, cart_pos bigint, cart_ts string, store_id string, store_name string, name string, url string, image_url string, item_price bigint, quantity bigint, line_total bigint",
    )

    def result(small):
        return {(r.item_pos, round(r.similarity, 9)) for r in title_similarity_best(views, items, small).collect()}

    assert result(0) == result(1000)
