"""Reports over shopping sessions: what was viewed, what is in the cart, and how well both can be matched.

Inputs: ``views`` with ``session_id, view_pos, store_id, store_name, name, url, color_list, sku_list, amount`` and ``items``
with one row per line of every cart event: ``session_id, item_pos, cart_pos, cart_ts, store_id, store_name, name, url,
image_url, item_price, quantity, line_total``. Value sets of a session are kept as rows, never as one array per session, and
all lookups are joins on (session, kind, key), so a session that holds a large part of the data spreads over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartloom.functions.text import (
    comparable_url,
    image_sku_ids,
    js_trim,
    parse_integer,
    parse_number,
    simple_title_similarity,
    with_title_parts,
)
from cartloom.functions.urls import with_url_parts
from cartloom.operators.title_pairs import SMALL_SESSION_TITLES, busy_sessions, containment_elements, containment_keys, title_pairs
from cartloom.operators.url_mining import analyze_url_shape, bare_domain, non_product_filter, shape_ids
from cartloom.sources.registry import dim_store_by_domain, dim_store_by_id

# Predicted strategies in evaluation order with their confidence, score weights and bands.
PREDICTIONS = [
    ("image_sku", "high"),
    ("extracted_id_sku", "high"),
    ("url", "medium"),
    ("extracted_id", "medium"),
    ("title_color", "medium"),
    ("title", "low"),
]
CONFIDENCE_POINTS = {"high": 100.0, "medium": 70.0, "low": 40.0}
SCORE_WEIGHTS = {"data_quality": 0.1, "id_extraction": 0.25, "id_overlap": 0.25, "match_confidence": 0.4}
KNOWN_ID_PARAMS = ["id", "productid", "sku", "pid", "product_id"]
_SEP = "\x01"


def _has(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) != ""


def final_cart_lines(items: DataFrame) -> DataFrame:
    """Lines of the last cart event of each session in arrival order."""
    last = items.groupBy("session_id").agg(F.max("cart_pos").alias("cart_pos"))
    return items.join(last, ["session_id", "cart_pos"], "left_semi")


def session_store_values(views: DataFrame, items: DataFrame) -> DataFrame:
    """Distinct store ids, store names and domains of a session with the place where each was first seen."""
    hosts = with_url_parts(views.select("session_id", "view_pos", "url")).where(F.col("u_error").isNull()).select(
        "session_id", F.struct(F.lit(0).alias("src"), F.col("view_pos").alias("pos")).alias("at"), bare_domain(F.col("u_host")).alias("value")
    )

    def named(df: DataFrame, src: int, pos: Column, field: str, column: str) -> DataFrame:
        return df.select(
            "session_id", F.struct(F.lit(src).alias("src"), pos.alias("pos")).alias("at"), F.lit(field).alias("field"), F.col(column).alias("value")
        )

    cart_at = F.concat(F.lpad(F.col("cart_pos").cast("string"), 12, "0"), F.lit("-"), "item_pos")
    rows = (
        named(views, 0, F.col("view_pos"), "store_id", "store_id")
        .unionByName(named(views.where(_has("store_name")), 0, F.col("view_pos"), "store_name", "store_name"))
        .unionByName(hosts.withColumn("field", F.lit("domain")))
        .unionByName(named(items, 1, cart_at, "store_id", "store_id"))
        .unionByName(named(items.where(_has("store_name")), 1, cart_at, "store_name", "store_name"))
    )
    return rows.where(F.col("value").isNotNull()).groupBy("session_id", "field", "value").agg(F.min("at").alias("first_at"))


def session_store_metadata(views: DataFrame, items: DataFrame) -> DataFrame:
    """First store id, name and domain of a session, how many of each it has, and whether they agree."""
    values = session_store_values(views, items)
    fields = ["store_id", "store_name", "domain"]
    agg = values.groupBy("session_id").agg(
        *[F.min(F.when(F.col("field") == f, F.struct("first_at", "value")))["value"].alias(f) for f in fields],
        *[F.count_if(F.col("field") == f).alias(f"{f}_count") for f in fields],
    )
    return agg.select(
        "session_id",
        *[F.coalesce(f, F.lit("")).alias(f) for f in fields],
        *[f"{f}_count" for f in fields],
        F.expr(" and ".join(f"{f}_count <= 1" for f in fields)).alias("is_consistent"),
    )


def unique_product_values(views: DataFrame) -> DataFrame:
    """Distinct colours, SKUs and URL ids of each product (session, lower-cased URL) as rows."""
    with_ids = shape_ids(views.where(F.col("url").isNotNull()), "url", "url_ids")
    groups = F.array(
        F.struct(F.lit("color").alias("kind"), F.col("color_list").alias("vals")),
        F.struct(F.lit("sku").alias("kind"), F.col("sku_list").alias("vals")),
        F.struct(F.lit("url_id").alias("kind"), F.col("url_ids").alias("vals")),
    )
    return (
        with_ids.select("session_id", F.lower("url").alias("url_key"), F.explode(groups).alias("g"))
        .select("session_id", "url_key", "g.kind", F.explode("g.vals").alias("value"))
        .distinct()
    )


def product_views_by_url(views: DataFrame) -> DataFrame:
    """Products of a session by lower-cased URL: first place, first name and URL, views, price range."""
    return (
        views.where(F.col("url").isNotNull())
        .groupBy("session_id", F.lower("url").alias("url_key"))
        .agg(
            F.min("view_pos").alias("first_pos"),
            F.min_by("name", "view_pos").alias("name"),
            F.min_by("url", "view_pos").alias("url"),
            F.count(F.lit(1)).alias("view_count"),
            F.min(parse_number(F.col("amount"))).alias("price_min"),
            F.max(parse_number(F.col("amount"))).alias("price_max"),
        )
    )


def unique_products(views: DataFrame) -> DataFrame:
    """The products of a session with their number of colours, SKUs and URL ids."""
    base = product_views_by_url(views)
    sizes = unique_product_values(views).groupBy("session_id", "url_key").agg(
        F.count_if(F.col("kind") == "color").alias("colors"),
        F.count_if(F.col("kind") == "sku").alias("skus"),
        F.count_if(F.col("kind") == "url_id").alias("extracted_ids"),
    )
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("colors", "skus", "extracted_ids")}
    return base.join(sizes, ["session_id", "url_key"], "left").withColumns(zero)


def cart_evolution(items: DataFrame) -> DataFrame:
    """Cart snapshots of a session in time order (a missing time counts as 0), sorted by range so that long sessions split."""
    ts = F.coalesce(parse_integer(F.col("cart_ts")), F.lit(0))
    return (
        items.groupBy("session_id", "cart_pos")
        .agg(
            F.min(ts).alias("ts"),
            F.coalesce(F.min("cart_ts"), F.lit("unknown")).alias("timestamp"),
            F.count(F.lit(1)).alias("item_count"),
            F.sum("line_total").alias("cart_total"),
        )
        .orderBy("session_id", "ts", "cart_pos")
    )


def final_cart(items: DataFrame) -> DataFrame:
    """Last snapshot by time and last event by arrival; the two can differ."""
    shot = F.struct("cart_pos", "item_count", "cart_total")
    return (
        cart_evolution(items)
        .groupBy("session_id")
        .agg(F.max_by(shot, F.struct("ts", "cart_pos")).alias("t"), F.max_by(shot, "cart_pos").alias("a"))
        .select(
            "session_id",
            F.col("t.cart_pos").alias("latest_cart_pos"),
            F.col("t.item_count").alias("latest_item_count"),
            F.col("t.cart_total").alias("latest_cart_total"),
            F.col("a.cart_pos").alias("arrived_cart_pos"),
            F.col("a.item_count").alias("arrived_item_count"),
            F.col("a.cart_total").alias("arrived_cart_total"),
        )
    )


ISSUES = ["missing_url", "no_skus", "malformed_url", "cart_line_without_url"]


def session_data_quality(views: DataFrame, items: DataFrame) -> DataFrame:
    """Number of views without URL, without SKUs, with unparsable URL, and of cart lines without URL, per session."""
    checked = with_url_parts(views).groupBy("session_id").agg(
        F.count_if(~_has("url")).alias("missing_url"),
        F.count_if(F.coalesce(F.size("sku_list"), F.lit(0)) <= 0).alias("no_skus"),
        F.count_if((F.col("u_error").isNotNull()) & (F.coalesce("u_scheme", F.lit("")).isin("", "http", "https"))).alias("malformed_url"),
    )
    lines = items.groupBy("session_id").agg(F.count_if(~_has("url")).alias("cart_line_without_url"))
    joined = checked.join(lines, "session_id", "full")
    return joined.select("session_id", *[F.coalesce(i, F.lit(0)).alias(i) for i in ISSUES])


def data_quality_issues(quality: DataFrame) -> DataFrame:
    """The same in long form, only what occurs."""
    return quality.unpivot("session_id", ISSUES, "issue", "rows").where(F.col("rows") > 0)


# --- keys shared by the match reports -------------------------------------------------------------------------------


def _line_keys(lines: DataFrame) -> DataFrame:
    """``session_id, item_pos, strategy, kind, key`` of the final cart lines for the predictable strategies."""
    base = with_title_parts(shape_ids(lines, "url", "url_ids"), "name").select(
        "session_id",
        "item_pos",
        image_sku_ids(F.col("image_url")).alias("image_skus"),
        "url_ids",
        F.array(comparable_url(F.col("url"))).alias("urls"),
        F.array(F.concat(F.lower("title_base"), F.lit(_SEP), F.lower("title_color"))).alias("title_colors"),
        F.array(F.lower("name")).alias("names"),
        F.array(F.lower("url")).alias("raw_urls"),
    )
    wanted = [
        ("image_sku", "sku", "image_skus"),
        ("extracted_id_sku", "sku", "url_ids"),
        ("url", "url", "urls"),
        ("extracted_id", "url_id", "url_ids"),
        ("image_id", "url_id", "image_skus"),
        ("title_color", "title_color", "title_colors"),
        ("same_name", "name", "names"),
        ("same_url", "raw_url", "raw_urls"),
    ]
    groups = F.array(
        *[F.struct(F.lit(s).alias("strategy"), F.lit(k).alias("kind"), F.col(v).alias("vals")) for s, k, v in wanted]
    )
    return (
        base.select("session_id", "item_pos", F.explode(groups).alias("g"))
        .select("session_id", "item_pos", "g.strategy", "g.kind", F.explode("g.vals").alias("key"))
        .where(F.col("key").isNotNull())
    )


def _product_keys(views: DataFrame) -> DataFrame:
    """``session_id, kind, key, first_pos``: first product of the session per key."""
    products = product_views_by_url(views)
    values = unique_product_values(views).join(products.select("session_id", "url_key", "first_pos", "name"), ["session_id", "url_key"])
    own = products.select(
        "session_id",
        "first_pos",
        F.explode(
            F.array(
                F.struct(F.lit("url").alias("kind"), comparable_url(F.col("url")).alias("key")),
                F.struct(F.lit("raw_url").alias("kind"), F.col("url_key").alias("key")),
                F.struct(F.lit("name").alias("kind"), F.lower("name").alias("key")),
            )
        ).alias("k"),
    ).select("session_id", "first_pos", "k.*")
    listed = values.where(F.col("kind") != "color").select("session_id", "first_pos", "kind", F.col("value").alias("key"))
    colored = values.where(F.col("kind") == "color").select(
        "session_id", "first_pos", F.lit("title_color").alias("kind"), F.concat(F.lower("name"), F.lit(_SEP), F.lower("value")).alias("key")
    )
    rows = own.unionByName(listed).unionByName(colored).where(F.col("key").isNotNull())
    return rows.groupBy("session_id", "kind", "key").agg(F.min("first_pos").alias("first_pos"))


def _key_hits(lines: DataFrame, views: DataFrame) -> DataFrame:
    return _line_keys(lines).join(_product_keys(views), ["session_id", "kind", "key"])


def _title_hits(lines: DataFrame, views: DataFrame, small_session: int = SMALL_SESSION_TITLES) -> DataFrame:
    """First product whose name contains, or is contained in, the name of the cart line."""
    carts = lines.where(F.col("name").isNotNull()).select("session_id", F.lower("name").alias("title")).distinct()
    names = (
        product_views_by_url(views).where(F.col("name").isNotNull())
        .groupBy("session_id", F.lower("name").alias("title"))
        .agg(F.min("first_pos").alias("product_pos"))
    )
    pairs = title_pairs(carts, names, containment_keys(), containment_elements, small_session, busy_sessions(views, small_session))
    hit = pairs.where(F.contains("c_title", "p_title") | F.contains("p_title", "c_title"))
    best = hit.groupBy("session_id", "c_title").agg(F.min("p_product_pos").alias("first_pos"))
    keyed = lines.select("session_id", "item_pos", F.lower("name").alias("c_title"))
    return keyed.join(best, ["session_id", "c_title"]).select("session_id", "item_pos", F.lit("title").alias("strategy"), "first_pos")


def _price_hits(lines: DataFrame, views: DataFrame) -> DataFrame:
    """Cart lines whose price lies between 0.9 times the lowest and 1.1 times the highest price of some product.

    Products are intervals on a logarithmic grid of 10 % steps. Every grid cell keeps four numbers per session: whether
    some interval covers it whole, the lowest start of intervals leaving through its top, the highest end of intervals
    entering through its bottom, so a line needs one row of its cell instead of all products of its session.
    """
    step = 1.1
    cents = F.col("item_price") / 100.0
    cell = F.floor(F.log(step, cents)).cast("long")
    probes = lines.where(cents > 0).select("session_id", "item_pos", cents.alias("x"), cell.alias("cell"))
    spans = product_views_by_url(views).where(F.col("price_max") > 0).select(
        "session_id",
        (F.greatest("price_min", F.lit(0.0001)) * 0.9).alias("lo"),
        (F.col("price_max") * 1.1).alias("hi"),
    )
    first, last = (F.floor(F.log(step, F.col(c))).cast("long") for c in ("lo", "hi"))
    cells = (
        spans.select("session_id", "lo", "hi", first.alias("a"), last.alias("b"))
        .select("session_id", "lo", "hi", "a", "b", F.explode(F.sequence("a", "b")).alias("cell"))
        .groupBy("session_id", "cell")
        .agg(
            F.max((F.col("cell") > F.col("a")) & (F.col("cell") < F.col("b"))).alias("whole"),
            F.min(F.when((F.col("cell") == F.col("a")) & (F.col("a") < F.col("b")), F.col("lo"))).alias("start"),
            F.max(F.when((F.col("cell") == F.col("b")) & (F.col("a") < F.col("b")), F.col("hi"))).alias("end"),
        )
    )
    inside = [F.col("whole"), F.col("x") >= F.col("start"), F.col("x") <= F.col("end")]
    no = F.lit(False)
    hits = probes.join(cells, ["session_id", "cell"]).where(
        F.coalesce(inside[0], no) | F.coalesce(inside[1], no) | F.coalesce(inside[2], no)
    )
    free = product_views_by_url(views).where(F.col("price_min") * 0.9 <= 0).select("session_id").distinct()
    zero = lines.where(F.col("item_price") == 0).join(free, "session_id", "left_semi")
    return hits.select("session_id", "item_pos").unionByName(zero.select("session_id", "item_pos"))


def match_potential(views: DataFrame, items: DataFrame) -> DataFrame:
    """Share of the final cart whose name, URL or URL id occurs among the viewed products."""
    lines = final_cart_lines(items)
    hits = _key_hits(lines, views).where(F.col("strategy").isin("same_name", "same_url", "extracted_id"))
    found = hits.select("session_id", "item_pos").distinct().withColumn("hit", F.lit(True))
    return (
        lines.join(found, ["session_id", "item_pos"], "left")
        .groupBy("session_id")
        .agg(F.count("hit").alias("lines_with_views"), (F.count(F.lit(1)) - F.count("hit")).alias("lines_without_views"))
        .withColumn("match_rate", F.col("lines_with_views") * 100.0 / (F.col("lines_with_views") + F.col("lines_without_views")))
    )


def predict_match_strategy(views: DataFrame, items: DataFrame) -> DataFrame:
    """Predicted strategy of every final cart line: the first strategy that hits the first product that is hit.

    ``alternatives`` lists the other strategies that hit some product, in evaluation order; price only ever supports.
    """
    lines = final_cart_lines(items)
    names = [p for p, _ in PREDICTIONS]
    keys = _key_hits(lines, views).where(F.col("strategy").isin(names)).select("session_id", "item_pos", "strategy", "first_pos")
    price = _price_hits(lines, views).select(
        "session_id", "item_pos", F.lit("price").alias("strategy"), F.lit(None).cast("string").alias("first_pos")
    )
    hits = keys.unionByName(_title_hits(lines, views)).unionByName(price)
    order = F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, i)])
    best = hits.groupBy("session_id", "item_pos").agg(
        F.min(F.when(F.col("first_pos").isNotNull(), F.struct("first_pos", order[F.col("strategy")].alias("o"), "strategy")))["strategy"].alias("predicted"),
        *[F.max(F.col("strategy") == n).alias(n) for n in [*names, "price"]],
    )
    confidence = F.create_map(*[F.lit(x) for kv in PREDICTIONS for x in kv])
    all_hit = F.filter(
        F.array(*[F.when(F.col(n), F.lit(n)) for n in [*names, "price"]]),
        lambda s: s.isNotNull() & ~s.eqNullSafe(F.col("predicted")),
    )
    return (
        lines.select("session_id", "item_pos", "name")
        .join(best, ["session_id", "item_pos"], "left")
        .select(
            "session_id",
            "item_pos",
            "name",
            "predicted",
            F.coalesce(F.try_element_at(confidence, F.coalesce("predicted", F.lit(""))), F.lit("low")).alias("confidence"),
            F.col("predicted").isNotNull().alias("has_view"),
            all_hit.alias("alternatives"),
            F.when(F.col("predicted").isNull(), F.lit("no viewed product matches"))
            .otherwise(F.concat(F.lit("Matches a viewed product by "), "predicted"))
            .alias("rationale"),
        )
    )


def strategy_distribution(predictions: DataFrame) -> DataFrame:
    """Count and share by predicted strategy and by confidence, most frequent first."""
    rows = predictions.select(
        F.explode(
            F.array(
                F.struct(F.lit("strategy").alias("dimension"), F.col("predicted").alias("value")),
                F.struct(F.lit("confidence").alias("dimension"), F.col("confidence").alias("value")),
            )
        ).alias("r")
    ).select("r.*")
    counted = rows.groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("items"))
    totals = counted.groupBy("dimension").agg(F.sum("items").alias("total"))
    return (
        counted.join(totals, "dimension")
        .where(F.col("value").isNotNull())
        .select("dimension", "value", "items", (F.col("items") * 100.0 / F.col("total")).alias("percent"))
        .orderBy(F.desc("items"), "dimension", "value")
    )


def _line_ids(lines: DataFrame) -> DataFrame:
    return shape_ids(lines, "url", "url_ids").withColumn("image_skus", image_sku_ids(F.col("image_url")))


def id_extraction_rates(views: DataFrame, items: DataFrame) -> DataFrame:
    """Per session: product URLs with and without ids; final cart lines with URL, ids or image SKUs."""
    v = shape_ids(views, "url", "url_ids").groupBy("session_id").agg(
        F.count(F.lit(1)).alias("product_urls"), F.count_if(F.size("url_ids") > 0).alias("product_urls_with_ids")
    )
    any_id = (F.size("url_ids") > 0) | (F.size("image_skus") > 0)
    c = _line_ids(final_cart_lines(items)).groupBy("session_id").agg(
        F.count(F.lit(1)).alias("cart_lines"),
        F.count_if(any_id).alias("cart_lines_with_ids"),
        F.count_if(~any_id & _has("url")).alias("cart_urls_without_ids"),
        F.count_if(~_has("url")).alias("cart_lines_without_url"),
    )
    counts = ["product_urls", "product_urls_with_ids", "cart_lines", "cart_lines_with_ids", "cart_urls_without_ids", "cart_lines_without_url"]
    return v.join(c, "session_id", "full").select("session_id", *[F.coalesce(n, F.lit(0)).alias(n) for n in counts])


def id_overlap(views: DataFrame, items: DataFrame) -> DataFrame:
    """Final cart lines whose URL ids or image SKUs occur among product ids and SKUs, or among product ids alone."""
    lines = final_cart_lines(items)
    hits = _key_hits(lines, views).where(F.col("strategy").isin("image_sku", "extracted_id_sku", "extracted_id", "image_id"))
    per_line = hits.groupBy("session_id", "item_pos").agg(
        F.lit(True).alias("any_hit"), F.max(F.col("strategy").isin("extracted_id", "image_id")).alias("id_hit")
    )
    return (
        lines.join(per_line, ["session_id", "item_pos"], "left")
        .groupBy("session_id")
        .agg(
            F.count(F.lit(1)).alias("cart_lines"),
            F.count_if(F.coalesce("any_hit", F.lit(False))).alias("overlap_ids_or_skus"),
            F.count_if(F.coalesce("id_hit", F.lit(False))).alias("overlap_ids"),
        )
    )


def session_quality_score(views: DataFrame, items: DataFrame) -> DataFrame:
    """Weighted score of data quality, id extraction, id overlap and predicted confidence, with its band."""
    quality = session_data_quality(views, items).select(
        "session_id", F.when(F.expr(" + ".join(ISSUES)) > 0, F.lit(70.0)).otherwise(F.lit(100.0)).alias("data_quality")
    )
    rates = id_extraction_rates(views, items)
    overlap = id_overlap(views, items).drop("cart_lines")
    points = F.create_map(*[F.lit(x) for kv in CONFIDENCE_POINTS.items() for x in kv])
    confidence = predict_match_strategy(views, items).groupBy("session_id").agg(F.sum(points[F.col("confidence")]).alias("points"))
    joined = quality.join(rates, "session_id", "left").join(overlap, "session_id", "left").join(confidence, "session_id", "left")

    def share(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.coalesce(F.col(part), F.lit(0)) * 100.0 / F.col(whole)).otherwise(F.lit(0.0))

    scored = joined.select(
        "session_id",
        "data_quality",
        share("product_urls_with_ids", "product_urls").alias("id_extraction"),
        share("overlap_ids", "cart_lines").alias("id_overlap"),
        F.when(F.col("cart_lines") > 0, F.col("points") / F.col("cart_lines")).otherwise(F.lit(0.0)).alias("match_confidence"),
    )
    total = sum((F.col(n) * w for n, w in SCORE_WEIGHTS.items()), F.lit(0.0))
    # rounding away binary noise first keeps a sum of exactly 80 from being cut to 79
    score = F.floor(F.round(total, 6)).cast("int")
    return scored.withColumn("score", score).withColumn(
        "band", F.when(F.col("score") >= 80, F.lit("ready")).when(F.col("score") >= 60, F.lit("moderate")).otherwise(F.lit("needs_improvement"))
    )


def title_similarity_best(views: DataFrame, items: DataFrame, small_session: int = SMALL_SESSION_TITLES) -> DataFrame:
    """Best simple title similarity per final cart line; 0 when nothing in the session is similar."""
    lines = final_cart_lines(items)
    title = js_trim(F.lower("name"))
    carts = lines.where(F.col("name").isNotNull()).select("session_id", title.alias("title")).distinct()
    names = product_views_by_url(views).where(F.col("name").isNotNull()).groupBy("session_id", title.alias("title")).agg(F.min("first_pos").alias("product_pos"))
    pairs = title_pairs(carts, names, containment_keys(), containment_elements, small_session, busy_sessions(views, small_session))
    best = (
        pairs.withColumn("score", simple_title_similarity(F.col("c_title"), F.col("p_title")))
        .groupBy("session_id", "c_title")
        .agg(F.max("score").alias("similarity"))
    )
    keyed = lines.select("session_id", "item_pos", title.alias("c_title"))
    return keyed.join(best, ["session_id", "c_title"], "left").select(
        "session_id", "item_pos", F.coalesce("similarity", F.lit(0.0)).alias("similarity")
    )


def title_similarity_buckets(views: DataFrame, items: DataFrame) -> DataFrame:
    s = F.col("similarity")
    return title_similarity_best(views, items).groupBy("session_id").agg(
        F.count_if(s >= 0.8).alias("will_match"),
        F.count_if((s >= 0.6) & (s < 0.8)).alias("borderline"),
        F.count_if(s < 0.6).alias("wont_match"),
    )


def strategy_availability(views: DataFrame, items: DataFrame) -> DataFrame:
    """Per session and strategy: how many products and cart lines carry the needed field and how many lines hit."""
    products = unique_products(views).groupBy("session_id").agg(
        F.count(F.lit(1)).alias("products"),
        F.count_if(F.col("skus") > 0).alias("with_skus"),
        F.count_if(F.col("extracted_ids") > 0).alias("with_ids"),
        F.count_if(F.col("colors") > 0).alias("with_colors"),
        F.coalesce(F.avg(F.when(F.col("skus") > 0, F.col("skus"))), F.lit(0.0)).alias("avg_skus"),
    )
    lines = final_cart_lines(items)
    parts = with_title_parts(_line_ids(lines), "name").groupBy("session_id").agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(_has("image_url")).alias("with_image"),
        F.count_if(F.size("image_skus") > 0).alias("with_image_skus"),
        F.count_if(F.size("url_ids") > 0).alias("with_url_ids"),
        F.count_if(_has("url")).alias("with_url"),
        F.count_if(F.col("title_color").isNotNull()).alias("with_color"),
    )
    hits = (
        _key_hits(lines, views)
        .groupBy("session_id", "item_pos")
        .agg(*[F.max(F.col("strategy") == s).alias(s) for s in ("extracted_id_sku", "url", "extracted_id", "image_sku", "title_color")])
        .groupBy("session_id")
        .agg(*[F.count_if(s).alias(f"hit_{s}") for s in ("extracted_id_sku", "url", "extracted_id", "image_sku", "title_color")])
    )
    similar = title_similarity_buckets(views, items).select("session_id", F.col("will_match").alias("hit_title"))
    joined = parts.join(products, "session_id", "left").join(hits, "session_id", "left").join(similar, "session_id", "left").na.fill(0)

    def row(strategy: str, product_side: Column, cart_side: Column, hit: Column) -> Column:
        return F.struct(
            F.lit(strategy).alias("strategy"),
            product_side.cast("long").alias("products_with_field"),
            cart_side.cast("long").alias("lines_with_field"),
            hit.cast("long").alias("lines_hit"),
        )

    zero = F.lit(0)
    rows = F.array(
        row("sku", F.col("with_skus"), zero, zero),
        row("variant_sku", F.col("with_skus"), zero, zero),
        row("image_sku", F.col("with_skus"), F.col("with_image_skus"), F.col("hit_image_sku")),
        row("extracted_id_sku", F.col("with_skus"), F.col("with_url_ids"), F.col("hit_extracted_id_sku")),
        row("url", F.col("products"), F.col("with_url"), F.col("hit_url")),
        row("extracted_id", F.col("with_ids"), F.col("with_url_ids"), F.col("hit_extracted_id")),
        row("title_color", F.col("with_colors"), F.col("with_color"), F.col("hit_title_color")),
        row("title", F.col("products"), F.col("lines"), F.col("hit_title")),
    )
    return joined.select("session_id", "products", "lines", "avg_skus", F.explode(rows).alias("r")).select(
        "session_id", "r.*", "products", "lines", "avg_skus"
    )


def query_param_frequency(urls: DataFrame, url_col: str = "url", top: int | None = None) -> DataFrame:
    """Query parameter names by frequency; names that are not known id parameters are flagged."""
    parsed = with_url_parts(urls.withColumn("q_url", F.col(url_col)), "q_url").where(F.col("u_error").isNull() & (F.col("u_query") != ""))
    raw = F.replace(F.substring_index("part", "=", 1), F.lit("+"), F.lit(" "))
    name = F.when(F.contains(raw, F.lit("%")), F.coalesce(F.try_url_decode(raw), raw)).otherwise(raw)
    counted = (
        parsed.select(F.explode(F.split("u_query", "&")).alias("part"))
        .where(F.col("part") != "")
        .groupBy(name.alias("param"))
        .agg(F.count(F.lit(1)).alias("urls"))
        .withColumn("unused", ~F.lower("param").isin(KNOWN_ID_PARAMS))
        .orderBy(F.desc("urls"), "param")
    )
    return counted.limit(top) if top else counted


def image_id_patterns(lines: DataFrame) -> DataFrame:
    """Image file names with a 6-12 digit run or a long token that does not start with a capital, by shortened example."""
    name = F.substring_index("image_url", "/", -1)
    number = F.regexp_extract(name, r"(\d{6,12})", 1)
    token = F.regexp_extract(name, "([a-zA-Z0-9]{8,})", 1)
    found = F.array(
        F.when(number != "", F.struct(F.lit("numeric").alias("kind"), F.concat(F.lit("numeric-"), F.substring(number, 1, 4), F.lit("...")).alias("pattern"))),
        F.when(
            (token != "") & ~token.rlike("^[A-Z]"),
            F.struct(F.lit("mixed").alias("kind"), F.concat(F.lit("mixed-"), F.substring(token, 1, 6), F.lit("...")).alias("pattern")),
        ),
    )
    return (
        lines.where(_has("image_url"))
        .select("session_id", F.explode(found).alias("f"))
        .where(F.col("f").isNotNull())
        .groupBy("session_id", "f.kind", "f.pattern")
        .agg(F.count(F.lit(1)).alias("images"))
    )


def title_prefix_suffix_mining(views: DataFrame, items: DataFrame, small_session: int = SMALL_SESSION_TITLES) -> DataFrame:
    """Final cart lines whose first word is missing from a product title holding the rest, and trailing size suffixes."""
    lines = final_cart_lines(items).where(F.col("name").isNotNull())
    tokens = F.split("name", r"\s+")
    parts = lines.select(
        "session_id",
        "item_pos",
        F.when(F.size(tokens) >= 2, F.get(tokens, F.lit(0))).alias("brand"),
        F.when(F.size(tokens) >= 2, F.lower(F.array_join(F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0))), " "))).alias("rest"),
        F.nullif(F.regexp_extract("name", r"(?i)\s*[-–]\s*([A-Z]{1,3}|Small|Medium|Large|\d+)$", 1), F.lit("")).alias("suffix"),
    )
    rests = parts.where(_has("brand")).select("session_id", F.col("rest").alias("title"), F.lower("brand").alias("brand")).distinct()
    names = (
        product_views_by_url(views).where(F.col("name").isNotNull())
        .groupBy("session_id", F.lower("name").alias("title"))
        .agg(F.min("first_pos").alias("product_pos"))
    )
    pairs = title_pairs(rests, names, containment_keys(), containment_elements, small_session, busy_sessions(views, small_session))
    hit = (
        pairs.where(F.contains("p_title", "c_title") & ~F.col("p_title").startswith(F.col("c_brand")))
        .select("session_id", F.col("c_title").alias("rest"), F.col("c_brand").alias("brand_key"))
        .distinct()
        .withColumn("hit", F.lit(True))
    )
    return (
        parts.withColumn("brand_key", F.lower("brand"))
        .join(hit, ["session_id", "rest", "brand_key"], "left")
        .select("session_id", "item_pos", F.when(F.col("hit"), F.col("brand")).alias("prefix"), "suffix")
        .where(F.col("prefix").isNotNull() | F.col("suffix").isNotNull())
    )


def price_unit_check(views: DataFrame, items: DataFrame) -> DataFrame:
    """Whether the cart and the products of a session seem to use different price units."""
    cart = final_cart_lines(items).groupBy("session_id").agg(F.avg("item_price").alias("avg_cart_price"))
    product = product_views_by_url(views).groupBy("session_id").agg(F.avg("price_min").alias("avg_product_price"))
    joined = cart.join(product, "session_id", "full").na.fill(0.0)
    return (
        joined.withColumn("cart_unit", F.when(F.col("avg_cart_price") > 1000, F.lit("cents")).otherwise(F.lit("dollars")))
        .withColumn("product_unit", F.when(F.col("avg_product_price") < 1000, F.lit("dollars")).otherwise(F.lit("cents")))
        .withColumn("mismatch", F.col("cart_unit") != F.col("product_unit"))
    )


def unmatched_colors(views: DataFrame, items: DataFrame) -> DataFrame:
    """Colours named in final cart titles that no viewed product of the session has."""
    wanted = with_title_parts(final_cart_lines(items), "name").where(_has("title_color")).select(
        "session_id", F.lower("title_color").alias("color")
    ).distinct()
    offered = views.where(F.col("url").isNotNull()).select("session_id", F.explode("color_list").alias("c")).select(
        "session_id", F.lower("c").alias("color")
    )
    return wanted.join(offered, ["session_id", "color"], "left_anti")


def extracted_id_reliability(views: DataFrame, items: DataFrame) -> DataFrame:
    """Share of final cart lines with URL whose URL id is also a product's URL id; above 0.9 the strategy earns trust."""
    lines = final_cart_lines(items).where(_has("url"))
    found = (
        _key_hits(lines, views).where(F.col("strategy") == "extracted_id").select("session_id", "item_pos").distinct().withColumn("hit", F.lit(True))
    )
    return (
        lines.join(found, ["session_id", "item_pos"], "left")
        .groupBy("session_id")
        .agg(F.count(F.lit(1)).alias("attempts"), F.count("hit").alias("matches"))
        .withColumn("reliability", F.col("matches") / F.col("attempts"))
        .withColumn("upgrade", F.col("reliability") > 0.9)
    )


def improvement_suggestions(views: DataFrame, items: DataFrame) -> DataFrame:
    """Suggestions per session with category, priority and the number of rows behind them."""
    lines = final_cart_lines(items)
    urls = views.select("session_id", "url").unionByName(lines.select("session_id", "url")).where(_has("url"))
    params = with_url_parts(urls).where(F.col("u_error").isNull() & (F.col("u_query") != "")).select(
        "session_id", F.explode(F.split("u_query", "&")).alias("part"), "u_text"
    )
    unused = params.where(~F.lower(F.substring_index("part", "=", 1)).isin(KNOWN_ID_PARAMS)).select("session_id").distinct()
    with_params = (
        with_url_parts(urls).where(F.col("u_error").isNull() & (F.col("u_query") != "")).groupBy("session_id").agg(F.count(F.lit(1)).alias("impact"))
    )

    def rows(df: DataFrame, category: str, title: str, priority: Column) -> DataFrame:
        return df.select(
            "session_id", F.lit(category).alias("category"), F.lit(title).alias("title"), priority.alias("priority"), F.col("impact").cast("long").alias("impact")
        )

    n = F.col("impact")
    images = image_id_patterns(lines).groupBy("session_id").agg(
        F.coalesce(F.sum(F.when(F.col("kind") == "numeric", F.col("images"))), F.lit(0)).alias("impact")
    )
    mined = title_prefix_suffix_mining(views, items)
    prefixes = mined.groupBy("session_id").agg(F.count("prefix").alias("impact")).where(n > 0)
    suffixes = mined.groupBy("session_id").agg(F.count("suffix").alias("impact")).where(n > 0)
    units = price_unit_check(views, items).where("mismatch").select("session_id", F.lit(1).alias("impact"))
    colors = unmatched_colors(views, items).groupBy("session_id").agg(F.count(F.lit(1)).alias("impact"))
    trusted = extracted_id_reliability(views, items).where("upgrade").select("session_id", F.col("matches").alias("impact"))
    parts = [
        rows(with_params.join(unused, "session_id", "left_semi"), "ids", "unused_query_parameters", F.lit("medium")),
        rows(images, "image_skus", "image_sku_patterns", F.when(n > 0, F.lit("high")).otherwise(F.lit("low"))),
        rows(prefixes, "titles", "brand_prefixes", F.when(n > 1, F.lit("medium")).otherwise(F.lit("low"))),
        rows(suffixes, "titles", "size_suffixes", F.lit("low")),
        rows(units, "prices", "price_units", F.lit("medium")),
        rows(colors, "title_colors", "color_synonyms", F.when(n > 2, F.lit("medium")).otherwise(F.lit("low"))),
        rows(trusted, "confidence", "trusted_extracted_ids", F.lit("low")),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def session_registry_status(views: DataFrame, items: DataFrame, registry: DataFrame, sample: int = 5) -> DataFrame:
    """Whether a session's store is registered by id or domain, and the id rate of its first views."""
    meta = session_store_metadata(views, items).select("session_id", "store_id", "domain")
    w = Window.partitionBy("session_id").orderBy("view_pos")
    first = views.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= sample)
    rate = shape_ids(first, "url", "url_ids").groupBy("session_id").agg(
        F.count(F.lit(1)).alias("sampled"), F.count_if(F.size("url_ids") > 0).alias("sampled_with_ids")
    )
    ids = dim_store_by_id(registry).select("store_id", F.lit(True).alias("by_id"))
    domains = dim_store_by_domain(registry).select(F.col("store_domain").alias("domain"), F.lit(True).alias("by_domain"))
    return (
        meta.join(ids, "store_id", "left")
        .join(domains, "domain", "left")
        .join(rate, "session_id", "left")
        .select(
            "session_id",
            "store_id",
            "domain",
            F.col("by_id").isNotNull().alias("known_by_id"),
            F.col("by_domain").isNotNull().alias("known_by_domain"),
            F.coalesce("sampled", F.lit(0)).alias("sampled"),
            F.coalesce("sampled_with_ids", F.lit(0)).alias("sampled_with_ids"),
        )
    )


def new_golden_candidates(views: DataFrame, items: DataFrame, golden: DataFrame) -> DataFrame:
    """Distinct product-page URLs of a session with ids that the golden set lacks."""
    domains = session_store_metadata(views, items).select("session_id", "domain")
    urls = views.select("session_id", "url").unionByName(final_cart_lines(items).select("session_id", "url")).where(_has("url")).distinct()
    kept = non_product_filter(urls.join(domains, "session_id"), "url", "domain").where(F.col("reject_reason").isNull())
    shaped = analyze_url_shape(kept.select("session_id", F.col("m_url").alias("product_url")), "product_url").where(F.size("shape_ids") > 0)
    known = analyze_url_shape(golden.select(F.col("url").alias("golden_url")), "golden_url").select(F.col("m_url").alias("product_url"))
    return shaped.select("session_id", "product_url", "shape_ids").dropDuplicates(["session_id", "product_url"]).join(known, "product_url", "left_anti")
