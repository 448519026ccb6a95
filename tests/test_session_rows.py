"""Session inputs over one copy of their rows in buckets, and jobs that do repeated work once."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cartloom.operators import enrichment, sessions
from cartloom.operators.product_views import normalize_raw_views
from cartloom.plans.adapters import session_views, view
from cartloom.sources.events import event_violations, parse_product_views
from cartloom.sources.registry import builtin_registry
from cartloom.streaming import jobs


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    """Line items and parts with repeated, missing and null keys."""
    rng, path = random.Random(3), tmp_path_factory.mktemp("rows")
    lines = [(rng.choice([None, *range(40)]), rng.choice([None, *range(30)]), rng.randrange(9), rng.randrange(1, 8), float(rng.randrange(1, 5)), 100.5 * rng.randrange(1, 9)) for _ in range(400)]
    parts = [(k % 25, f"{'red' if k % 2 else 'blue'} part {k}", f"Brand#{k}", "LARGE", k, 900.0 + k) for k in range(27)]
    spark.createDataFrame([*lines, *lines[:9]], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double").write.parquet(f"{path}/lineitem.parquet")
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{path}/part.parquet")
    return str(path)


def counted(df):
    return Counter(map(str, df.collect()))


@pytest.mark.parametrize("names", [("cart_lines", "viewed_products"), ("session_views", "session_cart_items")])
def test_session_views_are_the_views(spark, rows, names):
    for name, got in zip(names, session_views(spark, rows, *names), strict=True):
        assert got.columns == view(spark, rows, name).columns and counted(got) == counted(view(spark, rows, name))
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_jobs_by_session_dont_shuffle_what_they_make_of_its_rows(spark, rows):
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        carts, products = session_views(spark, rows, "cart_lines", "viewed_products")
        views, items = session_views(spark, rows, "session_views", "session_cart_items")
        assert shuffles(enrichment.enrich_cart(carts, products)) == 0 and shuffles(enrichment.primary_matches(carts, products)) == 0
        for job in (sessions.predict_match_strategy, sessions.session_quality_score, sessions.strategy_availability, sessions.improvement_suggestions, sessions.match_potential, sessions.id_overlap, sessions.extracted_id_reliability):
            # at most two of a row a session, around a full join
            assert shuffles(job(views, items)) <= 2, job
        # other inputs meet by session and key, as before
        assert shuffles(enrichment.enrich_cart(view(spark, rows, "cart_lines"), view(spark, rows, "viewed_products"))) > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)


def test_several_confidences_are_each_alone(spark, rows):
    carts, products = session_views(spark, rows, "cart_lines", "viewed_products")
    levels, none = ["high", "medium", "low"], ["enriched_at"]
    together = enrichment.enrich_cart(carts, products, levels)
    for level in levels:
        alone = enrichment.enrich_cart(carts, products, level).drop(*none)
        assert counted(together.where(F.col("min_confidence") == level).drop("min_confidence", *none)) == counted(alone)


def test_an_event_is_parsed_once(spark):
    texts = ['{"name":1}', ' \t{"name":"x"}', "[1]", "", None, '{"a":', '"{"', "{} x"]
    raw = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "event_id long, raw string")
    checked = event_violations(raw)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(checked).count("parseJson") == 1 and "schemaOfVariant" not in plan(parse_product_views(raw))
    assert {r.event_id: r.violations for r in checked.collect()} == {0: ["name"], 1: [], **{i: ["$"] for i in range(2, 7)}, 7: [] if spark.sql("select try_parse_json('{} x') is not null").first()[0] else ["$"]}
    read = {r.event_id for r in parse_product_views(raw).where(F.col("e").isNotNull()).collect()}
    assert read == {r.event_id for r in raw.where(F.schema_of_variant(F.try_parse_json("raw")).startswith("OBJECT")).collect()}


def test_ids_of_the_canonical_url(spark):
    raw = spark.createDataFrame([(0, '{"store_id":5246,"canonical":["https://www.target.com/p/x/-/A-10000001"]}')], "event_id long, raw string")
    products = normalize_raw_views(raw, builtin_registry(spark))
    assert products.first().extracted_ids == ["10000001"]


def test_closed_sessions_are_worked_out_once(spark, tmp_path):
    spark.sql("select 1L as session_id, timestamp '2024-01-01' as session_start, timestamp '2024-01-01' as session_end").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("session_id long, session_start timestamp, session_end timestamp").parquet(f"{tmp_path}/in")
    seen = []

    def load(kind):
        def of(closed):
            seen.append((closed._jdf.queryExecution().optimizedPlan().toString(), closed.collect()))
            return spark.createDataFrame([], kind).join(closed, "session_id", "left_semi")

        return of

    from test_matching import CART, PRODUCT

    jobs.stream_session_enrich(stream, load(CART), load(PRODUCT), lambda df, n: df.count(), f"{tmp_path}/checkpoint").awaitTermination()
    assert len(seen) == 2 and all("parquet" in plan and len(got) == 1 for plan, got in seen)
