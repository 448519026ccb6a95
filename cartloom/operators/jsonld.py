"""Schema.org product documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Accepted contexts and the fields that lead to further SKUs, in the order they are followed.
CONTEXTS = ["https://schema.org", "http://schema.org"]
NESTED_FIELDS = ["offers", "hasVariant", "isVariantOf", "model"]


def _text(v: Column, path: str) -> Column:
    got = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(got) == "STRING", F.try_variant_get(v, path, "string"))


def with_document(df: DataFrame, json_col: str = "json") -> DataFrame:
    return df.withColumn("v", F.try_parse_json(json_col))


def jsonld_product_filter(df: DataFrame, json_col: str = "json") -> DataFrame:
    """Adds ``is_product`` and ``reasons``: the parts that keep a document from being a product."""
    doc = with_document(df, json_col)
    kind = F.try_variant_get("v", "$['@type']", "variant")
    types = F.when(F.schema_of_variant(kind).startswith("ARRAY"), F.try_variant_get(kind, "$", "array<string>"))
    v = F.col("v")
    checks = [
        (F.coalesce(_text(v, "$['@context']").isin(CONTEXTS), F.lit(False)), "Missing or invalid @context"),
        (
            F.coalesce(F.array_contains(types, "Product"), _text(v, "$['@type']") == "Product", F.lit(False)),
            "Missing or invalid @type (Product)",
        ),
        (F.coalesce(_text(v, "$.name") != "", F.lit(False)), "Missing or invalid name"),
    ]
    reasons = F.filter(F.array(*[F.when(~ok, F.lit(text)) for ok, text in checks]), lambda r: r.isNotNull())
    return doc.withColumn("reasons", reasons).withColumn("is_product", F.size("reasons") == 0).drop("v")


def _own_skus(v: Column) -> Column:
    sku = F.try_variant_get(v, "$.sku", "variant")
    kind = F.schema_of_variant(sku)
    elements = F.filter(F.try_variant_get(sku, "$", "array<variant>"), lambda x: F.schema_of_variant(x) == "STRING")
    return (
        F.when(kind == "STRING", F.array(F.try_variant_get(sku, "$", "string")))
        .when(kind.startswith("ARRAY"), F.transform(elements, lambda x: F.try_variant_get(x, "$", "string")))
        .otherwise(F.expr("cast(array() as array<string>)"))
    )


def _children(v: Column) -> Column:
    """Nested objects of a node in the order they are followed."""
    lists = []
    for field in NESTED_FIELDS:
        got = F.try_variant_get(v, f"$.{field}", "variant")
        kind = F.schema_of_variant(got)
        lists.append(
            F.when(kind.startswith("ARRAY"), F.try_variant_get(got, "$", "array<variant>"))
            .when(kind.startswith("OBJECT"), F.array(got))
            .otherwise(F.expr("cast(array() as array<variant>)"))
        )
    return F.filter(F.flatten(F.array(*lists)), lambda x: F.schema_of_variant(x).startswith("OBJECT"))


def jsonld_skus(df: DataFrame, id_col: str = "doc_id", json_col: str = "json") -> DataFrame:
    """Distinct SKUs of a document in depth-first order, from any depth.

    One projection: a stack of nodes is worked off within the row, in as many steps as the document can have objects.
    """
    no_nodes, no_skus = F.expr("cast(array() as array<variant>)"), F.expr("cast(array() as array<string>)")
    is_object = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    start = F.struct(F.when(is_object, F.array("v")).otherwise(no_nodes).alias("stack"), no_skus.alias("skus"))
    most = F.length(json_col) - F.length(F.replace(F.col(json_col), F.lit("{"), F.lit("")))

    def step(state: Column, _: Column) -> Column:
        node, rest = F.get(state["stack"], F.lit(0)), F.slice(state["stack"], F.lit(2), F.greatest(F.size(state["stack"]) - 1, F.lit(0)))
        open_ = F.size(state["stack"]) > 0
        return F.struct(
            F.when(open_, F.concat(_children(node), rest)).otherwise(state["stack"]).alias("stack"),
            F.when(open_, F.concat(state["skus"], _own_skus(node))).otherwise(state["skus"]).alias("skus"),
        )

    walked = F.aggregate(F.sequence(F.lit(1), F.greatest(F.coalesce(most, F.lit(0)), F.lit(1))), start, step)
    found = with_document(df, json_col).select(*df.columns, walked["skus"].alias("skus"))
    return found.withColumn("skus", F.coalesce(F.array_distinct("skus"), no_skus))


def jsonld_product_summary(df: DataFrame, id_col: str = "doc_id", json_col: str = "json") -> DataFrame:
    """Name, brand, model, SKU, description and all SKUs of the documents that are products."""
    products = jsonld_product_filter(df, json_col).where("is_product").drop("reasons", "is_product")
    doc = with_document(jsonld_skus(products, id_col, json_col), json_col)
    v = F.col("v")
    brand = F.try_variant_get(v, "$.brand", "variant")
    return doc.select(
        id_col,
        _text(v, "$.name").alias("name"),
        F.when(F.schema_of_variant(brand).startswith("OBJECT"), _text(v, "$.brand.name"))
        .otherwise(F.try_variant_get(v, "$.brand", "string"))
        .alias("brand"),
        F.try_variant_get(v, "$.model", "string").alias("model"),
        F.try_variant_get(v, "$.sku", "string").alias("sku"),
        F.try_variant_get(v, "$.description", "string").alias("description"),
        "skus",
    )
