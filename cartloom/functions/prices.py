"""Prices as integer cents from numbers, texts and {amount, currency} objects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cartloom.functions.text import parse_number, round_half_up

# Amounts below this are read as whole currency units even without a decimal point.
UNIT_LIMIT = 100


def text_amount_to_cents(amount: Column) -> Column:
    """'12.99' and '12' become cents, '1299' stays as it is."""
    number = parse_number(amount)
    return F.when(
        F.contains(amount, F.lit(".")) | (number < UNIT_LIMIT), round_half_up(number * 100)
    ).otherwise(number.cast("long"))


def number_amount_to_cents(number: Column) -> Column:
    """12.99 and 12 become cents, 1299 stays as it is."""
    fractional = number != F.floor(number)
    return F.when(fractional | (number < UNIT_LIMIT), round_half_up(number * 100)).otherwise(number.cast("long"))


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def is_number(v: Column) -> Column:
    return _kind(v).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")


def amount_to_cents(v: Column) -> Column:
    """Cents of a variant that holds a text or a number amount."""
    return F.when(is_number(v), number_amount_to_cents(F.try_variant_get(v, "$", "double"))).otherwise(
        text_amount_to_cents(F.try_variant_get(v, "$", "string"))
    )


def price_to_cents(v: Column) -> Column:
    """Cents of a price variant: plain numbers already are cents, texts and objects are scaled by their look."""
    kind = _kind(v)
    return (
        F.when(is_number(v), round_half_up(F.try_variant_get(v, "$", "double")))
        .when(kind == "STRING", text_amount_to_cents(F.try_variant_get(v, "$", "string")))
        .when(kind.startswith("OBJECT"), amount_to_cents(F.try_variant_get(v, "$.amount", "variant")))
    )


def price_currency(v: Column) -> Column:
    """Currency of an object-shaped price; an empty code counts as none."""
    return F.when(_kind(v).startswith("OBJECT"), F.nullif(F.try_variant_get(v, "$.currency", "string"), F.lit("")))


def prices_close(a: Column, b: Column, tolerance: float = 0.1) -> Column:
    """Equal, or within the tolerance of the larger price; a zero price is close only to zero."""
    return (
        F.when(a.isNull() | b.isNull(), F.lit(False))
        .when(a == b, F.lit(True))
        .when((a == 0) | (b == 0), F.lit(False))
        .otherwise(F.abs(a - b) / F.greatest(a, b) <= tolerance)
    )
