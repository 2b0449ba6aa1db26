"""Price rules, as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_to_tens(price: Column) -> Column:
    """A whole number rounded to tens, five upwards; 0 if not positive."""
    return F.when(price > 0, F.floor((F.floor(price) + 5) / 10) * 10).otherwise(F.lit(0)).cast("double")


def retail_price(base: Column, percent: Column, threshold: Column, min_profit: Column) -> Column:
    """Base with its markup; up to the threshold at least min_profit is added."""
    marked = base * (1 + percent / 100)
    return round_to_tens(F.when(base <= threshold, F.greatest(marked, base + min_profit)).otherwise(marked))


def undiscounted_price(retail: Column, percent: Column) -> Column:
    return round_to_tens(retail * (1 + percent / 100))


def low_margin(price: Column, rrp: Column) -> Column:
    """Below 20 and below 5 %; one alone is no fault."""
    return (rrp - price < 20) & (rrp - price < price * 0.05)


def suspicious(price: Column, rrp: Column) -> Column:
    bad_price, bad_rrp = price.isNull() | (price <= 0), rrp.isNull() | (rrp <= 0)
    return F.when(bad_price, "invalid_price").when(bad_rrp, "invalid_rrp").when(rrp <= price, "rrp_not_above_price").when(low_margin(price, rrp), "low_margin")


def whole_price(price: Column) -> Column:
    """The price as shown beside a row: a whole number, 0 if not positive, null if not finite. Not round_to_tens."""
    finite = ~F.isnan(price) & (F.abs(price) < float("inf"))
    return F.when(finite, F.when(price > 0, F.floor(price)).otherwise(0)).cast("long")
