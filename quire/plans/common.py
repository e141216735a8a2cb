"""Derived inputs shared by several catalogue entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.cleaning import clean_deliveries, clean_weekly_sales
from quire.sources.views import Views

# Unit prices of the ordered items (the first kind costs 12, all others 10).
PREMIUM_ITEM = "STANDARD"
PREMIUM_PRICE = 12
BASE_PRICE = 10

# DuckDB spellings
DELIVERED_SQL = "coalesce(cancellation, '') IN ('null', '')"
ITEM_PRICE_SQL = f"CASE WHEN item_name = '{PREMIUM_ITEM}' THEN {PREMIUM_PRICE} ELSE {BASE_PRICE} END"


def item_price() -> F.Column:
    return F.when(F.col("item_name") == PREMIUM_ITEM, F.lit(PREMIUM_PRICE)).otherwise(F.lit(BASE_PRICE))


def deliveries(v: Views) -> DataFrame:
    return clean_deliveries(v.v_dirty)


def delivered_orders(v: Views) -> DataFrame:
    return deliveries(v).where(F.col("cancellation").isNull())


def delivered_items(v: Views, numbered: bool = False) -> DataFrame:
    """Ordered items whose order was delivered (left-semi join on the order);
    ``numbered`` adds the item number inside the order."""
    items = v.v_item if numbered else v.v_item_lines
    return items.join(delivered_orders(v).select("order_id"), "order_id", "left_semi")


def weekly(v: Views) -> DataFrame:
    return clean_weekly_sales(v.v_weekly)


def pct_sql(num: str, den: str, scale: int = 2, precision: int = 20) -> str:
    """Exact percent of integers (positive denominator) in DuckDB, rounded half away
    from zero, as DECIMAL(precision, scale)."""
    f = 10 ** scale
    return (f"CAST(CAST(sign({num}) * ((2 * {100 * f} * abs(CAST({num} AS HUGEINT)) + ({den})) // (2 * ({den})))"
            f" AS DECIMAL(38,0)) * {1 / f:.{scale}f} AS DECIMAL({precision},{scale}))")
