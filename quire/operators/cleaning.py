"""Cleaning and load operators.

All are narrow (row-local) transformations: they add no shuffle and fuse
into the scan's whole-stage-codegen span. ``check_constraints`` is the one
exception (uniqueness needs a grouping).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import calendar as cal
from quire.functions.numeric import ratio_decimal, trunc_div
from quire.functions.text import MISSING_TOKENS, decode, leading_number, null_if_token


def normalize_missing(df: DataFrame, cols: list[str], tokens=MISSING_TOKENS) -> DataFrame:
    """Replace the textual spellings of 'missing' in ``cols`` by NULL."""
    return df.withColumns({c: null_if_token(c, tokens) for c in cols})


def strip_unit_cast(df: DataFrame, col: str, to_type: str = "decimal(10,2)", out: str | None = None) -> DataFrame:
    """'23.4 km' -> 23.4, '32 minutes' -> 32; text that is no number -> NULL."""
    if to_type.startswith("timestamp"):
        value = null_if_token(col).try_cast(to_type)
    else:
        value = leading_number(col, to_type)
    return df.withColumn(out or col, value)


def clean_deliveries(df: DataFrame) -> DataFrame:
    """The cleaned delivery table: typed pickup time, distance (km), duration (min)."""
    df = normalize_missing(df, ["pickup_time", "distance", "duration", "cancellation"])
    df = strip_unit_cast(df, "pickup_time", "timestamp_ntz")
    df = strip_unit_cast(df, "distance", "decimal(10,2)")
    return strip_unit_cast(df, "duration", "int")


def parse_short_date(df: DataFrame, col: str, fmt: str = "d/M/yy", pivot: int = 2049,
                     out: str | None = None) -> DataFrame:
    """Day/month/two-digit-year text -> DATE with a century pivot."""
    return df.withColumn(out or col, cal.parse_short_date(col, fmt, pivot))


def calendar_parts(df: DataFrame, date_col: str, anchor: str | None = None) -> DataFrame:
    """Month, year, both weekday numberings, ISO week, Sunday-start week and
    (with ``anchor``) Sunday-boundary week offset to the anchor date (W05)."""
    d = F.col(date_col)
    cols = {
        "month_number": F.month(d),
        "calendar_year": F.year(d),
        "iso_weekday": cal.iso_weekday(d),
        "sunday_weekday": cal.sunday_weekday(d),
        "iso_week": cal.iso_week(d),
        "week_number": cal.sunday_week(d),
    }
    if anchor:
        cols["week_offset"] = cal.sunday_weeks_between(d, F.lit(anchor).cast("date"))
    return df.withColumns(cols)


# Segment decoding of the weekly sales table.
AGE_BANDS = {"1": "Young Adults", "2": "Middle Aged", "3": "Retirees", "4": "Retirees"}
DEMOGRAPHICS = {"C": "Couples", "F": "Families"}
UNKNOWN = "Unknown"


def decode_segment(df: DataFrame, col: str = "segment") -> DataFrame:
    """Last character -> age band, first character -> demographic; else 'Unknown' (W06)."""
    return df.withColumns({
        "age_band": decode(F.right(F.col(col), F.lit(1)), AGE_BANDS, UNKNOWN),
        "demographic": decode(F.left(F.col(col), F.lit(1)), DEMOGRAPHICS, UNKNOWN),
    })


def add_row_id(df: DataFrame, partition_cols: list[str], order_cols: list[str], name: str = "item_no") -> DataFrame:
    """Number rows 1..n inside a natural partition under a total order.

    (partition key, number) is the surrogate key. A dense global id would
    need a one-partition window; this one is a two-level ``sequence`` over
    the natural key.
    """
    from quire.operators.sequence import sequence
    s = sequence(df, partition_cols, order_cols, rn_name="_rn")
    return s.withColumn(name, F.col("_rn").cast("int")).drop("_rn")


def safe_ratio(df: DataFrame, num: str, den: str, out: str = "avg_transaction",
               out_int: str | None = None, precision: int = 10, scale: int = 2) -> DataFrame:
    """num/den as DECIMAL(precision, scale), and optionally the truncating integer ratio."""
    cols = {out: ratio_decimal(num, den, precision, scale)}
    if out_int:
        cols[out_int] = trunc_div(num, den)
    return df.withColumns(cols)


def check_constraints(df: DataFrame, unique: dict[str, list[str]],
                      checks: dict[str, Column]) -> DataFrame:
    """Violation counts per rule: (rule, violations).

    A uniqueness rule counts the rows whose key occurs more than once; a
    check rule counts rows where the predicate is FALSE (NULL passes, as a
    CHECK constraint does). Check rules share one aggregation pass; each
    uniqueness rule is one partial+final grouping on its key.
    """
    parts = []
    if checks:
        agg = df.agg(*[F.count_if(~F.coalesce(c, F.lit(True))).alias(n) for n, c in checks.items()])
        stack = ", ".join(f"'{n}', `{n}`" for n in checks)
        parts.append(agg.selectExpr(f"stack({len(checks)}, {stack}) AS (rule, violations)"))
    for name, keys in unique.items():
        dup = (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
               .agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("violations"))
               .select(F.lit(name).alias("rule"), "violations"))
        parts.append(dup)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def rejected_rows(df: DataFrame, unique: dict[str, list[str]], checks: dict[str, Column]) -> DataFrame:
    """The violating rows themselves, tagged with the rule they break."""
    parts = [df.where(~F.coalesce(c, F.lit(True))).withColumn("rule", F.lit(n)) for n, c in checks.items()]
    for name, keys in unique.items():
        # duplicated keys by a partial+final count, joined back (a hot key is split
        # by the skew-join handling instead of landing in one window task)
        dup = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*keys)
        parts.append(df.join(dup, keys, "left_semi").withColumn("rule", F.lit(name)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def clean_weekly_sales(weekly: DataFrame, date_col: str = "week_date") -> DataFrame:
    """The cleaned weekly sales table (case 5 step 1): calendar parts, decoded
    segment, average transaction size, sales as BIGINT."""
    df = calendar_parts(weekly, date_col)
    df = decode_segment(df)
    df = safe_ratio(df, "sales", "transactions")
    return df.select(date_col, "week_number", "month_number", "calendar_year", "age_band", "demographic",
                     "avg_transaction", F.col("transactions").cast("bigint").alias("transactions"),
                     F.col("sales").cast("bigint").alias("sales"), "region", "platform", "customer_type",
                     "segment")
