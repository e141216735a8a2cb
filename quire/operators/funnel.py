"""Loyalty points, purchase funnel, visit summaries and top-k.

Visit-level facts (did the visit buy, which (page, event) pairs it holds)
are partially aggregated before they are shuffled, and everything after works
on distinct (visit, page, event) rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.numeric import percent
from quire.operators.joins import interval_join

# Event type codes of the web events.
VIEW, ADD_TO_CART, PURCHASE, IMPRESSION, CLICK = 1, 2, 3, 4, 5


def item_points(sales: DataFrame, key: str, price: str, item_col: str, bonus_item: str,
                rate: int = 10, bonus_rate: int = 20) -> DataFrame:
    """Points per key: price x rate, price x bonus_rate for the bonus item."""
    r = F.when(F.col(item_col) == bonus_item, F.lit(bonus_rate)).otherwise(F.lit(rate))
    return sales.groupBy(key).agg(F.sum(F.col(price) * r).cast("decimal(38,2)").alias("points"))


def join_week_points(sales: DataFrame, members: DataFrame, key: str, price: str, item_col: str,
                     bonus_item: str, cutoff: str, date_col: str = "order_date", join_col: str = "join_date",
                     days: int = 7, rate: int = 10, bonus_rate: int = 20) -> DataFrame:
    """Points of members up to ``cutoff``: bonus rate in the first ``days`` days from joining
    (join day included) or on the bonus item, base rate otherwise (W55). Sales are summed per
    (key, day, bonus item) before they meet the members, so a hot key brings its days."""
    s = (sales.where(F.col(date_col) <= F.lit(cutoff).cast("date"))
         .groupBy(key, date_col, (F.col(item_col) == bonus_item).alias("_bonus")).agg(F.sum(price).alias("_sum"))
         .join(members.select(key, join_col), key))
    bonus = F.datediff(date_col, join_col).between(0, days - 1) | F.col("_bonus")
    r = F.when(bonus, F.lit(bonus_rate)).otherwise(F.lit(rate))
    return s.groupBy(key).agg(F.sum(F.col("_sum") * r).cast("decimal(38,2)").alias("points"))


def visit_pairs(events: DataFrame, visit: str = "visit_id", page: str = "page_id",
                etype: str = "event_type") -> DataFrame:
    """Distinct (visit, page, event type) rows with the visit's buyer flag: a distinct (partial hash
    aggregation) and a left join of the buying visits; no visit is gathered."""
    pairs = events.select(visit, page, etype).distinct()
    buyers = events.where(F.col(etype) == PURCHASE).select(visit).distinct().withColumn("_b", F.lit(1))
    return pairs.join(buyers, visit, "left").select(visit, F.coalesce("_b", F.lit(0)).alias("buyer"), page, etype)


def item_funnel(events: DataFrame, pages: DataFrame, page: str = "page_id", etype: str = "event_type",
                name: str = "page_name", category: str = "product_category") -> DataFrame:
    """Per product page: visits viewing, visits adding to cart, adds in visits without a
    purchase (abandoned) and adds in buying visits (purchases) (W56).

    Products with no purchase or no abandonment are dropped, as an inner join of
    both would. Counts are taken per page before they meet the page table.
    """
    add = F.col(etype) == ADD_TO_CART
    measures = {"product_views": F.col(etype) == VIEW, "product_added_to_cart": add,
                "total_abandoned_carts": add & (F.col("buyer") == 0), "total_purchases": add & (F.col("buyer") == 1)}
    per_page = visit_pairs(events, page=page, etype=etype).groupBy(page).agg(
        *[F.count_if(c).alias(m) for m, c in measures.items()])
    p = pages.where(F.col(category).isNotNull()).select(page, name, category)
    f = per_page.join(p, page).groupBy(name, category).agg(*[F.sum(m).alias(m) for m in measures])
    return f.where((F.col("total_abandoned_carts") > 0) & (F.col("total_purchases") > 0))


FUNNEL_MEASURES = ["product_views", "product_added_to_cart", "total_abandoned_carts", "total_purchases"]


def category_funnel(funnel: DataFrame, category: str = "product_category") -> DataFrame:
    """The product funnel rolled up to categories."""
    return funnel.groupBy(category).agg(*[F.sum(m).alias(m) for m in FUNNEL_MEASURES])


def funnel_leaders(funnel: DataFrame, name: str = "page_name") -> DataFrame:
    """Products leading on views, cart adds or purchases (ties by name).

    Leaders are found with ``min_by`` over (−measure, name) — an aggregate,
    not a single-partition global window.
    """
    def lead(m):
        return F.min_by(F.col(name), F.struct(-F.col(m), F.col(name)))

    leaders = (funnel.agg(F.array(lead("product_views"), lead("product_added_to_cart"),
                                  lead("total_purchases")).alias("_l"))
               .select(F.explode("_l").alias(name)).distinct())
    return (funnel.join(leaders, name, "left_semi")
            .select(F.col(name).alias("product"), "product_views", "product_added_to_cart", "total_purchases"))


def top_k(df: DataFrame, keys: list[str], metric: Column | None = None, k: int = 3,
          name: str = "n") -> DataFrame:
    """The k keys with the largest metric (count of rows by default), ties by key."""
    agg = metric if metric is not None else F.count(F.lit(1))
    return (df.groupBy(*keys).agg(agg.alias(name))
            .orderBy(F.col(name).desc(), *keys).limit(k))


def top_by(df: DataFrame, metric: str, name: str, k: int = 1) -> DataFrame:
    """Top-k rows of an already aggregated frame by a column, ties by name."""
    return df.orderBy(F.col(metric).desc(), F.col(name)).limit(k)


def conversion_means(funnel: DataFrame) -> DataFrame:
    """Mean view->cart and cart->purchase percentages over products."""
    def ratio(a, b):
        return F.col(a).cast("double") * 100.0 / F.col(b).cast("double")
    return funnel.agg(F.round(F.avg(ratio("product_added_to_cart", "product_views")), 4).alias("view_to_cart_add_perc"),
                      F.round(F.avg(ratio("total_purchases", "product_added_to_cart")), 4)
                      .alias("cart_add_to_purchase_perc"))


def visit_summary(events: DataFrame, campaigns: DataFrame, visit: str = "visit_id", user: str = "user_id",
                  ts: str = "event_time", etype: str = "event_type") -> DataFrame:
    """One row per visit: user, start time, page views, cart adds, purchase flag,
    impressions, clicks, and the campaign(s) whose closed interval holds the start (W57)."""
    e = F.col(etype)
    v = events.groupBy(user, visit).agg(
        F.min(ts).alias("visit_start_time"),
        F.count_if(e == VIEW).alias("page_views"),
        F.count_if(e == ADD_TO_CART).alias("cart_adds"),
        F.max((e == PURCHASE).cast("int")).alias("purchase"),
        F.count_if(e == IMPRESSION).alias("impression"),
        F.count_if(e == CLICK).alias("click"))
    j = interval_join(v, campaigns, "visit_start_time", "start_date", "end_date")
    return j.select(user, visit, "visit_start_time", "page_views", "cart_adds", "purchase", "campaign_name",
                    "impression", "click")


SKETCH_ROWS = 2          # hash functions of the sketch of counts
SKETCH_CELLS = 16_384    # cells of each


def top_k_by_sketch(df: DataFrame, key: str, k: int, name: str = "n") -> DataFrame:
    """The ``k`` most frequent values of ``key`` with their counts, ties with the k-th kept (W13, W58), for
    keys with very many distinct values: three phases, of which only the last counts values.

    1. A sketch: each task adds up its rows per cell, a few thousand cells for each hash function. The
       smaller of a value's cells is an upper bound of its count.
    2. A lower bound: the values of the first function's ``k`` largest cells, at least ``k`` values, are
       counted exactly; the k-th largest of these counts is at most the k-th largest of all.
    3. The values whose upper bound reaches the lower bound are counted exactly.

    The result is exact whatever the distribution. What is saved is the shuffle of the values that
    cannot be among the first: nearly all of them where counts are uneven, none where all are equal. The
    sketch has ``SKETCH_ROWS`` x ``SKETCH_CELLS`` numbers at most and comes to the tasks as an array in a
    scalar subquery. Null is no value.
    """
    exact = top_k_candidates(df, key, k).groupBy("_v").agg(F.count(F.lit(1)).alias(name))
    kth = exact.select(name).orderBy(F.desc(name)).limit(k).agg(F.min(name)).scalar()
    return exact.where(F.col(name) >= kth).select(F.col("_v").alias(key), name)


def top_k_candidates(df: DataFrame, key: str, k: int) -> DataFrame:
    """The rows (_v) of the values that the first two phases of ``top_k_by_sketch`` leave."""
    rows = df.select(F.col(key).alias("_v")).where("_v IS NOT NULL")

    def cell(i):
        return F.pmod(F.xxhash64(F.lit(i), F.col("_v")), F.lit(SKETCH_CELLS)).cast("int")

    counted = (rows.select(F.explode(F.array(*[cell(i) + i * SKETCH_CELLS for i in range(SKETCH_ROWS)])).alias("c"))
               .groupBy("c").agg(F.count(F.lit(1)).alias("n")))
    every = df.sparkSession.range(SKETCH_ROWS * SKETCH_CELLS).select(F.col("id").cast("int").alias("i"))
    sketch = (every.join(counted, F.col("i") == F.col("c"), "left")
              .agg(F.sort_array(F.collect_list(F.struct("i", F.coalesce("n", F.lit(0)).alias("n")))).alias("all"))
              .select(F.col("all.n").alias("a")))
    bound = F.least(*[F.get(sketch.scalar(), cell(i) + i * SKETCH_CELLS) for i in range(SKETCH_ROWS)])
    cells = F.sort_array(F.slice("a", 1, SKETCH_CELLS), asc=False)
    large = sketch.select(F.greatest(F.get(cells, F.lit(k - 1)), F.lit(1)).alias("n")).scalar()
    bounded = rows.withColumn("_upper", bound)
    first = rows.where(F.get(sketch.scalar(), cell(0)) >= large).groupBy("_v").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n")).limit(k)
    lower = first.agg(F.when(F.count(F.lit(1)) >= k, F.min("n")).otherwise(0)).scalar()
    return bounded.where(F.col("_upper") >= lower).select("_v")


def viewed_without_buying(events: DataFrame, page_value, visit: str = "visit_id", page: str = "page_id",
                          etype: str = "event_type") -> DataFrame:
    """Percent of visits on a page that never buy; the numerator counts distinct
    (visit, page, event) rows of those visits, as the reference does (W58)."""
    on_page = F.col(page) == page_value
    per_visit = events.groupBy(visit).agg(
        F.max(on_page.cast("int")).alias("_on"),
        F.max((F.col(etype) == PURCHASE).cast("int")).alias("_buyer"),
        F.size(F.collect_set(F.when(on_page, F.col(etype)))).alias("_pairs"))
    return (per_visit.agg(F.sum(F.when(F.col("_buyer") == 0, F.col("_pairs")).otherwise(0)).alias("_n"),
                          F.sum("_on").alias("_d"))
            .select(percent("_n", "_d").alias("checkout_without_purchase_perc")))
