"""Window and state-over-time operators.

Scale notes
-----------
* "first/last row per key" is an aggregate (``min_by``/``max_by`` over a
  struct of the ordering columns), not a window: it runs partial before
  the shuffle, so a key holding a third of all rows costs one row per task.
* Running balances are computed on per-(key, day) pre-aggregates — at most
  one row per key per calendar day reaches the window — and joined back
  to the detail rows on (key, day), which reproduces the RANGE frame
  (same-day rows share one total) exactly.
* Global windows (no PARTITION BY) only ever run over already-aggregated,
  calendar-bounded frames (one row per month).
* Operators that must see every row of a key in order (lead/lag of state
  sequences, payment schedules) use ``sequence``, which works per (key, day).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.calendar import sunday_weeks_between
from quire.functions.numeric import mean4, mean_exact, percent, trunc_div
from quire.operators.sequence import has_hot_key, hot_cuts, in_ranges, range_count, sequence


def first_per_key(df: DataFrame, key: str, order_cols: list[str], cols: list[str]) -> DataFrame:
    """The first row per key under a total order, as one partial+final aggregate."""
    pick = F.min_by(F.struct(*cols), F.struct(*order_cols)).alias("_first")
    return df.groupBy(key).agg(pick).select(key, "_first.*")


def top_by_count_per_key(df: DataFrame, key: str, item: str, count_name: str = "n") -> DataFrame:
    """Most frequent item(s) per key, ties kept."""
    counts = df.groupBy(key, item).agg(F.count(F.lit(1)).alias(count_name))
    w = Window.partitionBy(key).orderBy(F.col(count_name).desc())
    return counts.withColumn("_r", F.rank().over(w)).where("_r = 1").drop("_r")


def state_sequence(df: DataFrame, key: str, order_cols: list[str], state: str = "plan_id",
                   date_col: str | None = None) -> DataFrame:
    """Each state row with its position ``rn``, ``prev_state`` and ``next_state``
    (and ``next_date`` when ``date_col`` is given) per key."""
    lead = [state] + ([date_col] if date_col else [])
    s = sequence(df, [key], order_cols, lag_cols=[state], lead_cols=lead)
    s = s.withColumnRenamed(f"prev_{state}", "prev_state").withColumnRenamed(f"next_{state}", "next_state")
    return s.withColumnRenamed(f"next_{date_col}", "next_date") if date_col else s


def _first_rows(df: DataFrame, key: str, order_cols: list[str], state: str, n: int) -> DataFrame:
    """(key, state, rn) of the first ``n`` rows per key: a row number with an upper bound is planned
    as a group limit on both sides of the shuffle, so a hot key sends ``n`` rows per task."""
    w = Window.partitionBy(key).orderBy(*order_cols)
    cols = list(dict.fromkeys([key, state, *order_cols]))
    return df.select(*cols).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).select(key, state, "rn")


def nth_state(df: DataFrame, key: str, order_cols: list[str], n: int = 2, state: str = "plan_id") -> DataFrame:
    """Distribution of the n-th state over keys, with percent of all keys."""
    per = _first_rows(df, key, order_cols, state, n).groupBy(state).agg(
        F.count_if(F.col("rn") == n).alias("n_customers"), F.count_if((F.col("rn") == 1) & F.col(key).isNotNull()).alias("_f"))
    total = F.sum("_f").over(Window.partitionBy())  # one row per state
    return (per.withColumn("_total", total).where("n_customers > 0")
            .select(state, "n_customers", percent(F.col("n_customers"), F.col("_total")).alias("percent")))


def immediate_transition_share(df: DataFrame, key: str, order_cols: list[str], frm, to,
                               state: str = "plan_id") -> DataFrame:
    """Keys whose second state is ``to`` straight after a first state ``frm``."""
    two = _first_rows(df, key, order_cols, state, 2).groupBy(key).agg(
        F.max(F.when(F.col("rn") == 1, F.col(state))).alias("_1"), F.max(F.when(F.col("rn") == 2, F.col(state))).alias("_2"))
    return (two.agg(F.count_if((F.col("_1") == frm) & (F.col("_2") == to)).alias("n_customers"),
                    F.count(key).alias("_total"))
            .select("n_customers", percent(F.col("n_customers"), F.col("_total")).alias("percent")))


def later_state_in_year(df: DataFrame, key: str, order_cols: list[str], to, year: int,
                        date_col: str = "start_date", state: str = "plan_id") -> DataFrame:
    """Distinct keys that reached ``to`` as a non-first state within ``year`` (W45): the last such
    row of the key lies after the key's first row. One partial aggregation, no ordering."""
    at = F.struct(*order_cols)
    per = df.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.min(at).alias("_first"), F.max(F.when((F.col(state) == to) & (F.year(date_col) == year), at)).alias("_hit"))
    return per.agg(F.count_if(F.col("_hit") > F.col("_first")).alias("n_customers"))


def downgrade_count(df: DataFrame, key: str, order_cols: list[str], frm, to, year: int,
                    date_col: str = "start_date", state: str = "plan_id") -> DataFrame:
    """Rows whose *next* state is ``to`` after ``frm``, the change dated in ``year``.

    The next state is taken before filtering (the filter-then-lead form
    can never see a change).
    """
    s = state_sequence(df, key, order_cols, state, date_col=date_col)
    return (s.where((F.col(state) == frm) & (F.col("next_state") == to) & (F.year("next_date") == year))
            .agg(F.count(F.lit(1)).alias("n_downgrades")))


def path_counts(df: DataFrame, key: str, order_cols: list[str], paths: dict[str, list[tuple]],
                state: str = "plan_id") -> DataFrame:
    """Keys whose history follows each of several paths (W45): (path, n_customers).

    A path is a list of (wanted state, states that must not come before it); a forbidden state sends the
    key back to the path's start. ``[(a, []), (c, [b])]`` is "a, then never b, then c", with anything
    else in between.

    A path is a small automaton. A piece of a key's history, in order, is a map from the automaton's
    state before it to the one after it; the maps of a key's pieces are composed in order. A hot key's
    history is cut into ranges (as in ``sequence``), so no key is gathered: what meets in one row is a
    range's rows, then one map per range. Rows without a key are left out.
    """
    rows = df.where(F.col(key).isNotNull()).select(*dict.fromkeys([key, *order_cols, state]))
    ranges = range_count(rows)
    if has_hot_key(rows, [key], ranges):
        k = F.struct(F.col(key).alias("k0"))
        place = F.struct(k.alias("k"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order_cols)])
        rows = in_ranges(rows, hot_cuts(rows, place, ranges), place, k, ranges)
    else:
        rows = rows.withColumn("_b", F.lit(0))
    pieces = rows.groupBy(key, "_b").agg(F.array_sort(F.collect_list(F.struct(*order_cols, F.col(state).alias("_s")))).alias("_h"))

    def after(steps, at, event):
        out = at
        for i, (wanted, never) in reversed(list(enumerate(steps))):
            moved = F.when(event == wanted, F.lit(i + 1))
            for x in never:
                moved = moved.when(event == x, F.lit(0))
            out = F.when(at == i, moved.otherwise(at)).otherwise(out)
        return out

    def piece_map(steps):
        return F.aggregate("_h", F.array(*[F.lit(i) for i in range(len(steps) + 1)]),
                           lambda m, x: F.transform(m, lambda at: after(steps, at, x["_s"])))

    def end(i):
        return F.aggregate("_ms", F.lit(0), lambda at, x: F.get(x[f"m{i}"], at))

    maps = [piece_map(p).alias(f"m{i}") for i, p in enumerate(paths.values())]
    per = pieces.select(key, F.struct("_b", *maps).alias("_m")).groupBy(key).agg(
        F.array_sort(F.collect_list("_m")).alias("_ms"))
    done = per.agg(*[F.count_if(end(i) == len(p)).alias(f"n{i}") for i, p in enumerate(paths.values())])
    return done.select(F.inline(F.array(*[F.struct(F.lit(n).alias("path"), F.col(f"n{i}").alias("n_customers")) for i, n in enumerate(paths)])))


def state_asof_written(df: DataFrame, key: str, asof: str, trial_days: int = 7,
                       state: str = "plan_id", date_col: str = "start_date",
                       trial_state=0, end_state=4) -> DataFrame:
    """Plan counts at a date, counting every state that was ever paid (W46, as written).

    Paid states starting strictly before the date, plus trial states that
    started in the week ending on the date; percent of the distinct (key, state)
    pairs. One scan, one filter.
    """
    d = F.lit(asof).cast("date")
    started = F.col(date_col)
    counted = F.when(F.col(state) == trial_state, started.between(F.date_sub(d, trial_days - 1), d)).otherwise(
        (F.col(state) != end_state) & (started < d))
    return _state_shares(df.where(counted).select(key, state).distinct(), key, state)


def _state_shares(pairs: DataFrame, key: str, state: str) -> DataFrame:
    """Keys per state and their percent of all (key, state) rows; the total is that of the state rows."""
    per = pairs.groupBy(state).agg(F.count(key).alias("n_customers"), F.count(F.lit(1)).alias("_n"))
    total = F.sum("_n").over(Window.partitionBy())
    return (per.withColumn("_total", total)
            .select(state, "n_customers", percent(F.col("n_customers"), F.col("_total")).alias("percent")))


def state_asof_latest(df: DataFrame, key: str, asof: str, order_cols: list[str],
                      state: str = "plan_id", date_col: str = "start_date") -> DataFrame:
    """The state each key is in on a date — its latest row on or before it (W46, as-of form)."""
    d = F.lit(asof).cast("date")
    latest = (df.where(F.col(date_col) <= d).groupBy(key)
              .agg(F.max_by(state, F.struct(*order_cols)).alias(state)))
    per = latest.groupBy(state).agg(F.count(F.lit(1)).alias("n_customers"))
    total = F.sum("n_customers").over(Window.partitionBy())
    return (per.withColumn("_total", total)
            .select(state, "n_customers", percent(F.col("n_customers"), F.col("_total")).alias("percent")))


def state_mix(df: DataFrame, key: str, order_cols: list[str], state: str = "plan_id",
              date_col: str = "start_date") -> DataFrame:
    """``state_asof_latest`` for every month end at once (W46): keys per state and their percent.

    A sweep line: a state row adds one to its state on its date and takes one from the state it ends
    (the key's previous row, from ``sequence``), so the number of keys in a state at a date is a prefix
    sum. The events are summed per (month, state) before anything is accumulated; the sums then run over
    calendar months, from the first row's month to the last one's. States with no key at a month end
    have no row there, as in the as-of query. Rows without a date are left out.
    """
    rows = df.where(F.col(date_col).isNotNull())
    seq = sequence(rows.select(*dict.fromkeys([key, state, date_col, *order_cols])), [key], order_cols, lag_cols=[state], rn_name="_rn")
    events = seq.select(F.last_day(date_col).alias("month_end"), F.explode(F.array(
        F.struct(F.col(state).alias("s"), F.lit(1).alias("d")),
        F.struct(F.col(f"prev_{state}").alias("s"), F.when(F.col("_rn") > 1, -1).otherwise(0).alias("d")))).alias("e"))
    sums = events.groupBy("month_end", F.col("e.s").alias("_s")).agg(F.sum("e.d").alias("_d"))
    months = sums.agg(F.min("month_end").alias("a"), F.max("month_end").alias("z")).select(F.transform(
        F.sequence(F.trunc("a", "month"), F.trunc("z", "month"), F.expr("interval 1 month")), F.last_day)).scalar()
    grid = sums.select("_s").distinct().withColumn("month_end", F.explode(months))  # calendar months times states
    dense = grid.join(sums.select(F.col("month_end").alias("_m"), F.col("_s").alias("_t"), "_d"),
                      (F.col("month_end") == F.col("_m")) & F.col("_s").eqNullSafe(F.col("_t")), "left")
    upto = F.sum(F.coalesce("_d", F.lit(0))).over(Window.partitionBy("_s").orderBy("month_end"))
    mix = dense.select("month_end", F.col("_s").alias(state), upto.alias("n_customers")).where("n_customers > 0")
    total = F.sum("n_customers").over(Window.partitionBy("month_end"))
    return mix.withColumn("_total", total).select("month_end", state, "n_customers", percent(F.col("n_customers"), F.col("_total")).alias("percent"))


def missing_runs(df: DataFrame, col: str, names=("first_missing", "last_missing")) -> DataFrame:
    """Runs of whole numbers (or dates) between the smallest and the largest value of ``col`` that never
    occur, as (first, last, length) of each run (gaps and islands, W29).

    The domain may have any size: nothing is generated. Distinct values are scanned in order over
    ranges (``sequence`` without a key), so each value sees its successor although the neighbours may
    be in different tasks. Nulls are no values."""
    values = df.select(F.col(col).alias("_v")).where("_v IS NOT NULL").distinct()
    is_date = dict(df.dtypes)[col] == "date"
    step = (lambda c, n: F.date_add(c, n)) if is_date else (lambda c, n: c + n)
    length = (F.datediff("next__v", "_v") if is_date else F.col("next__v") - F.col("_v")) - 1
    seq = sequence(values, [], ["_v"], lead_cols=["_v"], rn_name="_rn")
    return seq.where(length > 0).select(step(F.col("_v"), 1).alias(names[0]), step(F.col("next__v"), -1).alias(names[1]),
                                        length.cast("bigint").alias("n_missing"))


def prefix_cube(df: DataFrame, date_col: str, dims: list[str], value: str = "sales") -> DataFrame:
    """(dimension, value, week, upto): per value of each dimension and Sunday week, the sum of ``value`` up
    to the end of that week, for every week from the first to the last of the table (W52). Any span of
    weeks is the difference of two rows. Meant to be stored; its size is that of the calendar times
    the dimensions' values, and the table is read once (one grouping-sets pass)."""
    week = F.date_sub(F.col(date_col), F.dayofweek(date_col) - 1)
    sums = df.where(F.col(date_col).isNotNull()).groupBy(week.alias("week"), *dims).agg(F.sum(value).alias("_sum"))
    g = sums.groupingSets([["week", d] for d in dims], "week", *dims).agg(F.sum("_sum").alias("_sum"), F.grouping_id().alias("_gid"))
    dim, val = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, d in enumerate(dims):
        here = F.col("_gid") == (1 << len(dims)) - 1 - (1 << (len(dims) - 1 - i))
        dim, val = F.when(here, d).otherwise(dim), F.when(here, F.col(d).cast("string")).otherwise(val)
    g = g.select("week", dim.alias("dimension"), val.alias("value"), "_sum")
    weeks = sums.agg(F.min("week").alias("a"), F.max("week").alias("z")).select(F.sequence("a", "z", F.expr("interval 7 days"))).scalar()
    grid = g.select("dimension", "value").distinct().withColumn("week", F.explode(weeks))  # calendar weeks times dimension values
    of = g.select(F.col("week").alias("_w"), F.col("dimension").alias("_dim"), F.col("value").alias("_val"), "_sum")
    dense = grid.join(of, (F.col("week") == F.col("_w")) & (F.col("dimension") == F.col("_dim")) & F.col("value").eqNullSafe(F.col("_val")), "left")
    upto = F.sum("_sum").over(Window.partitionBy("dimension", "value").orderBy("week"))
    return dense.select("dimension", "value", "week", F.coalesce(upto, F.lit(0)).cast("bigint").alias("upto"))


def cube_before_after(cube: DataFrame, weeks: int) -> DataFrame:
    """``before_after_by_dimension`` for every anchor week at once, from a ``prefix_cube`` alone (W52): the
    ``weeks`` weeks before the anchor's week and the ``weeks`` weeks from it, each the difference of
    two rows. Anchors whose weeks are not all inside the table are left out."""
    w = Window.partitionBy("dimension", "value").orderBy("week")
    # upto before the week, before the earlier weeks, and at the end of the later ones
    at = cube.withColumns({"_mid": F.lag("upto", 1).over(w), "_from": F.lag("upto", weeks + 1).over(w), "_to": F.lead("upto", weeks - 1).over(w),
                           "_n": F.row_number().over(w)})
    at = at.where((F.col("_n") > weeks) & F.col("_to").isNotNull())
    before = (F.col("_mid") - F.coalesce("_from", F.lit(0))).alias("total_sales_before")
    return at.select("dimension", "value", "week", before, (F.col("_to") - F.col("_mid")).alias("total_sales_after")).select(
        "dimension", "value", "week", *_change_columns("total_sales_before", "total_sales_after"))


def days_between_states(df: DataFrame, key: str, a, b, state: str = "plan_id",
                        date_col: str = "start_date") -> DataFrame:
    """Per key: days from its first ``a`` state to its first ``b`` state (positive only)."""
    per = df.groupBy(key).agg(
        F.min(F.when(F.col(state) == a, F.col(date_col))).alias("_a"),
        F.min(F.when(F.col(state) == b, F.col(date_col))).alias("_b"))
    return per.select(key, F.datediff("_b", "_a").alias("days")).where(F.col("days") > 0)


def avg_days_between_states(df: DataFrame, key: str, a, b, **kw) -> DataFrame:
    """Mean days from first ``a`` to first ``b`` over keys that have both."""
    d = days_between_states(df, key, a, b, **kw)
    return d.agg(mean4("days").alias("avg_days"), F.count(F.lit(1)).alias("n_customers"))


def bucket_histogram(values: DataFrame, col: str, width: int = 30) -> DataFrame:
    """Closed buckets [w*k, w*k + w - 1] for k = 0..max//w with mean and count; empty buckets kept.

    Bucket ids come from arithmetic (no range join); the bucket list is
    generated from the maximum, a one-row aggregate, so nothing passes
    through the driver.
    """
    b = F.floor(F.col(col) / width).cast("int")
    stats = (values.where(F.col(col) > 0).groupBy(b.alias("_b"))
             .agg(mean4(col).alias("average_days"), F.count(F.lit(1)).alias("customer_count")))
    buckets = (values.where(F.col(col) > 0).agg(F.max(b).alias("_m"))
               .select(F.explode(F.sequence(F.lit(0), F.col("_m"))).alias("_b")))
    return (buckets.join(stats, "_b", "left")
            .select((F.col("_b") * width).alias("r_from"), (F.col("_b") * width + width - 1).alias("r_to"),
                    "average_days", F.coalesce("customer_count", F.lit(0)).alias("customer_count")))


def expand_schedule(df: DataFrame, horizon_end: str, key: str = "customer_id", state: str = "plan_id",
                    date_col: str = "start_date", amount: str = "price", tie: str = "event_id",
                    once_state=3, end_state=4, skip_state=0, prorate_days: int = 30) -> DataFrame:
    """Recurring payment schedule.

    Each paid state pays on its start date and then monthly (dates anchored
    to the start: start + i months) strictly before the next state's start
    or, for the last state, up to the horizon; a once-only state pays once;
    the end state pays nothing. A payment made within ``prorate_days`` of a
    payment for a different state is reduced by that payment's amount.
    ``payment_order`` ranks the payments per key by date (ties share a rank).

    Both per-key orderings (next state start; previous payment) use
    ``sequence``, so a key with very many states is spread over its days;
    the rank only needs a window per (key, payment date).
    """
    h = F.lit(horizon_end).cast("date")
    s = df.where((F.col(state) != skip_state) & (F.col(date_col) <= h))
    s = sequence(s, [key], [date_col, tie], lead_cols=[date_col], rn_name="_srn") \
        .withColumnRenamed(f"next_{date_col}", "_next").drop("_srn")
    end = (F.when(F.col(state) == once_state, F.col(date_col))
           .when(F.col(state) == end_state, F.lit(None).cast("date"))
           .otherwise(F.coalesce("_next", h)))
    s = s.withColumn("_end", end)
    n = F.floor(F.months_between("_end", date_col)).cast("int") + 1
    s = s.withColumn("_i", F.explode(F.sequence(F.lit(0), F.greatest(n, F.lit(0)))))
    s = (s.withColumn("payment_date", F.add_months(date_col, F.col("_i")))
         .where(((F.col("_i") == 0) & (F.col(date_col) <= F.col("_end")))
                | ((F.col("_i") >= 1) & (F.col("payment_date") < F.col("_end"))))
         .select(key, state, tie, "_i", "payment_date", amount))
    p = sequence(s, [key], ["payment_date", state, tie, "_i"], lag_cols=[state, "payment_date", amount])
    amt = (F.when((F.col(f"prev_{state}") != F.col(state))
                  & (F.datediff("payment_date", "prev_payment_date") < prorate_days),
                  F.col(amount) - F.col(f"prev_{amount}"))
           .otherwise(F.col(amount)))
    peer = Window.partitionBy(key, "payment_date").orderBy(state, tie, "_i")
    order = (F.col("rn") - F.row_number().over(peer) + 1).cast("int")
    return p.select(key, state, "payment_date", amt.cast("decimal(7,2)").alias("amount"),
                    order.alias("payment_order"))


def period_growth(df: DataFrame, date_col: str, count_name: str = "current_number_of_customers") -> DataFrame:
    """Rows per (year, month), the previous month's count and truncated percent growth text.

    The global lag runs over the monthly aggregate (one row per calendar
    month), never over raw rows.
    """
    m = df.groupBy(F.year(date_col).alias("year"), F.month(date_col).alias("month")).agg(
        F.count(F.lit(1)).alias(count_name))
    w = Window.orderBy("year", "month")
    prev = F.lag(count_name).over(w)
    return (m.withColumn("past_number_of_customers", prev)
            .withColumn("growth", F.concat(trunc_div(100 * (F.col(count_name) - F.col("past_number_of_customers")),
                                                     F.col("past_number_of_customers")).cast("string"),
                                           F.lit("%"))))


def signed(df: DataFrame, type_col: str = "txn_type", amount: str = "txn_amount", positive: str = "deposit",
           name: str = "signed_amount") -> DataFrame:
    return df.withColumn(name, F.when(F.col(type_col) == positive, F.col(amount)).otherwise(-F.col(amount)))


def period_balance(df: DataFrame, key: str, date_col: str, value: str, period: str = "month") -> DataFrame:
    """Net value per (key, period) and the closing balance: running sum over periods."""
    m = df.groupBy(key, F.trunc(date_col, period).cast("date").alias(period)).agg(
        F.sum(value).alias("monthly_balance"))
    w = Window.partitionBy(key).orderBy(period)
    return m.withColumn("closing_balance", F.sum("monthly_balance").over(w))


def daily_running(df: DataFrame, key: str, date_col: str, value: str) -> DataFrame:
    """Per (key, day): the day's net and the running balance at the end of the day."""
    d = df.groupBy(key, date_col).agg(F.sum(value).alias("_day"))
    w = Window.partitionBy(key).orderBy(date_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return d.withColumn("running_balance", F.sum("_day").over(w)).drop("_day")


def running_balance(df: DataFrame, key: str, date_col: str, value: str) -> DataFrame:
    """Running signed sum per key in date order; rows of one date share the total.

    Equal to ``sum(value) OVER (PARTITION BY key ORDER BY date)`` (RANGE
    frame), computed on per-day pre-aggregates and joined back on
    (key, date), so the window sees one row per key-day.
    """
    return df.join(daily_running(df, key, date_col, value), [key, date_col])


def period_end_balance(df: DataFrame, key: str, date_col: str, value: str, period: str = "month") -> DataFrame:
    """Balance at the last transaction date of each (key, period)."""
    d = daily_running(df, key, date_col, value)
    return (d.groupBy(key, F.trunc(date_col, period).cast("date").alias(period))
            .agg(F.max_by("running_balance", date_col).alias("end_balance")))


def balance_growth_share(df: DataFrame, key: str, date_col: str, value: str, threshold: int = 5) -> DataFrame:
    """Percent (truncated) of keys whose positive closing balance rose by more than
    ``threshold`` percent (truncated) over their previous positive month (W51)."""
    pb = period_balance(df, key, date_col, value).where(F.col("closing_balance") > 0)
    w = Window.partitionBy(key).orderBy("month")
    g = pb.withColumn("_prev", F.lag("closing_balance").over(w))
    inc = trunc_div((F.col("closing_balance") - F.col("_prev")) * 100, F.col("_prev"))
    grown = g.where(inc > threshold).agg(F.countDistinct(key).alias("n_growing"))
    total = df.select(F.countDistinct(key)).scalar()
    # bind the scalar subquery once as a column, then use the column
    return (grown.select("n_growing", total.alias("total_customers"))
            .withColumn("cust_perc", trunc_div(F.col("n_growing") * 100, F.col("total_customers"))))


def min_avg_max(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.min(value).alias("min_bal"), mean_exact(value).alias("avg_bal"),
                               F.max(value).alias("max_bal"))


def interval_length(df: DataFrame, start: str, end: str, open_end: str) -> DataFrame:
    """Mean length in days of closed intervals; the open-end sentinel is excluded."""
    closed = df.where(F.col(end) != F.lit(open_end).cast("date"))
    return closed.agg(mean4(F.datediff(end, start)).alias("average_days"))


def speed(distance: Column | str, minutes: Column | str) -> Column:
    """distance / (minutes / 60) rounded half-up to 2 places, exact decimal arithmetic."""
    d = (distance if isinstance(distance, Column) else F.col(distance)).cast("decimal(12,2)")
    m = (minutes if isinstance(minutes, Column) else F.col(minutes)).cast("decimal(12,0)")
    return F.round(F.try_divide(d * 60, m), 2).cast("decimal(12,2)")


def _change_columns(before: str, after: str) -> list[Column]:
    return [F.col(before), F.col(after), (F.col(after) - F.col(before)).alias("change_in_sales"),
            percent(F.col(after) - F.col(before), F.col(before)).alias("percentage_of_change")]


def before_after_label(df: DataFrame, date_col: str, anchor: str, weeks: int, name: str = "period",
                       before: str = "before", after: str = "after") -> DataFrame:
    """Adds the label of the row's side of an anchor date: within ``weeks`` Sunday-bounded weeks
    before it, from it on, or null outside both (W52)."""
    off = sunday_weeks_between(F.col(date_col), F.lit(anchor).cast("date"))
    return df.withColumn(name, F.when(off.between(1, weeks), before).when(off.between(-(weeks - 1), 0), after))


def before_after(df: DataFrame, date_col: str, anchor: str, weeks: int, value: str = "sales",
                 by: list[str] | None = None) -> DataFrame:
    """Sum of ``value`` in the ``weeks`` weeks before an anchor date and the ``weeks`` weeks
    from it, the change and its percent (W52).

    Weeks are counted in Sunday boundaries from the row's date to the anchor:
    before = 1..weeks, after = -(weeks-1)..0. Both sums come from one pass
    of conditional sums (no self-join of two filtered scans); groups
    missing either side are dropped.
    """
    off = sunday_weeks_between(F.col(date_col), F.lit(anchor).cast("date"))
    b = F.sum(F.when(off.between(1, weeks), F.col(value))).cast("bigint").alias("total_sales_before")
    a = F.sum(F.when(off.between(-(weeks - 1), 0), F.col(value))).cast("bigint").alias("total_sales_after")
    scoped = df.where(off.between(-(weeks - 1), weeks))
    g = scoped.groupBy(*by).agg(b, a) if by else scoped.agg(b, a)
    g = g.where(F.col("total_sales_before").isNotNull() & F.col("total_sales_after").isNotNull())
    return g.select(*(by or []), *_change_columns("total_sales_before", "total_sales_after"))


def before_after_by_week_number(df: DataFrame, week_col: str, anchor_week: int, weeks: int,
                                by: list[str], value: str = "sales") -> DataFrame:
    """Per group: sum over week numbers [anchor-weeks, anchor-1] versus
    [anchor, anchor+weeks-1] (the per-year comparison of W52)."""
    w = F.col(week_col)
    b = F.sum(F.when(w.between(anchor_week - weeks, anchor_week - 1), F.col(value))).cast("bigint")
    a = F.sum(F.when(w.between(anchor_week, anchor_week + weeks - 1), F.col(value))).cast("bigint")
    g = (df.where(w.between(anchor_week - weeks, anchor_week + weeks - 1)).groupBy(*by)
         .agg(b.alias("total_sales_before"), a.alias("total_sales_after")))
    g = g.where(F.col("total_sales_before").isNotNull() & F.col("total_sales_after").isNotNull())
    return g.select(*by, *_change_columns("total_sales_before", "total_sales_after"))


def before_after_by_dimension(df: DataFrame, date_col: str, anchor: str, weeks: int, dims: list[str],
                              value: str = "sales") -> DataFrame:
    """W52 for each of several dimensions at once: (dimension, value) rows.

    One ``GROUPING SETS ((d1), (d2), ...)`` aggregation — a single scan
    expanded once per dimension and aggregated partial + final — instead of
    one scan and one join per dimension; ``grouping_id()`` tells which
    dimension a row belongs to.
    """
    off = sunday_weeks_between(F.col(date_col), F.lit(anchor).cast("date"))
    scoped = df.where(off.between(-(weeks - 1), weeks)).withColumn("_off", off)
    b = F.sum(F.when(F.col("_off").between(1, weeks), F.col(value))).cast("bigint").alias("total_sales_before")
    a = F.sum(F.when(F.col("_off").between(-(weeks - 1), 0), F.col(value))).cast("bigint").alias("total_sales_after")
    g = scoped.groupingSets([[d] for d in dims], *dims).agg(b, a, F.grouping_id().alias("_gid"))
    full = (1 << len(dims)) - 1
    gid = {d: full - (1 << (len(dims) - 1 - i)) for i, d in enumerate(dims)}
    dim = F.lit(None).cast("string")
    val = F.lit(None).cast("string")
    for d in reversed(dims):
        dim = F.when(F.col("_gid") == gid[d], F.lit(d)).otherwise(dim)
        val = F.when(F.col("_gid") == gid[d], F.col(d).cast("string")).otherwise(val)
    g = g.where(F.col("total_sales_before").isNotNull() & F.col("total_sales_after").isNotNull())
    return g.select(dim.alias("dimension"), val.alias("value"),
                    *_change_columns("total_sales_before", "total_sales_after"))
