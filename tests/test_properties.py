"""Property tests: the ordered sequence and the exact-arithmetic helpers against their definitions."""

from decimal import ROUND_HALF_UP, Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.functions.numeric import mean_exact, percent, trunc_div
from quire.operators.sequence import sequence

SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])

rows_strategy = st.lists(
    st.tuples(st.sampled_from([1, 1, 1, 2, 3, None]), st.integers(0, 5), st.integers(-3, 3)),
    min_size=1, max_size=60)


@SETTINGS
@given(rows=rows_strategy)
def test_sequence_equals_window(spark, rows):
    data = [(k, o, v, i) for i, (k, o, v) in enumerate(rows)]  # i: unique tie-break
    df = spark.createDataFrame(data, "k int, o int, v int, i int")
    got = sequence(df, ["k"], ["o", "i"], lag_cols=["v"], lead_cols=["v", "o"])
    got_rows = sorted(tuple(r) for r in got.select("i", "rn", "prev_v", "next_v", "next_o").collect())
    w = Window.partitionBy("k").orderBy("o", "i")
    exp = df.select("i", F.row_number().over(w).cast("long").alias("rn"), F.lag("v").over(w),
                    F.lead("v").over(w), F.lead("o").over(w))
    assert got_rows == sorted(tuple(r) for r in exp.collect())


@SETTINGS
@given(pairs=st.lists(st.tuples(st.integers(-10**15, 10**15), st.integers(1, 10**6)), min_size=1, max_size=20))
def test_trunc_div_and_percent(spark, pairs):
    df = spark.createDataFrame(pairs, "a long, b long")
    out = df.select("a", "b", trunc_div("a", "b").alias("q"), percent("a", "b").alias("p")).collect()
    for r in out:
        q = abs(r.a) // r.b * (1 if r.a >= 0 else -1)
        assert r.q == q
        exact = (Decimal(r.a) * 100 / Decimal(r.b)).quantize(Decimal("0.01"), rounding=ROUND_HALF_UP)
        assert r.p == exact


@SETTINGS
@given(cents=st.lists(st.integers(-10**9, 10**9), min_size=1, max_size=30))
def test_mean_exact(spark, cents):
    vals = [(Decimal(c) / 100,) for c in cents]
    df = spark.createDataFrame(vals, "x decimal(18,2)")
    got = df.agg(mean_exact("x")).first()[0]
    exact = (sum(Decimal(c) for c in cents) / 100 / len(cents))
    assert got == exact.quantize(Decimal("0.0001"), rounding=ROUND_HALF_UP)


# -- list operators against a direct implementation of their semantics ---------------
from quire.operators import lists as L  # noqa: E402

NAMES = {1: "Bacon", 2: "BBQ Sauce", 3: "Beef", 4: "Cheese", 5: "Chicken", 6: "Mushrooms"}
BASE = {"A": "1, 2, 3", "B": "4,5", "C": "6"}


def _parse(text):
    if text is None or text in ("null", ""):
        return None
    return [int(x) for x in text.replace(" ", "").split(",")]


def _fmt(ids):
    return ", ".join(sorted(NAMES[i] for i in ids))


list_text = st.one_of(
    st.none(), st.sampled_from(["null", ""]),
    st.tuples(st.lists(st.integers(1, 6), min_size=1, max_size=4), st.sampled_from([", ", ","]))
    .map(lambda t: t[1].join(map(str, t[0]))))


@SETTINGS
@given(items=st.lists(st.tuples(st.sampled_from(["A", "B", "C"]), list_text, list_text), min_size=1, max_size=12))
def test_list_operators_match_direct_semantics(spark, items):
    rows = [(i, kind, exc, ext) for i, (kind, exc, ext) in enumerate(items)]
    df = spark.createDataFrame(rows, "item_no int, item_name string, exclusions string, extras string")
    names = spark.createDataFrame(sorted(NAMES.items()), "topping_id int, topping_name string")
    base = spark.createDataFrame(sorted(BASE.items()), "item_name string, toppings string")

    got = {r.item_no: r.order_item for r in
           L.describe_item(df, ["item_no"], "item_name", "exclusions", "extras", names).collect()}
    for i, kind, exc, ext in rows:
        a, b = _parse(exc), _parse(ext)
        text = kind
        if a and b:
            text = f"{kind} - Exclude {_fmt(a)} - Extra {_fmt(b)}"
        elif b:
            text = f"{kind} - Extra {_fmt(b)}"
        elif a:
            text = f"{kind} - Exclude {_fmt(a)}"
        assert got[i] == text

    got = {r.item_no: r.ingredients for r in
           L.apply_list_edits(df, ["item_no"], "item_name", base, "toppings", "exclusions", "extras",
                              names).collect()}
    for i, kind, exc, ext in rows:
        kept = set(_parse(BASE[kind])) - set(_parse(exc) or [])
        counts = {m: 1 for m in kept}
        for m in _parse(ext) or []:
            counts[m] = counts.get(m, 0) + 1
        if not counts:
            assert i not in got
            continue
        parts = [(NAMES[m], NAMES[m] if n == 1 else f"{n}x {NAMES[m]}") for m, n in counts.items()]
        assert got[i] == f"{kind}: " + ", ".join(label for _, label in sorted(parts))
