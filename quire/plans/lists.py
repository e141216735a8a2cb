"""Catalogue entries for the delimited-list operators."""

from __future__ import annotations

from quire.operators import lists as L
from quire.plans.common import DELIVERED_SQL, ITEM_PRICE_SQL, delivered_items, item_price
from quire.plans.registry import register
from quire.sources.views import Views

ITEM_KEYS = ["order_id", "item_no"]


def _list_sql(col: str) -> str:
    return (f"(CASE WHEN {col} IN ('null', '') THEN NULL ELSE "
            f"list_transform(string_split(trim({col}), ','), lambda s: TRY_CAST(trim(s) AS INTEGER)) END)")


EXC, EXT = _list_sql("exclusions"), _list_sql("extras")
EMPTY = "CAST([] AS INTEGER[])"
DELIVERED_ITEMS_SQL = f"(SELECT * FROM v_item WHERE order_id IN (SELECT order_id FROM v_dirty WHERE {DELIVERED_SQL}))"


def _edits_sql(items: str) -> str:
    """DuckDB CTEs: a(order_id, item_no, item_name, id) = (base EXCEPT removed) UNION ALL added."""
    return f"""
     it AS {items},
     b AS (SELECT DISTINCT * FROM (
             SELECT i.order_id, i.item_no, i.item_name,
                    unnest(list_transform(string_split(r.toppings, ','), lambda s: TRY_CAST(trim(s) AS INTEGER))) AS id
             FROM it i JOIN v_recipe r ON r.item_name = i.item_name) q),
     e AS (SELECT order_id, item_no, item_name, unnest({EXC}) AS id FROM it),
     k AS (SELECT * FROM b EXCEPT SELECT * FROM e),
     x AS (SELECT order_id, item_no, item_name, unnest({EXT}) AS id FROM it
           WHERE item_name IN (SELECT item_name FROM v_recipe)),
     a AS (SELECT * FROM k UNION ALL SELECT * FROM x WHERE id IS NOT NULL)"""


@register("explode_list", "W12", f"""
SELECT u.order_id, u.item_no, u.id AS topping_id, t.topping_name
FROM (SELECT order_id, item_no, unnest({EXC}) AS id FROM v_item) u JOIN v_topping t ON t.topping_id = u.id""")
def q_explode_list(v: Views):
    return L.explode_list(v.v_item, "exclusions", ITEM_KEYS, v.v_topping).select(
        "order_id", "item_no", "topping_id", "topping_name")


def _top_sql(lst: str) -> str:
    return f"""
SELECT topping_name, count(*) AS n FROM (SELECT unnest({lst}) AS id FROM v_item) u
JOIN v_topping t ON t.topping_id = u.id GROUP BY topping_name ORDER BY n DESC, topping_name LIMIT 1"""


@register("top_extra", "W13", _top_sql(EXT))
def q_top_extra(v: Views):
    return L.top_list_member(v.v_item_lines, "extras", v.v_topping)


@register("top_exclusion", "W13", _top_sql(EXC))
def q_top_exclusion(v: Views):
    return L.top_list_member(v.v_item_lines, "exclusions", v.v_topping)


@register("zip_lists", "W14", f"""
SELECT order_id, item_no, unnest(coalesce({EXC}, {EMPTY})) AS exclusion, unnest(coalesce({EXT}, {EMPTY})) AS extra
FROM v_item""")
def q_zip_lists(v: Views):
    return L.zip_lists(v.v_item, "exclusions", "extras", ITEM_KEYS)


@register("join_list", "W15", f"""
SELECT item_name, string_agg(DISTINCT topping_name, ', ' ORDER BY topping_name) AS members
FROM (SELECT item_name, unnest({EXT}) AS id FROM v_item) u JOIN v_topping t ON t.topping_id = u.id
GROUP BY item_name""")
def q_join_list(v: Views):
    named = L.explode_list(v.v_item_lines, "extras", ["item_name"], v.v_topping)
    return L.join_list(named, ["item_name"], "topping_name")


@register("describe_item", "W16", f"""
WITH m AS (SELECT order_id, item_no, 'A' AS tg, unnest({EXC}) AS id FROM v_item
           UNION ALL SELECT order_id, item_no, 'B', unnest({EXT}) FROM v_item),
     n AS (SELECT m.order_id, m.item_no,
                  string_agg(t.topping_name, ', ' ORDER BY t.topping_name) FILTER (WHERE tg = 'A') AS a,
                  string_agg(t.topping_name, ', ' ORDER BY t.topping_name) FILTER (WHERE tg = 'B') AS b
           FROM m JOIN v_topping t ON t.topping_id = m.id GROUP BY 1, 2)
SELECT i.order_id, i.item_no,
       CASE WHEN n.a IS NOT NULL AND n.b IS NOT NULL THEN i.item_name || ' - Exclude ' || n.a || ' - Extra ' || n.b
            WHEN n.b IS NOT NULL THEN i.item_name || ' - Extra ' || n.b
            WHEN n.a IS NOT NULL THEN i.item_name || ' - Exclude ' || n.a
            ELSE i.item_name END AS order_item
FROM v_item i LEFT JOIN n ON n.order_id = i.order_id AND n.item_no = i.item_no""")
def q_describe_item(v: Views):
    return L.describe_item(v.v_item, ITEM_KEYS, "item_name", "exclusions", "extras", v.v_topping)


@register("apply_list_edits", "W17", f"""
WITH {_edits_sql('(SELECT * FROM v_item)')},
     c AS (SELECT a.order_id, a.item_no, a.item_name, t.topping_name, count(*) AS n
           FROM a JOIN v_topping t ON t.topping_id = a.id GROUP BY 1, 2, 3, 4)
SELECT order_id, item_no,
       item_name || ': ' || string_agg(CASE WHEN n = 1 THEN topping_name ELSE CAST(n AS VARCHAR) || 'x ' || topping_name END,
                                       ', ' ORDER BY topping_name) AS ingredients
FROM c GROUP BY order_id, item_no, item_name""")
def q_apply_list_edits(v: Views):
    return L.apply_list_edits(v.v_item, ITEM_KEYS, "item_name", v.v_recipe, "toppings", "exclusions", "extras",
                              v.v_topping)


@register("member_totals", "W18", f"""
WITH {_edits_sql(DELIVERED_ITEMS_SQL)}
SELECT a.id AS topping_id, t.topping_name, count(*) AS n_used
FROM a JOIN v_topping t ON t.topping_id = a.id GROUP BY 1, 2""")
def q_member_totals(v: Views):
    return L.member_totals(delivered_items(v), ["order_id"], "item_name", v.v_recipe, "toppings", "exclusions",
                           "extras", v.v_topping)


@register("list_surcharge", "W19", f"""
SELECT CAST(sum({ITEM_PRICE_SQL} + coalesce(len({EXT}), 0)) AS BIGINT) AS total_revenue FROM {DELIVERED_ITEMS_SQL} i""")
def q_list_surcharge(v: Views):
    return L.list_surcharge(delivered_items(v), item_price(), "extras")


RECIPE = "list_transform(string_split(toppings, ','), lambda s: TRY_CAST(trim(s) AS INTEGER))"


@register("explode_recipe", "W12", f"""
SELECT u.order_id, u.item_no, u.id AS topping_id, t.topping_name
FROM (SELECT i.order_id, i.item_no, unnest({RECIPE}) AS id FROM v_item i JOIN v_recipe r ON r.item_name = i.item_name) u
JOIN v_topping t ON t.topping_id = u.id""")
def q_explode_recipe(v: Views):
    made = v.v_item.join(v.v_recipe, "item_name")
    return L.explode_list(made, "toppings", ITEM_KEYS, v.v_topping).select("order_id", "item_no", "topping_id", "topping_name")


@register("recipe_text", "W15", f"""
SELECT i.order_id, i.item_no, r.members FROM v_item i JOIN (
  SELECT item_name, string_agg(topping_name, ', ' ORDER BY topping_name) AS members
  FROM (SELECT item_name, unnest({RECIPE}) AS id FROM v_recipe) u JOIN v_topping t ON t.topping_id = u.id
  GROUP BY item_name) r ON r.item_name = i.item_name""")
def q_recipe_text(v: Views):
    return L.list_text(v.v_item.join(v.v_recipe, "item_name"), ITEM_KEYS, "toppings", v.v_topping)
