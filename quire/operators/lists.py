"""Delimited-list operators.

Lists live in text columns ('1, 5', '4', 'null', ''). They are parsed with
``split`` into typed arrays and handled with array functions inside the
row. Operators that render a row's members look the names up in a one-row
map of the name table, if that table is measured to be small (``MAX_MAP``
rows, one row per id); past that they explode, join and regroup by the row's
key, with the same result. Other name joins carry no hint.

``sep`` (a regular expression) and ``member_type`` describe a list column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import LIST_SEPARATOR, split_int_list, split_typed_list

MAX_MAP = 1000  # rows of a name table that is looked up as a map inside the row


def explode_list(df: DataFrame, col: str, keys: list[str], names: DataFrame | None = None,
                 id_name: str = "topping_id", sep: str = LIST_SEPARATOR, member_type: str = "int") -> DataFrame:
    """One row per list member, typed, optionally joined to member names."""
    out = (df.select(*keys, F.explode(split_typed_list(col, sep, member_type)).alias(id_name))
           .where(F.col(id_name).isNotNull()))
    return out if names is None else out.join(names, id_name)


def _names_map(names: DataFrame, id_name: str, name_col: str) -> Column | None:
    """The names as a map in a scalar subquery; None past ``MAX_MAP`` rows or with a repeated id."""
    small = names.select(id_name, name_col).limit(MAX_MAP + 1)
    rows, ids = small.agg(F.count(F.lit(1)), F.countDistinct(id_name)).first()
    if rows > MAX_MAP or ids != rows:
        return None
    return names.agg(F.map_from_entries(F.collect_list(F.struct(id_name, name_col)))).scalar()


def top_list_member(df: DataFrame, col: str, names: DataFrame, n: int = 1, id_name: str = "topping_id",
                    name_col: str = "topping_name") -> DataFrame:
    """The n most frequent members of a list column; ties by name ascending."""
    m = explode_list(df, col, [], names, id_name)
    return (m.groupBy(name_col).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.col("n").desc(), F.col(name_col)).limit(n))


def zip_lists(df: DataFrame, a: str, b: str, keys: list[str], a_name: str = "exclusion",
              b_name: str = "extra", sep: str = LIST_SEPARATOR, member_type: str = "int") -> DataFrame:
    """Two lists exploded in lock-step; the shorter side is padded with NULL.

    A row with both lists missing yields nothing, matching two set-returning
    calls in one SELECT list.
    """
    za, zb = (F.coalesce(split_typed_list(c, sep, member_type), F.array().cast(f"array<{member_type}>")) for c in (a, b))
    z = F.arrays_zip(za.alias("a"), zb.alias("b"))
    return (df.select(*keys, F.explode(z).alias("_z"))
            .select(*keys, F.col("_z.a").alias(a_name), F.col("_z.b").alias(b_name)))


def _names_text(c: Column) -> Column:
    """array of names -> 'a, b' in alphabetical order; empty -> NULL."""
    return F.when(F.size(c) > 0, F.array_join(F.array_sort(c), ", "))


def join_list(df: DataFrame, keys: list[str], col: str, name: str = "members") -> DataFrame:
    """Distinct members of each group as one alphabetical ', '-separated text.

    The members are first reduced to distinct (group, member) pairs, so each
    group's array is bounded by the member domain, not by the number of rows.
    """
    d = df.select(*keys, col).distinct()
    return d.groupBy(*keys).agg(_names_text(F.collect_list(col)).alias(name))


def list_text(df: DataFrame, keys: list[str], col: str, names: DataFrame, id_name: str = "topping_id",
              name_col: str = "topping_name", out: str = "members", sep: str = LIST_SEPARATOR) -> DataFrame:
    """A row's list column as alphabetical ', '-separated member names (W15 inside the row);
    empty lists give NULL."""
    tagged = _tagged(df, keys, [], {"A": col}, names, id_name, name_col, sep)
    return tagged.select(*keys, _names_text(F.col("_A")).alias(out))


def _tagged(df: DataFrame, keys: list[str], carry: list[str], lists: dict[str, str], names: DataFrame,
            id_name: str, name_col: str, sep: str = LIST_SEPARATOR) -> DataFrame:
    """keys, carry and one array of member names per list, in no order."""
    empty = F.array().cast("array<int>")
    ids = {t: F.coalesce(split_int_list(c, sep), empty) for t, c in lists.items()}
    look_up = _names_map(names, id_name, name_col)
    if look_up is not None:
        d = df.select(*keys, *carry, look_up.alias("_map"), *[x.alias(f"_ids_{t}") for t, x in ids.items()])
        return d.select(*keys, *carry, *[
            F.filter(F.transform(f"_ids_{t}", lambda x: F.try_element_at(F.col("_map"), x)), lambda x: x.isNotNull()).alias(f"_{t}")
            for t in lists])
    every = F.concat(*[_with_tag(x, t) for t, x in ids.items()])
    m = (df.select(*keys, *carry, F.explode_outer(every).alias("_m"))
         .select(*keys, *carry, F.col("_m.t").alias("_t"), F.col("_m.id").alias(id_name)).join(names, id_name, "left"))
    return m.groupBy(*keys, *carry).agg(*[F.collect_list(F.when(F.col("_t") == t, F.col(name_col))).alias(f"_{t}") for t in lists])


def _with_tag(ids: Column, tag: str) -> Column:
    return F.transform(ids, lambda x: F.struct(F.lit(tag).alias("t"), x.alias("id")))


def describe_item(df: DataFrame, keys: list[str], item: str, a: str, b: str, names: DataFrame,
                  id_name: str = "topping_id", name_col: str = "topping_name",
                  out: str = "order_item") -> DataFrame:
    """'name', 'name - Exclude a, b', 'name - Extra c' or both, per row."""
    g = _tagged(df, keys, [item], {"A": a, "B": b}, names, id_name, name_col)
    g = g.select(*keys, item, _names_text(F.col("_A")).alias("_a"), _names_text(F.col("_B")).alias("_b"))
    text = F.concat(F.col(item), F.coalesce(F.concat(F.lit(" - Exclude "), "_a"), F.lit("")),
                    F.coalesce(F.concat(F.lit(" - Extra "), "_b"), F.lit("")))
    return g.select(*keys, text.alias(out))


def edited_members(df: DataFrame, keys: list[str], item: str, base: DataFrame, base_col: str,
                   removed: str, added: str, id_name: str = "topping_id") -> DataFrame:
    """Per row the multiset (distinct base members - removed) + added, one row per member.

    The base list comes from a join of the recipe table on the item; the set difference and the concatenation are array functions
    inside the row.
    """
    b = base.select(F.col(item), split_int_list(base_col).alias("_base"))
    j = df.join(b, item)
    kept = F.array_except(F.coalesce("_base", F.array().cast("array<int>")),
                          F.coalesce(split_int_list(removed), F.array().cast("array<int>")))
    every = F.concat(kept, F.coalesce(split_int_list(added), F.array().cast("array<int>")))
    return (j.select(*keys, item, F.explode(every).alias(id_name))
            .where(F.col(id_name).isNotNull()))


def apply_list_edits(df: DataFrame, keys: list[str], item: str, base: DataFrame, base_col: str,
                     removed: str, added: str, names: DataFrame, id_name: str = "topping_id",
                     name_col: str = "topping_name", out: str = "ingredients") -> DataFrame:
    """Ingredient text per row: 'item: a, 2x b, c' in alphabetical order.

    The text is made once per distinct (item, removed, added) and joined back on these three, so its
    cost follows the different edits, not the rows. Rows without a named member give no text.
    """
    edits = [item, removed, added]
    texts = _edited_texts(df.select(*edits).distinct(), edits, item, base, base_col, removed, added, names, id_name, name_col, out)
    texts = texts.withColumnsRenamed({c: f"_{i}" for i, c in enumerate(edits)})
    same = [F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate(edits)]
    return df.select(*dict.fromkeys([*keys, *edits])).join(texts, same[0] & same[1] & same[2]).select(*keys, out)


def _edited_texts(df: DataFrame, keys: list[str], item: str, base: DataFrame, base_col: str, removed: str, added: str,
                  names: DataFrame, id_name: str, name_col: str, out: str) -> DataFrame:
    """(keys, text) of each row; multiplicities are counted inside the row."""
    b = base.select(F.col(item), split_int_list(base_col).alias("_base"))
    empty = F.array().cast("array<int>")
    kept = F.array_except(F.coalesce("_base", empty), F.coalesce(split_int_list(removed), empty))
    every = F.filter(F.concat(kept, F.coalesce(split_int_list(added), empty)), lambda x: x.isNotNull())
    keys = list(dict.fromkeys([*keys, item]))
    j = df.join(b, item).select(*keys, every.alias("_every"))
    j = j.withColumn("_ids", F.array_distinct("_every"))
    n_of = lambda x: F.size(F.filter(F.col("_every"), lambda y: y == x))

    def label(name, n):
        return F.when(n == 1, name).otherwise(F.concat(n.cast("string"), F.lit("x "), name))

    look_up = _names_map(names, id_name, name_col)
    if look_up is not None:
        named = F.filter(F.transform("_ids", lambda x: F.struct(F.try_element_at(F.col("_map"), x).alias("name"), n_of(x).alias("n"))),
                         lambda s: s["name"].isNotNull())
        g = j.withColumn("_map", look_up).select(*keys, F.array_sort(named).alias("_ls")).where(F.size("_ls") > 0)
    else:
        m = (j.select(*keys, F.explode(F.transform("_ids", lambda x: F.struct(x.alias("id"), n_of(x).alias("n")))).alias("_m"))
             .select(*keys, F.col("_m.id").alias(id_name), F.col("_m.n").alias("n")).join(names, id_name))
        g = m.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(name_col).alias("name"), "n"))).alias("_ls"))
    return g.select(*keys, F.concat(F.col(item), F.lit(": "), F.array_join(
        F.transform("_ls", lambda s: label(s["name"], s["n"])), ", ")).alias(out))


def member_totals(df: DataFrame, keys: list[str], item: str, base: DataFrame, base_col: str,
                  removed: str, added: str, names: DataFrame, id_name: str = "topping_id",
                  name_col: str = "topping_name") -> DataFrame:
    """Total use of each member over all rows after edits, most used first."""
    m = edited_members(df, keys, item, base, base_col, removed, added, id_name)
    return (m.groupBy(id_name).agg(F.count(F.lit(1)).alias("n_used"))
            .join(names, id_name)
            .select(id_name, name_col, "n_used").orderBy(F.desc("n_used"), name_col, id_name))


def list_surcharge(df: DataFrame, price: Column, col: str, per_member: int = 1, sep: str = LIST_SEPARATOR) -> DataFrame:
    """Sum of (unit price + per_member x list length); a missing list adds nothing."""
    n = F.coalesce(F.size(split_int_list(col, sep)), F.lit(0))
    n = F.when(n < 0, F.lit(0)).otherwise(n)  # size(NULL) is -1 in legacy mode
    return df.agg(F.sum(price + n * per_member).cast("bigint").alias("total_revenue"))
