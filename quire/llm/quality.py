"""Learned quality rules (operator 1), DataFrame functions only.

Statistics of whole texts are computed with built-in functions. From labelled rows a decision list
is learned by sequential covering: a rule starts empty, thresholds are added one by one by
information gain on the growing fold, final conditions are cut again on the pruning fold, the rows
a rule covers are removed, and the next rule is learned on the rest. Every step is one Spark
aggregation that returns a bounded table of counts per feature and bin; the list is emitted as
an ordered Spark conditional expression.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import let, stage

SPACES = r"[\x20\x09-\x0D]+"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
FEATURES = ("n_words", "word_length", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "bang_rate",
            "digit_rate", "distinct_rate", "line_words")


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more: equal windows are neighbours once
    (hash, position) pairs are sorted; the sorted positions of repeated windows cover min(3, gap)
    words each. Windows are compared by 64-bit hash."""
    def covered(h):
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        return let(pairs, lambda s: let(F.sort_array(F.filter(F.transform(s, lambda p, i: F.when(
            (F.get(s, i - 1)["x"] == p["x"]) | (F.get(s, i + 1)["x"] == p["x"]), p["i"])), lambda v: v.isNotNull())),
            lambda r: F.aggregate(F.transform(r, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(r, i + 1) - p, F.lit(3)))),
                                  F.lit(0), lambda a, v: a + v)))

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3),
                         lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 3, 0).otherwise(let(hashes, lambda h: F.when(
        F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h))))


def text_stats(docs: DataFrame, carry: list[str]) -> DataFrame:
    """Counts over the whole text of every row (null: no words, all counts 0)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counts = let(words, lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
        _repeat_words(w).cast("long").alias("n_repeat_words")))
    line_counts = let(lines, lambda x: F.struct(
        F.size(x).cast("long").alias("n_lines"),
        (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return docs.select(*carry, counts.alias("_w"), line_counts.alias("_l"),
                       F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
                       F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
                       F.regexp_count(text, F.lit(r"!")).cast("long").alias("n_bang"),
                       F.regexp_count(text, F.lit(r"[0-9]")).cast("long").alias("n_digit")
                       ).select("*", "_w.*", "_l.*").drop("_w", "_l")


def features() -> Column:
    """The rule features of a row of statistics, all finite, in the order of ``FEATURES``."""
    words, chars, lines = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "word_chars", "n_lines"))
    return F.array(F.col("n_words").cast("double"), F.col("word_chars") / words, F.col("n_symbols") / words,
                   F.col("n_dup_lines") / lines, F.col("n_repeat_words") / words, F.col("n_upper") / chars,
                   F.col("n_bang") / words, F.col("n_digit") / chars, F.col("n_distinct") / words,
                   F.col("n_words") / lines)


Condition = tuple[int, bool, int]  # feature, at least (else below), index of the cut


def _holds(bins: Column, rule: list[Condition]) -> Column:
    out = F.lit(True)
    for f, at_least, k in rule:
        out = out & ((F.get(bins, F.lit(f)) > k) if at_least else (F.get(bins, F.lit(f)) <= k))
    return out


def learn_rules(labelled: DataFrame, n_features: int, n_cuts: int = 48, max_rules: int = 12, max_conditions: int = 4,
                min_precision: float = 0.9, min_rows: int = 5) -> list[list[tuple[int, bool, float]]]:
    """A decision list for ``y = 1`` from (x array<double>, y 0/1, fold 0/1/2).

    Folds 0 and 1 grow rules, fold 2 prunes them and decides whether they are kept: a rule needs
    ``min_precision`` and ``min_rows`` covered rows there. Thresholds are ``n_cuts`` quantiles per
    feature. Rules are conjunctions of (feature, at least or below, threshold). No rows, or rows of
    one label only, give an empty list.
    """
    points = [(i + 0.5) / n_cuts for i in range(n_cuts)]
    row = labelled.agg(*[F.percentile_approx(F.get("x", F.lit(f)), points, 10_000).alias(f"q{f}")
                         for f in range(n_features)]).first()
    cuts = [sorted(set(row[f"q{f}"] or [])) for f in range(n_features)]
    bins = F.array(*[sum((F.when(F.get("x", F.lit(f)) >= c, 1).otherwise(0) for c in cuts[f]), F.lit(0))
                     for f in range(n_features)])
    rows = stage(labelled.select("y", (F.col("fold") < 2).alias("grow"), bins.alias("bins")), "quality-labelled")
    rules: list[list[Condition]] = []
    rest = rows
    for _ in range(max_rules):
        rule = _grow(rest.filter("grow"), cuts, max_conditions)
        if not rule:
            break
        pruned = rest.filter("NOT grow").agg(*[c for i in range(1, len(rule) + 1) for c in (
            F.count_if(_holds(F.col("bins"), rule[:i]) & (F.col("y") == 1)).alias(f"p{i}"),
            F.count_if(_holds(F.col("bins"), rule[:i]) & (F.col("y") == 0)).alias(f"n{i}"))]).first()
        scores = [((p - n) / (p + n) if p + n else -1.0, -i, p, n) for i in range(1, len(rule) + 1)
                  for p, n in [(pruned[f"p{i}"], pruned[f"n{i}"])]]
        _, i, p, n = max(scores)
        if p < min_rows or p < min_precision * (p + n):
            break
        rules.append(rule[:-i])
        rest = rest.filter(~_holds(F.col("bins"), rule[:-i]))
    return [[(f, at_least, cuts[f][k]) for f, at_least, k in rule] for rule in rules]


def _grow(rows: DataFrame, cuts: list[list[float]], max_conditions: int) -> list[Condition]:
    rule: list[Condition] = []
    while len(rule) < max_conditions:
        table = (rows.filter(_holds(F.col("bins"), rule)).select("y", F.posexplode("bins").alias("f", "b"))
                 .groupBy("f", "b").agg(F.sum("y").alias("p"), F.count(F.lit(1)).alias("all")).collect())
        by = {f: {} for f in range(len(cuts))}
        for r in table:
            by[r["f"]][r["b"]] = (r["p"], r["all"] - r["p"])
        P, N = (sum(v[i] for v in by[0].values()) for i in (0, 1))
        if not P or not N:
            break
        base, best = math.log2(P / (P + N)), (1e-9, None)
        for f, hist in by.items():
            p = n = 0
            for k in range(len(cuts[f])):  # below the k-th cut: bins 0..k
                dp, dn = hist.get(k, (0, 0))
                p, n = p + dp, n + dn
                for at_least, a, b in ((False, p, n), (True, P - p, N - n)):
                    if a and a + b < P + N:
                        gain = a * (math.log2(a / (a + b)) - base)
                        if gain > best[0]:
                            best = (gain, (f, at_least, k))
        if best[1] is None:
            break
        rule.append(best[1])
    return rule


def rule_column(rules: list[list[tuple[int, bool, float]]], x: Column) -> Column:
    """Number of the first rule that holds, from 1; 0 if none does."""
    out = None
    for i, rule in enumerate(rules, 1):
        cond = F.lit(True)
        for f, at_least, c in rule:
            v = F.get(x, F.lit(f))
            cond = cond & ((v >= c) if at_least else (v < c))
        out = F.when(cond, i) if out is None else out.when(cond, i)
    return F.lit(0) if out is None else out.otherwise(0)


def describe(rules: list[list[tuple[int, bool, float]]]) -> list[str]:
    return [" and ".join(f"{FEATURES[f]} {'>=' if ge else '<'} {c:.4g}" for f, ge, c in r) for r in rules]


def quality(docs: DataFrame, labels: DataFrame, carry: list[str], **limits) -> DataFrame:
    """Statistics and verdict of every document.

    ``labels`` has doc_id and quality (1 good, 0 bad); of several labels the best counts, null ones
    do not. ``base_failed`` are texts of fewer than 50 words or with more than half of their words
    in repeated 3-word windows; ``kept`` is false for them and where a learned rule holds; ``rule``
    is that rule's number, 0 for none.
    """
    s = stage(text_stats(docs, carry), "quality-stats").withColumn("x", features())
    known = (labels.filter("quality IS NOT NULL").groupBy(F.col("doc_id").alias("_id"))
             .agg((1 - F.max("quality")).alias("y")))
    labelled = (s.join(known, F.col("doc_id") == F.col("_id"))
                .select("x", "y", F.pmod(F.xxhash64("doc_id"), F.lit(3)).cast("int").alias("fold")))
    rules = learn_rules(labelled, len(FEATURES), **limits)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return (s.withColumn("base_failed", failed).withColumn("rule", rule_column(rules, F.col("x")))
            .withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0)).drop("x"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: statistics, base rules and learned verdict of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality(docs, labels, ["doc_id"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
