"""Toxicity scores (operator 5): gradient-boosted trees over dense features, calibrated by
isotonic regression.

The features of a text are rates that need no vocabulary of the size of the corpus: densities of a
learned lexicon (words, their beginnings, and words behind digit and symbol spellings), lexicon
words near the second person, capitals, punctuation and obfuscation. Lexicon, trees and
calibration learn from different folds, so none of them sees what an earlier one has fitted.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import stage
from quire.llm.tokens import text_batches

MAX_LABELLED = 40_000   # labelled rows that are learned from, the first in a hash order
MAX_LEXICON = 4_000     # entries of the learned lexicon
MIN_TOXIC_DOCS = 3      # toxic documents that an entry must be found in
MIN_LOG_ODDS = 2.0
NEAR = 5                # words between a lexicon word and a second-person word that count as near
BEGINNINGS = (4, 6)
# fixed values: second-person words of four languages
SECOND_PERSON = ("you your yours yourself u ur du dich dir dein deine ihr euch sie "
                 "tu te toi ton ta tes vous votre vos tú ti usted ustedes tus vosotros").split()
# fixed values: usual spellings of letters by digits and signs
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
FEATURES = ("lexicon_density", "lexicon_hits", "beginning_density", "beginning_hits", "hidden_density", "hidden_hits",
            "second_person_density", "near_density", "capital_rate", "capital_word_rate", "punctuation_rate",
            "exclamation_rate", "obfuscation_rate", "stretched_rate", "log_words", "strongest_entry", "second_entry")


def crc_fold(doc_id: str = "doc_id", folds: int = 5):
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return (F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds).cast("int")


def _entries(word: str) -> list[str]:
    """A word and its beginnings, which stand for inflected forms; '*' marks a beginning."""
    return [word] + [word[:k] + "*" for k in BEGINNINGS if len(word) > k]


def _lexicon_counts(batches):
    """(entry, toxic, n) over batches of (text, toxic): documents that have an entry."""
    import re
    from collections import Counter

    import pyarrow as pa

    words = re.compile(r"[^\W\d_]{2,}").findall
    for b in batches:
        found: Counter = Counter()
        for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
            entries = {e for w in set(words((text or "").lower())) for e in _entries(w)}
            found.update((e, toxic) for e in entries)
        keys = list(zip(*found)) or [(), ()]
        yield pa.RecordBatch.from_arrays([pa.array(keys[0], pa.string()), pa.array(keys[1], pa.int64()),
                                          pa.array(list(found.values()), pa.int64())], names=["entry", "toxic", "n"])


def learn_lexicon(rows: DataFrame) -> dict[str, float]:
    """Entries of toxic texts with their log odds, from (text, toxic). At most ``MAX_LEXICON``,
    those found in most toxic documents first, ties by entry."""
    totals = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        return {}
    counts = (rows.mapInArrow(_lexicon_counts, "entry string, toxic long, n long").groupBy("entry")
              .agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("a"),
                   F.sum(F.when(F.col("toxic") == 1, 0).otherwise(F.col("n"))).alias("b")))
    odds = (F.log((F.col("a") + 0.5) / (n1 + 0.5 - F.col("a"))) - F.log((F.col("b") + 0.5) / (n0 + 0.5 - F.col("b"))))
    best = (counts.filter(F.col("a") >= MIN_TOXIC_DOCS).withColumn("odds", odds).filter(F.col("odds") >= MIN_LOG_ODDS)
            .orderBy(F.desc("a"), "entry").limit(MAX_LEXICON))
    return {r["entry"]: float(r["odds"]) for r in best.collect()}


class Featurizer:
    """Features of one text; remembers how it classed the tokens it has met."""

    PLAIN = ((False,) * 7 + (0.0, ""),)

    def __init__(self, lexicon: dict[str, float]):
        import re

        self.tokens = re.compile(r"\S+").findall
        self.parts = re.compile(r"[\w@$!*.\-+#]+").findall
        self.words = re.compile(r"[^\W\d_]{2,}").findall
        self.split = re.compile(r"[!*.\-_+#]+").split
        self.hidden = re.compile(r"^[^\W_]*[^\W\d_][0-9@$!*.\-_+#]+[^\W\d_]").match
        self.stretched = re.compile(r"([^\W\d_])\1\1").search
        self.marks = re.compile(r"[^\w\s]").findall
        self.lexicon = lexicon
        self.second = frozenset(SECOND_PERSON)
        self.seen: dict[str, tuple] = {}

    def spelled(self, part: str) -> list[str]:
        """Lexicon entries behind a digit and symbol spelling."""
        low = part.lower()
        plain = "".join(LOOKALIKES.get(c, c) for c in low)
        forms = ["".join(c for c in x if c.isalpha()) for x in (plain, low)]
        return [e for form in forms for e in _entries(form) if e in self.lexicon]

    def classed(self, token: str) -> tuple:
        """One unit for every word of a token, at least one: (lexicon, beginning, hidden, second person,
        capital, obfuscated, stretched, log odds of the strongest entry, name). Hidden spellings are
        looked for in each part of the token between signs that none of them uses, and in the pieces of
        a part between its points, dashes and the like; they go to the part's first word."""
        units = []
        for part in self.parts(token):
            words = self.words(part)
            mixed, stretched = bool(self.hidden(part)), bool(self.stretched(part))
            entries = []
            if mixed:
                entries = self.spelled(part) or [e for x in self.split(part) if self.hidden(x) for e in self.spelled(x)]
            strongest = max((self.lexicon[e] for e in entries), default=0.0)
            for i, w in enumerate(words or [""] * mixed):
                low = w.lower()
                own = _entries(low) if w else [""]
                units.append((low in self.lexicon, any(e in self.lexicon for e in own[1:]), bool(entries) and i == 0,
                              low in self.second, len(w) > 1 and w.isupper(), mixed and i == 0, stretched and i == 0,
                              max(strongest if i == 0 else 0.0, max(self.lexicon.get(e, 0.0) for e in own)), w or part))
        if len(units) == 1:
            units = [(*units[0][:8], token)]
        return tuple(units) if any(any(u[:8]) for u in units) else self.PLAIN * max(1, len(units))

    def features(self, text: str | None) -> list[float]:
        from itertools import chain

        text = text or ""
        tokens = self.tokens(text)
        if len(self.seen) > 200_000:
            self.seen.clear()
        seen = self.seen
        for t in set(tokens).difference(seen):
            seen[t] = self.classed(t)
        units = list(chain.from_iterable(map(seen.__getitem__, tokens)))
        for t in tokens if len(text) > 64 * len(tokens) else ():  # long tokens are not worth remembering
            seen.pop(t, None)
        n = max(1, len(units))
        sums = [0] * 7
        hits, seconds, odds = [], [], {}
        plain = self.PLAIN[0]
        for i, c in enumerate(units):
            if c is not plain:
                for k in range(7):
                    sums[k] += c[k]
                if c[0] or c[1] or c[2]:
                    hits.append(i)
                    odds[c[8]] = c[7]
                if c[3]:
                    seconds.append(i)
        near = j = 0
        for i in hits:
            while j < len(seconds) and seconds[j] < i - NEAR:
                j += 1
            near += j < len(seconds) and seconds[j] <= i + NEAR
        chars = max(1, len(text))
        marks = self.marks(text)
        strongest = [*sorted(odds.values(), reverse=True)[:2], 0.0, 0.0]
        return [100 * sums[0] / n, math.log1p(sums[0]), 100 * sums[1] / n, math.log1p(sums[1]),
                100 * sums[2] / n, math.log1p(sums[2]), 100 * sums[3] / n, 100 * near / n,
                sum(map(str.isupper, text)) / chars if not text.islower() else 0.0, sums[4] / n, len(marks) / chars,
                text.count("!") / n, sums[5] / n, sums[6] / n, math.log1p(len(units)),
                strongest[0], strongest[1]]


def text_features(docs: DataFrame, lexicon: dict[str, float], carry: list[str]) -> DataFrame:
    """Carried columns and ``x``, the dense features of every whole text (null: as empty)."""
    out = T.StructType([docs.schema[c] for c in carry]).add("x", T.ArrayType(T.DoubleType()))
    from pyspark.sql.pandas.types import to_arrow_schema
    schema = to_arrow_schema(out)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # bounded by MAX_LEXICON

    def run(batches):
        import pyarrow as pa

        of = Featurizer(shared.value).features
        for b in text_batches(batches):
            x = [of(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in carry] + [pa.array(x, schema.field("x").type)], schema=schema)

    return docs.select(*carry, *([] if "text" in carry else ["text"])).mapInArrow(run, out)


def score_toxicity(docs: DataFrame, labels: DataFrame, carry: list[str], learn_from=None) -> DataFrame:
    """(carried columns, score, predicted) of every text.

    ``labels`` has doc_id and toxic; of several labels of a document the highest counts, null ones
    do not. ``learn_from`` is a condition on doc_id that labelled rows must meet to be learned from.
    At most ``MAX_LABELLED`` labels are used (a table of that size is broadcast to find the texts).
    Without labelled rows of both kinds every score is 0.
    """
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL")
    known = (known if learn_from is None else known.filter(learn_from)).groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic"))
    known = stage(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
                  .select(F.col("doc_id").alias("_id"), "toxic", F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(4)).alias("_part")),
                  "toxicity-labels")
    labelled = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("_id"))
    lexicon = learn_lexicon(labelled.filter("_part < 2").select("text", "toxic"))
    columns = [c for c in dict.fromkeys([*carry, "doc_id"])]
    x = stage(text_features(docs, lexicon, columns), "toxicity-features")
    learned = stage(x.join(F.broadcast(known), F.col("doc_id") == F.col("_id")).filter("_part >= 2")
                    .select("x", F.col("toxic").cast("double").alias("label"), "_part"), "toxicity-learned")
    kinds = {(r["part"], r["label"]): r["n"] for r in learned.groupBy(F.col("_part").alias("part"), "label").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    if not all(kinds.get((2, y)) for y in (0.0, 1.0)):
        return x.select(*carry, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))

    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.regression import IsotonicRegression

    rows = learned.withColumn("features", array_to_vector("x")).coalesce(4)
    trees = GBTClassifier(maxIter=20, maxDepth=3, stepSize=0.3, subsamplingRate=1.0, seed=7,
                          maxMemoryInMB=64).fit(rows.filter("_part = 2"))

    def raw(df):
        return trees.transform(df).withColumn("raw", vector_to_array("probability")[1])

    scored = raw(x.withColumn("features", array_to_vector("x")))
    if all(kinds.get((3, y)) for y in (0.0, 1.0)):
        calibration = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="score").fit(
            raw(rows.filter("_part = 3")).select("raw", "label"))
        scored = calibration.transform(scored)
    else:
        scored = scored.withColumn("score", F.col("raw"))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score")))
    return scored.select(*carry, score.alias("score"), F.when(score >= 0.5, 1).otherwise(0).alias("predicted"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: score of every document, labels of the held-out fold unseen."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return (score_toxicity(docs, labels, ["doc_id"], learn_from=crc_fold() != 0)
            .select("doc_id", (crc_fold() == 0).alias("held_out"), "score", "predicted"))
