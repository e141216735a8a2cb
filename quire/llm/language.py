"""Language identification by word-first backoff (operator 7).

A known word is scored by its log frequency in every language. A word that no language knows
falls back to its character n-grams: the longest known ones decide, progressively shorter ones
are asked where none is known. The score of a text is its posterior probability, times the part of
the text that the model knows: all of a known word, less of one known by n-grams only, nothing of a
word whose letters were never learned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quire.llm.common import stage
from quire.llm.tokens import text_batches

DOCS_PER_LANGUAGE = 1500     # bound of the labelled sample
WORDS_PER_LANGUAGE = 40_000  # bound of the word model
GRAMS_PER_LANGUAGE = 10_000  # bound of the n-gram model, for each length
GRAM_LENGTHS = (5, 4, 3, 2, 1)
EVIDENCE = 5                 # words that a text's words count as at most: its length alone makes nothing certain
LETTERS = r"\p{L}[\p{L}\p{M}]*"
LATIN_LETTERS = "[a-zªµºß-öø-ÿ]+"  # the same in lower-case texts below U+0100, which have no combining marks
UNKNOWN = "und"


def letter_runs():
    """Function from a lower-case text to its runs of letters; texts of Latin-1 letters alone, most texts of
    western languages, take the standard library's faster matcher."""
    import re

    import regex

    every, latin = regex.compile(LETTERS).findall, re.compile(LATIN_LETTERS).findall

    def runs(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return every(text)
        return latin(text)

    return runs


def _grams(word: str, k: int) -> list[str]:
    """The n-grams of a word between spaces; single letters without the spaces, which every word has."""
    padded = f" {word} " if k > 1 else word
    return [padded[i:i + k] for i in range(len(padded) - k + 1)]


def _word_counts(batches):
    """(lang, w, n) of batches of (lang, _t), added up over each batch."""
    from collections import Counter

    import pyarrow as pa

    letters = letter_runs()
    for b in batches:
        found: Counter = Counter()
        for lang, text in zip(b.column("lang").to_pylist(), b.column("_t").to_pylist()):
            found.update((lang, w) for w in letters(text.lower()))
        keys = list(zip(*found)) or [(), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys[0], pa.string()), pa.array(keys[1], pa.string()),
             pa.array(list(found.values()), pa.int64())], names=["lang", "w", "n"])


def _gram_counts(batches):
    """(lang, k, n-gram, weight) of batches of (lang, w, n), added up over each batch; a word
    weighs the logarithm of its count."""
    import math
    from collections import Counter

    import pyarrow as pa

    for b in batches:
        found: Counter = Counter()
        for lang, w, n in zip(*(b.column(c).to_pylist() for c in ("lang", "w", "n"))):
            weight = math.log2(n + 1)
            for k in GRAM_LENGTHS:
                for g in _grams(w, k):
                    found[lang, k, g] += weight
        keys = list(zip(*found)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys[0], pa.string()), pa.array(keys[1], pa.int32()), pa.array(keys[2], pa.string()),
             pa.array(list(found.values()), pa.float64())], names=["lang", "k", "w", "n"])


def _by_language(values: dict[str, int]) -> str:
    """SQL for the value of the row's language; null for others."""
    def text(lang):
        return "'" + lang.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return "CASE " + " ".join(f"WHEN lang = {text(k)} THEN {v}L" if v > -(1 << 63) else f"WHEN lang = {text(k)} THEN -9223372036854775807L" for k, v in values.items()) + " END"


def _last_hashes(rows: DataFrame, wanted: int) -> dict[str, int]:
    """Per language the ``wanted``-th smallest hash of its rows (lang, _h), or the largest long where it has
    no more rows. Hashes are uniform, so a threshold by the language's count leaves about twice as many
    rows as wanted, and only these, without their texts, are put in order. One entry per language comes
    to the driver, as for the model."""
    largest = (1 << 63) - 1
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    out = {k: largest for k, n in counts.items() if n <= wanted}
    share = {k: 2 * wanted / n for k, n in counts.items() if n > wanted}
    while share:
        at = {k: largest if s >= 1 else int(s * (1 << 64)) - (1 << 63) for k, s in share.items()}
        few = rows.filter("_h <= " + _by_language(at)).withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy("_h")))
        found = {r["lang"]: r["_h"] for r in few.filter(F.col("_r") == wanted).select("lang", "_h").collect()}
        out |= found
        share = {k: 4 * s for k, s in share.items() if k not in found}  # fewer than wanted: a rare chance, or repeated ids
    return out


def _no_rows():
    import pyarrow as pa
    return pa.table({"lang": pa.array([], pa.string()), "k": pa.array([], pa.int32()), "w": pa.array([], pa.string()),
                     "n": pa.array([], pa.float64()), "_all": pa.array([], pa.float64())})


def train(labelled: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE) -> dict:
    """A model from (doc_id, text, lang): per-language log frequencies of words and n-grams.

    The model is fitted on a bounded sample: of every language the ``docs_per_language`` documents
    that come first in a hash order (ties by text), with their whole texts.
    Counts are taken in Spark; the model collected has at most ``WORDS_PER_LANGUAGE`` words and
    ``GRAMS_PER_LANGUAGE`` n-grams of each length per language. Rows without text or label are left
    out; without any row the model is empty.
    """
    usable = (labelled.filter("lang IS NOT NULL AND text IS NOT NULL")
              .select("lang", F.xxhash64("doc_id").alias("_h"), F.col("text").alias("_t")))
    last = _last_hashes(usable.select("lang", "_h"), docs_per_language)
    if not last:
        return _tables(_no_rows())
    sample = (usable.filter("_h <= " + _by_language(last))
              .withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy("_h", "_t")))
              .filter(F.col("_r") <= docs_per_language))
    words = (sample.select("lang", "_t", "_h").repartition("_h").mapInArrow(_word_counts, "lang string, w string, n long")
             .groupBy("lang", "w").agg(F.sum("n").alias("n")))
    words = stage(words, "language-words")
    # an n-gram counts for every distinct word that has it: unseen words are like rare ones
    counts = (words.mapInArrow(_gram_counts, "lang string, k int, w string, n double")
              .groupBy("lang", "k", "w").agg(F.sum("n").alias("n")))
    both = words.select("lang", F.lit(0).alias("k"), "w", F.col("n").cast("double")).unionByName(counts)
    top = Window.partitionBy("lang", "k").orderBy(F.desc("n"), "w")
    rows = (both.withColumn("_r", F.row_number().over(top))
            .withColumn("_all", F.sum("n").over(Window.partitionBy("lang", "k")))
            .filter(F.when(F.col("k") == 0, F.col("_r") <= WORDS_PER_LANGUAGE).otherwise(F.col("_r") <= GRAMS_PER_LANGUAGE))
            .select("lang", "k", "w", "n", "_all").toArrow())
    return _tables(rows)


def _tables(rows) -> dict:
    """{"langs", "at": {k: {word: row}}, "logs": {k: matrix of log frequencies}} from an Arrow table
    (lang, k, w, n, total); k is 0 for words, else the length of the n-grams. A word that a language
    does not have gets half an occurrence there."""
    import numpy as np

    lang = np.array(rows["lang"].to_pylist(), dtype=object)
    langs = sorted(set(lang))
    model: dict = {"langs": langs, "at": {}, "logs": {}}
    ks, n, total = (rows[c].to_numpy() for c in ("k", "n", "_all"))
    for k in (0, *GRAM_LENGTHS):
        own = np.flatnonzero(ks == k)
        words = rows["w"].take(own).to_pylist()
        at = {w: i for i, w in enumerate(dict.fromkeys(words))}
        counts, totals = np.zeros((len(at), len(langs))), np.zeros(len(langs))
        where = np.array([langs.index(x) for x in lang[own]], dtype=np.int64)
        counts[[at[w] for w in words], where] = n[own]
        totals[where] = total[own]
        model["at"][k] = at
        model["logs"][k] = np.log((counts + 0.5) / (totals + len(at) + 1))
    return model


class Scorer:
    """Scores texts with a model; keeps the scores of the words it has met."""

    def __init__(self, model: dict, kept: int = 200_000):
        import numpy as np

        self.np, self.langs, self.kept = np, model["langs"], kept
        self.places, self.logs = model["at"], model["logs"]
        self.letters = letter_runs()
        self.rows = {k: self.logs[k].tolist() for k in GRAM_LENGTHS}
        self.at: dict[str, int] = {}
        self.table = np.zeros((1024, len(self.langs) + 1))

    def word(self, w: str):
        """Scores of a word in every language, and how far it is known: 1 if it is known itself, else
        the largest share of its n-grams of one length that are known, shorter ones counting less."""
        known = self.places[0].get(w)
        if known is not None:
            return self.logs[0][known], 1.0
        scores, degree = 0.0, 0.0
        for k in GRAM_LENGTHS:
            grams, places = _grams(w, k), self.places[k]
            found = [v for g in grams if (v := places.get(g)) is not None]
            if found:
                if not degree:
                    rows = self.rows[k]
                    scores = [sum(x) / len(found) for x in zip(*[rows[v] for v in found])]
                degree = max(degree, k / GRAM_LENGTHS[0] * len(found) / len(grams))
            if degree >= (k - 1) / GRAM_LENGTHS[0]:
                break  # shorter ones count no more than that
        return scores, degree

    def text(self, text: str | None) -> tuple[str, float]:
        np = self.np
        words = self.letters(text.lower()) if text else []
        if not words or not self.langs:
            return UNKNOWN, 0.0
        if len(self.at) > self.kept:
            self.at.clear()
        at = self.at
        new = set(words).difference(at)
        if len(at) + len(new) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros((len(at) + len(new), len(self.langs) + 1))])
        for w in new:
            self.table[len(at), :-1], self.table[len(at), -1] = self.word(w)
            at[w] = len(at)
        total = self.table[np.fromiter(map(at.__getitem__, words), dtype=np.int64, count=len(words))].sum(axis=0)
        known, total = total[-1] / len(words), total[:-1] * min(1.0, EVIDENCE / len(words))
        if not known:
            return UNKNOWN, 0.0
        best = int(total.argmax())
        return self.langs[best], float(known / np.exp(total - total[best]).sum())


def predict(docs: DataFrame, model: dict, carry: list[str]) -> DataFrame:
    """(carried columns, lang_pred, score): the likeliest language of every whole text and its
    posterior probability times the known part of the text; ``und`` and 0 where the text is null or
    has no letter that was learned. Ties go to the first language in alphabetical order."""
    out = T.StructType([docs.schema[c] for c in carry]).add("lang_pred", "string").add("score", "double")
    from pyspark.sql.pandas.types import to_arrow_schema
    schema = to_arrow_schema(out)
    # bounded by the model's parameters
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        scorer = Scorer(shared.value)
        try:
            for b in text_batches(batches):
                found = [scorer.text(t) for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [b.column(c) for c in carry] + [pa.array([x[0] for x in found], pa.string()),
                                                    pa.array([x[1] for x in found], pa.float64())], schema=schema)
        finally:
            # the worker lives on through other stages: it lets go of the model, which its next task reads again
            scorer = None
            vars(shared).pop("_value", None)
            pa.default_memory_pool().release_unused()

    return docs.select(*carry, *([] if "text" in carry else ["text"])).mapInArrow(run, out)


def held_out(doc_id: str = "doc_id", folds: int = 4, fold: int = 2):
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds == fold


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: predicted language of every document, learned outside the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs.filter(~held_out()))
    return (predict(docs, model, ["doc_id"]).withColumn("held_out", held_out())
            .select("doc_id", "held_out", "lang_pred", "score"))
