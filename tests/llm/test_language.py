"""Language scores of unlearned texts."""

import random

from pyspark.sql import functions as F

from quire.llm import language

MEDIUM = "/root/testdata/sf0.01"


def noise(words, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(rng.randint(6, 11))) for _ in range(words))


def test_unlearned_texts_are_rejected_and_clean_short_ones_stay(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "text", "lang").filter("doc_id >= 0")
    clean = docs.filter("lang IS NOT NULL AND text IS NOT NULL").orderBy("doc_id").limit(40).select(
        (F.col("doc_id") + 10_000_000).alias("doc_id"),
        F.array_join(F.slice(F.split("text", r"\s+"), 3, 6), " ").alias("text"), F.lit(None).cast("string").alias("lang"))
    strange = ["ከተማው በጣም ትልቅ ነው", "ᏣᎳᎩ ᎦᏬᏂᎯᏍᏗ ᎠᏂᏴᏫ " * 40, noise(4, 1), noise(300, 2)]
    more = spark.createDataFrame([(20_000_000 + i, t, None) for i, t in enumerate(strange)], docs.schema)
    out = corpus_pipeline.language_stage(spark, docs.unionByName(clean).unionByName(more), MEDIUM)
    ids = [r.doc_id for r in out.select("doc_id").filter("doc_id >= 10000000").collect()]
    assert not [i for i in ids if i >= 20_000_000]
    assert len(ids) >= 38
    assert out.filter("doc_id < 10000000").count() >= 0.98 * docs.filter("length(text) > 20").count()


def test_word_of_unlearned_letters_has_no_language():
    rows = [("en", 0, "the", 5.0, 5.0), ("de", 0, "der", 5.0, 5.0), ("en", 1, "t", 3.0, 3.0), ("de", 1, "d", 3.0, 3.0)]
    import pyarrow as pa
    model = language._tables(pa.table(dict(zip(("lang", "k", "w", "n", "_all"), map(list, zip(*rows))))))
    assert language.Scorer(model).text("ከተማው ትልቅ") == ("und", 0.0)
    assert language.Scorer(model).text("the the the")[1] > 0.9


def test_rare_words_of_a_language_are_kept(spark):
    words = ["".join(chr(97 + n // 26**k % 26) for k in range(4)) for n in range(25_000)]
    model = language.train(spark.createDataFrame([(1, " ".join(words), "en")], "doc_id long, text string, lang string"))
    assert set(words) <= set(model["at"][0])


def test_latin_texts_have_the_same_letter_runs():
    import regex

    every = regex.compile(language.LETTERS).findall
    runs = language.letter_runs()
    for c in map(chr, range(0x250)):
        for text in (c, f"a{c}b", c * 2, f"{c} é"):
            assert runs(text.lower()) == every(text.lower())


def test_the_sample_is_the_first_in_hash_order(spark, monkeypatch):
    """With few and many documents per language, quotes in a label, and a threshold that is too low at first."""
    from pyspark.sql import functions as F

    rows = spark.range(6000).select(F.when(F.col("id") % 3 == 0, "it's").when(F.col("id") % 50 == 1, "rare\\").otherwise("x").alias("lang"),
                                    F.xxhash64("id").alias("_h"))
    for wanted in (1, 7, 100, 1999, 2000, 2001):
        got = language._last_hashes(rows, wanted)
        for lang in ("it's", "rare\\", "x"):
            hashes = sorted(r["_h"] for r in rows.filter(F.col("lang") == lang).collect())
            assert got[lang] == (hashes[wanted - 1] if wanted < len(hashes) else (1 << 63) - 1)
    assert language._last_hashes(rows.limit(0), 5) == {}
    same = rows.withColumn("_h", F.lit((1 << 62)).cast("long"))
    assert set(language._last_hashes(same, 5).values()) == {1 << 62}
