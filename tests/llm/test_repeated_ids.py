"""Rows that share a doc_id but not the text."""

import pytest

LINE = "This line is long enough to be looked at, and many documents hold it."
OTHER = "Here is a line of its own, which no other document holds at all, number"
WORDS = [" ".join(f"{a}{i}" for i in range(60)) for a in ("north", "south")]


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "a") for i, t in rows], "doc_id long, text string, lang string, source string")


def test_lines_are_cut_from_the_text_that_lost_them(spark):
    import corpus_pipeline

    rows = [(1, f"{LINE}\n{OTHER} 1"), (1, f"{OTHER} 2\n{OTHER} 3\n{LINE}"), *[(10 + i, LINE) for i in range(5)]]
    out = corpus_pipeline.line_stage(spark, docs_of(spark, rows), "")
    assert sorted(r.text for r in out.filter("doc_id = 1").collect()) == [f"{OTHER} 1", f"{OTHER} 2\n{OTHER} 3"]


@pytest.mark.parametrize("second", [0, 1])
def test_near_copies_and_copies_of_the_mix(spark, second):
    import corpus_pipeline

    # of the two texts of document 5, the first is a near copy of document 3; the other stands alone
    rows = [(5, WORDS[second]), (5, WORDS[1 - second]), (3, WORDS[second] + " end"), (5, WORDS[1 - second])]
    out = corpus_pipeline.near_duplicate_stage(spark, docs_of(spark, rows), "")
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(3, WORDS[second] + " end"), (5, WORDS[1 - second])]
    apart = docs_of(spark, [(5, WORDS[0]), (5, WORDS[1])])
    mixed = corpus_pipeline.mixing_stage(spark, apart, "").collect()
    assert 1 <= len(mixed) <= 4 and len({r.text for r in mixed}) == 2 and max(
        sum(r.text == t for r in mixed) for t in WORDS) <= 2
