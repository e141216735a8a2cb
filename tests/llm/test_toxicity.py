"""Toxic words inside tokens."""

import pytest

from quire.llm.toxicity import FEATURES, Featurizer


def of(text):
    lexicon = {"idiot": 4.0, "idio*": 3.0, "moron": 5.0}
    return dict(zip(FEATURES, Featurizer(lexicon).features(text)))


@pytest.mark.parametrize("text", ["calm,idiot", "you/idiot", "so-called—idiot", "well...idiot", "quiet,1d10t", "calm.1d10t"])
def test_toxic_words_joined_by_punctuation(text):
    got = of(text)
    assert got["strongest_entry"] >= 3.0
    assert got["lexicon_hits"] > 0 or got["hidden_hits"] > 0


def test_long_text_without_spaces():
    words = ["calm"] * 400 + ["you", "idiot", "quiet", "moron"] * 100
    joined, spaced = of(",".join(words)), of(" ".join(words))
    same = [f for f in FEATURES if f not in ("capital_rate", "punctuation_rate")]
    assert {f: joined[f] for f in same} == pytest.approx({f: spaced[f] for f in same})
    assert joined["strongest_entry"] == 5.0 and joined["second_entry"] == 4.0 and joined["near_density"] > 0
