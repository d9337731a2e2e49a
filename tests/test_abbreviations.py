"""Abbreviations learned from texts, and sentences cut with them."""

import random

import pytest
from pyspark.sql import functions as F

from chronoweave.functions.text import sentences
from chronoweave.operators import abbreviations as ab


def _corpus(seed, n):
    """Texts of sentences with known ends; "approx.", "ca." and "z.b." stand within them before a capital letter."""
    rng = random.Random(seed)
    words = ["harbour", "stone", "river", "old", "the", "walked", "built", "near", "light", "a", "no", "it"]
    short = ["approx.", "ca.", "z.b.", "Capt."]
    texts = []
    for _ in range(n):
        said = []
        for _ in range(rng.randint(1, 5)):
            own = rng.choices(words, k=rng.randint(4, 9))
            if rng.random() < 0.5:
                at = rng.randrange(1, len(own))
                own[at:at] = [rng.choice(short), rng.choice(["Rome", "Berlin", "Oslo"])]
            own[0] = own[0].capitalize()
            said.append(" ".join(own) + rng.choice("..!?"))
        texts.append(said)
    return texts


def test_learned_abbreviations_and_ends(spark):
    learnt, told = _corpus(1, 400), _corpus(2, 200)
    rows = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(learnt)] + [(-1, None), (-2, "")], "i int, text string")
    found = ab.abbreviation_list(ab.abbreviations(rows))
    assert {"ca", "z.b", "capt"} <= set(found) and not {"harbour", "river", "stone", "old", "the"} & set(found)
    held = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(told)], "i int, text string")
    cut = held.select("i", sentences(F.col("text"), found).alias("s"), sentences(F.col("text")).alias("plain")).collect()
    right = sum(r["s"] == told[r["i"]] for r in cut)
    by_list = sum(r["plain"] == told[r["i"]] for r in cut)
    assert right >= 0.98 * len(told) > by_list


def test_nothing_and_bounds(spark):
    rows = spark.createDataFrame([(None,), ("",), ("12 - 3.",)], "text string")
    assert ab.abbreviations(rows).count() == 0 and ab.abbreviations(rows.limit(0)).count() == 0
    assert ab.abbreviation_list(ab.abbreviations(rows)) == []
    some = spark.createDataFrame([("x. b. c. and so it went on without an end of it all",)], "text string")
    assert ab.abbreviations(some).count() > 1
    with pytest.raises(ValueError):
        ab.abbreviation_list(ab.abbreviations(some), most=1)


def test_all_words_dotted(spark):
    """Nothing tells an abbreviation where every word has a full stop."""
    assert ab.abbreviations(spark.createDataFrame([("ab. cd. ef.",)], "text string")).count() == 0
