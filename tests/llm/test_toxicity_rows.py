"""Which rows the toxicity model is fitted on, and that its steps on executors equal those on lists."""

import collections

import numpy as np

from chronoweave.llm import toxicity


def test_all_other_rows_up_to_the_bound(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(300)] + [(None, "none"), (299, "again")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, toxic int")
    for bound, other in ((5000, 201), (150, 150), (0, 0)):
        rows = toxicity.training_rows(docs, labels, unlabelled_rows=bound).collect()
        assert collections.Counter(-1 if r["toxic"] is None else r["toxic"] for r in rows) == collections.Counter({0: 50, 1: 50, -1: other})
        rest = {r["text"] for r in rows if r["toxic"] is None}
        assert len(rest) == other and not rest & {"none", *(f"text {i}" for i in range(100))}


def test_fit_equals_learn(spark):
    """Terms counted and votes cast on executors give the model that lists give."""
    rng = np.random.default_rng(5)
    say = lambda *more: " ".join([*rng.choice([f"w{i}" for i in range(200)], 30), *more])
    texts = [say("brute", "vequ" + e) for e in ["e", "en", "ung", "lich", "er"] * 6] + [say() for _ in range(200)] + ["", None, "you are STUPID!!"]
    labels = [1] * 30 + [0] * 203
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    marks = spark.createDataFrame([(i, y) for i, y in enumerate(labels)], "doc_id long, toxic int")
    here, there = toxicity.learn(texts, np.array(labels)), toxicity.fit(docs, marks, unlabelled_rows=0)
    assert {t for t in there.voters.lexicon if t not in toxicity.SEED_WORDS} == {"brute", "vequ*"}
    assert here.voters == there.voters and np.allclose(here.score(texts), there.score(texts), atol=1e-3)
    assert ((there.score(texts) >= toxicity.THRESHOLD) == np.array(labels, bool))[:-1].all()


def test_labels_act_through_voters_only():
    """Wrong labels of rows without votes neither make them toxic nor spoil the voters."""
    rng = np.random.default_rng(2)
    voters = toxicity.Voters(["a", "b", "c"], [1, 1, 1], [])
    y = rng.random(3000) < 0.2
    counts = (rng.random((3000, 3)) < np.where(y[:, None], 0.7, 0.02)).astype(np.float32)
    labels = y.astype(int)
    silent = np.flatnonzero(~counts.any(1))[:40]
    labels[silent] = 1
    model = toxicity.learn_from(counts, labels, voters)
    x = model.features(counts) @ model.weights[:-1] + model.weights[-1]
    assert (x[silent] < 0).all() and (x[y & (counts.sum(1) > 1)] > 0).all()
