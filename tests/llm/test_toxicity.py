import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm import toxicity

LABELS = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "quality", "toxic")])
CATEGORIES = {"poor": "1 - quality", "toxic": "toxic"}


def corpus(n=900, seed=1):
    """Texts with invented words; toxic ones hold some of a few telling words, poor ones of others."""
    rnd = random.Random(seed)
    plain = [f"{a}{b}{c}" for a in ("ba", "ko", "mi", "tu") for b in ("la", "ri", "so") for c in ("n", "k", "st", "m")]
    toxic, poor = ["vrex", "Grolk", "zqualify", "brunk"], ["ftt", "hgg"]
    rows = []
    for i in range(n):
        bad, low = rnd.random() < 0.15, rnd.random() < 0.2
        words = [rnd.choice(plain) for _ in range(rnd.randrange(20, 200))]
        for vocabulary, chosen in ((toxic, bad), (poor, low)):
            for _ in range(rnd.randrange(2, 6) if chosen else 0):
                words.insert(rnd.randrange(len(words)), rnd.choice(vocabulary) + rnd.choice(["", ",", "!"]))
        rows.append((i, " ".join(words), int(not low), int(bad)))
    return rows


@pytest.fixture(scope="module")
def trained(spark, make_docs):
    rows = corpus()
    docs = make_docs([r[:2] for r in rows])
    labels = spark.createDataFrame([(r[0], r[2], r[3]) for r in rows if r[0] < 600], LABELS)
    return rows, docs, toxicity.train(docs, labels, CATEGORIES)


def test_held_out_accuracy(trained):
    rows, docs, chain = trained
    found = {r.doc_id: r.rejected for r in toxicity.score(docs, chain).collect()}
    held = [r for r in rows if r[0] >= 600]
    assert sum(found[r[0]] == bool(r[3]) for r in held) >= 0.98 * len(held)
    assert not any(found[r[0]] for r in held if not r[3])


def test_scores_follow_the_chain(trained):
    """Probabilities by hand: weights of the inputs, then the earlier probability as an input."""
    import math

    rows, docs, chain = trained
    index = {name: i for i, name in enumerate(chain.vocabulary)}
    got = {r.doc_id: (r.p_poor, r.p_toxic) for r in toxicity.score(docs, chain).collect()}
    assert [link.category for link in chain.links] == ["poor", "toxic"] and len(chain.links[1].earlier) == 1
    for i, text, _, _ in rows[:50]:
        inputs = [index[x] for w in toxicity.words_of(text) for x in toxicity.inputs_of(w) if x in index]
        earlier = []
        for link in chain.links:
            margin = link.intercept + sum(link.weights[x] for x in inputs) + sum(w * p for w, p in zip(link.earlier, earlier))
            earlier.append(1 / (1 + math.exp(-margin)))
        assert got[i] == pytest.approx(earlier, abs=2e-6)


def test_odd_rows_and_columns(trained, make_docs):
    _, _, chain = trained
    docs = make_docs([(1, None), (None, ""), (1, "vrex Grolk brunk zqualify " * 9000), (1, None)]).withColumn("rejected", F.lit("x"))
    rows = toxicity.score(docs, chain).collect()
    assert sorted(r.rejected for r in rows) == [False, False, False, True] and len({r.p_toxic for r in rows if not r.rejected}) == 1
    left = toxicity.drop_toxic(docs, chain)
    assert left.columns == docs.columns and left.count() == 3
    assert toxicity.score(docs.limit(0), chain).count() == 0


def test_labels_that_teach_nothing(spark, make_docs):
    docs = make_docs([(i, "some words here") for i in range(20)])
    empty = toxicity.train(docs, spark.createDataFrame([], LABELS), CATEGORIES)
    assert not any(r.rejected for r in toxicity.score(docs, empty).collect())
    one = toxicity.train(docs, spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(None, 0, 1), (3, None, 1), (99, 0, 1)], LABELS), CATEGORIES)
    assert not any(r.rejected for r in toxicity.score(docs, one).collect())


def test_repeated_labels_take_the_highest(spark, make_docs):
    docs = make_docs([(i, ("bad " if i % 2 else "good ") * 3) for i in range(60)])
    labels = [(i, 1, 0) for i in range(60)] + [(i, 1, 1) for i in range(1, 60, 2)]
    chain = toxicity.train(docs, spark.createDataFrame(labels, LABELS), CATEGORIES)
    assert {r.doc_id % 2: r.rejected for r in toxicity.score(docs, chain).collect()} == {0: False, 1: True}
