"""Toxicity by a chain of linear classifiers.

Categories are predicted one after the other. Each has a logistic model over
the words of a text and, as further inputs, the probabilities of the categories
before it. A model later in the chain is trained on probabilities that models
of the earlier categories gave to rows they had not seen (out of fold); for
scoring every category has one model fitted on the whole sample.

Training takes a bounded sample of the labelled rows, so the models fit the
driver whatever the corpus holds. Scoring reads every word of every text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import col, fresh, text_of, without
from tabloom.session import write_table

# bounds of the fit: labelled rows, inputs, and rows an input must occur in
SAMPLE = 10_000
INPUTS = 1_000
LEAST_ROWS = 4
FOLDS = 3
LEAST_STRENGTH = 10.83  # chi-square of one degree at one in a thousand
PENALTY = 0.0001
ITERATIONS = 20
PREFIXES = (5, 6, 7)
CACHE_WORDS = 300_000


def words_of(text: str) -> set[str]:
    """The distinct words of a text: runs of letters in lower case."""
    return set(_letters()(text.lower()))


def _letters():
    import re

    return re.compile(r"[^\W\d_]+").findall


def inputs_of(word: str) -> list[str]:
    """What a word tells: itself, and how it begins."""
    marked = f"<{word}>"
    return [marked, *[marked[:n] for n in PREFIXES if len(word) >= n]]


@dataclass
class Link:
    """One category of a chain: weights of inputs, weights of earlier probabilities, and the rest."""

    category: str
    intercept: float
    weights: np.ndarray
    earlier: np.ndarray


@dataclass
class Chain:
    """Models of all categories over one vocabulary of inputs."""

    vocabulary: list[str]
    links: list[Link] = field(default_factory=list)

    def scorer(self):
        """A function from a text to the probabilities of the categories."""
        letters = _letters()
        index = {name: i for i, name in enumerate(self.vocabulary)}
        matrix = np.array([link.weights for link in self.links]).reshape(len(self.links), len(index)).T
        cache: dict[str, np.ndarray | None] = {}

        def weigh(word: str) -> np.ndarray | None:
            if len(cache) >= CACHE_WORDS:
                cache.clear()
            known = [index[i] for i in inputs_of(word) if i in index]
            cache[word] = found = matrix[known].sum(0) if known else None
            return found

        def score(text: str) -> list[float]:
            total = np.zeros(len(self.links))
            for word in set(letters(text.lower())):
                found = cache[word] if word in cache else weigh(word)
                if found is not None:
                    total += found
            out: list[float] = []
            for link, sum_ in zip(self.links, total):
                margin = sum_ + link.intercept + float(np.dot(link.earlier, out))
                out.append(1 / (1 + np.exp(-min(max(margin, -500.0), 500.0))))
            return out

        return score


def _sample(docs: DataFrame, labels: DataFrame, categories: dict[str, str], limit: int, id_col: str, text_col: str) -> DataFrame:
    """Words and labels of at most ``limit`` labelled documents, drawn by a hash of the id."""
    marked = labels.select(col(id_col).alias("id"), *[F.expr(c).cast("double").alias(f"y_{n}") for n, c in categories.items()]).dropna()
    marked = marked.groupBy("id").agg(*[F.max(f"y_{n}").alias(f"y_{n}") for n in categories])
    drawn = marked.orderBy(F.xxhash64("id"), "id").limit(limit)

    @F.pandas_udf("array<string>")
    def tell(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([[i for w in sorted(words_of(t)) for i in inputs_of(w)] for t in batch])

    texts = docs.select(col(id_col).alias("id"), text_of(text_col).alias("text"))
    rows = texts.join(F.broadcast(drawn), "id")  # at most ``limit`` ids
    return write_table(rows.select("id", *[f"y_{n}" for n in categories], tell("text").alias("inputs")), "labelled")


def _vocabulary(rows: DataFrame, categories: Sequence[str], size: int, least: int) -> list[str]:
    """The inputs that speak most for any category, by the chi-square of their presence.

    Inputs that speak against all are left out: common words do, a little each,
    and in a long text their sum would hide the few words that matter.
    """
    total = rows.agg(F.count("*").alias("n"), *[F.sum(f"y_{c}").alias(c) for c in categories]).first()
    if not total.n:
        return []
    seen = rows.select(*[f"y_{c}" for c in categories], F.explode(F.array_distinct("inputs")).alias("input"))
    counts = seen.groupBy("input").agg(F.count("*").alias("n"), *[F.sum(f"y_{c}").alias(c) for c in categories])
    counts = counts.where(F.col("n") >= least)

    def chi(c: str) -> Column:
        n, p = F.lit(float(total.n)), F.lit(float(total[c]))
        a = F.col(c)
        expected = F.col("n") * p / n
        spread = expected * (1 - p / n) * (1 - F.col("n") / n)
        return F.when((spread > 0) & (a > expected), (a - expected) ** 2 / spread).otherwise(0.0)

    strength = F.greatest(F.lit(0.0), *[chi(c) for c in categories])
    best = counts.where(strength > LEAST_STRENGTH).orderBy(strength.desc(), "input").limit(size).select("input").collect()  # ``size`` rows
    return sorted(r.input for r in best)


def _fit(rows: DataFrame, label: str, inputs: str) -> LogisticRegressionModel:
    model = LogisticRegression(
        featuresCol=inputs, labelCol=label, regParam=PENALTY, maxIter=ITERATIONS, standardization=False, probabilityCol="p", rawPredictionCol="raw", predictionCol="class"
    )
    return model.fit(rows)


def train(
    docs: DataFrame,
    labels: DataFrame,
    categories: dict[str, str],
    id_col: str = "doc_id",
    text_col: str = "text",
    sample: int = SAMPLE,
    inputs: int = INPUTS,
    least_rows: int = LEAST_ROWS,
) -> Chain:
    """A chain over ``categories``: name to an expression over ``labels`` that is 0 or 1, in the order they are predicted.

    At most ``sample`` labelled documents are used, and at most ``inputs`` words
    or beginnings of words that occur in ``least_rows`` of them. Rows of labels
    with a null, and ids without a document, are left out; an id labelled more
    than once has the highest of its labels. A category without two classes in
    the sample has a constant probability, zero if there is no sample.
    """
    names = list(categories)
    rows = _sample(docs, labels, categories, sample, id_col, text_col)
    chain = Chain(_vocabulary(rows, names, inputs, least_rows))
    if chain.vocabulary:
        counted = CountVectorizerModel.from_vocabulary(chain.vocabulary, inputCol="inputs", outputCol="words")
        rows = counted.transform(rows)
    rows = rows.drop("inputs").withColumn("fold", F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(FOLDS))).coalesce(4).persist()
    held = [rows]
    width = len(chain.vocabulary)
    for i, name in enumerate(names):
        label, earlier = f"y_{name}", [f"p_{n}" for n in names[:i]]
        classes = [r[0] for r in rows.select(label).distinct().collect()]
        if len(classes) < 2 or not chain.vocabulary:
            share = rows.agg(F.avg(label)).first()[0] or 0.0
            share = min(max(share, 1e-6), 1 - 1e-6)
            chain.links.append(Link(name, float(np.log(share / (1 - share))), np.zeros(width), np.zeros(i)))
            rows = rows.withColumn(f"p_{name}", F.lit(share))
            continue
        given = VectorAssembler(inputCols=["words", *earlier], outputCol="given").transform(rows)
        model = _fit(given, label, "given")
        weights = model.coefficients.toArray()
        chain.links.append(Link(name, float(model.intercept), weights[:width], weights[width:]))
        if name == names[-1]:
            break
        parts = []
        for fold in range(FOLDS):
            apart = given.where(F.col("fold") != fold)
            own = given.where(F.col("fold") == fold)
            if apart.select(label).distinct().count() < 2:
                parts.append(own.withColumn(f"p_{name}", F.lit(apart.agg(F.avg(label)).first()[0] or 0.0)).drop("given"))
                continue
            scored = _fit(apart, label, "given").transform(own)
            parts.append(scored.withColumn(f"p_{name}", vector_to_array("p")[1]).drop("given", "p", "raw", "class"))
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        rows = rows.persist()
        held.append(rows)
    for frame in held:
        frame.unpersist()
    return chain


def probabilities(text: Column, chain: Chain) -> Column:
    """Probabilities of the categories of a chain for a text column, as a struct p_<category>, rounded to six places."""
    names = [f"p_{link.category}" for link in chain.links]
    shape = ", ".join(f"`{n}` double" for n in names)

    @F.pandas_udf(shape)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        each = chain.scorer()
        for batch in batches:
            yield pd.DataFrame([each(t) for t in batch], columns=names).round(6)

    return run(text)


def score(docs: DataFrame, chain: Chain, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """``docs`` with p_<category> for each category, and ``rejected`` if the last reaches ``threshold``.

    Probabilities are rounded to six places. A null or empty text has no words
    and gets the probabilities of the intercepts. Input columns with one of the
    new names, case ignored, are replaced; rows are kept as they are.
    """
    names = [f"p_{link.category}" for link in chain.links]
    (found,) = fresh(docs, "chain")
    scored = docs.withColumn(found, probabilities(text_of(text_col), chain))
    return scored.select(
        *[col(c) for c in without(docs, *names, "rejected")],
        *[F.col(found)[n].alias(n) for n in names],
        (F.col(found)[names[-1]] >= threshold).alias("rejected"),
    )


def drop_toxic(docs: DataFrame, chain: Chain, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows that ``score`` does not reject, all their columns as they are."""
    (found,) = fresh(docs, "chain")
    last = f"p_{chain.links[-1].category}"
    scored = docs.withColumn(found, probabilities(text_of(text_col), chain))
    return scored.where(F.col(found)[last] < threshold).select(*[col(c) for c in docs.columns])
