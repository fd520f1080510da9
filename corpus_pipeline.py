"""A corpus prepared for training: stages over ``documents``, each on what the last one kept.

Documents that the toxicity chain rejects go, then all but one of each group of
equal texts, then all but one of each group of near copies; what is left is
mixed to the sources' target weights (a document taken more than once is as many
rows) and packed into sequences of token ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tabloom.llm import exact_dedup, mixing, packing, simhash, toxicity
from tabloom.llm.common import table
from tabloom.llm.queries import WORD_VOCABULARY, toxicity_chain
from tabloom.session import write_table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain, trained on the labels, does not reject."""
    return toxicity.drop_toxic(docs, toxicity_chain(docs, table(spark, sf_dir, "labels")))


def drop_equal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return exact_dedup.drop_equal(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies the document with the smallest id."""
    return simhash.drop_near(docs, words=3, bits=3)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.take(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 ids."""
    packed = packing.pack(docs, WORD_VOCABULARY, end_id=1, size=2048)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", reject_toxic),
    ("exact dedup", drop_equal),
    ("near dedup", drop_near),
    ("mixing", mix_sources),
    ("packing", pack),
]

# the tokenizer and the classifiers have no SQL
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"pipeline": run}
ORACLES: dict[str, str] = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
