import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType())])

PARTS = ["a", "B", "é", " ", "\n", "\t", "'s", "'", "ß", "İ", "Σ", "ς", "́", "<|endoftext|>", "<|", "\x1c", "\xa0", " ", "中", "²", "½", "9", "!!", "😀", "ﬁ", "Ǆ", "\x00", "\x7f", "\xad", "  ", "the ", "ing"]


def odd_texts(n: int, seed: int = 1) -> list[str]:
    """Short texts of awkward characters."""
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PARTS) for _ in range(rnd.randrange(30))) for _ in range(n)]


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows):
        return spark.createDataFrame([(*r, *[None] * (3 - len(r))) for r in rows], DOCS)

    return make
