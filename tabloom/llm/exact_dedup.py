"""Exact duplicates of whole texts, found through recipes of content-defined chunks.

A text is cut where its own content says so: at the first sentence or line end
after ``SHORTEST`` characters, at ``LONGEST`` at the latest. Each chunk gets a
128-bit identifier. One pass over the distinct chunks verifies that no
identifier stands for two contents (if one did, identifiers are drawn anew with
other seeds), after which two texts are equal exactly if their ordered lists of
identifiers are. Only those lists, a sixtieth of the text or less, are grouped;
texts themselves move once, as distinct chunks, whatever their length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import col, fresh, text_of
from tabloom.session import write_table

SHORTEST, LONGEST = 256, 8192
CHUNK = rf"(?s).{{{SHORTEST},{LONGEST}}}?(?:\n|[.!?] )|.{{1,{LONGEST}}}"
ROUNDS = 8

Identify = Callable[[Column, int], list[Column]]


def identifiers(chunk: Column, attempt: int) -> list[Column]:
    """Two 64-bit hashes of a chunk under seeds of this attempt."""
    return [F.xxhash64(F.lit(2 * attempt + i), chunk) for i in range(2)]


def chunks_of(text: Column) -> Column:
    """The chunks of a text in order; joined they are the text."""
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def verified(texts: DataFrame, attempt: int, identify: Identify = identifiers) -> bool:
    """True if no identifier of this attempt stands for two different chunks."""
    chunks = texts.select(F.explode(chunks_of(F.col("text"))).alias("chunk"))
    ids = [c.alias(f"i{k}") for k, c in enumerate(identify(F.col("chunk"), attempt))]
    names = [f"i{k}" for k in range(len(ids))]
    distinct = chunks.select(*ids, "chunk").distinct()
    return distinct.groupBy(*names).agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def equal_texts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] = lambda text: text,
    identify: Identify = identifiers,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical after ``normalise`` (nothing by default); null
    counts as empty. Of equal texts the row with the largest id stays (a null id
    is smaller than any); of rows that agree in text and id one stays. Rows with
    no equal are kept in groups of one. An empty table gives no rows. Other
    columns of ``docs`` are not read.
    """
    texts = docs.select(col(id_col).alias("id"), normalise(text_of(text_col)).alias("text"))
    for attempt in range(ROUNDS):
        if verified(texts, attempt, identify):
            break
    else:
        raise RuntimeError(f"no identifiers without collision in {ROUNDS} attempts")
    recipe = F.transform(chunks_of(F.col("text")), lambda chunk: F.struct(*identify(chunk, attempt)))
    narrow = write_table(
        texts.select("id", recipe.alias("recipe"), F.sha2("text", 256).alias("sha256"))
        .withColumn("row", F.monotonically_increasing_id())
        .withColumn("digest", F.xxhash64("recipe")),
        "recipes",
    )
    last = F.max(F.struct(F.col("id"), F.col("row"))).alias("last")
    groups = narrow.groupBy("digest", "recipe").agg(F.count("*").alias("group_size"), last)
    # written, so that both sides of the join are dealt afresh and a group of any size is split
    groups = write_table(groups.where("group_size > 1"), "copies")
    same = (F.col("n.digest") == F.col("g.digest")) & (F.col("n.recipe") == F.col("g.recipe"))
    return (
        narrow.alias("n")
        .join(groups.alias("g"), same, "left")
        .select(
            F.col("n.id").alias(id_col),
            F.when(F.col("g.last").isNull(), F.col("n.id")).otherwise(F.col("g.last.id")).alias("keep_id"),
            F.coalesce("g.group_size", F.lit(1)).cast("long").alias("group_size"),
            (F.col("g.last").isNull() | (F.col("g.last.row") == F.col("n.row"))).alias("kept"),
            F.col("n.sha256").alias("text_sha256"),
        )
    )


def drop_equal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns as they are."""
    marked = write_table(equal_texts(docs, id_col, text_col), "kept")
    ours = fresh(docs, "kept_id", "kept_sha")
    stay = marked.where("kept").select(col(id_col).alias(ours[0]), F.col("text_sha256").alias(ours[1]))
    sha = F.sha2(text_of(text_col), 256)
    found = docs.join(stay, col(id_col).eqNullSafe(F.col(ours[0])) & (sha == F.col(ours[1])))
    if not marked.groupBy(id_col, "text_sha256").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        found = found.dropDuplicates(ours)  # rows that agree in id and text
    return found.select(*[col(c) for c in docs.columns])
