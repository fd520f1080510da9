"""Mixing sources to target weights by entropy balancing.

Each source gets a target of words from its weight; targets stop at a multiple
of what the source holds. Within a source, documents get rates that stay as
close to one as relative entropy allows while their words add up to the target:
exponentially tilted rates, exp(tilt * size), limited to the same multiple. The
tilt solves a convex dual with one unknown per source, found by Newton steps on
a table of (source, size, documents); each step is one aggregate over it. Rates
are then rounded into whole copies by (source, size): the documents of one size
get a whole number of copies together, and what rounding leaves over goes on from
large sizes to smaller ones. The copies of a size are dealt to its documents by
their place in a hash order, so no group of documents is ever gathered.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import col, fresh, text_of, without
from tabloom.operators.ordering import numbered
from tabloom.session import write_table

WORD = r"[^\x20\x09-\x0D]+"
MULTIPLE = 3
WEIGHTS = (1.0, 2.0, 3.0)
STEPS = 60
CLOSE = 1e-7
FAR = 1e-3


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, multiple: int = MULTIPLE) -> DataFrame:
    """``sources`` (source, source_size) with the target of each.

    Sources in code point order, null last, have the weights in turn and share
    the sum of all sizes; a target stops at ``multiple`` times its source's size,
    and what lies above is shared again by weight among the others.
    """
    ranked = numbered(sources, [], [F.col("source").asc_nulls_last()], "rank")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = write_table(ranked.withColumn("weight", F.element_at(cycle, ((F.col("rank") - 1) % len(weights) + 1).cast("int"))), "sources")
    most = F.col("source_size") * F.lit(float(multiple))
    level = -1.0
    while True:  # each turn stops at least one more source, or none and ends
        stopped = most <= F.col("weight") * F.lit(level)
        r = ranked.agg(
            F.sum("source_size").alias("total"),
            F.sum(F.when(stopped, most)).alias("full"),
            F.sum(F.when(~stopped, F.col("weight"))).alias("weight"),
        ).first()
        above = ((r.total or 0) - (r.full or 0.0)) / r.weight if r.weight else level
        if above <= level + abs(level) * 1e-12:
            break
        level = above
    return ranked.select("source", "source_size", F.least(F.col("weight") * F.lit(max(level, 0.0)), most).alias("target"))


def tilts(sizes: DataFrame, goals: DataFrame, multiple: int = MULTIPLE) -> DataFrame:
    """The tilt of each source: columns source, mean, tilt (null where every document is taken in full).

    ``sizes`` has source, size, documents; ``goals`` has source, source_size, target.
    The gradient of the dual, the words taken at a tilt less the target, rises
    with the tilt. Steps are Newton's on the logarithm of the words taken, which
    is nearly straight, and are kept inside the bracket found so far.
    """
    means = sizes.where("size > 0").groupBy("source").agg((F.sum(F.col("size") * F.col("documents")) / F.sum("documents")).alias("mean"))
    state = (
        goals.where(F.col("target") < F.col("source_size") * multiple)
        .alias("g")
        .join(means.alias("m"), F.col("g.source").eqNullSafe(F.col("m.source")))
        .selectExpr("g.source", "g.target", "m.mean", "0D AS tilt", "CAST(NULL AS DOUBLE) AS low", "CAST(NULL AS DOUBLE) AS high")
    )
    state = write_table(state, "tilts")
    cap = math.log(multiple)
    for _ in range(STEPS):
        at = state.alias("t")
        x = F.col("size") / F.col("mean")
        rate = F.exp(F.least(F.col("tilt") * x, F.lit(cap)))
        free = F.col("tilt") * x < cap
        seen = (
            sizes.where("size > 0")
            .alias("s")
            .join(at, F.col("s.source").eqNullSafe(F.col("t.source")))
            .groupBy(F.col("t.source").alias("source"))
            .agg(
                F.first("target").alias("target"),
                F.first("mean").alias("mean"),
                F.first("tilt").alias("tilt"),
                F.first("low").alias("low"),
                F.first("high").alias("high"),
                F.sum(rate * F.col("size") * F.col("documents")).alias("taken"),
                F.sum(F.when(free, rate * x * F.col("size") * F.col("documents")).otherwise(0.0)).alias("slope"),
            )
        )
        error = F.log(F.col("taken") / F.col("target"))
        low = F.when(error < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(error > 0, F.col("tilt")).otherwise(F.col("high"))
        step = F.col("tilt") - error * F.col("taken") / F.col("slope")
        middle = F.coalesce(
            (F.col("new_low") + F.col("new_high")) / 2,
            F.col("new_low") + F.greatest(F.lit(1.0), F.abs("new_low")),
            F.col("new_high") - F.greatest(F.lit(1.0), F.abs("new_high")),
        )
        outside = (
            F.col("step").isNull()
            | F.isnan("step")
            | (F.abs("step") > 1e6)
            | F.coalesce(F.col("step") <= F.col("new_low"), F.lit(False))
            | F.coalesce(F.col("step") >= F.col("new_high"), F.lit(False))
        )
        done = F.abs("error") <= CLOSE
        moved = seen.select("source", "target", "mean", "tilt", error.alias("error"), low.alias("new_low"), high.alias("new_high"), step.alias("step"))
        state = write_table(
            moved.select(
                "source", "target", "mean",
                F.when(done, F.col("tilt")).when(outside, middle).otherwise(F.col("step")).alias("tilt"),
                F.col("new_low").alias("low"), F.col("new_high").alias("high"), done.alias("done"), "error",
            ),
            "tilts",
        )
        if state.where(~F.col("done")).isEmpty():
            break
    else:
        if not state.where(F.abs("error") > FAR).isEmpty():
            raise RuntimeError(f"no tilt found in {STEPS} steps")
    # rounded, so that the order in which a cluster adds doubles leaves no trace
    return state.select("source", "mean", F.round("tilt", 5).alias("tilt"))


def _whole(multiple: int):
    """Copies that the documents of each size of one source get together: largest first, what is left over carried on."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size", ascending=False, kind="stable")
        copies, carry = [], 0.0
        for size, documents, rate in zip(rows["size"].tolist(), rows["documents"].tolist(), rows["rate"].tolist()):
            if not size:
                copies.append(documents)
                continue
            want = rate * size * documents + carry
            copies.append(min(multiple * documents, max(0, math.floor(want / size + 0.5))))
            carry = want - copies[-1] * size
        return rows.assign(copies=np.array(copies, np.int64))[["source", "size", "documents", "copies"]]

    return run


def _mixed(docs: DataFrame, weights: Sequence[float], multiple: int, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, list[str]]:
    """``docs`` with size, source_size, target and copies under names of their own, and these names."""
    size = word_count(text_of(text_col))
    narrow = docs.select(col(id_col).alias("id"), col(source_col).alias("source"), size.alias("size"))
    units = write_table(narrow.groupBy("id", "source").agg(F.sum("size").alias("size")), "units")
    sizes = write_table(units.groupBy("source", "size").agg(F.count("*").alias("documents")), "sizes")
    totals = write_table(sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("documents")).alias("source_size")), "totals")
    goals = write_table(targets(totals, weights, multiple), "goals")
    found = tilts(sizes, goals, multiple)
    rate = F.when(F.col("f.tilt").isNull(), F.lit(float(multiple))).otherwise(
        F.exp(F.least(F.col("f.tilt") * F.col("s.size") / F.col("f.mean"), F.lit(math.log(multiple))))
    )
    rated = sizes.alias("s").join(found.alias("f"), F.col("s.source").eqNullSafe(F.col("f.source")), "left")
    rated = rated.select("s.source", "s.size", "s.documents", rate.alias("rate"))
    source_type = units.schema["source"].dataType.simpleString()
    # a row for each different size of a source, however many documents have it
    whole = rated.groupBy("source").applyInPandas(_whole(multiple), f"source {source_type}, size long, documents long, copies long")
    whole = write_table(whole, "whole")
    # within a size, documents come in an order of their own; the first of them get what does not divide
    order = F.xxhash64("id", "source")
    placed = write_table(numbered(units.withColumn("order", order), ["source", "size"], [F.col("order"), F.col("id")], "place", small_rows=0), "placed")
    same = F.col("p.source").eqNullSafe(F.col("w.source")) & (F.col("p.size") == F.col("w.size"))
    share = F.floor(F.col("w.copies") / F.col("w.documents")) + (F.col("p.place") <= F.col("w.copies") % F.col("w.documents")).cast("long")
    copies = placed.alias("p").join(whole.alias("w"), same).select("p.id", "p.source", share.cast("long").alias("copies"))
    copies = write_table(copies, "copies")
    names = fresh(docs, "size", "source_size", "target", "copies", "mix_id", "mix_source", "fact_source")
    ours = copies.select(F.col("id").alias(names[4]), F.col("source").alias(names[5]), F.col("copies").alias(names[3]))
    facts = goals.select(F.col("source").alias(names[6]), F.col("source_size").alias(names[1]), F.col("target").alias(names[2]))
    joined = (
        docs.withColumn(names[0], size)
        .join(ours, col(id_col).eqNullSafe(F.col(names[4])) & col(source_col).eqNullSafe(F.col(names[5])))
        .join(facts, col(source_col).eqNullSafe(F.col(names[6])))
    )
    return joined, names[:4]


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    multiple: int = MULTIPLE,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """``docs`` with size, source_size, target, copies and taken.

    ``size`` is the number of words (runs without ASCII white space; null text:
    0), ``copies`` how often the mix takes the document, 0 to ``multiple``, and
    ``taken`` its words that the mix takes. A document without words is taken
    once. Rows that agree in id and source are one unit and get the same number
    of copies; ids and sources may be null. Reruns over the same rows agree,
    however the rows are stored. Input columns with one of the five names, case
    ignored, are replaced. An empty table stays empty.
    """
    new = ("size", "source_size", "target", "copies", "taken")
    joined, names = _mixed(docs, weights, multiple, id_col, text_col, source_col)
    values = [F.col(n) for n in names]
    return joined.select(*[col(c) for c in without(docs, *new)], *[v.alias(n) for v, n in zip(values, new)], (values[3] * values[0]).alias("taken"))


def take(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    multiple: int = MULTIPLE,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as the mix takes it, all its columns as they are."""
    joined, names = _mixed(docs, weights, multiple, id_col, text_col, source_col)
    (copy,) = fresh(joined, "copy")
    repeated = joined.where(F.col(names[3]) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(names[3]).cast("int"))))
    return repeated.select(*[col(c) for c in docs.columns])
