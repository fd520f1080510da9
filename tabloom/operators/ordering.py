"""Row numbers and running totals over groups of any size.

A plain window sends a whole group (or, without one, the whole table) to one
task. Here rows are range-partitioned on group, order and a tie-breaker, so a
group that holds a third of the table, or a third of the table in equal rows,
is spread over many partitions; the counts per partition give each one its
offset. The range-partitioned rows are written once, so that the partition
numbers are data and a retried task cannot change them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.columns import col
from tabloom.session import parts_for, write_table

SMALL_ROWS = 500_000
PART = "_part"
TIE = "_tie"


def numbered(
    df: DataFrame,
    groups: Sequence[str],
    order: Sequence[Column],
    name: str = "position",
    small_rows: int = SMALL_ROWS,
    rows: int | None = None,
) -> DataFrame:
    """``row_number()`` within ``groups`` by ``order``, 1-based. ``rows`` is the number of rows, where it is known."""
    rows = df.count() if rows is None else rows
    if rows <= small_rows:
        window = Window.partitionBy(*[col(g) for g in groups]).orderBy(*order)
        return df.withColumn(name, F.row_number().over(window).cast("bigint"))
    table = range_parts(df, groups, order, rows)
    per_part = table.groupBy(*[col(g) for g in groups], PART).agg(F.count("*").alias("_n"))
    earlier = (
        Window.partitionBy(*[col(g) for g in groups])
        .orderBy(PART)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = per_part.select(
        *[col(g).alias(f"_g{i}") for i, g in enumerate(groups)],
        F.col(PART).alias("_p"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"),
    )
    same = F.col(PART) == F.col("_p")
    for i, g in enumerate(groups):
        same = same & col(g).eqNullSafe(F.col(f"_g{i}"))
    inside = Window.partitionBy(*[col(g) for g in groups], PART).orderBy(*order, TIE)
    return (
        table.withColumn("_local", F.row_number().over(inside))
        .join(offsets, same, "left")
        .withColumn(name, F.col("_local") + F.col("_offset"))
        .drop("_local", "_offset", "_p", PART, TIE, *[f"_g{i}" for i in range(len(groups))])
    )


def running(
    df: DataFrame,
    order: Sequence[Column],
    sums: Mapping[str, Column],
    lasts: Mapping[str, Column] | None = None,
    small_rows: int = SMALL_ROWS,
) -> DataFrame:
    """Running sums and last non-null values over the whole table's order."""
    lasts = lasts or {}
    inputs = {f"_s{i}": c for i, c in enumerate(sums.values())}
    inputs |= {f"_l{i}": c for i, c in enumerate(lasts.values())}
    narrow = df.withColumns(inputs)
    rows = df.count()
    if rows <= small_rows:
        window = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return _with_running(narrow, window, sums, lasts).drop(*inputs)
    table = range_parts(narrow, [], order, rows)
    per_part = table.groupBy(PART).agg(
        *[F.sum(f"_s{i}").alias(f"_s{i}") for i in range(len(sums))],
        *[
            F.max_by(f"_l{i}", F.when(F.col(f"_l{i}").isNotNull(), F.struct(*_keys(order), F.col(TIE)))).alias(f"_l{i}")
            for i in range(len(lasts))
        ],
    )
    earlier = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    carried = per_part.select(
        F.col(PART).alias("_p"),
        *[F.coalesce(F.sum(f"_s{i}").over(earlier), F.lit(0)).alias(f"_cs{i}") for i in range(len(sums))],
        *[F.last(f"_l{i}", ignorenulls=True).over(earlier).alias(f"_cl{i}") for i in range(len(lasts))],
    )
    inside = Window.partitionBy(PART).orderBy(*order, TIE).rowsBetween(Window.unboundedPreceding, 0)
    out = _with_running(table, inside, sums, lasts)
    # one row per range partition: a bounded table
    out = out.join(F.broadcast(carried), F.col(PART) == F.col("_p"), "left")
    for i, name in enumerate(sums):
        out = out.withColumn(name, F.col(name) + F.col(f"_cs{i}"))
    for i, name in enumerate(lasts):
        out = out.withColumn(name, F.coalesce(F.col(name), F.col(f"_cl{i}")))
    helpers = [f"_cs{i}" for i in range(len(sums))] + [f"_cl{i}" for i in range(len(lasts))]
    return out.drop("_p", PART, TIE, *inputs, *helpers)


def _with_running(df, window, sums, lasts):
    named = {name: F.coalesce(F.sum(f"_s{i}").over(window), F.lit(0)) for i, name in enumerate(sums)}
    named |= {name: F.last(f"_l{i}", ignorenulls=True).over(window) for i, name in enumerate(lasts)}
    return df.withColumns(named)


def _keys(order: Sequence[Column]) -> list[Column]:
    return [c.alias(f"_k{i}") for i, c in enumerate(order)]


def range_parts(df: DataFrame, groups: Sequence[str], order: Sequence[Column], rows: int) -> DataFrame:
    """Rows range-partitioned on (groups, order, tie-breaker), part number kept."""
    parts = parts_for(df.sparkSession, rows)
    spread = (
        df.withColumn(TIE, F.monotonically_increasing_id())
        .repartitionByRange(parts, *[col(g) for g in groups], *order, TIE)
        .withColumn(PART, F.spark_partition_id())
    )
    return write_table(spread, "ranges")
