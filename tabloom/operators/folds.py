"""Reproducible folds and splits from a seeded hash of the row key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.columns import col, digest, hash32
from tabloom.operators.ordering import SMALL_ROWS
from tabloom.session import parts_for

SEED = 42
COPIES_PER_CHUNK = 100_000
# rows that one task writes out when counted rows are expanded
ROWS_PER_TASK = 250_000


def effective_folds(folds: int, limit: int) -> int:
    """At least 2, at most the smallest class (or the number of rows)."""
    return max(2, min(folds, limit))


def stratified_folds(
    df: DataFrame,
    strata: Sequence[str],
    k: int,
    key: Sequence[str] | None = None,
    seed: int = SEED,
    small_rows: int = SMALL_ROWS,
) -> DataFrame:
    """Add ``fold``: within each stratum fold sizes differ by at most one.

    Rows are numbered per stratum in hash order, modulo ``k``. One task per
    class would not scale, so beyond ``small_rows`` rows are numbered within
    (stratum, hash range) and shifted by the counts of the ranges before; the
    answer is the same. ``key`` must identify a row. Without a key, equal rows
    are counted first, numbered as one, and expanded again.
    """
    if key is None:
        return _folds_without_key(df, strata, k, seed, small_rows)
    order = [digest(seed, *key), *[col(c) for c in key]]
    rows = df.count()
    if rows <= small_rows:
        window = Window.partitionBy(*[col(s) for s in strata]).orderBy(*order)
        return df.withColumn("fold", F.pmod(F.row_number().over(window) - 1, F.lit(k)).cast("bigint"))
    groups = [f"_s{i}" for i in range(len(strata))]
    ranged = df.withColumns(
        {g: col(s) for g, s in zip(groups, strata)} | {"_range": hash_range(df, seed, key, rows)}
    )
    offsets = _offsets(ranged, groups, F.count("*"))
    inside = Window.partitionBy(*groups, "_range").orderBy(*order)
    return _shifted(ranged.withColumn("_local", F.row_number().over(inside) - 1), offsets, groups).withColumn(
        "fold", F.pmod(F.col("_local") + F.col("_offset"), F.lit(k)).cast("bigint")
    ).drop(*groups, "_range", "_local", "_offset")


def hash_range(df: DataFrame, seed: int, key: Sequence[str], rows: int) -> Column:
    """Equal slices of the hash space, as many as the rows need: never skewed."""
    ranges = parts_for(df.sparkSession, rows)
    return F.floor(hash32(seed, *key) * F.lit(float(ranges)) / F.lit(2.0**32)).cast("bigint")


def _offsets(ranged: DataFrame, groups: list[str], size: Column) -> DataFrame:
    """Rows in earlier hash ranges of the same stratum, one row per pair."""
    earlier = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy(*groups, "_range").agg(size.alias("_n"))
    return counts.select(
        *[F.col(g).alias(f"_o{g}") for g in groups],
        F.col("_range").alias("_orange"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"),
    )


def _shifted(rows: DataFrame, offsets: DataFrame, groups: list[str]) -> DataFrame:
    same = F.col("_range") == F.col("_orange")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_o{g}"))
    return rows.join(offsets, same, "left").drop("_orange", *[f"_o{g}" for g in groups])


def _folds_without_key(df, strata, k, seed, small_rows):
    columns, rows = df.columns, df.count()
    distinct = df.groupBy(*[col(c) for c in columns]).agg(F.count("*").alias("_copies"))
    groups = [f"_s{i}" for i in range(len(strata))]
    row_hash = F.md5(F.to_json(F.struct(F.lit(seed), *[col(c) for c in columns]), {"ignoreNullFields": "false"}))
    ranged = distinct.withColumns({g: col(s) for g, s in zip(groups, strata)} | {"_hash": row_hash})
    ranged = ranged.withColumn("_range", hash_range(df, seed, ["_hash"], rows))
    inside = (
        Window.partitionBy(*groups, "_range").orderBy("_hash").rowsBetween(Window.unboundedPreceding, -1)
    )
    local = ranged.withColumn("_local", F.coalesce(F.sum("_copies").over(inside), F.lit(0)))
    first = _shifted(local, _offsets(ranged, groups, F.sum("_copies")), groups).select(
        *[col(c) for c in columns], "_copies", (F.col("_local") + F.col("_offset")).alias("_first")
    )
    # expand copies in two steps, so that a row that fills a third of the table
    # is spread before it is written out
    chunk = F.lit(COPIES_PER_CHUNK)
    chunks = first.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("_copies") - 1) / chunk))))
    if rows > small_rows:
        # a number of its own: counted rows are few bytes, and would be put together into one task
        chunks = chunks.repartition(-(-rows // ROWS_PER_TASK), *[col(c) for c in columns], "_chunk")
    begin = F.col("_chunk") * chunk
    end = F.least(begin + chunk, F.col("_copies")) - 1
    copies = chunks.withColumn("_copy", F.explode(F.sequence(begin, end)))
    return copies.select(
        *[col(c) for c in columns],
        F.pmod(F.col("_first") + F.col("_copy"), F.lit(k)).cast("bigint").alias("fold"),
    )


def hash_folds(df: DataFrame, k: int, key: Sequence[str], seed: int = SEED) -> DataFrame:
    """Map-only folds: no shuffle, sizes balanced in expectation."""
    return df.withColumn("fold", F.pmod(hash32(seed, *key), F.lit(k)).cast("bigint"))


def train_test_split(df: DataFrame, key: Sequence[str], test_share: float = 0.2, seed: int = SEED) -> DataFrame:
    """Map-only split: adds ``is_test``."""
    threshold = int(test_share * 2**32)
    return df.withColumn("is_test", hash32(seed, *key) < F.lit(threshold))


def assign_folds(
    df: DataFrame,
    target: str,
    problem_type: str,
    folds: int,
    key: Sequence[str] | None = None,
    seed: int = SEED,
    rows: int | None = None,
    smallest: int | None = None,
) -> tuple[DataFrame, int]:
    """Folds for cross-validation and how many there are.

    Classification is stratified by label; regression is one stratum. Folds are
    balanced exactly at every size. ``rows`` and ``smallest`` (rows of the smallest class) save a pass
    if they are known.
    """
    if problem_type == "classification":
        if smallest is None:
            smallest = df.groupBy(col(target)).agg(F.count("*").alias("n")).agg(F.min("n")).first()[0]
        k = effective_folds(folds, smallest)
        return stratified_folds(df, [target], k, key, seed), k
    rows = df.count() if rows is None else rows
    k = effective_folds(folds, rows)
    whole = df.withColumn("_all", F.lit(0))
    return stratified_folds(whole, ["_all"], k, key, seed).drop("_all"), k
