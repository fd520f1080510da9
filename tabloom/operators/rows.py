"""Row-level operators: preview, sample, code mapping, numeric coercion."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.columns import col, digest, hash32
from tabloom.functions.quantiles import order_statistics

TOP_ROWS = 50_000
ALL_ROWS = 1_000_000


def preview(df: DataFrame, key: Sequence[str], n: int = 20) -> DataFrame:
    """The first rows by key; planned as a top-k, not a sort."""
    return df.orderBy(*[col(k) for k in key]).limit(n)


def sample_rows(df: DataFrame, n: int, key: Sequence[str], seed: int = 42, top_rows: int = TOP_ROWS) -> DataFrame:
    """Exactly ``n`` rows, chosen by a seeded hash of the row key.

    ``key`` must identify a row. A small ``n`` is a top-k. A large one would
    gather ``n`` rows in one task, so the hash of the n-th row is looked up as
    an exact order statistic; rows below it pass a plain filter and only the
    few rows that share it are ranked.
    """
    order = [digest(seed, *key), *[col(k) for k in key]]
    total = df.count()
    if n >= total:
        return df
    df = _lowest_hashes(df, n, total, key, seed)
    if n <= top_rows:
        return df.orderBy(*order).limit(n)
    hashed = df.withColumn("_hash", hash32(seed, *key).cast("double"))
    cut = order_statistics(hashed, {"_hash": F.col("_hash")}, {"_hash": {n - 1}})["_hash"][n - 1]
    below = hashed.where(F.col("_hash") < cut)
    edge = hashed.where(F.col("_hash") == cut).orderBy(*order).limit(n - below.count())
    return below.unionByName(edge).drop("_hash")


def _lowest_hashes(df: DataFrame, n: int, total: int, key: Sequence[str], seed: int) -> DataFrame:
    """Leave out rows whose hash is surely too large, where that pays off.

    Every task would otherwise send its own ``n`` best rows to the last one.
    Falls back to all rows if the guess was too low, so the sample is exact.
    """
    share = (n + 10.0 * math.sqrt(n) + 100.0) / total
    if total <= ALL_ROWS or share > 0.5:
        return df
    low = df.where(hash32(seed, *key) < F.lit(int(share * 2**32)))
    return low if low.count() >= n else df


def map_codes(df: DataFrame, column: str, names: Mapping[int, str], output: str | None = None) -> DataFrame:
    """Replace codes by names; a code without a name becomes null."""
    pairs = [F.lit(x) for item in names.items() for x in item]
    lookup = F.create_map(*pairs)
    return df.withColumn(output or column, F.try_element_at(lookup, col(column)))


def numeric_or_null(column: Column) -> Column:
    """Text to double; blanks and junk become null."""
    return F.trim(column).try_cast("double")


def coerce_numeric(df: DataFrame, column: str, output: str | None = None) -> DataFrame:
    return df.withColumn(output or column, numeric_or_null(col(column)))
