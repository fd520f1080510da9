"""Column helpers shared by all operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLOATING = (T.FloatType, T.DoubleType)


def quoted(name: str) -> str:
    """Backtick-quote a column name (names may hold dots or spaces)."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def missing_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into null in every floating column, so both mean missing."""
    floating = [f.name for f in df.schema.fields if isinstance(f.dataType, FLOATING)]
    if not floating:
        return df
    return df.withColumns(
        {name: F.nanvl(col(name), F.lit(None).cast(df.schema[name].dataType)) for name in floating}
    )


def as_double(name: str) -> Column:
    """The column as double with NaN read as null."""
    value = col(name).cast("double")
    return F.nanvl(value, F.lit(None).cast("double"))


def as_text(df: DataFrame, name: str) -> Column:
    """The column as text, with -0.0 and 0.0 alike and NaN read as null."""
    if isinstance(df.schema[name].dataType, FLOATING):
        return (as_double(name) + F.lit(0.0)).cast("string")
    return col(name).cast("string")


def rounded(column: Column, digits: int) -> Column:
    """Round for comparison and printing; adding 0.0 removes a negative zero."""
    return F.round(column, digits) + F.lit(0.0)


def hash32(seed: int, *keys: str | Column) -> Column:
    """Seeded, engine-independent 32-bit hash of a row key, as bigint.

    The first eight hex digits of an md5: the same number in every SQL engine,
    on every partitioning and after every retry of a task.
    """
    return F.conv(F.substring(digest(seed, *keys), 1, 8), 16, 10).cast("bigint")


def digest(seed: int, *keys: str | Column) -> Column:
    """md5 of the seed and the key's texts; a null has a mark of its own, so its place counts."""
    columns = [col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("\0null")) for c in columns]))


def rows_from_columns(stats: DataFrame, entries: Sequence[Sequence[Column]], names: Sequence[str]) -> DataFrame:
    """Turn one wide row of statistics into one row per entry."""
    structs = [
        F.struct(*[value.alias(name) for name, value in zip(names, entry)]) for entry in entries
    ]
    return stats.select(F.inline(F.array(*structs)))


def text_values(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Long table ``(keep..., column, value)`` of the given columns as text."""
    narrow = df.select(*[col(k) for k in keep], *[as_text(df, c).alias(c) for c in columns])
    return narrow.unpivot(
        [col(k) for k in keep], [col(c) for c in columns], "column", "value"
    )
