"""Exact order statistics by radix selection, without sorting, sketching or gathering a column.

A double becomes a 64-bit key of the same order. Each pass counts, for the
stretches of keys that still hold a wanted rank, how many keys have each of the
next 12 bits, and the least and the largest of them; the counts tell in which
cell a rank lies. A rank is found once its cell holds one value only, after six
passes at most whatever the table. All columns, ranks and groups share the
passes, and what a task holds or sends is a row per cell.

The rows of "all groups but one" need no pass of their own: cells are counted by
group, and a part leaves out those of its group.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 12
CELLS = 1 << BITS
CHUNK = 150
# columns that one pass counts together
TOGETHER = 64
TOP = np.uint64(1 << 63)
NOTHING = None


def keys_of(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit keys in the order of the doubles; both zeros are one, and so are all NaN, after everything else."""
    bits = np.where(np.isnan(x), np.nan, x + 0.0).view(np.uint64)
    return np.where(bits & TOP, ~bits, bits | TOP)


def value_of(key: int) -> float:
    bits = np.array([key], np.uint64)
    return float(np.where(bits & TOP, bits ^ TOP, ~bits).view(np.float64)[0])


def chunked_agg(df: DataFrame, expressions: Mapping[str, Column], chunk: int = CHUNK) -> dict:
    """Evaluate many global aggregates, ``chunk`` of them per pass."""
    names = list(expressions)
    result: dict = {}
    for start in range(0, len(names), chunk):
        part = names[start : start + chunk]
        row = df.agg(*[expressions[n].alias(f"a{i}") for i, n in enumerate(part)]).first()
        result.update({n: row[i] for i, n in enumerate(part)})
    return result


def exact_quantiles(df: DataFrame, values: Mapping[str, Column], probabilities: Sequence[float]) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles of several expressions, exactly.

    ``values`` maps a name to a double expression (null = not counted).
    Returns one list per name, in the order of ``probabilities``.
    """
    found = quantiles_without(df, values, probabilities)
    return {name: quantiles for (_, name), quantiles in found.items()}


def quantiles_without(
    df: DataFrame, values: Mapping[str, Column], probabilities: Sequence[float], group: Column | None = None, parts: Sequence[int | None] = (NOTHING,)
) -> dict[tuple, list[float | None]]:
    """Quantiles by (part, name), where a part is all rows but those of one group (``None``: all rows)."""

    def ranks(n: int) -> set[int]:
        wanted = [p * (n - 1) for p in probabilities] if n else []
        return {r for rank in wanted for r in (math.floor(rank), math.ceil(rank))}

    result: dict[tuple, list[float | None]] = {}
    for key, (n, at) in ordered(df, values, ranks, group, parts).items():
        result[key] = []
        for p in probabilities:
            rank = p * (n - 1)
            low, high = (at[math.floor(rank)], at[math.ceil(rank)]) if n else (None, None)
            result[key].append(low + (high - low) * (rank - math.floor(rank)) if n and low != high else low)
    return result


def order_statistics(df: DataFrame, values: Mapping[str, Column], wanted: Mapping[str, set[int]]) -> dict[str, dict[int, float]]:
    """Values at zero-based ranks: ``{name: {rank: value}}``."""
    out = {}
    for name, ranks in wanted.items():
        out[name] = ordered(df, {name: values[name]}, lambda n, r=ranks: r)[NOTHING, name][1]
    return out


def ordered(
    df: DataFrame,
    values: Mapping[str, Column],
    ranks: Callable[[int], set[int]],
    group: Column | None = None,
    parts: Sequence[int | None] = (NOTHING,),
) -> dict[tuple, tuple[int, dict[int, float]]]:
    """Count, and values at the zero-based ``ranks(count)``, by (part, name)."""
    names = list(values)
    found: dict[tuple, tuple[int, dict[int, float]]] = {}
    groups = sorted(p for p in parts if p is not NOTHING)
    for start in range(0, len(names), TOGETHER):
        own = names[start : start + TOGETHER]
        narrow = df.select(*[values[n].cast("double").alias(f"v{i}") for i, n in enumerate(own)], (group if group is not None else F.lit(0)).cast("long").alias("g"))
        for (part, i), result in _selected(narrow, len(own), ranks, groups, parts).items():
            found[part, own[i]] = result
    return found


def _selected(narrow: DataFrame, width: int, ranks, groups: list[int], parts) -> dict[tuple, tuple[int, dict[int, float]]]:
    found: dict[tuple, tuple[int, dict[int, float]]] = {(part, i): (0, {}) for part in parts for i in range(width)}
    # rank within its stretch, by (part, column, rank)
    left: dict[tuple, tuple[int, int]] = {}
    prefixes: list[set[int]] = [{0} for _ in range(width)]
    level = 0
    while any(prefixes):
        cells = _cells(narrow, width, groups, level, [sorted(p) for p in prefixes])
        if level == 0:
            for part in parts:
                for i in range(width):
                    n = sum(len_ for _, len_, _, _ in _of_part(cells.get((i, 0), {}), part))
                    found[part, i] = (n, {})
                    left |= {(part, i, rank): (0, rank) for rank in (ranks(n) if n else ())}
        onward: dict[tuple, tuple[int, int]] = {}
        for (part, i, rank), (prefix, inside) in left.items():
            for cell, n, low, high in _of_part(cells[i, prefix], part):
                if inside < n:
                    if low == high:
                        found[part, i][1][rank] = value_of(low)
                    else:
                        onward[part, i, rank] = (_further(prefix, cell, level), inside)
                    break
                inside -= n
        left = onward
        prefixes = [set() for _ in range(width)]
        for (_, i, _), (prefix, _) in left.items():
            prefixes[i].add(prefix)
        level += 1
    return found


def _shift(level: int) -> int:
    """Bits below those that a level tells apart."""
    return max(0, 64 - BITS * (level + 1))


def _further(prefix: int, cell: int, level: int) -> int:
    return (prefix << min(BITS, 64 - BITS * level)) + cell


def _of_part(cells: dict[int, list], part: int | None) -> list[tuple[int, int, int, int]]:
    """Cells in order with count, least and largest key, over all groups but one."""
    merged = []
    for cell in sorted(cells):
        own = [(n, low, high) for g, n, low, high in cells[cell] if part is NOTHING or g != part]
        if own:
            merged.append((cell, sum(n for n, _, _ in own), min(low for _, low, _ in own), max(high for _, _, high in own)))
    return merged


def _cells(narrow: DataFrame, width: int, groups: list[int], level: int, prefixes: list[list[int]]) -> dict[tuple, dict[int, list]]:
    """Rows of every cell, by (column, stretch), then cell: group, count, least and largest key."""
    known = [np.array(p, np.uint64) for p in prefixes]
    listed = np.array(groups, np.int64)
    kinds = len(listed) + 1  # the last one: rows of no listed group

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(kinds * len(k) * CELLS, np.int64) for k in known]
        lows = [np.full(len(c), np.uint64(0xFFFFFFFFFFFFFFFF)) for c in counts]
        highs = [np.zeros(len(c), np.uint64) for c in counts]
        shift = np.uint64(_shift(level))
        for batch in batches:
            g = batch.column(width).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
            kind = np.minimum(np.searchsorted(listed, g), max(0, kinds - 2))
            kind = np.where(listed[kind] == g, kind, kinds - 1) if len(listed) else np.zeros(len(g), np.int64)
            for i, own in enumerate(known):
                if not len(own):
                    continue
                column = batch.column(i)
                valid = column.is_valid().to_numpy(zero_copy_only=False)
                key = keys_of(column.fill_null(0.0).to_numpy(zero_copy_only=False)[valid])
                of = kind[valid]
                if level:
                    prefix = key >> np.uint64(64 - BITS * level)
                    place = np.minimum(np.searchsorted(own, prefix), len(own) - 1)
                    inside = own[place] == prefix
                    key, place, of = key[inside], place[inside], of[inside]
                else:
                    place = np.zeros(len(key), np.int64)
                cell = ((key >> shift) & np.uint64((1 << min(BITS, 64 - BITS * level)) - 1)).astype(np.int64)
                at = (of * len(own) + place) * CELLS + cell
                counts[i] += np.bincount(at, minlength=len(counts[i]))
                np.minimum.at(lows[i], at, key)
                np.maximum.at(highs[i], at, key)
        for i, own in enumerate(known):
            used = np.flatnonzero(counts[i])
            if len(used):
                of, rest = np.divmod(used, len(own) * CELLS)
                place, cell = np.divmod(rest, CELLS)
                signed = [(a[used] ^ TOP).view(np.int64) for a in (lows[i], highs[i])]
                columns = [np.full(len(used), i), place, cell, of, counts[i][used], *signed]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["v", "place", "cell", "kind", "n", "low", "high"])

    schema = ", ".join(f"{n} long" for n in ("v", "place", "cell", "kind", "n", "low", "high"))
    cells = narrow.mapInArrow(run, schema).groupBy("v", "place", "cell", "kind").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    out: dict[tuple, dict[int, list]] = {}
    for r in cells.collect():  # as many rows as cells, at most
        group = groups[r.kind] if r.kind < len(groups) else NOTHING
        stretch = out.setdefault((r.v, prefixes[r.v][r.place]), {})
        stretch.setdefault(r.cell, []).append((group, r.n, r.low + (1 << 63), r.high + (1 << 63)))
    return out
