"""Documents packed into sequences of token ids with little padding.

Shortest-pack-first over the histogram of lengths. Documents are tokenised and
cut into pieces of one sequence at most; the histogram of piece lengths has one
entry for each length, so it fits the driver whatever the table holds. There
lengths are placed longest first into the pack with the most room, and what is
kept is patterns of lengths with the number of packs that follow them. A
pattern says which ranks of each length fill its slots, so a piece finds its
sequence from its length and its rank among pieces of that length.

Ranks need no sort: a task numbers its own pieces of each length while it
writes them, and the counts of earlier tasks are added afterwards.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm.common import col, steps, utf8
from tabloom.llm.encoding import encoder
from tabloom.session import write_table

LENGTH = 2048
RANK_BITS = 44

Runs = tuple[tuple[int, int], ...]


def pattern_counts(histogram: Mapping[int, int], size: int) -> list[tuple[int, Runs]]:
    """Packing patterns: how many packs, and their (length, copies) runs, longest first.

    Each length in turn goes to the fullest room left, that is the shortest
    pack; where it does not fit there, new packs are opened. Lengths of zero
    are refused.
    """
    if any(not 0 < length <= size for length in histogram):
        raise ValueError(f"lengths must lie between 1 and {size}")
    by_fill: dict[int, dict[Runs, int]] = {}
    fills: list[int] = []
    done: list[tuple[int, Runs]] = []

    def keep(fill: int, runs: Runs, packs: int) -> None:
        if fill == size:
            done.append((packs, runs))
            return
        if fill not in by_fill:
            by_fill[fill] = {}
            heapq.heappush(fills, fill)
        by_fill[fill][runs] = by_fill[fill].get(runs, 0) + packs

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if fills and fills[0] + length <= size:
                fill = fills[0]
                runs, packs = by_fill[fill].popitem()
                used = min(packs, left)
                if used < packs:
                    by_fill[fill][runs] = packs - used
                if not by_fill[fill]:
                    del by_fill[fill]
                    heapq.heappop(fills)
                longer = (*runs[:-1], (length, runs[-1][1] + 1)) if runs[-1][0] == length else (*runs, (length, 1))
                keep(fill + length, longer, used)
                left -= used
            else:  # a pack opened for this length stays the shortest until it is full of it
                each = size // length
                full, rest = divmod(left, each)
                if full:
                    keep(each * length, ((length, each),), full)
                if rest:
                    keep(rest * length, ((length, rest),), 1)
                left = 0
    open_packs = [(packs, runs) for fill in sorted(by_fill, reverse=True) for runs, packs in by_fill[fill].items()]
    return done + open_packs


def slots(patterns: list[tuple[int, Runs]]) -> np.ndarray:
    """For each slot of a pattern: (key of its first rank, first sequence, offset), by key.

    A key is a length and a rank of that length; ranks count from zero.
    """
    following: dict[int, int] = {}
    rows, sequence = [], 0
    for packs, runs in patterns:
        offset = 0
        for length, copies in runs:
            for _ in range(copies):
                rank = following.get(length, 0)
                rows.append(((length << RANK_BITS) + rank, sequence, offset))
                following[length] = rank + packs
                offset += length
        sequence += packs
    table = np.array(rows, np.int64).reshape(-1, 3)
    return table[np.argsort(table[:, 0])]


def _cut(tokenizer: str, end_id: int, size: int, ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).column
        part = TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        for whole in batches:
            for batch in steps(whole, "text"):
                flat, ends = encode(utf8(batch.column("text")))
                out: dict[str, list] = {n: [] for n in ("at", "start", "length", "doc_tokens", "ids", "rank")}
                for i in range(batch.num_rows):
                    own = np.append(flat[ends[i] : ends[i + 1]], np.uint32(end_id)).astype("<u4")
                    for start in range(0, len(own), size):
                        piece = own[start : start + size]
                        rank = seen.get(len(piece), 0)
                        seen[len(piece)] = rank + 1
                        for name, value in zip(out, (i, start, len(piece), len(own), piece.tobytes() if ids else b"", rank)):
                            out[name].append(value)
                at = pa.array(out.pop("at"), pa.int64())
                made = {n: pa.array(v, pa.binary() if n == "ids" else pa.int64()) for n, v in out.items()}
                made["part"] = pa.array(np.full(len(at), part), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("id").take(at), *made.values()], ["id", *made])

    return run


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 1,
    size: int = LENGTH,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, ids, sequence_id, offset.

    ``ids`` are the piece's token ids as little-endian 32-bit integers.
    A document's ids are those of its text and ``end_id``; a null or empty text
    has the end id alone. A document longer than ``size`` fills whole sequences
    and leaves one shorter piece, so every id lies in one piece. Sequences are
    numbered without gaps from zero and filled from offset zero without gaps.
    Repeated rows are packed each for itself; null document ids are kept. An
    empty table gives no rows. Other columns of ``docs`` are not read.
    """
    ids = docs.select(col(id_col).alias("id"), col(text_col).alias("text"))
    schema = T.StructType(
        [
            T.StructField("id", ids.schema["id"].dataType),
            *[T.StructField(n, T.BinaryType() if n == "ids" else T.LongType()) for n in ("start", "length", "doc_tokens", "ids", "rank", "part")],
        ]
    )
    pieces = write_table(ids.mapInArrow(_cut(tokenizer, end_id, size, True), schema), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # ``size`` rows at most
    table = slots(pattern_counts(histogram, size))

    # a row for each task that wrote pieces of this length
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        key = (length.to_numpy(np.int64) << RANK_BITS) + rank.to_numpy(np.int64)
        slot = table[np.searchsorted(table[:, 0], key, "right") - 1]
        return pd.DataFrame({"sequence_id": slot[:, 1] + key - slot[:, 0], "offset": slot[:, 2]})

    return (
        pieces.withColumn("ids_crc32", F.crc32("ids"))
        .join(before, ["part", "length"])
        .withColumn("place", place("length", F.col("rank") + F.col("before")))
        .select(F.col("id").alias(id_col), "start", "length", "doc_tokens", "ids", "ids_crc32", "place.sequence_id", "place.offset")
    )
