"""Near-duplicates by SimHash, found through multi-index hashing.

Fingerprints of 64 bits are cut into two segments of 32. Two that differ in
three bits at most differ in one bit at most in one of the segments, so each
fingerprint looks up its own segment value and the small ball around it in a
table per segment; the ball is halved by letting only the side with the unset
bit probe. Matches are verified on all 64 bits. Copies of a fingerprint are one
entry, and a bucket gives the links of a spanning forest instead of all its
pairs. A bucket beyond ``BUCKET`` rows is cut further by the balls around the
other segment, which finds the same components in work linear in its rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import col, fresh, text_of
from tabloom.llm.components import components
from tabloom.session import write_table

HALF = 32
BUCKET = 4096
MOST_BITS = 3


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """SimHash of the word shingles of a text, unsigned."""
    import xxhash

    found = text.encode().lower().split()
    if not found:
        return 0
    words = min(words, len(found))
    joined = b" ".join(found)
    sizes = np.fromiter(map(len, found), np.int64, len(found)) + 1
    starts = np.cumsum(sizes) - sizes
    ends = (starts + sizes - 1)[words - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends)], "<u8")
    counts = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(text: Column, words: int = 3, seed: int = 42) -> Column:
    """SimHash of a text column as a signed long; null counts as empty."""

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            found = np.array([fingerprint(t or "", words, seed) for t in batch], np.uint64)
            yield pd.Series(found.view(np.int64))

    return run(text)


def _low(column: Column) -> Column:
    return column.bitwiseAND(F.lit((1 << HALF) - 1))


def _sides(bits: int) -> Column:
    """Owners (kind 0) and probes (kind 1) of a fingerprint: table, key, rest, kind."""
    print_ = F.col("print")
    high, low = F.shiftrightunsigned(print_, HALF), _low(print_)
    sides = []
    for side, key, rest in ((0, high, low), (1, low, high)):
        sides.append(F.array(F.struct(F.lit(side).alias("side"), key.alias("key"), rest.alias("rest"), F.lit(0).alias("kind"))))
        if bits > 1:
            flips = F.array(*[F.lit(1 << b) for b in range(HALF)])
            unset = F.filter(flips, lambda f: key.bitwiseAND(f) == 0)
            sides.append(F.transform(unset, lambda f: F.struct(F.lit(side).alias("side"), key.bitwiseOR(f).alias("key"), rest.alias("rest"), F.lit(1).alias("kind"))))
    return F.concat(*sides)


def _forest(bits: int):
    """Links of a spanning forest of each bucket; rows come sorted by bucket."""

    def bucket(prints: np.ndarray, kinds: np.ndarray) -> list[tuple[int, int]]:
        links, left, kind = [], prints, kinds
        while len(left):
            queue = [(left[0], kind[0])]
            left, kind = left[1:], kind[1:]
            while queue and len(left):
                at, own = queue.pop()
                near = np.bitwise_count(left ^ at) <= bits
                if own:
                    near &= kind == 0
                if near.any():
                    links.extend((at, x) for x in left[near])
                    queue.extend(zip(left[near], kind[near]))
                    left, kind = left[~near], kind[~near]
        return links

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty((0,), np.int64) for _ in range(4)]
        for batch in _then_none(batches):
            if batch is None:
                rows, upto = held, len(held[0])
            else:
                rows = [np.concatenate([h, c.to_numpy(zero_copy_only=False).astype(np.int64)]) for h, c in zip(held, batch.columns)]
                last = len(rows[0]) - 1
                open_ = (rows[0] == rows[0][last]) & (rows[1] == rows[1][last]) if last >= 0 else np.empty(0, bool)
                upto = int(np.argmax(open_)) if last >= 0 else 0
                held = [r[upto:] for r in rows]
            side, key, prints, kinds = (r[:upto] for r in rows)
            if not upto:
                continue
            begin = np.flatnonzero(np.concatenate([[True], (side[1:] != side[:-1]) | (key[1:] != key[:-1])]))
            end = np.append(begin[1:], upto)
            links = []
            for i in np.flatnonzero(end - begin > 1):
                own = slice(begin[i], end[i])
                if not kinds[own].all():
                    links += bucket(prints[own].view(np.uint64), kinds[own])
            if links:
                pairs = np.array(links, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return run


def _then_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _ball(radius: int) -> list[int]:
    """Masks of up to ``radius`` bits of a segment."""
    return [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(HALF), r)]


def _large_buckets(rows: DataFrame, bits: int) -> DataFrame:
    """Links within buckets of any size: a star around one owner at each point near it.

    For three bits: owners mark the points within one bit of their other segment
    as cores, owners mark those within two bits as well, and probes, one bit away
    already, those within one. Whoever shares a point with a core is within the
    limit of it, cores of a point are within two bits of each other, and every
    pair within the limit shares such a point. Fewer bits have smaller balls.
    """
    core = min(1, bits - 1)

    def points(radius: int, kinds: Column) -> DataFrame:
        around = F.explode(F.transform(F.array(*map(F.lit, _ball(radius))), lambda m: F.col("rest").bitwiseXOR(m)))
        return rows.where(kinds).select("side", "key", "print", around.alias("point"))

    owner = F.col("kind") == 0
    hubs = write_table(points(core, owner).groupBy("side", "key", "point").agg(F.min("print").alias("hub")), "hubs")
    marks = points(bits - core, owner)
    if bits > 1:
        marks = marks.unionByName(points(bits - 1 - core, ~owner))
    stars = marks.join(hubs, ["side", "key", "point"]).where("print <> hub")
    return stars.select(F.col("print").alias("a"), F.col("hub").alias("b")).distinct()


def links(prints: DataFrame, bits: int = MOST_BITS, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) whose components are those of all pairs within ``bits`` bits.

    ``prints`` has a long column ``print`` without repeats.
    """
    if not 0 <= bits <= MOST_BITS:
        raise ValueError(f"two segments find up to {MOST_BITS} differing bits")
    sides = prints.select("print", F.explode(_sides(bits)).alias("s")).select("s.side", "s.key", "s.rest", "print", "s.kind")
    owned = sides.where("kind = 0").select("side", "key").distinct()
    rows = write_table(sides.join(owned, ["side", "key"], "left_semi"), "buckets")
    sizes = rows.groupBy("side", "key").agg(F.count("*").alias("n"))
    large = write_table(sizes.where(F.col("n") > bucket).select("side", "key"), "large")
    some = bits > 0 and not large.isEmpty()
    small = rows.join(large, ["side", "key"], "left_anti") if some else rows
    dealt = small.select("side", "key", "print", "kind").repartition("side", "key").sortWithinPartitions("side", "key")
    found = dealt.mapInArrow(_forest(bits), "a long, b long")
    return found.unionByName(_large_buckets(rows.join(large, ["side", "key"], "left_semi"), bits)) if some else found


def _prints(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """Id and fingerprint of each row, written once."""
    made = docs.select(col(id_col).alias("id"), fingerprints(text_of(text_col), words).alias("print"))
    return write_table(made, "prints")


def _classes(made: DataFrame, bits: int, bucket: int) -> DataFrame:
    """Label of the component of each distinct fingerprint: columns print, least (smallest id), label."""
    distinct = write_table(made.groupBy("print").agg(F.min("id").alias("least")), "distinct")
    labels = components(links(distinct.select("print"), bits, bucket))
    members = distinct.join(labels, F.col("print") == F.col("node"), "left")
    return write_table(members.select("print", "least", F.coalesce("label", "print").alias("label")), "members")


def near_copies(
    docs: DataFrame,
    words: int = 3,
    bits: int = MOST_BITS,
    id_col: str = "doc_id",
    text_col: str = "text",
    bucket: int = BUCKET,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints within ``bits`` differing bits are linked; ``component_id`` is
    the smallest id reachable by links, null ids left out (null if all are).
    Texts without words have fingerprint zero and are linked like any other; a
    null text counts as empty. Equal and repeated rows share a component. An
    empty table gives no rows. Other columns of ``docs`` are not read.
    """
    made = _prints(docs, words, id_col, text_col)
    members = _classes(made, bits, bucket)
    least = write_table(members.groupBy("label").agg(F.min("least").alias("component_id")), "least")
    by_print = write_table(members.join(least, "label").select("print", "component_id"), "classes")
    joined = made.join(by_print, "print")
    return joined.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def drop_near(
    docs: DataFrame,
    words: int = 3,
    bits: int = MOST_BITS,
    id_col: str = "doc_id",
    text_col: str = "text",
    bucket: int = BUCKET,
) -> DataFrame:
    """One row of each component of ``near_copies``, its columns as they are.

    The row with the smallest id stays, null ids last; of rows with that id the
    one with the smallest fingerprint, and one of those that agree in both.
    """
    made = _prints(docs, words, id_col, text_col)
    members = _classes(made, bits, bucket)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("print").alias("print")))
    # written on both sides, so that a join splits the rows of a large group
    leaders = members.select("print", "label")
    by_label = made.groupBy("print").agg(first.alias("first")).join(leaders, "print").groupBy("label").agg(F.min("first").alias("first"))
    stay_id, stay_print, own = fresh(docs, "stay_id", "stay_print", "print")
    stay = write_table(by_label.select(F.col("first.id").alias(stay_id), F.col("first.print").alias(stay_print)), "stay")
    names = [col(c) for c in docs.columns]
    unnamed = made.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 OR id IS NULL")
    if unnamed.isEmpty():  # the id tells the row
        return docs.join(stay, col(id_col) == F.col(stay_id), "left_semi").select(*names)
    marked = docs.withColumn(own, fingerprints(text_of(text_col), words))
    same = col(id_col).eqNullSafe(F.col(stay_id)) & (F.col(own) == F.col(stay_print))
    return marked.join(stay, same).dropDuplicates([stay_id, stay_print]).select(*names)
