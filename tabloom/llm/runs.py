"""Periodic runs of words, found through string synchronising sets.

A run is a stretch of words with smallest period q, at least 2q long, that no
neighbouring word extends. At each dyadic scale t the positions of a
synchronising set are chosen by the hashes of the t words that start there: a
position belongs to it if the least hash among the t + 1 next positions is at
the first or the last of them, positions inside a region of period up to t / 3
left out. Whether a position belongs depends on the 2t words after it only, and
every stretch of t positions has one unless the words there are a region of such
a small period. So a run of period q, for the scale with 3t - 1 <= q < 6t - 1,
has two members at distance q with the same 2t words after them, which propose
the period; or its two halves lie in two neighbouring regions of one smaller
period, which are known from the scales before and propose it by their phase.
Proposals are extended both ways by names of stretches of dyadic lengths, and
verified word by word.

The texts of a step are worked on together, longest first, so that a scale sees
only the texts that are long enough for it. Everything here is linear in the
words of a step but for a logarithm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm.common import col, steps, text_of, utf8

WORD = r"[^\x20\x09-\x0D]+"
STEP = 2 << 20
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
ATTEMPTS = 4


def _mixed(values: np.ndarray) -> np.ndarray:
    """A fixed pseudo-random 64-bit number for each."""
    values = values ^ (values >> np.uint64(31))
    values = values * np.uint64(0x9E3779B97F4A7C15)
    values = values ^ (values >> np.uint64(29))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> np.uint64(32))


class Words:
    """Words of several texts, one after the other, the longest text first."""

    def __init__(self, codes: np.ndarray, lengths: np.ndarray, seed: int = 0):
        self.codes, self.lengths = codes, lengths
        ends = np.cumsum(lengths)
        self.begins = ends - lengths
        self.text = np.repeat(np.arange(len(lengths)), lengths)
        self.end = ends[self.text]
        self.begin = self.begins[self.text]
        # names[k][i] tells the 2^k words from i on; texts too short for them are left out at the end
        self.names = [_mixed(codes.astype(np.uint64) + np.uint64((seed + 1) << 40))]
        k = 0
        while (count := self.upto(2 << k)) > 0:
            half, last = 1 << k, self.names[k]
            ahead = np.zeros(count, np.uint64)
            ahead[: max(0, count - half)] = last[half : max(half, count)]
            made = _mixed(last[:count] * np.uint64(0xD6E8FEB86659FD93) + ahead)
            short = np.flatnonzero(np.arange(count) + 2 * half > self.end[:count])
            made[short] = short.astype(np.uint64)  # names of their own
            self.names.append(made)
            k += 1

    def upto(self, least: int) -> int:
        """Words in texts of ``least`` words and more."""
        return int(self.lengths[self.lengths >= least].sum())

    def ahead(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many words from ``x`` and ``y`` (later, same text) on agree."""
        found = np.zeros(len(x), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            name, size = self.names[k], 1 << k
            a, b = x + found, y + found
            fits = np.flatnonzero(b + size <= self.end[y])
            fits = fits[b[fits] < len(name)]
            found[fits[name[a[fits]] == name[b[fits]]]] += size
        return found

    def behind(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many words before ``x`` and ``y`` agree."""
        found = np.zeros(len(x), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            name, size = self.names[k], 1 << k
            a, b = x - found - size, y - found - size
            fits = np.flatnonzero(a >= self.begin[x])
            fits = fits[b[fits] < len(name)]
            found[fits[name[a[fits]] == name[b[fits]]]] += size
        return found

    def holds(self, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> bool:
        """Whether all these stretches have their periods, word by word, and end where they do."""
        sizes = end - start - period
        at = np.repeat(start - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        if (self.codes[at] != self.codes[at + np.repeat(period, sizes)]).any():
            return False
        left = start > self.begin[start]
        if (self.codes[start[left] - 1] == self.codes[start[left] - 1 + period[left]]).any():
            return False
        right = end < self.end[start]
        return not (self.codes[end[right]] == self.codes[end[right] - period[right]]).any()


Found = tuple[np.ndarray, np.ndarray, np.ndarray]


def _merged(runs: Found, more: Found) -> Found:
    """Stretches of both by start and end, each with its smallest period: larger ones of the same stretch are its multiples."""
    start, end, period = (np.concatenate(p) for p in zip(runs, more))
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return start[first], end[first], period[first]


def _pruned(x: np.ndarray, q: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """One proposal of those of a period whose agreeing words (``reach`` from each on) touch."""
    order = np.lexsort((x, q))
    x, q = x[order], q[order]
    first = np.ones(len(x), bool)
    first[1:] = (q[1:] != q[:-1]) | (x[1:] > x[:-1] + reach)
    return x[first], q[first]


def _extended(words: Words, x: np.ndarray, q: np.ndarray) -> Found:
    """The runs that proposals of a period lead to."""
    f, b = words.ahead(x, x + q), words.behind(x, x + q)
    good = f + b >= q
    return (x - b)[good], (x + q + f)[good], q[good]


def _regions(count: int, runs: Found, t: int) -> np.ndarray:
    """Whether the ``t`` words from each position on have a period of ``t / 3`` at most."""
    start, end, period = runs
    own = (period * 3 <= t) & (end - start >= t) & (start < count)
    steps_ = np.zeros(count + 1, np.int64)
    np.add.at(steps_, start[own], 1)
    np.add.at(steps_, np.minimum(end[own] - t + 1, count), -1)
    return np.cumsum(steps_)[:count] > 0


def synchronising(words: Words, k: int, runs: Found) -> np.ndarray:
    """Positions of the synchronising set of scale ``2^k``, given the runs of smaller periods."""
    t = 1 << k
    count = words.upto(2 * t)
    ids = np.where(_regions(count, runs, t), NONE, words.names[k][:count])
    if count <= t:
        return np.empty(0, np.int64)
    least, width = ids, 1
    while width < t:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: count - t], ids[t:])
    edge = np.minimum(ids[: count - t], ids[t:])
    at = np.flatnonzero((edge == least) & (edge != NONE))
    return at[at + 2 * t <= words.end[at]]


def _pairs(words: Words, k: int, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Members with equal words after them, at the distances of scale ``2^k``: (position, distance)."""
    t = 1 << k
    name = words.names[k + 1][chosen]
    order = np.argsort(name, kind="stable")
    at, name = chosen[order], name[order]
    found_x, found_q = [], []
    left = np.arange(len(at))
    step = 1
    while True:
        left = left[left + step < len(at)]
        near = (name[left] == name[left + step]) & (at[left + step] - at[left] < 6 * t - 1) & (at[left + step] < words.end[at[left]])
        left = left[near]
        if not len(left):
            break
        q = at[left + step] - at[left]
        wide = q >= 3 * t - 1
        x, q = _pruned(at[left[wide]], q[wide], 2 * t)
        found_x.append(x)
        found_q.append(q)
        step += 1
    if not found_x:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return _pruned(np.concatenate(found_x), np.concatenate(found_q), 2 * t)


def _ranges(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and place within it, for each of ``sizes`` places."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _neighbours(words: Words, k: int, runs: Found) -> tuple[np.ndarray, np.ndarray]:
    """Proposals from two regions of one small period that follow each other: (position, distance)."""
    t = 1 << k
    own = (runs[2] * 3 <= t) & (runs[1] - runs[0] >= 3 * t - 1)
    start, end, period = (r[own] for r in runs)
    order = np.lexsort((start, period))
    start, end, period = start[order], end[order], period[order]
    i = np.flatnonzero((period[1:] == period[:-1]) & (start[1:] <= end[:-1]) & (end[1:] > end[:-1]) & (start[1:] < words.end[start[:-1]]))
    p, begin, over, then, last = period[i], start[i], end[i], start[i + 1], end[i + 1]
    # the phase: one of the p places before the border has the words that the second region begins with
    owner, place = _ranges(p)
    x, y = over[owner] - 2 * p[owner] + place, then[owner]
    same = np.flatnonzero((y > x) & (words.ahead(x, np.maximum(y, x)) >= p[owner]))
    owner, least = owner[same], (y - x)[same]
    p, begin, over, then, last = p[owner], begin[owner], over[owner], then[owner], last[owner]
    low = least + np.maximum(0, -((least - (3 * t - 1)) // p)) * p
    low = low - np.maximum(0, (low - (3 * t - 1)) // p) * p  # the least of this phase from 3t - 1 on
    high = np.minimum(6 * t - 2, np.minimum(over - begin, last - then) + p)
    owner, place = _ranges(np.maximum(0, (high - low) // p + 1))
    q = low[owner] + place * p[owner]
    x = np.maximum(begin[owner], then[owner] - q)
    good = (x < over[owner]) & (x + q < last[owner])
    return x[good], q[good]


def all_runs(words: Words) -> Found:
    """Start, end and period of every run of two periods and more, by start, then end."""
    none = np.empty(0, np.int64)
    if not len(words.codes):
        return none, none, none
    # period 1: equal neighbours
    same = np.flatnonzero((words.codes[1:] == words.codes[:-1]) & (words.text[1:] == words.text[:-1]))
    first = np.ones(len(same), bool)
    first[1:] = same[1:] != same[:-1] + 1
    x = same[first]
    runs = _merged((none, none, none), _extended(words, x, np.ones(len(x), np.int64)))
    k = 0
    while words.upto(2 * (3 * (1 << k) - 1)):
        proposed = [_pairs(words, k, synchronising(words, k, runs)), _neighbours(words, k, runs)]
        x, q = (np.concatenate(p) for p in zip(*proposed))
        runs = _merged(runs, _extended(words, x, q))
        k += 1
    return runs


def runs_of(codes: np.ndarray, lengths: np.ndarray, least: int) -> tuple[np.ndarray, Found]:
    """Runs of ``least`` words and more in texts of ``lengths`` words, given one after the other.

    Returns the text of each run, and its start within it, its end and its period;
    runs are ordered by text, start, then period.
    """
    order = np.argsort(-lengths, kind="stable")
    begins = np.cumsum(lengths) - lengths
    owner, place = _ranges(lengths[order])
    sorted_codes = codes[begins[order][owner] + place]
    for seed in range(ATTEMPTS):
        words = Words(sorted_codes, lengths[order], seed)
        start, end, period = all_runs(words)
        long = end - start >= np.maximum(least, 2 * period)
        start, end, period = start[long], end[long], period[long]
        if not len(start) or words.holds(start, end, period):
            break
    else:
        raise RuntimeError("names of different words agree")
    text = words.text[start] if len(start) else start
    begin = words.begins[text]
    text = order[text]
    sort = np.lexsort((period, start - begin, text))
    return text[sort], ((start - begin)[sort], (end - begin)[sort], period[sort])


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words of all texts, the code of each, and how many each text has."""
    split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts))
    found = split.flatten()
    counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    real = pc.greater(pc.binary_length(found), 0)
    counts[(counts == 1) & ~_full(texts)] = 0
    found = found.filter(real)
    coded = found.dictionary_encode() if len(found) else None
    return found, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) if coded else np.empty(0, np.int64), counts


def _full(texts: pa.Array) -> np.ndarray:
    """Whether a text has a word."""
    return pc.greater(pc.binary_length(pc.ascii_trim_whitespace(texts)), 0).to_numpy(zero_copy_only=False)


def _found(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in steps(whole, "text", STEP):
                texts = utf8(batch.column("text"))
                words, codes, counts = _split(texts)
                text, (start, end, period) = runs_of(codes, counts, least)
                begins = np.cumsum(counts) - counts
                # words that stay: outside every run after its first period
                marks = np.zeros(len(codes) + 1, np.int64)
                np.add.at(marks, begins[text] + start + period, 1)
                np.add.at(marks, begins[text] + end, -1)
                kept = np.cumsum(marks)[:-1] == 0
                left = np.add.reduceat(np.append(kept, False).astype(np.int64), begins) if len(begins) else begins
                left[counts == 0] = 0
                offsets = np.concatenate([[0], np.cumsum(left)])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), words.filter(pa.array(kept)).cast(pa.string()))
                per = np.bincount(text, minlength=len(counts)).astype(np.int32)
                each = pa.StructArray.from_arrays([pa.array(a, pa.int64()) for a in (start, end - start, period)], ["start", "length", "period"])
                listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]), pa.int32()), each)
                # the longest run of each text, the first of the shortest period among equals
                order = np.lexsort((period, start, start - end, text))
                firsts = order[np.unique(text[order], return_index=True)[1]]
                longest = np.full(len(counts), -1)
                longest[text[firsts]] = firsts
                place = pa.array(longest, mask=longest < 0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array(counts), listed, each.take(place), pc.binary_join(lists, " ")],
                    ["id", "n_words", "runs", "longest", "collapsed"],
                )

    return run


def periodic_runs(docs: DataFrame, least: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, runs, longest, collapsed.

    Words are stretches without white space (blank, tab to carriage return),
    numbered from 0. ``runs`` lists every run of ``least`` words and two periods
    or more as (start, length, period), by start, then period; ``longest`` is the
    one of greatest length, of equal ones the first by start, then period, and
    null if there is none. ``collapsed`` has the words that no run holds after
    its first period, joined by one space. A null text counts as empty: no words,
    no runs, an empty ``collapsed``. Rows are kept as they are, repeated ones and
    null ids included; an empty table gives no rows. Memory follows the longest
    text, which one step holds whole. Other columns of ``docs`` are not read.
    """
    if least < 1:
        raise ValueError("a run has one word at least")
    each = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
    given = docs.select(col(id_col).alias("id"), text_of(text_col).alias("text"))
    schema = T.StructType(
        [
            T.StructField("id", given.schema["id"].dataType),
            T.StructField("n_words", T.LongType()),
            T.StructField("runs", T.ArrayType(each)),
            T.StructField("longest", each),
            T.StructField("collapsed", T.StringType()),
        ]
    )
    return given.mapInArrow(_found(least), schema).withColumnRenamed("id", id_col)


def repeating(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids and texts, of every tenth document (by a checksum of its id) with a periodic end.

    Let h be the CRC-32 of the id as decimal digits, g = floor(h / 10) and n the
    words of the text. If h % 10 = 0, each word i from a = g % n on becomes word
    a + (i - a) % p for p = 1 + floor((n - a) / (3 + g % 8)), and the words are
    joined by single blanks. Texts without words, and null ids, stay as they are.
    """
    h = F.crc32(col(id_col).cast("string").cast("binary"))
    given = docs.select(col(id_col).alias(id_col), text_of(text_col).alias(text_col), h.alias("h"))
    words, n, g = F.col("words"), F.size("words"), F.floor(F.col("h") / 10)
    a = F.pmod(g, n.cast("long")).cast("int")
    p = (F.lit(1) + F.floor((n - F.col("a")) / (F.lit(3) + g % 8))).cast("int")
    changed = given.withColumn("words", F.when(F.col("h") % 10 == 0, F.regexp_extract_all(col(text_col), F.lit(f"({WORD})"), F.lit(1))))
    changed = changed.withColumn("a", F.when(n > 0, a)).withColumn("p", F.when(n > 0, p))
    from_a = F.transform(F.sequence(F.lit(0), n - F.col("a") - 1), lambda i: F.get(words, F.col("a") + i % F.col("p")))
    edited = F.array_join(F.concat(F.slice(words, F.lit(1), F.col("a")), from_a), " ")
    return changed.select(col(id_col), F.when(n > 0, edited).otherwise(col(text_col)).alias(text_col))


def listed(runs: Column) -> Column:
    """Runs as lines of start, length and period."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
