"""Document fingerprints from closed syncmers.

A text becomes tokens cut by its content: at white space, after a few characters
of every kind (so that text without blanks is cut as well, and again at the same
places after an edit), and after ``LONGEST`` characters. With empty tokens before
and after it, every ``K`` tokens in a row are a K-mer, and every ``S`` of them an
inner run. A K-mer is an anchor (a closed syncmer) if the least hash of its
``K - S + 1`` inner runs belongs to the first or the last of them. Whether a K-mer
is one depends on its own tokens only, so an edit moves no anchor outside its
reach, and one of ``K - S`` K-mers in a row is an anchor at least. Texts of every
length and script have anchors of one kind.

A fingerprint lists all anchors of a text in order, each with a hash of its tokens
and the distance to the one before, and so their positions. Two fingerprints are
matched by position: common anchors tell by how much one text is shifted against
the other (the median of their offsets), and those are matched, each once, that
agree with that shift but for a band. All of it is column functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import col, text_of
from tabloom.operators.ordering import numbered
from tabloom.session import write_table

# White space, and the characters that end a token: some letters and digits,
# marks on letters, and every letter of scripts from U+2E80 on, which are written without blanks.
SPACE = r"\x20\x09-\x0D"
ENDS = r"!-,./:-@\[-`{-~037jkqvxzJKQVXZ\p{M}\x{2E80}-\x{10FFFF}"
LONGEST = 32
TOKEN = rf"[^{SPACE}{ENDS}]{{0,{LONGEST - 1}}}[{ENDS}]|[^{SPACE}{ENDS}]{{1,{LONGEST}}}"
K, S = 14, 2
DIGITS = 8
# positions agree within this many tokens, and this part of the longer text
NEAR, PART = 16, 8
# an anchor is one long: 31 bits of its hash, 31 bits of its position (with room to shift it both ways), and the side it is on
ROOM = 1 << 29
HASH = (1 << 31) - 1


def tokens(text: Column) -> Column:
    """Tokens of a text in order, none empty."""
    return F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1))


def padded(tokens_: Column) -> Column:
    """Tokens with empty ones around them; none if there are none."""
    edge = F.array_repeat(F.lit(""), K - 1)
    return F.when(F.size(tokens_) > 0, F.concat(edge, tokens_, edge)).otherwise(tokens_)


def inner(tokens_: Column) -> Column:
    """Hashes of all runs of ``S`` tokens, by the first of them; the last ``S - 1`` reach beyond the end and are not used."""
    return F.transform(tokens_, lambda t, i: F.xxhash64(t, *[F.get(tokens_, i + j) for j in range(1, S)]))


def places(runs: Column) -> Column:
    """Positions (first token) of the closed syncmers of a text with these runs."""
    last = K - S

    def closed(i: Column) -> Column:
        return F.least(F.get(runs, i), F.get(runs, i + last)) <= F.least(*[F.get(runs, i + j) for j in range(1, last)])

    return F.when(F.size(runs) >= K, F.filter(F.sequence(F.lit(0), F.size(runs) - K), closed)).otherwise(F.array().cast("array<int>"))


def anchors(runs: Column, places_: Column) -> Column:
    """Hash and position of each anchor, in order, as one long."""

    def packed(i: Column) -> Column:
        whole = F.xxhash64(*[F.get(runs, i + j) for j in range(0, K - S + 1, S)])
        return F.shiftleft(whole.bitwiseAND(F.lit(HASH)), 32) + (i.cast("long") + ROOM) * 2

    return F.transform(places_, packed)


def position(anchor: Column) -> Column:
    return F.shiftright(anchor, 1).bitwiseAND(F.lit(HASH)) - ROOM


def with_sketch(df: DataFrame, text: Column, name: str) -> DataFrame:
    """``df`` with the sketch of ``text``: all its anchors in order. Each step is a column of its own, so that none is computed twice."""
    kept = df.columns
    t, r, p = (f"_{name}_{c}" for c in "trp")
    df = df.withColumn(t, tokens(text))
    df = df.withColumn(t, padded(F.col(t)))
    df = df.withColumn(r, inner(F.col(t)))
    df = df.withColumn(p, places(F.col(r)))
    return df.select(*[col(c) for c in kept], anchors(F.col(r), F.col(p)).alias(name))


def fingerprint(sketch_: Column) -> Column:
    """A sketch in print: of each anchor the distance to the one before (or to the beginning) and the hash, in hexadecimal digits."""

    def printed(anchor: Column, i: Column) -> Column:
        gap = position(anchor) - F.when(i > 0, position(F.get(sketch_, i - 1))).otherwise(F.lit(0))
        # the distance is less than 16
        return F.lower(F.lpad(F.hex(F.shiftright(anchor, 32) + F.shiftleft(gap, 32)), DIGITS + 1, "0"))

    return F.array_join(F.transform(sketch_, printed), "")


def with_likeness(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """``df`` with the likeness of two sketches: matched anchors among all of both, 1 if both are empty.

    Anchors match if their hashes agree and their positions do, once the median
    offset of common anchors is taken off, within ``NEAR`` tokens and a
    ``PART``-th of the longer text; each is matched once.
    """
    kept = df.columns
    x, y = col(a), col(b)
    m, d = f"_{name}_m", f"_{name}_d"
    # common hashes stand next to each other, by position
    df = df.withColumn(m, F.sort_array(F.concat(x, F.transform(y, lambda v: v + 1))))
    merged = col(m)

    def apart(v: Column, i: Column) -> Column:
        """Whether the next anchor has the same hash and is on the other side."""
        following = F.get(merged, i + 1)
        return (F.shiftright(following, 32) == F.shiftright(v, 32)) & ((following - v).bitwiseAND(F.lit(1)) == 1)

    def pairs() -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(merged) - 2), lambda i: apart(F.get(merged, i), i))
        # position on the second side less that on the first
        sided = lambda v, w: F.when(v.bitwiseAND(F.lit(1)) == 0, position(w) - position(v)).otherwise(position(v) - position(w))
        return F.sort_array(F.transform(at, lambda i: sided(F.get(merged, i), F.get(merged, i + 1))))

    offsets = F.when(F.size(merged) > 1, pairs()).otherwise(F.array().cast("array<long>"))
    df = df.withColumn(d, offsets)
    df = df.withColumn(d, F.get(d, F.floor(F.size(d) / 2).cast("int")))
    shift = col(d)
    aligned = F.when(shift == 0, merged).otherwise(F.sort_array(F.concat(x, F.transform(y, lambda v: v + 1 - shift * 2))))
    end = lambda s: F.coalesce(position(F.element_at(s, -1)), F.lit(0))
    reach = f"_{name}_w"
    df = df.withColumn(reach, 2 * (F.lit(NEAR) + F.floor(F.greatest(F.when(F.size(x) > 0, end(x)), F.when(F.size(y) > 0, end(y)), F.lit(0)) / PART)) + 1)
    width = col(reach)

    def step(state: Column, v: Column) -> Column:
        gap = v - state["waiting"]
        met = (gap <= width) & (gap.bitwiseAND(F.lit(1)) == 1)
        none = F.struct(F.lit(-1).cast("long").alias("waiting"), (state["n"] + 1).alias("n"))
        return F.when(met, none).otherwise(F.struct(v.alias("waiting"), state["n"].alias("n")))

    begin = F.struct(F.lit(-1).cast("long").alias("waiting"), F.lit(0).alias("n"))
    common = F.when(shift.isNull(), F.lit(0)).otherwise(F.aggregate(aligned, begin, step)["n"])
    every = F.size(x) + F.size(y)
    n = f"_{name}_n"
    df = df.withColumn(n, common)
    found = F.when(every == 0, F.lit(1.0)).otherwise(F.col(n) / (every - F.col(n)))
    return df.select(*[col(c) for c in kept], found.alias(name))


def edited_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text beside an edited form and the next text, by all their anchors.

    Columns: doc_id, text, edited, sketch, edited_sketch, next_sketch. Documents
    follow each other by descending id (null ids last; several texts of one id by
    a hash), the first after the last. The edited text has its last third of code
    points (rounded down) replaced by as many from the beginning of the next
    text, or by all of it if that is shorter. Null text counts as empty. Rows
    that agree in id and text are one document in that order and have the same
    result. A single document follows itself; an empty table gives no rows.
    """
    text = text_of(text_col)
    plain = docs.select(col(id_col).alias("id"), text.alias("text"))
    # a key without nulls; the hash tells a null id from the number that stands for it
    keyed = plain.select("id", F.coalesce(F.col("id").cast("long"), F.lit(-(2**63))).alias("k"), F.xxhash64("id", "text").alias("h"), "text")
    third = F.floor(F.length("text") / 3).cast("int")
    keys = write_table(keyed.groupBy("id", "k", "h").agg(F.count("*").alias("rows"), F.max(third).alias("third")), "keys")
    counted = keys.agg(F.count("*").alias("n"), F.max("rows").alias("rows")).first()
    placed = numbered(keys, [], [F.col("id").desc_nulls_last(), F.col("h").desc()], "at", small_rows=0)
    placed = write_table(placed.select("id", "k", "h", "third", "at"), "order")
    after = placed.select(F.col("k").alias("next_k"), F.col("h").alias("next_h"), F.col("at").alias("next_at"))
    links = placed.join(after, F.col("at") % F.lit(max(counted.n, 1)) + 1 == F.col("next_at"))
    links = write_table(links.select("id", "k", "h", "third", "next_k", "next_h"), "links")

    # each text is worked on once, before both joins, which take the same columns of it, so that one exchange serves them;
    # of the next text no more goes on than its sketch and the part that is wanted
    texts = with_sketch(keyed.drop("id"), F.col("text"), "sketch")
    following = (F.col("l.next_k") == F.col("t.k")) & (F.col("l.next_h") == F.col("t.h"))
    given = links.alias("l").join(texts.alias("t"), following)
    given = given.select("l.id", "l.k", "l.h", "l.third", F.left("t.text", F.col("l.third")).alias("lead"), F.col("t.sketch").alias("next_sketch"))
    if (counted.rows or 1) > 1:
        given = given.dropDuplicates(["k", "h"])
    joined = texts.join(given, ["k", "h"]).select("id", "text", "sketch", "third", "lead", "next_sketch")
    joined = joined.withColumn("edited", F.concat(F.left("text", F.length("text") - F.col("third")), F.col("lead"))).drop("third", "lead")
    joined = with_sketch(joined, F.col("edited"), "edited_sketch")
    return joined.select(F.col("id").alias(id_col), "text", "edited", "sketch", "edited_sketch", "next_sketch")
