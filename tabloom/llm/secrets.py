"""Secrets in texts: fixed patterns, and random strings told by character Markov models.

Three patterns (assignments to telling names, access keys, long hex numbers)
give the base spans. In what they leave, every run of key characters is walked
with two first-order Markov models over characters, one trained on random
strings and one on ordinary identifiers; stretches of a run whose log-likelihood
ratio is high enough in its sum and its mean are added, so a key counts whatever
path or name it is glued to. All of it is column functions; the models are one
short array.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm.common import col, text_of
from tabloom.session import write_table

# The base patterns, in the order in which spans of one start are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LEAST_ASSIGNED = 6
KINDS = ("assign", "access", "hex", "random")

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
LETTERS = 62  # of the alphabet, before the separators
RUN = r"[A-Za-z0-9+/_=-]"
LEAST_RUN = 8
# log-likelihood ratio from which a stretch counts as random: its mean per pair of characters, and its sum
LEAST_RATIO = 0.5
LEAST_SUM = 16.0
# a stretch ends where the sum above the least mean has fallen by as much
FALL = 5.0
# counts added to each character, and weight of single characters where pairs are rare
PRIOR = 0.5
BACKING = 50.0
# bounds of the labelled sample that a model is fitted on: texts of either kind, strings of a text, and random strings drawn
SAMPLE_TEXTS = 2_000
SAMPLE_STRINGS = 5_000
DRAWN = 2_000
DRAWN_LENGTHS = (16, 24, 32, 40)

SPANS = "array<struct<kind: string, start: int, end: int>>"


@dataclass(frozen=True)
class Model:
    """Log-likelihood ratio (random less ordinary) of each pair of characters of ``ALPHABET``."""

    ratios: tuple[float, ...]

    def column(self) -> Column:
        return F.split(F.lit(",".join(f"{r:.4f}" for r in self.ratios)), ",").cast("array<double>")


def train(samples: DataFrame, string_col: str = "string", secret_col: str = "secret") -> Model:
    """Fit both chains to labelled strings: ``secret`` true for random ones, false for ordinary ones.

    Pairs with a character outside ``ALPHABET`` are left out, as are rows with a
    null. Chances of pairs are backed by those of single characters, and without
    samples every ratio is zero.
    """
    at = F.sequence(F.lit(1), F.length(col(string_col)) - 1)
    pairs = samples.where(F.length(col(string_col)) > 1).select(
        col(secret_col).alias("secret"), F.explode(F.transform(at, lambda i: F.substring(col(string_col), i, 2))).alias("pair")
    )
    inside = pairs.dropna().where(F.col("pair").rlike(f"^{RUN}{{2}}$"))
    counts = {True: {}, False: {}}
    for row in inside.groupBy("secret", "pair").agg(F.count("*").alias("n")).collect():  # two rows per pair at most
        counts[row.secret][row.pair] = row.n
    chances = {}
    for label, seen in counts.items():
        single = {b: PRIOR + sum(seen.get(a + b, 0) for a in ALPHABET) for b in ALPHABET}
        every = sum(single.values())
        first = {a: sum(seen.get(a + b, 0) for b in ALPHABET) for a in ALPHABET}
        chances[label] = {a + b: (seen.get(a + b, 0) + BACKING * single[b] / every) / (first[a] + BACKING) for a in ALPHABET for b in ALPHABET}
    ratios = [math.log(chances[True][a + b] / chances[False][a + b]) for a in ALPHABET for b in ALPHABET]
    return Model(tuple(ratios))


def random_strings(spark: SparkSession, count: int = DRAWN, seed: int = 42) -> DataFrame:
    """``count`` strings drawn evenly from the alphabets that keys are written in, the same for a seed: column string."""
    letters = ALPHABET[:26]
    alphabets = F.array(*[F.lit(a) for a in (ALPHABET[:LETTERS], "0123456789abcdef", letters.upper() + "234567", letters + "0123456789")])
    rows = spark.range(count).select("id", F.get(alphabets, (F.col("id") % 4).cast("int")).alias("a"), F.get(F.array(*map(F.lit, DRAWN_LENGTHS)), F.floor(F.col("id") / 4 % len(DRAWN_LENGTHS)).cast("int")).alias("n"))
    letter = lambda i: F.substring(F.col("a"), (F.pmod(F.xxhash64(F.lit(seed), "id", i), F.length("a").cast("long")) + 1).cast("int"), F.lit(1))
    return rows.select(F.array_join(F.transform(F.sequence(F.lit(1), F.col("n")), letter), "").alias("string"))


def labelled_strings(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    texts: int = SAMPLE_TEXTS,
    strings: int = SAMPLE_STRINGS,
    drawn: int = DRAWN,
    seed: int = 42,
) -> DataFrame:
    """A bounded labelled sample: strings in the base patterns and ``drawn`` random ones, and words of texts without a base pattern.

    Strings come from ``texts`` texts of either kind at most, drawn by a hash of
    the id, and are the first ``strings`` of a text at most; assigned values have
    ``LEAST_ASSIGNED`` characters or more. What decides the draw is one number a
    text; texts are read again for those that are drawn. Null ids and texts are
    allowed; a table without texts gives the random strings alone.
    """
    given = docs.select(F.xxhash64(col(id_col)).alias("h"), text_of(text_col).alias("text"))
    marked = F.col("text").rlike(ASSIGN) | F.col("text").rlike(ACCESS) | F.col("text").rlike(HEX)
    marks = write_table(given.select("h", marked.alias("secret")), "marks")
    # bounded: two numbers a kind and text
    chosen = [marks.where(F.col("secret") == kind).select("h", "secret").distinct().orderBy("h").limit(texts) for kind in (True, False)]
    ids = chosen[0].unionByName(chosen[1]).groupBy(F.col("h").alias("drawn_h")).agg(F.bool_or("secret").alias("secret"))
    rows = given.join(F.broadcast(ids), F.col("h") == F.col("drawn_h"))
    values = F.filter(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= LEAST_ASSIGNED)
    found = F.concat(values, F.regexp_extract_all("text", F.lit(ACCESS), F.lit(0)), F.regexp_extract_all("text", F.lit(HEX), F.lit(0)))
    words = F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9_]{4,}"), F.lit(0))
    sample = rows.select("secret", F.explode(F.slice(F.when(F.col("secret"), found).otherwise(words), 1, strings)).alias("string"))
    made = random_strings(docs.sparkSession, drawn, seed)
    return sample.unionByName(made.select(F.lit(True).alias("secret"), "string"))


def find_secrets(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, and the spans of each kind as arrays assign, access, hex, random.

    A span has kind, start and end, in code points of the whole text, end
    exclusive. Base kinds are leftmost, without overlap within a kind, over
    whole texts; random spans lie in what the base spans leave, begin and end
    at separators (other than letters and digits), and take the ``=`` that pad a
    run at its end. Null and empty texts have no spans; rows are kept as they
    are, and other columns of ``docs`` are not read.
    """
    rows = docs.select(col(id_col).alias("id"), text_of(text_col).alias("text"))
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX}
    rows = rows.withColumns({f"m_{k}": F.regexp_extract_all("text", F.lit(p), F.lit(0)) for k, p in patterns.items()})
    kept = {
        "assign": F.transform(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= LEAST_ASSIGNED),
        "access": F.transform("m_access", lambda _: F.lit(True)),
        "hex": F.transform("m_hex", lambda _: F.lit(True)),
    }
    rows = rows.withColumns({f"k_{k}": F.when(F.size(f"m_{k}") > 0, keep) for k, keep in kept.items()})
    rows = rows.withColumns({f"b_{k}": F.when(F.size(f"m_{k}") > 0, F.split("text", p, -1)) for k, p in patterns.items()})
    rows = rows.select("id", "text", F.col("m_assign"), F.col("k_assign"), F.col("b_assign"), *[_positions(k).alias(k) for k in patterns])
    # base spans give way to as many blanks: first the kept assignments, then the others
    rows = rows.withColumn("left", F.when(F.size("m_assign") > 0, _blanked("assign")).otherwise(F.col("text"))).drop("text", "m_assign", "k_assign", "b_assign")
    for kind in ("access", "hex"):
        rows = rows.withColumn(f"m_{kind}", F.regexp_extract_all("left", F.lit(patterns[kind]), F.lit(0)))
        rows = rows.withColumn(f"k_{kind}", F.transform(f"m_{kind}", lambda _: F.lit(True)))
        rows = rows.withColumn(f"b_{kind}", F.when(F.size(f"m_{kind}") > 0, F.split("left", patterns[kind], -1)))
        rows = rows.withColumn("left", F.when(F.size(f"m_{kind}") > 0, _blanked(kind)).otherwise(F.col("left")))
    run = f"{RUN}{{{LEAST_RUN},}}"
    rows = rows.withColumn("m_random", F.regexp_extract_all("left", F.lit(run), F.lit(0)))
    rows = rows.withColumn("k_random", F.transform("m_random", lambda r: _stretches(r, model)))
    rows = rows.withColumn("b_random", F.when(F.exists("k_random", lambda k: F.size(k) > 0), F.split("left", run, -1)))
    rows = rows.select("id", "assign", "access", "hex", _random_positions().alias("random"))
    base = F.concat("assign", "access", "hex")
    free = F.filter("random", lambda r: ~F.exists(base, lambda b: (r["start"] < b["end"]) & (b["start"] < r["end"])))
    return rows.select(F.col("id").alias(id_col), "assign", "access", "hex", free.alias("random"))


def _blanked(kind: str) -> Column:
    """The text with blanks in place of the kept matches."""
    matches, keep = F.col(f"m_{kind}"), F.col(f"k_{kind}")
    parts = F.transform(
        F.col(f"b_{kind}"),
        lambda b, i: F.concat(b, F.coalesce(F.when(F.get(keep, i), F.repeat(F.lit(" "), F.length(F.get(matches, i)))).otherwise(F.get(matches, i)), F.lit(""))),
    )
    return F.array_join(parts, "")


def _with(value: Column, use) -> Column:
    """``use(value)``, with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _stretches(run: Column, model: Model) -> Column:
    """Random stretches of a run as (start, end), grown to the separators around them."""
    ratios, letters = model.column(), F.lit(ALPHABET)
    none = F.from_json(F.lit("[]"), "array<struct<start: int, end: int>>")
    names = ("at", "last", "start", "rise", "sum", "top", "top_sum", "end", "spans")

    def state(*values: Column) -> Column:
        return F.struct(*[v.alias(n) for v, n in zip(values, names)])

    def ended(s: Column) -> Column:
        return F.when(s["top_sum"] >= LEAST_SUM, F.concat(s["spans"], F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))).otherwise(s["spans"])

    zero, nought = F.lit(0), F.lit(0.0)

    def step(s: Column, letter: Column) -> Column:
        def moved(x: Column) -> Column:
            """With the letter's place in the alphabet and the ratio of its pair, which says nothing at a separator."""
            rise = s["rise"] + x["ratio"] - LEAST_RATIO
            total, at = s["sum"] + x["ratio"], s["at"]
            begun = state(at + 1, x["place"], at, nought, nought, nought, nought, at, ended(s))
            higher = state(at + 1, x["place"], s["start"], rise, total, rise, total, at + 1, s["spans"])
            lower = state(at + 1, x["place"], s["start"], rise, total, s["top"], s["top_sum"], s["end"], s["spans"])
            return F.when((rise <= 0) | (s["top"] - rise > FALL), begun).when(rise > s["top"], higher).otherwise(lower)

        place = F.instr(letters, letter)
        pair = _with(place, lambda p: F.struct(p.alias("place"), F.when((s["last"] < 1) | (s["last"] > LETTERS) | (p > LETTERS), nought).otherwise(F.get(ratios, (s["last"] - 1) * len(ALPHABET) + p - 1)).alias("ratio")))
        return _with(pair, moved)

    begin = state(zero, zero, zero, nought, nought, nought, nought, zero, none)
    found = F.aggregate(F.split(run, ""), begin, step, ended)

    def grown(span: Column) -> Column:
        before = F.length(F.regexp_extract(F.reverse(F.substring(run, F.lit(1), span["start"])), "^[A-Za-z0-9]*", 0))
        after = F.length(F.regexp_extract(F.substring(run, span["end"] + 1, F.length(run)), "^[A-Za-z0-9]*(?:={1,2}$)?", 0))
        return F.struct((span["start"] - before).alias("start"), (span["end"] + after).alias("end"))

    def joined(spans: Column, span: Column) -> Column:
        last = F.element_at(spans, -1)
        one = F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"))
        rest = F.slice(spans, F.lit(1), F.size(spans) - 1)
        return F.when(F.size(spans) == 0, F.array(span)).when(span["start"] < last["end"], F.concat(rest, F.array(one))).otherwise(F.concat(spans, F.array(span)))

    return F.aggregate(F.transform(found, grown), none, joined)


def _random_positions() -> Column:
    """Spans of the random stretches in the text."""
    matches, keep, between = F.col("m_random"), F.col("k_random"), F.col("b_random")
    none = F.from_json(F.lit("[]"), SPANS)

    def step(state: Column, i: Column) -> Column:
        start = state["at"] + F.length(F.get(between, i))
        spans = F.transform(F.get(keep, i), lambda s: F.struct(F.lit("random").alias("kind"), (start + s["start"]).alias("start"), (start + s["end"]).alias("end")))
        return F.struct((start + F.length(F.get(matches, i))).alias("at"), F.when(F.size(F.get(keep, i)) > 0, F.concat(state["spans"], spans)).otherwise(state["spans"]).alias("spans"))

    begin = F.struct(F.lit(0).alias("at"), none.alias("spans"))
    walked = F.aggregate(F.sequence(F.lit(0), F.size(matches) - 1), begin, step)["spans"]
    return F.when(between.isNotNull(), walked).otherwise(none)


def _positions(kind: str) -> Column:
    """Spans of the kept matches: matches and the text between them alternate, so positions are running sums."""
    matches, keep, between = F.col(f"m_{kind}"), F.col(f"k_{kind}"), F.col(f"b_{kind}")
    none = F.from_json(F.lit("[]"), SPANS)

    def step(state: Column, i: Column) -> Column:
        start = state["at"] + F.length(F.get(between, i))
        end = start + F.length(F.get(matches, i))
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"))
        spans = F.when(F.get(keep, i), F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    begin = F.struct(F.lit(0).alias("at"), none.alias("spans"))
    walked = F.aggregate(F.sequence(F.lit(0), F.size(matches) - 1), begin, step)["spans"]
    return F.when(F.size(matches) > 0, walked).otherwise(none)


def listed(spans: Column) -> Column:
    """Spans as ``kind:start:end`` by start, then kind in the order of ``KINDS``, joined by commas."""
    order = F.array(*[F.lit(k) for k in KINDS])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("k"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
