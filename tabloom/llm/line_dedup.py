"""Lines that many documents share, found by probing a sharded minimal perfect hash.

A line's key is its text without white space at both ends, A-Z in lower case. Its
128-bit hash tells it. The distinct hashes with the number of their documents are
dealt into shards by the hash; each shard becomes a minimal perfect hash (levels
of bits: a key that meets no other at its place of a level is settled there, the
others go on) that numbers its keys without gaps, and two compact arrays by that
number, fingerprints of 32 bits and counts that stop at the threshold. Documents
send the hashes of their lines to the shards, where they are looked up in the
arrays, and get back those of lines to drop: no line is joined with a line. Every
probed line is among the keys, so each is found at its own place; the fingerprint
guards the arrays.

A line or a text of which there are very many copies stays small: each step of a
task sends the lines of equal texts once, and a shard with many more probes than
others is copied to several tasks, which share its probes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm.common import col, steps, text_of, utf8
from tabloom.session import write_table

WHITE = b" \t\n\v\f\r"
SHARD_KEYS = 32_768
PROBES = 4  # probes of a task per key of a full shard
SLACK = 2  # bits of a level per key that comes to it
LEVELS = 200
GOLDEN = 0x9E3779B97F4A7C15


def key_of(line: bytes) -> bytes:
    """The line without white space at its ends, A-Z in lower case (other letters as they are)."""
    return line.strip(WHITE).lower()


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _place(first: np.ndarray, second: np.ndarray, level: int, size: int) -> np.ndarray:
    own = np.uint64(GOLDEN * (level + 1) % (1 << 64))
    return (_mixed(first + _mixed(second + own)) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Numbers distinct 128-bit keys (two unsigned halves) from 0 without gaps."""

    def __init__(self, sizes: list[int], bits: bytes):
        self.sizes = sizes
        self.bits = np.unpackbits(np.frombuffer(bits, np.uint8), count=sum(sizes), bitorder="little").astype(bool)
        self.ranks = np.concatenate([[0], np.cumsum(self.bits)])

    @classmethod
    def build(cls, first: np.ndarray, second: np.ndarray) -> PerfectHash:
        sizes, bits = [], []
        while len(first):
            if len(sizes) == LEVELS:
                raise ValueError("keys are not distinct")
            size = SLACK * len(first)
            place = _place(first, second, len(sizes), size)
            alone = np.bincount(place, minlength=size) == 1
            sizes.append(size)
            bits.append(alone)
            left = ~alone[place]
            first, second = first[left], second[left]
        whole = np.concatenate(bits) if bits else np.empty(0, bool)
        return cls(sizes, np.packbits(whole, bitorder="little").tobytes())

    def packed(self) -> bytes:
        return np.packbits(self.bits, bitorder="little").tobytes()

    def find(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The number of each key; -1 for some that are no keys, any number for others."""
        found = np.full(len(first), -1, np.int64)
        left, base = np.arange(len(first)), 0
        for level, size in enumerate(self.sizes):
            at = base + _place(first[left], second[left], level, size)
            hit = self.bits[at]
            found[left[hit]] = self.ranks[at[hit]]
            left, base = left[~hit], base + size
        return found


def _halves(hashes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(hashes), "<u8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _unsigned(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy().view(np.uint64)


def _long_enough(key: bytes, least_chars: int) -> bool:
    return len(key) >= least_chars and (least_chars <= 1 or len(key.decode()) >= least_chars)


def _lines(least_chars: int):
    """Hashes of the distinct keys of each distinct text of a step, with the number of its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in steps(whole, "text"):
                firsts: dict[tuple[int, int], list] = {}
                names = zip(batch.column("t1").to_pylist(), batch.column("t2").to_pylist())
                for i, name in enumerate(names):
                    firsts.setdefault(name, [i, 0])[1] += 1
                texts = utf8(batch.column("text"))
                hashes: list[bytes] = []
                owners: list[int] = []
                counts: list[int] = []
                known: dict[bytes, bytes] = {}
                for i, rows in firsts.values():
                    keys = {key_of(line) for line in texts[i].as_buffer().to_pybytes().split(b"\n")}
                    for key in keys:
                        if _long_enough(key, least_chars):
                            found = known.get(key)
                            if found is None:
                                found = known[key] = xxhash.xxh3_128_digest(key)
                            hashes.append(found)
                            owners.append(i)
                            counts.append(rows)
                if not hashes:
                    continue
                a, b = _halves(hashes)
                at = pa.array(owners, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("t1").take(at), batch.column("t2").take(at), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(counts, pa.int64())],
                    ["t1", "t2", "h1", "h2", "n"],
                )

    return run


SHARD = "shard long, sizes array<int>, bits binary, prints binary, counts binary, probes long"


def _built(threshold: int):
    """One row per shard: the levels and the arrays of its keys."""
    kind = np.min_scalar_type(threshold).newbyteorder("<")

    def run(table: pa.Table) -> pa.Table:
        first, second = _unsigned(table["h1"]), _unsigned(table["h2"])
        tree = PerfectHash.build(first, second)
        at = tree.find(first, second)
        prints, counts = np.zeros(len(at), "<u4"), np.zeros(len(at), kind)
        prints[at] = second >> np.uint64(32)
        counts[at] = np.minimum(table["n"].to_numpy(), threshold)
        row = [[table["shard"][0].as_py()], [tree.sizes], [tree.packed()], [prints.tobytes()], [counts.tobytes()], [int(table["probes"].to_numpy().sum())]]
        kinds = [pa.int64(), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
        return pa.Table.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], names=["shard", "sizes", "bits", "prints", "counts", "probes"])

    return run


def _probed(threshold: int):
    """Text and line of each probe whose count reaches the threshold."""
    kind = np.min_scalar_type(threshold).newbyteorder("<")

    def run(probes: pa.Table, shard: pa.Table) -> pa.Table:
        if not probes.num_rows:
            return probes.select(["t1", "t2", "h1", "h2"])
        row = shard.slice(0, 1).to_pylist()[0]
        first, second = _unsigned(probes["h1"]), _unsigned(probes["h2"])
        at = PerfectHash(row["sizes"], row["bits"]).find(first, second)
        prints, counts = np.frombuffer(row["prints"], "<u4"), np.frombuffer(row["counts"], kind)
        if (at < 0).any() or (prints[at] != (second >> np.uint64(32)).astype("<u4")).any():
            raise RuntimeError("a probed line is not among the keys")
        return probes.select(["t1", "t2", "h1", "h2"]).filter(pa.array(counts[at] >= threshold))

    return run


def _kept(least_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in steps(whole, "text"):
                texts, totals, gone = [], [], []
                for text, drop in zip(utf8(batch.column("text")).to_pylist(), batch.column("drop").to_pylist()):
                    if not drop:
                        texts.append(text)
                        totals.append(text.count("\n") + 1)
                        gone.append(0)
                        continue
                    known = {(d["h1"], d["h2"]) for d in drop}
                    lines = text.encode().split(b"\n")
                    left = []
                    for line in lines:
                        key = key_of(line)
                        if _long_enough(key, least_chars):
                            a, b = np.frombuffer(xxhash.xxh3_128_digest(key), "<i8").tolist()
                            if (a, b) in known:
                                continue
                        left.append(line)
                    texts.append(b"\n".join(left).decode())
                    totals.append(len(lines))
                    gone.append(len(lines) - len(left))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array(texts, pa.string()), pa.array(totals, pa.int64()), pa.array(gone, pa.int64())],
                    ["id", "kept", "n_lines", "n_dropped"],
                )

    return run


def shared_lines(lines: DataFrame, threshold: int, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """Text and line (t1, t2, h1, h2) of every probe whose line has ``threshold`` documents or more.

    ``lines`` (t1, t2, h1, h2, n; a written table) has a row for each line of a
    text and step, with the number of documents it stands for.
    """
    spark = lines.sparkSession
    counts = write_table(lines.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.count("*").alias("probes")), "line-counts")
    total = counts.agg(F.count("*").alias("keys"), F.sum("probes").alias("probes")).first()
    most = PROBES * shard_keys
    # as many shards as bound the keys and the probes of one, and enough for all tasks
    wanted = max(-(-total.keys // shard_keys), -(-(total.probes or 0) // most), 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    shards = max(1, min(total.keys, wanted))
    shard = F.pmod("h1", F.lit(shards))
    built = counts.withColumn("shard", shard).groupBy("shard").applyInArrow(_built(threshold), SHARD)
    arrays = write_table(built, "line-shards")
    # tasks that share a shard: as many as its probes exceed twice the mean, or what one should hold
    fair = max(1, min(most, 2 * -(-(total.probes or 0) // shards)))
    parts = F.ceil(F.col("probes") / F.lit(fair)).cast("int")
    wide = write_table(arrays.select("shard", parts.alias("parts")).where("parts > 1"), "line-wide")
    probes = lines.select("t1", "t2", "h1", "h2", shard.alias("shard")).join(wide, "shard", "left")
    part = F.when(F.col("parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("t1", "t2"), F.col("parts")).cast("int"))
    probes = probes.select("t1", "t2", "h1", "h2", "shard", part.alias("part"))
    copies = arrays.withColumn("part", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1)))
    found = probes.groupBy("shard", "part").cogroup(copies.groupBy("shard", "part"))
    return found.applyInArrow(_probed(threshold), "t1 long, t2 long, h1 long, h2 long")


def drop_shared_lines(
    docs: DataFrame,
    documents: int = 10,
    least_chars: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    shard_keys: int = SHARD_KEYS,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, kept (text without the dropped lines), n_lines, n_dropped.

    Lines end at a line feed and nowhere else; a null or empty text is one empty
    line. A line whose key has ``least_chars`` code points or more and is found
    in ``documents`` rows or more goes from every text, also where it stands
    several times; the others are joined by a line feed, none left over is an
    empty text. Rows are kept as they are; repeated rows and null ids count as
    documents of their own. An empty table gives no rows. Other columns of
    ``docs`` are not read.
    """
    if documents < 1 or least_chars < 0:
        raise ValueError("lines are found in one document at least, and have no negative length")
    text = text_of(text_col)
    named = docs.select(col(id_col).alias("id"), text.alias("text")).withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(1), F.col("text"))})
    schema = "t1 long, t2 long, h1 long, h2 long, n long"
    lines = write_table(named.select("text", "t1", "t2").mapInArrow(_lines(least_chars), schema), "lines")
    gone = shared_lines(lines, documents, shard_keys)
    gone = gone.groupBy("t1", "t2").agg(F.collect_set(F.struct("h1", "h2")).alias("drop"))
    # both sides are read from tables, so that a join splits the rows of a text with very many copies
    gone = write_table(gone.select(F.col("t1").alias("d1"), F.col("t2").alias("d2"), "drop"), "line-drops")
    marked = named.join(gone, (F.col("t1") == F.col("d1")) & (F.col("t2") == F.col("d2")), "left").select("id", "text", "drop")
    out = T.StructType(
        [
            T.StructField("id", named.schema["id"].dataType),
            T.StructField("kept", T.StringType()),
            T.StructField("n_lines", T.LongType()),
            T.StructField("n_dropped", T.LongType()),
        ]
    )
    return marked.mapInArrow(_kept(least_chars), out).withColumnRenamed("id", id_col)
