import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tabloom.llm import mixing


def brute_targets(sizes):
    """Excess over three times a source's size is shared again by weight until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    target = {s: sum(sizes.values()) * weight[s] / sum(weight.values()) for s in names}
    full = set()
    while True:
        over = {s for s in names if s not in full and target[s] > 3 * sizes[s]}
        if not over:
            return target
        excess = sum(target[s] - 3 * sizes[s] for s in over)
        full |= over
        for s in over:
            target[s] = 3.0 * sizes[s]
        rest = sum(weight[s] for s in names if s not in full)
        for s in names:
            if s not in full:
                target[s] += excess * weight[s] / rest


def corpus(seed=1):
    rnd = random.Random(seed)
    rows = []
    for source, n, most in (("b", 120, 60), ("a", 300, 200), ("z", 40, 30), (None, 60, 90), ("é", 3, 4), ("few", 150, 300)):
        rows += [(len(rows) + i, " ".join(["w"] * rnd.randrange(0, most)), source) for i in range(n)]
    return [*rows, (5000, None, "a"), (5001, "\n", None), (5002, "x " * 400, "a"), (7, "again one two", "b"), (7, "again one two", "b"), (None, "no id", "z")]


def test_mix_reaches_the_targets(make_docs):
    rows = corpus()
    docs = make_docs(rows).withColumns({"size": F.lit("x"), "rate": F.lit(1)})
    found = mixing.mix(docs).collect()
    words = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    sizes = defaultdict(int)
    for n, (_, _, s) in zip(words, rows):
        sizes[s] += n
    target = brute_targets(sizes)
    assert Counter((r.doc_id, r.size, r.source_size, r.source) for r in found) == Counter((i, n, sizes[s], s) for n, (i, _, s) in zip(words, rows))
    taken = defaultdict(int)
    for r in found:
        assert abs(r.target - target[r.source]) < 1e-6 * max(1, target[r.source])
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    for s, t in target.items():
        assert abs(taken[s] - t) <= max(6, 0.01 * t), (s, taken[s], t)


def test_reruns_agree_however_the_rows_lie(make_docs):
    rows = corpus(2)
    first = mixing.mix(make_docs(rows)).select("doc_id", "source", "size", "taken").collect()
    again = mixing.mix(make_docs(rows[::-1]).repartition(7)).select("doc_id", "source", "size", "taken").collect()
    assert Counter(map(tuple, first)) == Counter(map(tuple, again))


def test_rates_are_tilted_by_size(make_docs):
    """The tilt found solves the dual: tilted words add up to the target."""
    import math

    rows = [(i, "w " * (i % 50 + 1), "a") for i in range(200)] + [(1000 + i, "w " * 10, "b") for i in range(900)]
    docs = make_docs(rows)
    sizes = docs.select("source", mixing.word_count(F.col("text")).alias("size")).groupBy("source", "size").agg(F.count("*").alias("documents"))
    totals = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("documents")).alias("source_size"))
    goals = mixing.targets(totals)
    found = {r.source: r for r in mixing.tilts(sizes, goals).collect()}
    for goal in goals.collect():
        tilt = found[goal.source]
        words = sum(min(3.0, math.exp(tilt.tilt * r["size"] / tilt["mean"])) * r["size"] * r.documents for r in sizes.where(F.col("source") == goal.source).collect())
        assert abs(words / goal.target - 1) < 1e-4


def test_take_repeats_rows(make_docs):
    docs = make_docs(corpus(3))
    copies = Counter({(r.doc_id, r.text, r.source): r.copies for r in mixing.mix(docs).collect()})
    times = Counter((i, t, s) for i, t, s in corpus(3))
    taken = mixing.take(docs)
    assert taken.columns == docs.columns
    assert Counter((r.doc_id, r.text, r.source) for r in taken.collect()) == Counter({k: n * times[k] for k, n in copies.items() if n})


def test_an_empty_table_stays_empty(make_docs):
    assert mixing.mix(make_docs([])).count() == 0 and mixing.take(make_docs([])).count() == 0


def test_texts_without_words(make_docs):
    found = mixing.mix(make_docs([(1, "", "a"), (2, None, "b")])).collect()
    assert [(r.size, r.source_size, r.target, r.taken) for r in found] == [(0, 0, 0.0, 0)] * 2


def test_very_long_documents_leave_no_error(make_docs):
    """Documents that outweigh many others leave no error in their source, and the short ones stay in the mix."""
    rnd = random.Random(17)
    rows = [(i, "w " * rnd.randrange(1, 20), "a") for i in range(1000)] + [(1000 + i, "w " * 3000, "a") for i in range(20)]
    rows += [(5000 + i, "w " * 60, "b") for i in range(600)] + [(9000, "w " * 100_000, "c"), *[(9001 + i, "w " * 50, "c") for i in range(800)]]
    found = mixing.mix(make_docs(rows)).collect()
    for source in "abc":
        ours = [r for r in found if r.source == source]
        assert abs(sum(r.taken for r in ours) - ours[0].target) <= 0.01 * ours[0].target, source
    short = [r for r in found if r.source == "a" and r.doc_id < 1000]
    assert sum(r.copies > 0 for r in short) > 100


def brute_copies(rows, rates):
    """Copies by size of one source: largest first, what rounding leaves carried on; ``rates`` by size."""
    sizes = Counter(n for n, _ in rows)
    out, carry = {}, 0.0
    for size in sorted(sizes, reverse=True):
        want = rates[size] * size * sizes[size] + carry
        out[size] = min(3 * sizes[size], max(0, int(want // size if want % size < size / 2 else want // size + 1)))
        carry = want - out[size] * size
    return out


def test_copies_equal_brute_force(make_docs):
    import math

    rnd = random.Random(23)
    rows = [(i, "w " * rnd.choice([1, 2, 3, 7, 19, 40]), rnd.choice("abbb")) for i in range(700)]
    docs = make_docs(rows)
    found = mixing.mix(docs).collect()
    sizes = docs.select("source", mixing.word_count(F.col("text")).alias("size")).groupBy("source", "size").agg(F.count("*").alias("documents"))
    totals = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("documents")).alias("source_size"))
    tilts = {r.source: r for r in mixing.tilts(sizes, mixing.targets(totals)).collect()}
    for source in "ab":
        ours = [r for r in found if r.source == source]
        t = tilts.get(source)
        rates = {r["size"]: 3.0 if t is None else min(3.0, math.exp(t.tilt * r["size"] / t["mean"])) for r in ours}
        expected = brute_copies([(r["size"], r.doc_id) for r in ours], rates)
        by_size = Counter()
        for r in ours:
            by_size[r["size"]] += r.copies
        assert dict(by_size) == expected
        for size in expected:  # dealt evenly: no two documents of a size differ by more than one copy
            copies = {r.copies for r in ours if r["size"] == size}
            assert max(copies) - min(copies) <= 1
