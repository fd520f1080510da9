import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.llm import runs
from tests.llm.conftest import odd_texts


def brute(words):
    """Start, length and smallest period of every run of two periods and more."""
    found, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i >= q:
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def long_enough(found, least):
    return sorted((r for r in found if r[1] >= least), key=lambda r: (r[0], r[2]))


def by_text(texts, least=1):
    codes: dict = {}
    flat = [codes.setdefault(w, len(codes)) for t in texts for w in t]
    text, found = runs.runs_of(np.array(flat, np.int64), np.array([len(t) for t in texts], np.int64), least)
    out = [[] for _ in texts]
    for t, s, e, q in zip(text.tolist(), *(f.tolist() for f in found)):
        out[t].append((s, e - s, q))
    return out


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


def drawn(rnd):
    n, kind = rnd.randrange(160), rnd.randrange(7)
    if kind == 0:
        return [rnd.choice("ab") for _ in range(n)]
    if kind == 1:
        return fibonacci(n + 2)
    if kind == 2:  # two regions of one small period, in and out of phase
        root = [rnd.choice("ab") for _ in range(rnd.randrange(1, 8))] * 100
        first, second = root[: rnd.randrange(1, 90)], root[rnd.randrange(8) :][: rnd.randrange(1, 90)]
        return first + second + first[: rnd.randrange(60)]
    if kind == 3:
        return [str(i.bit_count() % 2) for i in range(n)]
    if kind == 4:
        return ["a"] * n
    if kind == 5:
        root = [rnd.choice("abc") for _ in range(rnd.randrange(1, 60))]
        return root * rnd.randrange(1, 4) + root[: rnd.randrange(len(root))]
    root = (list("aab") * 60)[rnd.randrange(3) :][: rnd.randrange(30, 130)]
    return (root + ["c"] * rnd.randrange(2) + root) * 2


@pytest.mark.parametrize("seed", range(8))
def test_runs_equal_brute_force(seed):
    rnd = random.Random(seed)
    for _ in range(12):
        texts, least = [drawn(rnd) for _ in range(rnd.randrange(25))], rnd.choice([1, 12])
        assert by_text(texts, least) == [long_enough(brute(t), least) for t in texts]


def test_every_short_word_of_two_letters():
    for n in range(13):
        texts = list(itertools.product("ab", repeat=n))
        assert by_text(texts) == [long_enough(brute(t), 1) for t in texts]


def test_regions_whose_halves_have_a_small_period():
    texts = [(list("ab") * 600)[:1001] * 2 + ["a"], fibonacci(1500), fibonacci(1500)[::-1] + fibonacci(900), (list("ab") * 12)[:23] * 2]
    assert by_text(texts) == [long_enough(brute(t), 1) for t in texts]


def test_members_depend_on_the_words_after_them_only():
    rnd = random.Random(4)
    middle = [rnd.randrange(5) for _ in range(400)]
    texts = [[rnd.randrange(5) for _ in range(60)] + middle, [rnd.randrange(5) for _ in range(37)] + middle]
    for k in (2, 3, 4):
        chosen = []
        for t in texts:
            words = runs.Words(np.array(t), np.array([len(t)]))
            found = runs.all_runs(words)
            small = found[2] * 3 <= 1 << k
            chosen.append({len(t) - i for i in runs.synchronising(words, k, tuple(f[small] for f in found)).tolist() if i >= len(t) - 400 + (1 << k)})
        assert chosen[0] == chosen[1] and chosen[0]


ROWS = [(1, "a b " * 9), (2, "x " * 30 + "y " * 12), (2, "x " * 30 + "y " * 12), (3, None), (None, "one two  three\tfour\n" * 4), (4, ""), (5, " \n"), (6, "no run here"), (7, "long " * 60_000), (8, "a b c " * 5000 + "z " + "a b c " * 5000)]


def plain(text, least=12):
    words = re.findall(runs.WORD, text or "")
    found = long_enough(brute(words), least)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    return len(words), found, best, " ".join(w for i, w in enumerate(words) if i not in gone)


def test_rows_and_collapsed_texts(make_docs):
    rows = [r for r in ROWS if r[0] not in (7, 8)] + [(100 + i, t * 3) for i, t in enumerate(odd_texts(40))]
    docs = make_docs([(*r, "s") for r in rows]).withColumns({"runs": F.lit(1), "ID": F.lit(2), "collapsed": F.lit("x"), "Longest": F.lit(0)})
    found = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.longest and tuple(r.longest), r.collapsed) for r in runs.periodic_runs(docs).collect()]
    assert sorted(map(str, found)) == sorted(str((i, *plain(t))) for i, t in rows)
    assert runs.periodic_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        runs.periodic_runs(docs, least=0)


def test_long_texts(make_docs):
    found = {r.doc_id: r for r in runs.periodic_runs(make_docs(ROWS[-2:])).collect()}
    assert [tuple(r) for r in found[7].runs] == [(0, 60_000, 1)] and found[7].collapsed == "long"
    assert [tuple(r) for r in found[8].runs] == [(0, 15_000, 3), (15_001, 15_000, 3)] and found[8].collapsed == "a b c z a b c"


def test_texts_with_a_periodic_end(make_docs):
    rows = [(i, " ".join(f"w{j}" for j in range(i % 45))) for i in range(300)] + [(None, "a b c"), (990, None)]
    for r in runs.repeating(make_docs(rows)).collect():
        words = re.findall(runs.WORD, dict(rows)[r.doc_id] or "")
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        if r.doc_id is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (i - a) % p if i >= a else i] for i in range(n)]
        assert r.text.split() == words


def test_listed(spark):
    one = spark.createDataFrame([([(0, 12, 3), (4, 20, 1)], [])], "r array<struct<start: long, length: long, period: long>>, e array<struct<start: long, length: long, period: long>>")
    assert one.select(runs.listed(F.col("r")), runs.listed(F.col("e"))).first()[:] == ("0,12,3\n4,20,1\n", "")
