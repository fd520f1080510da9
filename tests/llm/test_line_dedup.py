import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tabloom.llm import line_dedup
from tests.llm.conftest import odd_texts


def halves(n, seed=0):
    hashes = [xxhash.xxh3_128_digest(f"{seed}:{i}".encode()) for i in range(n)]
    return line_dedup._halves(hashes) if n else (np.empty(0, "<u8"), np.empty(0, "<u8"))


@pytest.mark.parametrize("n", [0, 1, 2, 7, 1000, 50_000])
def test_numbers_are_perfect_and_minimal(n):
    tree = line_dedup.PerfectHash.build(*halves(n))
    again = line_dedup.PerfectHash(tree.sizes, tree.packed())
    assert sorted(again.find(*halves(n)).tolist()) == list(range(n))
    others = again.find(*halves(500, 1))
    assert ((others >= -1) & (others < max(n, 0))).all()
    assert n < 1000 or len(tree.packed()) * 8 < 6 * n


def test_equal_keys_are_refused():
    a, b = halves(1)
    with pytest.raises(ValueError):
        line_dedup.PerfectHash.build(np.repeat(a, 2), np.repeat(b, 2))


def key(line):
    line = line.strip(" \t\n\v\f\r")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)


def brute(rows, documents, least_chars=1):
    seen = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if len(k) >= least_chars)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if len(key(x)) < least_chars or seen[key(x)] < documents]
        out.append((i, "\n".join(left), len(lines), len(lines) - len(left)))
    return sorted(map(str, out))


def found(docs, **options):
    return sorted(str((r.doc_id, r.kept, r.n_lines, r.n_dropped)) for r in line_dedup.drop_shared_lines(docs, **options).collect())


LINES = ["Header", " header\t", "HEADER\r", "É line", "é line", "", " ", "own", "中文", "\x0b tail \x0c", "\x1cx", "\x85", "shared one", "shared two"]


@pytest.mark.parametrize("documents, least_chars, shard_keys", [(1, 1, 32_768), (2, 1, 1), (3, 1, 5), (3, 3, 32_768), (2, 0, 4), (10, 1, 32_768)])
def test_kept_lines_equal_brute_force(make_docs, documents, least_chars, shard_keys):
    rnd = random.Random(documents)
    rows = [(i, "\n".join(rnd.choice(LINES) + rnd.choice(["", "", str(rnd.randrange(40))]) for _ in range(rnd.randrange(12)))) for i in range(120)]
    rows += [(1, None), (None, None), (None, "own\nown"), (3, ""), (4, "Header\n" * 3), (5, "\n"), *[(i, t) for i, t in enumerate(odd_texts(60))]]
    rows += [(7, rows[0][1])] * 30 + [(1000 + i, "copy\nHeader\nof many") for i in range(80)]
    docs = make_docs([(*r, "s") for r in rows]).withColumns({"kept": F.lit("x"), "T1": F.lit(1), "drop": F.lit(2), "shard": F.lit(0), "n_lines": F.lit(0)})
    assert found(docs, documents=documents, least_chars=least_chars, shard_keys=shard_keys) == brute(rows, documents, least_chars)


def test_long_texts_and_empty_tables(make_docs):
    line = "word " * 20_000
    rows = [(i, "\n".join([line, f"own {i}"] + [f"line {j}" for j in range(3000)])) for i in range(3)]
    assert found(make_docs(rows), documents=3) == brute(rows, 3)
    assert line_dedup.drop_shared_lines(make_docs(rows).limit(0)).count() == 0
    blank = [(1, None), (2, " \n ")]
    assert found(make_docs(blank), documents=1) == brute(blank, 1)
    with pytest.raises(ValueError):
        line_dedup.drop_shared_lines(make_docs(rows), documents=0)
