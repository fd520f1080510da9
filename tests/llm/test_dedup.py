import random
from collections import Counter, defaultdict

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabloom.llm import exact_dedup, simhash
from tabloom.llm.components import components
from tests.llm.conftest import odd_texts

LONG = "One sentence here. " * 2000 + "x" * 30000


def classes(n, pairs):
    """Smallest member of each node's component."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


# exact


@pytest.mark.parametrize("text", ["", "a", LONG, "é中😀 \n" * 900, "line\n" * 3000, *odd_texts(30)])
def test_chunks_join_to_the_text(spark, text):
    chunks = spark.createDataFrame([(text,)], "text string").select(exact_dedup.chunks_of(F.col("text"))).first()[0]
    assert "".join(chunks) == text and all(0 < len(c) <= exact_dedup.LONGEST + 2 for c in chunks)


def test_an_insertion_moves_few_chunks(spark):
    rnd = random.Random(3)
    text = " ".join(rnd.choice(["alpha", "beta", "gamma", "delta"]) + str(rnd.randrange(999)) + rnd.choice(["", "", "."]) for _ in range(9000))
    rows = spark.createDataFrame([(text,), ("new words " + text,)], "text string").select(exact_dedup.chunks_of(F.col("text"))).collect()
    assert len(set(rows[0][0]) - set(rows[1][0])) < 0.2 * len(rows[0][0])


ROWS = [(1, "a b"), (2, "a b"), (2, "a b"), (3, "a  b"), (4, None), (5, ""), (None, "n"), (None, "n"), (6, LONG), (7, LONG), (8, LONG + "!")]


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    keep = {t: max(ids, key=lambda i: (i is not None, i)) for t, ids in groups.items()}
    return Counter((i, keep[t or ""], len(groups[t or ""])) for i, t in rows), {t: (k, 1) for t, k in keep.items()}


def test_equal_texts_are_grouped_whole(make_docs):
    docs = make_docs(ROWS).withColumns({"kept": F.lit("x"), "digest": F.lit(1)})
    found = exact_dedup.equal_texts(docs).collect()
    rows, keep = brute_exact(ROWS)
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in found) == rows
    kept = Counter((r.text_sha256, r.doc_id) for r in found if r.kept)
    assert len(kept) == len(keep) and set(kept.values()) == {1}


def test_identifiers_with_collisions_are_drawn_anew(make_docs):
    drawn = []

    def weak(chunk, attempt):
        drawn.append(attempt)
        return [F.length(chunk) if attempt == 0 else F.xxhash64(F.lit(attempt), chunk)]

    rows = [(1, "abc"), (2, "xyz"), (3, "abc")]
    found = exact_dedup.equal_texts(make_docs(rows), identify=weak).collect()
    assert Counter((r.doc_id, r.keep_id) for r in found) == Counter([(1, 3), (2, 2), (3, 3)]) and max(drawn) == 1
    with pytest.raises(RuntimeError):
        exact_dedup.equal_texts(make_docs(rows), identify=lambda chunk, attempt: [F.length(chunk)])


def test_texts_equal_after_normalising(make_docs):
    found = exact_dedup.equal_texts(make_docs([(1, "A"), (2, "a")]), normalise=F.lower).collect()
    assert {r.keep_id for r in found} == {2}


def test_drop_equal_keeps_one_row_with_its_columns(make_docs):
    docs = make_docs([(*r, "s") for r in ROWS])
    left = exact_dedup.drop_equal(docs)
    assert left.columns == docs.columns
    _, keep = brute_exact(ROWS)
    assert Counter((r.doc_id, r.text or "") for r in left.collect()) == Counter((k, t) for t, (k, _) in keep.items())
    assert exact_dedup.drop_equal(docs.where("doc_id < 2")).count() == 1
    assert exact_dedup.equal_texts(docs.limit(0)).count() == 0 and exact_dedup.drop_equal(docs.limit(0)).count() == 0


# components


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=40))
def test_components_equal_brute_force(spark, pairs):
    frame = spark.createDataFrame(pairs, "a long, b long")
    found = {r.node: r.label for r in components(frame).collect()}
    expected = classes(26, pairs)
    nodes = {x for a, b in pairs if a != b for x in (a, b)}
    assert set(found) == nodes
    for a in nodes:
        for b in nodes:
            assert (found[a] == found[b]) == (expected[a] == expected[b])


def test_components_of_a_long_path(spark):
    found = components(spark.range(300).selectExpr("id AS a", "id + 1 AS b"))
    assert found.count() == 301 and found.select("label").distinct().count() == 1


# near


def plain_print(text, words=3):
    import re

    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not found:
        return 0
    shingles = [" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_equal_the_definition():
    for text in ["", " \n", "One", "one TWO", "ÀB c d", *odd_texts(300), "a b c d e f " * 2000]:
        assert simhash.fingerprint(text) == plain_print(text)


def near_prints(n, seed):
    rnd = random.Random(seed)
    centres = [rnd.getrandbits(64) for _ in range(4)]
    out = set()
    while len(out) < n:
        value = rnd.choice(centres)
        for _ in range(rnd.randrange(6)):
            value ^= 1 << rnd.randrange(64)
        out.add(value)
    return sorted(out)


@pytest.mark.parametrize("bits", [0, 1, 2, 3])
@pytest.mark.parametrize("bucket", [2, 4096])
def test_links_join_exactly_what_all_pairs_join(spark, bits, bucket):
    prints = near_prints(160, bits)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    pairs = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= bits]
    links = simhash.links(spark.createDataFrame([(s,) for s in signed], "print long"), bits, bucket).collect()
    index = {s: i for i, s in enumerate(signed)}
    found = [(index[r.a], index[r.b]) for r in links]
    assert all((prints[a] ^ prints[b]).bit_count() <= bits for a, b in found)
    assert classes(len(prints), found) == classes(len(prints), pairs)


def test_near_copies_and_what_stays(make_docs):
    base = " ".join(f"word{i}" for i in range(400))
    rows = [(5, base), (3, base + " end"), (9, base.upper()), (9, base.upper()), (1, None), (None, " "), (7, "quite another text here"), (None, None), (7, "other")]
    prints = [plain_print(t) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    group = classes(len(rows), pairs)
    docs = make_docs(rows).withColumns({"print": F.lit("x"), "label": F.lit(0)})
    found = simhash.near_copies(docs).collect()
    least = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in set(group)}
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in found) == Counter(
        (rows[i][0], f"{prints[i]:016x}", least[group[i]]) for i in range(len(rows))
    )
    left = simhash.drop_near(docs)
    assert left.columns == docs.columns
    kept = Counter(r.doc_id for r in left.collect())
    assert kept == Counter(least[g] for g in set(group))
    assert simhash.drop_near(make_docs(rows[:2])).count() == len({group[0], group[1]})
    assert simhash.near_copies(docs.limit(0)).count() == 0 and simhash.drop_near(docs.limit(0)).count() == 0
