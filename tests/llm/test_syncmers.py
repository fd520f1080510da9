import random
from collections import Counter

import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from tabloom.llm import syncmers

K, S = syncmers.K, syncmers.S


def measured(docs):
    found = syncmers.edited_neighbours(docs)
    found = syncmers.with_likeness(found, "sketch", "edited_sketch", "near_edited")
    found = syncmers.with_likeness(found, "sketch", "next_sketch", "near_next")
    prints = {c: syncmers.fingerprint(F.col(s)) for c, s in (("fingerprint", "sketch"), ("edited_fingerprint", "edited_sketch"))}
    return found.withColumns(prints).select("doc_id", "text", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def texts(n, seed=1):
    rnd = random.Random(seed)
    return [" ".join("".join(rnd.choice("abcdeé😀") for _ in range(rnd.randrange(1, 9))) for _ in range(rnd.randrange(0, 150))) for _ in range(n)]


def brute(rows):
    """Edited text of each distinct (id, text) when every id has one text."""
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0]), reverse=True)
    out = {}
    for (i, t), (_, following) in zip(order, [*order[1:], order[0]]):
        n = len(t) // 3
        out[i] = (t[: len(t) - n] + following[:n], following)
    return out


def ends_token(c):
    return c in "!\"#$%&'()*+,./:;<=>?@[\\]^_`{|}~037jkqvxzJKQVXZ" or bool(regex.match(r"\p{M}", c)) or ord(c) >= 0x2E80


def brute_tokens(text):
    out, held = [], ""
    for c in text:
        if c in " \t\n\v\f\r":
            out += [held] if held else []
            held = ""
            continue
        if len(held) == syncmers.LONGEST:
            out.append(held)
            held = ""
        held += c
        if ends_token(c):
            out.append(held)
            held = ""
    return [*out, held] if held else out


def chained(values):
    """The engine's 64-bit hash of several strings or numbers, signed."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v.to_bytes(8, "little", signed=True), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def brute_sketch(text):
    """(hash, position) of every closed syncmer."""
    found = brute_tokens(text)
    if not found:
        return []
    found = [""] * (K - 1) + found + [""] * (K - 1)
    runs = [chained(found[i : i + S]) for i in range(len(found) - S + 1)]
    out = []
    for i in range(len(found) - K + 1):
        inside = runs[i : i + K - S + 1]
        if min(inside) in (inside[0], inside[-1]):
            out.append((chained(inside[::S]) & syncmers.HASH, i))
    return out


def brute_print(sketch):
    gaps = [b - a for a, b in zip([0, *[p for _, p in sketch]], [p for _, p in sketch])]
    return "".join(f"{g:x}{h:08x}" for g, (h, _) in zip(gaps, sketch))


def brute_likeness(a, b):
    if not a and not b:
        return 1.0
    merged = sorted([(h, p, 0) for h, p in a] + [(h, p, 1) for h, p in b])
    offsets = sorted((w[1] - v[1]) * (1 if w[2] else -1) for v, w in zip(merged, merged[1:]) if v[0] == w[0] and v[2] != w[2])
    if not offsets:
        return 0.0
    shift = offsets[len(offsets) // 2]
    width = syncmers.NEAR + max([0, *[s[-1][1] for s in (a, b) if s]]) // syncmers.PART
    common, waiting = 0, None
    for h, p, side in sorted([(h, p, 0) for h, p in a] + [(h, p - shift, 1) for h, p in b]):
        if waiting and waiting[0] == h and waiting[2] != side and p - waiting[1] <= width:
            common, waiting = common + 1, None
        else:
            waiting = (h, p, side)
    return common / (len(a) + len(b) - common)


ODD = ["", " \n ", "a", "ab", "abc  ", "天地玄", "x " * 50, "é😀" * 9, "a" * 100, "ab " * 200, "x̀ý" * 30, "j" * 40, "same words again and again " * 30]


def test_every_result_equals_brute_force(make_docs):
    rows = [(i * 13 % 997, t) for i, t in enumerate([*texts(97), *ODD])]
    near = texts(1, 33)[0] * 3
    rows += [(2000 + i, near[:k] + "new words here " + near[k:]) for i, k in enumerate((0, 50, 400, 900))] + [(3000, near), (3001, near[500:] + " " + near[:500])]
    rows += [(4000, ""), (None, "no id at all, though some words"), (4001, "z " * 3000), (301, "same here " * 30), (302, "same here " * 30), (301, "same here " * 30)]
    docs = make_docs([*rows, (4002, None)]).withColumns({"at": F.lit("x"), "sketch": F.lit(1), "_sketch_t": F.lit(2), "Next": F.lit(3)})
    found = measured(docs).collect()
    every = [*rows, (4002, "")]
    expected = brute(every)
    assert Counter((r.doc_id, r.text, r.edited) for r in found) == Counter((i, t, expected[i][0]) for i, t in every)
    assert len({r.near_next for r in found}) > 5
    for r in found:
        own, edited, following = map(brute_sketch, (r.text, r.edited, expected[r.doc_id][1]))
        assert (r.fingerprint, r.edited_fingerprint) == (brute_print(own), brute_print(edited))
        assert r.near_edited == brute_likeness(own, edited) and r.near_next == brute_likeness(own, following)


def test_anchors_leave_no_wide_gap():
    rnd = random.Random(2)
    for text in [*texts(20, 4), *ODD, " ".join(rnd.choice("ab") for _ in range(500))]:
        at = [p for _, p in brute_sketch(text)]
        assert all(b - a <= K - S for a, b in zip([0, *at], at))


@pytest.mark.parametrize("n", [0, 1, 2])
def test_few_documents(make_docs, n):
    rows = [(i, f"text number {i} with words") for i in range(n)]
    found = syncmers.edited_neighbours(make_docs(rows)).collect()
    assert Counter((r.doc_id, r.edited) for r in found) == Counter((i, e[0]) for i, e in (brute(rows).items() if rows else ()))


def compared(spark, a, b):
    """Likeness of two texts."""
    frame = spark.createDataFrame([(a, b)], "a string, b string")
    frame = syncmers.with_sketch(syncmers.with_sketch(frame, F.col("a"), "x"), F.col("b"), "y")
    return syncmers.with_likeness(frame, "x", "y", "likeness").first().likeness


def words_of(rnd, n):
    return ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(3, 9))) for _ in range(n)]


def test_a_short_passage_in_long_texts_is_seen(spark):
    rnd = random.Random(11)
    words = [words_of(rnd, 20_000) for _ in range(2)]
    assert compared(spark, " ".join(words[0]), " ".join(words[1])) < 0.0005
    words[1][5000:5100] = words[0][12_000:12_100]
    assert 0.001 < compared(spark, " ".join(words[0]), " ".join(words[1])) < 0.01


def test_an_anchor_counts_at_each_position(spark):
    passage = " ".join(words_of(random.Random(5), 150))
    assert compared(spark, passage, passage) == 1
    assert 0.2 < compared(spark, passage, " ".join([passage] * 4)) < 0.3


def test_order_counts(spark):
    rnd = random.Random(19)
    for n in (2, 5, 10, 40):
        paragraphs = [" ".join(words_of(rnd, 60)) for _ in range(n)]
        assert compared(spark, "\n\n".join(paragraphs), "\n\n".join(paragraphs[::-1])) < 0.45


def test_insertions_in_order_keep_the_likeness(spark):
    rnd = random.Random(23)
    words = words_of(rnd, 900)
    longer = [*words[:200], *words_of(rnd, 20), *words[200:600], "one", *words[600:]]
    assert compared(spark, " ".join(words), " ".join(longer)) > 0.9


def test_an_insertion_into_text_without_blanks_moves_no_anchor(spark):
    rnd = random.Random(13)
    for letters in ("天地玄黃宇宙洪荒日月盈昃辰宿列張寒來暑往", "ABCDwxyz0189+/", "01", "กขคงจฉิีึื่้", "abcdefghijklmnopqrstuvwxyz"):
        text = "".join(rnd.choice(letters) for _ in range(3000))
        assert compared(spark, text, text[:5] + "*" + text[5:]) > 0.97


@pytest.mark.parametrize("n", [2, 9, 10, 30, 60])
def test_a_text_and_its_beginning_share_anchors_at_every_length(spark, n):
    words = [f"{'abcdefgh'[i % 8]}{i:03d}" for i in range(n)]
    assert compared(spark, " ".join(words), " ".join(words[:-1])) > 0.05
