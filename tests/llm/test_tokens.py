import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabloom.llm import packing, records, token_counts
from tabloom.llm.encoding import Encoder
from tests.llm.conftest import odd_texts

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORD_LIBRARY, BYTE_LIBRARY = Tokenizer.from_file(WORDS), Tokenizer.from_file(BYTES)
ENCODER, COUNTER = Encoder(WORDS), token_counts.Counter(BYTES)


def ids_of(text):
    return WORD_LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_library():
    texts = ["", " ", *odd_texts(3000)]
    flat, ends = ENCODER.column(pa.array(texts, pa.large_string()))
    assert [flat[a:b].tolist() for a, b in zip(ends, ends[1:])] == [ids_of(t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs", "Cn"])), max_size=5))
def test_ids_equal_the_library_on_any_text(texts):
    flat, ends = ENCODER.column(pa.array(texts, pa.large_string()))
    assert [flat[a:b].tolist() for a, b in zip(ends, ends[1:])] == [ids_of(t) for t in texts]


def test_other_tokenizers_encode_whole_texts():
    texts = odd_texts(50)
    flat, ends = Encoder(BYTES).column(pa.array(texts, pa.large_string()))
    assert [flat[a:b].tolist() for a, b in zip(ends, ends[1:])] == [BYTE_LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


def test_counts_equal_the_library():
    texts = ["", " ", "a" * 5000, "ab" * 3000, *odd_texts(3000)]
    assert COUNTER.column(pa.array(texts, pa.large_string())).tolist() == [len(BYTE_LIBRARY.encode(t, add_special_tokens=False).ids) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs", "Cn"])), max_size=5))
def test_counts_equal_the_library_on_any_text(texts):
    assert COUNTER.column(pa.array(texts, pa.large_string())).tolist() == [len(BYTE_LIBRARY.encode(t, add_special_tokens=False).ids) for t in texts]


def test_count_tokens_keeps_rows_and_replaces_columns(make_docs):
    docs = make_docs([(1, "Hello there, you"), (1, "Hello there, you"), (None, None), (4, "x" * 3000)]).withColumn("n_tokens", F.lit("old"))
    rows = token_counts.count_tokens(docs, BYTES, limit=3).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()
    assert Counter(map(tuple, rows)) == Counter(
        [(1, 16, 4, True)] * 2 + [(None, 0, 0, False), (4, 3000, len(BYTE_LIBRARY.encode("x" * 3000).ids), True)]
    )
    assert token_counts.count_tokens(docs.limit(0), BYTES).count() == 0


def brute_packs(lengths, size):
    """The same rule on single packs: the shortest takes the piece if it fits."""
    packs = []
    for length in sorted(lengths, reverse=True):
        shortest = min(packs, key=sum, default=None)
        if shortest is not None and sum(shortest) + length <= size:
            shortest.append(length)
        else:
            packs.append([length])
    return packs


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_patterns_fill_as_many_packs_as_single_packs_do(lengths):
    patterns = packing.pattern_counts(Counter(lengths), 20)
    packs = Counter()
    for n, runs in patterns:
        packs[sum(length * copies for length, copies in runs)] += n
    assert packs == Counter(map(sum, brute_packs(lengths, 20)))


def test_patterns_refuse_lengths_that_never_fit():
    with pytest.raises(ValueError):
        packing.pattern_counts({0: 1}, 8)


def test_pack_places_every_id_once(make_docs):
    texts = [(i, t) for i, t in enumerate(odd_texts(300))] + [(500, "word and " * 40), (500, "word and " * 40), (None, None), (501, "a b c d " * 16)]
    rows = packing.pack(make_docs(texts).withColumn("length", F.lit("x")), WORDS, end_id=1, size=32).collect()
    whole = Counter((i, tuple([*ids_of(t), 1])) for i, t in texts)
    by_sequence, found = {}, Counter()
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length <= 32 and zlib.crc32(bytes(r.ids)) == r.ids_crc32
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        found[r.doc_id, r.start, tuple(ids)] += 1
    expected = Counter()
    for (i, ids), n in whole.items():
        for start in range(0, len(ids), 32):
            expected[i, start, ids[start : start + 32]] += n
    assert found == expected
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 32
    assert len(by_sequence) == len(brute_packs([r.length for r in rows], 32))


def test_pack_of_an_empty_table(make_docs):
    assert packing.pack(make_docs([]), WORDS).count() == 0


def test_records_round_trip(make_docs, tmp_path):
    texts = [(i * 7 % 101, t) for i, t in enumerate(odd_texts(101))] + [(None, "no id"), (3, "again"), (3, "again"), (200, None), (201, "long " * 5000)]
    folder, shards = records.write_records(make_docs(texts), WORDS, str(tmp_path / "out"), end_id=2)
    rows = records.read_records(folder, shards).orderBy("start").collect()
    assert Counter((r.doc_id, bytes(r.ids)) for r in rows) == Counter((i, np.array([*ids_of(t), 2], "<u4").tobytes()) for i, t in texts)
    at, last = 0, None
    for r in rows:
        assert r.start == at and (last is None or r.doc_id >= last)
        at, last = at + r.n_tokens, r.doc_id
    name = shards.orderBy("shard").first().name
    first = records.read_at(folder, name, [1, 0])
    assert [f[0] for f in first] == [rows[1].doc_id, rows[0].doc_id]
    assert first[1][1].astype("<u4").tobytes() == bytes(rows[0].ids)


def test_damage_is_found(make_docs, tmp_path):
    folder, shards = records.write_records(make_docs([(1, "one two three")]), WORDS, str(tmp_path / "out"))
    file = next((tmp_path / "out").glob("*.rec"))
    file = [f for f in (tmp_path / "out").glob("*.rec") if f.stat().st_size > 8][0]
    data = bytearray(file.read_bytes())
    data[-6] ^= 1
    file.write_bytes(data)
    with pytest.raises(Exception, match="damaged record"):
        records.read_records(folder, shards).collect()


def test_records_of_an_empty_table(make_docs, tmp_path):
    folder, shards = records.write_records(make_docs([]), WORDS, str(tmp_path / "out"))
    assert shards.count() == 0 and records.read_records(folder, shards).count() == 0
