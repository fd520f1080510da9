"""Token counts of whole texts by byte-pair merging, without identifiers.

A text is cut where the tokenizer's pattern cuts it; in each piece the adjacent
pair of the lowest rank is merged until none is left. Pairs wait in a heap,
symbols form a linked list, and the count is the number of bytes less the
number of merges. Pieces and words repeat, so their counts are kept in caches
of bounded size for as long as the worker lives.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import STEP_BYTES, col, text_of
from tabloom.llm.encoding import byte_letters

CACHE_WORDS = 500_000
# The white space and the word pattern of byte-level vocabularies of this kind.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


class Counter:
    """Counts tokens of texts for a byte-level pair vocabulary file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        before = spec["pre_tokenizer"]
        if spec["normalizer"] or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"]:
            raise ValueError("only byte-level vocabularies with the plain word pattern are counted here")
        self.find = regex.compile(WORDS).findall
        self.run = regex.compile(rf"[{SPACE}]{{2}}").search
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        vocab, letters = spec["model"]["vocab"], byte_letters()
        self.first = [vocab[c] for c in letters]
        # a pair of symbols -> its rank and the symbol it becomes, in one number
        self.pairs: dict[int, int] = {}
        for rank, (a, b) in enumerate(spec["model"]["merges"]):
            self.pairs[vocab[a] << 20 | vocab[b]] = rank << 20 | vocab[a + b]
        self.pieces: dict[str, int] = {}
        self.words: dict[str, int] = {}

    def merged(self, piece: bytes) -> int:
        """Symbols left of one piece: pop the lowest pair, merge, until the heap is empty."""
        symbols = [self.first[b] for b in piece]
        count = len(symbols)
        if count < 2:
            return count
        pairs = self.pairs
        heap = []
        for i in range(count - 1):
            known = pairs.get(symbols[i] << 20 | symbols[i + 1])
            if known is not None:
                heap.append(((known >> 20) << 40 | i, known))
        heapq.heapify(heap)
        end = count
        after = list(range(1, end + 1))
        ahead = list(range(-1, end - 1))
        while heap:
            place, known = heapq.heappop(heap)
            i = place & 0xFFFFFFFFFF
            j = after[i]
            if symbols[i] < 0 or j >= end or pairs.get(symbols[i] << 20 | symbols[j]) != known:
                continue  # one of the two has merged with another meanwhile
            count -= 1
            symbols[i] = known & 0xFFFFF
            symbols[j] = -1
            after[i] = k = after[j]
            if k < end:
                ahead[k] = i
                found = pairs.get(symbols[i] << 20 | symbols[k])
                if found is not None:
                    heapq.heappush(heap, ((found >> 20) << 40 | i, found))
            h = ahead[i]
            if h >= 0:
                found = pairs.get(symbols[h] << 20 | symbols[i])
                if found is not None:
                    heapq.heappush(heap, ((found >> 20) << 40 | h, found))
        return count

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings."""
        total = 0
        for piece in self.find(text):
            known = self.pieces.get(piece)
            if known is None:
                if len(self.pieces) >= CACHE_WORDS:
                    self.pieces.clear()
                known = self.pieces[piece] = self.merged(piece.encode())
            total += known
        return total

    def text(self, text: str) -> int:
        """Tokens of a text; a special string in it is one token."""
        if not self.special or not self.special.search(text):
            return self.plain(text)
        parts = self.special.split(text)
        return sum(map(self.plain, parts)) + len(parts) - 1

    def column(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text.

        Where white space stands alone, every blank begins a piece, so such texts
        are counted by their blank-separated words, each distinct one once.
        """
        listed = texts.to_pylist()
        simple = np.array([not self.run(t) and not (self.special and self.special.search(t)) for t in listed], bool)
        out = np.zeros(len(listed), np.int64)
        for i in np.flatnonzero(~simple):
            out[i] = self.text(listed[i])
        if not simple.any():
            return out
        split = pc.split_pattern(texts.filter(pa.array(simple)), " ")
        ends = split.offsets.to_numpy().astype(np.int64)
        coded = split.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
        ends = ends - ends[0]
        words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        sizes = np.empty(len(words), np.int64)
        for i, word in enumerate(words):
            known = self.words.get(word)
            if known is None:
                known = self.words[word] = self.plain(" " + word)
            sizes[i] = known
        sums = np.concatenate([[0], np.cumsum(sizes[codes])])
        begun = codes[ends[:-1]]  # the first word has no blank before it
        out[simple] = sums[ends[1:]] - sums[ends[:-1]] - sizes[begun] + [self.plain(words[c]) for c in begun]
        return out


_counters: dict[str, Counter] = {}


def token_count(text: Column, tokenizer: str) -> Column:
    """Number of tokens of a text column, null for null."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if tokenizer not in _counters:
            _counters[tokenizer] = Counter(tokenizer)
        counter = _counters[tokenizer]
        for batch in batches:
            array = pa.array(batch, pa.large_string(), from_pandas=True)
            filled = pc.fill_null(array, "")
            sizes = pc.cumulative_sum(pc.binary_length(filled)).to_numpy()
            out, first = np.zeros(len(filled), np.int64), 0
            while first < len(filled):
                base = sizes[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(sizes, base + STEP_BYTES, "right")))
                out[first:last] = counter.column(filled.slice(first, last - first))
                first = last
            yield pd.Series(out).where(pd.Series(array.is_valid().to_numpy(zero_copy_only=False)))

    return count(text)


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024, text_col: str = "text") -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit (more than ``limit`` tokens).

    A null text counts as empty: no bytes, no tokens. Special strings inside a
    text are one token each, as the library has it by default. Columns of the
    input that have one of the three names are replaced. Rows are kept as they
    are, repeated ones and null ids included; an empty table stays empty.
    """
    text = text_of(text_col)
    counted = docs.withColumns({"n_bytes": F.octet_length(text).cast("long"), "n_tokens": token_count(text, tokenizer)})
    return counted.withColumn("over_limit", col("n_tokens") > F.lit(limit))
