"""Token ids of whole columns of text, as the tokenizers library gives them.

A tokenizer that drops white space and splits the rest by one pattern gives a
text the ids of its words, one after the other. Words repeat, so each distinct
word of a batch is encoded once and the ids are gathered by position; that is
the same result at a fraction of the work. Words over the range of characters
for which lower case and composition are settled go straight to the model of
the library, all others through its whole encode call. Tokenizers of another
build encode whole texts.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# words (and pieces of words) kept between batches of one worker; a full cache starts anew
CACHE_WORDS = 500_000
# below this code point no character is changed by NFC, and all but one have a settled lower case
SETTLED = "ƀ"
DOTTED_I = "İ"


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies use for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    letters = {b: chr(b) for b in shown}
    return [letters[b] if b in letters else chr(next(rest)) for b in range(256)]


class Encoder:
    """Ids of texts from one tokenizer file, without added special tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            pattern = self._word_pattern(json.load(file))
        self.words: dict[str, bytes] | None = {} if pattern else None
        self.pieces: dict[str, bytes] = {}
        if pattern:
            import regex

            self.find = regex.compile(pattern).findall
            letters = byte_letters()
            self.framed = [i.to_bytes(4, "little") for i in range(self.library.get_vocab_size())]
            self.spelled = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(0x80, ord(SETTLED))}

    @staticmethod
    def _word_pattern(spec: dict) -> str | None:
        """The pattern of words, if white space between words changes nothing else."""
        normal = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        before = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if normal != ["NFC", "Replace", "Lowercase"] or [p["type"] for p in before] != ["Split", "ByteLevel"]:
            return None
        split, level = before
        settled = split["behavior"] == "Removed" and split["invert"] and not level["add_prefix_space"] and not level["use_regex"]
        added = any(t["lstrip"] or t["rstrip"] or t["normalized"] or any(c.isspace() for c in t["content"]) for t in spec["added_tokens"])
        return split["pattern"]["Regex"] if settled and not added else None

    def _piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            if len(self.pieces) >= CACHE_WORDS:
                self.pieces.clear()
            letters = piece if piece.isascii() else piece.translate(self.spelled)
            found = b"".join([self.framed[t.id] for t in self.library.model.tokenize(letters)])
            self.pieces[piece] = found
        return found

    def _new_words(self, words: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(words)
        hard = []
        piece = self._piece
        for i, word in enumerate(words):
            if word.isascii() and word.isalpha():
                out[i] = piece(word.lower())
            elif word.isprintable() and "<|" not in word and (word.isascii() or max(word) < SETTLED and DOTTED_I not in word and "\xa0" not in word):
                out[i] = b"".join(map(piece, self.find(word.lower())))
            else:
                hard.append(i)
        for i, found in zip(hard, self.library.encode_batch_fast([words[i] for i in hard], add_special_tokens=False)):
            out[i] = np.array(found.ids, "<u4").tobytes()
        return out

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and where each text's ids begin (one more entry at the end)."""
        if self.words is None:
            found = [e.ids for e in self.library.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            starts = np.concatenate([[0], np.cumsum([len(f) for f in found], dtype=np.int64)])
            return np.array([i for f in found for i in f], "<u4"), starts
        split = pc.ascii_split_whitespace(texts)
        ends = split.offsets.to_numpy().astype(np.int64)
        coded = split.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
        ends = ends - ends[0]
        words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        known = list(map(self.words.get, words))
        missing = [i for i, k in enumerate(known) if k is None]
        if len(self.words) + len(missing) > CACHE_WORDS:
            self.words.clear()
        for i, ids in zip(missing, self._new_words([words[i] for i in missing])):
            known[i] = ids
            if len(self.words) < CACHE_WORDS:
                self.words[words[i]] = ids
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        pool = np.frombuffer(b"".join(known), "<u4")
        first = np.cumsum(sizes) - sizes
        lengths = sizes[codes]
        at = np.concatenate([[0], np.cumsum(lengths)])
        take = np.arange(at[-1]) + np.repeat(first[codes] - at[:-1], lengths)
        return pool[take], at[ends]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each file and worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
