"""Token ids of a lower-case word-end BPE file, computed once per distinct word of a block of texts."""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from tokenizers import Tokenizer

from lakegauge.llm import bpe
from lakegauge.llm.common import Words

_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_LETTER, _DIGIT, _OTHER, _JUDGED = range(4)
_LEAD = 0xC3  # of the letters U+00C0 to U+00FF in UTF-8


def _kinds() -> np.ndarray:
    """What each byte is by itself; words with a byte that stays _JUDGED are taken apart one by one."""
    kinds = np.full(256, _JUDGED, np.uint8)
    kinds[33:127] = _OTHER
    kinds[48:58] = _DIGIT
    kinds[65:91] = kinds[97:123] = _LETTER
    kinds[ord("'")] = _JUDGED
    return kinds


_KINDS = _kinds()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _raw(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings and where each begins."""
    if not len(strings):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = strings.buffers()
    at = np.frombuffer(at, np.int32)[strings.offset:strings.offset + len(strings) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]], at - at[0]


def _parted(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Which words must be judged one by one; the pre-tokens of the others one after the other, and where each word's begin.

    All words of ASCII and of U+00C0 to U+00FF are taken apart at once, by their bytes, but those with an apostrophe, a
    control sign or what may be a mark. Such letters are normalized already and none changes its length in lower case.
    """
    kinds, low = _KINDS[raw], _LOWER[raw]
    lead = np.flatnonzero(raw[:-1] == _LEAD)
    tail = raw[lead + 1]
    letter = (tail >= 0x80) & (tail < 0xC0) & (tail != 0x97) & (tail != 0xB7)  # no times sign, no division sign
    lead, tail = lead[letter], tail[letter]
    kinds[lead] = kinds[lead + 1] = _LETTER
    low[lead[tail < 0x9F] + 1] += 32
    kinds[:-1][(raw[:-1] == ord("<")) & (raw[1:] == ord("|"))] = _JUDGED
    heads = np.ones(len(raw), bool)
    heads[1:] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == _DIGIT)
    heads[at[:-1]] = True
    size = np.diff(at)
    judged = np.maximum.reduceat(kinds, at[:-1]) == _JUDGED if len(size) else np.zeros(0, bool)
    if judged.any():
        kept = np.repeat(~judged, size)
        heads, low, size = heads[kept], low[kept], size[~judged]
    first = np.flatnonzero(heads)
    bounds = np.append(first, len(low)).astype(np.int32)
    parts = pa.StringArray.from_buffers(len(first), pa.py_buffer(bounds), pa.py_buffer(low))
    return judged, parts, np.searchsorted(first, np.concatenate([[0], np.cumsum(size)]))


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


class WordTokens:
    """Encodes by its own merging where a word consists of letters and ASCII, else by the library itself."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.pairs = bpe.Pairs([vocab[a] for a, _ in merges], [vocab[b] for _, b in merges], range(len(merges)),
                               [vocab[a + b] for a, b in merges])
        letters = _byte_letters()
        self.inner, self.last = (np.array([vocab[c + e] for c in letters], np.int64) for e in ("", end))
        self.library = Tokenizer.from_file(path)
        self.marks = [t.content for t in self.library.get_added_tokens_decoder().values()]

    def _parts(self, word: str) -> list[str] | None:
        """Pre-tokens of a word, or None if the library must judge."""
        if word.isascii():
            if not word.isprintable() or "<|" in word and any(m in word for m in self.marks):
                return None
            low = word.lower()
            return [low] if low.isalpha() else _PARTS.findall(low)
        if not unicodedata.is_normalized("NFC", word) or "Σ" in word:
            return None
        low = word.lower()
        if len(low) != len(word) or "<|" in low:
            return None
        if low.isalpha():
            return [low] if word.isalpha() else None
        return _PARTS.findall(low) if all(c.isalpha() or " " < c < "\x7f" for c in word) else None

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's begin."""
        words = Words(texts)
        judged, parts, word_at = _parted(*_raw(words.vocabulary))
        alone, count, own, strange = [], [], [], []
        for i, word in zip(np.flatnonzero(judged).tolist(), words.vocabulary.filter(pa.array(judged)).to_pylist()):
            found = self._parts(word)
            if found is None:
                strange.append((i, word))
            else:
                alone.append(i)
                count.append(len(found))
                own += found
        if own:
            parts = pa.concat_arrays([parts, pa.array(own, pa.string())])
        word_at = np.concatenate([word_at, word_at[-1] + np.cumsum(count, dtype=np.int64)])
        coded = parts.dictionary_encode()
        raw, at = _raw(coded.dictionary)
        symbols = self.inner[raw]
        ends = at[1:] - 1
        symbols[ends] = self.last[raw[ends]]
        ids, ids_at = bpe.merge(symbols, at, self.pairs)
        by_part, part_at = bpe.gather(ids, ids_at, coded.indices.to_numpy(zero_copy_only=False))
        by_word, word_at = by_part, part_at[word_at]
        if strange:
            extra = [np.array(e.ids, np.int64) for e in self.library.encode_batch([w for _, w in strange], add_special_tokens=False)]
            by_word = np.concatenate([by_part, *extra])
            word_at = np.concatenate([word_at, word_at[-1] + np.cumsum([len(e) for e in extra])])
        # rows stand in three runs: words taken apart at once, one by one, and by the library
        place = np.empty(len(words.vocabulary), np.int64)
        place[np.concatenate([np.flatnonzero(~judged), np.array(alone, np.int64), np.array([i for i, _ in strange], np.int64)])] = np.arange(len(place))
        out, out_at = bpe.gather(by_word, word_at, place[words.codes])
        return out, out_at[words.at]


@lru_cache(maxsize=2)
def word_tokens(path: str) -> WordTokens:
    return WordTokens(path)
