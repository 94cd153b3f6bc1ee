"""SentencePiece BPE with seeded merge-dropout, and its decoding.

Each candidate merge has a keyed hash of the seed, the document's id, the unit it lies in, that unit's place in the text, its
place in the unit and its two symbols; a share of the hashes equal to the dropout means "never". So every occurrence of a
word is segmented on its own, a seed gives the same segmentation every time and everywhere, another seed another one, and
every segmentation decodes to the text it came from.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame, types as T

from lakegauge.llm import bpe
from lakegauge.llm.common import id_hashes, list_array, map_text, mix, segments, text_hashes

DROPOUT, SEED = 0.1, 1
_SPACE = "▁"
_UNIT = re.compile(r" +[^ ]*")
_BLOCK = 6 << 20
_SYMBOLS = 1 << 19  # symbols, and candidate merges, looked at in one go


def _pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (left.astype(np.uint64) << np.uint64(20)) ^ right.astype(np.uint64)


def _skips(place: np.ndarray, pair: np.ndarray, limit: np.uint64) -> np.ndarray:
    """Whether a candidate is skipped; `place` is the occurrence's hash and the character where the candidate begins."""
    return mix(mix(place) ^ pair) <= limit


def _hits(own: np.ndarray, word: np.ndarray, met_at: np.ndarray, start: np.ndarray, pair: np.ndarray, limit: np.uint64):
    """For occurrences, what each skips of the candidates that its word met: flags, places of the candidates, how many."""
    some = np.diff(met_at)[word]
    which = np.repeat(met_at[:-1][word], some) + segments(some)
    return _skips(np.repeat(own, some) + start[which], pair[which], limit), which, some


def _chunks(work: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about _SYMBOLS of work."""
    step = np.cumsum(work) // _SYMBOLS
    edges = np.flatnonzero(np.concatenate([[True], step[1:] != step[:-1], [True]])) if len(work) else np.zeros(1, np.int64)
    return zip(edges[:-1].tolist(), edges[1:].tolist())


class Pieces:
    """Vocabulary and merges of a model file. A text is split into units: a run of spaces and what follows it.

    No piece holds a space behind another character, so no merge crosses units. As in the library, a space is put
    before a text that is not empty. Other than there, the sign that stands for a space is spelled in bytes where a text
    holds it, which keeps decoding lossless.
    """

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(size)]
        byte = {int(names[i][3:-1], 16): i for i in range(size) if model.is_byte(i)}
        known = {names[i]: i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
        scores = sorted({model.get_score(i) for i in known.values()}, reverse=True)
        place = {s: r for r, s in enumerate(scores)}
        merges = [(known[n[:c]], known[n[c:]], place[model.get_score(i)], i) for n, i in known.items()
                  for c in range(1, len(n)) if n[:c] in known and n[c:] in known]
        self.pairs = bpe.Pairs(*zip(*merges))
        self.letter = np.full(0x110000, -1, np.int64)
        for n, i in known.items():
            if len(n) == 1 and n != _SPACE:
                self.letter[ord(n)] = i
        self.letter[ord(" ")] = known[_SPACE]
        self.byte = np.array([byte[b] for b in range(256)], np.int64)
        inverse = {i: n for n, i in known.items()}
        data = [inverse[i].replace(_SPACE, " ").encode() if i in inverse else b"" for i in range(size)]
        for b, i in byte.items():
            data[i] = bytes([b])
        self.said = np.frombuffer(b"".join(data), np.uint8)
        self.said_at = np.concatenate([[0], np.cumsum([len(d) for d in data])])

    def symbols(self, units: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """First symbols of the units: one per character, or its bytes where the vocabulary lacks it."""
        units = pa.array(units, pa.string())
        points = np.frombuffer("".join(units.to_pylist()).encode("utf-32-le"), np.uint32)
        at = np.concatenate([[0], np.cumsum(pc.utf8_length(units).to_numpy(zero_copy_only=False), dtype=np.int64)])
        out = self.letter[points]
        strange = np.flatnonzero(out < 0)
        if not len(strange):
            return out, at
        spelled = [self.byte[np.frombuffer(chr(p).encode(), np.uint8)] for p in points[strange].tolist()]
        width = np.ones(len(points), np.int64)
        width[strange] = [len(s) for s in spelled]
        places = np.concatenate([[0], np.cumsum(width)])
        wide = np.repeat(out, width)
        wide[np.repeat(places[strange], width[strange]) + np.concatenate([np.arange(len(s)) for s in spelled])] = np.concatenate(spelled)
        return wide, places[at]

    def encode(self, texts: pa.Array, key: np.ndarray, seed: int, dropout: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other and where each text's begin. Texts with equal keys and words are segmented alike."""
        lists = pc.split_pattern(texts, " ")
        at = lists.offsets.to_numpy().astype(np.int64)
        flat, counts = lists.flatten(), np.diff(at)
        empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        runs = pc.or_(pc.match_substring(texts, "  "), pc.starts_with(texts, " ")).to_numpy(zero_copy_only=False)
        odd = np.flatnonzero(empty | runs)
        if len(odd):
            keep = np.ones(len(flat), bool)
            extra, where = [], []
            for i in odd.tolist():
                keep[at[i]:at[i + 1]] = False
                own = [] if empty[i] else [u[1:] for u in _UNIT.findall(" " + texts[i].as_py())]
                counts[i] = len(own)
                extra += own
                where += [i] * len(own)
            owner = np.concatenate([np.repeat(np.arange(len(texts)), np.diff(at))[keep], np.array(where, np.int64)])
            flat = pa.concat_arrays([flat.filter(pa.array(keep)), pa.array(extra, flat.type)]).take(pa.array(np.argsort(owner, kind="stable")))
        at = np.concatenate([[0], np.cumsum(counts)])
        coded = flat.dictionary_encode()
        codes, units = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
        symbols, starts = self.symbols(pc.binary_join_element_wise("", units, " "))
        if dropout <= 0:
            ids, ids_at = bpe.merge(symbols, starts, self.pairs)
            out, out_at = bpe.gather(ids, ids_at, codes)
            return out, out_at[at]
        limit = np.uint64(min(1 << 64, int(dropout * (1 << 64))) - 1)
        unit_keys = text_hashes(units)
        streams = mix(np.asarray(key).astype(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64)))
        doc, place = np.repeat(np.arange(len(counts)), counts), segments(counts).astype(np.uint64)
        own = mix(unit_keys[codes] ^ mix(streams[doc] + place))
        ids, ids_at, met_at, start, pair = self._met(symbols, starts, lambda word, start, pair: np.zeros(len(word), bool))
        # an occurrence that skips none of the candidates its unit meets when none is skipped ends as the unit does
        anew, group = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for lo, hi in _chunks(np.maximum(np.diff(met_at), np.diff(starts))[codes]):
            hit, which, some = _hits(own[lo:hi], codes[lo:hi], met_at, start, pair, limit)
            hit = np.flatnonzero(hit)
            owner = np.searchsorted(np.cumsum(some), hit, side="right")
            heads = np.flatnonzero(np.diff(owner, prepend=-1))
            anew.append(lo + owner[heads])
            # what an occurrence skips, as one number
            group.append(np.add.reduceat(mix(pair[which[hit]] + start[which[hit]]), heads) if len(heads) else group[0])
        index, made, made_at, total = codes.copy(), [ids], [ids_at], len(units)
        anew = np.concatenate(anew)
        group = mix(np.concatenate(group) + unit_keys[codes[anew]])
        order = np.argsort(group)
        anew, group = anew[order], group[order]
        for lo, hi in _chunks(np.diff(starts)[codes[anew]]):
            part, same = anew[lo:hi], group[lo:hi]
            # of those that skip the same of them, one is merged; the others end as it does if they agree with it on all that it met
            first = np.concatenate([[True], (same[1:] != same[:-1]) | (codes[part[1:]] != codes[part[:-1]])])
            for last in (False, True):
                if last:
                    first = np.ones(len(part), bool)
                lead = part[first]
                fresh, fresh_at, met_at, start, pair = self._met(
                    *bpe.gather(symbols, starts, codes[lead]), lambda word, start, pair, lead=lead: _skips(own[lead[word]] + start, pair, limit))
                made.append(fresh)
                made_at.append(made_at[-1][-1] + fresh_at[1:])
                leader = np.cumsum(first) - 1
                index[part] = total + leader
                total += len(lead)
                if last:
                    break
                theirs, which, some = _hits(own[part], leader, met_at, start, pair, limit)
                leads = _skips(np.repeat(own[lead], np.diff(met_at)) + start, pair, limit)
                other = np.flatnonzero(theirs != leads[which])
                part = part[np.unique(np.searchsorted(np.cumsum(some), other, side="right"))]
                if not len(part):
                    break
        out, out_at = bpe.gather(np.concatenate(made), np.concatenate(made_at), index)
        return out, out_at[at]

    def _met(self, symbols: np.ndarray, starts: np.ndarray, rule) -> tuple[np.ndarray, ...]:
        """What `bpe.merge` returns, and the candidates that each word met: where its own begin, their starts and pairs."""
        met: list[tuple[np.ndarray, ...]] = []

        def meet(word, start, left, right):
            met.append((word, start.astype(np.uint64), _pair(left, right)))
            return rule(*met[-1])

        ids, ids_at = bpe.merge(symbols, starts, self.pairs, meet)
        if not met:
            return ids, ids_at, np.zeros(len(starts), np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        owner, start, pair = (np.concatenate(v) for v in zip(*met))
        order = np.argsort(owner, kind="stable")
        return ids, ids_at, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(starts) - 1))]), start[order], pair[order]

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[bytes]:
        """UTF-8 of each id sequence, without the space that encoding puts before it."""
        data, data_at = bpe.gather(self.said, self.said_at, ids)
        raw = data.tobytes()
        return [raw[a + 1:b] if b > a else b"" for a, b in zip(data_at[at[:-1]].tolist(), data_at[at[1:]].tolist())]


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _default() -> str:
    return public_tokenizers.path("piece_bpe_32k.model")


def encoded(docs: DataFrame, keep: list[str], id: str = "doc_id", text: str = "text", path: str | None = None, seed: int = SEED,
            dropout: float = DROPOUT) -> DataFrame:
    """The kept columns and `ids`. Each id has its own segmentations.

    Null and empty texts have no ids; equal ids and texts have equal results. Texts are encoded whole.
    """
    path = path or _default()

    def make():
        model = pieces(path)

        def run(texts: pa.Array, part: pa.RecordBatch) -> list:
            ids, at = model.encode(texts, id_hashes(part.column(keep.index(id))), seed, dropout)
            return [list_array(np.split(ids, at[1:-1]) if len(at) > 1 else [])]
        return run

    return map_text(docs, keep, text, [T.StructField("ids", T.ArrayType(T.LongType()))], make, _BLOCK)


def round_trip(docs: DataFrame, keep: list[str], id: str = "doc_id", text: str = "text", path: str | None = None, seed: int = SEED,
               dropout: float = DROPOUT) -> DataFrame:
    """The kept columns, n_tokens, ids_crc32 (little-endian unsigned 32-bit ids), decoded_sha256 and lossless.

    Encodes and decodes in one pass, so that ids need not be moved; otherwise as `encoded`.
    """
    path = path or _default()
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()),
              T.StructField("decoded_sha256", T.StringType()), T.StructField("lossless", T.BooleanType())]

    def make():
        model = pieces(path)

        def run(texts: pa.Array, part: pa.RecordBatch) -> list:
            ids, at = model.encode(texts, id_hashes(part.column(keep.index(id))), seed, dropout)
            said = model.decode(ids, at)
            small = ids.astype("<u4")
            crc = [zlib.crc32(small[a:b].tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            same = [t.as_buffer().to_pybytes() == s for t, s in zip(texts, said)]
            return [pa.array(np.diff(at)), pa.array(crc, pa.int64()), pa.array([hashlib.sha256(s).hexdigest() for s in said], pa.string()),
                    pa.array(same, pa.bool_())]
        return run

    return map_text(docs, keep, text, fields, make, _BLOCK)
