"""Token ids of whole text columns: distinct words are encoded once a worker, the rest is numpy.

Both tokenizers split at white space and where letters, digits and other ASCII characters meet before they merge, so a text's ids are
those of its pieces in a row. A piece is a run of ASCII white space with what follows up to the next such place (without
the white space where the tokenizer drops it). No cut lies beside a character that is neither ASCII nor a letter of Latin-1, nor
between an apostrophe and a letter, which may belong together. Texts with other white space or with the strings of special tokens are encoded whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from twinline.llm.wordhash import _LOWER, _SPACE, hash_spans, word_spans

SLICE_BYTES = 8 << 20  # of text handled at once
CACHED_PIECES = 2_000_000  # of a worker; further pieces are encoded again
_JOINED = 2048  # pieces in one call's text
_SEP = "\x01"
_LEADS = " \n"  # a piece that begins with one of these begins a token
_ODD = r"[\x01\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

# Kinds of bytes between which a tokenizer always splits; 0: unknown.
_LETTER, _DIGIT, _OTHER = 1, 2, 3
_KIND = np.zeros(256, np.int8)
_KIND[0x21:0x7F] = _OTHER
_KIND[48:58] = _DIGIT
_KIND[65:91] = _KIND[97:123] = _LETTER
_APOSTROPHE = ord("'")
# The letters of Latin-1 in UTF-8: this byte, then one of these.
_LATIN = 0xC3
_LATIN_NEXT = np.zeros(256, bool)
_LATIN_NEXT[0x80:0xC0] = True
_LATIN_NEXT[[0x97, 0xB7]] = False  # the signs of multiplication and division


def byte_characters() -> dict[int, str]:
    """The character that byte-level vocabularies show for each byte: itself where it can be seen, else one from 256 up."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_SHOWN = byte_characters()


def kinds(raw: np.ndarray) -> np.ndarray:
    """What each byte is part of."""
    kind = _KIND[raw]
    two = np.flatnonzero((raw[:-1] == _LATIN) & _LATIN_NEXT[raw[1:]])
    kind[two] = kind[two + 1] = _LETTER
    return kind


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` cut between rows so that each part has about ``most`` bytes of text; a longer text is a part."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all runs ``starts[i] .. starts[i] + lengths[i]`` in a row."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


class Encoder:
    """A tokenizer file with a bounded cache of encoded pieces."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark spreads the work
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.keeps_space = bool(self._ids([" a"])[0] != self._ids(["a"])[0])
        if self.keeps_space:
            size = self.tok.get_vocab_size()
            names = [self.tok.id_to_token(i) or "" for i in range(size)]
            marks = [self.tok.id_to_token(self._ids([f"{c}a"])[0][0])[0] for c in _LEADS]
            self.begins = [np.array([x.startswith(m) for x in names]) for m in marks]
        else:
            (self.sep,) = self._ids([f" {_SEP} "])[0]
        self.lowers = self._ids(["Ab"]) == self._ids(["ab"])
        trial = ["the", "zqxj", "internationalization", "été", "Übergrößen", "ÀÉ", " the", " zqxj", " à"][: 9 if self.keeps_space else 6]
        #: Letters alone may skip all steps before the merging.
        self.direct = self._merge([x.encode() for x in trial]) == self._ids(trial)
        self.keys = np.empty(0, np.uint64)
        self.at = np.empty(0, np.int64)
        self.size = np.empty(0, np.int64)
        self.flat = np.empty(0, np.uint32)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _merge(self, letters: list[bytes]) -> list[list[int]]:
        """Ids of words of letters, with a space before them or not."""
        tokenize = self.tok.model.tokenize
        out = []
        for word in letters:
            if self.lowers and not word.isascii():
                word = word.decode("utf-8").lower().encode("utf-8")
            out.append([t.id for t in tokenize(word.decode("latin-1").translate(_SHOWN))])
        return out

    def _encode(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """Ids of all pieces, and each one's number of ids and place among them.

        Many pieces go in one text: single calls cost more than the merging.
        """
        lead = self._lead(raw, starts, ends)
        order, flat, sizes = [], [], []
        if self.direct:
            blank = (raw[starts] == 0x20) & self.keeps_space
            odd = np.concatenate(([0], np.cumsum(kinds(raw) != _LETTER, dtype=np.int32)))
            letters = np.flatnonzero((odd[ends] == odd[starts + blank]) & (ends > starts + blank))
            flat_raw = raw.tobytes()
            found = self._merge([flat_raw[a:b] for a, b in zip(starts[letters].tolist(), ends[letters].tolist())])
            order.append(letters)
            flat.append(np.fromiter(chain.from_iterable(found), np.uint32))
            sizes.append(np.array([len(ids) for ids in found], np.int64))
            lead[letters] = -2
        glued = np.concatenate([raw, np.frombuffer(f" {_SEP} ".encode(), np.uint8)])
        for kind in range(len(_LEADS) if self.keeps_space else 1):
            alike = np.flatnonzero(lead == kind)
            for a in range(0, len(alike), _JOINED):
                part = alike[a : a + _JOINED]
                at, size = starts[part], ends[part] - starts[part]
                if not self.keeps_space:  # the separator after each piece
                    at = np.column_stack([at, np.full(len(at), len(raw))]).ravel()
                    size = np.column_stack([size, np.full(len(size), len(glued) - len(raw))]).ravel()
                text = glued[ragged(at, size)].tobytes().decode("utf-8")
                ids = np.array(self._ids([text])[0], np.uint32)
                if self.keeps_space:
                    cuts = np.flatnonzero(self.begins[kind][ids])
                else:
                    ends_at = np.flatnonzero(ids == self.sep)
                    ids, cuts = np.delete(ids, ends_at), ends_at - np.arange(len(ends_at))
                    cuts = np.concatenate(([0], cuts[:-1]))
                if len(cuts) != len(part) or cuts[0]:
                    lead[part] = -1
                    continue
                order.append(part)
                flat.append(ids)
                sizes.append(np.diff(cuts, append=len(ids)))
        rest = np.flatnonzero(lead == -1)
        alone = self._ids([raw[starts[i] : ends[i]].tobytes().decode("utf-8") for i in rest])
        order.append(rest)
        flat.append(np.array([x for ids in alone for x in ids], np.uint32))
        sizes.append(np.array([len(ids) for ids in alone], np.int64))
        size, at = np.empty(len(starts), np.int64), np.empty(len(starts), np.int64)
        order, run = np.concatenate(order), np.concatenate(sizes)
        size[order], at[order] = run, np.cumsum(run) - run
        return np.concatenate(flat), size, at

    def _lead(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Which pieces can be encoded in one text, by what they begin with; -1: alone."""
        if not self.keeps_space:
            return np.zeros(len(starts), np.int8)
        kinds = np.full(256, -1, np.int8)
        kinds[list(_LEADS.encode())] = np.arange(len(_LEADS))
        second = raw[np.minimum(starts + 1, len(raw) - 1)]
        return np.where((ends - starts < 2) | _SPACE[second], -1, kinds[raw[starts]]).astype(np.int8)

    def _pieces(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        raw, offsets, starts, ends = word_spans(column)
        kind = kinds(raw)
        cut = np.zeros(len(raw), bool)
        cut[1:] = (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
        cut[1:] &= ~((raw[:-1] == _APOSTROPHE) & (kind[1:] == _LETTER))
        if self.keeps_space:
            # The pieces tile the texts: what follows a word begins the next piece.
            cut[ends[ends < len(raw)]] = True
            cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
            starts = np.flatnonzero(cut)
            ends = np.append(starts[1:], len(raw)) if len(starts) else starts
        else:
            cut[offsets[:-1][offsets[:-1] < len(raw)]] = False
            inner = np.flatnonzero(cut)
            starts, ends = np.sort(np.concatenate([starts, inner])), np.sort(np.concatenate([ends, inner]))
        return _LOWER[raw] if self.lowers else raw, starts, ends, np.diff(np.searchsorted(starts, offsets))

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row (uint32) and their number for each text; a null is an empty text."""
        column = column.fill_null("")
        odd = pc.match_substring_regex(column, _ODD)
        for content in self.special:
            odd = pc.or_(odd, pc.match_substring(column, content, ignore_case=True))
        whole = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if len(whole):
            texts = column.take(pa.array(whole)).to_pylist()
            column = pc.if_else(odd, pa.scalar("", column.type), column)
        ids, counts = self._by_pieces(column)
        if len(whole):
            cut = np.split(ids, np.cumsum(counts)[:-1])
            for i, x in zip(whole, self._ids(texts)):
                cut[i] = np.array(x, np.uint32)
                counts[i] = len(x)
            ids = np.concatenate(cut)
        return ids, counts

    def _by_pieces(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        raw, starts, ends, counts = self._pieces(column)
        if not len(starts):
            return np.empty(0, np.uint32), np.zeros(len(column), np.int64)
        inverse, uniq = pd.factorize(hash_spans(raw, starts, ends))
        first = np.empty(len(uniq), np.int64)
        first[inverse[::-1]] = np.arange(len(inverse))[::-1]
        where = np.searchsorted(self.keys, uniq)
        known = np.zeros(len(uniq), bool)
        inside = where < len(self.keys)
        known[inside] = self.keys[where[inside]] == uniq[inside]
        at, size = np.empty(len(uniq), np.int64), np.empty(len(uniq), np.int64)
        at[known], size[known] = self.at[where[known]], self.size[where[known]]
        new, flat = np.flatnonzero(~known), self.flat
        if len(new):
            new = new[np.argsort(uniq[new])]
            got, size[new], place = self._encode(raw, starts[first[new]], ends[first[new]])
            at[new] = len(flat) + place
            flat = np.concatenate([flat, got])
            if len(self.keys) + len(new) <= CACHED_PIECES:
                self.keys = np.insert(self.keys, where[new], uniq[new])
                self.at = np.insert(self.at, where[new], at[new])
                self.size = np.insert(self.size, where[new], size[new])
                self.flat = flat
        lengths = size[inverse]
        ids = flat[ragged(at[inverse], lengths)]
        ends_of = np.concatenate(([0], np.cumsum(lengths)))[np.concatenate(([0], np.cumsum(counts)))]
        return ids, np.diff(ends_of)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode_whole(column: pa.Array, path: str, end: int) -> tuple[np.ndarray, np.ndarray]:
    """:class:`Encoder` with the id ``end`` after each text."""
    ids, counts = encoder(path)(column)
    out = np.insert(ids, np.cumsum(counts), np.uint32(end))
    return out, counts + 1
