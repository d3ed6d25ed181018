"""Encoding of whole columns of text by white-space word, shared by the token operators.

Valid for tokenizers whose pieces never cross white space, as with a pre-tokenizer that drops it. The words of a step
are cut, hashed and grouped in numpy; only its different words meet Python, and only those not met before are encoded.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import numpy as np

from cairn.llm import base

#: Words of Latin letters: normal forms leave them alone and each capital has one small letter. No special token fits.
_LATIN = [c for c in range(0x21, 0x180) if c not in (0x130, 0x85, 0xA0)]
_kind = lambda k: "".join(re.escape(chr(c)) for c in _LATIN if unicodedata.category(chr(c))[0] == k)
PLAIN = re.compile("[\x21-\x84\x86-\x9f\xa1-\u012f\u0131-\u017f]*")
PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_kind('L')}]+|[{_kind('N')}]|[^{_kind('L')}{_kind('N')}]+")


def plain_pieces(word: str) -> list[str] | None:
    """The lower-case pieces of a plain word; None of a word that needs the general way."""
    if word.isascii() and word.isalpha():
        return [word.lower()]
    if PLAIN.fullmatch(word) and "<|" not in word:
        return PIECES.findall(word.lower())
    return None


#: Classes of bytes for cutting words: 0 letters (ASCII, or two bytes from 0xC3 on), 1 digits, 2 signs, 3 not to be cut.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[0x21:0x7F] = 2
_CLASS[[*range(65, 91), *range(97, 123)]] = 0
_CLASS[48:58] = 1
_CLASS[[0x27, 0x3C]] = 3


def units(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray):
    """Small-letter copy of ``data`` and finer spans: runs of letters, single digits, runs of signs.

    Words with an apostrophe, ``<`` or letters beyond Latin-1 stay whole and as they are, since there a piece may reach
    over such a border. Returns data, starts, ends and the index of each document's first unit.
    """
    kind = _CLASS[data]
    lead = data == 0xC3
    lead[:-1] &= (data[1:] != 0x97) & (data[1:] != 0xB7)
    kind[lead] = 0
    kind[1:][lead[:-1]] = 0
    odd = np.flatnonzero((kind == 3) & ~base.SPACE[data])
    lower = base.LOWER[data]
    cut = np.zeros(len(data), bool)
    cut[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 1)
    if len(odd):
        whole = np.unique(np.searchsorted(starts, odd, side="right") - 1)
        whole = whole[whole >= 0]
        size = ends[whole] - starts[whole]
        edge = np.cumsum(size)
        inside = np.arange(edge[-1]) + np.repeat(starts[whole] - edge + size, size) if len(whole) else whole
        cut[inside] = False
        lower[inside] = data[inside]
    cut &= ~base.SPACE[data]
    cut[starts] = True
    begin = np.flatnonzero(cut)
    # a unit ends where the next begins, or with its word
    head = np.zeros(len(data), bool)
    head[starts] = True
    head = head[begin]
    stop = np.append(begin[1:], 0)
    last = np.append(head[1:], True)
    stop[last] = ends
    return lower, begin, stop, np.append(np.flatnonzero(head), len(begin))[first]


def filled(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """True at the positions of the spans, which are in order and apart."""
    step = np.zeros(n + 1, np.int8)
    step[starts] = 1
    step[ends] -= 1
    return np.cumsum(step[:-1], dtype=np.int8).view(bool)


class WordCoder:
    """Ids of text columns from ``encode(words)``, which gives those of each word as little-endian uint32 bytes.

    A word here is a run without ASCII white space; ``encode`` has to deal with other white space inside it. Results
    are kept for later steps; with ``cut`` words are first cut into units (see ``units``). ``most`` words of up to
    ``longest`` bytes bound the memory of a Python worker: once half as many have come since the last time, those go that
    have not been met since then.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], cut: bool = True, most: int = 300_000, longest: int = 64):
        self.encode, self.cut, self.most, self.longest, self.known, self.older = encode, cut, most, longest, {}, {}

    def words(self, keys: list[bytes]) -> list[bytes]:
        if len(self.known) >= self.most // 2:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        out = list(map(known.get, keys))
        miss = [i for i, v in enumerate(out) if v is None]
        if older:
            new, miss = miss, []
            for i, v in zip(new, map(older.get, [keys[i] for i in new])):
                if v is None:
                    miss.append(i)
                else:
                    out[i] = known[keys[i]] = v
        if miss:
            fresh = [keys[i] for i in miss]
            coded = self.encode([k.decode() for k in fresh])
            for i, v in zip(miss, coded):
                out[i] = v
            room = max(0, self.most // 2 - len(known))
            known.update([(k, v) for k, v in zip(fresh[:room], coded) if len(k) <= self.longest])
        return out

    def column(self, column) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows in one array, and the n + 1 offsets of the rows."""
        data, offsets = base.flat(column)
        starts, ends, first = base.words(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        if self.cut:
            data, starts, ends, first = units(data, starts, ends, first)
        _, lead, group = np.unique(base.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        lengths, lead_starts = ends - starts, starts[lead]
        # equal hashes have to be equal words: compare each word's bytes with those of its group's first
        same = np.array_equal(lengths, lengths[lead][group])
        if same:
            size = lengths.astype(np.int32)
            shift = np.repeat((starts - lead_starts[group]).astype(np.int32), size)
            inner = np.flatnonzero(filled(len(data), starts, ends)).astype(np.int32)
            same = np.array_equal(data[inner], data[inner - shift])
        if not same:
            lead, group = np.arange(len(starts)), np.arange(len(starts))
            lead_starts = starts
        raw = data.tobytes()
        coded = self.words([raw[a:b] for a, b in zip(lead_starts.tolist(), ends[lead].tolist())])
        pool = np.frombuffer(b"".join(coded), "<u4")
        size = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        at = np.cumsum(size) - size
        count = size[group]
        edge = np.concatenate([[0], np.cumsum(count)])
        ids = pool[np.arange(edge[-1], dtype=np.int32) + np.repeat((at[group] - edge[:-1]).astype(np.int32), count)]
        return ids, edge[first]


def by_pieces(encode_pieces: Callable[[list[str]], list[bytes]], encode_words: Callable[[list[str]], list[bytes]]) -> Callable[[list[str]], list[bytes]]:
    """An encoder of words from one of pieces, for plain words, and a general one for the others."""

    def encode(words: list[str]) -> list[bytes]:
        # most words are a piece as they are, and few come twice
        letters = [i for i, w in enumerate(words) if w.isascii() and w.isalpha()]
        out: list = [None] * len(words)
        for i, v in zip(letters, encode_pieces([words[i].lower() for i in letters])):
            out[i] = v
        rest = [i for i, v in enumerate(out) if v is None]
        split = [plain_pieces(words[i]) for i in rest]
        fresh = list({p for pieces in split if pieces for p in pieces})
        known = dict(zip(fresh, encode_pieces(fresh)))
        others = iter(encode_words([words[i] for i, p in zip(rest, split) if p is None]))
        for i, p in zip(rest, split):
            out[i] = next(others) if p is None else b"".join([known[x] for x in p])
        return out

    return encode
