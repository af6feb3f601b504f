"""Subword ids of whole texts by the ``tokenizers`` library.

Texts are cut where the tokenizer's own pre-tokenisation always cuts, each distinct piece of a
chunk is encoded once, and its ids are gathered for every occurrence; the ids equal those of the
whole text.  A cut is made only beside ASCII space whose neighbours can't be white space, so no
look-around of a split pattern and no normalisation reaches over it.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa

from .common import encode_slices, flat_text, ranges, word_slices, worker_setup

_PLAIN = np.zeros(256, bool)
_PLAIN[0x21:0x7F] = True
_LETTER, _STOP = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_STOP[list(b".,;:!?()#*$%&|")] = True
#: Pieces that keep to themselves beside others of their kind: led by a space and ended by a character that is not white space; or letters of Latin-1, which lower-casing and NFC map to single letters.
_SPACE_LED = re.compile(rb" [^\s\x00-\x20\x7f\xc2\xe1-\xe3](?:[^\x00-\x1f\x7f\xc2\xe1-\xe3]*[^\x00-\x20\x7f\xc2\xe1-\xe3])?", re.DOTALL)
_LETTERS = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
_TOGETHER = 500


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _flagged(n: int, *places: np.ndarray) -> np.ndarray:
    flags = np.zeros(n + 1, bool)
    for at in places:
        flags[at] = True
    return np.flatnonzero(flags)


def space_cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Offsets of pieces that end before a lone space between characters which are certainly not white space."""
    n = len(data)
    if n < 3:
        return _flagged(n, offsets)
    at = np.flatnonzero(data[1:-1] == 0x20) + 1
    # White space beyond ASCII begins with byte C2 (two bytes) or E1 to E3 (three bytes).
    before, second, third = data[at - 1], data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
    fine = _PLAIN[before] | ((before >= 0x80) & (second != 0xC2) & ((third < 0xE1) | (third > 0xE3)))
    after = data[at + 1]
    fine &= _PLAIN[after] | ((after >= 0xC3) & ((after < 0xE1) | (after > 0xE3)))
    return _flagged(n, at[fine], offsets)


def punctuation_cuts(data: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Further cuts of words before plain punctuation that follows an ASCII letter."""
    return _flagged(len(data), cuts, np.flatnonzero(_LETTER[data[:-1]] & _STOP[data[1:]]) + 1)


class TextTokenizer:
    """``space_led``: pieces keep the space that leads them (byte-level BPE); else white space is dropped, as the tokenizer drops it (BPE with word ends).

    Distinct pieces that can't affect each other are encoded many at a time and told apart by the
    bytes of their ids, or by ids that end words; all others alone.
    """

    def __init__(self, path: str, space_led: bool, remembered: int = 1_200_000):
        worker_setup()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.space_led, self.remembered = space_led, remembered
        vocabulary = self.tokenizer.get_vocab()
        self.weight = np.zeros(max(vocabulary.values()) + 1, np.int32)
        for text, i in vocabulary.items():
            self.weight[i] = len(text) if space_led else text.endswith("</w>")
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.start, self.length, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _encoded(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids_of(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces end to end, and each piece's count."""
        apart = _SPACE_LED if self.space_led else _LETTERS
        fits = [x is not None for x in map(apart.fullmatch, pieces)]
        joined = [p for p, x in zip(pieces, fits, strict=True) if x]
        alone = [p for p, x in zip(pieces, fits, strict=True) if not x]
        groups = [joined[a : a + _TOGETHER] for a in range(0, len(joined), _TOGETHER)]
        lengths, flats = [], []
        glue = b"" if self.space_led else b" "
        for g, ids in zip(groups, self._encoded([glue.join(g).decode() for g in groups]), strict=True):
            ids = np.array(ids, np.int32)
            done = np.cumsum(self.weight[ids])
            want = np.cumsum([len(p) for p in g]) if self.space_led else np.arange(1, len(g) + 1)
            ends = np.searchsorted(done, want, "left") + 1
            if done[-1] != want[-1] or (done[ends - 1] != want).any():
                raise ValueError("ids do not fall on the ends of pieces")
            lengths.append(np.diff(ends, prepend=0))
            flats.append(ids)
        single = self._encoded([p.decode() for p in alone])
        lengths.append(np.fromiter(map(len, single), np.int64, len(single)))
        flats.append(np.fromiter((i for x in single for i in x), np.int32))
        length, flat = np.concatenate(lengths), np.concatenate(flats)
        start = np.cumsum(length) - length
        order = np.empty(len(pieces), np.int64)  # back to the order of the pieces
        fits = np.array(fits, bool)
        order[fits], order[~fits] = np.arange(len(joined)), np.arange(len(joined), len(pieces))
        return flat[ranges(start[order], length[order])], length[order]

    def _codes_of(self, pieces: list[bytes]) -> np.ndarray:
        known = self.known
        codes = np.fromiter(map(known.get, pieces, itertools.repeat(-1)), np.int64, len(pieces))
        new = np.flatnonzero(codes < 0)
        if len(new):
            if known and len(known) + len(new) > self.remembered:
                self._forget()
                return self._codes_of(pieces)
            fresh = [pieces[i] for i in new]
            flat, length = self._ids_of(fresh)
            codes[new] = np.arange(len(known), len(known) + len(new))
            known.update(zip(fresh, range(len(known), len(known) + len(new)), strict=True))
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(length) - length])
            self.length = np.concatenate([self.length, length])
            self.flat = np.concatenate([self.flat, flat])
        return codes

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and each text's offset in them."""
        data, offsets = flat_text(column)
        if self.space_led:
            cuts = space_cuts(data, offsets) if len(data) else np.zeros(1, np.int64)
            piece_of_text = np.searchsorted(cuts, offsets)
        else:
            data, words, first = word_slices(data, offsets)
            cuts = punctuation_cuts(data, words) if len(data) else words
            piece_of_text = np.searchsorted(cuts, words)[first]
        codes, pieces = encode_slices(data, cuts)
        if not len(codes):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        raw, ends = flat_text(pieces)
        raw, ends = raw.tobytes(), ends.tolist()
        own = self._codes_of([raw[a:b] for a, b in itertools.pairwise(ends)])[codes]
        lengths = self.length[own]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return self.flat[ranges(self.start[own], lengths)], ends[piece_of_text]


_LOADED: dict[tuple[str, bool], TextTokenizer] = {}


def text_tokenizer(path: str, space_led: bool, remembered: int = 1_200_000) -> TextTokenizer:
    """The tokenizer of this worker process, with what it remembers from earlier tasks; how much it may from now on is the caller's, whoever loaded it."""
    if (path, space_led) not in _LOADED:
        _LOADED[path, space_led] = TextTokenizer(path, space_led, remembered)
    _LOADED[path, space_led].remembered = remembered
    return _LOADED[path, space_led]
