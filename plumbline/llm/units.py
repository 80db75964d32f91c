"""Token ids of many texts through a tokenizer that works on pre-split pieces.

Byte-level BPE encodes every pre-split piece by itself, so a text may be cut at any
place where a piece must end, and equal parts have equal ids. Parts recur, so a task
keeps their ids in a table and calls the tokenizer for new parts only. Cuts are made
at bytes where the GPT-2 pattern ends a piece whatever stands around:

* a space or line break after a character that is surely no white space,
* a visible character after a single line break (only a space joins what follows),
* ASCII punctuation after an ASCII or Latin-1 letter, and an ASCII letter after ASCII
  punctuation other than the apostrophe (which begins contractions).

An added token of the tokenizer, written out in a text, is a part of its own, as in the
library's plain encode(); no cut is made inside one.

Everything is done on arrays over a few hundred kilobytes of text at a time. The table
has a fixed number of places and is emptied when it fills up.
"""

from __future__ import annotations

import re

import numpy as np

from . import wordhash

PIECE = 1 << 18
PLACES = 1 << 21
_U = np.uint64

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_VISIBLE = np.zeros(256, bool)
_VISIBLE[33:127] = True
_TWO = np.zeros(256, bool)  # leads of two-byte characters that are never white space
_TWO[0xC3:0xE0] = True
_BREAK = np.zeros(256, bool)
_BREAK[[10, 32]] = True


def cuts(raw: np.ndarray) -> np.ndarray:
    """Whether a part begins at each byte; the first byte always does."""
    out = np.zeros(len(raw), bool)
    if not len(raw):
        return out
    prev, here = raw[:-1], raw[1:]
    second = np.zeros(len(prev), bool)  # prev ends such a two-byte character
    second[1:] = _TWO[prev[:-1]] & (prev[1:] >= 0x80)
    latin = np.zeros(len(prev), bool)
    latin[1:] = (prev[:-1] == 0xC3) & (prev[1:] != 0x97) & (prev[1:] != 0xB7) & (prev[1:] >= 0x80)
    spaced = _BREAK[here] & (_VISIBLE[prev] | second)
    single = np.zeros(len(prev), bool)  # prev is the one white space in its run so far
    single[1:] = spaced[:-1]
    out[1:] = (
        spaced
        | (single & (prev == 10) & (_VISIBLE[here] | _TWO[here]))
        | (_PUNCT[here] & (_LETTER[prev] | latin))
        | (_LETTER[here] & _PUNCT[prev] & (prev != 39))
    )
    out[0] = True
    return out


class Encoder:
    """encode(list of UTF-8 texts) -> (ids of all, bounds per text)."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        if any(t.lstrip or t.rstrip or t.single_word for t in added):
            raise ValueError("added tokens that take in what stands around them are not supported")
        # the longest first, as they may begin alike
        names = sorted({t.content.encode() for t in added}, key=lambda n: (-len(n), n))
        self.added = re.compile(b"|".join(map(re.escape, names))) if names else None
        self.clear()

    def cuts(self, data: bytes, begins: np.ndarray = np.zeros(0, np.int64)) -> np.ndarray:
        """Whether a part begins at each byte of texts that begin at ``begins``."""
        out = cuts(np.frombuffer(data, np.uint8))
        out[begins[begins < len(data)]] = True
        for m in self.added.finditer(data) if self.added else ():
            a, b = m.span()
            if np.searchsorted(begins, a, "right") == np.searchsorted(begins, b, "left"):  # in one text
                out[a + 1 : b] = False
                out[a] = True
                if b < len(data):
                    out[b] = True
        return out

    def clear(self) -> None:
        self.keys = np.zeros(PLACES, _U)
        self.part = np.full(PLACES, -1, np.int32)
        self.start = np.zeros(PLACES // 2 + 1, np.int64)  # of each part's ids in flat
        self.flat = np.zeros(PLACES * 2, np.uint32)
        self.count = 0

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Numbers of known parts, -1 for others."""
        out = np.full(len(h), -1, np.int32)
        todo = np.arange(len(h))
        place = (h & _U(PLACES - 1)).astype(np.int64)
        while len(todo):
            got, part = self.keys[place], self.part[place]
            same = (got == h[todo]) & (part >= 0)
            out[todo[same]] = part[same]
            on = ~same & (part >= 0)
            todo, place = todo[on], (place[on] + 1) & (PLACES - 1)
        return out

    def _add(self, h: np.ndarray, texts: list[str]) -> None:
        """New parts; h are distinct."""
        coded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        ids = [c.ids for c in coded]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((x for i in ids for x in i), np.uint32, int(sizes.sum()))
        base = self.start[self.count]
        while base + len(flat) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros(len(self.flat), np.uint32)))
        self.flat[base : base + len(flat)] = flat
        self.start[self.count + 1 : self.count + 1 + len(h)] = base + np.cumsum(sizes)
        number = np.arange(self.count, self.count + len(h), dtype=np.int32)
        self.count += len(h)
        todo, place = np.arange(len(h)), (h & _U(PLACES - 1)).astype(np.int64)
        while len(todo):
            free = self.part[place] < 0
            self.part[place[free]] = number[todo[free]]  # the last of several wins
            won = free & (self.part[place] == number[todo])
            self.keys[place[won]] = h[todo[won]]
            todo, place = todo[~won], (place[~won] + 1) & (PLACES - 1)

    def _piece(self, data: bytes, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of data, and how many stand before each of its bytes begins[k]."""
        raw = np.frombuffer(data, np.uint8)
        start = np.flatnonzero(self.cuts(data, begins))
        end = np.append(start[1:], len(raw))
        power, inverse = wordhash._up_to(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, _U)
        np.cumsum(wordhash._BYTES[raw] * power[: len(raw)], out=sums[1:])
        h = wordhash.mix(((sums[end] - sums[start]) * inverse[start]) ^ ((end - start).astype(_U) * _U(0xA0761D6478BD642F)))
        part = self._find(h)
        if (part < 0).any():
            new, at = np.unique(h[part < 0], return_index=True)
            where = np.flatnonzero(part < 0)[at]
            if self.count + len(new) > PLACES // 2:
                self.clear()
                new, where = np.unique(h, return_index=True)
            for a in range(0, len(new), PLACES // 4):
                pick = where[a : a + PLACES // 4]
                self._add(new[a : a + PLACES // 4], [data[s:e].decode() for s, e in zip(start[pick].tolist(), end[pick].tolist(), strict=True)])
            part = self._find(h)
        size = self.start[part + 1] - self.start[part]
        before = np.concatenate(([0], np.cumsum(size)))
        index = np.arange(before[-1]) + np.repeat(self.start[part] - before[:-1], size)
        return self.flat[index], before[np.searchsorted(start, begins)]

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        out, bounds, total, k = [], [0], 0, 0
        while k < len(texts):
            last, size = k + 1, len(texts[k])
            while last < len(texts) and size + len(texts[last]) <= PIECE:
                size += len(texts[last])
                last += 1
            if size > PIECE:  # one long text, taken piece by piece
                n = 0
                for part in _parts(texts[k], self.cuts):
                    ids, _ = self._piece(part, np.zeros(1, np.int64))
                    out.append(ids)
                    n += len(ids)
                total += n
                bounds.append(total)
            elif size:
                begins = np.cumsum([0] + [len(t) for t in texts[k:last]])
                ids, at = self._piece(b"".join(texts[k:last]), begins)
                out.append(ids)
                bounds.extend((total + at[1:]).tolist())
                total += len(ids)
            else:
                bounds.extend([total] * (last - k))
            k = last
        return (np.concatenate(out) if out else np.zeros(0, np.uint32)), np.array(bounds)


def _parts(text: bytes, cut):
    """Parts of a long text that begin where cut() allows it, of about PIECE bytes."""
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            safe = np.flatnonzero(cut(text[at : end + PIECE]))
            later = safe[safe >= PIECE // 2]
            while not len(later) and end < len(text):  # a run without any safe place
                end += PIECE * 4
                safe = np.flatnonzero(cut(text[at : end + PIECE]))
                later = safe[safe >= PIECE // 2]
            end = at + int(later[min(np.searchsorted(later, PIECE), len(later) - 1)]) if len(later) else len(text)
        yield text[at:end]
        at = end
