"""Pieces of text as the byte-level pattern cuts them, each different one known by a code.

Numpy finds the pieces of most texts in their UTF-8 bytes and looks their hashes up in a table of fixed size.
Texts with an apostrophe (contractions), white space beyond ASCII, or characters beyond the basic plane are cut
by the pattern itself, as are all texts if the pattern is another one.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex

from . import _words as words
from ._shared import as_bytes

#: The pattern that the numpy form stands for.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LETTER, NUMBER, OTHER, SPACE, HARD = range(5)
_KINDS: list[np.ndarray] = []
#: Bits of the table; longest piece that is known by its hash.
TABLE_BITS, SHORT = 20, 64


def kinds() -> np.ndarray:
    """Kind of each code point of the basic plane, by the pattern's own classes."""
    if not _KINDS:
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
        kind = np.full(0x10000, OTHER, np.uint8)
        for what, k in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", HARD)):
            kind[np.frombuffer("".join(regex.findall(what, every)).encode("utf-16-le"), "<u2")] = k
        kind[[9, 10, 11, 12, 13, 32]] = SPACE
        kind[39] = HARD
        _KINDS.append(kind)
    return _KINDS[0]


def kind_of_bytes(raw: np.ndarray) -> np.ndarray:
    """Each byte's kind; all bytes of a character have its kind."""
    table = kinds()
    kind = table[:256][raw]
    wide = np.flatnonzero(raw >= 0x80)
    if len(wide):
        pad = np.concatenate([raw, np.zeros(3, np.uint8)]).astype(np.int32)
        lead = wide[raw[wide] >= 0xC0]
        b = pad[lead]
        two, three = lead[b < 0xE0], lead[(b >= 0xE0) & (b < 0xF0)]
        kind[lead[b >= 0xF0]] = HARD
        k = table[(pad[two] & 31) << 6 | pad[two + 1] & 63]
        kind[two] = kind[two + 1] = k
        k = table[(pad[three] & 15) << 12 | (pad[three + 1] & 63) << 6 | pad[three + 2] & 63]
        kind[three] = kind[three + 1] = kind[three + 2] = k
    return kind


def starts(raw: np.ndarray, at: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where pieces start, for texts without HARD characters."""
    n = len(raw)
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    space = kind == SPACE
    begin = np.ones(n, bool)  # of a run of one kind
    begin[1:] = (kind[1:] != kind[:-1]) | edge[1:n]
    joined = np.zeros(n, bool)  # a run that takes the blank before it
    joined[1:] = begin[1:] & ~space[1:] & (raw[:-1] == 32) & ~edge[1:n]
    last = np.zeros(n, bool)  # white space before a run of another kind in the same text
    last[:-1] = space[:-1] & ~space[1:] & ~edge[1:n]
    return np.flatnonzero(begin & ~joined | last)


class PieceTable:
    """Codes of pieces in the order in which `learn` has seen them."""

    def __init__(self, pattern: str, learn: Callable[[list[bytes]], None], forget: Callable[[], None], kept: int):
        self.cut, self.by_bytes = regex.compile(pattern).findall, pattern == BYTE_LEVEL
        self.learn, self.forget, self.kept = learn, forget, kept
        self.clear()

    def clear(self) -> None:
        self.n = 0
        self.by_text: dict[bytes, int] = {}
        self.by_hash: dict[int, int] = {}
        self.key, self.value = np.zeros(1 << TABLE_BITS, np.uint64), np.zeros(1 << TABLE_BITS, np.int32)
        self.forget()

    def _known(self, pieces: list[bytes]) -> list[int]:
        new = [p for p in dict.fromkeys(pieces) if p not in self.by_text]
        if new:
            self.by_text.update(zip(new, range(self.n, self.n + len(new))))
            self.n += len(new)
            self.learn(new)
        return [self.by_text[p] for p in pieces]

    def _fast(self, raw: np.ndarray, at: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start = starts(raw, at, kind)
        end = np.append(start[1:], len(raw))
        code = np.zeros(len(start), np.int64)
        key = words.ranges(words.prefix(raw), start, end)
        slot = (key >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        long = end - start > SHORT
        hit = (self.key[slot] == key) & ~long
        code[hit] = self.value[slot[hit]]
        miss = np.flatnonzero(~hit & ~long)
        if len(miss):
            unique, first, back = np.unique(key[miss], return_index=True, return_inverse=True)
            found = [self.by_hash.get(k, -1) for k in unique.tolist()]
            own = np.array(found, np.int64)
            new = np.flatnonzero(own < 0)
            if len(new):
                where = miss[first[new]]
                text = raw.tobytes()
                own[new] = np.arange(self.n, self.n + len(new))
                self.by_hash.update(zip(unique[new].tolist(), own[new].tolist()))
                self.n += len(new)
                self.learn([text[a:b] for a, b in zip(start[where].tolist(), end[where].tolist())])
            code[miss] = own[back]
            to = (unique >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
            self.key[to], self.value[to] = unique, own
        if long.any():
            which = np.flatnonzero(long)
            text = raw.tobytes()
            code[which] = self._known([text[a:b] for a, b in zip(start[which].tolist(), end[which].tolist())])
        return code, np.searchsorted(start, at)

    def codes(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Code of each piece, and where each text's pieces start."""
        if self.n > self.kept:
            self.clear()
        raw, at = as_bytes(col)
        n = len(at) - 1
        hard = np.ones(n, bool)
        if self.by_bytes:
            kind = kind_of_bytes(raw)
            bad = np.flatnonzero(kind == HARD)
            hard = np.searchsorted(bad, at[1:]) > np.searchsorted(bad, at[:-1])
        if not hard.any():
            return self._fast(raw, at, kind)
        parts: list[np.ndarray] = [np.zeros(0, np.int64)] * n
        easy = np.flatnonzero(~hard)
        if len(easy):
            use = np.repeat(~hard, np.diff(at))
            code, edge = self._fast(raw[use], np.concatenate([[0], np.cumsum(np.diff(at)[easy])]), kind[use])
            for i, a, b in zip(easy, edge[:-1], edge[1:]):
                parts[i] = code[a:b]
        texts, those = raw.tobytes(), np.flatnonzero(hard)
        cut = [self.cut(texts[at[i] : at[i + 1]].decode()) for i in those]
        known = np.array(self._known([p.encode() for c in cut for p in c]), np.int64)
        for i, part in zip(those, np.split(known, np.cumsum([len(c) for c in cut])[:-1])):
            parts[i] = part
        return np.concatenate([np.zeros(0, np.int64), *parts]), np.cumsum([0, *map(len, parts)])


def gather(data: np.ndarray, at: np.ndarray, code: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What each code stands for (data[at[code]:at[code + 1]]), end to end, and where each text's starts."""
    n = at[code + 1] - at[code]
    end = np.concatenate([[0], np.cumsum(n)])
    return data[np.repeat(at[code] - end[:-1], n) + np.arange(end[-1])], end[text]
