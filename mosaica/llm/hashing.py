"""Vectorised 64-bit hashes of the words of many texts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

_P = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_P, -1, 1 << 64)
_POWERS: list[np.ndarray] = []
#: Bytes of text that are hashed at once.
PIECE = 1 << 20


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, PIECE + (1 << 13))
        made = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, p, np.uint64)])) for p in (_P, _INVERSE)]
        if size > 1 << 22:  # for one word of some MB: not kept
            return made[0][:n], made[1][:n]
        _POWERS[:] = made
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits (the finaliser of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@dataclass
class Words:
    """Words of texts, one after the other."""

    hash: np.ndarray  # uint64
    doc: np.ndarray  # index of the text
    count: np.ndarray  # words of each text
    start: np.ndarray  # byte offsets inside the text
    end: np.ndarray
    first: np.ndarray  # index of each text's first word


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Classes for ``split_marks``: space 0, word characters 1, other marks 2.
_CLASS = np.full(256, 2, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = 1


def pieces(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of about ``PIECE`` bytes that end at white space, so that no word is cut."""
    begin = 0
    while begin < len(data):
        end, look = min(len(data), begin + PIECE), 1 << 12
        while end < len(data):
            space = np.flatnonzero(_SPACE[data[end : end + look]])
            if len(space):
                end += int(space[0]) + 1
                break
            end, look = min(len(data), end + look), look * 2
        yield begin, end
        begin = end


def split_words(texts: list[str | None], marks: bool = False, lower: bool = True) -> Words:
    """Words between ASCII white space, A-Z in lower case; ``marks`` parts runs of punctuation from letters and digits.

    What takes many bytes a byte of text is made for a piece at a time, so a very long text is as good as many short ones.
    """
    raw = [(t or "").encode() for t in texts]
    size = np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw))
    whole = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    base = np.concatenate([[0], np.cumsum(size)])
    starts, ends, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for at, to in pieces(whole):
        data = _LOWER[whole[at:to]] if lower else whole[at:to]
        if marks:
            kind = _CLASS[data]
            change = np.flatnonzero(np.diff(kind, prepend=np.uint8(0), append=np.uint8(0)))
            start, end = change[:-1], change[1:]
            real = kind[start] > 0 if len(start) else np.zeros(0, bool)
            start, end = start[real], end[real]
        else:
            inside = ~_SPACE[data]
            change = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
            start, end = change[::2], change[1::2]
        up, down = powers(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
        hashes.append(mix((total[end] - total[start]) * down[start]))
        starts.append(start + at)
        ends.append(end + at)
    h, start, end = np.concatenate(hashes), np.concatenate(starts), np.concatenate(ends)
    edge = np.searchsorted(start, base)
    count = np.diff(edge)
    doc = np.repeat(np.arange(len(raw)), count)
    return Words(h, doc, count, start - base[doc], end - base[doc], edge[:-1])


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every ``n`` neighbours (also across texts: the caller drops those)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out, p = np.zeros(len(h) - n + 1, np.uint64), 1
    for k in range(n):
        out += h[k : len(h) - n + 1 + k] * np.uint64(p)
        p = p * 0xD6E8FEB86659FD93 & (1 << 64) - 1
    return mix(out)


def window_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every ``n`` neighbours in time that does not depend on ``n``."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = []
    for a in range(0, len(h) - n + 1, PIECE // 4):
        part = h[a : a + PIECE // 4 + n - 1]
        up, down = powers(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[: len(part)], out=total[1:])
        out.append(mix((total[n:] - total[:-n]) * down[: len(part) - n + 1]))
    return np.concatenate(out)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
