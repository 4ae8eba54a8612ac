"""Hashed features of many texts at once, as arrays over their bytes."""

from __future__ import annotations

import numpy as np

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PRIME = 0x100000001B3
_INVERSE = pow(_PRIME, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def lowered(raw: np.ndarray) -> np.ndarray:
    """A-Z in lower case."""
    return _LOWER[raw]


def _power(name: str, base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, kept between calls."""
    if len(_powers.get(name, ())) < n:
        values = np.full(max(n, 1 << 16), base, np.uint64)
        values[0] = 1
        _powers[name] = np.cumprod(values)
    return _powers[name][:n]


def char_class(inside: bytes) -> np.ndarray:
    """A table of 256 flags; bytes beyond ASCII belong to every class."""
    flags = np.zeros(256, bool)
    flags[list(inside)] = True
    flags[0x80:] = True
    return flags


LETTERS_AND_DIGITS = char_class(b"0123456789abcdefghijklmnopqrstuvwxyz")
NO_SPACE = char_class(bytes(x for x in range(128) if chr(x) not in " \t\n\r\x0b\x0c"))


def word_hashes(raw: np.ndarray, places: np.ndarray, inside: np.ndarray,
                longest: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (runs of bytes of a class) and the offsets of each text in them.

    A word never runs from one text into the next. With `longest`, only so many first bytes of a
    word count.
    """
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(places), np.int64)
    word = np.append(inside[raw], False)
    first = np.zeros(n + 1, bool)
    first[places] = True
    before = np.empty(n + 1, bool)
    before[0] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | first))
    stops = np.flatnonzero(before & (~word | first))
    if longest:
        stops = np.minimum(stops, starts + longest)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _power("up", _PRIME, n), out=sums[1:])
    hashes = (sums[stops] - sums[starts]) * _power("down", _INVERSE, n)[starts]
    return mixed(hashes), np.searchsorted(starts, places)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def pairs(hashes: np.ndarray, gap: int, salt: int) -> np.ndarray:
    """Hashes of words and the words `gap` places later; the last `gap` have no partner."""
    if len(hashes) <= gap:
        return np.zeros(0, np.uint64)
    return mixed(hashes[:-gap] * np.uint64(0x9E3779B97F4A7C15) + hashes[gap:] + np.uint64(salt))


def byte_grams(raw: np.ndarray, size: int) -> np.ndarray:
    """Hashes of `size` (up to 8) consecutive bytes from every byte on."""
    if len(raw) < size:
        return np.zeros(0, np.uint64)
    n = len(raw) - size + 1
    code = np.full(n, size, np.uint64)
    for k in range(size):
        code = (code << np.uint64(8)) | raw[k:k + n]
    return mixed(code)


def slots(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Places in a table of 2^bits."""
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def spans(places: np.ndarray, lost: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) of the grams of each text, of which the last `lost` reach beyond it."""
    return places[:-1], np.maximum(places[1:] - lost, places[:-1])


def span_sums(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1)
    np.cumsum(values, out=total[1:])
    top = len(values)
    return total[np.minimum(last, top)] - total[np.minimum(first, top)]
