"""Hashed n-grams of whole texts, of bytes or of characters, many texts at a time."""

from __future__ import annotations

import numpy as np

_TABLE = np.random.default_rng(20).integers(0, 2**32, (8, 256), dtype=np.uint32)
#: ASCII letters and apostrophe stay, other ASCII becomes a space; bytes of other characters stay.
_PLAIN = bytes(c if c >= 128 or chr(c).isalpha() or c == 39 else 32 for c in range(256))


def plain(text: str | None) -> bytes:
    """Lower case, with a space before and after; digits, marks and controls are spaces."""
    return b" " + (text or "").lower().encode("utf-8", "surrogatepass").translate(_PLAIN) + b" "


def grams(buf: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Hash of the n bytes at each place where n are left."""
    if len(buf) < n:
        return np.zeros(0, np.uint32)
    h = _TABLE[0][buf[: len(buf) - n + 1]]
    for i in range(1, n):
        h = h ^ _TABLE[i][buf[i : len(buf) - n + 1 + i]]
    return h & np.uint32((1 << bits) - 1)


def chunks(texts: list, most: int = 1 << 21):
    """Runs of texts with about so many bytes: start, end, bytes laid end to end, size of each."""
    at = 0
    while at < len(texts):
        got, total, to = [], 0, at
        while to < len(texts) and (to == at or total < most):
            got.append(plain(texts[to]))
            total += len(got[-1])
            to += 1
        yield at, to, np.frombuffer(b"".join(got), np.uint8), np.array([len(g) for g in got])
        at = to


#: Odd multipliers, one for each character of an n-gram.
_ODD = np.random.default_rng(21).integers(0, 2**31, 16, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SPACES = {c: 32 for c in range(33)}


def characters(text: str | None) -> np.ndarray:
    """Code points in lower case, with a space before and after; ASCII white space and controls are spaces. Digits and marks stay."""
    return np.frombuffer((" " + (text or "").lower().translate(_SPACES) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)


def char_grams(codes: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Hash of the n characters at each place where n are left; n itself takes part."""
    if len(codes) < n:
        return np.zeros(0, np.uint32)
    h = np.full(len(codes) - n + 1, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    for i in range(n):
        h += codes[i : len(codes) - n + 1 + i] * _ODD[i]
        h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    return h >> np.uint32(32 - bits)


def char_chunks(texts: list, most: int = 1 << 19):
    """Runs of texts with about so many characters, as chunks() has them."""
    at = 0
    while at < len(texts):
        got, total, to = [], 0, at
        while to < len(texts) and (to == at or total < most):
            got.append(characters(texts[to]))
            total += len(got[-1])
            to += 1
        yield at, to, np.concatenate(got), np.array([len(g) for g in got])
        at = to
