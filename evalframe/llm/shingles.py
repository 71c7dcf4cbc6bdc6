"""Word and shingle hashes of many texts at once, in numpy.

A word is a maximal run of letters, digits, ``_`` and other characters outside ASCII and the
blocks of general punctuation, in lower case. Its hash is a polynomial of its bytes modulo
2**64, taken from running sums, then mixed; a shingle's hash is the same of its words.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np

WORDS_IN_SHINGLE = 5
CHUNK_CHARS = 1_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_STEP = np.uint64(0xD1342543DE82EF95)
_SPACE = re.compile(r"\s")

_is_word = np.zeros(256, bool)
_is_word[[*range(48, 58), *range(65, 91), 95, *range(97, 123)]] = True
_is_word[128:] = True
_weight = np.random.Generator(np.random.PCG64(7)).integers(0, 2**64, 256, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[:1] = 1
    out[1:] = base
    return np.multiply.accumulate(out, out=out)


class _Powers:
    up = down = np.zeros(0, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up, cls.down = _powers(_BASE, n + n // 8), _powers(_BASE_INVERSE, n + n // 8)
        return cls.up, cls.down


def _hashed(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first bytes of the words in ``data``."""
    byte = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(byte) + 2, bool)
    word = inside[1:-1]
    word[:] = _is_word[byte]
    if len(byte) > 2 and (byte >= 0xC2).any():
        # General punctuation (U+2000-206F), CJK punctuation (U+3000-303F), Latin-1 signs.
        three = (byte[:-2] == 0xE2) & ((byte[1:-1] == 0x80) | (byte[1:-1] == 0x81)) | (byte[:-2] == 0xE3) & (byte[1:-1] == 0x80)
        two = (byte[:-1] == 0xC2) & (byte[1:] != 0xAA) & (byte[1:] != 0xB5) & (byte[1:] != 0xBA)
        for places, n in ((np.flatnonzero(three), 3), (np.flatnonzero(two), 2)):
            for k in range(n):
                word[places + k] = False
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, stop = edge[::2], edge[1::2]
    up, down = _Powers.of(len(byte) + 1)
    total = np.zeros(len(byte) + 1, np.uint64)
    np.cumsum(_weight[byte] * up[: len(byte)], out=total[1:])
    return mixed((total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64)), start


def _pieces(text: str) -> Iterator[str]:
    start = 0
    while start < len(text):
        cut = _SPACE.search(text, start + CHUNK_CHARS)
        stop = cut.end() if cut else len(text)
        yield text[start:stop]
        start = stop


def word_hashes(texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    """The word hashes of each text, in order.

    Texts are hashed some ``CHUNK_CHARS`` characters at a time, so temporary arrays stay
    small whether there are many texts or a very long one.
    """
    held: list[bytes] = []
    size = 0

    def settle() -> Iterator[np.ndarray]:
        hashes, start = _hashed(b"\n".join(held))
        bounds = np.searchsorted(start, np.cumsum([len(x) + 1 for x in held]))
        yield from np.split(hashes, bounds[:-1]) if len(bounds) else ()
        held.clear()

    for text in texts:
        text = text or ""
        if len(text) > CHUNK_CHARS:
            if held:
                yield from settle()
                size = 0
            yield np.concatenate([_hashed(x.lower().encode("utf-8", "replace"))[0] for x in _pieces(text)])
            continue
        held.append(text.lower().encode("utf-8", "replace"))
        size += len(held[-1])
        if size > CHUNK_CHARS:
            yield from settle()
            size = 0
    if held:
        yield from settle()


def shingle_hashes(words: np.ndarray, k: int = WORDS_IN_SHINGLE) -> np.ndarray:
    """Hashes of all runs of ``k`` words; a text of fewer words is one shingle."""
    n = len(words)
    if n == 0:
        return words
    k = min(k, n)
    total = words[: n - k + 1].copy()
    for j in range(1, k):
        total = total * _STEP + words[j : n - k + 1 + j]
    return mixed(total + np.uint64(k))


def labelled(shingles: np.ndarray) -> np.ndarray:
    """Shingle hashes with their occurrence in the text mixed in: first, second, ..."""
    order = np.argsort(shingles, kind="stable")
    same = np.r_[False, shingles[order][1:] == shingles[order][:-1]]
    if not same.any():
        return shingles
    at = np.arange(len(shingles))
    nth = at - np.maximum.accumulate(np.where(same, 0, at))
    label = np.empty_like(nth)
    label[order] = nth
    return with_label(shingles, label)


def with_label(shingles: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """Shingle hashes with the number of earlier equal ones mixed in."""
    out = shingles.copy()
    again = nth > 0
    out[again] = mixed(shingles[again] + nth[again].astype(np.uint64) * _BASE)
    return out
