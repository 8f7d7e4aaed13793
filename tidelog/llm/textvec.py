"""Vectorised text primitives shared by the operators of this subpackage.

Everything here works on whole texts with numpy: a batch of strings becomes one
code point array, words become 64-bit hashes by prefix sums of a polynomial
hash, and per-document sums come from ``reduceat``/``cumsum``.  Very long texts
are cut into segments for memory only; the results are those of the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

_BMP = 0x10000
_MULT = np.uint64(0x9E3779B97F4A7C15)
_POLY = 0x100000001B3
#: Characters that one vectorised step works on; bounds a worker's memory.
SLICE_CHARS = 1 << 18


@lru_cache(maxsize=2)
def _tables(limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(lower-case code point, is letter or digit) by code point below limit."""
    lower = np.arange(limit, dtype=np.uint32)
    alnum = np.zeros(limit, dtype=bool)
    for i in range(limit):
        c = chr(i)
        if c.isalnum():
            alnum[i] = True
            low = c.lower()
            if len(low) == 1:
                lower[i] = ord(low)
    return lower, alnum


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the polynomial's base and of its inverse, modulo 2**64."""
    up = np.full(n, _POLY, dtype=np.uint64)
    up[0] = 1
    down = np.full(n, pow(_POLY, -1, 1 << 64), dtype=np.uint64)
    down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def tables_for(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _tables(_BMP if not len(cp) or int(cp.max()) < _BMP else 0x110000)


def slices(texts: list[str | None], chars: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``chars`` characters each, one at least."""
    begin, total = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if total and total + n > chars:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(texts):
        yield begin, len(texts)


def _word_hashes_of(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lower, alnum = tables_for(cp)
    inside = alnum[cp]
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends
    size = 1 << max(19, int(len(cp)).bit_length())
    up, down = _powers(size)
    sums = np.zeros(len(cp) + 1, dtype=np.uint64)
    np.cumsum((lower[cp].astype(np.uint64) + np.uint64(1)) * up[: len(cp)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix(h ^ ((ends - starts).astype(np.uint64) * _MULT)), starts, ends


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs of letters and digits, lower case) of the texts,
    and where each text's begin: text i has hashes[at[i]:at[i + 1]].  A null has none."""
    counts = np.zeros(len(texts), dtype=np.int64)
    out: list[np.ndarray] = []
    for a, b in slices(texts):
        part = [t or "" for t in texts[a:b]]
        if b - a == 1 and len(part[0]) > 2 * SLICE_CHARS:
            long, at, n = part[0], 0, 0
            while at < len(long):
                end = at + SLICE_CHARS
                while end < len(long) and long[end - 1].isalnum() and long[end].isalnum():
                    end += 1
                h = _word_hashes_of(code_points(long[at:end]))[0]
                out.append(h)
                n += len(h)
                at = end
            counts[a] = n
            continue
        h, starts, _ = _word_hashes_of(code_points("\n".join(part)))
        begin = np.cumsum([0] + [len(t) + 1 for t in part])
        counts[a:b] = np.diff(np.searchsorted(starts, begin))
        out.append(h)
    at = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(counts, out=at[1:])
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), at


def shingles(words: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words inside each text; a shorter text with
    words has one shingle of them all, a text without words none."""
    counts = np.diff(at)
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    to = np.zeros(len(at), dtype=np.int64)
    np.cumsum(n, out=to[1:])
    if not to[-1]:
        return np.zeros(0, np.uint64), to
    first = np.repeat(at[:-1] - to[:-1], n) + np.arange(to[-1])
    left = np.repeat(at[1:], n) - first  # words from here to the text's end
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    h = np.zeros(to[-1], dtype=np.uint64)
    short = bool((left < size).any())
    for j in range(size):
        w = padded[first + j]
        if short:
            w = np.where(j < left, w, np.uint64(0))
        h = h * np.uint64(0x5851F42D4C957F2D) + w
    return mix(h), to


def segment_sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values[at[i]:at[i + 1]] for every i; 0 for an empty range."""
    sums = np.zeros(len(values) + 1, dtype=np.float64)
    np.cumsum(values, out=sums[1:])
    return sums[at[1:]] - sums[at[:-1]]


def gram_index(cp: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Bucket below 2**bits of the n-gram of (lower-case) characters that begins at
    each position; the last n - 1 positions have none."""
    m = len(cp) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint32)
    h = np.full(m, (n * 0x9E3779B1) & 0xFFFFFFFF, dtype=np.uint32)
    for j in range(n):
        h *= np.uint32(0x01000193)
        h ^= cp[j : m + j]
        h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(15)
    return h >> np.uint32(32 - bits)


def folded(texts: list[str | None], first: str = " ", last: str = " ") -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code points of the texts, each between ``first`` and ``last``, end to
    end; digits count as '0', white space as ' '.  Text i has cp[at[i]:at[i + 1]]."""
    part = [first + (t or "") + last for t in texts]
    at = np.zeros(len(part) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in part], out=at[1:])
    cp = code_points("".join(part))
    cp = tables_for(cp)[0][cp]
    cp[(cp >= 48) & (cp <= 57)] = 48
    cp[(cp == 10) | (cp == 13) | (cp == 9)] = 32
    return cp, at


def pieces(texts: list[str | None], size: int = SLICE_CHARS, overlap: int = 8) -> Iterator[tuple[list[int], list[str], list[int]]]:
    """All texts in groups of about ``size`` characters: (text's number, its piece, how
    many characters of the piece count).  A text longer than that is cut; a piece then
    carries ``overlap`` more characters, so that n-grams over the cut are seen once."""
    who: list[int] = []
    part: list[str] = []
    own: list[int] = []
    total = 0
    for i, t in enumerate(texts):
        t = t or ""
        for a in range(0, max(1, len(t)), size):
            n = min(size, len(t) - a)
            who.append(i)
            part.append(t[a : a + n + overlap] if len(t) > size else t)
            own.append(n)
            total += n
            if total >= size:
                yield who, part, own
                who, part, own, total = [], [], [], 0
    if who:
        yield who, part, own
