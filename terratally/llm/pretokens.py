"""Splitting text into pre-tokens with array operations.

The result is that of matching the byte-level pattern of the public vocabularies (contractions, then an optional
space with a run of letters, of digits or of other signs, then white space) from left to right. The matches tile
the text, so only their starts are computed, from the classes of neighbouring characters.
"""
from __future__ import annotations

from functools import lru_cache

import numpy as np
import regex

from terratally.llm.common import mixed

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: Code points with the White_Space property.
WHITE_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Letters of the contractions after an apostrophe.
ONE, TWO = "stmd", ("re", "ve", "ll")
BASE = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(1)
def char_classes() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, range(0x110000)))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            table[m.start():m.end()] = kind
    table[WHITE_SPACE] = SPACE
    return table


@lru_cache(1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    up, down = np.full(n, BASE, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def code_points(utf8: np.ndarray) -> np.ndarray:
    return np.frombuffer(utf8.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), "<u4")


def char_bytes(codes: np.ndarray) -> np.ndarray:
    """UTF-8 length of each code point."""
    return 1 + (codes > 0x7F).astype(np.int8) + (codes > 0x7FF) + (codes > 0xFFFF)


def word_starts(codes: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Character offsets where a pre-token starts. ``doc_starts``: first offsets of the non-empty documents."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    kind = char_classes()[codes]
    first = np.zeros(n, bool)
    first[doc_starts] = True
    last = np.empty(n, bool)
    last[:-1], last[-1] = first[1:], True
    start = first.copy()
    start[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    # a run's last white space stands alone, or with what follows if it is a plain space
    before_word = np.zeros(n, bool)
    before_word[:-1] = space[:-1] & ~space[1:] & ~last[:-1]
    start |= before_word
    plain = before_word & (codes == 0x20)
    start[1:] &= ~plain[:-1] | first[1:]
    # contractions: an apostrophe that starts a match, and the letters after it
    quote = np.flatnonzero((codes == 0x27) & start & ~last)
    if len(quote):
        def at(k):
            out = np.zeros(len(quote), np.uint32)
            ok = quote + k < n
            for j in range(1, k + 1):
                ok[ok] &= ~first[quote[ok] + j]
            out[ok] = codes[quote[ok] + k]
            return out
        a, b = at(1), at(2)
        one = np.isin(a, [ord(x) for x in ONE])
        two = np.zeros(len(quote), bool)
        for x, y in TWO:
            two |= (a == ord(x)) & (b == ord(y))
        start[quote[one | two] + 1] = False
        for q, length in ((quote[one], 2), (quote[two], 3)):
            q = q[q + length < n]
            start[q + length] = True
    return np.flatnonzero(start)


def word_hashes(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64-bit hash of each pre-token."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = 1 << max(16, int(len(codes)).bit_length())
    up, down = powers(n)
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes + np.uint64(1)) * up[:len(codes)], out=total[1:])
    ends = np.append(starts[1:], len(codes))
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * BASE)
