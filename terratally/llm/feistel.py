"""Keyed permutation of 0 .. n - 1: a Feistel network on the next even number of bits, with cycle walking."""
from __future__ import annotations

import hashlib

import numpy as np

ROUNDS = 8


def round_keys(key: bytes, tweak: bytes = b"") -> list[np.uint64]:
    return [np.uint64(int.from_bytes(hashlib.blake2b(tweak + bytes([r]), key=hashlib.sha256(key).digest(), digest_size=8).digest(), "little")) for r in range(ROUNDS)]


def scrambled(x: np.ndarray, key: np.uint64) -> np.ndarray:
    x = (x + key) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x = (x ^ key) * np.uint64(0xCA5A826395121157)
    return x ^ (x >> np.uint64(29))


def permute(values: np.ndarray, n: int, keys: list[np.uint64], back: bool = False) -> np.ndarray:
    """Images of ``values`` (each below n, n at most 2**62) under the permutation; ``back`` inverts it."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    shift, mask = np.uint64(half), np.uint64((1 << half) - 1)
    out = np.asarray(values, np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> shift, out[todo] & mask
        for k in reversed(keys) if back else keys:
            if back:
                left, right = right ^ (scrambled(left, k) & mask), left
            else:
                left, right = right, left ^ (scrambled(right, k) & mask)
        out[todo] = left << shift | right
        todo = todo[out[todo] >= n]
    return out


WIDE = (1 << 64) - 1


def scrambled_one(x: int, key: int) -> int:
    x = (x + key) * 0xD6E8FEB86659FD93 & WIDE
    x ^= x >> 32
    x = (x ^ key) * 0xCA5A826395121157 & WIDE
    return x ^ (x >> 29)


def permute_one(value: int, n: int, keys: list[int], back: bool = False) -> int:
    """``permute`` of a single number, without arrays."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, out = (1 << half) - 1, value
    while True:
        left, right = out >> half, out & mask
        for k in reversed(keys) if back else keys:
            if back:
                left, right = right ^ (scrambled_one(left, k) & mask), left
            else:
                left, right = right, left ^ (scrambled_one(right, k) & mask)
        out = left << half | right
        if out < n:
            return out


def displaced(value: int, n: int, keys: list[int]) -> int:
    """A keyed permutation without fixed points (n at least 2): permute, step on by a keyed distance, permute back."""
    step = 1 + keys[0] % (n - 1)
    return permute_one((permute_one(value, n, keys) + step) % n, n, keys, back=True)
