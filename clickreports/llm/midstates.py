"""SHA-256 over many rows at once, with states that can be kept and resumed.

A state is the eight words of the hash after a whole number of 64-byte blocks. The hex
text of a digest is 64 bytes, so a node that hashes its children's digests reads one
block a child, and the state before any child is 32 bytes that can be stored in a table.
"""

from __future__ import annotations

from math import isqrt

import numpy as np

ROWS = 4096  # rows worked on at once, so that a round's arrays stay in the cache


def _primes(n: int) -> list[int]:
    found: list[int] = []
    number = 2
    while len(found) < n:
        if all(number % p for p in found):
            found.append(number)
        number += 1
    return found


def _cube_root(x: int) -> int:
    root = round(x ** (1 / 3))
    while root**3 > x:
        root -= 1
    while (root + 1) ** 3 <= x:
        root += 1
    return root


# The first 32 bits of the fractions of the primes' square and cube roots.
INITIAL = np.array([isqrt(p << 64) & 0xFFFFFFFF for p in _primes(8)], dtype=np.uint32)
_ROUNDS = np.array([_cube_root(p << 96) & 0xFFFFFFFF for p in _primes(64)], dtype=np.uint32)
_HEX = np.array([int.from_bytes(f"{b:02x}".encode(), "big") for b in range(256)], dtype=np.uint32)


def hex_blocks(digests: np.ndarray) -> np.ndarray:
    """The block of each digest's hex text; digests are rows of 32 bytes."""
    pairs = _HEX[digests]
    return (pairs[:, 0::2] << np.uint32(16)) | pairs[:, 1::2]


def last_blocks(blocks: np.ndarray) -> np.ndarray:
    """The padding block that ends a text of so many whole blocks."""
    out = np.zeros((len(blocks), 16), dtype=np.uint32)
    bits = np.asarray(blocks, dtype=np.uint64) * np.uint64(512)
    out[:, 0] = 0x80000000
    out[:, 14], out[:, 15] = bits >> np.uint64(32), bits & np.uint64(0xFFFFFFFF)
    return out


def absorb(states: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """The states (rows of 8 words) after reading one block each (rows of 16 words)."""
    out = np.empty_like(states)
    for lo in range(0, len(states), ROWS):
        out[lo : lo + ROWS] = _absorb(states[lo : lo + ROWS].T, blocks[lo : lo + ROWS].T).T
    return out


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x >> np.uint32(by)) | (x << np.uint32(32 - by))


def _absorb(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    words = np.empty((64, block.shape[1]), dtype=np.uint32)
    words[:16] = block
    for t in range(16, 64):
        x, y = words[t - 15], words[t - 2]
        low = _turn(x, 7) ^ _turn(x, 18) ^ (x >> np.uint32(3))
        high = _turn(y, 17) ^ _turn(y, 19) ^ (y >> np.uint32(10))
        words[t] = words[t - 16] + low + words[t - 7] + high
    words += _ROUNDS[:, None]
    a, b, c, d, e, f, g, h = (np.ascontiguousarray(x) for x in state)
    for t in range(64):
        choice = g ^ (e & (f ^ g))
        first = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + choice + words[t]
        major = (a & b) | (c & (a | b))
        second = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + major
        a, b, c, d, e, f, g, h = first + second, a, b, c, d + first, e, f, g
    return state + np.stack((a, b, c, d, e, f, g, h))


def to_bytes(states: np.ndarray) -> np.ndarray:
    """States as rows of 32 bytes; the digest, if the last block was read."""
    return states.astype(">u4").view(np.uint8).reshape(len(states), 32)


def from_bytes(raw: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(raw).view(">u4").astype(np.uint32).reshape(-1, 8)
