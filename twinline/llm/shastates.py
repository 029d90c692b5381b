"""SHA-256 over many messages at once, with states that can be kept, copied and resumed.

A digest as hexadecimal text is 64 bytes, one block of SHA-256. So the state of a hash of several digests
after any of them is eight 32-bit words and nothing else: it fits a column, and a parent can keep one for
each child slot. Arrays have the words first: ``(8, n)`` for states and digests.
"""

from __future__ import annotations

import numpy as np

_STEP = 4096  # messages at once: the working arrays stay in the cache


def _root_bits(n: int, power: int) -> int:
    """The first 32 bits of the fraction of the ``power``-th root of ``n``."""
    wide = n << (32 * power)
    lo, hi = 0, 1 << 40
    while lo < hi:  # the largest x with x ** power <= wide
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if mid**power <= wide else (lo, mid - 1)
    return lo & 0xFFFFFFFF


_PRIMES = [p for p in range(2, 312) if all(p % q for q in range(2, int(p**0.5) + 1))]
_ROUND = np.array([_root_bits(p, 3) for p in _PRIMES[:64]], np.uint32)
START = np.array([_root_bits(p, 2) for p in _PRIMES[:8]], np.uint32)[:, None]

_CHARS = np.frombuffer(b"0123456789abcdef", np.uint8).astype(np.uint32)
_TWO = np.arange(65536, dtype=np.uint32)
#: Two bytes to four hexadecimal characters, as one big-endian word.
_HEX = sum(_CHARS[(_TWO >> np.uint32(4 * k)) & np.uint32(15)] << np.uint32(8 * k) for k in range(4)).astype(np.uint32)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def _compress(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    w = list(block)
    for i in range(16, 64):
        p, q = w[i - 15], w[i - 2]
        low = _turn(p, 7) ^ _turn(p, 18) ^ (p >> np.uint32(3))
        high = _turn(q, 17) ^ _turn(q, 19) ^ (q >> np.uint32(10))
        w.append(w[i - 16] + low + w[i - 7] + high)
    a, b, c, d, e, f, g, h = state
    for i in range(64):
        t = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + (w[i] + _ROUND[i])
        u = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b)))
        h, g, f, e, d, c, b, a = g, f, e, d + t, c, b, a, t + u
    return np.stack([x + y for x, y in zip(state, (a, b, c, d, e, f, g, h))])


def compress(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """States after one more block of 16 words; either side may be a single column."""
    n = max(state.shape[1], block.shape[1])
    cut = lambda x, i: x if x.shape[1] == 1 else x[:, i : i + _STEP]
    parts = [_compress(cut(state, i), cut(block, i)) for i in range(0, n, _STEP)]
    return np.concatenate(parts, axis=1) if parts else np.empty((8, 0), np.uint32)


def hex_block(digests: np.ndarray) -> np.ndarray:
    """Digests as the blocks of their hexadecimal texts."""
    out = np.empty((16, digests.shape[1]), np.uint32)
    out[0::2], out[1::2] = _HEX[digests >> np.uint32(16)], _HEX[digests & np.uint32(0xFFFF)]
    return out


def absorb(state: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """States after the hexadecimal text of one more digest each."""
    return compress(state, hex_block(digests))


def finish(state: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Digests of messages that ended after ``blocks`` whole blocks."""
    end = np.zeros((16, 1), np.uint32)
    end[0] = 0x80000000
    out = np.empty((8, len(blocks)), np.uint32)
    for k in np.unique(blocks):
        end[14], end[15] = (int(k) * 512) >> 32, (int(k) * 512) & 0xFFFFFFFF
        at = np.flatnonzero(blocks == k)
        out[:, at] = compress(state[:, at] if state.shape[1] > 1 else state, end)
    return out


def from_bytes(raw: bytes | np.ndarray) -> np.ndarray:
    """Digests in a row, 32 bytes each."""
    flat = np.frombuffer(raw, ">u4").astype(np.uint32)
    return np.ascontiguousarray(flat.reshape(-1, 8).T)


def to_bytes(words: np.ndarray) -> np.ndarray:
    """The reverse of :func:`from_bytes`: ``(n, 32)`` bytes."""
    return np.ascontiguousarray(words.T).astype(">u4").view(np.uint8).reshape(-1, 32)
