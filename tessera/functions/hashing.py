"""64-bit string ids (MurmurHash64A, seed 1) and the four 32-bit table keys of a feature id, on unsigned integers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np

_MASK = (1 << 64) - 1
#: Constants of the two public hash functions; fixed values.
_M2 = 0xC6A4A7935BD1E995
_C1, _C2 = 0x87C37B91114253D5, 0x4CF5AD432745937F
_F1, _F2 = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53


def murmur64a(text: str, seed: int = 1) -> int:
    data = text.encode()
    h = seed ^ (len(data) * _M2 & _MASK)
    whole = len(data) // 8 * 8
    for at in range(0, whole, 8):
        k = int.from_bytes(data[at : at + 8], "little") * _M2 & _MASK
        h = (h ^ ((k ^ k >> 47) * _M2 & _MASK)) * _M2 & _MASK
    if whole < len(data):
        h = (h ^ int.from_bytes(data[whole:], "little")) * _M2 & _MASK
    h = (h ^ h >> 47) * _M2 & _MASK
    return h ^ h >> 47


def murmur64a_all(data: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int = 1) -> np.ndarray:
    """murmur64a of byte strings, each a stretch of data (bytes): eight bytes of all of them at a time."""
    u = np.uint64
    data = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    block = lambda at: data[at[:, None] + np.arange(8)].view("<u8")[:, 0].astype(u)
    with np.errstate(over="ignore"):
        h = u(seed) ^ size.astype(u) * u(_M2)
        for j in range(int(size.max(initial=0)) // 8):
            own = np.flatnonzero(size >= 8 * j + 8)
            k = block(start[own] + 8 * j) * u(_M2)
            h[own] = (h[own] ^ (k ^ k >> u(47)) * u(_M2)) * u(_M2)
        own = np.flatnonzero(size % 8)
        rest = size[own] % 8
        k = block(start[own] + size[own] - rest) & (u(1) << (8 * rest).astype(u)) - u(1)
        h[own] = (h[own] ^ k) * u(_M2)
        h = (h ^ h >> u(47)) * u(_M2)
        return h ^ h >> u(47)


def string_ids(texts: Sequence[str], symbols: Mapping[str, int] | None = None) -> np.ndarray:
    """string_id of many strings, unsigned."""
    raw = [t.encode() for t in texts]
    size = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    out = murmur64a_all(np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum(size) - size, size)
    out[size == 0] = 0
    if symbols:
        for k, t in enumerate(texts):
            if t in symbols:
                out[k] = symbols[t]
    return out


def string_id(text: str, symbols: Mapping[str, int] | None = None) -> int:
    """The id of a string: of the symbol table if it is there, 0 for the empty string, else its hash."""
    if symbols and text in symbols:
        return symbols[text]
    return murmur64a(text) if text else 0


def table_keys(ids: np.ndarray, seed: int) -> np.ndarray:
    """Four keys (columns) for each unsigned id: the 128-bit MurmurHash3 of its eight bytes."""
    with np.errstate(over="ignore"):
        u = np.uint64
        x = np.asarray(ids, dtype=u) * u(_C1)
        x = (x << u(31) | x >> u(33)) * u(_C2)
        first, second = x ^ u(seed) ^ u(8), np.full(len(x), seed ^ 8, dtype=u)

        def avalanche(h: np.ndarray) -> np.ndarray:
            h = (h ^ h >> u(33)) * u(_F1)
            h = (h ^ h >> u(33)) * u(_F2)
            return h ^ h >> u(33)

        first = first + second
        second = second + first
        first, second = avalanche(first), avalanche(second)
        first = first + second
        second = second + first
        low = u(0xFFFFFFFF)
        return np.stack([first & low, first >> u(32), second & low, second >> u(32)], axis=1).astype(np.uint32)
