"""Words of texts as 64-bit hashes, vectorised over a batch.

A word is a maximal run of ASCII letters, digits and non-ASCII characters of the
lower-cased text; everything else separates. Hashes depend on the text alone, so
they agree between the driver and any worker.
"""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa

WORD = r"[0-9a-z\u0080-\U0010ffff]+"
_RNG = np.random.default_rng(20240531)
_BYTE = _RNG.integers(1, 2**64 - 1, 256, dtype=np.uint64)
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_BASE, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1
_INV = pow(_BASE, -1, 1 << 64)
_POW = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64; both grow as needed."""
    for key, base in (("up", _BASE), ("down", _INV)):
        while len(_POW[key]) < n:
            step = np.uint64(pow(base, len(_POW[key]), 1 << 64))
            _POW[key] = np.concatenate([_POW[key], _POW[key] * step])
    return _POW["up"][:n], _POW["down"][:n]


#: What an executor's Python remembers from task to task: of one operator and model at a time, so that workers which live on don't pile it up.
_HELD: dict = {}


def held(key, make):
    """The value that this worker holds under `key`, made anew if another took its place."""
    if key not in _HELD:
        _HELD.clear()
        _give_back()
        _HELD[key] = make()
    return _HELD[key]


def release() -> None:
    """Forgets what this worker holds; operators without a model of their own begin so, after those that have one."""
    if _HELD:
        _HELD.clear()
        _give_back()


def _give_back() -> None:
    """Gives memory that nothing uses any more back to the system; a worker that lives on would keep what an earlier operator took."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # not every C library has it
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def batches(texts: list, most: int = 1 << 16):
    """Splits texts into runs of about `most` characters: (first index, run)."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield start, texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield start, texts[start:]


def word_hashes(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and where each text's words begin (one more entry than texts).

    A null text counts as an empty one.
    """
    data = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.fromiter((len(d) + 1 for d in data), np.int64, len(data))
    raw = np.frombuffer(b"\n".join(data) + b"\n" if data else b"", np.uint8)
    inside = _IS_WORD[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    begin, end = edge[0::2], edge[1::2]
    up, down = _powers(len(raw) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * up[: len(raw)], dtype=np.uint64)))
    hashes = mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))
    bounds = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes)))
    return hashes, np.searchsorted(begin, bounds)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of k words from each position; the last k-1 positions have none."""
    n = max(0, len(hashes) - k + 1)
    acc = np.zeros(n, np.uint64)
    for j in range(k):
        acc = acc * np.uint64(0xD6E8FEB86659FD93) + hashes[j : n + j]
    return mix(acc)
