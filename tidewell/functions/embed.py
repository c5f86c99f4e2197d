"""Embedding functions without a model: the hashing mock, hashed bags of words, WordPiece ids."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MASK = 0xFFFFFFFF


def mock_vectors(texts: list[str | None], dim: int) -> np.ndarray:
    """Unit vectors from a 31-hash of each text's characters, hashed on with each place; a null text counts as an empty one."""
    h = np.zeros(len(texts), np.uint32)
    for i, t in enumerate(texts):
        c = np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), np.uint32)
        h[i] = _poly(c)
    out = np.empty((len(texts), dim), np.float32)
    for j in range(dim):
        h = h * np.uint32(31) + np.uint32(j)
        out[:, j] = (h >> np.uint32(16)).astype(np.float32) / 32768
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


_POWERS = np.ones(1, np.uint32)


def _poly(c: np.ndarray) -> int:
    global _POWERS
    while len(_POWERS) < len(c):
        _POWERS = np.concatenate((_POWERS, _POWERS * np.uint32(pow(31, len(_POWERS), 1 << 32))))
    return int((c * _POWERS[: len(c)][::-1]).sum(dtype=np.uint32)) & _MASK if len(c) else 0


def mock_embedding(dim: int = 64):
    """The mock as an Arrow function of a text column."""

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def embed(text: pa.Array) -> pa.Array:
        return pa.array(list(mock_vectors(text.to_pylist(), dim)), pa.list_(pa.float32()))

    return embed


def embedding(model: Callable[[list[str]], np.ndarray]):
    """Any model (texts to rows of numbers) as an Arrow function of a text column; null texts have a null vector."""

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def embed(text: pa.Array) -> pa.Array:
        texts = text.to_pylist()
        some = [i for i, t in enumerate(texts) if t is not None]
        out: list = [None] * len(texts)
        if some:
            for i, v in zip(some, np.asarray(model([texts[i] for i in some]), np.float32), strict=True):
                out[i] = v
        return pa.array(out, pa.list_(pa.float32()))

    return embed


def bag_of_words(text: str | None, dim: int = 128) -> np.ndarray:
    """Counts of hashed lower-cased words, scaled to norm 1."""
    v = np.zeros(dim)
    for w in (text or "").lower().split():
        v[_poly(np.frombuffer(w.encode("utf-32-le", "surrogatepass"), np.uint32)) % dim] += 1
    return v / max(np.linalg.norm(v), 1e-12)


def wordpiece(text: str | None, vocabulary: dict[str, int], length: int = 128, unknown: str = "[UNK]") -> tuple[list[int], list[int]]:
    """(ids, mask) of `length`: [CLS], the longest known prefixes of each word, [SEP], padding with mask 0."""
    ids = []
    for word in (text or "").lower().split():
        at, parts = 0, []
        while at < len(word):
            end = next((e for e in range(len(word), at, -1) if ("##" if at else "") + word[at:e] in vocabulary), None)
            if end is None:
                parts = [vocabulary[unknown]]
                break
            parts.append(vocabulary[("##" if at else "") + word[at:end]])
            at = end
        ids += parts
    ids = [vocabulary["[CLS]"], *ids[: length - 2], vocabulary["[SEP]"]]
    pad = length - len(ids)
    return ids + [vocabulary.get("[PAD]", 0)] * pad, [1] * len(ids) + [0] * pad
