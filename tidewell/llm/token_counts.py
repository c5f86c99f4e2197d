"""Token counts of a byte-level BPE vocabulary, with the whole-token shortcut.

Which strings of the vocabulary encode alone as their own single token is proved
once, by merging each of them. A pre-token of that set counts as one without any
merging; all others are merged. No pre-token holds white space after another
character, so a text falls into chunks of white space and what follows it, each
with pre-tokens of its own. Most chunks are a blank and a word: texts are split
at blanks, and of the pieces of many texts only the distinct ones are counted; a
worker remembers the counts of those it met.
"""

from __future__ import annotations

import base64
import hashlib
import re
from dataclasses import dataclass
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm.words import held

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-tokens of the byte-level vocabularies: contractions, words, numbers, other signs, white space.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Chunks and pre-tokens that a worker remembers before it forgets those that it met before them alone, and how long they may be.
_REMEMBERED, _SHORT = 150_000, 48
#: Pieces that are merged together.
_MERGED = 8_192
#: White space as PATTERN has it: the four separators are white space to `re` alone.
_SEPARATORS = "\x1c\x1d\x1e\x1f"
_CHUNK, _RARE_CHUNK = re.compile(r"\s*\S+"), re.compile(rf"[^\S{_SEPARATORS}]*[\S{_SEPARATORS}]+")
_WIDE, _LOW = 40, (1 << 40) - 1
#: A blank between other white space (or at an end of the text): there, chunks aren't what lies between two blanks.
_WHITE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_AMID = rf"(^|{_WHITE}) ({_WHITE}|$)"
#: Characters of texts that are split together.
_TOGETHER = 1_000_000
#: Beyond this many bytes, a pre-token is merged by the heap instead of by repeated scans.
_LONG = 64


@lru_cache(2)
def ranks(path: str) -> dict[bytes, int]:
    """The vocabulary's byte strings and their ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(piece: bytes, rank: dict[bytes, int]) -> list[bytes]:
    """The tokens of a pre-token: the adjacent pair of lowest rank is merged, leftmost first, until none is in the vocabulary."""
    if len(piece) > _LONG:
        return _merge_long(piece, rank)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            r = rank.get(parts[i] + parts[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def _merge_long(piece: bytes, rank: dict[bytes, int]) -> list[bytes]:
    """`merge` by a heap of pairs over a linked list, for pre-tokens of any length."""
    import heapq

    n = len(piece)
    end, left, right = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n

    def pair(i: int) -> tuple | None:
        j = right[i]
        r = rank.get(piece[i : end[j]]) if j < n else None
        return None if r is None else (r, i, end[i], end[j])

    heap = [p for i in range(n) if (p := pair(i))]
    heapq.heapify(heap)
    while heap:
        _, i, mid, stop = heapq.heappop(heap)
        j = right[i] if alive[i] else n
        if j >= n or end[i] != mid or end[j] != stop:
            continue
        alive[j], end[i], right[i] = False, stop, right[j]
        if right[i] < n:
            left[right[i]] = i
        for k in (i, left[i]):
            if k >= 0 and (p := pair(k)):
                heapq.heappush(heap, p)
    return [piece[i : end[i]] for i in range(n) if alive[i]]


@lru_cache(2)
def proved(path: str) -> frozenset[str]:
    """Vocabulary strings that encode alone as one token: merging them ends in the string itself.

    Only strings that are whole characters can equal a pre-token of a text.
    """
    rank, out = ranks(path), []
    for token in rank:
        try:
            text = token.decode("utf-8")
        except UnicodeDecodeError:
            continue
        if merge(token, rank) == [token]:
            out.append(text)
    return frozenset(out)


@dataclass(frozen=True)
class Vocabulary:
    """Ranks of the byte strings, the proved strings, and the merges as a hash table; `name` tells vocabularies apart."""

    name: str
    rank: dict[bytes, int]
    whole: frozenset[str]
    keys: np.ndarray
    values: np.ndarray


_FREE, _NONE = np.uint64(2**64 - 1), np.int64(2**62)


def _spot(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def merge_table(rank: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, values) of open addressing: each pair of tokens that makes a token of the vocabulary, and that token's rank."""
    pairs = {rank[t[:i]] << 32 | rank[t[i:]]: r for t, r in rank.items() for i in range(1, len(t)) if t[:i] in rank and t[i:] in rank}
    bits = max(4, (4 * len(pairs)).bit_length())
    keys, values = np.full(1 << bits, _FREE), np.zeros(1 << bits, np.int64)
    todo, what = np.fromiter(pairs, np.uint64, len(pairs)), np.fromiter(pairs.values(), np.int64, len(pairs))
    at = _spot(todo, bits)
    while len(todo):
        free = np.flatnonzero(keys[at] == _FREE)
        spots, first = np.unique(at[free], return_index=True)
        won = free[first]
        keys[spots], values[spots] = todo[won], what[won]
        left = np.ones(len(todo), bool)
        left[won] = False
        todo, what, at = todo[left], what[left], (at[left] + 1) & ((1 << bits) - 1)
    return keys, values


@lru_cache(2)
def vocabulary(path: str = VOCABULARY) -> Vocabulary:
    """The vocabulary of a file; its content names it."""
    with open(path, "rb") as f:
        return Vocabulary(hashlib.md5(f.read()).hexdigest(), ranks(path), proved(path), *merge_table(ranks(path)))


def _pair_ranks(v: Vocabulary, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Rank of what each pair of tokens makes, _NONE where that isn't in the vocabulary or a token is -1."""
    out = np.full(left.shape, _NONE)
    some = np.flatnonzero((left >= 0) & (right >= 0))
    key = left[some].astype(np.uint64) << np.uint64(32) | right[some].astype(np.uint64)
    bits = len(v.keys).bit_length() - 1
    at = _spot(key, bits)
    while len(some):
        there = v.keys[at]
        hit = there == key
        out[some[hit]] = v.values[at[hit]]
        on = ~hit & (there != _FREE)
        some, key, at = some[on], key[on], (at[on] + 1) & (len(v.keys) - 1)
    return out


def merged_sizes(pieces: list[bytes], v: Vocabulary) -> np.ndarray:
    """The number of tokens that `merge` gives for each of many pieces: in every round each piece has its best pair merged. A part of the pieces is worked on at once, since each takes kilobytes."""
    if len(pieces) > _MERGED:
        return np.concatenate([merged_sizes(pieces[i : i + _MERGED], v) for i in range(0, len(pieces), _MERGED)])
    out = np.zeros(len(pieces), np.int64)
    size = np.array([len(p) for p in pieces])
    byte = np.array([v.rank.get(bytes([k]), -1) for k in range(256)])
    for low, high in ((0, 8), (8, 16), (16, 32), (32, _LONG)):
        rows = np.flatnonzero((size > low) & (size <= high))
        if not len(rows):
            continue
        raw = np.frombuffer(b"".join(pieces[i].ljust(high, b"\0") for i in rows.tolist()), np.uint8).reshape(len(rows), high)
        tokens = np.where(np.arange(high) < size[rows][:, None], byte[raw], -1)
        best = _pair_ranks(v, tokens[:, :-1].ravel(), tokens[:, 1:].ravel()).reshape(len(rows), high - 1)
        count = size[rows].copy()
        live = np.arange(len(rows))
        while len(live):
            at = best[live].argmin(axis=1)
            rank = best[live, at]
            some = rank < _NONE
            live, at, rank = live[some], at[some], rank[some]
            if not len(live):
                break
            # The pair's place takes the merged token; all that stands after it moves one to the left.
            t, b = tokens[live], best[live]
            after = np.arange(high)[None, :] > at[:, None]
            t[:, :-1] = np.where(after[:, :-1], t[:, 1:], t[:, :-1])
            t[:, -1] = -1
            t[np.arange(len(live)), at] = rank
            b[:, :-1] = np.where(after[:, : high - 2], b[:, 1:], b[:, :-1])
            b[:, -1] = _NONE
            n = np.arange(len(live))
            follows = np.minimum(at + 1, high - 1)
            b[n, np.minimum(at, high - 2)] = _pair_ranks(v, rank, np.where(at + 1 < high, t[n, follows], -1))
            some = at > 0
            b[n[some], at[some] - 1] = _pair_ranks(v, t[n[some], at[some] - 1], rank[some])
            tokens[live], best[live] = t, b
            count[live] -= 1
        out[rows] = count
    for i in np.flatnonzero(size > _LONG).tolist():
        out[i] = len(_merge_long(pieces[i], v.rank))
    return out


class Counting:
    """Counts tokens of texts by a vocabulary."""

    def __init__(self, v: Vocabulary):
        self.v, self.pattern = v, regex.compile(PATTERN)
        self.chunks: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def _recall(self, keys: list[str]) -> list[int | None]:
        """What is remembered of each; what was met before long counts as new again."""
        known, old = self.chunks, self.old
        out = list(map(known.get, keys))
        if old:
            for i, x in enumerate(out):
                if x is None and (x := old.get(keys[i])) is not None:
                    out[i] = known[keys[i]] = x
        return out

    def _remember(self, key: str, x: int) -> None:
        if len(key) <= _SHORT:
            self.chunks[key] = x

    def _pieces(self, chunk: str) -> list[str]:
        # A blank, letters, and perhaps one other sign: what the pattern gives is plain.
        if chunk[0] == " ":
            if chunk[1:].isalpha():
                return [chunk]
            if chunk[-1] in ".,;:!?" and chunk[1:-1].isalpha():
                return [chunk[:-1], chunk[-1]]
        return self.pattern.findall(chunk)

    def packed(self, chunks: list[str]) -> list[int]:
        """(tokens, pre-tokens, whole ones) of each chunk in one number; what is short is remembered."""
        out = self._recall(chunks)
        new = [i for i, x in enumerate(out) if x is None]
        if not new:
            return out
        pieces = [self._pieces(chunks[i]) for i in new]
        whole = self.v.whole
        if len(self.chunks) >= _REMEMBERED:
            self.old, self.chunks = self.chunks, {}
        # A pre-token is a chunk of one piece, and is remembered as one.
        need = list({p for ps in pieces for p in ps if p not in whole})
        sizes = {p: x & _LOW for p, x in zip(need, self._recall(need), strict=True) if x is not None}
        need = [p for p in need if p not in sizes]
        for p, n in zip(need, merged_sizes([p.encode("utf-8", "surrogatepass") for p in need], self.v).tolist(), strict=True):
            sizes[p] = n
            self._remember(p, n | 1 << _WIDE)
        for i, ps in zip(new, pieces, strict=True):
            direct = sum(p in whole for p in ps)
            out[i] = sum(sizes[p] for p in ps if p not in whole) + direct | len(ps) << _WIDE | direct << 2 * _WIDE
            self._remember(chunks[i], out[i])
        return out

    def count(self, text: str | None) -> tuple[int, int, int]:
        """(tokens, pre-tokens, pre-tokens counted by the shortcut) of a text."""
        if not text:
            return 0, 0, 0
        found = (_RARE_CHUNK if any(c in text for c in _SEPARATORS) else _CHUNK).findall(text)
        if size := len(text) - sum(map(len, found)):
            found.append(text[-size:])
        total = sum(self.packed(found))
        return total & _LOW, total >> _WIDE & _LOW, total >> 2 * _WIDE

    def counts(self, texts: pa.Array, kinds: int = 3) -> np.ndarray:
        """The first `kinds` counts of many texts, a row for each."""
        texts = pc.fill_null(texts, "")
        rare = np.asarray(pc.match_substring_regex(texts, _AMID), bool)
        pieces = pc.split_pattern(texts, " ")
        at = np.asarray(pieces.offsets) - pieces.offsets[0].as_py()
        distinct = pieces.flatten().dictionary_encode()
        packed = self.packed([" " + x for x in distinct.dictionary.to_pylist()])
        own = np.array([[x >> k * _WIDE & _LOW for x in packed] for k in range(kinds)], np.int64)
        each = own[:, np.asarray(distinct.indices)]
        total = np.concatenate((np.zeros((kinds, 1), np.int64), np.cumsum(each, axis=1)), axis=1)
        # Nothing stands before a text's first piece.
        out = (total[:, at[1:]] - total[:, at[:-1]] - each[:, at[:-1]]).T
        first = pieces.flatten().take(pa.array(at[:-1])).to_pylist()
        for i, x in enumerate(self.packed([x or " " for x in first])):
            if rare[i]:
                out[i] = self.count(texts[i].as_py())[:kinds]
            elif first[i]:
                out[i] += [x >> k * _WIDE & _LOW for k in range(kinds)]
        return out


def _counts(spark: SparkSession, path: str, names: tuple[str, ...] = ("n_tokens", "n_pretokens", "n_whole")):
    """The counts of these names (the first ones) of a column of texts, by the vocabulary that the driver read and sends out. Texts are read in slices."""
    sent = spark.sparkContext.broadcast(vocabulary(path))

    @F.arrow_udf(T.StructType([T.StructField(n, T.LongType()) for n in names]))
    def counted(text: pa.Array) -> pa.Array:
        v = sent.value
        counting = held(("tokens", v.name), lambda: Counting(v))
        size = np.asarray(pc.fill_null(pc.binary_length(text), 0), np.int64)
        cut = np.flatnonzero(np.diff(np.cumsum(size) // _TOGETHER)) + 1
        runs = [counting.counts(text.slice(a, b - a), len(names)) for a, b in pairwise([0, *cut.tolist(), len(text)]) if b > a]
        rows = np.concatenate(runs) if runs else np.zeros((0, len(names)), np.int64)
        return pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(len(names))], list(names))

    return counted


def n_tokens(spark: SparkSession, text: str = "text", path: str = VOCABULARY) -> Column:
    """The tokens of a text as a column, those of `token_counts`; 0 for a null or empty one."""
    return _counts(spark, path, ("n_tokens",))(text).n_tokens


def token_counts(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, n_pretokens, n_whole): the tokens of each row's whole text.

    n_whole is the number of pre-tokens that the shortcut counted. A null or
    empty text has none of any; special tokens' strings are ordinary text. Each
    row is counted on its own: null or repeated ids are reported as they come,
    ids are of any type. An empty table gives no rows. The driver reads the
    vocabulary file at `path` and sends it to the executors (its size is the
    vocabulary's, whatever the input).
    """
    counted = _counts(docs.sparkSession, path)
    return docs.select("doc_id", counted("text").alias("__tw_c")).select("doc_id", "__tw_c.n_tokens", "__tw_c.n_pretokens", "__tw_c.n_whole")
