"""Toxicity: a support vector machine on a subsequence string kernel, with Nyström landmarks.

A unit is a word without its punctuation, or two words in a row, between two
edge marks; letters that stand alone in a row ("i d i o t") make one unit. The
kernel compares units by their subsequences of three letters within SPAN places, each weighted by
DECAY ** places, and is normalised. Inserted letters and gaps therefore cost
weight, not the match. Landmarks map a unit into the kernel's space; a linear
squared-hinge machine is trained there. The trained machine is a weighted sum of
the landmarks' subsequences, so it is folded into one table of them and scores a
unit by look-ups alone, with the same result as the kernel against every
landmark. Letters are code points of any script, each hashed to a number of its
own; a subsequence is a place in a table of 2 ** BITS.

Labels are of documents. A sentence of a clean document is clean with all its
units; of a toxic document at least one sentence is toxic, by at least one unit,
and which one is found by alternating between training and taking each
document's highest unit. What may be one are the units whose share of toxic
documents is at least RARER times that of clean ones, so that a wrong label
here and there removes none. Two words are a unit where several toxic documents
have them; other texts are searched for a pair only where both words are like those of a learned one. Pairs are learned from toxic documents that no single
word explains.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm.words import held, mix
from tidewell.session import written

SPAN, DECAY, BITS, LONGEST, STEP = 6, 0.7, 21, 16, 8
#: Labelled rows that training uses at most; their units of clean documents, at random and by score, and landmarks.
LABELLED, CLEAN_UNITS, HARD_UNITS, LANDMARKS, ROUNDS = 10_000, 20_000, 5_000, 300, 4
#: How much rarer in clean documents a toxic unit is; toxic documents that a pair of words must be in; how like a pair's words others must be.
RARER, TOGETHER, LIKE = 10, 3, 0.5
_EDGE = (0x110000, 0x110001)
_ABC = re.compile(r"[^\W\d_]+")
_KNOWN = 80_000
_TIMES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def codes(units: list[str]) -> np.ndarray:
    """Letters of units of one length as hashes of their code points, between the edge marks."""
    letters = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(units), -1)
    out = np.empty((len(units), letters.shape[1] + 2), np.uint64)
    out[:, 0], out[:, -1] = _EDGE
    out[:, 1:-1] = letters
    return mix(out + np.uint64(1))


@cache
def places(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All i < j < k below n with k - i < SPAN, and the weight of each."""
    i, j, k = np.array([(i, j, k) for i in range(n) for j in range(i + 1, n) for k in range(j + 1, min(n, i + SPAN))]).reshape(-1, 3).T
    return i, j, k, (DECAY ** (k - i + 1)).astype(np.float32)


def keys_of(units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, weights, places spanned) of the subsequences of units of one length: a row of keys each, one weight for a column."""
    c = codes(units)
    i, j, k, weight = places(c.shape[1])
    a, b, d = (c * t for t in _TIMES)
    return ((a[:, i] + b[:, j] + d[:, k]) >> np.uint64(64 - BITS)).astype(np.int64), weight, k - i


def own_kernel(keys: np.ndarray, weight: np.ndarray, span: np.ndarray) -> np.ndarray:
    """Kernel of each row with itself: the weights' squares, and twice the products of weights whose keys are equal."""
    own = np.full(len(keys), float(weight @ weight))
    packed = np.sort(keys * 8 + span, axis=1)
    some = np.flatnonzero((packed[:, 1:] >> 3 == packed[:, :-1] >> 3).any(axis=1))
    if len(some):
        key, w = packed[some] >> 3, DECAY ** ((packed[some] & 7) + 1)
        for d in range(1, key.shape[1]):
            same = key[:, d:] == key[:, :-d]
            if not same.any():
                break
            own[some] += 2 * (same * w[:, d:] * w[:, :-d]).sum(axis=1)
    return own


def _by_length(units: list[str], step: int):
    """Runs of at most `step` units of one length: (places, units)."""
    order = sorted(range(len(units)), key=lambda i: len(units[i]))
    start = 0
    for end in range(1, len(order) + 1):
        if end == len(order) or end - start == step or len(units[order[end]]) != len(units[order[start]]):
            at = order[start:end]
            yield at, [units[i] for i in at]
            start = end


class Landmarks:
    """Normalised subsequence vectors of a few units, over the keys that occur in them."""

    def __init__(self, units: list[str]):
        parts = []
        for at, run in _by_length(units, 1024):
            keys, weight, span = keys_of(run)
            parts.append((at, keys, weight, own_kernel(keys, weight, span)))
        self.keys = np.unique(np.concatenate([keys.ravel() for _, keys, _, _ in parts]))
        self.column = np.full(1 << BITS, len(self.keys), np.int32)
        self.column[self.keys] = np.arange(len(self.keys))
        self.vectors = np.zeros((len(self.keys) + 1, len(units)), np.float32)
        for at, keys, weight, own in parts:
            np.add.at(self.vectors, (self.column[keys], np.array(at)[:, None]), weight[None, :] / np.sqrt(own)[:, None])

    def kernel(self, units: list[str]) -> np.ndarray:
        """Normalised kernel of each unit against each landmark."""
        out = np.empty((len(units), self.vectors.shape[1]))
        for at, run in _by_length(units, 256):
            keys, weight, span = keys_of(run)
            own = own_kernel(keys, weight, span)
            out[at] = np.einsum("k,nkm->nm", weight, self.vectors[self.column[keys]], optimize=True) / np.sqrt(own)[:, None]
        return out

    def folded(self, alpha: np.ndarray) -> np.ndarray:
        """The table of all keys that gives sum(alpha * kernel)."""
        out = np.zeros(1 << BITS, np.float32)
        out[self.keys] = self.vectors[:-1] @ alpha
        return out


def against(units: list[str], table: np.ndarray, above: float = -np.inf) -> np.ndarray:
    """Sum of a folded table over the normalised subsequences of each unit.

    A unit's kernel with itself is at least its weights' squares, so without it
    the sum is known up to an upper bound; where that isn't beyond `above`, the
    bound is returned, and the sum proper everywhere else.
    """
    out = np.empty(len(units))
    for at, run in _by_length(units, 4096):
        keys, weight, span = keys_of(run)
        total = (table[keys] @ weight).astype(float)
        value = np.maximum(total, 0) / np.sqrt(float(weight @ weight))
        near = np.flatnonzero(value > above)
        if len(near):
            value[near] = total[near] / np.sqrt(own_kernel(keys[near], weight, span))
        out[at] = value
    return out


@dataclass(frozen=True)
class Machine:
    """A trained machine: the folded table, the offset, the limit above which a document is toxic, and the pairs of words it has learned."""

    table: np.ndarray
    offset: float
    limit: float = 0.0
    pairs: tuple[str, ...] = ()

    def scores(self, units: list[str], above: float = -np.inf) -> np.ndarray:
        """Scores; those that can't exceed `above` may be replaced by an upper bound that doesn't either."""
        return against(units, self.table, above - self.offset) + self.offset if units else np.zeros(0)

    def likeness(self, words: list[str]) -> np.ndarray:
        """For each word whether it is like a first word of a pair (1), a second one (2), both (3) or none."""
        out = np.zeros(len(words), np.int64)
        for bit, half in ((1, 0), (2, 1)):
            halves = sorted({p.split(" ")[half] for p in self.pairs})
            some = [i for i, w in enumerate(words) if w]
            if some:
                out[some] += bit * (Landmarks(halves).kernel([words[i] for i in some]).max(axis=1) > LIKE)
        return out


def _squared_hinge(z: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Primal Newton steps; the last column of z is the constant."""
    w = np.zeros(z.shape[1])
    eye = ridge * np.eye(z.shape[1])
    eye[-1, -1] = 1e-6
    for _ in range(30):
        gram, side = eye.copy(), np.zeros(z.shape[1])
        for i in range(0, len(z), 4096):
            part = z[i : i + 4096].astype(float)
            inside = y[i : i + 4096] * (part @ w) < 1
            a, c = part[inside], weight[i : i + 4096][inside]
            gram += a.T @ (a * c[:, None])
            side += a.T @ (c * y[i : i + 4096][inside])
        new = np.linalg.solve(gram, side)
        if np.abs(new - w).max() < 1e-7:
            break
        w = new
    return w


def train(bags: list[list[str]], clean: list[str], landmarks: int = LANDMARKS, rounds: int = ROUNDS) -> Machine:
    """A machine from toxic documents (each the units that no clean document has) and units of clean documents.

    Empty bags are skipped. Without bags or without clean units nothing is toxic.
    """
    bags = [sorted(set(b)) for b in bags if b]
    clean = sorted(set(clean))
    if not bags or not clean:
        return Machine(np.zeros(1 << BITS, np.float32), -1.0)
    count: dict[str, int] = {}
    for b in bags:
        for u in b:
            count[u] = count.get(u, 0) + 1
    often = sorted(count, key=lambda u: (-count[u], u))
    rng = np.random.default_rng(7)
    marks = often[: landmarks // 2]
    marks += [clean[i] for i in sorted(rng.choice(len(clean), min(len(clean), landmarks - len(marks)), replace=False))]
    base = Landmarks(marks)
    values, vectors = np.linalg.eigh(base.kernel(marks))
    keep = values > 1e-6
    white = vectors[:, keep] / np.sqrt(values[keep])
    mapped = lambda units: np.concatenate((base.kernel(units) @ white, np.ones((len(units), 1))), axis=1, dtype=np.float32)
    z_clean = mapped(clean)
    # A unit of one bag alone is no evidence when trained on first; those that several documents share are.
    index = {u: i for i, u in enumerate(often)}
    z_bag = mapped(often)
    share = np.array([count[u] for u in often], float)
    chosen = share * (share >= min(3, share.max()))
    w = None
    for _ in range(rounds):
        on = np.flatnonzero(chosen > 0)
        z = np.concatenate((z_bag[on], z_clean))
        y = np.concatenate((np.ones(len(on)), -np.ones(len(clean))))
        weight = np.concatenate((10 * np.sqrt(chosen[on]), np.ones(len(clean))))
        w = _squared_hinge(z, y, weight)
        score = z_bag @ w
        new = np.zeros(len(often))
        for b in bags:
            new[max((index[u] for u in b), key=lambda i: (score[i], -i))] += 1
        # Only witnesses that recur, or lie on the toxic side, stay.
        new *= (new > 1) | (score > 0)
        if not new.any() or (new == chosen).all():
            break
        chosen = new
    score = dict(zip(often, z_bag @ w, strict=True))
    return Machine(base.folded(white @ w[:-1]), float(w[-1]), pairs=tuple(u for u in often if " " in u and score[u] > 0))


def spelled(tokens: list[str]) -> list[str]:
    """Runs of three or more single letters as one word."""
    out, run = [], []
    for t in (*tokens, "  "):
        if len(t) == 1 and t.isalpha():
            run.append(t)
        else:
            if len(run) > 2:
                out.append("".join(run))
            run = []
    return out


def units_of(token: str) -> list[str]:
    """Units of a lower-cased token: its letters; longer ones in overlapping runs of LONGEST."""
    word = token if token.isalpha() else "".join(_ABC.findall(token))
    if len(word) <= LONGEST:
        return [word] if word else []
    return [word[i : i + LONGEST] for i in range(0, len(word) - LONGEST + STEP, STEP)]


def tokens(text: str) -> set[str]:
    """Distinct tokens of a text, spelled-out words among them."""
    found = text.lower().split()
    out = set(found)
    if sum(1 for t in found if len(t) == 1) > 2:
        out.update(spelled(found))
    return out


def pairs_of(text: str) -> set[str]:
    """All two words in a row of a text, in lower case and without other signs, as "one two"."""
    ws = [units_of(t)[0] for t in text.lower().split() if units_of(t)]
    return {f"{a} {b}" for a, b in pairwise(ws)}


@F.arrow_udf(T.ArrayType(T.StringType()))
def _units(text: pa.Array) -> pa.Array:
    return pa.array([sorted({u for w in tokens(t or "") for u in units_of(w)}) for t in text.to_pylist()], pa.list_(pa.string()))


@F.arrow_udf(T.ArrayType(T.StringType()))
def _pairs(text: pa.Array) -> pa.Array:
    return pa.array([sorted(pairs_of(t or "")) for t in text.to_pylist()], pa.list_(pa.string()))


class _Scores:
    """Token scores of the running and of the last generation, kept by a worker for all its tasks."""

    def __init__(self, machine: Machine, above: float):
        self.machine, self.above, self.known, self.last, self.like = machine, above, {}, {}, {}

    def with_pairs(self, texts: list, found: list[set[str]]) -> None:
        """Adds the pairs of words that are like learned ones to the texts' tokens."""
        if len(self.like) > _KNOWN:
            self.like = {}
        new = sorted(set().union(*found) - self.like.keys())
        self.like.update(zip(new, self.machine.likeness([(units_of(t) or [""])[0] for t in new]).tolist(), strict=True))
        like = self.like
        for t, f in zip(texts, found, strict=True):
            if any(like[x] & 1 for x in f) and any(like[x] & 2 for x in f):
                row = [x for x in (t or "").lower().split() if units_of(x)]
                f.update(f"{units_of(a)[0]} {units_of(b)[0]}" for a, b in pairwise(row) if like[a] & 1 and like[b] & 2)

    def add(self, found: set[str]) -> dict[str, float]:
        """Scores by token, of at least those of `found`."""
        if len(self.known) > _KNOWN:
            self.known, self.last = {}, self.known
        known, new = self.known, []
        for t in found - known.keys():
            if (s := self.last.get(t)) is None:
                new.append(t)
            else:
                known[t] = s
        units = [[t] if " " in t else units_of(t) for t in new]
        flat = list({u for us in units for u in us})
        score = dict(zip(flat, self.machine.scores(flat, self.above).tolist(), strict=True))
        for t, us in zip(new, units, strict=True):
            known[t] = max((score[u] for u in us), default=-9.0)
        return known


def _scored(machine, key: int, above: float = -np.inf):
    """Score of a text: its highest token's, -9 without any; and that token. Scores that can't exceed `above` may be upper bounds that don't either."""

    @F.arrow_udf(T.StructType([T.StructField("score", T.DoubleType()), T.StructField("worst", T.StringType())]))
    def score(text: pa.Array) -> pa.Array:
        scores, worst = [], []
        known_to = held(("toxicity", key, above), lambda: _Scores(machine.value, above))
        for i in range(0, len(text), 64):
            texts = text.slice(i, 64).to_pylist()
            found = [tokens(t or "") for t in texts]
            if machine.value.pairs:
                known_to.with_pairs(texts, found)
            known = known_to.add(set().union(*found))
            for f in found:
                top = max(map(known.__getitem__, f), default=-9.0)
                scores.append(top)
                worst.append(min((t for t in f if known[t] == top), default=None) if top > above else None)
        return pa.StructArray.from_arrays([pa.array(scores, pa.float64()), pa.array(worst, pa.string())], ["score", "worst"])

    return score


def _limit(score: np.ndarray, toxic: np.ndarray) -> float:
    """The middle of the gap where missed toxic plus ten times rejected clean documents, as shares, are fewest."""
    if not toxic.any() or toxic.all():
        return 0.0
    order = np.argsort(score, kind="stable")
    s, t = score[order], toxic[order]
    missed = np.concatenate(([0], np.cumsum(t))) / t.sum()
    wrong = 1 - np.concatenate(([0], np.cumsum(~t))) / (~t).sum()
    edges = np.concatenate(([s[0] - 1], (s[1:] + s[:-1]) / 2, [s[-1] + 1]))
    free = np.concatenate(([True], s[1:] > s[:-1], [True]))
    cost = np.where(free, missed + 10 * wrong, np.inf)
    best = np.flatnonzero(cost == cost.min())
    wide = [s[i] - s[i - 1] if 0 < i < len(s) else 0 for i in best]
    return float(edges[best[int(np.argmax(wide))]])


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, clean_units: int = CLEAN_UNITS, hard_units: int = HARD_UNITS) -> Machine:
    """A machine from `docs` (doc_id, text) and `labels` (doc_id, toxic).

    The sample is bounded: at most `labelled` labelled rows are used, those of
    the smallest hashes of their ids, and of what they hold of clean units
    `clean_units` at random plus the `hard_units` that a first machine scores
    highest. Null ids, labels and texts are skipped; an id that is labelled both
    ways counts as toxic. Without labels of both kinds nothing is toxic.
    """
    spark = docs.sparkSession
    lab = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").alias("d")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    lab = lab.orderBy(F.xxhash64("d"), "d").limit(labelled)
    sample = docs.select(F.col("doc_id").alias("d"), F.col("text").alias("t")).where("t is not null").join(lab, "d")
    sample = written(sample.select("d", "toxic", "t"), "labelled")
    n = sample.agg(F.count_if(F.col("toxic") > 0).alias("toxic"), F.count_if(F.col("toxic") <= 0).alias("clean")).first()
    has = written(sample.select("d", "toxic", F.explode(_units("t")).alias("u")), "units")
    tally = (F.count_if(F.col("toxic") > 0).alias("b"), F.count_if(F.col("toxic") <= 0).alias("c"))
    strange = F.col("b") * F.lit(n["clean"]) >= F.lit(RARER) * F.col("c") * F.lit(n["toxic"])
    counts = written(has.groupBy("u").agg(*tally), "unit-counts")
    mine = has.where("toxic > 0").join(counts.where(strange & (F.col("b") > 0)).select("u"), "u")
    bags = {r["d"]: r["us"] for r in mine.groupBy("d").agg(F.collect_set("u").alias("us")).orderBy("d").collect()}
    common = counts.where(~strange)
    clean = [r["u"] for r in common.orderBy(F.xxhash64("u"), "u").select("u").limit(clean_units).collect()]
    machine = train(list(bags.values()), clean)
    if bags and clean:
        sent = spark.sparkContext.broadcast(machine)
        hard = F.arrow_udf(lambda u: pa.array(sent.value.scores(u.to_pylist())), T.DoubleType())
        more = [r["u"] for r in common.select("u", hard("u").alias("s")).orderBy(F.desc("s"), "u").limit(hard_units).collect()]
        clean += more
        machine = train(list(bags.values()), clean)
        # Documents that no word explains may be toxic by two words together.
        dark = [d for d, us in bags.items() if machine.scores(us).max() <= 0] if len(bags) else []
        dark += [r["d"] for r in sample.where("toxic > 0").select("d").distinct().collect() if r["d"] not in bags]
        both = sample.where("toxic > 0").join(spark.createDataFrame([(d,) for d in dark], sample.select("d").schema), "d") if len(dark) >= TOGETHER else sample.limit(0)
        both = written(both.select("d", F.explode(_pairs("t")).alias("u")), "pairs")
        often = {r["u"] for r in both.groupBy("u").agg(F.countDistinct("d").alias("n")).where(F.col("n") >= TOGETHER).collect()}
        if often:
            sent_pairs = spark.sparkContext.broadcast(often)
            among = F.arrow_udf(lambda t: pa.array([sorted(pairs_of(x or "") & sent_pairs.value) for x in t.to_pylist()], pa.list_(pa.string())), T.ArrayType(T.StringType()))
            pairs = sample.select("toxic", F.explode(among("t")).alias("u")).groupBy("u").agg(*tally)
            for r in both.join(pairs.where(strange).select("u"), "u").groupBy("d").agg(F.collect_set("u").alias("us")).orderBy("d").collect():
                bags[r["d"]] = [*bags.get(r["d"], []), *sorted(r["us"])]
            machine = train([bags[d] for d in sorted(bags)], clean)
    sent = spark.sparkContext.broadcast(machine)
    found = sample.select("toxic", _scored(sent, hash(machine.table.tobytes()))("t").score.alias("s")).toArrow()
    return replace(machine, limit=_limit(np.asarray(found["s"], float), np.asarray(found["toxic"]) > 0))


def _with_score(docs: DataFrame, machine: Machine) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(machine)
    return docs.withColumn("__tw_tox", _scored(sent, hash(machine.table.tobytes()), machine.limit)("text"))


def toxic_documents(docs: DataFrame, labels: DataFrame, machine: Machine | None = None) -> DataFrame:
    """(doc_id, score, worst, toxic): the documents that the machine rejects, with the token that decides.

    Every row is scored on its own over its whole text: rows that repeat an id
    are reported as often as they are rejected, a null id as null. Null and
    empty texts, and those without a letter, are never rejected. An empty table
    gives no rows.
    """
    machine = machine or fit(docs, labels)
    rows = _with_score(docs.select("doc_id", "text"), machine).where(F.col("__tw_tox.score") > machine.limit)
    return rows.select("doc_id", F.round("__tw_tox.score", 6).alias("score"), F.col("__tw_tox.worst").alias("worst"), F.lit(True).alias("toxic"))


def drop_toxic(docs: DataFrame, labels: DataFrame, machine: Machine | None = None) -> DataFrame:
    """The rows of `docs` that the machine doesn't reject; all columns stay.

    The decision is each row's own: repeated rows stay or go together, null ids
    are no special case, null and empty texts stay. An empty table, of documents
    or of labels, leaves `docs` as it is.
    """
    machine = machine or fit(docs, labels)
    kept = _with_score(docs, machine).where(F.col("__tw_tox.score") <= machine.limit)
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))
