"""Quality classifier: random Fourier features over document statistics, ridge, isotonic calibration.

Statistics of a text are standardised and mapped by FEATURES random cosines,
whose inner products approximate a Gaussian kernel. Every partition sums its
normal equations over its labelled rows; the sums are added in two levels, so
that the driver receives PARTS of them whatever the number of partitions. One
labelled row in CALIBRATE is held out of the fit; on those rows, counted by
rounded score, the pool-adjacent-violators algorithm turns scores into
probabilities.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.session import written

FEATURES, RIDGE, CALIBRATE, PARTS, SEED, KEEP = 256, 1e-3, 5, 16, 5, 0.5
NAMES = ("chars", "words", "word_len", "upper", "digit", "stops", "symbol", "space", "non_ascii", "distinct", "repeated_lines", "line_len", "top_word", "odd_words", "entropy", "other_control")
_D = len(NAMES)
_CLASS = np.full(256, 7, np.int64)
for _k, _chars in enumerate((range(97, 123), range(65, 91), range(48, 58), b".,;:'\"-()?", b" \t\r\n", range(128, 256), b"!#$%&*+/<=>@[\\]^_`{|}~")):
    _CLASS[list(_chars)] = _k
_ODD = re.compile(r"[!#$%&*+/<=>@\[\\\]^_`{|}~]")


def statistics(text: str | None) -> list[float]:
    """The values of NAMES for a text; an empty or null one has zeros."""
    if not text:
        return [0.0] * _D
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    n = raw.sum()
    kind = np.bincount(_CLASS, weights=raw, minlength=8) / n
    p = raw[raw > 0] / n
    words = text.split()
    count = Counter(words)
    lines = [x for x in text.split("\n") if x]
    total = max(1, len(words))
    odd = sum(c for w, c in count.items() if _ODD.search(w))
    letters = max(1e-9, kind[0] + kind[1] + kind[5])
    return [
        float(np.log1p(len(text))), float(np.log1p(len(words))), (len(text) - len(words)) / total, kind[1] / letters, kind[2], kind[3], kind[6], kind[4], kind[5],
        len(count) / total, 1 - len(set(lines)) / max(1, len(lines)), float(np.log1p(len(text) / max(1, len(lines)))), max(count.values(), default=0) / total,
        odd / total, float(-(p * np.log2(p)).sum()), kind[7],
    ]


@F.arrow_udf(T.ArrayType(T.FloatType()))
def _statistics(text: pa.Array) -> pa.Array:
    return pa.array([statistics(t) for t in text.to_pylist()], pa.list_(pa.float32()))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), float).reshape(-1, _D)


@dataclass(frozen=True)
class Model:
    """Standardisation, random frequencies, ridge weights and the calibration's steps."""

    mean: np.ndarray
    scale: np.ndarray
    frequency: np.ndarray
    phase: np.ndarray
    weights: np.ndarray | None = None
    steps: tuple[np.ndarray, np.ndarray] = (np.zeros(1), np.full(1, 0.5))

    def mapped(self, x: np.ndarray) -> np.ndarray:
        z = np.cos(np.clip((x - self.mean) * self.scale, -8, 8) @ self.frequency + self.phase) * np.sqrt(2 / len(self.phase))
        return np.concatenate((z, np.ones((len(z), 1))), axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.mapped(x) @ self.weights if self.weights is not None and len(x) else np.zeros(len(x))

    def probability(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, *self.steps)


def frequencies(seed: int = SEED, features: int = FEATURES) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies of a Gaussian kernel whose width is the root of the dimension, and phases."""
    rng = np.random.default_rng(seed)
    return rng.normal(size=(_D, features)) / np.sqrt(_D), rng.uniform(0, 2 * np.pi, features)


def isotonic(score: np.ndarray, positive: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators over sorted distinct scores: (scores, non-decreasing probabilities)."""
    blocks: list[list[float]] = []
    for p, t in zip(positive, total, strict=True):
        blocks.append([p, t, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            p2, t2, n2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + p2, blocks[-1][1] + t2, blocks[-1][2] + n2]
    return score, np.repeat([b[0] / b[1] for b in blocks], [int(b[2]) for b in blocks])


def _summed(df: DataFrame, each, size: int) -> np.ndarray:
    """Sum over all rows of the vectors that `each` makes of a batch, added in partitions, then in PARTS, then here."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros(size)
        for b in batches:
            if b.num_rows:
                acc += each(b)
        yield pa.record_batch([pa.array([acc.tobytes()], pa.binary())], names=["v"])

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros(size)
        for b in batches:
            for v in b.column(0):
                acc += np.frombuffer(v.as_py())
        yield pa.record_batch([pa.array([acc.tobytes()], pa.binary())], names=["v"])

    sums = df.mapInArrow(first, "v binary").repartition(PARTS).mapInArrow(second, "v binary").collect()
    return sum((np.frombuffer(r["v"]) for r in sums), np.zeros(size))


def fit(stats: DataFrame, labels: DataFrame) -> Model:
    """A model from `stats` (id, x) and `labels` (doc_id, quality), over all labelled rows.

    Null ids and labels are skipped; an id with several labels has their
    maximum. Without labels of both kinds every probability is 1/2.
    """
    lab = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("id")).agg(F.max((F.col("quality") > 0).cast("double")).alias("y"))
    rows = written(stats.join(lab, "id").select("x", "y", (F.pmod(F.xxhash64("id"), F.lit(CALIBRATE)) == 0).alias("held")), "labelled")
    train = rows.where("not held").select("x", "y")

    def moments(b: pa.RecordBatch) -> np.ndarray:
        x = _matrix(b.column(0))
        return np.concatenate((x.sum(axis=0), (x * x).sum(axis=0), [len(x), np.asarray(b.column(1)).sum()]))

    m = _summed(train, moments, 2 * _D + 2)
    n, positive = m[-2:]
    frequency, phase = frequencies()
    if not 0 < positive < n:
        return Model(np.zeros(_D), np.ones(_D), frequency, phase)
    mean = m[:_D] / n
    spread = np.sqrt(np.maximum(m[_D : 2 * _D] / n - mean * mean, 0))
    model = Model(mean, np.where(spread > 1e-6, 1 / np.maximum(spread, 1e-6), 0.0), frequency, phase)
    size = FEATURES + 1

    def normal(b: pa.RecordBatch) -> np.ndarray:
        z, y = model.mapped(_matrix(b.column(0))), np.asarray(b.column(1))
        return np.concatenate(((z.T @ z).ravel(), z.T @ y))

    a = _summed(train, normal, size * size + size)
    eye = RIDGE * n * np.eye(size)
    eye[-1, -1] = 0
    weights = np.linalg.solve(a[: size * size].reshape(size, size) + eye, a[size * size :])
    model = Model(mean, model.scale, frequency, phase, weights)
    scored = F.arrow_udf(lambda x: pa.array(model.scores(_matrix(x))), T.DoubleType())
    bins = rows.where("held").select(F.round(scored("x"), 3).alias("s"), "y").groupBy("s").agg(F.sum("y").alias("p"), F.count("*").alias("n")).orderBy("s").toArrow()
    if not bins.num_rows:
        return Model(mean, model.scale, frequency, phase, weights, (np.array([0.0, 1.0]), np.array([0.0, 1.0])))
    steps = isotonic(*(np.asarray(bins[c], float) for c in ("s", "p", "n")))
    return Model(mean, model.scale, frequency, phase, weights, steps)


def quality_scores(docs: DataFrame, labels: DataFrame, keep: float = KEEP) -> DataFrame:
    """(doc_id, score, probability, keep): ridge score, calibrated probability of good quality, and whether it reaches `keep`.

    Every row is scored on its whole text. A null or empty text has statistics
    of zero and is scored like any other; null and repeated ids are reported
    as they come, ids are of any type; equal rows get equal scores. An empty
    table gives no rows.
    """
    stats = written(docs.select(F.col("doc_id").alias("id"), _statistics("text").alias("x")), "statistics")
    model = docs.sparkSession.sparkContext.broadcast(fit(stats, labels))

    @F.arrow_udf(T.StructType([T.StructField("score", T.DoubleType()), T.StructField("probability", T.DoubleType())]))
    def scored(x: pa.Array) -> pa.Array:
        s = model.value.scores(_matrix(x))
        return pa.StructArray.from_arrays([pa.array(s), pa.array(model.value.probability(s))], ["score", "probability"])

    rows = stats.select(F.col("id").alias("doc_id"), scored("x").alias("s"))
    return rows.select("doc_id", F.round("s.score", 6).alias("score"), F.round("s.probability", 6).alias("probability"), (F.col("s.probability") >= keep).alias("keep"))
