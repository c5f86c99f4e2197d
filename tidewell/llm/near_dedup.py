"""MinHash near-dedup by min-max hashing.

Each permutation of the shingle hashes yields two values, its minimum and its
maximum, so 64 permutations fill a signature of 128. Four values make a band;
documents that agree in a band are candidates; the share of agreeing values,
corrected for chance agreement of the 8 bits kept, estimates the Jaccard
similarity of the shingle sets and decides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm.words import batches, grams, mix, word_hashes
from tidewell.operators.components import components
from tidewell.session import written

PERMUTATIONS, ROWS, SHINGLE = 64, 4, 3
BANDS = 2 * PERMUTATIONS // ROWS
_RNG = np.random.default_rng(97)
_A = _RNG.integers(0, 2**31, PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RNG.integers(0, 2**32, PERMUTATIONS, dtype=np.uint32)
_SIGNED = pa.struct([("sig", pa.binary()), ("bands", pa.list_(pa.int64()))])


def shingles(hashes: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of k words; a shorter text is one shingle of all its words."""
    return grams(hashes, min(k, len(hashes))) if len(hashes) else hashes


def min_max(x: np.ndarray) -> np.ndarray:
    """The minimum of each permutation of x, then the maximum of each: 128 values of 32 bits."""
    x = (x >> np.uint64(32)).astype(np.uint32)
    low, high = np.full(PERMUTATIONS, 2**32 - 1, np.uint32), np.zeros(PERMUTATIONS, np.uint32)
    for i in range(0, len(x), 1024):
        p = x[i : i + 1024, None] * _A + _B
        np.minimum(low, p.min(axis=0), out=low)
        np.maximum(high, p.max(axis=0), out=high)
    return np.concatenate((low, high))


def signatures(texts: list) -> list[dict | None]:
    """Signature bytes and band keys of each text; None for one without words."""
    out: list[dict | None] = []
    for _, run in batches(texts):
        h, at = word_hashes(run)
        rows, values = [], []
        for i in range(len(run)):
            if at[i] < at[i + 1]:
                rows.append(i)
                values.append(min_max(shingles(h[at[i] : at[i + 1]])))
        part: list[dict | None] = [None] * len(run)
        if rows:
            v = np.stack(values).astype(np.uint64)
            sig = (mix(v) & np.uint64(255)).astype(np.uint8)
            acc = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :]
            for j in range(ROWS):
                acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + v[:, j * BANDS : (j + 1) * BANDS])
            keys = acc.view(np.int64)
            for i, s, b in zip(rows, sig, keys):
                part[i] = {"sig": s.tobytes(), "bands": b}
        out += part
    return out


@F.arrow_udf(T.StructType([T.StructField("sig", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))]))
def _signed(text: pa.Array) -> pa.Array:
    parts = [pa.array(signatures(text.slice(i, 256).to_pylist()), _SIGNED) for i in range(0, len(text), 256)]
    return pa.concat_arrays(parts) if parts else pa.array([], _SIGNED)


@F.arrow_udf(T.DoubleType())
def _similar(a: pa.Array, b: pa.Array) -> pa.Array:
    """Jaccard similarity as estimated from two columns of signatures."""
    if not len(a):
        return pa.array([], pa.float64())
    x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(len(c), -1) for c in (a, b))
    same = (x == y).mean(axis=1)
    return pa.array((same - 1 / 256) / (1 - 1 / 256))


def similar_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.55) -> DataFrame:
    """Candidate pairs (a, b, similarity) whose estimated similarity is at least `threshold`.

    Documents of equal signatures are put together first; each is paired with
    the smallest id of them, which alone stands for them in the bands. Within a
    band every signature is compared with the smallest id of its bucket, found
    by partial minima, so a group of n copies costs n comparisons and a hot
    bucket is no task's alone. Whatever doesn't match that one is compared with
    all other signatures of the bucket, so that no partner is lost. Pairs that
    only meet through their bucket's smallest id aren't listed: they are in one
    component with it.

    Rows with a null id or without any word are in no pair. Rows that repeat an
    id are one document, which matches by any of its rows. Ids are of any type
    that has an order.
    """
    s = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where("id is not null and t is not null")
    s = s.select("id", _signed("t").alias("s")).where("s is not null").select("id", F.struct(F.xxhash64("s.sig").alias("u"), F.xxhash64("s.sig", F.lit(1)).alias("v")).alias("h"), "s.sig", "s.bands")
    s = written(s, "signatures")
    same = s.groupBy("h").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1").select("h", "rep")
    copies = written(s.select("id", "h").join(same, "h").where("id <> rep").select("rep", "id", "h"), "copies")
    # Rows of one id may have several signatures, so it is a row that is left out, not an id.
    alone = s.join(copies.select("id", "h").distinct(), ["id", "h"], "left_anti")
    rows = alone.select("id", F.explode("bands").alias("key"))
    reps = rows.groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1").select("key", "rep")
    met = written(rows.join(reps, "key").where("id <> rep"), "met")
    sig = s.select("id", "sig")

    def judged(pairs: DataFrame) -> DataFrame:
        left = pairs.join(sig.select(F.col("id").alias("a"), F.col("sig").alias("x")), "a")
        return left.join(sig.select(F.col("id").alias("b"), F.col("sig").alias("y")), "b").select("a", "b", _similar("x", "y").alias("similarity"))

    first = written(judged(met.select(F.col("rep").alias("a"), F.col("id").alias("b")).distinct()), "judged")
    matched = first.where(F.col("similarity") >= threshold)
    missed = first.select("a", "b").distinct().join(matched.select("a", "b"), ["a", "b"], "left_anti").select(F.col("a").alias("rep"), F.col("b").alias("id"))
    left = met.join(missed, ["rep", "id"], "left_semi")
    others = left.select("key", F.col("id").alias("i")).join(met.select("key", F.col("id").alias("j")), "key").where("i <> j")
    again = judged(others.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).distinct())
    equal = copies.select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity"))
    return equal.union(first).union(again).where(F.col("similarity") >= threshold)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.55) -> DataFrame:
    """(doc_id, duplicate_of): every document of a group but its smallest id, and that id.

    Groups are the components of `similar_pairs`. Documents with a null id, a
    null or empty text, or no word in it, are in no group. An empty table gives
    no rows.
    """
    pairs = similar_pairs(docs, id_col, text_col, threshold)
    return components(pairs.select("a", "b")).select(F.col("id").alias("doc_id"), F.col("root").alias("duplicate_of"))


def drop_near_duplicates(docs: DataFrame, threshold: float = 0.55) -> DataFrame:
    """The rows of `docs` whose document is alone or the smallest id of its group; all columns stay.

    Rows that repeat both id and text are one document: one of them stays. Rows
    with a null id can't be told apart by id; they stay as they are.
    """
    gone = written(near_duplicates(docs, threshold=threshold).select(F.col("doc_id").alias("__tw_id")), "gone")
    rows = docs.withColumns({"__tw_id": F.col("doc_id"), "__tw_hash": F.xxhash64("text")})
    # Texts are moved only for the keys that occur more than once, not for all rows.
    again = written(rows.where("__tw_id is not null").groupBy("__tw_id", "__tw_hash").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "repeated")
    kept = rows.join(gone, "__tw_id", "left_anti")
    once = kept.join(again, ["__tw_id", "__tw_hash"], "left_anti")
    same = W.partitionBy("__tw_id", "__tw_hash").orderBy("__tw_hash")
    first = kept.join(again, ["__tw_id", "__tw_hash"], "left_semi").withColumn("__tw_rank", F.row_number().over(same)).where("__tw_rank = 1")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return once.select(*columns).unionAll(first.select(*columns))
