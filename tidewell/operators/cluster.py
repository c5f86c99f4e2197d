"""The sharded cluster as queries: hash ring, shards, scatter-gather."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

VIRTUAL = 150


def ring_hash(key: Column) -> Column:
    """The first 8 bytes of the MD5, big-endian."""
    return F.conv(F.substring(F.md5(key), 1, 16), 16, 10).cast("decimal(20,0)")


def ring(nodes: DataFrame, virtual: int = VIRTUAL) -> DataFrame:
    """(at, node): the virtual nodes of each node."""
    each = nodes.select("node", F.explode(F.sequence(F.lit(0), F.lit(virtual - 1))).alias("v"))
    return each.select(ring_hash(F.concat("node", F.lit("#"), F.col("v").cast("string"))).alias("at"), "node")


#: Points of a ring that are sent to the executors at most (24 bytes each); more nodes than that are an error.
RING_POINTS = 4_000_000


def replicas(keys: DataFrame, nodes: DataFrame, n: int = 1, key: str = "key", virtual: int = VIRTUAL) -> DataFrame:
    """(key, nodes): the first n distinct nodes clockwise from each key's hash, its owner first; all nodes if they are fewer.

    The ring's size is checked before it is sent; a key is placed by binary
    search, and each point knows the nodes that follow it. Without nodes a key
    has none.
    """
    points = ring(nodes.distinct(), virtual)
    if (size := points.count()) > RING_POINTS:
        raise ValueError(f"a ring of {size} points is beyond {RING_POINTS}")
    rows = sorted((int(r["at"]), r["node"]) for r in points.collect())
    at, owner = np.array([a for a, _ in rows], np.uint64), [o for _, o in rows]
    most = min(n, len(set(owner)))
    follow: list[list[str]] = [[] for _ in rows]
    ahead: list[str] = []
    # Backwards over two turns, so that the last points see the first ones.
    for i in range(2 * len(rows) - 1, -1, -1):
        o = owner[i % len(rows)]
        ahead = [o, *(x for x in ahead if x != o)][:most]
        follow[i % len(rows)] = ahead
    sent = keys.sparkSession.sparkContext.broadcast((at, follow))

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def place(h: pa.Array) -> pa.Array:
        spots, after = sent.value
        found = np.searchsorted(spots, np.array([int(x) for x in h.to_pylist()], np.uint64), "left")
        return pa.array([after[i % len(after)] if after else [] for i in found.tolist()], pa.list_(pa.string()))

    return keys.select(F.col(key).alias("key"), place(ring_hash(F.col(key))).alias("nodes"))


def owners(keys: DataFrame, nodes: DataFrame, key: str = "key", virtual: int = VIRTUAL) -> DataFrame:
    """(key, node): the node of the first virtual node at or after the key's hash, the first of all beyond the last."""
    return replicas(keys, nodes, 1, key, virtual).select("key", F.get("nodes", F.lit(0)).alias("node"))


def rebalance(keys: DataFrame, before: DataFrame, after: DataFrame, n: int = 1, key: str = "key") -> DataFrame:
    """(key, source, target): what must be copied when the nodes change: each replica that a key gains, from its first replica that stays, else its old owner."""
    old, new = replicas(keys, before, n, key).withColumnRenamed("nodes", "old"), replicas(keys, after, n, key)
    rows = old.join(new, "key").select("key", F.coalesce(F.get(F.array_intersect("old", "nodes"), F.lit(0)), F.get("old", F.lit(0))).alias("source"), F.explode(F.array_except("nodes", "old")).alias("target"))
    return rows


def shard_of(chunk_id: Column) -> Column:
    """The first eight characters of an id."""
    return F.substring(chunk_id, 1, 8)


def scatter_gather(scored: DataFrame, shard: str, k: int, by: str = "query_id", tie: str = "doc_id") -> DataFrame:
    """The k best of each query from at most 2k of each shard; a row that several shards hold counts once."""
    local = W.partitionBy(by, shard).orderBy(F.desc("score"), tie)
    part = scored.withColumn("n", F.row_number().over(local)).where(F.col("n") <= 2 * k).drop("n")
    once = part.groupBy(by, tie).agg(F.max("score").alias("score"))
    whole = W.partitionBy(by).orderBy(F.desc("score"), tie)
    return once.withColumn("rank", F.row_number().over(whole).cast("long")).where(F.col("rank") <= k)


def health(nodes: DataFrame) -> DataFrame:
    """One row (total, online, leader, healthy): the smallest online id leads; a quorum must be online."""
    on = F.col("status") == "online"
    row = nodes.agg(F.count("*").alias("total"), F.count_if(on).alias("online"), F.min(F.when(on, F.col("node"))).alias("leader"))
    return row.withColumn("healthy", F.col("online") >= F.floor(F.col("total") / 2) + 1)
