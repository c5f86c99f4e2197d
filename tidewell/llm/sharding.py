"""Sharding by proportional stratified interleaving.

Rows are shuffled within their source by a seeded hash, ranked, and put in the
order of their fractional rank (rank - 1/2) / n; every run of that order then
holds the sources in proportion, and equal cuts of it make the shards. Both
orders are numbered by buckets of hash or of fractional rank, so that neither a
hot source nor the whole table is one task's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators.ranks import spread_rank
from tidewell.session import written

SHARD_ROWS, BUCKET_ROWS, SEED = 8192, 250_000, 17


def shards(docs: DataFrame, shard_rows: int = SHARD_ROWS, seed: int = SEED, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, source, shard, place): the shard of each row and its place in it, both from 0.

    There are ceil(rows / shard_rows) shards, and their sizes differ by one at
    most. The count of a source in a shard differs from its exact share by less
    than the number of sources. The shuffle depends on the id and the seed
    alone: md5("seed:id"); rows of one source that repeat an id follow each
    other in any order. A null source is a source of its own, a null id is
    hashed as an empty one, texts aren't read. An empty table gives no rows.
    """
    shuffled = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return _placed(docs.select("doc_id", "source", shuffled.alias("h")), (), shard_rows, bucket_rows)


def _placed(thin: DataFrame, more: tuple[str, ...], shard_rows: int, bucket_rows: int) -> DataFrame:
    """The shards of rows (doc_id, source, h), with the columns `more`, by which rows of one id are ordered."""
    counts = written(thin.groupBy("source").agg(F.count("*").alias("n")), "sources")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    parts = max(1, -(-total // bucket_rows))
    hashed = F.conv(F.substring("h", 1, 8), 16, 10).cast("long")
    ranked = spread_rank(thin, F.floor(hashed * F.lit(parts) / F.lit(1 << 32)), ["h", "doc_id", *more], ("source",), "rank")
    same = F.col("source").eqNullSafe(F.col("__tw_source"))
    ranked = ranked.join(counts.select(F.col("source").alias("__tw_source"), "n"), same)
    at = ranked.select("doc_id", "source", *more, "rank", ((2 * F.col("rank") - 1) / (2 * F.col("n"))).alias("at"))
    order = ["at", F.asc_nulls_first("source"), "rank"]
    placed = spread_rank(at, F.floor(F.col("at") * F.lit(parts)), order, (), "row")
    count = max(1, -(-total // shard_rows))
    shard = F.expr(f"((row - 1) * {count}L) div {max(1, total)}L")
    first = F.expr(f"(shard * {max(1, total)}L + {count - 1}L) div {count}L")
    return placed.withColumn("shard", shard).select("doc_id", "source", *more, "shard", (F.col("row") - 1 - first).alias("place"))


def write_shards(docs: DataFrame, path: str, shard_rows: int = SHARD_ROWS, seed: int = SEED, bucket_rows: int = BUCKET_ROWS) -> None:
    """Writes the rows of `docs` to `path`/shard=N, each shard in the order of its places; all columns stay.

    Every row is written once for each time that it occurs: ids may repeat or be
    null, and rows that are the same in all columns are each given a place. If
    `docs` has a column named shard, the folders' name gets underscores until it
    is free. Columns of a map type can't be hashed and aren't taken.
    """
    own = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.select("*", F.struct(F.xxhash64(*own), F.xxhash64(F.lit(1), *own)).alias("__tw_row"))
    shuffled = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    at = _placed(keyed.select("doc_id", "source", shuffled.alias("h"), "__tw_row"), ("__tw_row",), shard_rows, bucket_rows)
    at = at.select("__tw_row", F.col("shard").alias("__tw_shard"), F.col("place").alias("__tw_place"))
    rows = keyed.dropDuplicates(["__tw_row"]).join(at, "__tw_row").select(*own, "__tw_shard", "__tw_place")
    name = "shard"
    while name in docs.columns:
        name += "_"
    ordered = rows.repartition("__tw_shard").sortWithinPartitions("__tw_shard", "__tw_place")
    ordered.drop("__tw_place").withColumnRenamed("__tw_shard", name).write.partitionBy(name).parquet(path)


SQL = f"""
WITH h AS (SELECT doc_id, source, md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY h, doc_id) AS rank, count(*) OVER (PARTITION BY source) AS n FROM h),
p AS (SELECT doc_id, source, row_number() OVER (ORDER BY CAST(2 * rank - 1 AS DOUBLE) / CAST(2 * n AS DOUBLE), source NULLS FIRST, rank) - 1 AS row, count(*) OVER () AS total FROM r),
s AS (SELECT *, greatest(1, (total + {SHARD_ROWS - 1}) // {SHARD_ROWS}) AS shards FROM p),
t AS (SELECT *, row * shards // total AS shard FROM s)
SELECT doc_id, source, shard, row - (shard * total + shards - 1) // shards AS place FROM t
"""
