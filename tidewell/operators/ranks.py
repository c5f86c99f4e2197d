"""Row numbers over a whole table or over few large groups, without one task for each group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def spread_rank(df: DataFrame, bucket: Column, order: list, by: tuple[str, ...] = (), name: str = "rank") -> DataFrame:
    """`df` with its row number from 1 in `order` within `by`, as column `name`.

    `bucket` must not fall where `order` rises; rows are numbered within their
    bucket, and the counts of the buckets before are added. So a hot group is
    shared by as many tasks as it has buckets. Only the counts, one for each
    bucket and group, are put in one order.
    """
    keys = [*by, "__tw_bucket"]
    rows = df.withColumn("__tw_bucket", bucket)
    counts = rows.groupBy(*keys).agg(F.count("*").alias("__tw_n"))
    before = W.partitionBy(*by).orderBy("__tw_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*keys, F.coalesce(F.sum("__tw_n").over(before), F.lit(0)).alias("__tw_before"))
    numbered = rows.withColumn("__tw_in", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__tw_o{i}"))
    joined = numbered.join(offsets.select(*(F.col(k).alias(f"__tw_o{i}") for i, k in enumerate(keys)), "__tw_before"), on)
    return joined.select(*(F.col(f"`{c}`") for c in df.columns), (F.col("__tw_before") + F.col("__tw_in")).alias(name))

