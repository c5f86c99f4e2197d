"""Query-log analytics and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BOUNDS = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def popular(log: DataFrame, query: str, latency: str, time: str, limit: int = 10) -> DataFrame:
    """(query, n, avg_latency, last_seen) of the most frequent normalised queries; the mean latency is cut to a whole number."""
    key = F.lower(F.trim(F.col(query)))
    rows = log.groupBy(key.alias("query")).agg(F.count("*").alias("n"), F.floor(F.avg(latency)).cast("long").alias("avg_latency"), F.max(time).alias("last_seen"))
    return rows.orderBy(F.desc("n"), "query").limit(limit)


def drop_off(log: DataFrame, by: str, failed: Column, score: str, limit: int | None = None) -> DataFrame:
    """(by, n, avg_score) of the rows that failed."""
    rows = log.where(failed).groupBy(by).agg(F.count("*").alias("n"), F.avg(score).alias("avg_score")).orderBy(F.desc("n"), by)
    return rows.limit(limit) if limit else rows


def last_n(log: DataFrame, n: int, time: str, tie: str) -> DataFrame:
    """The n latest rows, as the bounded log holds them."""
    return log.orderBy(F.desc(time), F.desc(tie)).limit(n)


def top_scores(log: DataFrame, query: str, score: str) -> DataFrame:
    """(query, top): the highest score of each normalised query."""
    return log.groupBy(F.lower(F.trim(F.col(query))).alias("query")).agg(F.max(score).alias("top"))


def snapshot(rows: DataFrame, name: str, value: str, time: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, counter, gauge) of a table of increments and readings: the sum of all values, and the latest one."""
    return rows.groupBy(*by).agg(F.sum(value).alias(f"{name}_total"), F.max_by(value, F.struct(time, value)).alias(f"{name}_last"))


def histogram(rows: DataFrame, value: str, by: tuple[str, ...] = (), bounds: tuple[float, ...] = BOUNDS) -> DataFrame:
    """(by, le, n) cumulative counts for each bound and +Inf, in one aggregation."""
    counts = [F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    sums = rows.groupBy(*by).agg(*counts, F.count(value).alias("all"))
    pairs = [F.struct(F.lit(repr(float(b))).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)]
    pairs.append(F.struct(F.lit("+Inf").alias("le"), F.col("all").alias("n")))
    return sums.select(*by, F.explode(F.array(*pairs)).alias("x")).select(*by, "x.le", "x.n")


def percentiles(rows: DataFrame, value: str, by: str, shares: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Nearest-rank percentiles of each group, exact."""
    out = [F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})").alias(f"p{round(100 * p)}") for p in shares]
    return rows.groupBy(by).agg(*out)


def prometheus(counts: DataFrame, name: str, help_text: str, total: DataFrame | None = None) -> DataFrame:
    """One row (line) for each line of the text exposition of a histogram (le, n); `total` is one row (sum, count) that ends it."""
    lines = counts.select(F.when(F.col("le") == "+Inf", F.lit(float("inf"))).otherwise(F.col("le").try_cast("double")).alias("at"), F.format_string(f'{name}_bucket{{le="%s"}} %d', "le", "n").alias("line"))
    head = counts.sparkSession.createDataFrame([(-2.0, f"# HELP {name} {help_text}"), (-1.0, f"# TYPE {name} histogram")], "at double, line string")
    rows = head.union(lines)
    if total is not None:
        for at, what in ((1.0, "sum"), (2.0, "count")):
            rows = rows.union(total.select(F.lit(float("nan")).alias("at"), F.concat(F.lit(f"{name}_{what} "), F.col(what).cast("string")).alias("line")))
    return rows.orderBy("at", F.desc("line")).select("line")


def latest(rows: DataFrame, by: list[str], time: str, tie: str) -> DataFrame:
    """The latest row of each group."""
    order = W.partitionBy(*by).orderBy(F.desc(time), F.desc(tie))
    return rows.withColumn("__tw_n", F.row_number().over(order)).where("__tw_n = 1").drop("__tw_n")
