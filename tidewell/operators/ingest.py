"""Ingest: hashing, exact dedup, incremental runs, validation, and the run's summary."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.session import written


def content_hash(text: str = "text") -> Column:
    """Hex SHA-256 of a text's bytes."""
    return F.sha2(F.col(text), 256)


def dedup_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seen: DataFrame | None = None) -> DataFrame:
    """The row of the smallest id (null ids last) of each distinct text; those whose hash is in `seen(hash)` go too. Null texts are one text.

    The smallest ids are found from ids and hashes alone, by partial minima;
    rows are numbered only where an id repeats with its text.
    """
    rows = docs.withColumns({"__tw_hash": F.coalesce(content_hash(text_col), F.lit("")), "__tw_id": F.struct(F.col(id_col).isNull().alias("z"), F.col(id_col).alias("i"))})
    ids = rows.select("__tw_hash", "__tw_id")
    if seen is not None:
        ids = ids.join(seen.select(F.col("hash").alias("__tw_hash")), "__tw_hash", "left_anti")
    first = written(ids.groupBy("__tw_hash", "__tw_id").agg(F.count("*").alias("n")).groupBy("__tw_hash").agg(F.min(F.struct("__tw_id", "n")).alias("m")).select("__tw_hash", "m.__tw_id", F.col("m.n").alias("__tw_n")), "firsts")
    kept = rows.join(first.withColumnsRenamed({"__tw_hash": "__tw_h", "__tw_id": "__tw_i"}), (F.col("__tw_hash") == F.col("__tw_h")) & F.col("__tw_id").eqNullSafe(F.col("__tw_i")))
    again = kept.where("__tw_n > 1").withColumn("__tw_k", F.row_number().over(W.partitionBy("__tw_hash").orderBy("__tw_hash"))).where("__tw_k = 1")
    own = [F.col(f"`{c}`") for c in docs.columns]
    return kept.where("__tw_n = 1").select(*own).unionAll(again.select(*own))


def incremental_delta(docs: DataFrame, state: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with its hash, without the rows whose id has that very hash in `state(id, hash)`."""
    known = state.select(F.col("id").alias("__tw_id"), F.col("hash").alias("__tw_was"))
    rows = docs.withColumn("hash", content_hash(text_col)).join(known, F.col(id_col) == F.col("__tw_id"), "left")
    return rows.where(~F.col("hash").eqNullSafe(F.col("__tw_was"))).drop("__tw_id", "__tw_was")


def problems(
    text: str = "text", least: int = 1, most: int | None = None, required: tuple[str, ...] = (), source: str | None = None, prefixes: tuple[str, ...] = ()
) -> Column:
    """The names of all rules that a row breaks: size in bytes, blank required columns, source outside the allowed prefixes."""
    size = F.octet_length(F.coalesce(F.col(text), F.lit("")))
    found = [F.when(size < least, "too_short")]
    if most is not None:
        found.append(F.when(size > most, "too_long"))
    found += [F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "", f"missing_{c}") for c in required]
    if source and prefixes:
        allowed = F.lit(False)
        for p in prefixes:
            allowed = allowed | F.coalesce(F.col(source).startswith(p), F.lit(False))
        found.append(F.when(~allowed, "source_not_allowed"))
    return F.array_compact(F.array(*found))


def run(
    docs: DataFrame, state: DataFrame, rules: Column, transform: Callable[[DataFrame], DataFrame] | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """`docs` with its hash and status: unchanged, duplicate, invalid or uploaded, in that order of tests.

    `transform` maps the rows that would be uploaded; those it drops are gone
    from the result.
    """
    known = state.select(F.col("id").alias("__tw_id"), F.col("hash").alias("__tw_was"))
    rows = docs.withColumn("hash", content_hash(text_col)).join(known, F.col(id_col) == F.col("__tw_id"), "left")
    rows = rows.withColumn("__tw_same", F.col("hash").eqNullSafe(F.col("__tw_was")) & F.col("__tw_id").isNotNull())
    order = W.partitionBy("hash", "__tw_same").orderBy(F.asc_nulls_last(id_col))
    rows = rows.withColumn("__tw_n", F.row_number().over(order))
    status = F.when(F.col("__tw_same"), "unchanged").when(F.col("__tw_n") > 1, "duplicate").when(F.size(rules) > 0, "invalid").otherwise("uploaded")
    rows = rows.withColumn("status", status).drop("__tw_id", "__tw_was", "__tw_same", "__tw_n")
    if transform:
        rows = rows.where("status <> 'uploaded'").unionByName(transform(rows.where("status = 'uploaded'")))
    return rows


def run_batch(spark, sources: dict[str, Callable[[], DataFrame]], state: DataFrame, rules: Column, done: Callable[[str, dict], None] | None = None, **how) -> DataFrame:
    """(source, status, n, error): a run of each source in turn; one that fails is reported and doesn't stop the others.

    `done` is told the counts by status after each source, as progress.
    """
    rows = []
    for name, load in sources.items():
        try:
            counts = {r["status"]: r["n"] for r in run(load(), state, rules, **how).groupBy("status").agg(F.count("*").alias("n")).collect()}
            rows += [(name, status, n, None) for status, n in sorted(counts.items())]
        except Exception as e:  # any source's failure is a row of the result
            counts = {"failed": 1}
            rows.append((name, "failed", 1, f"{type(e).__name__}: {e}".split("\n")[0]))
        if done:
            done(name, counts)
    return spark.createDataFrame(rows, "source string, status string, n long, error string")


def upsert(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """The latest row of each key by `version`; the new table wins ties."""
    both = old.withColumn("__tw_new", F.lit(0)).unionByName(new.withColumn("__tw_new", F.lit(1)))
    latest = W.partitionBy(key).orderBy(F.desc(version), F.desc("__tw_new"))
    return both.withColumn("__tw_n", F.row_number().over(latest)).where("__tw_n = 1").drop("__tw_new", "__tw_n")


def delete(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't among the tombstones."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")
