"""Session helpers: the shared folder, written intermediate tables, sizes of plans."""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Where the setting is unset, a local master gets a temporary folder (tests);
    on a cluster that is an error, since a machine-local folder would be lost
    with its machine.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _OWN[app] = tempfile.mkdtemp(prefix="tidewell-")
        spark.sparkContext.setCheckpointDir("file://" + _OWN[app])
        atexit.register(shutil.rmtree, _OWN[app], True)
    return "file://" + _OWN[app]


def _forget(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the gateway may be gone when the interpreter ends
        if path.startswith("file:"):
            shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


#: Whether a query's shuffle files are removed when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Cuts the lineage: writes df as Parquet in the shared folder and reads it back.

    The table outlives any executor and carries its size, so that the planner
    chooses join sides by what was really written. It is removed when the
    interpreter ends. Shuffle files of the write go as soon as it is over, not
    when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidewell-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    atexit.register(_forget, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def plan_bytes(df: DataFrame) -> int:
    """The planner's estimate of df's size in bytes (file sizes, for a scan)."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    return int(str(stats.sizeInBytes()))


#: Bytes, by the planner's estimate, of the part of a table that one task sorts or counts.
PART = 8 << 20


def parts_of(df: DataFrame) -> int:
    """How many parts of PART bytes df has, or 0 where the session's number of shuffle partitions is enough or the size isn't known."""
    n = -(-plan_bytes(df) // PART)
    return 0 if n > 1 << 20 else n if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else 0


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df by its keys in as many parts as its size needs, whatever the session's number of them is: a count or join by these keys that follows holds no more for more input."""
    n = parts_of(df)
    return df.repartition(n, *keys) if n else df


#: Rows of an Arrow batch between the JVM and Python. Texts may be long, and both sides hold whole batches.
BATCH_ROWS, _BATCH = 1_000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a scale-factor folder. Where the session has Spark's own batch size, it gets BATCH_ROWS."""
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


#: Bytes for each core below which a table is dealt out to all cores.
SPREAD = 8 << 20


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows take long to work on.

    A small file may be one row group, which one task reads however many there
    are; rows of a table of less than SPREAD bytes for each core are therefore
    dealt out to all of them. Larger tables have row groups enough and aren't
    moved.
    """
    df, cores = table(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if plan_bytes(df) < cores * SPREAD else df


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python, once for each application, from the shared folder.

    Nothing is sent where PYTHONPATH already names the package's root, as the
    workers inherit it.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    app = spark.sparkContext.applicationId
    if app in _SHIPPED or root in map(os.path.abspath, filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))):
        return
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(os.path.join(root, "tidewell")):
            for name in names:
                if name.endswith(".py"):
                    at = os.path.join(folder, name)
                    z.write(at, os.path.relpath(at, root))
    path = f"{shared_dir(spark)}/tidewell-{uuid.uuid4().hex}.zip"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where)
    out.write(held.getvalue())
    out.close()
    spark.sparkContext.addPyFile(path)
    atexit.register(_forget, spark, path)
    _SHIPPED.add(app)
