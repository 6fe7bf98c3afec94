"""Session helpers: a local builder and the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


FILES_A_CORE = 4
#: Input bytes that a task of ``write_table`` may read, on average, when partitions are put together.
TASK_BYTES = 64 << 20
#: Paths that are still there, by application.
_written: dict[str, dict[str, None]] = {}


def local_session(cpus: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on this machine."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("pagewright")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; on a local master a fresh one where it is unset."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = "file://" + os.path.join(tempfile.mkdtemp(prefix="pagewright-"), "shared")
    sc.setCheckpointDir(made)
    return made


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, {})[path] = None
    return path


def input_bytes(df: DataFrame) -> int:
    """What the leaves of the plan hold, by their statistics."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def write_table(df: DataFrame, name: str, files_a_core: int = FILES_A_CORE) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back.

    Small partitions are put together where there are more than ``files_a_core`` for each core,
    but never so that a task would read more than TASK_BYTES of the plan's inputs on average:
    a large scan keeps its splits. The table stays until ``drop_table`` or ``drop_all``; who
    consumes a result calls the latter, as the result reads the tables it was made of.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    files = max(files_a_core * spark.sparkContext.defaultParallelism, -(-input_bytes(df) // TASK_BYTES))
    df.coalesce(min(files, 2**31 - 1)).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._pagewright_path = path
    return out


def drop_table(*tables: DataFrame) -> None:
    """Delete what ``write_table`` wrote; only for tables that no later plan reads."""
    for df in tables:
        path = getattr(df, "_pagewright_path", None)
        if path:
            _delete(df.sparkSession, path)


def drop_all(spark: SparkSession) -> None:
    """Delete every table that this application's ``write_table`` and ``new_path`` made and left.

    For the end of a query, when its result is consumed or written elsewhere.
    """
    for path in list(_written.get(spark.sparkContext.applicationId, {})):
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    _written.get(spark.sparkContext.applicationId, {}).pop(path, None)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores: dealt out anew only where the scan has fewer splits than the cluster has cores.

    A large table has more splits than that and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
