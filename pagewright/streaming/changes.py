"""Change events as a stream (R1, R2, R5): the store's states kept up to date.

A micro-batch is summed up by attachment and merged with the states of just the attachments
that it names; earlier batches are not read again. Each batch writes its version of those
states, and every ``full_every`` batches all states, so that a reader needs the last full
version and the ones after it. A batch's folder is written over when the batch is replayed, so
a lost executor or a replay changes nothing. A key's changes have to arrive in order of seq.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagewright.operators import store

LOG = "library_id bigint, attachment_key string, seq bigint, change string, fingerprint string"
STATE_KIND = "struct<fingerprint:string,is_trashed:int,first_seen:bigint,last_seen:bigint,opens:bigint>"
FULL_EVERY = 50


def start(changes: DataFrame, state_path: str, checkpoint: str, *, key: list[str] | None = None, trigger: dict | None = None, full_every: int = FULL_EVERY) -> StreamingQuery:
    """Start a query that keeps ``state_path`` the fold of all changes seen.

    ``changes`` is a stream with the columns of LOG. R5: ``trigger`` sets how often.
    """
    keys = key or store.KEY

    def fold(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        partial = store.partial_states(batch, key=keys)
        named = partial.select(*keys)
        before = _versions(spark, state_path, batch.schema, keys, epoch)
        fresh = store.merged_states(_last(before.join(named, keys, "left_semi"), keys), partial, key=keys)
        full = epoch % full_every == full_every - 1
        if full:
            fresh = _last(before.join(named, keys, "left_anti"), keys).select(*keys, F.struct(*store.STATE).alias("state")).unionByName(fresh.where("state is not null"))
        for kind in ("full", "delta"):  # what a replay under another setting might have left
            _delete(spark, f"{state_path}/epoch={epoch}/kind={kind}")
        fresh.withColumn("state", F.col("state").cast(STATE_KIND)).write.parquet(f"{state_path}/epoch={epoch}/kind={'full' if full else 'delta'}")

    return changes.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _epochs(spark: SparkSession, state_path: str) -> list[tuple[int, str]]:
    """Epochs and kinds of the versions, from the folder's names."""
    glob = spark._jvm.org.apache.hadoop.fs.Path(f"{state_path}/epoch=*/kind=*")
    found = glob.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(glob)
    paths = [f.getPath() for f in found or []]
    return sorted((int(p.getParent().getName().removeprefix("epoch=")), p.getName().removeprefix("kind=")) for p in paths)


def _versions(spark: SparkSession, state_path: str, schema, keys: list[str], below: int | None = None) -> DataFrame:
    """The rows of the last full version before an epoch and of those after it."""
    epochs = [(e, kind) for e, kind in _epochs(spark, state_path) if below is None or e < below]
    first = max((e for e, kind in epochs if kind == "full"), default=-1)
    paths = [f"{state_path}/epoch={e}/kind={kind}" for e, kind in epochs if e >= first]
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema if f.name in keys) + f", state {STATE_KIND}"
    reader = spark.read.schema(kind + ", epoch bigint").option("basePath", state_path)
    return reader.parquet(*paths) if paths else spark.createDataFrame([], kind + ", epoch bigint")


def _last(versions: DataFrame, keys: list[str]) -> DataFrame:
    last = versions.groupBy(*keys).agg(F.max_by(F.struct("state"), "epoch").alias("v"))
    return last.select(*keys, "v.state").where("state is not null").select(*keys, "state.*")


def current(spark: SparkSession, state_path: str, *, key: list[str] | None = None) -> DataFrame:
    """The states as of the last batch."""
    keys = key or store.KEY
    schema = spark.createDataFrame([], LOG).schema
    return _last(_versions(spark, state_path, schema, keys), keys)
