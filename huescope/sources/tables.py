"""Tables between the steps of an iteration, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def _folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; where that is unset and the master is local (tests), a folder of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="huescope-")
        _forget(spark, _own[app], at_exit=True)
    return _own[app]


def _forget(spark: SparkSession, path: str, at_exit: bool) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    system.deleteOnExit(at) if at_exit else system.delete(at, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path, deleted when the application ends."""
    path = f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _forget(spark, path, at_exit=True)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a written table: its lineage is cut and it survives lost executors. It goes when the application ends, or by drop()."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._own_table = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables of written() that nothing reads any more."""
    for t in tables:
        _forget(t.sparkSession, t._own_table, at_exit=False)


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by keys, or evenly without any, to as many tasks as shuffles have, however few bytes they are: it's the work on them that takes the time.

    Evenly dealt rows stay so; by keys that rows are dealt by already, Spark leaves them as they are and joins small parts again.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
