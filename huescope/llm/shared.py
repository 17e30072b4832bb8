"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
_watching: list[list[DataFrame]] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset and the master is local (tests), one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="huescope-")
        _gone_at_exit(spark, _own[app])
    return _own[app]


def _gone_at_exit(spark: SparkSession, path: str) -> None:
    """Have the folder deleted when the application ends."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)


def table(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it again: its lineage is cut, it survives lost executors. It goes by drop(), or when the application ends.

    Spark deletes the shuffles of the write once the table is there, instead of when the driver's heap is next collected.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    _gone_at_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._own_table = path
    for made in _watching:
        made.append(out)
    return out


@contextlib.contextmanager
def collected() -> Iterator[list[DataFrame]]:
    """The tables that table() makes inside, for drop() once they have served."""
    made: list[DataFrame] = []
    _watching.append(made)
    try:
        yield made
    finally:
        _watching[:] = [w for w in _watching if w is not made]


def drop(*tables: DataFrame) -> None:
    """Delete the folders of what table() returned; nothing may read them any more."""
    for t in tables:
        at = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._own_table)
        at.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct: other columns beside it can't clash with them, and select("row.*") gives them back."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns]).alias("row")


def small(df: DataFrame, most: int) -> bool:
    """Whether df has at most so many rows; counts no further than that."""
    return df.limit(most + 1).count() <= most
