"""Helpers shared by the training-data operators."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by any path Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares: ``spark.checkpoint.dir``; a temporary one only in local mode where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='gristmill-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: What has been written to the shared folder and not been deleted.
_paths: set[str] = set()


def shared_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _paths.add(path)
    return path


def forget(spark: SparkSession) -> None:
    """Deletes all that this process has written to the shared folder; results that read from it must be done."""
    for path in list(_paths):
        delete_path(spark, path)


def written(spark: SparkSession, df: DataFrame, label: str = "", path: str | None = None) -> DataFrame:
    """``df`` as a table in the shared folder (a new one, or ``path``): lineage is cut and lost executors cost nothing."""
    path = path or shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).delete(where, True)
    _paths.discard(path)


def spread(spark: SparkSession, rows: int, per_task: int, least: int | None = None) -> int:
    """A number of partitions for ``rows`` rows: the session's shuffle setting at least, then as the rows grow."""
    floor = least or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(floor, math.ceil(rows / per_task))
