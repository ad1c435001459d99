"""What the jobs ask of the session they are given."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named in ``spark.checkpoint.dir``.

    Only a local session may go without the setting: it then gets a folder of its own.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        folder = tempfile.mkdtemp(prefix="likeness-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark)}/likeness-{spark.sparkContext.applicationId}"


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession) -> bool:
    """Delete all intermediate results of this application. Results that are still to be
    computed may need them, so this is for its end, or for when all are written."""
    return delete_path(spark, own_dir(spark))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` below the shared folder and go on from the written table.

    Used where several jobs or branches read one result, and where row positions must
    not change when a lost executor has its partitions computed again. Unlike an RDD
    checkpoint the copy is columnar and has a size Spark can plan with.
    """
    path = fresh_dir(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def delete_path(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
