"""Scratch tables in the folder that the driver and every executor share.

A written table cuts lineage: if an executor is lost later, the rows are read again from
the shared store and nothing upstream is recomputed.
"""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Folders made for sessions that name none, by application.
_own: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _own.get(spark.sparkContext.applicationId)
        if not root:
            root = _own[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="millrace-")
            atexit.register(shutil.rmtree, root, ignore_errors=True)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/millrace/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """df as a table in the scratch folder, read back from there."""
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Removes a scratch table that no later plan reads."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete shuffle files of finished jobs now, not when memory happens to run low."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
