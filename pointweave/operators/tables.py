"""Tables in the folder that all executors share, for operators that iterate or stream."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder on a local master and an error on any other.

    On a cluster each executor would write a machine-local folder of its own, and reads would silently miss rows.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        folder = "file://" + tempfile.mkdtemp(prefix="pointweave-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """df written as a table and read again, without lineage; it survives lost executors.

    The table stays until release() or until the folder is cleared.
    """
    path = new_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder of the shared store, if it is there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def release(*tables: DataFrame) -> None:
    """Deletes tables made by stored(). Nothing that is still to be computed may read them."""
    for df in tables:
        delete(df.sparkSession, df.stored_path)
