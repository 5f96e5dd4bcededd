"""Streams over tables: sources, sinks, and runs over what is available now."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from pointweave.operators.tables import delete, new_path


def stream_of(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int = 1) -> DataFrame:
    """A table's files as a stream; timestamps without zone become timestamps, as watermarks need."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    # As a pattern, the path may be a single file as well as a folder.
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{path[:-1]}[t]")
    return rows.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema.fields if f.dataType.simpleString() == "timestamp_ntz"})


#: A time after all events, which lets event time pass every row of a stream that has ended.
END = datetime.datetime(2200, 1, 1)


def with_end(rows: DataFrame) -> DataFrame:
    """rows, whose event time is ``_time``, and ``_end``, false; rows put into the folder ``end_folder`` of the result end them."""
    spark = rows.sparkSession
    rows = rows.withColumn("_end", F.lit(False))
    folder = new_path(spark, "end")
    spark.createDataFrame([], rows.schema).write.parquet(folder)
    out = rows.unionByName(spark.readStream.schema(rows.schema).parquet(folder))
    out.end_folder = folder, rows.schema
    return out


def append_all(rows: DataFrame, name: str) -> DataFrame:
    """Runs a stream in append mode over all that is there, into a table, and reads the table.

    A stream of with_end is run once more with its end mark, from where it stopped, so that nothing stays in its state.
    """
    spark = rows.sparkSession
    out, progress = new_path(spark, name), new_path(spark, f"{name}-state")
    for last in (False, True) if hasattr(rows, "end_folder") else (False,):
        if last:
            folder, schema = rows.end_folder
            mark = spark.createDataFrame([tuple({"_time": END, "_end": True}.get(c) for c in schema.names)], StructType([StructField(f.name, f.dataType) for f in schema]))
            mark.write.mode("append").parquet(folder)
        query = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", progress).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(out)


def complete_all(rows: DataFrame, name: str) -> DataFrame:
    """Runs a stream in complete mode; the last micro-batch's whole result stands."""
    spark = rows.sparkSession
    base = new_path(spark, name)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/{number}")
        batch.sparkSession.createDataFrame([(number,)], "number long").write.mode("overwrite").parquet(f"{base}/last")
        delete(batch.sparkSession, f"{base}/{number - 1}")

    query = rows.writeStream.foreachBatch(keep).option("checkpointLocation", new_path(spark, f"{name}-state")).outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{base}/{spark.read.parquet(f'{base}/last').first()['number']}")
