"""Streaming twins of operators that are incremental by nature."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.plans.session import new_folder


def table_stream(spark: SparkSession, path: str) -> DataFrame:
    """The Parquet files of a folder, or a single one, as a stream with the schema that they have."""
    rows = spark.readStream.schema(spark.read.parquet(path).schema)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        return rows.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())
    return rows.parquet(path)


def completed(stream: DataFrame, name: str, seconds: int = 3600) -> DataFrame:
    """What a streaming aggregate gives once all that is there now has been read, as a table.

    The query runs in micro-batches with its state and checkpoint in the run's folder; each batch
    replaces the table, written by the executors.
    """
    spark, folder = stream.sparkSession, new_folder(stream.sparkSession, name)
    query = stream.writeStream.outputMode("complete").option("checkpointLocation", f"{folder}-state").trigger(availableNow=True)
    query = query.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(folder)).start()
    if not query.awaitTermination(seconds):
        query.stop()
        raise TimeoutError(name)
    return spark.read.schema(stream.schema).parquet(folder)


def envelope(stream: DataFrame, key: str, time: str, value: str, width: str, late: str = "1 hour") -> DataFrame:
    """key, block_start, min, max, rms of each tumbling window; state ends with the watermark."""
    rows = stream.withWatermark(time, late)
    out = rows.groupBy(key, F.window(time, width).alias("w")).agg(F.min(value).alias("min"), F.max(value).alias("max"), F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"))
    return out.select(key, F.col("w.start").alias("block_start"), "min", "max", "rms")


def gap_sessions(stream: DataFrame, key: str, time: str, gap_us: int, late: str = "1 hour") -> DataFrame:
    """key, first, last, tokens of runs of events less than the gap apart.

    Spark's sessions join events exactly a gap apart and ours split there, hence a microsecond less.
    """
    window = F.session_window(time, f"{gap_us - 1} microseconds")
    out = stream.withWatermark(time, late).groupBy(key, window.alias("w")).agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count(F.lit(1)).alias("tokens"))
    return out.drop("w")
