"""What a session needs before Python functions of this package run on executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's source to the executors through Spark, once an application.

    Executors then import it wherever they run and whatever their working directory is.
    """
    context = spark.sparkContext
    if context.applicationId not in _shipped and os.path.isdir(PACKAGE):
        _shipped.add(context.applicationId)
        folder = tempfile.mkdtemp(prefix="spanloom-src-")
        path = os.path.join(folder, "spanloom_src.zip")
        with zipfile.ZipFile(path, "w") as out:
            for top, _, names in os.walk(PACKAGE):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(top, name)
                        out.write(full, os.path.join("spanloom", os.path.relpath(full, PACKAGE)))
        context.addPyFile(path)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in spark.checkpoint.dir.

    Only in local mode, where one process is driver and executor, a temporary folder stands in
    for a setting that is absent.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the executors share")
    folder = "file://" + os.path.join(tempfile.gettempdir(), f"spanloom-{os.getuid()}")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def run_folder(spark: SparkSession) -> str:
    """Where an application keeps what it computes once: one folder, which :func:`clear_run` deletes."""
    return f"{shared_dir(spark)}/spanloom-runs/{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own for each call, so that a second run meets nothing of the first."""
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df, computed once: written as Parquet into the run's folder and read again.

    What calls a model must not run again for each reader, and a lost executor costs nothing,
    as the files are in the shared folder. The schema goes along, so an empty table is read
    back too.
    """
    spark = df.sparkSession
    folder = new_folder(spark, name)
    df.write.option("compression", codec).parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def clear_run(spark: SparkSession) -> None:
    """Delete what this application has stored, once its results are written: DataFrames that still read it fail then."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
