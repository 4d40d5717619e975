from pyspark.sql import functions as F

from spanloom.plans import session


def test_a_run_stores_in_one_folder_and_clears_it(spark):
    first = session.stored(spark.range(5), "some")
    empty = session.stored(spark.range(0).withColumn("a", F.lit("x")), "none")
    assert first.count() == 5 and empty.count() == 0 and empty.columns == ["id", "a"]
    path = spark._jvm.org.apache.hadoop.fs.Path(session.run_folder(spark))
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    assert fs.exists(path)
    session.clear_run(spark)
    assert not fs.exists(path)
