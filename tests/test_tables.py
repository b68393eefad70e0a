from pyspark.sql import functions as F

from tempolink.sources import tables


def test_tasks_are_as_many_as_the_data_needs(spark, small):
    """Before, shuffled rows were merged into as many tasks as there are cores, however many rows there were."""
    keys = (tables._MERGED, tables._BEGUN)
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        tables.table(spark, small, "orders")
        tables.small_tasks(spark, 64 * tables.FILE_BYTES)
        tasks = spark.range(4_000_000).select(F.xxhash64("id").alias("h")).distinct().rdd.getNumPartitions()
        assert tasks > 4
        spark.conf.set(tables._MERGED, "1m")
        tables.small_tasks(spark, tables.FILE_BYTES)
        assert spark.conf.get(tables._MERGED) == "1m" and spark.conf.get(tables._BEGUN) == "64"
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_a_task_holds_no_more_of_larger_tables(spark, small, tmp_path):
    """F16 to F23: before, a scan task read up to 128 MB, and a shuffle began with one partition for 4 MB of files, 10 MB of edges."""
    keys = (tables._MERGED, tables._BEGUN, tables._SCANNED)
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        spark.conf.set(tables._SCANNED, "128m")
        tables.table(spark, small, "orders")
        assert spark.conf.get(tables._SCANNED) == f"{tables.SCAN_BYTES}b"
        tables.small_tasks(spark, 4 << 30)
        assert int(spark.conf.get(tables._BEGUN)) * tables.TASK_BYTES >= 3 * (4 << 30)
        spark.conf.set(tables._SCANNED, "1m")
        tables.small_tasks(spark, 4 << 30)
        assert spark.conf.get(tables._SCANNED) == "1m"
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
