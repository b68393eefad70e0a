"""Input tables with fixed schemas, and sinks.

A table whose columns or types differ from what a query reads fails when it is
loaded, not somewhere in a plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMAS = {
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}

#: The processed tier; every builder returns one of these.
EXPOSURES = "group_id bigint, node_id bigint, ts timestamp_ntz"
EDGES = "group_id bigint, src bigint, dst bigint, ts timestamp_ntz"


#: Bytes of shuffled data that are merged into one task at most, and of a table's files for each partition that
#: shuffles begin with: edges shuffled are about three times the files that they come from.
TASK_BYTES, FILE_BYTES = 4 << 20, 1 << 20
#: Bytes of a file that one task reads, row groups being whole; else a scan task grows with the file until it reads 128 MB.
SCAN_BYTES = 16 << 20

_SCANNED = "spark.sql.files.maxPartitionBytes"
_MERGED = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
_BEGUN = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def small_tasks(spark: SparkSession, file_bytes: int) -> None:
    """Has this session's shuffles make as many tasks as the data needs, not as there are cores.

    Otherwise AQE merges shuffled partitions until each core has one, or they hold
    64 MB, a scan gives each core one part of a file, and what a task sorts or counts
    grows with the tables.  Settings that are finer already stay.
    """
    as_bytes = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for key, most in ((_MERGED, TASK_BYTES), (_SCANNED, SCAN_BYTES)):
        if most < as_bytes(spark.conf.get(key)):
            spark.conf.set(key, f"{most}b")
    begun = -(-file_bytes // FILE_BYTES)
    if begun > int(spark.conf.get(_BEGUN, spark.conf.get("spark.sql.shuffle.partitions"))):
        spark.conf.set(_BEGUN, str(begun))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    at = f"{sf_dir}/{name}.parquet"
    df = spark.read.parquet(at)
    check(df, SCHEMAS[name], name)
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    small_tasks(spark, path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength())
    return df


def check(df: DataFrame, ddl: str, name: str = "table") -> DataFrame:
    """Fails unless the table has each column of the schema with its type."""
    have = {f.name: f.dataType for f in df.schema}
    for want in T._parse_datatype_string(ddl).fields:
        if have.get(want.name) != want.dataType:
            raise ValueError(f"{name}.{want.name}: {want.dataType.simpleString()} expected, found {have.get(want.name)}")
    return df


def write_edges(edges: DataFrame, path: str, unit: str = "month") -> None:
    """The processed tier, partitioned by time so that later reads prune."""
    check(edges, EDGES, "edges")
    period = F.date_format(F.date_trunc(unit, "ts"), "yyyy-MM-dd").alias("period")
    edges.select("*", period).repartition("period", F.pmod("src", F.lit(16))).write.mode("overwrite").partitionBy("period").parquet(path)


def read_edges(spark: SparkSession, path: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """Edges with a time in [since, until); whole periods outside are never read.

    Periods are named by their first day, so the one that holds ``since`` begins
    up to a year before it.
    """
    df = spark.read.parquet(path)
    time = lambda t: F.lit(t).cast("timestamp_ntz")
    if since:
        first = df.where(F.col("period").cast("date") <= time(since).cast("date")).agg(F.max(F.col("period").cast("string"))).head()[0]
        df = df.where(F.col("ts") >= time(since))
        df = df.where(F.col("period").cast("string") >= F.lit(first)) if first else df
    if until:
        df = df.where((F.col("ts") < time(until)) & (F.col("period").cast("date") <= time(until).cast("date")))
    return check(df.drop("period"), EDGES, "edges")
