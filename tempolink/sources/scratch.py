"""Tables of one job in storage that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it.

    Only a local session (as in tests) may leave it unset; it then gets a
    temporary folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if jvm_dir.isDefined():
        return jvm_dir.get().rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):  # local-cluster has executors of its own
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="tempolink-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


class Scratch:
    """Written tables that cut lineage and survive the loss of executors.

    ``keep`` writes a DataFrame and reads it back; ``drop`` frees tables that no
    later step reads, and ``release`` all but those that one does.  What is left
    goes with the application.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: list[str] = []
        fs, root = self._at(self.root)
        fs.mkdirs(root)  # only what is there can be marked for deletion
        fs.deleteOnExit(root)

    def _at(self, path: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def keep(self, df: DataFrame, row_group: int | None = None, **counts: Column) -> DataFrame:
        """The written table; ``counts`` are aggregates taken while it is written, then its attribute of that name.

        ``row_group``: bytes of a row group, for long values, as a reader holds many rows of one.
        """
        path = f"{self.root}/{len(self.paths):04d}"
        self.paths.append(path)
        seen = Observation()
        schema = df.schema
        if counts:
            df = df.observe(seen, *[c.alias(k) for k, c in counts.items()])
        writer = df.write.option("compression", "zstd")
        (writer.option("parquet.block.size", row_group) if row_group else writer).parquet(path)
        kept = self.spark.read.schema(schema).parquet(path)
        kept._scratch_path = path
        kept.counts = seen.get if counts else {}
        return kept

    def keep_dealt(self, df: DataFrame, buckets: int, *keys: str) -> DataFrame:
        """As ``keep``, in buckets of the keys: joins on all of these shuffle the other side only.

        ``df`` is dealt to as many partitions by the same keys, one file each.
        """
        path, name = f"{self.root}/{len(self.paths):04d}", f"dealt_{uuid.uuid4().hex}"
        self.paths.append(path)
        df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, *keys).saveAsTable(name)
        kept = self.spark.table(name)
        # the rows stay, only the name goes
        self.spark.sql(f"DROP TABLE {name}")
        kept._scratch_path = path
        kept.counts = {}
        return kept

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            fs, path = self._at(df._scratch_path)
            fs.delete(path, True)
            self.paths = [p if p != df._scratch_path else "" for p in self.paths]

    def release(self, *still_read: DataFrame) -> None:
        """Frees all tables but the given ones."""
        for path in {p for p in self.paths if p} - {df._scratch_path for df in still_read}:
            fs, at = self._at(path)
            fs.delete(at, True)
        self.paths = [p if p in {df._scratch_path for df in still_read} else "" for p in self.paths]
