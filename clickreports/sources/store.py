"""Tables kept in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder.

    Only a local session that names none, as in tests, gets a temporary folder: its
    driver and executors are one process. It is then set on the session's context,
    so later calls share it.
    """
    named = spark.conf.get(_CHECKPOINT_DIR, None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_CHECKPOINT_DIR} to a folder all executors can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="clickreports-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


class Store:
    """Writes a DataFrame once and hands back the table.

    Reading it back cuts the lineage, survives lost executors, and gives the planner
    the table's real size: small ones are broadcast below the session's
    ``spark.sql.autoBroadcastJoinThreshold``, large ones meet in a shuffled join
    whose hot partitions adaptive execution splits. The tables stay in ``folder``
    until ``close``, or the end of a ``with`` block.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self._spark = spark
        self.folder = folder or f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"

    def close(self) -> None:
        """Delete this store's tables; DataFrames over them can't be read after."""
        jvm = self._spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self._spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def land(self, name: str, table: DataFrame) -> DataFrame:
        path = f"{self.folder}/{name}"
        # The folder is this store's own; only a failed attempt can have left files here.
        table.write.mode("overwrite").parquet(path)
        return self._spark.read.schema(table.schema).parquet(path)
