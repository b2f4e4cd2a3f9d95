"""Tables landed between the steps of one operator."""

from __future__ import annotations

import gc
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickreports.sources.store import Store


COLLECT_BYTES = 1 << 20


class Steps(Store):
    """A store whose operator runs in steps, each reading what the one before landed.

    Spark deletes the shuffle files of a finished step when the driver's garbage
    collector finds the plan unused. A driver with free memory may not collect for
    hours, while executors' disks fill; so it is asked for after every ``COLLECT_BYTES``
    landed. Landed tables go as soon as no later step reads them (``drop``), and all but
    the operator's rows at its end (``result``).
    """

    def __init__(self, spark: SparkSession):
        super().__init__(spark)
        self._since = 0

    def land(self, name: str, table: DataFrame) -> DataFrame:
        landed = super().land(name, table)
        del table
        self._since += self._size(name)
        if self._since > COLLECT_BYTES:
            self._since = 0
            gc.collect()
            self._spark.sparkContext._jvm.System.gc()
        return landed

    def _size(self, name: str) -> int:
        return self._files(self._path(name)).getContentSummary(self._path(name)).getLength()

    def drop(self, *names: str) -> None:
        """Delete landed tables that no later step reads."""
        for name in names:
            path = self._path(name)
            self._files(path).delete(path, True)

    def result(self, table: DataFrame, name: str = "result") -> DataFrame:
        """Land the operator's rows and delete every other table of this store."""
        landed = self.land(name, table)
        folder = self._path("")
        for found in self._files(folder).listStatus(folder):
            if found.getPath().getName() != name:
                self._files(folder).delete(found.getPath(), True)
        return landed

    def _path(self, name: str):
        return self._spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _files(self, path):
        return path.getFileSystem(self._spark.sparkContext._jsc.hadoopConfiguration())


ROW = "__row"


def numbered(docs: DataFrame, id_column: str, text_column: str, steps: Steps, nulls_last: bool = False) -> tuple[DataFrame, bool]:
    """``docs`` with ``ROW``, a number per row, ascending with the id; and whether it is the id.

    Unique whole-number ids serve as they are. Otherwise the rows are landed once, in the
    order of id and text hash, and numbered by partition and place: a range of equal or
    missing ids spreads over tasks like any other.
    """
    whole = docs.schema[id_column].dataType.typeName() in ("byte", "short", "integer", "long")
    per_id = docs.groupBy(F.col(id_column).alias("id")).agg(F.count(F.lit(1)).alias("rows"))
    if whole and per_id.where("rows > 1 OR id IS NULL").isEmpty():
        return docs.withColumn(ROW, F.col(id_column).cast("long")), True
    first = F.col(id_column).asc_nulls_last() if nulls_last else F.col(id_column).asc_nulls_first()
    order = (first, F.xxhash64(text_column), F.xxhash64(F.monotonically_increasing_id()))
    return steps.land("numbered", docs.orderBy(*order).withColumn(ROW, F.monotonically_increasing_id())), False


def without(table: DataFrame, *names: str) -> list[str]:
    """The table's columns but those an operator adds itself."""
    taken = {name.lower() for name in names}
    return [c for c in table.columns if c.lower() not in taken]


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors' Python workers, once per application.

    Needed where it is not installed on them; the archive holds the package's sources.
    """
    application = spark.sparkContext.applicationId
    if application not in _SHIPPED:
        package = Path(__file__).resolve().parents[1]
        base = Path(tempfile.mkdtemp(prefix="package-"), package.name)
        spark.sparkContext.addPyFile(shutil.make_archive(str(base), "zip", package.parent, package.name))
        _SHIPPED.add(application)
    return spark
