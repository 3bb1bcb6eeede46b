"""Access to the folder all executors share, and tables written there to cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    On a cluster the setting must be there: a folder of one machine would not
    survive the loss of that machine.  In local mode, where all tasks run in one
    JVM, a temporary folder is made when the setting is absent.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        _OWN[app] = tempfile.mkdtemp(prefix="kvern-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return _OWN[app]


class Stage:
    """Tables of one run of an operator, written to the shared folder.

    A written table cuts the lineage: if an executor is lost later, the table is
    read again instead of being computed again.  ``drop`` removes a table that no
    later step reads; the rest, which results may still read, goes when the session's
    driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        at, files = self._files(self.root)
        files.deleteOnExit(at)

    def _files(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def there(self, table: str) -> bool:
        at, files = self._files(self.path(table))
        return files.exists(at)

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def write(self, df: DataFrame, table: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(table))
        return self.spark.read.schema(df.schema).parquet(self.path(table))

    def read(self, tables: list[str], like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(*map(self.path, tables))

    def drop(self, table: str) -> None:
        at, files = self._files(self.path(table))
        files.delete(at, True)


def local_session(cpus: int = 8, shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A session for tests, the bench and trials on one machine."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("kvern")
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
