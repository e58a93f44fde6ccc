"""Written tables in the shared folder of the cluster.

Long jobs are cut by writing a table below ``spark.checkpoint.dir`` and reading
it again: a lost executor then costs the tasks it ran, not the whole lineage.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. Where that is unset, a folder in the warehouse, which a cluster shares; on a local master a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.startswith("local"):
            found = tempfile.mkdtemp(prefix="lodestar-")
        else:
            found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/lodestar-scratch"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, for as long as the driver lives."""
    path = f"{shared_dir(spark)}/lodestar-{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(at)
    store.deleteOnExit(at)  # takes effect for paths that exist
    return path


class Scratch:
    """Tables of one job. ``write`` materialises, ``drop`` frees the disk of a table not needed again."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, new_path(spark, name), 0

    def write(self, df: DataFrame, codec: str = "zstd", conf: dict[str, str] | None = None, long_rows: bool = False) -> DataFrame:
        """The rows of ``df``, written once, planned with the settings ``conf``; shuffle files of the writing job are freed when it ends.

        ``long_rows``: rows of many MB. Each gets a row group, as a writer holds a group (100 rows at least) and a reader decodes up to 4096 rows of one at once.
        """
        self.n += 1
        path = f"{self.root}/{self.n}"
        now = {CLEANUP: "true", **(conf or {})}
        before = {k: self.spark.conf.get(k, None) for k in now}
        for key, value in now.items():
            self.spark.conf.set(key, value)
        try:
            writer = df.write.option("compression", codec)
            (writer.option("parquet.block.row.count.limit", 1) if long_rows else writer).parquet(path)
        finally:
            for key, value in before.items():
                self.spark.conf.unset(key) if value is None else self.spark.conf.set(key, value)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._lodestar_path = path
        return back

    def settle(self) -> None:
        """Lets Spark drop the broadcasts and shuffles of steps that are over: it does when their handles are collected as garbage, which a driver of many small jobs may not do for long."""
        self.spark._jvm.System.gc()

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(table._lodestar_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
