"""What every operator of this subpackage shares: reading tables, the shared scratch folder, Arrow passes.

Scratch tables go to the folder that the cluster names in ``spark.checkpoint.dir``; only where that is
unset and Spark runs on one machine (tests, a laptop) a local one is made.  They are plain Parquet, so a lost executor costs a re-read,
never a recomputation of the lineage above them.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.packing import ship

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow with bounded batches."""
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)


def _scratch_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="curatrix-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).delete(where, True)


class Scratch:
    """Tables of one run in the shared folder; dropped one by one when done with, the rest at exit."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{_scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self._end)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write df as Parquet and read it again: cuts the lineage."""
        df.write.parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            remove(self.spark, f"{self.path}/{name}")

    def only(self, df: DataFrame, name: str) -> DataFrame:
        """Save df and drop all tables before it."""
        out = Scratch(self.spark, name).save(df, "out")
        remove(self.spark, self.path)
        return out

    def _end(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                remove(self.spark, self.path)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            pass


def sql_text(column: str = "text") -> F.Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
