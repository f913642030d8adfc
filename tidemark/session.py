"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

# Settings a job on this library should run with. Joins carry no broadcast hints: Spark
# broadcasts a side only when its size estimate is below autoBroadcastJoinThreshold, and
# adaptive execution re-checks with measured sizes and splits skewed shuffle partitions.
RECOMMENDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def local_session(cores: str | int = 8, app: str = "tidemark", **conf: str) -> SparkSession:
    """A local session for tests and the benchmark."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.shuffle.partitions", str(cores))
               .config("spark.driver.memory", "8g"))
    for key, value in {**RECOMMENDED, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


# Shuffle files go when the query that made them ends, not when the driver happens to collect garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a private one only for a local session without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="tidemark-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return os.path.join(shared_folder(spark), "tidemark", f"{name}-{uuid.uuid4().hex}")


PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()  # of stored tables


def stored(rows: DataFrame, name: str) -> DataFrame:
    """Write ``rows`` once to the shared folder and read them back.

    Cuts lineage and freezes non-repeatable columns; the files outlive lost executors. Shuffle files of the write are
    freed at its end. :func:`free` deletes the files when nothing reads the rows any more.
    """
    spark = rows.sparkSession
    path, before = new_path(spark, name), spark.conf.get(FREE_SHUFFLES)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        rows.write.parquet(path)
    finally:
        spark.conf.set(FREE_SHUFFLES, before)
    out = spark.read.schema(rows.schema).parquet(path)
    PATHS[out] = path
    return out


def free(*tables: DataFrame) -> None:
    """Delete the files of tables made by :func:`stored`, which nothing may read afterwards."""
    for table in tables:
        spark, path = table.sparkSession, PATHS.pop(table)
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
