"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``. Only where neither that
    setting nor a checkpoint folder exists and all tasks run in the driver's own
    process (tests), a temporary folder is set.
    """
    root = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="textloom-")
        spark.sparkContext.setCheckpointDir(root)
    return root


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the written table.

    Cuts lineage: a lost executor costs a re-read, not a recomputation, and
    later passes see the same rows.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark).rstrip('/')}/textloom/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished queries: it does so once the driver has collected its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote and nothing reads any more; then sweep."""
    spark = tables[0].sparkSession
    for df in tables:
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/textloom/" in name:
                path = spark._jvm.org.apache.hadoop.fs.Path(name)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    sweep(spark)
