"""Tables written to the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which the driver and all executors see. Where it is unset, a local session gets a
    temporary one; a cluster must name it."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spindrift-")
        atexit.register(shutil.rmtree, found, True)
        sc.setCheckpointDir(found)
    return found


@contextmanager
def setting(spark: SparkSession, **values: str):
    """Session settings (dots as two underscores) for the time of a block; the caller's come back after it."""
    before = {k: spark.conf.get(k.replace("__", "."), None) for k in values}
    for k, v in values.items():
        spark.conf.set(k.replace("__", "."), v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k.replace("__", "."))
            else:
                spark.conf.set(k.replace("__", "."), v)


class Scratch:
    """Tables written to the shared folder. They cut lineage, so a lost executor costs at most the stage at hand."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/spindrift-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str, options: dict | None = None) -> DataFrame:
        """Write a table and return it as read back. The shuffles that led to it are removed with the write."""
        with setting(self.spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
            df.write.mode("overwrite").options(**{"compression": "zstd"} | (options or {})).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Remove tables that nothing returned depends on."""
        jvm = self.spark._jvm
        for name in names:
            p = jvm.org.apache.hadoop.fs.Path(self.path(name))
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
