"""Tables and files shared by all executors, used to cut lineage between the steps of an operator."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

from siftwell.sources import shared
from siftwell.sources.shared import shared_dir  # noqa: F401


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared.shared_dir(spark)}/siftwell/{name}-{uuid.uuid4().hex}"


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder as a URI that executors' Python can open with `files`."""
    fs, p = shared.file_system(spark, new_path(spark, name))
    fs.mkdirs(p)
    return fs.makeQualified(p).toString().replace("file:/", "file:///", 1).replace("file://///", "file:///", 1)


def files(uri: str):
    """(file system, path) of a URI: local or mounted folders, HDFS and object stores."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def free_prefix(columns: list[str], *names: str) -> str:
    """A prefix of underscores under which none of the names is a column yet (column names don't differ by case alone)."""
    prefix, taken = "__", {c.lower() for c in columns}
    while any(f"{prefix}{n}".lower() in taken for n in names):
        prefix += "_"
    return prefix


class Table:
    """A written table. `read()` gives a DataFrame without lineage; `drop()` deletes the files."""

    def __init__(self, df: DataFrame, name: str, partition_by: list[str] | None = None):
        self.spark, self.schema = df.sparkSession, df.schema
        self.path = new_path(self.spark, name)
        writer = df.write.mode("errorifexists").option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        shared.delete(self.spark, self.path)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of steps whose results are already in tables."""
    gc.collect()
    spark._jvm.System.gc()
