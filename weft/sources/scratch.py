"""Intermediate tables in the folder that driver and executors share (``spark.checkpoint.dir``)."""

from __future__ import annotations

import tempfile
import uuid

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Observation, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:  # as in tests
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that all of them share")
        base = _OWN.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="weft-"))
    return base.rstrip("/")


class Tables:
    """Tables written one after the other; reading them needs no earlier lineage.  They go when the
    session's file systems are closed, as lazy results still read them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.count = spark, f"{shared_dir(spark)}/weft-{uuid.uuid4().hex}", 0
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(where)
        files.deleteOnExit(where)

    def write(self, df: DataFrame) -> str:
        return self.counted(df)[0]

    def counted(self, df: DataFrame, what: Column | None = None) -> tuple[str, int]:
        """Writes a table and tells its rows, or another count over them, counted on the way."""
        self.count += 1
        path = f"{self.root}/{self.count}"
        rows = Observation()
        df.observe(rows, (F.count(F.lit(1)) if what is None else what).alias("n")).write.parquet(path)
        return path, rows.get["n"]

    def dealt(self, df: DataFrame, by: str, parts: int, what: Column | None = None) -> tuple[DataFrame, int]:
        """Writes a table dealt by the hash of a column into ``parts`` buckets, and gives it with its rows or another count
        over them: a join or grouping by that column leaves it where it is.  A table that lies so already is not moved."""
        self.count += 1
        path, name, rows = f"{self.root}/{self.count}", f"weft_{uuid.uuid4().hex}", Observation()
        seen = df.observe(rows, (F.count(F.lit(1)) if what is None else what).alias("n"))
        seen.write.bucketBy(parts, by).option("path", path).saveAsTable(name, format="parquet")
        found = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")  # the files stay; what was looked up goes on reading them
        return found, rows.get["n"]

    def split(self, df: DataFrame, by: str, path: str | None = None) -> str:
        """Writes a table with a folder for each value of a column, or adds to one."""
        if path is None:
            self.count += 1
            path = f"{self.root}/{self.count}"
        df.write.mode("append").partitionBy(by).parquet(path)
        return path

    def part(self, path: str, schema, **value) -> DataFrame | None:
        """The rows of a split table in one value's folder, without that column; None if there is no such folder."""
        ((name, wanted),) = value.items()
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}={wanted}")
        files = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return self.read(schema, where.toString()) if files.exists(where) else None

    def drop(self, *paths: str) -> None:
        for path in paths:
            where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def read(self, schema, *paths: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths)
