"""Services: one folder of tables each, opened for reading, listed and deleted on their own."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Fixed value: what a service may be called.
NAME = re.compile(r"[a-z][a-z0-9_-]{0,62}")
TABLES = ("thought", "edge", "embedding", "action", "journal_entry")


class Services:
    """The services under one folder, in any file system that Spark reads."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, *parts: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _check(self, name: str) -> str:
        if not NAME.fullmatch(name):
            raise ValueError(f"{name!r} can't be a service")
        return name

    def list(self) -> list[str]:
        at, fs = self._path()
        found = fs.listStatus(at) if fs.exists(at) else []
        return sorted(x.getPath().getName() for x in found if x.isDirectory() and NAME.fullmatch(x.getPath().getName()))

    def exists(self, name: str) -> bool:
        at, fs = self._path(self._check(name))
        return bool(fs.exists(at))

    def delete(self, name: str) -> bool:
        """Whether there was such a service; it is gone then."""
        at, fs = self._path(self._check(name))
        return bool(fs.exists(at)) and bool(fs.delete(at, True))

    def write(self, name: str, table: str, rows: DataFrame) -> None:
        """Put rows in the place of a service's table."""
        if table not in TABLES:
            raise ValueError(f"{table!r} is no table")
        rows.write.mode("overwrite").parquet(f"{self.root}/{self._check(name)}/{table}")

    def open(self, name: str) -> ReadOnly:
        if not self.exists(name):
            raise ValueError(f"there is no service {name!r}")
        return ReadOnly(self.spark, f"{self.root}/{name}")


class ReadOnly:
    """A service's tables; a name that would write is an error that says so."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self._spark, self._folder = spark, folder

    def table(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise ValueError(f"{name!r} is no table")
        return self._spark.read.parquet(f"{self._folder}/{name}")

    def __getattr__(self, name: str):
        if name in TABLES:
            return self.table(name)
        if re.match(r"(create|update|delete|store|remember|restore|record|upsert|write|invalidate|bulk)", name):
            raise PermissionError(f"{name}: this view can't be written")
        raise AttributeError(name)
