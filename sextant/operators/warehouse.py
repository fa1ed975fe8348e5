"""The tables on disk: create, read, rewrite by swapping, and start anew."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schemas import TABLES, UNIQUE, checked

MARKER = "_sextant_warehouse"


class Warehouse:
    """A folder of Parquet tables that this engine owns."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._path(f"{self.path}/{name}")

    def bootstrap(self) -> None:
        """Make what is missing; may be repeated."""
        self._fs.mkdirs(self._path(self.path))
        if not self._fs.exists(self._at(MARKER)):
            if len(self._fs.listStatus(self._path(self.path))):
                raise ValueError(f"{self.path} holds other files")
            self._fs.create(self._at(MARKER)).close()
        for name, schema in TABLES.items():
            if not self._fs.exists(self._at(name)):
                self.spark.createDataFrame([], schema).write.parquet(f"{self.path}/{name}")
        self.verify()

    def verify(self) -> None:
        """Every table is there with its columns."""
        for name, schema in TABLES.items():
            found = self.spark.read.parquet(f"{self.path}/{name}").schema
            lacking = {f.name for f in schema.fields} - set(found.names)
            if lacking:
                raise ValueError(f"{name} lacks {sorted(lacking)}")

    def reset(self, confirm: str) -> None:
        """Remove all tables; only of a folder that bootstrap made, and only if its path is repeated."""
        if confirm != self.path or not self._fs.exists(self._at(MARKER)):
            raise ValueError("not a warehouse of this engine, or not confirmed")
        self._fs.delete(self._path(self.path), True)
        self.bootstrap()

    def _current(self, name: str) -> str:
        """A swap that broke off leaves the table under its old name: that is read, until the next write settles it."""
        here = self._fs.exists(self._at(name)) or not self._fs.exists(self._at(f"{name}.old"))
        return f"{self.path}/{name}" if here else f"{self.path}/{name}.old"

    def read(self, name: str) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(self._current(name))

    def append(self, name: str, rows: DataFrame) -> None:
        """Add rows that break no rule, also together with those that are there."""
        new = checked(rows, name)
        for key in UNIQUE[name]:
            if not new.join(self.read(name).select(key), key, "left_semi").isEmpty():
                raise ValueError(f"{name}: repeated {', '.join(key)}")
        self._settle(name)
        new.write.mode("append").parquet(f"{self.path}/{name}")

    def replace(self, name: str, rows: DataFrame) -> None:
        """Write the new state beside the old, then swap."""
        checked(rows, name).write.mode("overwrite").parquet(f"{self.path}/{name}.next")
        self._settle(name)
        self._fs.rename(self._at(name), self._at(f"{name}.old"))
        self._fs.rename(self._at(f"{name}.next"), self._at(name))
        self._fs.delete(self._at(f"{name}.old"), True)

    def _settle(self, name: str) -> None:
        if self._fs.exists(self._at(name)):
            self._fs.delete(self._at(f"{name}.old"), True)
        elif self._fs.exists(self._at(f"{name}.old")):
            self._fs.rename(self._at(f"{name}.old"), self._at(name))
