"""Steps that are done once: results kept under what they were made from, so that work which was cut off goes on where it was.

A step's folder is named by its name and a digest of its inputs and settings, and counts only when Spark has marked it as
complete; a driver that dies inside a step leaves a folder that the next run overwrites.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagspark.plans.refresh import record_digests


def table_digest(df: DataFrame) -> str:
    """The same for the same rows in any order and in any partitions."""
    whole = df.withColumn("_all", F.lit(0))
    found = record_digests(whole, "_all").first()
    return f"{','.join(sorted(df.columns))}:{found['digest'] if found else ''}"


class Steps:
    """Finished steps under ``path``; ``made`` counts those that this run had to work out."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.made: list[str] = []
        self.used: set[str] = set()

    def _folder(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def key(self, name: str, inputs: Mapping) -> str:
        """The step's folder name: another input or setting is another step."""
        text = json.dumps(inputs, sort_keys=True, default=str)
        return f"{name}-{hashlib.sha256(text.encode()).hexdigest()[:24]}"

    def done(self, key: str) -> bool:
        fs, where = self._folder(f"{self.path}/{key}/_SUCCESS")
        return fs.exists(where)

    def table(self, name: str, inputs: Mapping, make: Callable[[], DataFrame]) -> DataFrame:
        """The rows of a step, worked out only if no run has finished it."""
        key = self.key(name, inputs)
        self.used.add(key)
        at = f"{self.path}/{key}"
        if not self.done(key):
            self.made.append(name)
            make().write.mode("overwrite").parquet(at)
        return self.spark.read.parquet(at)

    def text(self, name: str, inputs: Mapping, make: Callable[[], str]) -> str:
        """One text, such as chosen settings."""
        rows = self.table(name, inputs, lambda: self.spark.createDataFrame([(make(),)], "text string").coalesce(1))
        return rows.first()["text"]

    def clean(self) -> int:
        """Remove the steps that this run did not ask for, and unfinished ones; the number removed."""
        fs, where = self._folder(self.path)
        if not fs.exists(where):
            return 0
        old = [f.getPath() for f in fs.listStatus(where) if f.getPath().getName() not in self.used or not self.done(f.getPath().getName())]
        return sum(bool(fs.delete(p, True)) for p in old)
