"""Settings and split metadata as one JSON row."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T


def save(spark: SparkSession, settings: dict, schema: T.StructType, path: str) -> None:
    row = [tuple(settings.get(name) for name in schema.fieldNames())]
    spark.createDataFrame(row, schema).coalesce(1).write.mode("overwrite").option(
        "ignoreNullFields", False
    ).json(path)


def load(spark: SparkSession, schema: T.StructType, path: str) -> dict:
    rows = spark.read.schema(schema).json(path).take(2)
    if len(rows) != 1:
        raise ValueError(f"expected one settings row in {path}, found {len(rows)}")
    return rows[0].asDict()
