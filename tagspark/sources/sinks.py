"""Writers. Parquet is the better home for large results; CSV is kept for exchange."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagspark.functions.codes import join_codes


def whole_numbers(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Money columns without decimals, cut toward zero."""
    return df.withColumns({c: F.col(c).cast("long") for c in cols})


def sink_csv(
    df: DataFrame, path: str, whole_number_cols: Sequence[str] = (), mode: str = "overwrite"
) -> None:
    writer = whole_numbers(df, whole_number_cols).write.mode(mode)
    writer.option("header", True).option("escape", '"').option("dateFormat", "yyyy-MM-dd").csv(path)


def sink_parquet(df: DataFrame, path: str, by: Sequence[str] = (), mode: str = "overwrite") -> None:
    df.write.mode(mode).partitionBy(*by).parquet(path)


def sink_split_active(
    df: DataFrame, path: str, flag: str = "active", whole_number_cols: Sequence[str] = ()
) -> None:
    """Active and inactive records as two partitions, written in one pass."""
    out = whole_numbers(df, whole_number_cols).withColumn(flag, F.coalesce(flag, F.lit(False)))
    out.write.mode("overwrite").partitionBy(flag).option("header", True).option(
        "escape", '"'
    ).option("dateFormat", "yyyy-MM-dd").csv(path)


def prediction_rows(eval_rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Evaluation rows with both code sets as sorted ``;`` texts."""
    return eval_rows.select(
        *by,
        "org_id",
        join_codes(F.col("true_codes")).alias("true_codes"),
        join_codes(F.col("predicted_codes")).alias("predicted_codes"),
        "prediction_source",
    )


def sink_predictions(eval_rows: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    prediction_rows(eval_rows, by).write.mode("overwrite").partitionBy(*by).option(
        "header", True
    ).csv(path)


def sink_grid(per_state: DataFrame | None, summary: DataFrame | None, path: str) -> None:
    """Optional tables of a settings search."""
    for name, table in (("per_state", per_state), ("summary", summary)):
        if table is not None:
            table.write.mode("overwrite").parquet(f"{path}/{name}")
