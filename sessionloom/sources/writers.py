"""Sinks."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def as_json_report(metrics: DataFrame, key: str = "metric") -> DataFrame:
    """Metric rows to one JSON text per row."""
    rest = [c for c in metrics.columns if c != key]
    return metrics.select(key, F.to_json(F.struct(*rest)).alias("payload"))


def write_report_json(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").json(path)


def write_sequences(sequences: DataFrame, scaler: DataFrame, path: str) -> None:
    """Array-column sequences next to the scaler parameters that standardised them."""
    sequences.write.mode("overwrite").parquet(f"{path}/sequences")
    scaler.write.mode("overwrite").parquet(f"{path}/scaler")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
