"""Sinks: split tables, reports, models and parameters."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabcal.session import delete_at_end, ensure_checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder; it goes when the driver's JVM ends."""
    return delete_at_end(spark, f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}")


def save_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """One Parquet table partitioned by split; X, y and lineage stay row-aligned by construction."""
    df.withColumn("split", F.col(split)).write.mode("overwrite").partitionBy("split").parquet(path)


def save_report(df: DataFrame, paths: Sequence[str]) -> None:
    """The same report as CSV in every given folder."""
    for path in paths:
        df.write.mode("overwrite").option("header", True).csv(path)


def append_report(new: DataFrame, path: str, target: str, keys: Sequence[str]) -> DataFrame:
    """Old results plus new ones, exact repeats removed, written to ``target`` (never over its own input)."""
    old = new.sparkSession.read.parquet(path)
    old.unionByName(new, allowMissingColumns=True).dropDuplicates(list(keys)).write.mode("overwrite").parquet(target)
    return new.sparkSession.read.parquet(target)


def save_model(model, path: str) -> None:
    """Fitted MLlib model or pipeline."""
    model.write().overwrite().save(path)


def save_params(spark: SparkSession, params: dict, path: str) -> None:
    """Frozen configuration as a one-row table of sorted JSON."""
    spark.createDataFrame([(json.dumps(params, sort_keys=True),)], "params string").write.mode("overwrite").json(path)


def load_params(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.json(path).first().params)


def params_json(df: DataFrame, columns: Sequence[str], out: str = "parameters") -> DataFrame:
    """Parameter columns as one JSON text with sorted keys."""
    return df.select(*[c for c in df.columns if c not in columns], F.to_json(F.struct(*sorted(columns))).alias(out))
