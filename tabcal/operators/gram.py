"""Sums over all pairs of columns in one pass: a task adds up matrices, not one expression per pair."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

CHUNK_ROWS = 4_096  # rows multiplied at once
MERGED = 64  # sums of tasks are merged in so many groups first


def pair_moments(df: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(n, s, q, c), each columns x columns, over the rows where both columns are known (neither NULL nor NaN): rows, sum and sum of squares of
    the first column, sum of products; all around the columns' means.

    A task keeps four matrices whatever its rows; their rows are summed by number, first in groups of tasks, so the driver gets one row per
    column.
    """
    columns, d = list(columns), len(columns)
    known = df.select(*[F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double")).alias(f"x{i}") for i, c in enumerate(columns)])
    means = np.array([m or 0.0 for m in known.agg(*[F.avg(f"x{i}") for i in range(d)]).first()], dtype=float)

    def add(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        total = np.zeros((4, d, d))
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK_ROWS):
                part = batch.slice(at, CHUNK_ROWS)
                x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in part.columns]).astype(float) - means
                mask = (~np.isnan(x)).astype(float)
                x = np.where(mask > 0, x, 0.0)
                total += np.stack([mask.T @ mask, x.T @ mask, (x * x).T @ mask, x.T @ x])
        flat = total.transpose(1, 0, 2).reshape(d, 4 * d)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(d), pa.int32()), pa.array([TaskContext.get().partitionId() % MERGED] * d, pa.int32()), pa.array(list(flat), pa.list_(pa.float64()))], ["i", "part", "v"])

    def merge(pdf):
        return pd.DataFrame({"i": pdf["i"].iloc[:1], "v": [np.sum(np.stack(pdf["v"].to_list()), axis=0)]})

    parts = known.mapInArrow(add, "i int, part int, v array<double>")
    summed = parts.groupBy("i", "part").applyInPandas(merge, "i int, v array<double>").groupBy("i").applyInPandas(merge, "i int, v array<double>")
    out = np.zeros((d, 4 * d))
    for row in summed.collect():
        out[row["i"]] = row["v"]
    return tuple(out.reshape(d, 4, d).transpose(1, 0, 2))


def correlations(moments) -> np.ndarray:
    """Pearson correlation of each pair on the rows where both are known; NaN where one of them has no spread there."""
    n, s, q, c = moments
    with np.errstate(divide="ignore", invalid="ignore"):
        mean, square = s / n, q / n
        spread = square - mean ** 2
        spread = np.where(spread > 1e-13 * square, spread, np.nan)
        r = (c / n - mean * mean.T) / np.sqrt(spread * spread.T)
    return np.where(np.eye(len(n), dtype=bool), np.where(np.isnan(np.diag(spread)), np.nan, 1.0), r)
