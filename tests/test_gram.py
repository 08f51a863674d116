"""Pair sums of many columns against pandas."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tabcal.operators import gram, linear as L, profile as P


def test_correlations_of_pairs_equal_pandas(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame(rng.normal(size=(500, 6)) + 1e4, columns=list("abcdef"))
    pdf["b"] = pdf.a * 2 + rng.normal(size=500)
    pdf.loc[rng.random(500) < 0.3, "a"] = np.nan
    pdf.loc[rng.random(500) < 0.5, "c"] = np.nan
    pdf["constant"] = 7.5
    pdf["gone"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("a", F.when(~F.isnan("a"), F.col("a"))).repartition(6)
    got = {(r.left_column, r.right_column): r.r for r in P.correlation_matrix(df, list(pdf.columns)).collect()}
    want = pdf.corr()
    for (a, b), r in got.items():
        w = want.loc[a, b]
        assert (r is None) == bool(np.isnan(w)) and (r is None or abs(r - w) < 1e-9)
    assert len(got) == 64
    assert all(r.r is None for r in P.correlation_matrix(df.limit(0), ["a", "b"]).collect())


def test_five_hundred_columns_in_one_pass(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3_000, 500))
    x[:, 7] = x[:, 3] + 0.1 * rng.normal(size=3_000)
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "i long, v array<double>").repartition(4)
    df = rows.select(*[F.col("v")[i].alias(f"x{i}") for i in range(500)])
    names = [f"x{i}" for i in range(500)]
    assert np.allclose(gram.correlations(gram.pair_moments(df, names)), np.corrcoef(x.T), atol=1e-10)
    vif = {r.feature: r.VIF for r in L.vif_table(df.select(names[:40]), names[:40]).collect()}
    want = np.diag(np.linalg.inv(np.corrcoef(x[:, :40].T)))
    assert all(abs(vif[c] / w - 1) < 1e-8 for c, w in zip(names[:40], want))
