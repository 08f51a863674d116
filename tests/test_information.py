"""The k-neighbour estimate of mutual information against all pairs."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabcal.operators import information as I, scale as S


def psi(m):
    return -0.57721566490153286 + sum(1.0 / i for i in range(1, m))


def by_all_pairs(x, y, k):
    dx, dy = np.abs(x[:, None] - x[None, :]), np.abs(y[:, None] - y[None, :])
    joint = np.maximum(dx, dy)
    np.fill_diagonal(joint, np.iinfo(np.int64).max)
    r = np.sort(joint, axis=1)[:, k - 1]
    counts = [(np.where(r[:, None] > 0, d < r[:, None], d == 0)).sum(axis=1) for d in (dx, dy)]
    return max(0.0, psi(len(x)) + psi(k) - sum(np.mean([psi(int(c)) for c in count]) for count in counts))


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    n = 700
    y = rng.normal(size=n)
    close = 0.9 * y + math.sqrt(1 - 0.81) * rng.normal(size=n)
    frame = pd.DataFrame({
        "row_id": np.arange(n), "y": y, "close": close, "apart": rng.normal(size=n), "steps": np.floor(2 * close), "flat": 4.0,
        "holes": np.where(np.arange(n) % 3 == 0, np.nan, close), "few": np.where(np.arange(n) < 3, close, np.nan), "none": np.nan,
    })
    frame.loc[10:30, ["y", "close"]] = frame.loc[10, ["y", "close"]].to_numpy()  # repeated rows
    return spark.createDataFrame(frame).repartition(5).cache()


def test_estimate_equals_all_pairs(rows):
    features = ["close", "apart", "steps", "flat", "holes", "few", "none"]
    got = {r.column: r for r in I.neighbor_mutual_information(rows, features, "y", "row_id").collect()}
    for feature in features[:5]:
        points = I.joint_points(rows, feature, "y", "row_id").toPandas()
        assert len(points) == got[feature].n_rows
        want = by_all_pairs(points["x"].to_numpy(), points["y"].to_numpy(), 3)
        assert got[feature].mutual_information == pytest.approx(want, abs=1e-9)
    assert got["few"].n_rows == 3 and got["few"].mutual_information is None
    assert got["none"].n_rows == 0 and got["none"].mutual_information is None
    assert abs(got["close"].mutual_information + 0.5 * math.log(1 - 0.81)) < 0.15
    assert got["apart"].mutual_information < 0.1 < got["steps"].mutual_information


def test_radius_across_boxes_equals_all_pairs(spark):
    """Lines, a far point, copies and boxes far smaller than the data, so most squares leave their box."""
    rng = np.random.default_rng(11)
    x = np.r_[rng.integers(0, 5, 600) * 10**6 + rng.integers(0, 3, 600), rng.integers(0, 10**7, 600), 10**12]
    y = np.r_[rng.integers(0, 10**4, 600), rng.integers(0, 10**7, 600), 5]
    frame = pd.DataFrame({"x": x, "y": y}).drop_duplicates().reset_index(drop=True)
    frame["m"] = rng.choice([1, 1, 1, 2, 3, 9], len(frame))
    frame.insert(0, "id", np.arange(len(frame)))
    got = I.plane_radius(spark.createDataFrame(frame), 3, box_rows=40).toPandas().set_index("id")["radius"]
    at = np.repeat(frame[["x", "y"]].to_numpy(), frame["m"], axis=0)
    for r in frame.itertuples():
        d = np.sort(np.abs(at - np.array([r.x, r.y])).max(axis=1))
        assert got[r.id] == d[3]


def test_digamma(spark):
    got = spark.range(1, 60).select("id", I.digamma(F.col("id").cast("double")).alias("p")).collect()
    assert all(abs(r.p - psi(r.id)) < 1e-11 for r in got)


def test_running_weights_match_pandas(spark):
    rng = np.random.default_rng(6)
    frame = pd.DataFrame({"k": np.where(rng.random(4000) < 0.7, "hot", rng.integers(0, 40, 4000).astype(str)), "v": rng.integers(0, 500, 4000) / 4, "w": rng.integers(0, 3, 4000)})
    frame.loc[:50, "v"] = np.nan
    frame.loc[60:90, "k"] = None
    df = spark.createDataFrame(frame)
    got = S.running_weights(df, ["k"], "v", "w").toPandas().sort_values(["k", "v"]).reset_index(drop=True)
    want = frame.dropna(subset=["v"]).groupby(["k", "v"], dropna=False, as_index=False)["w"].sum().sort_values(["k", "v"]).reset_index(drop=True)
    want["before"] = want.groupby("k", dropna=False)["w"].cumsum() - want["w"]
    assert got["own"].tolist() == want["w"].tolist() and got["before"].tolist() == want["before"].tolist()
