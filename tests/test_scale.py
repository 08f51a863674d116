import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabcal.operators import calibrate as K, scale as S


@pytest.fixture
def skewed(spark):
    """One key holds most rows, one value holds a third of them, one key is NULL."""
    rng = np.random.default_rng(1)
    n = 6000
    key = np.where(rng.random(n) < 0.7, "hot", rng.choice(["a", "b", "c"], n))
    value = np.where(rng.random(n) < 0.33, 5.0, rng.normal(0, 10, n))
    pdf = pd.DataFrame({"k": key, "v": value, "i": np.arange(n)})
    pdf.loc[pdf.k == "c", "k"] = None
    return spark.createDataFrame(pdf).repartition(7), pdf


@pytest.fixture
def small_limits(monkeypatch):
    monkeypatch.setattr(S, "WHOLE_GROUP_ROWS", 100)
    monkeypatch.setattr(S, "SKETCH_ACCURACY", 200)
    monkeypatch.setattr(S, "BRACKET", 4 / 200)


@pytest.mark.parametrize("large_rows", [10, 1_000_000])
def test_quantiles_match_numpy(skewed, small_limits, large_rows):
    df, pdf = skewed
    got = S.exact_quantiles(df, ["k"], "v", {"q1": 0.25, "q2": 0.5, "q9": 0.9}, count_as="n", large_rows=large_rows).toPandas()
    assert len(got) == 4
    for _, row in got.iterrows():
        part = pdf[pdf.k.isna()] if row.k is None else pdf[pdf.k == row.k]
        assert row.n == len(part)
        assert np.allclose([row.q1, row.q2, row.q9], np.quantile(part.v, [0.25, 0.5, 0.9]), atol=1e-12)


def test_global_quantiles_and_many_probabilities(skewed, small_limits):
    df, pdf = skewed
    probs = {f"p{i}": i / 20 for i in range(1, 20)}
    got = S.exact_quantiles(df, [], "v", probs).first()
    assert np.allclose([got[p] for p in probs], np.quantile(pdf.v, list(probs.values())))


@pytest.mark.parametrize("large_rows", [10, 1_000_000])
def test_order_statistics(skewed, small_limits, large_rows):
    df, pdf = skewed
    got = S.order_statistics(df, ["k"], "v", {"third": (0.3, F.ceil(F.col("_n") * 0.3))}, large_rows=large_rows).toPandas()
    hot = np.sort(pdf[pdf.k == "hot"].v.to_numpy())
    assert got[got.k == "hot"].third.iloc[0] == hot[int(np.ceil(len(hot) * 0.3)) - 1]


def test_value_ranks_match_pandas(skewed):
    df, pdf = skewed
    got = S.value_ranks(df, ["k"], "v").withColumn("r", S.average_rank()).toPandas()
    pdf = pdf.assign(k=pdf.k.fillna("none"))
    want = pdf.assign(r=pdf.groupby("k").v.rank())[["k", "v", "r"]].drop_duplicates().sort_values(["k", "v"])
    got = got.assign(k=got.k.fillna("none")).sort_values(["k", "v"])
    assert np.allclose(got.r.to_numpy(), want.r.to_numpy())


def test_spearman_matches_pandas_with_a_hot_group_and_value(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"g": rng.choice(["x", "x", "x", "y", "z"], 3000), "a": rng.integers(0, 30, 3000).astype(float), "b": rng.normal(size=3000)})
    pdf.loc[rng.random(3000) < 0.4, "a"] = 7.0
    pdf.loc[:40, "b"] = np.nan
    pdf.loc[50, "g"] = "single"
    df = spark.createDataFrame(pdf).repartition(6)
    known = pdf.dropna()
    want = {g: d.a.rank().corr(d.b.rank()) for g, d in known.groupby("g") if len(d) > 1}
    got = {r.g: r.rho for r in K.spearman(df, ["g"], "a", "b", "rho").collect()}
    assert all(abs(got[g] - want[g]) < 1e-9 for g in want) and got["single"] is None


def test_attach_keeps_every_row_once_with_hot_and_null_keys(skewed):
    df, pdf = skewed
    stats = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("m"))
    split = {"hot_groups": 1, "broadcast_rows": 0}
    for arguments in ({"size_col": "n"}, {"size_col": "n", **split}, {"bounded": True}, {}, {"count_rows": True}, {"count_rows": True, **split}):
        out = S.attach(df, stats, ["k"], **arguments).toPandas()
        assert sorted(out.i) == list(range(len(pdf))) and out.m.notna().all()
        assert out.groupby("k", dropna=False).n.nunique().eq(1).all()


def test_constant_group_gives_null_not_an_error(spark):
    df = spark.createDataFrame([("g", 1.0, 2.0), ("g", 1.0, 3.0)], "g string, a double, b double")
    assert df.groupBy("g").agg(S.safe_corr("a", "b").alias("r")).first().r is None


@pytest.mark.parametrize("how", ["size_col", "count_rows"])
def test_hot_key_is_split_over_the_partitions(spark, how):
    """One key with 90% of the rows, no adaptive execution, no automatic broadcast: no partition holds twice the mean."""
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        df = spark.range(0, 100_000, 1, 8).select(F.when(F.col("id") % 10 > 0, -1).otherwise(F.col("id") % 5000).alias("k"), "id")
        stats = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.avg("id").alias("m"))
        out = S.attach(df, stats, ["k"], size_col="n", hot_groups=1, broadcast_rows=0) if how == "size_col" else S.attach(df, stats.drop("n"), ["k"], count_rows=True, hot_groups=1, broadcast_rows=0)
        assert out.where(F.col("m").isNull()).count() == 0
        counts = [r["n"] for r in out.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
        assert sum(counts) == 100_000 and max(counts) <= 2 * 100_000 / len(counts)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("arguments", [{"size_col": "n"}, {"count_rows": True}])
def test_five_chained_calls_read_the_input_once_each(spark, tmp_path, arguments):
    """The result's plan holds the input once, and each call adds its statistics (twice), whatever came before."""
    path = f"{tmp_path}/rows"
    spark.range(3000).select("id", (F.col("id") % 7).alias("k")).write.parquet(path)
    df = spark.read.parquet(path)
    for call in range(5):
        stats = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.avg("id").alias(f"m{call}"))
        stats = stats if "size_col" in arguments else stats.drop("n")
        df = S.attach(df, stats, ["k"], hot_groups=2, broadcast_rows=0, **arguments)
        df = df.drop("n")
    plan = df._jdf.queryExecution().optimizedPlan()
    relations = plan.collectLeaves().size()
    assert relations <= 1 + 2 * 5
    assert df.count() == 3000 and df.where(" OR ".join(f"m{i} IS NULL" for i in range(5))).count() == 0


def test_equal_rows_of_a_hot_group_are_dealt_out(spark):
    df = spark.range(0, 40_000, 1, 8).select(F.lit("same").alias("k"))
    stats = df.groupBy("k").agg(F.count(F.lit(1)).alias("n")).unionByName(spark.sql("SELECT 'other' AS k, 0L AS n"))
    out = S.attach(df, stats, ["k"], size_col="n", hot_groups=1, broadcast_rows=0)
    assert out.where("n = 40000").count() == 40_000
