import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabcal.operators import audit as A, bootstrap as B, calibrate as K, splits as S


def interval_rows(spark):
    base = spark.createDataFrame(
        [(0, 0.0, 1.0, 0.0, 2.0), (1, 5.0, 5.0, 4.0, 6.0), (2, 10.0, 8.0, 7.0, 9.0)],
        "row_id int, Actual double, Predicted double, Lower double, Upper double",
    )
    return K.interval_table(base, labels={
        "method": F.lit("m"), "model": F.lit("x"), "evaluation_scheme": F.lit("s"), "split": F.lit("test"), "nominal_coverage": F.lit(0.9)})


def test_conformal_rank(spark):
    scores = spark.createDataFrame([(float(i),) for i in range(1, 6)], "s double")
    assert K.conformal_quantiles(scores, [], "s", [0.2]).first().q_hat == 5.0
    with pytest.raises(ValueError):
        K.conformal_quantiles(scores, [], "s", [1.0])


def test_interval_metrics_by_hand(spark):
    m = K.interval_metrics(interval_rows(spark)).first()
    assert m.EmpiricalCoverage == pytest.approx(2 / 3)
    assert m.MeanIntervalWidth == 2.0
    assert m.MeanWinklerScore == pytest.approx((2 + 2 + 22) / 3)
    assert (m.BelowIntervalRate, m.AboveIntervalRate) == (0.0, pytest.approx(1 / 3))
    assert m.UncertaintyErrorSpearman is None


def test_conformalised_bounds(spark):
    schema = "Actual double, Lower double, Upper double"
    calibration = spark.createDataFrame([(0.0, 0.0, 1.0), (3.0, 2.0, 4.0), (10.0, 6.0, 8.0)], schema)
    evaluation = spark.createDataFrame([(0.0, 5.0, 6.0), (0.0, 7.0, 8.0)], schema)
    out = K.conformalize(calibration, evaluation, [], 0.25).orderBy("Lower").collect()
    assert [(r.Lower, r.Upper, r.q_hat) for r in out] == [(3.0, 8.0, 2.0), (5.0, 10.0, 2.0)]


def test_crossed_interval_and_negative_width_fail(spark):
    bad = spark.createDataFrame([(0, 1.0, 1.0, 3.0, 2.0)], "row_id int, Actual double, Predicted double, Lower double, Upper double")
    with pytest.raises(Exception, match="lower bound above upper bound"):
        K.interval_table(bad, labels={"nominal_coverage": F.lit(0.9)}).collect()
    with pytest.raises(Exception, match="cannot be negative"):
        bad.select(K.checked_half_width(F.lit(-1.0) * F.col("Actual"))).collect()


def test_held_group_roles(spark):
    data = spark.createDataFrame([(g,) for g in "aabbcd"], "g string")
    manifest = spark.createDataFrame([("a", "train"), ("b", "validation"), ("c", "test"), ("d", "train")], "g string, split string")
    roles = S.held_group_roles(S.group_sizes(data, "g"), manifest, "g", "a")
    assert {r.g: r.role for r in roles.collect()} == {"a": "heldout", "b": "calibration", "c": "train", "d": "train"}
    rows = S.apply_manifest(data, roles, "g", "role")
    audit = A.leakage_audit(rows, split="role", group="g", names=["train", "calibration", "heldout"])
    assert all(r.status == "pass" for r in A.fail_on_failed_checks(audit).collect())
    with pytest.raises(Exception, match="absent from manifest"):
        S.held_group_roles(S.group_sizes(data, "g"), manifest.where("g <> 'd'"), "g", "a").collect()


def test_confidence_labels_ignore_dust(spark):
    groups = spark.createDataFrame(
        [("m", "a", 5, 0.5, 0.9, 100.0), ("m", "b", 20, 1.0, 0.9, 100.0 + 1e-10)],
        "method string, g string, n_rows long, EmpiricalCoverage double, nominal_coverage double, MeanIntervalWidth double",
    )
    out = {r.g: r for r in K.confidence_labels(groups).collect()}
    assert out["a"].ConfidenceDiagnostic == "narrow_but_wrong" and out["b"].ConfidenceDiagnostic == "well_calibrated_or_sharp"
    assert (out["a"].CoverageEvidence, out["b"].CoverageEvidence) == ("limited_n_lt_10", "more_stable_n_ge_10")


def bootstrap_frame(spark, n=400):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, 2))
    pdf = pd.DataFrame({"row_id": [f"r{i}" for i in range(n)], "a": x[:, 0], "b": x[:, 1], "y": 3 * x[:, 0] - x[:, 1] + rng.normal(size=n)})
    return spark.createDataFrame(pdf)


def test_bootstrap_is_reproducible_under_repartitioning(spark):
    df = bootstrap_frame(spark)
    def run(d):
        boot = B.ResidualBootstrap(d, row_id="row_id", features=["a", "b"], target="y", repetitions=6, seed=7, block_rows=150, alpha=0.01, l1_ratio=0.5)
        return B.bootstrap_bounds(boot.distribution(d, "row_id"), "row_id", 0.9).orderBy("row_id").toPandas()
    one, two = run(df), run(df.repartition(5, "y"))
    assert np.allclose(one[["Lower", "Upper"]], two[["Lower", "Upper"]], atol=1e-9)


@pytest.mark.parametrize("chunk_rows, block_rows", [(1000, 1000), (37, 1000), (1000, 11), (29, 7)])
def test_bootstrap_has_one_law_at_every_size(spark, chunk_rows, block_rows):
    """Chunks and blocks decide where draws are made, not which: every draw is a position among all residuals, and no row is lost."""
    df = bootstrap_frame(spark)
    boot = B.ResidualBootstrap(df, row_id="row_id", features=["a", "b"], target="y", repetitions=6, seed=7, chunk_rows=chunk_rows, block_rows=block_rows, kind="ols")
    pdf = df.toPandas()
    pdf["h"] = [hashlib.md5(f"{i}|7".encode()).hexdigest() for i in pdf.row_id]
    x = np.column_stack([np.ones(len(pdf)), pdf.a, pdf.b])
    first = np.linalg.lstsq(x, pdf.y, rcond=None)[0]
    ordered = (pdf.y - x @ first)[pdf.sort_values(["h", "row_id"]).index].to_numpy()
    keys = np.array([int(h[:13], 16) for h in pdf.h])
    again = np.linalg.lstsq(x, (x @ first)[:, None] + ordered[B.drawn_positions(keys, 6, len(pdf), 0)], rcond=None)[0]
    want = x @ again + ordered[B.drawn_positions(keys, 6, len(pdf), 1)]
    got = boot.distribution(df, "row_id").toPandas().set_index("row_id")["predictions"]
    assert len(got) == len(pdf)
    assert np.allclose(np.stack(got.loc[pdf.row_id].to_list()), want, atol=1e-8)
    bounds = boot.bounds(df, [0.5, 0.9]).toPandas().set_index("row_id").loc[pdf.row_id]
    assert np.allclose(bounds[["lower_1", "upper_1"]].to_numpy(), np.quantile(want, [0.05, 0.95], axis=1).T, atol=1e-8)


def test_draws_are_even(spark):
    keys = np.random.default_rng(1).integers(0, 2**52, 400)
    n = 50
    drawn = B.drawn_positions(keys, 300, n, 1)
    counts = np.bincount(drawn.ravel(), minlength=n)
    assert drawn.min() >= 0 and drawn.max() < n and abs(counts / counts.mean() - 1).max() < 0.1
    assert abs(np.corrcoef(drawn[:, 0], drawn[:, 1])[0, 1]) < 0.2 and abs(np.corrcoef(drawn[0], drawn[1])[0, 1]) < 0.2


@pytest.mark.parametrize("n", [97, 2**31 - 2, 2**31 + 11, 2**32 - 1])
def test_draws_are_uniform_at_any_size(n):
    """Chi-square over even cells of the positions, over their last bits and over their quadratic characters."""
    drawn = B.drawn_positions(np.random.default_rng(4).integers(0, 2**52, 4_000), 300, n, 0).ravel()
    assert drawn.min() >= 0 and drawn.max() < n

    def chi(cells, k):
        expected = len(cells) / k
        return float(((np.bincount(cells, minlength=k) - expected) ** 2).sum() / expected)

    cells = np.minimum(97, n)
    assert chi((drawn * cells // n).astype(int), cells) < 97 + 6 * np.sqrt(2 * 97)
    if n > 2**20:
        assert chi((drawn & 63).astype(int), 64) < 63 + 6 * np.sqrt(2 * 63)
        some = drawn[:4_000].tolist()
        squares = sum(pow(x, (B.PRIME - 1) // 2, B.PRIME) == 1 for x in some)
        assert abs(squares / len(some) - 0.5) < 0.05
        assert len(set(drawn.tolist())) > 0.999 * len(drawn) - len(drawn) ** 2 / n


def test_bootstrap_refuses_a_perfect_fit(spark):
    df = spark.createDataFrame([(f"r{i}", float(i), 2.0 * i) for i in range(8)], "row_id string, a double, y double").withColumn("y", F.lit(3.0))
    with pytest.raises(ValueError):
        B.ResidualBootstrap(df, row_id="row_id", features=["a"], target="y", kind="ols", repetitions=3)


def test_bootstrap_spread_covers(spark):
    df = bootstrap_frame(spark)
    boot = B.ResidualBootstrap(df, row_id="row_id", features=["a", "b"], target="y", kind="ols", repetitions=200, seed=1)
    assert abs(boot.coef.mean(axis=0)[0] / boot.sd[0] - 3) < 0.2
    out = B.bootstrap_bounds(boot.distribution(df, "row_id"), "row_id", 0.9).join(df, "row_id")
    share = out.agg(F.avg(F.col("y").between(F.col("Lower"), F.col("Upper")).cast("double"))).first()[0]
    assert 0.84 < share < 0.96


def test_conformal_coverage_on_exchangeable_data(spark):
    rng = np.random.default_rng(5)
    cal = spark.createDataFrame([(float(v),) for v in np.abs(rng.normal(size=999))], "s double")
    q = K.conformal_quantiles(cal, [], "s", [0.1]).first().q_hat
    assert abs((np.abs(rng.normal(size=20000)) <= q).mean() - 0.9) < 0.03


def test_bootstrap_shuffles_no_draws(spark):
    """What tasks exchange holds rows and residuals, never one entry per (row, repetition) on the way to the refit."""
    n = 3_000
    df = bootstrap_frame(spark, n)
    boot = B.ResidualBootstrap(df, row_id="row_id", features=["a", "b"], target="y", repetitions=50, seed=7, kind="ols")
    assert boot.blocks == 1 and boot.residuals.agg(F.sum(F.size("e"))).first()[0] == n
    given, groups = boot._grouped(df, boot.group_rows)
    seen = boot._met(given, groups, lambda a, b: pd.DataFrame({"rows": [len(a)], "pieces": [len(b)]}), "rows long, pieces long").toPandas()
    assert seen.rows.sum() == n and seen.pieces.sum() <= groups * boot.residuals.count()
    plan = boot.bounds(df, [0.9])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapCoGroupsInPandas") == 1 and "array<int>" not in plan


def test_draws_equal_plain_remainders():
    """The folded arithmetic gives what remainders modulo the prime give, at the largest keys too."""
    p = B.PRIME
    fifth = lambda x: pow(x, 5, p)
    keys = [0, 1, p - 1, p, p + 1, 2**52 - 1, *np.random.default_rng(2).integers(0, 2**52, 200).tolist()]
    for n in (1, 97, 2**31 + 11, 2**32 - 1):
        for stream in (0, 1):
            got = B.drawn_positions(np.array(keys), 40, n, stream)
            for i, k in enumerate(keys):
                for r in range(40):
                    x = fifth((k % p + r * 40503 + stream * 7919) % p)
                    high = fifth((x * 48271 + k // p * 16807 + r * 69621 + stream) % p)
                    low = fifth((high * 69621 + x) % p)
                    assert got[i, r] == (high * n + low * n // p) // p


def test_fold_quantiles_equal_sorted_errors(spark, monkeypatch):
    """Brackets of chunks and counts give each fold's order statistic exactly, with repeated errors, and rows without target or feature left out."""
    from tabcal.plans import calibration as CP

    monkeypatch.setattr(CP, "CHUNK_ROWS", 90)
    monkeypatch.setattr(CP, "FOLD_BATCH", 4)
    rng = np.random.default_rng(12)
    x, y = rng.integers(0, 6, 700).astype(float), rng.integers(0, 9, 700).astype(float)
    x[:20], y[20:50] = np.nan, np.nan
    cal = spark.createDataFrame(pd.DataFrame({"x": x, "y": y})).replace(float("nan"), None)
    models = rng.integers(-2, 3, (11, 2)).astype(float)
    models[7:] += rng.normal(size=(4, 2))
    folds = spark.createDataFrame([(i, m.tolist()) for i, m in enumerate(models)], "_f long, _numbers array<double>")
    for coverage in (0.5, 0.9, 0.999):
        got = {r._f: r.q_hat for r in CP._fold_quantiles(folds, cal, [F.col("x")], "y", True, coverage).collect()}
        for i, (a, b) in enumerate(models):
            e = np.sort(np.abs(y - (a + b * x))[~np.isnan(x + y)])
            assert got[i] == e[min(len(e), int(np.ceil((len(e) + 1) * (1 - (1 - coverage))))) - 1]


def test_rank_correlation_of_small_and_large_groups(spark, monkeypatch):
    """Small groups are ranked in their task, large ones across tasks; both equal pandas, ties, NULL keys and unknown values included."""
    from tabcal.operators import calibrate

    rng = np.random.default_rng(8)
    frame = pd.DataFrame({"k": np.where(np.arange(400) < 250, "big", rng.choice(["a", "b", "c"], 400)), "u": rng.integers(0, 9, 400) * 1.0, "v": rng.normal(size=400).round(1)})
    frame.loc[300:330, "k"] = None
    frame.loc[5:9, "u"] = np.nan
    spread = []
    monkeypatch.setattr(calibrate, "LARGE_GROUP_ROWS", 100)
    monkeypatch.setattr(calibrate, "_spread_spearman", lambda rows, *a, run=calibrate._spread_spearman: spread.append(rows) or run(rows, *a))
    got = {r.k: r.rho for r in calibrate.spearman(spark.createDataFrame(frame), ["k"], "u", "v", "rho").collect()}
    assert {r.k for r in spread[0].select("k").distinct().collect()} == {"big"}
    known = frame.dropna(subset=["u", "v"])
    for k, part in known.groupby("k", dropna=False):
        want = part["u"].rank().corr(part["v"].rank())
        assert abs(got[None if pd.isna(k) else k] - want) < 1e-9


@pytest.mark.parametrize("linear", [True, False])
def test_few_rows_meet_folds_that_are_alike(spark, monkeypatch, linear):
    """Of models that differ little only the rows near the quantile are met, and every fold's order statistic stays exact."""
    from tabcal.plans import calibration as CP

    monkeypatch.setattr(CP, "CHUNK_ROWS", 700)
    monkeypatch.setattr(CP, "FOLD_BATCH", 9)
    rng = np.random.default_rng(14)
    n, folds = 6_000, 40
    x, y = rng.integers(0, 4, n).astype(float), rng.normal(size=n)
    models = np.array([0.3, 0.1] if linear else [0.5, -0.2, 0.1, 0.9]) + rng.normal(size=(folds, 2 if linear else 4)) * 1e-4
    models[-1] += 3.0  # one far from all others
    cal = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    frame = spark.createDataFrame([(i, m.tolist()) for i, m in enumerate(models)], "_f long, _numbers array<double>")
    seen, keep = [], CP.written
    monkeypatch.setattr(CP, "written", lambda df: seen.append(keep(df)) or seen[-1])
    got = {r._f: r.q_hat for r in CP._fold_quantiles(frame, cal, [F.col("x")], "y", linear, 0.9).collect()}
    for i, m in enumerate(models):
        e = np.sort(np.abs(y - (m[0] + m[1] * x if linear else m[x.astype(int)])))
        assert got[i] == e[int(np.ceil((n + 1) * (1 - (1 - 0.9)))) - 1]
    band = next(df for df in seen if "salt" in df.columns).where("below < 0")
    assert band.count() < n / 10


def test_residuals_beyond_a_block_are_sent_once(spark):
    """Several blocks of residuals go to executors as one file; neither draws nor copies of the residuals per group of rows are shuffled."""
    df = bootstrap_frame(spark)
    one, many = (B.ResidualBootstrap(df, row_id="row_id", features=["a", "b"], target="y", repetitions=6, seed=7, block_rows=size, kind="ols") for size in (1_000, 64))
    assert (one.blocks, many.blocks) == (1, 7) and np.allclose(one.coef, many.coef) and np.allclose(one.intercept, many.intercept)
    bounds = many.bounds(df, [0.9])
    assert "CoGroup" not in bounds._jdf.queryExecution().executedPlan().toString()
    want, got = (b.orderBy("row_id").toPandas() for b in (one.bounds(df, [0.9]), bounds))
    assert (want.row_id == got.row_id).all() and np.allclose(want.iloc[:, 1:].to_numpy(float), got.iloc[:, 1:].to_numpy(float))
