"""Prediction intervals of every method at every coverage level, on one role split or per held-out group."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window as W, functions as F

from tabcal.operators import bootstrap as B, calibrate as K, grouped as G, kernels, linear as L
from tabcal.operators.scale import attach, pin, with_scalars
from tabcal.session import written

cloudpickle.register_pickle_by_value(kernels)

SD_FLOOR = 1e-8
FOLD_BATCH = 1000  # models that meet a chunk of calibration rows in one task
CHUNK_ROWS = 50_000  # calibration rows in a chunk
ERRORS = 1 << 20  # errors worked out at once
DRAWN_FOLDS = 20_000  # folds among which centres are sought; they decide which rows are met, never a result
CENTRES = 16  # folds at most that others are compared with
CLOSE = 1e-3  # gap between a fold and its centre, in standard deviations of the target, below which no more centres are sought


def _frame(df, method, model, scheme, coverage, carry, uncertainty=None):
    return K.interval_table(
        df, carry=carry, uncertainty=uncertainty,
        labels={"method": F.lit(method), "model": F.lit(model), "evaluation_scheme": F.lit(scheme), "split": F.col("role"),
                "nominal_coverage": F.lit(float(coverage))},
    )


def _around(df, width, centre="Predicted"):
    lower, upper = K.symmetric_bounds(F.col(centre), width)
    return df.withColumn("Lower", lower).withColumn("Upper", upper)


def interval_methods(
    df: DataFrame, *, row_id: str, features: Sequence[str], target: str, elastic_net: dict, coverages: Sequence[float] = (0.8, 0.9, 0.95),
    repetitions: int = 300, seed: int = 42, scheme: str = "shared", carry: Sequence[str] = (),
) -> DataFrame:
    """Interval tables of five methods from one table with a ``role`` column (train, calibration, heldout).

    Methods: split conformal around the elastic net; Bayesian ridge with its own sd; the same
    sd conformalised; residual-bootstrap percentiles; those percentiles conformalised.
    """
    # read about eight times below, so the needed columns are stored once
    df = written(df.select(row_id, "role", target, *[c for c in features if c != target], *[c for c in carry if c not in features]))
    train, others = df.where("role = 'train'"), df.where("role <> 'train'")
    sums = pin(L.cross_products(train, [], [*features, target]))
    net = L.fit_all(sums, "elastic_net", **elastic_net)
    bayes = L.fit_all(sums, "bayesian_ridge")
    boot = B.ResidualBootstrap(train, row_id=row_id, features=features, target=target, repetitions=repetitions, seed=seed, sums=sums, **elastic_net)
    spread = boot.bounds(others, coverages, "row_id").drop("mean")
    first = L.score(others, net, [], features).drop("prediction_sd").withColumnRenamed("prediction", "net")
    both = L.score(first, bayes, [], features)
    scored = written(both.select(
        F.col(row_id).cast("string").alias("row_id"), "role", F.col(target).alias("Actual"), "net", F.col("prediction").alias("bayes"),
        F.greatest("prediction_sd", F.lit(SD_FLOOR)).alias("sd"), *carry,
    ).join(spread, "row_id"))  # used for the quantiles and for the tables

    actual = F.col("Actual")
    score = lambda method, level, value: F.struct(F.lit(method).alias("method"), F.lit(level).cast("int").alias("level"), value.alias("score"))
    scores = scored.where("role = 'calibration'").select(F.inline(F.array(
        score("split_conformal", -1, F.abs(actual - F.col("net"))),
        score("bayesian_conformalized", -1, F.abs(actual - F.col("bayes")) / F.col("sd")),
        *[score("bootstrap_conformalized", i, K.nonconformity(actual, F.col(f"lower_{i}"), F.col(f"upper_{i}"))) for i in range(len(coverages))],
    )))
    alphas = [1 - c for c in coverages]
    found = K.conformal_quantiles(scores, ["method", "level"], "score", alphas, bounded=True).collect()  # methods x levels
    q = {(row.method, row.level, round(row.alpha, 12)): row.q_hat for row in found}

    tables = []
    for i, coverage in enumerate(coverages):
        key = round(1 - coverage, 12)
        around = lambda centre, width: K.symmetric_bounds(F.col(centre), width)
        half = lambda bounds: (bounds[1] - bounds[0]) / 2
        split_q = F.lit(q["split_conformal", -1, key])
        bayes_q = F.lit(q["bayesian_conformalized", -1, key])
        boot_q = F.lit(q["bootstrap_conformalized", i, key])
        raw = (F.col(f"lower_{i}"), F.col(f"upper_{i}"))
        for method, model, centre, bounds, uncertain in (
            ("split_conformal", "elastic_net", "net", around("net", split_q), None),
            ("bayesian_native", "bayesian_ridge", "bayes", around("bayes", K.normal_half_width(F.col("sd"), coverage)), F.col("sd")),
            ("bayesian_conformalized", "bayesian_ridge", "bayes", around("bayes", bayes_q * F.col("sd")), F.col("sd")),
            ("bootstrap_percentile", "elastic_net", "net", raw, None),
            ("bootstrap_conformalized", "elastic_net", "net", (raw[0] - boot_q, raw[1] + boot_q), None),
        ):
            tables.append(F.struct(
                F.lit(method).alias("method"), F.lit(model).alias("model"), F.lit(float(coverage)).alias("nominal_coverage"),
                F.col(centre).alias("Predicted"), bounds[0].alias("Lower"), bounds[1].alias("Upper"),
                (half(bounds) if uncertain is None else uncertain).alias("uncertainty"),
            ))
    rows = scored.where("role = 'heldout'").select("row_id", "role", "Actual", *carry, F.explode(F.array(*tables)).alias("_t"))
    flat = rows.select("row_id", "role", "Actual", *carry, "_t.*")
    return K.interval_table(flat, carry=carry, uncertainty="uncertainty", labels={
        "method": F.col("method"), "model": F.col("model"), "evaluation_scheme": F.lit(scheme), "split": F.col("role"),
        "nominal_coverage": F.col("nominal_coverage"),
    })


def coverage_curve(intervals: DataFrame) -> DataFrame:
    """Nominal against empirical coverage and mean width per method."""
    return intervals.groupBy("method", "nominal_coverage").agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg(F.col("Covered").cast("double")).alias("EmpiricalCoverage"),
        F.avg("IntervalWidth").alias("MeanIntervalWidth"),
    )


def _linear_folds(pool, group, features, target, kind, minimum_rows, params):
    """(group, _model, _numbers) of the models without each eligible group, how a model predicts, and what it reads of a row."""
    sums = L.cross_products(pool, [group], [*features, target])
    folds = L.without_each(sums, [group], len(features) + 1)
    eligible = sums.where(F.col("n") >= minimum_rows).select(group, F.lit(1).alias("_ok"))
    models = attach(L.fit(folds, [group], features, kind, **params), eligible, [group]).where("_ok = 1")
    predict = lambda m: sum((F.col(c).cast("double") * m.coef[i] for i, c in enumerate(features)), m.intercept)
    numbers = F.concat(F.array(F.col("intercept").cast("double")), "coef")
    return models.select(group, F.struct("coef", "intercept").alias("_model"), numbers.alias("_numbers")), predict, [F.col(c).cast("double") for c in features]


def _stump_folds(pool, group, features, target, kind, minimum_rows, params):
    """The same for boosted stumps (``rounds``, ``rate``, ``bins``)."""
    bins = params.get("bins", G.BINS)
    edges = G.bin_edges(pool, features, bins)
    tables = G.fold_tables(
        pool, group, features, target, rounds=params.get("rounds", 100), rate=params.get("rate", 0.1), minimum_rows=minimum_rows, bins=bins, edges=edges)
    models = tables.withColumnRenamed("_table", "_model").withColumn("_numbers", F.col("_model"))
    return models, lambda m: G.table_prediction(features, edges, m), G.table_cells(features, edges)


def _fold_quantiles(folds, cal, inputs, target, linear, coverage):
    """(_f, q_hat): per fold (_f, _numbers) the finite-sample conformal quantile of its absolute errors on all calibration rows.

    Folds are alike, so few rows can decide a fold's quantile: where the predictions of fold and centre (one of a few folds) differ by at most
    ``gap`` on every row, both quantiles do too, and a row whose error around the centre is further than two gaps from the centre's
    quantile lies on the same side of the fold's.  Folds of one centre and about one gap are a class; only the rows in the class's band meet its
    folds, those below it are counted.  A wide gap makes a wide band, up to all rows.

    Batches of folds meet chunks of the band twice: the first time each chunk brackets its own quantile, and the fold's quantile lies between
    the smallest and the largest of these; the second time errors below are counted and only those inside are returned.  So the errors
    themselves are never shuffled.
    """
    spark = folds.sparkSession
    names = [f"x{i}" for i in range(len(inputs))]
    rows = cal.select(F.col(target).cast("double").alias("y"), *[c.cast("double").alias(name) for c, name in zip(inputs, names)])
    for c in ["y", *names]:  # a row without a finite error for any model
        rows = rows.where(F.abs(c) < float("inf"))
    rows = written(rows)
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.abs("y")).alias("y"), F.array(*[F.min(c) for c in names]).alias("low"), F.array(*[F.max(c) for c in names]).alias("high"),
                     F.stddev_pop("y").alias("sd")).first()
    sound = folds.where(F.forall("_numbers", lambda v: F.abs(v) < float("inf")))
    some = sound.orderBy(F.xxhash64("_f")).limit(DRAWN_FOLDS).select("_numbers").toPandas()
    if not facts.n or not len(some):
        return spark.createDataFrame([], "_f long, q_hat double")
    low, high, largest = np.array(facts.low), np.array(facts.high), facts.y
    centres = kernels.centres(kernels.stack(some["_numbers"]), low, high, linear, CENTRES, CLOSE * facts.sd)

    def around(batches):
        for pdf in batches:
            errors = kernels.fold_errors(centres, pdf[names].to_numpy(float), pdf["y"].to_numpy(float), linear)
            yield pd.DataFrame({"centre": np.repeat(np.arange(len(centres)), len(pdf)), "e": errors.ravel()})

    # one row per centre
    middle = {r.centre: r.q_hat for r in K.conformal_quantiles(rows.mapInPandas(around, "centre int, e double"), ["centre"], "e", [1 - coverage], bounded=True).collect()}

    def assign(batches):
        for pdf in batches:
            centre, gap = kernels.nearest_centre(kernels.stack(pdf["_numbers"]), centres, low, high, largest, linear)
            with np.errstate(divide="ignore"):
                level = np.clip(np.log2(gap), -2_000, 2_000).astype(int)
            yield pdf.assign(centre=centre, gap=gap, level=level)

    assigned = written(sound.select("_f", "_numbers").mapInPandas(assign, "_f long, _numbers array<double>, centre int, gap double, level int"))
    classes = [(i, r.centre, r.level, r.gap, max(1, -(-r.n // FOLD_BATCH))) for i, r in enumerate(  # at most centres x powers of two
        assigned.groupBy("centre", "level").agg(F.max("gap").alias("gap"), F.count(F.lit(1)).alias("n")).collect())]

    def band(batches):
        below, at = np.zeros(len(classes), dtype=np.int64), 0
        for pdf in batches:
            errors = kernels.fold_errors(centres, pdf[names].to_numpy(float), pdf["y"].to_numpy(float), linear)
            for i, centre, _, gap, _ in classes:
                e, q = errors[centre], middle[centre]
                below[i] += (e < q - 2 * gap).sum()
                held = pdf[~(e < q - 2 * gap) & ~(e > q + 2 * gap)]
                yield held.assign(cls=i, below=-1, salt=np.arange(at, at + len(held)))
            at += len(pdf)
        yield pd.DataFrame({"y": 0.0, **{c: 0.0 for c in names}, "cls": np.arange(len(classes)), "below": below, "salt": 0})

    found = written(rows.mapInPandas(band, ", ".join(f"{c} double" for c in ["y", *names]) + ", cls int, below long, salt long"))
    sizes = {r.cls: r for r in found.groupBy("cls").agg(F.sum(F.greatest("below", F.lit(0))).alias("below"), F.count_if(F.col("below") < 0).alias("n")).collect()}
    rank = min(facts.n, math.ceil((facts.n + 1) * (1 - (1 - coverage))))  # as K.conformal_rank
    plan = spark.createDataFrame(
        [(i, centre, level, batches, -(-sizes[i].n // CHUNK_ROWS), sizes[i].below, (rank - sizes[i].below) / sizes[i].n) for i, centre, level, _, batches in classes],
        "cls int, centre int, level int, batches int, chunks int, base long, share double")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    models = assigned.join(F.broadcast(plan), ["centre", "level"]).withColumn("batch", F.pmod(F.xxhash64("_f"), F.col("batches")).cast("int"))
    models = models.select("_f", "_numbers", "cls", "batch", "chunks", "base", "share")
    right = found.where("below < 0").drop("below").join(F.broadcast(plan.select("cls", "batches", "chunks")), "cls").withColumn(
        "chunk", F.pmod("salt", F.col("chunks")).cast("int")).withColumn("batch", spread("batches"))
    keys = ["cls", "batch", "chunk"]

    def met(models, run, schema):
        def cell(some, chunk):
            parts = []
            if len(some) and len(chunk):
                y, x, step = chunk["y"].to_numpy(float), chunk[names].to_numpy(float), max(1, ERRORS // len(chunk))
                for at in range(0, len(some), step):
                    part = some.iloc[at : at + step]
                    parts.append(run(part, kernels.fold_errors(kernels.stack(part["_numbers"]), x, y, linear)))
            return pd.concat(parts) if parts else pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")}, dtype=object)

        left = models.withColumn("chunk", spread("chunks"))
        return left.groupBy(*keys).cogroup(right.select(*keys, "y", *names).groupBy(*keys)).applyInPandas(cell, schema)

    def bracket(part, errors):
        ends = kernels.error_bracket(errors, part["share"].iloc[0])
        return pd.DataFrame({"_f": part["_f"].to_numpy(), "low": ends[:, 0], "high": ends[:, 1]})

    def inside(part, errors):
        found = list(kernels.errors_inside(errors, part["low"], part["high"]))
        return pd.DataFrame(list(zip(part["_f"], *zip(*found))), columns=["_f", "n", "below", "value", "count"])

    known = met(models, bracket, "_f long, low double, high double").where(~F.isnan("low"))
    ends = known.groupBy("_f").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    parts = written(met(models.join(ends, "_f"), inside, "_f long, n long, below long, value array<double>, count array<long>"))
    totals = parts.groupBy("_f").agg(F.sum("below").alias("below"))
    values = parts.select("_f", F.explode(F.arrays_zip("value", "count")).alias("z")).groupBy("_f", F.col("z.value").alias("value")).agg(F.sum("z.count").alias("c"))
    running = F.sum("c").over(W.partitionBy("_f").orderBy("value").rowsBetween(W.unboundedPreceding, W.currentRow))
    upto = values.withColumn("upto", running).join(totals, "_f").join(models.select("_f", "base"), "_f")
    return upto.where(F.col("base") + F.col("below") + F.col("upto") >= F.lit(rank)).groupBy("_f").agg(F.min("value").alias("q_hat"))


def held_out_conformal(
    df: DataFrame, *, row_id: str, group: str, features: Sequence[str], target: str, kind: str, coverage: float, minimum_rows: int,
    calibration: str, carry: Sequence[str] = (), **params,
) -> DataFrame:
    """Leave-one-group-out split conformal for every eligible group, in one plan.

    ``calibration`` is a condition marking the fixed calibration groups.  Fold g trains on all
    groups but g and the calibration groups, so its statistics are the training total minus g's own:
    cross products of a linear model, counts of bin pairs of boosted ``stumps``.  Calibration scores are
    needed per fold, so the folds' models (one row each) meet the calibration rows in blocks.
    """
    marked = df.withColumn("_cal", F.expr(calibration))
    pool = marked.where(~F.col("_cal"))
    models, predict, inputs = (_stump_folds if kind == "stumps" else _linear_folds)(pool, group, features, target, kind, minimum_rows, params)
    fitted = written(models.withColumn("_f", F.monotonically_increasing_id()))
    q = _fold_quantiles(fitted.select("_f", "_numbers"), marked.where("_cal"), inputs, target, kind != "stumps", coverage)
    q = fitted.select(group, "_f").join(q, "_f", "left").drop("_f")
    fitted = fitted.select(group, "_model")
    scored = attach(pool, fitted, [group], count_rows=True).where(F.col("_model").isNotNull()).withColumn("prediction", predict(F.col("_model"))).drop("_model")
    scored = scored.where("prediction IS NOT NULL")
    rows = attach(scored, q, [group], count_rows=True).select(
        F.col(row_id).cast("string").alias("row_id"), F.lit("heldout").alias("role"), F.col(target).alias("Actual"),
        F.col("prediction").alias("Predicted"), "q_hat", group, *[c for c in carry if c != group],
    )
    return _frame(_around(rows, F.col("q_hat")), "split_conformal", kind, "leave_one_group_out", coverage, [group, *[c for c in carry if c != group]])
