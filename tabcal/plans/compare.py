"""Tune on training folds, compare on validation, run experiments on frozen parameters."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F

from tabcal.operators import columns as C, linear as L
from tabcal.operators.evaluate import best_row, experiment_delta, prediction_table, regression_metrics
from tabcal.operators.ordering import union_ragged
from tabcal.operators.scale import pin

METRIC_KEYS = ("policy", "experiment", "exploratory", "model", "split")


def linear_predictions(
    df: DataFrame, *, row_id: str, features: Sequence[str], target: str, models: dict[str, tuple[str, dict]],
    train: str = "split = 'train'", policy: str = "all", experiment: str = "baseline", carry: Sequence[str] = (),
) -> DataFrame:
    """One long prediction table of several linear models fitted on the training rows.

    All models share one pass of cross products over the training rows.
    """
    sums = pin(L.cross_products(df.where(train), [], [*features, target]))
    options = []
    for name, (kind, params) in models.items():
        one = L.fit_all(sums, kind, **params).first()
        guess = sum((F.col(c).cast("double") * float(w) for c, w in zip(features, one.coef)), F.lit(float(one.intercept)))
        options.append(F.struct(F.lit(name).alias("model"), guess.alias("prediction")))
    both = df.select("*", F.explode(F.array(*options)).alias("_m"))
    return prediction_table(
        both.select(*df.columns, "_m.model", "_m.prediction"), row_id=row_id, actual=target, predicted="prediction", carry=carry,
        labels={"policy": F.lit(policy), "experiment": F.lit(experiment), "exploratory": F.lit(False),
                "model": F.col("model"), "split": F.col("split")},
    )


def tune_linear(train: DataFrame, *, fold: str, features: Sequence[str], target: str, grids: dict[str, list[dict]]) -> DataFrame:
    """(model, candidate_count, best_cv_RMSE, best_parameters) after one pass over the training rows."""
    candidates = [(kind, params) for kind, options in grids.items() for params in options]
    return L.best_candidates(L.cv_table(L.grid_search(train, fold, features, target, candidates)))


def frozen_models(tuned: DataFrame) -> dict[str, tuple[str, dict]]:
    """Chosen parameters per model (one row each)."""
    return {r.model: (r.model, json.loads(r.best_parameters)) for r in tuned.collect()}


def select_and_test(
    df: DataFrame, *, row_id: str, features: Sequence[str], target: str, fold: str, grids: dict[str, list[dict]], carry: Sequence[str] = ()
) -> tuple[str, DataFrame]:
    """Tune on training groups, choose on validation, refit on train+validation, score the test rows once."""
    models = frozen_models(tune_linear(df.where("split = 'train'"), fold=fold, features=features, target=target, grids=grids))
    trial = linear_predictions(df, row_id=row_id, features=features, target=target, models=models)
    on_validation = regression_metrics(trial.where("split = 'validation'"), METRIC_KEYS, bounded=True)
    chosen = best_row(on_validation, "RMSE", "model").first().model
    final = linear_predictions(
        df, row_id=row_id, features=features, target=target, models={chosen: models[chosen]},
        train="split IN ('train', 'validation')", experiment="refit_train_validation", carry=carry,
    )
    return chosen, final


def run_variants(
    df: DataFrame, variants: dict[str, tuple[Callable[[DataFrame], DataFrame], Sequence[str]]], *, row_id: str, target: str,
    models: dict[str, tuple[str, dict]], policy: str = "all",
) -> DataFrame:
    """Metrics of frozen models over table variants (ablation, trimming, engineered features, scalings).

    A variant is (transform, features); the prediction tables are summarised in one job.
    """
    parts = [
        linear_predictions(change(df), row_id=row_id, features=features, target=target, models=models, policy=policy, experiment=name)
        for name, (change, features) in variants.items()
    ]
    return regression_metrics(union_ragged(parts), METRIC_KEYS, bounded=True)


def variant_deltas(metrics: DataFrame, reference: str, challenger: str) -> DataFrame:
    return experiment_delta(metrics, reference, challenger, ["RMSE", "MAE", "R2"])


def experiment_scope(spark, experiments: dict[str, dict]) -> DataFrame:
    """One row per experiment: enabled, targeted, exploratory and why."""
    rows = [
        (name, bool(e.get("enabled", False)), bool(e.get("targeted", False)), bool(e.get("exploratory", False)), e.get("reason", ""))
        for name, e in experiments.items()
    ]
    return spark.createDataFrame(rows, "experiment string, enabled boolean, targeted boolean, exploratory boolean, reason string")


def trimmed(target: str, lower: float = 0.025, upper: float = 0.975) -> Callable[[DataFrame], DataFrame]:
    """Variant that removes training rows outside the train target quantiles."""
    return lambda df: C.trim_train_target(df, target, "split = 'train'", lower, upper)
