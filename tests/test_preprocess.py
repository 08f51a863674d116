"""The fitted preprocessor: unseen rows, saved models, label buckets, KNN fill."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabcal.operators import encode as E, preprocess as PP


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    n = 400
    pdf = pd.DataFrame({
        "id": [f"r{i}" for i in range(n)], "split": np.where(rng.random(n) < 0.7, "train", "test"), "fold": rng.integers(0, 3, n),
        "a": rng.normal(size=n), "b": rng.normal(5, 3, n), "few": rng.choice(["x", "y"], n), "some": rng.choice([f"s{i}" for i in range(14)], n),
        "many": rng.choice([f"m{i}" for i in range(60)], n)})
    pdf["target"] = pdf.a * 2 + pdf.few.eq("x") * 3 + rng.normal(size=n)
    df = spark.createDataFrame(pdf).withColumn("a", F.when(F.crc32("id") % 5 > 0, F.col("a"))).withColumn("few", F.when(F.crc32("id") % 11 > 0, F.col("few")))
    unseen = spark.createDataFrame([("new", "test", 0, None, 2.0, "never", "never", None, 1.0)], df.schema)
    return df.unionByName(unseen)


RECIPE = PP.Recipe(numeric=("a", "b"), one_hot=("few",), grouped=("some",), encoded=("many",), indicators=True, folds=3)


def test_training_rows_equal_the_one_step_preprocessor(rows):
    old = E.TablePreprocessor(numeric=["a", "b"], one_hot_columns=["few"], grouped=["some"], encoded=["many"], indicators=True, folds=3)
    want = {r["id"]: r["features"].toArray() for r in old.fit_transform(rows).collect()}
    model = PP.Preprocessor(RECIPE).fit(rows)
    assert model.output_columns == old.output_columns
    got = {r["id"]: r["features"].toArray() for r in model.transform_training(rows).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[i], want[i]) for i in want)


def test_saved_model_gives_the_same_rows_and_unseen_rows_change_nothing(spark, rows, tmp_path):
    model = PP.Preprocessor(RECIPE).fit(rows)
    model.save(f"{tmp_path}/model")
    again = PP.PreprocessorModel.load(spark, f"{tmp_path}/model")
    assert again.recipe == model.recipe
    first = {r["id"]: r["features"].toArray() for r in model.transform(rows).collect()}
    alone = again.transform(rows.where("id = 'new'")).collect()
    assert len(alone) == 1 and np.allclose(alone[0]["features"].toArray(), first["new"])
    second = {r["id"]: r["features"].toArray() for r in again.transform(rows).collect()}
    assert all(np.allclose(first[i], second[i]) for i in first)
    kinds = [i for i, c in enumerate(again.output_columns) if c.startswith("few=")]
    assert first["new"][kinds].sum() == 0 and again.transform(rows.limit(0)).count() == 0


def test_labels_are_dealt_by_their_categories(rows):
    model = PP.Preprocessor(PP.bucketed_recipe(["a"], ["few", "some", "many"], high="encoded", folds=3)).fit(rows)
    assert (model.recipe.one_hot, model.recipe.grouped, model.recipe.encoded) == (("few",), ("some",), ("many",))
    assert "many_encoded" in model.output_columns and "a_missing" in model.output_columns
    grouped = PP.Preprocessor(PP.bucketed_recipe([], ["many"], by_domain=True, folds=3)).fit(rows)
    assert grouped.recipe.grouped == ("many",) and grouped.recipe.domain_columns == ("many",)
    assert 1 <= len(grouped.output_columns) <= 20 and grouped.transform(rows).count() == 401


def test_boosting_recipe_and_knn_fill(rows):
    model = PP.Preprocessor(PP.boosting_recipe(["a", "b"], ["few"], ["many"], folds=3)).fit(rows)
    train = rows.where("split = 'train'").toPandas()
    a = train.a.fillna(train.a.median())
    got = model.transform(rows).toPandas().set_index("id")
    whole = rows.toPandas().set_index("id")
    want = (whole.a.fillna(train.a.median()) - a.median()) / (a.quantile(0.75) - a.quantile(0.25))
    assert np.allclose(got.a, want.loc[got.index])
    filled = PP.Preprocessor(PP.Recipe(numeric=("a", "b"), fill="knn", neighbors=3, row_id="id", scaling="none")).fit(rows).transform(rows).toPandas().set_index("id")
    donors = train.dropna(subset=["a"])
    for i in whole.index[whole.a.isna() & whole.b.notna()][:10]:
        order = donors.assign(d=(donors.b - whole.b[i]).abs()).sort_values(["d", "id"])
        assert abs(filled.a[i] - order.a.head(3).mean()) < 1e-9
