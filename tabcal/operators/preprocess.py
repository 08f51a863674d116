"""Preprocessing as an Estimator: fitted on training rows, applied to any rows, saved as Parquet tables.

``Preprocessor(...).fit(df)`` gives a ``PreprocessorModel`` whose state is a handful of tables with one row per column, per
category or per (category, fold); ``transform`` joins them, so new rows never change a statistic.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, replace

from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, functions as F

from tabcal.functions.rules import MISSING_GAP, domain_group
from tabcal.operators import encode as E
from tabcal.operators.columns import null_shares
from tabcal.operators.neighbors import knn_impute
from tabcal.operators.profile import cardinality_report
from tabcal.operators.scale import attach, unpivot_text
from tabcal.session import written

TABLES = ("numbers", "rare", "categories", "encodings", "encoded_scale")


@dataclass(frozen=True)
class Recipe:
    """What is done to which columns.

    ``numeric``: filled (median, mean or knn, the nearest training rows by ``row_id``) and scaled (standard, robust, minmax, none), with
    0/1 columns for those that are missing in training if ``indicators``.  ``one_hot``, ``grouped`` (rare categories merged first) and
    ``encoded`` (target encoding, out of fold for training rows) are label columns; those in ``labels`` are dealt to the three by their
    number of training categories: up to ``low`` one-hot, up to ``medium`` grouped, above that as ``high`` says (grouped or
    encoded), after grouping by domain if ``by_domain``.  ``encoded`` columns are standardised if ``scale_encoded``.
    """

    numeric: tuple[str, ...] = ()
    one_hot: tuple[str, ...] = ()
    grouped: tuple[str, ...] = ()
    encoded: tuple[str, ...] = ()
    labels: tuple[str, ...] = ()
    fill: str = "median"
    neighbors: int = 5
    row_id: str | None = None
    scaling: str = "standard"
    indicators: bool = False
    scale_encoded: bool = True
    low: int = 10
    medium: int = 20
    high: str = "grouped"
    by_domain: bool = False
    domain_columns: tuple[str, ...] = ()
    target: str = "target"
    fold: str = "fold"
    folds: int = 5
    train: str = "split = 'train'"


#: Boosting: median, robust scale, one-hot and raw target encoding.  Linear family: indicators, standard scale, labels by cardinality.
def boosting_recipe(numeric: Sequence[str], one_hot: Sequence[str], encoded: Sequence[str], **more) -> Recipe:
    return Recipe(tuple(numeric), tuple(one_hot), (), tuple(encoded), scaling="robust", scale_encoded=False, **more)


def bucketed_recipe(numeric: Sequence[str], labels: Sequence[str], **more) -> Recipe:
    return Recipe(tuple(numeric), labels=tuple(labels), indicators=True, **more)


class Preprocessor(Estimator):
    def __init__(self, recipe: Recipe):
        super().__init__()
        self.recipe = recipe

    def _fit(self, df: DataFrame) -> PreprocessorModel:
        r, spark = self.recipe, df.sparkSession
        source = df.where(r.train)
        r = _dealt(r, source)
        state: dict[str, DataFrame] = {}
        numeric = list(r.numeric)
        if numeric:
            gaps = {x["column"] for x in null_shares(source, numeric).where("missing > 0").collect()} if r.indicators else set()
            fills = E.fill_statistics(source, numeric, "mean" if r.fill == "mean" else "median").first()
            shown = source.select(*([r.row_id] if r.row_id else []), *[F.col(c).cast("double").alias(c) for c in numeric])
            if r.fill == "knn":
                state["donors"] = shown = written(shown)
                shown = knn_impute(shown, shown, numeric, r.row_id, k=r.neighbors)
            else:
                shown = shown.select(*[F.coalesce(F.col(c), F.lit(fills[f"_f_{c}"])).alias(c) for c in numeric])
            units = E.scale_statistics(shown, numeric, r.scaling).first() if r.scaling != "none" else None
            rows = [(i, c, c in gaps, fills[f"_f_{c}"], units[f"_c_{c}"] if units else 0.0, units[f"_u_{c}"] if units else 1.0) for i, c in enumerate(numeric)]
            state["numbers"] = spark.createDataFrame(rows, "place int, column string, flagged boolean, fill double, centre double, unit double")
        labelled = _labelled(source, r)
        if r.grouped:
            state["rare"] = written(E.rare_category_map(labelled, r.grouped))
            labelled = E.group_rare(labelled, state["rare"], r.grouped)
        hot = [*r.one_hot, *r.grouped]
        if hot:
            state["categories"] = written(unpivot_text(labelled, [], hot).select("column", F.coalesce("value", F.lit(MISSING_GAP)).alias("value")).distinct())
        if r.encoded:
            parts, defaults = [], []
            for c in r.encoded:
                table, overall = E.encoding_table(_labelled(df, r), column=c, target=r.target, train=r.train, fold=r.fold, folds=r.folds)
                parts.append(table.select(F.lit(c).alias("column"), F.col("_cat").alias("value"), F.col("_size").alias("size"), F.col("_values").alias("per_fold")))
                defaults.append(overall.select(F.lit(c).alias("column"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("double").alias("size"), F.col("_default").alias("per_fold")))
            union = parts[0]
            for p in [*parts[1:], *defaults]:
                union = union.unionByName(p)
            state["encodings"] = written(union)
        model = PreprocessorModel(r, state)
        if r.encoded and r.scale_encoded:
            names = [f"{c}_encoded" for c in r.encoded]
            units = E.scale_statistics(model._encode(_labelled(df, r), training=True).where(r.train), names, "standard").first()
            state["encoded_scale"] = spark.createDataFrame(
                [(c, units[f"_c_{n}"], units[f"_u_{n}"]) for c, n in zip(r.encoded, names)], "column string, centre double, unit double")
        return model


def _dealt(r: Recipe, source: DataFrame) -> Recipe:
    """The recipe with ``labels`` dealt to one-hot, grouped and encoded columns by their training categories."""
    if not r.labels:
        return r
    bucket = {x["column"]: x["cardinality_bucket"] for x in cardinality_report(source, r.labels, r.low, r.medium).collect()}
    of = lambda name: tuple(c for c in r.labels if bucket.get(c, "low") == name)
    high = of("high")
    return replace(
        r, labels=(), one_hot=(*r.one_hot, *of("low")), grouped=(*r.grouped, *of("medium"), *(high if r.high == "grouped" else ())),
        encoded=(*r.encoded, *(high if r.high == "encoded" else ())), domain_columns=high if r.by_domain else ())


def _labelled(df: DataFrame, r: Recipe) -> DataFrame:
    """Label columns as they are encoded: those of many categories grouped by domain."""
    return df.withColumns({c: domain_group(F.col(c)) for c in r.domain_columns}) if r.domain_columns else df


class PreprocessorModel(Model):
    def __init__(self, recipe: Recipe, state: dict[str, DataFrame]):
        super().__init__()
        self.recipe, self.state = recipe, state

    def _rows(self, name: str) -> list:
        """A state table with one row per column or per one-hot category (columns of the output, so bounded by its width)."""
        return self.state[name].collect() if name in self.state else []

    def _encode(self, df: DataFrame, training: bool) -> DataFrame:
        r = self.recipe
        slot = F.when(F.expr(r.train), F.col(r.fold)).otherwise(F.lit(r.folds)) if training else F.lit(r.folds)
        known = self.state["encodings"]
        default = {x["column"]: x["per_fold"] for x in known.where("value IS NULL").collect()}
        for c in r.encoded:
            table = known.where((F.col("column") == c) & F.col("value").isNotNull()).select(F.col("value").alias("_cat"), F.col("size").alias("_size"), F.col("per_fold").alias("_values"))
            rows = attach(df.withColumn("_cat", F.coalesce(F.col(c).cast("string"), F.lit(MISSING_GAP))), table, ["_cat"], size_col="_size")
            values = F.coalesce("_values", F.array(*[F.lit(x) for x in default[c]]))
            df = rows.withColumn(f"{c}_encoded", F.element_at(values, (slot + 1).cast("int"))).drop("_cat", "_size", "_values")
        return df

    def _transform(self, df: DataFrame) -> DataFrame:
        """Rows beside their output columns and a ``features`` vector; every row is treated as unseen."""
        return self._apply(df, training=False)

    def transform_training(self, df: DataFrame) -> DataFrame:
        """The same, but training rows get the target encoding of the other folds."""
        return self._apply(df, training=True)

    @property
    def output_columns(self) -> list[str]:
        r = self.recipe
        numbers = sorted(self._rows("numbers"), key=lambda x: x["place"])
        return [*[f"{c}_encoded" for c in r.encoded], *[x["column"] for x in numbers], *[f"{x['column']}_missing" for x in numbers if x["flagged"]],
                *[f"{c}={v}" for c, values in self._categories().items() for v in values]]

    def _categories(self) -> dict[str, list[str]]:
        found = self._rows("categories")
        return {c: sorted(x["value"] for x in found if x["column"] == c) for c in (*self.recipe.one_hot, *self.recipe.grouped)}

    def _apply(self, df: DataFrame, training: bool) -> DataFrame:
        r, out = self.recipe, df
        numbers = sorted(self._rows("numbers"), key=lambda x: x["place"])
        out = out.withColumns({f"{x['column']}_missing": F.col(x["column"]).isNull().cast("double") for x in numbers if x["flagged"]})
        if numbers and r.fill == "knn":
            out = knn_impute(out, self.state["donors"], [x["column"] for x in numbers], r.row_id, k=r.neighbors)
        if numbers:
            out = out.withColumns({
                x["column"]: (F.coalesce(F.col(x["column"]).cast("double"), F.lit(x["fill"])) - F.lit(x["centre"])) / F.lit(x["unit"]) for x in numbers})
        shown = _labelled(out, r)
        if r.grouped:
            shown = E.group_rare(shown, self.state["rare"], r.grouped)
        categories = self._categories()
        if categories:
            kept = {f"_keep_{c}": F.col(c) for c in categories}
            shown = E.one_hot(shown.withColumns(kept), categories).withColumnsRenamed({k: k.removeprefix("_keep_") for k in kept})
        if r.encoded:
            shown = self._encode(shown, training)
            shown = shown.withColumns({
                f"{x['column']}_encoded": (F.col(f"{x['column']}_encoded") - F.lit(x["centre"])) / F.lit(x["unit"]) for x in self._rows("encoded_scale")})
        return shown.withColumn("features", array_to_vector(F.array(*[F.col(f"`{c}`").cast("double") for c in self.output_columns])))

    def save(self, path: str) -> None:
        """Every state table and the recipe (one row of JSON) as Parquet below ``path``."""
        spark = next(iter(self.state.values())).sparkSession
        for name, table in self.state.items():
            table.write.mode("overwrite").parquet(f"{path}/{name}")
        spark.createDataFrame([(json.dumps(asdict(self.recipe), sort_keys=True), sorted(self.state))], "recipe string, tables array<string>").write.mode("overwrite").parquet(f"{path}/recipe")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> PreprocessorModel:
        row = spark.read.parquet(f"{path}/recipe").first()
        fields = {k: tuple(v) if isinstance(v, list) else v for k, v in json.loads(row["recipe"]).items()}
        return cls(Recipe(**fields), {name: spark.read.parquet(f"{path}/{name}") for name in row["tables"]})
