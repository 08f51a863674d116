"""Imputers, scalers and encoders: statistics from training rows, applied anywhere."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import OneHotEncoder, PolynomialExpansion, VectorAssembler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tabcal.functions.rules import MISSING_GAP
from tabcal.operators.columns import null_shares
from tabcal.operators.evaluate import medians
from tabcal.operators.scale import attach, condition, exact_quantiles, pin, unpivot_numeric, unpivot_text, with_scalars
from tabcal.session import durable, written

INFREQUENT = "__infrequent__"
MIN_FREQUENCY = 10  # fixed value: rarer train categories are grouped
MAX_CATEGORIES = 20  # fixed value: output categories per column, the grouped one included


def _replace(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    return df.select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns])


def fill_statistics(train: DataFrame, columns: Sequence[str], how: str) -> DataFrame:
    """One row with one fill value per column (exact median or mean of the train rows)."""
    if how == "mean":
        return train.agg(*[F.avg(c).alias(f"_f_{c}") for c in columns])
    if how == "median":
        return medians(train, [], {c: f"_f_{c}" for c in columns}, bounded=True)
    raise ValueError(f"unknown imputation: {how}")


def apply_fill(df: DataFrame, fills: DataFrame, columns: Sequence[str]) -> DataFrame:
    rows = with_scalars(df, fills)
    return _replace(rows, {c: F.coalesce(F.col(c).cast("double"), F.col(f"_f_{c}")) for c in columns}).select(*df.columns)


def impute(df: DataFrame, train: DataFrame, columns: Sequence[str], how: str = "median") -> DataFrame:
    return apply_fill(df, fill_statistics(train, columns, how), columns)


def missing_indicators(df: DataFrame, train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """0/1 columns, only for columns with NULLs in training (one small aggregate decides the schema)."""
    flagged = [r["column"] for r in null_shares(train, columns).where("missing > 0").collect()]
    return df.select("*", *[F.col(c).isNull().cast("double").alias(f"{c}_missing") for c in columns if c in flagged])


def scale_statistics(train: DataFrame, columns: Sequence[str], how: str) -> DataFrame:
    """One row: centre ``_c_x`` and unit ``_u_x`` per column (zero spread gives unit 1).

    standard: mean and population sd; robust: exact median and interquartile range;
    minmax: minimum and range.
    """
    if how == "standard":
        raw = train.agg(*[f for c in columns for f in (F.avg(c).alias(f"_c_{c}"), F.stddev_pop(c).alias(f"_u_{c}"))])
    elif how == "minmax":
        raw = train.agg(*[f for c in columns for f in (F.min(c).alias(f"_c_{c}"), (F.max(c) - F.min(c)).alias(f"_u_{c}"))])
    elif how == "robust":
        long = unpivot_numeric(train, [], columns)
        q = exact_quantiles(long, ["column"], "value", {"q1": 0.25, "q2": 0.5, "q3": 0.75}, bounded=True)
        pick = lambda c, v: F.max(F.when(F.col("column") == c, v))
        raw = q.agg(*[
            f for c in columns
            for f in (pick(c, F.col("q2")).alias(f"_c_{c}"), pick(c, F.col("q3") - F.col("q1")).alias(f"_u_{c}"))
        ])
    else:
        raise ValueError(f"unknown scaling: {how}")
    unit = lambda c: F.when(F.col(f"_u_{c}") == 0, F.lit(1.0)).otherwise(F.col(f"_u_{c}"))
    return raw.select(*[f for c in columns for f in (F.col(f"_c_{c}"), unit(c).alias(f"_u_{c}"))])


def apply_scale(df: DataFrame, stats: DataFrame, columns: Sequence[str]) -> DataFrame:
    rows = with_scalars(df, stats)
    return _replace(rows, {c: (F.col(c) - F.col(f"_c_{c}")) / F.col(f"_u_{c}") for c in columns}).select(*df.columns)


def standardize(df: DataFrame, train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Population sd; a constant column is only centred."""
    return apply_scale(df, scale_statistics(train, columns, "standard"), columns)


def robust_scale(df: DataFrame, train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Centre on the exact median, divide by the interquartile range."""
    return apply_scale(df, scale_statistics(train, columns, "robust"), columns)


def min_max_scale(df: DataFrame, train: DataFrame, columns: Sequence[str]) -> DataFrame:
    return apply_scale(df, scale_statistics(train, columns, "minmax"), columns)


def train_categories(train: DataFrame, columns: Sequence[str], *, drop_first: bool = False) -> dict[str, list[str]]:
    """Sorted train categories per column, NULL as its own category.  Each becomes an output column, so they reach the driver;
    ``one_hot_vector`` is for columns of very many."""
    values = unpivot_text(train, [], columns).select("column", F.coalesce("value", F.lit(MISSING_GAP)).alias("value")).distinct()
    found = values.collect() if columns else []
    out = {c: sorted(r["value"] for r in found if r["column"] == c) for c in columns}
    return {c: v[1:] if drop_first else v for c, v in out.items()}


def one_hot_vector(df: DataFrame, train: DataFrame, column: str, out: str) -> DataFrame:
    """One sparse 0/1 vector over all train categories, however many; unseen values give the zero vector.

    A category's place follows its hash, found in counted hash buckets; categories stay a table that is joined.
    """
    label = F.coalesce(F.col(column).cast("string"), F.lit(MISSING_GAP))
    found = train.select(label.alias("_cat")).distinct().withColumn("_h", F.md5("_cat")).withColumn("_b", F.substring("_h", 1, 3))
    counts = found.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))  # at most 4,096 rows
    starts = counts.select("_b", F.coalesce(F.sum("_c").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_s"))
    place = F.col("_s") + F.row_number().over(W.partitionBy("_b").orderBy("_h", "_cat")) - 1
    places = durable(attach(found, starts, ["_b"], bounded=True).select("_cat", place.cast("double").alias("_at")))
    model = OneHotEncoder(inputCols=["_at"], outputCols=[out], handleInvalid="keep", dropLast=True).fit(places)
    rows = attach(df.withColumn("_cat", label), places, ["_cat"], count_rows=True)
    return model.transform(rows.withColumn("_at", F.coalesce("_at", F.lit(float(places.count()))))).drop("_cat", "_at")


def one_hot(df: DataFrame, categories: dict[str, list[str]]) -> DataFrame:
    """One 0/1 column per train category; unseen values give all zeros."""
    hot = [
        (F.coalesce(F.col(c).cast("string"), F.lit(MISSING_GAP)) == v).cast("double").alias(f"{c}={v}")
        for c, values in categories.items() for v in values
    ]
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in categories], *hot)


def rare_category_map(
    train: DataFrame, columns: Sequence[str], min_frequency: int = MIN_FREQUENCY, max_categories: int = MAX_CATEGORIES
) -> DataFrame:
    """Kept categories (column, value) plus one row per column telling whether a rare class exists.

    At most ``max_categories`` rows per column leave the executors; the rank limit also applies
    before the shuffle, so a column with millions of labels never sits in one task.
    """
    counts = unpivot_text(train, [], columns).select(
        "column", F.coalesce("value", F.lit(MISSING_GAP)).alias("value")
    ).groupBy("column", "value").agg(F.count(F.lit(1)).alias("_c"))
    sizes = counts.groupBy("column").agg(
        F.count(F.lit(1)).alias("_all"), F.count_if(F.col("_c") >= min_frequency).alias("_frequent")
    )
    current = F.col("_frequent") + (F.col("_all") > F.col("_frequent")).cast("long")
    keep = F.when(current > max_categories, F.lit(max_categories - 1)).otherwise(F.col("_frequent"))
    sizes = sizes.select("column", "_all", keep.alias("_keep"))
    ranked = counts.where(F.col("_c") >= min_frequency).withColumn(
        "_r", F.row_number().over(W.partitionBy("column").orderBy(F.desc("_c"), F.desc("value")))
    ).where(F.col("_r") <= max_categories)
    kept = attach(ranked, sizes, ["column"], bounded=True).where("_r <= _keep")
    return kept.select("column", "value", (F.col("_all") > F.col("_keep")).alias("has_rare"))


def group_rare(df: DataFrame, rare_map: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rare and unseen labels become ``__infrequent__`` where training had a rare class, else NULL."""
    arrays = rare_map.agg(*[
        F.collect_set(F.when(F.col("column") == c, F.col("value"))).alias(f"_k_{c}") for c in columns
    ], *[F.max(F.when(F.col("column") == c, F.col("has_rare"))).alias(f"_h_{c}") for c in columns])
    rows = with_scalars(df, arrays)
    label = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(MISSING_GAP))
    return _replace(rows, {
        c: F.when(F.array_contains(F.col(f"_k_{c}"), label(c)), label(c)).when(
            F.coalesce(F.col(f"_h_{c}"), F.lit(True)), F.lit(INFREQUENT)
        ) for c in columns
    }).select(*df.columns)


def encoding_table(df: DataFrame, *, column: str, target: str, train: Column | str, fold: str, folds: int) -> tuple[DataFrame, DataFrame]:
    """((_cat, _size, _values), one row of _default): the empirical-Bayes encoding of each training category without fold 0, 1, ..., then of
    all training rows, and what a category without rows there gets.

    The category mean is shrunk to the overall mean by n / (n + within variance / overall variance).  Only (category, fold) sums are
    shuffled; leaving a fold out is a subtraction.
    """
    label = F.coalesce(F.col(column).cast("string"), F.lit(MISSING_GAP))
    rows = df.where(train)
    centre = pin(rows.agg(F.avg(target).alias("_mu")))
    fitted = with_scalars(rows, centre).select(label.alias("_cat"), fold, (F.col(target) - F.col("_mu")).alias("_y"))
    sums = fitted.groupBy("_cat", fold).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum("_y").alias("s"), F.sum(F.col("_y") * F.col("_y")).alias("q")
    )
    minus = lambda field_name, f: F.sum(F.when(F.col(fold) != f, F.col(field_name)).otherwise(0.0))
    triple = lambda f: F.struct(*[minus(c, f).alias(c) for c in ("n", "s", "q")])
    slots = F.array(*[triple(f) for f in range(folds)], F.struct(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")))
    per_category = written(sums.groupBy("_cat").agg(F.sum("n").alias("_size"), slots.alias("_per")))
    add = lambda i, c: F.coalesce(F.sum(F.col("_per")[i][c]), F.lit(0.0)).alias(c)
    overall = pin(with_scalars(per_category.agg(F.array(*[F.struct(*[add(i, c) for c in ("n", "s", "q")]) for i in range(folds + 1)]).alias("_tot")), centre))

    def value(c, t):
        mean_all = F.try_divide(t["s"], t["n"])
        var_all = F.try_divide(t["q"], t["n"]) - mean_all * mean_all
        mean_cat = F.try_divide(c["s"], c["n"])
        within = F.greatest(F.try_divide(c["q"], c["n"]) - mean_cat * mean_cat, F.lit(0.0))
        weight = F.try_divide(c["n"], c["n"] + F.try_divide(within, var_all))
        shrunk = weight * mean_cat + (1 - weight) * mean_all
        return F.when((c["n"] > 0) & (var_all > 0), shrunk).otherwise(mean_all) + F.col("_mu")

    table = with_scalars(per_category, overall).select("_cat", "_size", F.zip_with("_per", "_tot", value).alias("_values"))
    default = overall.select(F.transform("_tot", lambda t: F.try_divide(t["s"], t["n"]) + F.col("_mu")).alias("_default"))
    return table, default


def target_encode(
    df: DataFrame, *, column: str, target: str, train: Column | str, fold: str, out: str, folds: int, cross_fit: bool = True,
) -> DataFrame:
    """Empirical-Bayes target encoding (``encoding_table``), out of fold for training rows.

    ``cross_fit=False`` scores training rows with the all-train value as well.
    """
    label = F.coalesce(F.col(column).cast("string"), F.lit(MISSING_GAP))
    table, default = encoding_table(df, column=column, target=target, train=train, fold=fold, folds=folds)
    rows = df.withColumn("_cat", label).withColumn("_train", condition(train))
    joined = with_scalars(attach(rows, table, ["_cat"], size_col="_size"), default)
    slot = F.when(F.col("_train"), F.col(fold)).otherwise(F.lit(folds)) if cross_fit else F.lit(folds)
    return joined.select(*df.columns, F.element_at(F.coalesce("_values", "_default"), (slot + 1).cast("int")).alias(out))


def expand_polynomial(df: DataFrame, columns: Sequence[str], degree: int, *, interaction_only: bool = False, out: str = "poly") -> DataFrame:
    """Polynomial terms without a constant; ``interaction_only`` keeps products of distinct columns."""
    assembled = VectorAssembler(inputCols=list(columns), outputCol="_v").transform(df)
    full = PolynomialExpansion(degree=degree, inputCol="_v", outputCol=out).transform(assembled).drop("_v")
    if not interaction_only:
        return full
    keep = [i for i, powers in enumerate(polynomial_powers(len(columns), degree)) if max(powers) <= 1]
    return VectorSlicer(inputCol=out, outputCol="_s", indices=keep).transform(full).drop(out).withColumnRenamed("_s", out)


def polynomial_powers(width: int, degree: int) -> list[tuple[int, ...]]:
    """Exponents of every term in the order PolynomialExpansion emits them (x, x2, y, xy, y2, ...)."""
    def expand(last: int, left: int):
        if left == 0 or last < 0:
            return [()] if last < 0 else [tuple([0] * (last + 1))]
        return [head + (power,) for power in range(left + 1) for head in expand(last - 1, left - power)]

    return expand(width - 1, degree)[1:]


def scale_vector(df: DataFrame, train: Column | str, vector: str, out: str) -> DataFrame:
    """Standardise a vector column with population sd of the training rows."""
    width = F.size(vector_to_array(vector))
    cells = df.where(train).select(F.posexplode(vector_to_array(vector)).alias("i", "x"))
    stats = cells.groupBy("i").agg(F.avg("x").alias("a"), F.stddev_pop("x").alias("s"))
    ordered = stats.agg(F.array_sort(F.collect_list(F.struct("i", "a", "s"))).alias("_st"))  # one entry per dimension
    rows = with_scalars(df, ordered)
    scaled = F.transform(F.arrays_zip(vector_to_array(vector).alias("x"), F.col("_st")), lambda z: (
        (z["x"] - z["_st"]["a"]) / F.when(z["_st"]["s"] == 0, F.lit(1.0)).otherwise(z["_st"]["s"])
    ))
    return rows.withColumn("_x", F.when(width >= 0, scaled)).select(*df.columns, array_to_vector("_x").alias(out))


@dataclass
class TablePreprocessor:
    """Median fill and scaling for numbers, one-hot and target encoding for labels, fitted on train rows.

    ``scaling`` is standard, robust, minmax or none; rare labels of ``grouped`` columns are
    merged before one-hot encoding; ``vectors`` are encoded as one sparse vector column each.
    ``fit_transform`` adds the output columns and a ``features`` vector.
    """

    numeric: Sequence[str]
    one_hot_columns: Sequence[str] = ()
    encoded: Sequence[str] = ()
    grouped: Sequence[str] = ()
    vectors: Sequence[str] = ()
    scaling: str = "standard"
    indicators: bool = False
    target: str = "target"
    fold: str = "fold"
    folds: int = 5
    train: Column | str = "split = 'train'"
    categories: dict[str, list[str]] = field(default_factory=dict)
    wide: dict[str, int] = field(default_factory=dict)  # one-hot vector columns with their number of categories
    output_columns: list[str] = field(default_factory=list)

    def fit_transform(self, df: DataFrame, *, cross_fit: bool = True) -> DataFrame:
        # statistics come from the input rows, and are pinned, so steps do not recompute each other
        source, out, numeric = df.where(self.train), df, list(self.numeric)
        flags, hot = [], []
        if self.indicators:
            flagged = [r["column"] for r in null_shares(source, numeric).where("missing > 0").collect()]
            flags = [f"{c}_missing" for c in numeric if c in flagged]
            out = out.select("*", *[F.col(c).isNull().cast("double").alias(f"{c}_missing") for c in numeric if c in flagged])
        if numeric:
            fills = pin(fill_statistics(source, numeric, "median"))
            out = apply_fill(out, fills, numeric)
            if self.scaling != "none":
                out = apply_scale(out, pin(scale_statistics(apply_fill(source, fills, numeric), numeric, self.scaling)), numeric)
        if self.grouped:
            rare = pin(rare_category_map(source, self.grouped))
            out, source = group_rare(out, rare, self.grouped), group_rare(source, rare, self.grouped)
        labels = [*self.one_hot_columns, *self.grouped]
        if labels:
            self.categories = train_categories(source, labels)
            hot = [f"{c}={v}" for c, values in self.categories.items() for v in values]
            kept = [F.col(c).alias(f"_keep_{c}") for c in labels]
            out = one_hot(out.select("*", *kept), self.categories).withColumnsRenamed({f"_keep_{c}": c for c in labels})
        for c in self.vectors:
            out = one_hot_vector(out, source, c, f"{c}_onehot")
            self.wide[c] = source.select(F.coalesce(F.col(c).cast("string"), F.lit(MISSING_GAP))).distinct().count()
        for c in self.encoded:
            out = target_encode(
                out, column=c, target=self.target, train=self.train, fold=self.fold, out=f"{c}_encoded",
                folds=self.folds, cross_fit=cross_fit,
            )
        encoded = [f"{c}_encoded" for c in self.encoded]
        if encoded:
            out = apply_scale(out, pin(scale_statistics(out.where(self.train), encoded, "standard")), encoded)
        self.output_columns = [*encoded, *numeric, *flags, *hot]
        vector = array_to_vector(F.array(*[F.col(f"`{c}`").cast("double") for c in self.output_columns]))
        if not self.wide:
            return out.withColumn("features", vector)
        blocks = [f"{c}_onehot" for c in self.wide]
        self.output_columns += blocks
        return VectorAssembler(inputCols=["_dense", *blocks], outputCol="features").transform(out.withColumn("_dense", vector)).drop("_dense")

    def expansion_audit(self, df: DataFrame) -> DataFrame:
        """Columns in and out per block."""
        hot = sum(len(v) for v in self.categories.values()) + sum(self.wide.values())
        row = (
            len(self.numeric) + len(self.one_hot_columns) + len(self.grouped) + len(self.vectors) + len(self.encoded), len(self.numeric),
            len(self.one_hot_columns) + len(self.grouped) + len(self.vectors), len(self.encoded), hot, len(self.output_columns) - len(self.wide) + sum(self.wide.values()),
        )
        schema = "input_columns long, numeric_columns long, one_hot_inputs long, encoded_columns long, one_hot_outputs long, output_columns long"
        return df.sparkSession.createDataFrame([row], schema)
