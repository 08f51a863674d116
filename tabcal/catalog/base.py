"""Query registry, and the derived input views in Spark and SQL form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = (fn, sql)
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r(c: Column | str, digits: int = 6) -> Column:
    """Round for comparison across engines (adding 0.0 turns -0.0 into 0.0)."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*[
        r(f"`{c}`", special.get(c, digits)).alias(c) if kinds[c] == "double" else F.col(f"`{c}`") for c in df.columns
    ])


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem with a row id and deterministic blanks."""
    d = table(spark, sf, "lineitem")
    return d.select(
        F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")]).alias("row_id"),
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag", "l_linestatus",
        F.expr("CASE WHEN l_orderkey % 7 = 0 THEN NULL WHEN l_orderkey % 5 = 0 THEN 0D ELSE l_quantity END").alias("amount"),
        F.expr("CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE l_returnflag END").alias("kind"),
        F.expr("CASE WHEN l_linenumber = 7 THEN NULL ELSE l_discount END").alias("discount"),
        F.expr("CASE WHEN l_orderkey % 3 = 0 THEN NULL WHEN l_partkey % 6 = 0 THEN 'N/A' ELSE l_linestatus END").alias("status"),
        F.expr("CASE WHEN l_orderkey % 11 < 7 THEN NULL ELSE l_tax END").alias("sparse"),
        F.expr("CAST(NULL AS DOUBLE)").alias("empty"),
    )


LINES = """WITH lines AS (SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS row_id,
 l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus,
 CASE WHEN l_orderkey % 7 = 0 THEN NULL WHEN l_orderkey % 5 = 0 THEN 0::DOUBLE ELSE l_quantity END AS amount,
 CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE l_returnflag END AS kind,
 CASE WHEN l_linenumber = 7 THEN NULL ELSE l_discount END AS discount,
 CASE WHEN l_orderkey % 3 = 0 THEN NULL WHEN l_partkey % 6 = 0 THEN 'N/A' ELSE l_linestatus END AS status,
 CASE WHEN l_orderkey % 11 < 7 THEN NULL ELSE l_tax END AS sparse,
 CAST(NULL AS DOUBLE) AS empty FROM lineitem)
"""

SEED = 42
FRACTIONS = {"train": 0.7, "validation": 0.15, "test": 0.15}


def md5_unit_sql(key: str, seed: int = SEED) -> str:
    return f"(('0x' || substr(md5(({key})::VARCHAR || '|{seed}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


SPLIT_SQL = (
    f"CASE WHEN {md5_unit_sql('row_id')} < 0.7::DOUBLE THEN 'train' "
    f"WHEN {md5_unit_sql('row_id')} < 0.85::DOUBLE THEN 'validation' ELSE 'test' END"
)
SPLIT_LINES = LINES + f", sl AS (SELECT *, {SPLIT_SQL} AS split FROM lines)\n"

# Closed-form predictions: two fixed rules, so metrics can be checked exactly without training.
# The target is a seventh of the price, so no average of it is a short decimal (rounding ties).
RULES = {"flat": "290 * l_quantity + 35", "taxed": "270 * l_quantity * (1 + l_tax)"}


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    from tabcal.operators.evaluate import prediction_table
    from tabcal.operators.splits import random_split

    d = random_split(lines(spark, sf), "row_id", FRACTIONS, SEED)
    both = d.select("*", (F.col("l_extendedprice") / 7).alias("target"), F.explode(F.array(*[
        F.struct(F.lit(m).alias("model"), F.expr(e).cast("double").alias("predicted")) for m, e in RULES.items()
    ])).alias("_m")).select("*", "_m.model", "_m.predicted")
    return prediction_table(
        both, row_id="row_id", actual="target", predicted="predicted",
        labels={"policy": F.lit("all"), "experiment": F.lit("closed_form"), "exploratory": F.lit(False), "model": F.col("model"), "split": F.col("split")},
        carry=["l_suppkey", "l_quantity", "l_returnflag", "amount", "discount", "l_tax"],
    )


PRED = SPLIT_LINES + """, pr AS (SELECT 'all' AS policy, 'closed_form' AS experiment, false AS exploratory, m.model, split, row_id,
 y AS Actual, p AS Predicted, y - p AS Residual, abs(y - p) AS AbsoluteError, (y - p) * (y - p) AS SquaredError, l_suppkey, l_quantity, l_returnflag, amount, discount, l_tax
 FROM (SELECT *, l_extendedprice / 7 AS y, 'flat' AS model, (290 * l_quantity + 35)::DOUBLE AS p FROM sl
       UNION ALL SELECT *, l_extendedprice / 7, 'taxed', (270 * l_quantity * (1 + l_tax))::DOUBLE FROM sl) m)
"""

METRIC_SQL = """count(*) AS n_rows, avg(AbsoluteError) AS MAE, sqrt(avg(SquaredError)) AS RMSE,
 CASE WHEN count(*) < 2 THEN NULL WHEN var_pop(Actual) > 0 THEN 1 - sum(SquaredError) / (var_pop(Actual) * count(*))
      WHEN sum(SquaredError) = 0 THEN 1.0 ELSE 0.0 END AS R2,
 CASE WHEN stddev_pop(Actual) > 0 AND stddev_pop(Predicted) > 0 THEN corr(Actual, Predicted) END AS R,
 avg(Residual) AS Bias, median(AbsoluteError) AS MedianAE"""


def round_sql(columns: list[str], digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in columns)


METRIC_ROUND = "n_rows, " + round_sql(["MAE", "RMSE", "R2", "R", "Bias", "MedianAE"])
