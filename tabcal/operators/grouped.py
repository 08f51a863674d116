"""Leave-one-group-out for trees, boosted stumps and neighbours: every fold from statistics per group.

* Features are binned once.  A fold's histogram is the total minus its own group's, so folds never re-read rows.
* ``leave_group_out_tree`` grows the trees of all folds level by level.  Folds that share the splits above a node share its
  histograms; the rows are read once per level, whatever the number of folds.
* ``leave_group_out_boosting`` needs one pass: residual sums of stumps follow from the counts of bin pairs, as ridge follows from
  cross products.
* ``leave_group_out_knn`` searches once; a query's own group is no neighbour.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from tabcal.operators import group_kernels as GK
from tabcal.operators.neighbors import knn_regression, nearest
from tabcal.operators.scale import attach, by_size, running_weights, unpivot_numeric, usable
from tabcal.session import written

cloudpickle.register_pickle_by_value(GK)

BINS = 32
SEARCHED_EDGES = 64  # up to so many edges a value's bin is found by nested comparisons, beyond by a list
GROUP_ROWS = 200_000  # a group of at most so many rows may be counted in one task; at most rows / this many are larger
SPLIT_ROWS = 2_000  # nodes whose splits are sought at once


def bin_edges(df: DataFrame, features: Sequence[str], bins: int = BINS) -> list[list[float]]:
    """Per feature the distinct exact quantiles at 1/bins, 2/bins, ...: at most features x bins numbers.

    Equal values of all features are counted first and ranked in one range-partitioned pass; only values at wanted ranks return.
    """
    long = unpivot_numeric(df, [], features).withColumn("_one", F.lit(1))
    ranks = written(running_weights(long, ["column"], "value", "_one"))
    sizes = {r["column"]: r["n"] for r in ranks.groupBy("column").agg(F.sum("own").alias("n")).collect()}
    position = {c: [(n - 1) * (i / bins) for i in range(1, bins)] for c, n in sizes.items()}
    wanted = {c: sorted({min(int(p) + up, sizes[c]) for p in at for up in (1, 2)}) for c, at in position.items()}
    if not any(wanted.values()):
        return [[] for _ in features]
    asked = F.coalesce(*[F.when(F.col("column") == c, F.array(*[F.lit(k).cast("long") for k in at])) for c, at in wanted.items()])
    held = ranks.withColumn("_k", F.explode(F.filter(asked, lambda k: (k > F.col("before")) & (k <= F.col("before") + F.col("own")))))
    found = {(r["column"], r["_k"]): r["value"] for r in held.select("column", "_k", "value").collect()}
    out = []
    for c in features:
        edges = set()
        for p in position.get(c, ()):
            low, high = (found[c, min(int(p) + up, sizes[c])] for up in (1, 2))
            edges.add(low + (high - low) * (p - int(p)) if p > int(p) else low)
        out.append(sorted(edges))
    return out


def bin_number(feature: Column, edges: Sequence[float]) -> Column:
    """How many edges lie below the value; a missing value goes with the smallest ones."""
    value = feature.cast("double")
    if not edges:
        return F.lit(0)

    def below(low: int, high: int) -> Column:  # between low and high edges lie below the value
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value > F.lit(float(edges[middle])), below(middle + 1, high)).otherwise(below(low, middle))

    if len(edges) <= SEARCHED_EDGES:
        number = below(0, len(edges))
    else:
        number = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e < value))
    return F.when(value.isNull() | F.isnan(value), F.lit(0)).otherwise(number)


def _binned(df: DataFrame, group: str, features: Sequence[str], target: str, edges) -> DataFrame:
    """(group, y, cells): one cell number per feature, feature i's bins after those of the features before it."""
    width = _width(edges)
    cells = F.array(*[bin_number(F.col(c), edges[i]) + i * width for i, c in enumerate(features)])
    return df.where(usable(target)).select(F.col(group).alias("_g"), F.col(target).cast("double").alias("_y"), cells.alias("_cells"))


def _width(edges) -> int:
    return max((len(e) for e in edges), default=0) + 1


def _folds(rows: DataFrame, minimum_rows: int) -> DataFrame:
    return rows.groupBy("_g").agg(F.count(F.lit(1)).alias("_own")).where(F.col("_own") >= minimum_rows).select("_g")


def _group_type(df: DataFrame, group: str) -> str:
    return dict(df.dtypes)[group]


# ---- trees -----------------------------------------------------------------------------------
def leave_group_out_tree(
    df: DataFrame, group: str, features: Sequence[str], target: str, *, depth: int = 1, minimum_rows: int = 1, minimum_leaf: int = 1,
    bins: int = BINS, out: str = "prediction",
) -> DataFrame:
    """Rows of every eligible group (NULL is one) with the prediction of the regression tree grown on all other groups' rows.

    A split sends values up to a bin edge to the left; it is the one of least squared error, of equal ones (to nine decimals of the total)
    the first feature's, then the smallest edge.  Nodes without a split that gains are leaves.  Edges are quantiles of all rows.  Rows
    without target are not learned from, but scored.
    """
    edges = bin_edges(df, features, bins)
    width = _width(edges)
    # Rows of a group lie together, a large group in several partitions, so each level adds most of a group's rows up before its shuffle.
    rows = written(_binned(df, group, features, target, edges).repartitionByRange("_g", "_y")).withColumn("_path", F.lit(""))
    folds = written(_folds(rows, minimum_rows).withColumns({"_path": F.lit(""), "_node": F.lit("")}))
    kind = _group_type(df, group)
    centre = rows.agg(F.avg("_y").alias("m")).first()["m"] or 0.0
    trees = None
    for level in range(depth + 1):
        cells = rows.select("_path", "_g", (F.col("_y") - F.lit(centre)).alias("_y"), F.explode("_cells").alias("cell"))
        own = written(cells.groupBy("_path", "_g", "cell").agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("s")))
        packed = F.collect_list(F.struct("cell", "n", "s"))
        total = own.groupBy("_path", "cell").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).groupBy("_path").agg(packed.alias("_all"))
        mine = own.groupBy("_path", "_g").agg(packed.alias("_mine"))
        asked = attach(attach(folds, total, ["_path"], count_rows=True), mine, ["_path", "_g"])
        lists = [F.col(f"_{w}.{c}").alias(f"{w}_{c}") for w in ("all", "mine") for c in ("cell", "n", "s")]
        last = level == depth

        def split(batches, last=last):
            size = len(features) * width
            for whole in batches:
                for at in range(0, len(whole), SPLIT_ROWS):
                    pdf = whole.iloc[at : at + SPLIT_ROWS]
                    every, own = (GK.cell_sums(pdf[f"{w}_cell"], pdf[f"{w}_n"], pdf[f"{w}_s"], size) for w in ("all", "mine"))
                    n, s = ((a - b).reshape(len(pdf), len(features), width) for a, b in zip(every, own))
                    value, feature, place, gains = GK.best_splits(n, s, width, minimum_leaf, last)
                    yield pdf[["_g", "_path", "_node"]].assign(value=value + centre, feature=feature, bin=place, gains=gains)

        nodes = written(asked.select("_g", "_path", "_node", *lists).mapInPandas(
            split, f"_g {kind}, _path string, _node string, value double, feature int, bin int, gains boolean"))
        kept = nodes.select("_g", "_node", "value", "feature", "bin", "gains")
        trees = kept if trees is None else trees.unionByName(kept)
        if last or nodes.where("gains").isEmpty():
            break
        side = lambda s: F.concat("_path", F.format_string(f"%d{s}%d;", "feature", "bin"))
        grown = nodes.where("gains").select("_g", "_path", "_node", "feature", "bin", F.explode(F.array(F.lit("l"), F.lit("r"))).alias("_s"))
        folds = written(grown.select(
            "_g", F.when(F.col("_s") == "l", side("l")).otherwise(side("r")).alias("_path"), F.concat("_node", "_s").alias("_node")))
        # The distinct splits of a path: its rows go on once for each, to one side.
        splits = nodes.where("gains").groupBy("_path").agg(F.collect_set(F.struct("feature", "bin")).alias("_splits"))
        rows = attach(rows, splits, ["_path"], count_rows=True).select("_g", "_y", "_cells", "_path", F.explode("_splits").alias("_t")).select(
            "_g", "_y", "_cells", F.concat("_path", F.format_string("%d%s%d;", "_t.feature", F.when(
                F.get("_cells", F.col("_t.feature")) - F.col("_t.feature") * width <= F.col("_t.bin"), "l").otherwise("r"), "_t.bin")).alias("_path"))
    whole = trees.groupBy("_g").agg(F.map_from_entries(F.collect_list(F.struct("_node", F.struct("value", "feature", "bin", "gains")))).alias("_tree"))
    scored = attach(df, whole.withColumnRenamed("_g", group), [group], count_rows=True).where("_tree IS NOT NULL")
    numbers = F.array(*[bin_number(F.col(c), edges[i]) for i, c in enumerate(features)])
    scored = scored.withColumn("_numbers", numbers).withColumn("_at", F.lit(""))
    for _ in range(depth):
        node = F.element_at("_tree", F.col("_at"))
        scored = scored.withColumn("_at", F.when(node.gains, F.concat("_at", F.when(
            F.get("_numbers", node.feature) <= node.bin, "l").otherwise("r"))).otherwise(F.col("_at")))
    return scored.select(*df.columns, F.element_at("_tree", F.col("_at")).value.alias(out))


# ---- boosted stumps -----------------------------------------------------------------------------
def fold_tables(
    df: DataFrame, group: str, features: Sequence[str], target: str, *, rounds: int, rate: float, minimum_rows: int, bins: int, edges,
) -> DataFrame:
    """(group, _table): per eligible group the boosted model of all other groups, as one number per feature and bin; the mean of the
    target is spread over the features."""
    width, d = _width(edges), len(features)
    kind, size = _group_type(df, group), d * width
    rows = written(_binned(df, group, features, target, edges).select("_g", "_y", *[F.get("_cells", i).alias(f"_c{i}") for i in range(d)]))
    numbers = lambda pdf: pdf[[f"_c{i}" for i in range(d)]].to_numpy(np.int64)

    def count(batches):  # rows per pair of cells in a task, at most cells squared numbers; the pair of a cell with itself carries the target's sum
        counts, sums = np.zeros((size, size)), np.zeros(size)
        for pdf in batches:
            a, b, n, s = GK.pair_counts(numbers(pdf), pdf["_y"].to_numpy(), size)
            counts[a, b] += n
            sums[a[a == b]] += s[a == b]
        a, b = np.nonzero(counts)
        yield pd.DataFrame({"a": a, "b": b, "n": counts[a, b], "s": np.where(a == b, sums[a], 0.0)})

    # Features x bins squared numbers at most: fixed by the parameters.
    total = rows.mapInPandas(count, "a int, b int, n double, s double").groupBy("a", "b").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).toPandas()
    shared = df.sparkSession.sparkContext.broadcast(GK.matrices(total, size))

    def solve(g, n, s):
        table = GK.boost_stumps(shared.value[0] - n, shared.value[1] - s, d, width, rounds, rate)
        return pd.DataFrame({"_g": [g], "_table": [table]})

    def from_rows(key, pdf):
        if len(pdf) < minimum_rows:
            return pd.DataFrame({"_g": [], "_table": []}, dtype=object)
        a, b, n, s = GK.pair_counts(numbers(pdf), pdf["_y"].to_numpy(), size)
        return solve(key[0], *GK.matrices({"a": a, "b": b, "n": n, "s": s}, size))

    # A group's rows are shuffled once and counted in its task; of a large group only the counts of its pairs are.
    small, large = by_size(rows, ["_g"], GROUP_ROWS)
    out = f"_g {kind}, _table array<double>"
    direct = small.groupBy("_g").applyInPandas(from_rows, out)
    cells = F.array(*[f"_c{i}" for i in range(d)])
    pairs = large.withColumn("_cells", cells).select("_g", "_y", F.explode(F.transform("_cells", lambda a: F.struct(
        a.alias("a"), F.filter("_cells", lambda b: b >= a).alias("others")))).alias("p")).select("_g", "_y", "p.a", F.explode("p.others").alias("b"))
    own = pairs.groupBy("_g", "a", "b").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("_y"))).alias("s"))
    eligible = _folds(large, minimum_rows).select(F.col("_g").alias("_e"))
    mine = own.join(eligible, own["_g"].eqNullSafe(F.col("_e")), "left_semi")
    summed = mine.groupBy("_g").applyInPandas(lambda key, pdf: solve(key[0], *GK.matrices(pdf, size)), out)
    return direct.unionByName(summed).withColumnRenamed("_g", group)


def table_cells(features: Sequence[str], edges) -> list[Column]:
    """The entries of a fold's table that a row's prediction adds up."""
    width = _width(edges)
    return [bin_number(F.col(c), edges[i]) + i * width for i, c in enumerate(features)]


def table_prediction(features: Sequence[str], edges, table: Column) -> Column:
    return sum((F.get(table, cell) for cell in table_cells(features, edges)), F.lit(0.0))


def leave_group_out_boosting(
    df: DataFrame, group: str, features: Sequence[str], target: str, *, rounds: int = 100, rate: float = 0.1, minimum_rows: int = 1,
    bins: int = BINS, out: str = "prediction",
) -> DataFrame:
    """Rows of every eligible group with the prediction of boosted stumps (squared error) fitted on all other groups' rows.

    Counts of bin pairs are gathered in one pass and per group in its task; each fold subtracts its own and boosts on the matrix alone, so
    the number of rounds and of folds costs no pass over rows.  Splits and ties as in ``leave_group_out_tree``.
    """
    edges = bin_edges(df, features, bins)
    tables = fold_tables(df, group, features, target, rounds=rounds, rate=rate, minimum_rows=minimum_rows, bins=bins, edges=edges)
    scored = attach(df, tables, [group], count_rows=True).where("_table IS NOT NULL")
    return scored.select(*df.columns, table_prediction(features, edges, F.col("_table")).alias(out))


# ---- neighbours ----------------------------------------------------------------------------------
def leave_group_out_knn(
    df: DataFrame, group: str, row_id: str, vector: str, target: str, *, k: int = 5, weights: str = "uniform", metric: str = "euclidean",
    minimum_rows: int = 1, out: str = "prediction",
) -> DataFrame:
    """Rows of every eligible group with the mean target of their k nearest rows in other groups, from one search."""
    sizes = df.where(usable(target)).groupBy(group).agg(F.count(F.lit(1)).alias("_n_rows"))
    eligible = attach(df, sizes.where(F.col("_n_rows") >= minimum_rows), [group], count_rows=True).where("_n_rows IS NOT NULL").drop("_n_rows")
    found = nearest(
        eligible, df.where(usable(target)), query_id=row_id, train_id=row_id, vector=vector, value=target, k=k, metric=metric, group=group)
    predictions = knn_regression(found, row_id, weights).select(F.col(row_id).alias("_q"), F.col("prediction").alias(out))
    return eligible.join(predictions, F.col(row_id) == F.col("_q"), "left").drop("_q")
