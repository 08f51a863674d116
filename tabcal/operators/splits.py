"""Splits, folds and role manifests, decided by salted md5 so that repartitioning changes nothing."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tabcal.operators.ordering import content_key
from tabcal.operators.scale import attach, order_statistics, with_scalars
from tabcal.session import durable

SPLITS = ("train", "validation", "test")
ROLE_OF_SPLIT = {"train": "train", "validation": "calibration", "test": "heldout"}


def salted_md5(key: Column, seed: int) -> Column:
    return F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}")))


def hash_number(key: Column, seed: int, digits: int = 8) -> Column:
    """First hex digits of the salted md5 as an integer (13 digits still fit a double exactly)."""
    return F.conv(F.substring(salted_md5(key, seed), 1, digits), 16, 10).cast("long")


def hash_unit(key: Column, seed: int) -> Column:
    return hash_number(key, seed) / F.lit(4294967296.0)


def random_split(df: DataFrame, row_id: str, fractions: dict[str, float], seed: int, out: str = "split") -> DataFrame:
    """Row split by fixed cut points on the row's hash."""
    unit, chain, upto = hash_unit(F.col(row_id), seed), F, 0.0
    names = list(fractions)
    for name in names[:-1]:
        upto += fractions[name]
        chain = chain.when(unit < F.lit(round(upto, 12)), F.lit(name))
    return df.withColumn(out, chain.otherwise(F.lit(names[-1])))


def feature_hash_group(df: DataFrame, features: Sequence[str], out: str = "feature_group") -> DataFrame:
    """Rows with identical features share a group."""
    return df.withColumn(out, content_key(features))


def largest_remainder(n: Column, fractions: dict[str, float]) -> dict[str, Column]:
    """Whole-number shares of n that sum to n; leftovers go to the largest remainders in name order."""
    names = list(fractions)
    raw = {k: n * F.lit(float(f)) for k, f in fractions.items()}
    floor = {k: F.floor(raw[k]) for k in names}
    rest = {k: raw[k] - floor[k] for k in names}
    left = n - sum((floor[k] for k in names), F.lit(0))
    out = {}
    for i, k in enumerate(names):
        ahead = sum(
            ((rest[o] > rest[k]) | ((rest[o] == rest[k]) & F.lit(j < i))).cast("long")
            for j, o in enumerate(names) if j != i
        )
        out[k] = floor[k] + F.when(ahead < left, 1).otherwise(0)
    return out


def group_sizes(df: DataFrame, group: str) -> DataFrame:
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n_rows"))


def group_split(df: DataFrame, group: str, fractions: dict[str, float], seed: int) -> DataFrame:
    """(group, n_rows, split): fractions apply to the NUMBER of groups, whole groups only.

    The cut points are two exact order statistics of the group hash, so no global sort runs.
    """
    sizes = group_sizes(df, group).withColumn("_h", hash_number(F.coalesce(F.col(group).cast("string"), F.lit("")), seed, 13))
    names = list(fractions)
    cuts, upto = {}, 0.0
    for name in names[:-1]:
        upto += fractions[name]
        cuts[f"_cut_{name}"] = (upto, F.floor(F.col("_n") * F.lit(round(upto, 12))))
    thresholds = order_statistics(sizes, [], "_h", cuts, count_as="_groups")
    chain = F
    for name in names[:-1]:
        chain = chain.when(F.col("_h") <= F.col(f"_cut_{name}"), F.lit(name))
    return with_scalars(sizes, thresholds).select(group, "n_rows", chain.otherwise(F.lit(names[-1])).alias("split"))


def apply_manifest(df: DataFrame, manifest: DataFrame, group: str, column: str = "split") -> DataFrame:
    """Put the group's split or role on its rows."""
    stats = manifest.select(group, column, F.col("n_rows").alias("_size"))
    return attach(df, stats, [group], size_col="_size").drop("_size")


def split_objective(rows: dict[str, Column], wanted: dict[str, Column]) -> Column:
    """Sum of squared relative gaps between split sizes and their targets."""
    return sum((F.pow((rows[s] - wanted[s]) / wanted[s], F.lit(2.0)) for s in rows), F.lit(0.0))


def balanced_manifest_candidates(sizes: DataFrame, group: str, fractions: dict[str, float], seed: int, restarts: int) -> DataFrame:
    """(restart, per-split rows, score) of every seeded candidate; target values are never read.

    A candidate gives the groups with the smallest salted hashes to train, the next to
    validation, the rest to test, with group counts fixed by largest remainder.  Candidates
    exist only inside partial aggregates: each pass ships counts per restart.
    """
    names = list(fractions)
    tried = _tried(sizes, group, seed, restarts)
    shares = largest_remainder(F.col("_n"), fractions)
    cuts, total, upto = {}, F.lit(0), 0.0
    for name in names[:-1]:
        total, upto = total + shares[name], upto + fractions[name]
        cuts[f"_cut_{name}"] = (upto, total)
    thresholds = order_statistics(tried, ["restart"], "_h", cuts, bounded=True, count_as="_groups")
    placed = attach(tried, thresholds, ["restart"], bounded=True)
    chain = F
    for name in names[:-1]:
        chain = chain.when(F.col("_h") <= F.col(f"_cut_{name}"), F.lit(name))
    placed = placed.withColumn("split", chain.otherwise(F.lit(names[-1])))
    per = placed.groupBy("restart").agg(
        *[F.coalesce(F.sum(F.when(F.col("split") == s, F.col("n_rows"))), F.lit(0)).alias(f"rows_{s}") for s in names],
        F.sum("n_rows").alias("_total"), *[F.max(f"_cut_{s}").alias(f"_cut_{s}") for s in names[:-1]],
    )
    wanted = {s: F.col("_total") * F.lit(fractions[s]) for s in names}
    score = split_objective({s: F.col(f"rows_{s}").cast("double") for s in names}, wanted)
    return per.withColumn("score", score).drop("_total")


def _tried(sizes, group, seed, restarts):
    each = sizes.select(group, "n_rows", F.explode(F.sequence(F.lit(0), F.lit(restarts - 1))).alias("restart"))
    key = F.concat(F.coalesce(F.col(group).cast("string"), F.lit("")), F.lit("|"), F.col("restart").cast("string"))
    return each.withColumn("_h", hash_number(key, seed, 13))


def balanced_manifest(df: DataFrame, group: str, fractions: dict[str, float], seed: int, restarts: int = 200) -> DataFrame:
    """Group manifest of the best-scoring restart, with the target row and group counts."""
    names = list(fractions)
    sizes = group_sizes(df, group)
    scored = balanced_manifest_candidates(sizes, group, fractions, seed, restarts)
    full = scored.where(" AND ".join(f"rows_{s} > 0" for s in names))
    best = full.agg(F.min_by(F.struct("restart", *[f"_cut_{s}" for s in names[:-1]]), F.struct("score", "restart")).alias("_b"))
    totals = sizes.agg(F.sum("n_rows").alias("_total"), F.count(F.lit(1)).alias("_groups"))
    rows = with_scalars(with_scalars(sizes, best), totals)
    key = F.concat(F.coalesce(F.col(group).cast("string"), F.lit("")), F.lit("|"), F.col("_b.restart").cast("string"))
    rows = rows.withColumn("_h", hash_number(key, seed, 13))
    chain = F
    for name in names[:-1]:
        chain = chain.when(F.col("_h") <= F.col(f"_b._cut_{name}"), F.lit(name))
    counts = largest_remainder(F.col("_groups"), fractions)
    per_split = lambda make: F.coalesce(*[F.when(F.col("split") == s, make(s)) for s in names])
    return rows.withColumn("split", chain.otherwise(F.lit(names[-1]))).select(
        group, "n_rows", "split",
        per_split(lambda s: F.col("_total") * F.lit(fractions[s])).alias("target_row_count"),
        per_split(lambda s: counts[s]).alias("target_group_count"),
        F.lit(False).alias("assignment_uses_target_values"),
    )


def best_swap(manifest: DataFrame, group: str, fractions: dict[str, float]) -> DataFrame:
    """The one exchange of two groups between splits that lowers the objective most.

    Exchanging sizes a and b only moves d = b - a rows, and the objective is a parabola in d,
    so for each size a only the sizes next to a + d* can win.  The search runs on distinct
    sizes per split (at most sqrt(2 rows) of them), never on pairs of groups.
    """
    names = list(fractions)
    totals = manifest.agg(*[
        F.coalesce(F.sum(F.when(F.col("split") == s, F.col("n_rows"))), F.lit(0)).cast("double").alias(f"_r_{s}") for s in names
    ])
    sizes = manifest.groupBy("split", "n_rows").agg(F.min(group).alias("_g"))
    pairs = [(s, t) for i, s in enumerate(names) for t in names[i + 1 :]]
    total = sum((F.col(f"_r_{s}") for s in names), F.lit(0.0))
    want = {s: total * F.lit(fractions[s]) for s in names}
    tagged = with_scalars(sizes, totals).select(
        "*", F.explode(F.array(*[F.struct(F.lit(s).alias("s"), F.lit(t).alias("t")) for s, t in pairs])).alias("_p")
    ).where((F.col("split") == F.col("_p.s")) | (F.col("split") == F.col("_p.t")))
    pick = lambda make, side: F.coalesce(*[F.when(F.col(f"_p.{side}") == s, make(s)) for s in names])
    rs, rt = pick(lambda s: F.col(f"_r_{s}"), "s"), pick(lambda s: F.col(f"_r_{s}"), "t")
    ws, wt = pick(lambda s: want[s], "s"), pick(lambda s: want[s], "t")
    ideal = ((ws - rs) / (ws * ws) - (wt - rt) / (wt * wt)) / (1 / (ws * ws) + 1 / (wt * wt))
    first = F.col("split") == F.col("_p.s")
    line = tagged.select(
        "_p", "_g", "n_rows", first.alias("_first"),
        F.when(first, F.col("n_rows") + ideal).otherwise(F.col("n_rows").cast("double")).alias("_x"),
        rs.alias("_rs"), rt.alias("_rt"), ws.alias("_ws"), wt.alias("_wt"), *[F.col(f"_r_{s}") for s in names],
    )
    along = W.partitionBy("_p").orderBy("_x", "_first", "_g")
    partner = F.when(~F.col("_first"), F.struct("n_rows", "_g"))
    near = line.select(
        "*", F.last(partner, ignorenulls=True).over(along.rowsBetween(W.unboundedPreceding, W.currentRow)).alias("_dn"),
        F.first(partner, ignorenulls=True).over(along.rowsBetween(W.currentRow, W.unboundedFollowing)).alias("_up"),
    ).where("_first")
    options = near.select("*", F.explode(F.array("_dn", "_up")).alias("_o")).where(F.col("_o").isNotNull())
    d = F.col("_o.n_rows") - F.col("n_rows")
    rest = sum((
        F.when((F.col("_p.s") != s) & (F.col("_p.t") != s), F.pow((F.col(f"_r_{s}") - want[s]) / want[s], F.lit(2.0))).otherwise(0.0)
        for s in names
    ), F.lit(0.0))
    score = F.pow((F.col("_rs") + d - F.col("_ws")) / F.col("_ws"), F.lit(2.0)) + F.pow(
        (F.col("_rt") - d - F.col("_wt")) / F.col("_wt"), F.lit(2.0)
    ) + rest
    current = split_objective({s: F.col(f"_r_{s}") for s in names}, want)
    scored = options.select(
        F.col("_g").alias("first_group"), F.col("_o._g").alias("second_group"),
        F.col("_p.s").alias("first_split"), F.col("_p.t").alias("second_split"),
        current.alias("score_before"), score.alias("score_after"),
    )
    return scored.orderBy("score_after", "first_group", "second_group").limit(1)


def swap_refine(manifest: DataFrame, group: str, fractions: dict[str, float]) -> DataFrame:
    """Apply the best exchange until none helps (one small job per exchange; each lowers the objective, so it ends)."""
    done = 0
    while True:
        found = best_swap(manifest, group, fractions).collect()
        if not found or not found[0].score_after < found[0].score_before - 1e-15:
            return manifest
        swap, done = found[0], done + 1
        manifest = manifest.withColumn(
            "split",
            F.when(F.col(group) == F.lit(swap.first_group), F.lit(swap.second_split))
            .when(F.col(group) == F.lit(swap.second_group), F.lit(swap.first_split))
            .otherwise(F.col("split")),
        )
        if done % 10 == 0:
            manifest = durable(manifest)


def group_folds(df: DataFrame, group: str, k: int) -> DataFrame:
    """(group, n_rows, fold): groups by size descending, dealt to folds in a snake.

    The position of a group is found in two counted levels (size, then a hash bucket of the
    group), so millions of equal-sized groups are not sorted in one task.
    """
    sizes = group_sizes(df, group).withColumn("_h", F.md5(F.coalesce(F.col(group).cast("string"), F.lit(""))))
    sizes = sizes.withColumn("_b", F.substring("_h", 1, 3))
    per_bucket = sizes.groupBy("n_rows", "_b").agg(F.count(F.lit(1)).alias("_c"))
    per_size = per_bucket.groupBy("n_rows").agg(F.sum("_c").alias("_c"))
    larger = W.orderBy(F.desc("n_rows")).rowsBetween(W.unboundedPreceding, -1)  # distinct sizes only
    size_offset = per_size.select("n_rows", F.coalesce(F.sum("_c").over(larger), F.lit(0)).alias("_so"))
    before = W.partitionBy("n_rows").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    bucket_offset = attach(
        per_bucket.select("n_rows", "_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_bo")), size_offset, ["n_rows"]
    )
    inside = F.row_number().over(W.partitionBy("n_rows", "_b").orderBy("_h", group))
    ranked = attach(sizes, bucket_offset, ["n_rows", "_b"]).select(
        group, "n_rows", (F.col("_so") + F.col("_bo") + inside - 1).alias("position")
    )
    turn = F.pmod(F.col("position"), F.lit(2 * k))
    return ranked.withColumn("fold", F.when(turn < k, turn).otherwise(2 * k - 1 - turn).cast("long"))


def _dealt(loads, size, items):
    """(fold of the first ``items`` equal groups, each given to the lightest fold, the first of equals; loads after the last).

    Fold f's keys are its load, load + size, ...; groups follow the keys in order.  Above the level q_f where a fold joins in, every
    level holds one key of each fold that has joined, so places are found without a walk over the groups.
    """
    gap = loads - loads.min()
    joins, rest = gap // size, gap % size
    levels = np.unique(joins)
    active = np.searchsorted(np.sort(joins), levels, "right")
    starts = np.concatenate([[0], np.cumsum(np.diff(levels) * active[:-1])])  # groups before each of these levels

    def place(i):
        at = np.searchsorted(starts, i, "right") - 1
        out = np.zeros(len(i), dtype=np.int64)
        for a in np.unique(at):
            order = [f for f in np.lexsort((np.arange(len(loads)), rest)) if joins[f] <= levels[a]]
            here = at == a
            out[here] = np.array(order)[(i[here] - starts[a]) % active[a]]
        return out

    at = int(np.searchsorted(starts, items, "right") - 1)
    whole, part = divmod(items - int(starts[at]), int(active[at]))
    order = [f for f in np.lexsort((np.arange(len(loads)), rest)) if joins[f] <= levels[at]]
    given = np.maximum(0, levels[at] + whole - joins)
    given[order[:part]] += 1
    return place, loads + given * size


def lightest_folds(df: DataFrame, group: str, k: int) -> DataFrame:
    """(group, n_rows, fold): groups by size descending (equal ones by hash), each to the fold with the fewest rows so far.

    Folds' loads are carried over the distinct sizes, at most sqrt(2 rows) of them, in one pass; where a group of a size goes follows
    from the loads before that size and the group's place among its equals, so groups are never walked one by one.
    """
    dealt = group_folds(df, group, k).drop("fold")
    sizes = dealt.groupBy("n_rows").agg(F.count(F.lit(1)).alias("_c"), F.min("position").alias("_first"))

    def carry(batches):
        loads = np.zeros(k, dtype=np.int64)
        for pdf in batches:
            before = []
            for size, count in zip(pdf["n_rows"].tolist(), pdf["_c"].tolist()):
                before.append(loads.tolist())
                loads = _dealt(loads, size, count)[1]
            yield pdf.assign(_loads=before)[["n_rows", "_first", "_loads"]]

    states = sizes.repartition(1).sortWithinPartitions(F.desc("n_rows")).mapInPandas(carry, "n_rows long, _first long, _loads array<long>")
    placed = attach(dealt, states, ["n_rows"], count_rows=True)
    kind = dict(df.dtypes)[group]

    def choose(batches):
        for pdf in batches:
            fold = np.zeros(len(pdf), dtype=np.int64)
            for size, at in pdf.groupby("n_rows").indices.items():
                part = pdf.iloc[at]
                fold[at] = _dealt(np.asarray(part["_loads"].iloc[0], dtype=np.int64), int(size), 0)[0]((part["position"] - part["_first"]).to_numpy())
            yield pdf.assign(fold=fold)[[group, "n_rows", "fold"]]

    return placed.select(group, "n_rows", "position", "_first", "_loads").mapInPandas(choose, f"`{group}` {kind}, n_rows long, fold long")


def row_folds(df: DataFrame, row_id: str, k: int, seed: int) -> DataFrame:
    """Shuffled k-fold by row hash."""
    return df.withColumn("fold", F.pmod(hash_number(F.col(row_id), seed), F.lit(k)))


def eligible_groups(df: DataFrame, group: str, minimum_rows: int) -> DataFrame:
    return group_sizes(df, group).where(F.col("n_rows") >= minimum_rows).orderBy(F.desc("n_rows"), group)


def fold_sizes(df: DataFrame, group: str, minimum_rows: int) -> DataFrame:
    """Held-out and training rows of every leave-one-group-out fold, without expanding any fold."""
    totals = df.agg(F.count(F.lit(1)).alias("_total"))
    return with_scalars(eligible_groups(df, group, minimum_rows), totals).select(
        F.col(group).alias("evaluation_fold"), F.col("n_rows").alias("heldout_rows"),
        (F.col("_total") - F.col("n_rows")).alias("train_rows"),
    )


def fold_roles(df: DataFrame, group: str, heldout: object) -> DataFrame:
    """Role of every row in one leave-one-group-out fold."""
    return df.withColumn("role", F.when(F.col(group).eqNullSafe(F.lit(heldout)), F.lit("heldout")).otherwise(F.lit("train")))


def shared_roles(manifest: DataFrame) -> DataFrame:
    """Translate split names to role names; an unknown split fails."""
    chain = F
    for split, role in ROLE_OF_SPLIT.items():
        chain = chain.when(F.col("split") == split, F.lit(role))
    role = chain.otherwise(F.raise_error(F.concat(F.lit("unsupported split: "), F.col("split"))).cast("string"))
    return manifest.select(F.lit("shared_group_test").alias("evaluation_fold"), "*", role.alias("role"))


def held_group_roles(sizes: DataFrame, manifest: DataFrame, group: str, heldout: object, calibration_split: str = "validation") -> DataFrame:
    """One fold's manifest: the held group, the fixed calibration groups, the rest train."""
    joined = attach(sizes.select(group, "n_rows"), manifest.select(group, F.col("split").alias("_split")), [group])
    absent = F.raise_error(F.concat(F.lit("group absent from manifest: "), F.col(group).cast("string"))).cast("string")
    role = (
        F.when(F.col("_split").isNull(), absent)
        .when(F.col(group).eqNullSafe(F.lit(heldout)), F.lit("heldout"))
        .when(F.col("_split") == calibration_split, F.lit("calibration"))
        .otherwise(F.lit("train"))
    )
    return joined.select(
        F.lit(heldout).cast("string").alias("evaluation_fold"), group, "n_rows", F.col("_split").alias("base_split"),
        role.alias("role"), F.lit(False).alias("assignment_uses_target_values"),
    )


def carve_calibration(df: DataFrame, key: str, share: float, seed: int, train: str = "train", out: str = "role") -> DataFrame:
    """Move a hashed share of the training rows to calibration; ``key`` may be the row id or the group."""
    part = (F.col(out) == train) & (hash_unit(F.col(key), seed) < F.lit(share))
    return df.withColumn(out, F.when(part, F.lit("calibration")).otherwise(F.col(out)))
