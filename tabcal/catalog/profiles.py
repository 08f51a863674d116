"""Column and group profiles, splits, audits and lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabcal.catalog.base import FRACTIONS, LINES, SEED, SPLIT_LINES, lines, md5_unit_sql, query, r, rounded, round_sql, table
from tabcal.catalog.cleaning import PAIRS, RECODED, blanked
from tabcal.catalog.columns import POLICY_COLUMNS, share_rows, spiked, split_lines, IQR_SQL
from tabcal.operators import audit as A, columns as C, joins as J, ordering as O, profile as P, recode as K, splits as S
from tabcal.operators.information import neighbor_mutual_information
from tabcal.operators.scale import with_scalars

TRAIN = "split = 'train'"
FEATURES = ["amount", "kind", "discount", "status", "sparse", "l_tax"]


@query("missing_report_a4", LINES + share_rows("""'$c' AS "column", count(*) FILTER ($c IS NULL) AS missing_count, round(count(*) FILTER ($c IS NULL) * 100 / count(*)::DOUBLE, 9) AS missing_percent"""))
def _(spark, sf):
    return rounded(P.missing_report(lines(spark, sf), POLICY_COLUMNS), 9)


def before_after(c):
    return f"""SELECT '{c}' AS "column", count(*) FILTER (b.{c} IS NULL) AS missing_before, count(*) FILTER (rc.{c} IS NULL) AS missing_after,
 count(*) FILTER (b.{c} IS NULL) - count(*) FILTER (rc.{c} IS NULL) AS missing_reduced_by,
 round(count(*) FILTER (b.{c} IS NULL) * 100 / count(*)::DOUBLE, 9) AS missing_percentage_before,
 round(count(*) FILTER (rc.{c} IS NULL) * 100 / count(*)::DOUBLE, 9) AS missing_percentage_after FROM b JOIN rc USING (row_id)"""


@query("missing_before_after_a5", LINES + RECODED + " UNION ALL ".join(before_after(c) for c in ("amount", "kind", "discount", "status")))
def _(spark, sf):
    d = blanked(spark, sf)
    return rounded(P.missing_before_after(d.drop("row_id"), K.recode_pairs(d, PAIRS)), 9)


@query("fully_missing_a7", SPLIT_LINES + share_rows("""'$c' AS "column", count(*) AS train_rows, count(*) FILTER ($c IS NULL) AS missing_count_train,
 round(count(*) FILTER ($c IS NULL) / count(*)::DOUBLE, 9) AS missing_fraction_train, count($c) = 0 AS fully_missing_in_train, count($c) = 0 AS dropped_from_modeling,
 CASE WHEN count($c) = 0 THEN 'numeric_fully_missing_in_X_train' ELSE '' END AS drop_reason""", ["amount", "discount", "sparse", "empty"], "sl WHERE split = 'train'"))
def _(spark, sf):
    return rounded(P.fully_missing_audit(split_lines(spark, sf).where(TRAIN), ["amount", "discount", "sparse", "empty"]), 9)


CARDS = ["kind", "status", "l_linenumber", "l_suppkey"]


def card_sql(c, source):
    n = f"(count(DISTINCT {c}) + CASE WHEN count(*) > count({c}) THEN 1 ELSE 0 END)"
    return f"""SELECT '{c}' AS "column", count(*) - count({c}) AS missing_count_train, round((count(*) - count({c})) / count(*)::DOUBLE, 9) AS missing_fraction_train,
 {n} AS unique_categories_train, CASE WHEN {n} <= 10 THEN 'low' WHEN {n} <= 20 THEN 'medium' ELSE 'high' END AS cardinality_bucket,
 CASE WHEN {n} <= 10 THEN 'onehot_ignore_unknown' WHEN {n} <= 20 THEN 'rare_category_onehot' ELSE 'domain_grouping_then_rare_category_onehot' END AS encoder_policy,
 10::BIGINT AS low_cardinality_max, 20::BIGINT AS medium_cardinality_max FROM {source}"""


@query("cardinality_report_a8", SPLIT_LINES + " UNION ALL ".join(card_sql(c, "sl WHERE split = 'train'") for c in CARDS))
def _(spark, sf):
    return rounded(P.cardinality_report(split_lines(spark, sf).where(TRAIN), CARDS), 9)


ADVICE = ["l_returnflag", "l_linestatus", "kind", "row_id", "l_quantity"]


def advice_sql(c):
    text = c != "l_quantity"
    label = f"CASE WHEN count(DISTINCT {c}) = 2 THEN 'Binary Encoding' WHEN count(DISTINCT {c}) <= 10 THEN 'One-Hot Encoding' ELSE 'Ordinal/Target Encoding' END"
    return f"""SELECT '{c}' AS "column", '{'text' if text else 'number'}' AS kind, count(DISTINCT {c}) AS unique_values, {label if text else "'No Encoding'"} AS encoding FROM lines"""


@query("encoding_advice_a8", LINES + " UNION ALL ".join(advice_sql(c) for c in ADVICE))
def _(spark, sf):
    return P.encoding_advice(lines(spark, sf), ADVICE)


def contract_sql(i, c, role, present=True):
    if not present:
        return f"SELECT {i}::BIGINT AS position, '{c}' AS \"column\", '{role}' AS role, false AS present, NULL::BIGINT AS missing_count, NULL::BIGINT AS unique_values, NULL::BIGINT AS output_columns"
    width = f"count(DISTINCT {c}) + CASE WHEN count(*) > count({c}) THEN 1 ELSE 0 END" if role == "one_hot" else "1::BIGINT"
    return f"SELECT {i}::BIGINT AS position, '{c}' AS \"column\", '{role}' AS role, true AS present, count(*) - count({c}) AS missing_count, count(DISTINCT {c}) AS unique_values, {width} AS output_columns FROM lines"


@query("column_contract_a9", LINES + " UNION ALL ".join([
    contract_sql(0, "amount", "numeric"), contract_sql(1, "gone", "numeric", False), contract_sql(2, "kind", "one_hot"), contract_sql(3, "l_suppkey", "target_encoded")]))
def _(spark, sf):
    return P.column_contract(lines(spark, sf), ["amount", "gone"], ["kind"], ["l_suppkey"])


PROFILE_SQL = """SELECT "column", round(avg(value), 6) + 0.0 AS mean, round(median(value), 6) + 0.0 AS median, round(stddev_samp(value), 6) AS std, min(value) AS min, max(value) AS max,
 round(stddev_samp(value) * 100 / avg(value), 6) AS cv_percent, round(skewness(value), 6) + 0.0 AS skewness,
 count(*) FILTER (value > lim) AS outliers FROM (SELECT *, quantile_cont(value, 0.75) OVER w + 1.5 * stddev_samp(value) OVER w AS lim FROM u WINDOW w AS (PARTITION BY "column")) GROUP BY 1"""


@query("numeric_profile_a10", IQR_SQL + PROFILE_SQL)
def _(spark, sf):
    out = rounded(P.numeric_profile(spiked(spark, sf), ["l_quantity", "l_extendedprice", "spiked"]))
    return out


@query("describe_a11", IQR_SQL + """SELECT "column", count(value) AS "count", round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS min, max(value) AS max,
 round(kurtosis(value), 6) AS kurtosis, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.75), 6) AS q75 FROM u GROUP BY 1""")
def _(spark, sf):
    return rounded(P.describe(spiked(spark, sf), ["l_quantity", "l_extendedprice", "spiked"]))


@query("group_sizes_a11", """SELECT 'rows_per_group' AS "column", count(*) AS "count", round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std, min(n)::DOUBLE AS min, max(n)::DOUBLE AS max, round(kurtosis(n), 6) AS kurtosis,
 round(quantile_cont(n, 0.25), 6) AS q25, round(quantile_cont(n, 0.5), 6) AS q50, round(quantile_cont(n, 0.75), 6) AS q75 FROM (SELECT count(*)::DOUBLE AS n FROM lineitem GROUP BY l_suppkey)""")
def _(spark, sf):
    return rounded(P.group_size_describe(table(spark, sf, "lineitem"), "l_suppkey"))


@query("value_counts_a12", LINES + "SELECT kind, count(*) AS n, round(count(*) * 100 / (SELECT count(*) FROM lines)::DOUBLE, 9) AS percent FROM lines GROUP BY kind")
def _(spark, sf):
    return rounded(P.value_counts(lines(spark, sf), "kind"), 9)


CORRS = ["l_quantity", "l_extendedprice", "amount", "discount"]


@query("correlation_matrix_a13", LINES + " UNION ALL ".join(
    f"SELECT '{a}' AS left_column, '{b}' AS right_column, " + ("1.0::DOUBLE" if a == b else f"round(corr({a}, {b}), 8) + 0.0") + " AS r FROM " + ("(SELECT 1)" if a == b else "lines") for a in CORRS for b in CORRS))
def _(spark, sf):
    return rounded(P.correlation_matrix(lines(spark, sf), CORRS), 8)


@query("target_correlations_a13", LINES + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(corr({c}, l_extendedprice), 8) + 0.0 AS r FROM lines" for c in ["l_quantity", "amount", "discount"]))
def _(spark, sf):
    return rounded(P.target_correlations(lines(spark, sf), ["l_quantity", "amount", "discount"], "l_extendedprice"), 8)


@query("trend_lines_a14", LINES + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(regr_slope(l_extendedprice, {c}), 5) + 0.0 AS slope, round(regr_intercept(l_extendedprice, {c}), 5) AS intercept, round(regr_r2(l_extendedprice, {c}), 8) AS r2 FROM lines" for c in ["l_quantity", "amount", "discount"]))
def _(spark, sf):
    return rounded(P.trend_lines(lines(spark, sf), ["l_quantity", "amount", "discount"], "l_extendedprice"), 5, r2=8)


def mi_sql(c):
    edges = lambda col, cond: "[" + ", ".join(f"quantile_cont({col}, {i / 8}) {cond}" for i in range(1, 8)) + "]"
    return f"""SELECT '{c}' AS "column", round(sum(c / n * ln(c * n / (cx * cy))), 6) AS mutual_information FROM (
 SELECT c, sum(c) OVER () AS n, sum(c) OVER (PARTITION BY x) AS cx, sum(c) OVER (PARTITION BY y) AS cy FROM (
 SELECT len(list_filter(fe, lambda e: e < v)) AS x, len(list_filter(te, lambda e: e < t)) AS y, count(*)::DOUBLE AS c
 FROM (SELECT {c}::DOUBLE AS v, l_extendedprice AS t FROM lines WHERE {c} IS NOT NULL), (SELECT {edges(c, '')} AS fe, {edges('l_extendedprice', '')} AS te FROM lines) GROUP BY 1, 2))"""


@query("mutual_information_a15", LINES + " UNION ALL ".join(mi_sql(c) for c in ("l_quantity", "amount", "discount")))
def _(spark, sf):
    return rounded(P.mutual_information(lines(spark, sf), ["l_quantity", "amount", "discount"], "l_extendedprice"))


@query("neighbor_mutual_information_a15")
def _(spark, sf):
    return rounded(neighbor_mutual_information(lines(spark, sf), ["l_quantity", "amount", "discount"], "l_extendedprice", "row_id"))


@query("histogram_a16", """SELECT least(floor((o_totalprice - lo) / ((hi - lo) / 30)), 29)::BIGINT AS bin, count(*) AS n FROM orders, (SELECT min(o_totalprice) lo, max(o_totalprice) hi FROM orders) GROUP BY 1""")
def _(spark, sf):
    return P.histogram(table(spark, sf, "orders"), "o_totalprice", 30)


COMPOSITION = LINES + """, x AS (SELECT *, (amount IS NULL)::INT + (discount IS NULL)::INT + (sparse IS NULL)::INT AS mc FROM lines),
 dm AS (SELECT l_suppkey, kind AS dominant_category FROM (SELECT l_suppkey, kind, count(*) c FROM lines WHERE kind IS NOT NULL GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY c DESC, kind) = 1),
 ga AS (SELECT l_suppkey, count(*) AS n_rows, avg(l_extendedprice) AS target_mean, stddev_samp(l_extendedprice) AS target_std, min(l_extendedprice) AS target_min, max(l_extendedprice) AS target_max,
 sum(mc)::BIGINT AS missing_cells_total, avg(mc) AS missing_cells_per_row_mean, avg((amount > 0 IS TRUE)::INT) * 100 AS flag_percentage, count(*) >= 600 AS eligible,
 min(amount) AS amount_min, max(amount) AS amount_max FROM x GROUP BY 1)
"""


def composition(spark, sf):
    return P.group_composition(
        lines(spark, sf), group="l_suppkey", target="l_extendedprice", features=["amount", "discount", "sparse"],
        used=F.coalesce(F.col("amount") > 0, F.lit(False)), category="kind", numeric=["amount"], minimum_rows=600)


@query("group_composition_a17", COMPOSITION + """SELECT l_suppkey, n_rows, round(target_mean, 5) AS target_mean, round(target_std, 5) AS target_std, target_min, target_max, missing_cells_total,
 round(missing_cells_per_row_mean, 8) AS missing_cells_per_row_mean, round(flag_percentage, 8) AS flag_percentage, eligible, amount_min, amount_max, dominant_category FROM ga LEFT JOIN dm USING (l_suppkey)""")
def _(spark, sf):
    return rounded(composition(spark, sf), 8, target_mean=5, target_std=5)


@query("composition_summary_a17", COMPOSITION + """SELECT sum(n_rows)::BIGINT AS modeling_rows, count(*) AS groups, min(n_rows) AS minimum_group_rows, max(n_rows) AS maximum_group_rows, count(*) FILTER (eligible) AS groups_with_minimum_rows,
 coalesce(sum(n_rows) FILTER (eligible), 0)::BIGINT AS rows_in_groups_with_minimum_rows, round(max(n_rows) * 100 / sum(n_rows)::DOUBLE, 8) AS largest_group_row_percentage, median(n_rows) AS median_group_rows FROM ga""")
def _(spark, sf):
    return rounded(P.composition_summary(composition(spark, sf)), 8)


# ---- splits --------------------------------------------------------------------------------
@query("random_split_sp1", LINES + f"SELECT row_id, CASE WHEN {md5_unit_sql('row_id')} < 0.8::DOUBLE THEN 'train' ELSE 'test' END AS split FROM lines")
def _(spark, sf):
    return S.random_split(lines(spark, sf).select("row_id"), "row_id", {"train": 0.8, "test": 0.2}, SEED)


@query("three_way_split_sp2", SPLIT_LINES + "SELECT row_id, split FROM sl")
def _(spark, sf):
    return split_lines(spark, sf).select("row_id", "split")


HASHED = ["amount", "kind", "discount"]
HASH_SQL = "md5(coalesce(amount::VARCHAR, '__MISSING__') || chr(31) || coalesce(kind, '__MISSING__') || chr(31) || coalesce(discount::VARCHAR, '__MISSING__'))"


@query("feature_hash_sp3", LINES + f"SELECT row_id, {HASH_SQL} AS feature_group FROM lines")
def _(spark, sf):
    return S.feature_hash_group(lines(spark, sf).select("row_id", *HASHED), HASHED).select("row_id", "feature_group")


def group_split_sql(group, source):
    return f"""(SELECT *, CASE WHEN k <= floor(g * 0.7::DOUBLE) THEN 'train' WHEN k <= floor(g * 0.85::DOUBLE) THEN 'validation' ELSE 'test' END AS split FROM (
 SELECT {group}, n_rows, count(*) OVER () AS g, row_number() OVER (ORDER BY ('0x' || substr(md5({group}::VARCHAR || '|{SEED}'), 1, 13))::BIGINT) AS k
 FROM (SELECT {group}, count(*) AS n_rows FROM {source} GROUP BY 1)))"""


@query("group_split_sp4", LINES + f"SELECT l_orderkey, n_rows, split FROM {group_split_sql('l_orderkey', 'lines')}")
def _(spark, sf):
    return S.group_split(lines(spark, sf), "l_orderkey", FRACTIONS, SEED)


@query("hash_group_split_sp4", LINES + f", h AS (SELECT {HASH_SQL} AS feature_group FROM lines) SELECT feature_group, n_rows, split FROM {group_split_sql('feature_group', 'h')}")
def _(spark, sf):
    return S.group_split(S.feature_hash_group(lines(spark, sf), HASHED), "feature_group", FRACTIONS, SEED)


@query("largest_remainder_sp5", """, f AS (SELECT n, unnest(['train', 'validation', 'test']) AS split, unnest([0.7, 0.15, 0.15])::DOUBLE * n AS raw, unnest([1, 2, 3]) AS o FROM c)
 SELECT n_groups, split, (floor(raw) + CASE WHEN row_number() OVER (PARTITION BY n_groups ORDER BY raw - floor(raw) DESC, o) <= n - sum(floor(raw)) OVER (PARTITION BY n_groups) THEN 1 ELSE 0 END)::BIGINT AS groups
 FROM (SELECT n AS n_groups, * FROM f)""".replace(", f AS", "WITH c AS (SELECT count(*) AS n FROM lineitem GROUP BY l_suppkey), f AS", 1).replace("FROM c)", "FROM (SELECT DISTINCT n FROM c))"))
def _(spark, sf):
    n = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n")).select("n").distinct()
    shares = S.largest_remainder(F.col("n"), FRACTIONS)
    return n.select(F.col("n").alias("n_groups"), F.explode(F.map_from_entries(F.array(*[
        F.struct(F.lit(k), v) for k, v in shares.items()]))).alias("split", "groups"))


RESTARTS = 200


def restart_sql(restarts):
    return LINES + f""", gs AS (SELECT l_suppkey, count(*) AS n_rows FROM lines GROUP BY 1), tot AS (SELECT sum(n_rows)::DOUBLE AS t, count(*) AS g FROM gs),
 tg AS (SELECT split, CASE WHEN row_number() OVER (ORDER BY raw - floor(raw) DESC, o) <= g - sum(floor(raw)) OVER () THEN floor(raw) + 1 ELSE floor(raw) END AS groups
   FROM (SELECT unnest(['train', 'validation', 'test']) AS split, unnest([0.7, 0.15, 0.15])::DOUBLE * g AS raw, unnest([1, 2, 3]) AS o, g FROM tot)),
 tr AS (SELECT gs.*, restart, row_number() OVER (PARTITION BY restart ORDER BY ('0x' || substr(md5(l_suppkey || '|' || restart || '|{SEED}'), 1, 13))::BIGINT) AS k FROM gs, (SELECT unnest(range({restarts})) AS restart)),
 pl AS (SELECT *, CASE WHEN k <= (SELECT groups FROM tg WHERE split = 'train') THEN 'train' WHEN k <= (SELECT sum(groups) FROM tg WHERE split <> 'test') THEN 'validation' ELSE 'test' END AS split FROM tr),
 sc AS (SELECT restart, rows_train, rows_validation, rows_test, pow((rows_train - 0.7::DOUBLE * t) / (0.7::DOUBLE * t), 2) + pow((rows_validation - 0.15::DOUBLE * t) / (0.15::DOUBLE * t), 2) + pow((rows_test - 0.15::DOUBLE * t) / (0.15::DOUBLE * t), 2) AS score
   FROM (SELECT restart, coalesce(sum(n_rows) FILTER (split = 'train'), 0)::BIGINT AS rows_train, coalesce(sum(n_rows) FILTER (split = 'validation'), 0)::BIGINT AS rows_validation, coalesce(sum(n_rows) FILTER (split = 'test'), 0)::BIGINT AS rows_test FROM pl GROUP BY 1), tot)
"""


@query("manifest_restarts_sp6", restart_sql(RESTARTS) + "SELECT restart, rows_train, rows_validation, rows_test, round(score, 9) AS score FROM sc")
def _(spark, sf):
    sizes = S.group_sizes(lines(spark, sf), "l_suppkey")
    out = S.balanced_manifest_candidates(sizes, "l_suppkey", FRACTIONS, SEED, RESTARTS)
    return out.select("restart", "rows_train", "rows_validation", "rows_test", r("score", 9).alias("score"))


@query("balanced_manifest_sp6", restart_sql(RESTARTS) + """SELECT l_suppkey, n_rows, pl.split, round((CASE WHEN pl.split = 'train' THEN 0.7::DOUBLE ELSE 0.15::DOUBLE END) * t, 6) AS target_row_count,
 tg.groups::BIGINT AS target_group_count, false AS assignment_uses_target_values FROM pl JOIN tg ON tg.split = pl.split, tot WHERE restart = (SELECT restart FROM sc ORDER BY score, restart LIMIT 1)""")
def _(spark, sf):
    return rounded(S.balanced_manifest(lines(spark, sf), "l_suppkey", FRACTIONS, SEED, RESTARTS))


SWAP_SQL = LINES + f""", m AS {group_split_sql('l_suppkey', 'lines')}, tt AS (SELECT sum(n_rows)::DOUBLE AS t FROM m),
 rw AS (SELECT s, 0.0 + coalesce(sum(n_rows), 0)::DOUBLE AS rows, max(f) * max(t) AS want FROM (SELECT unnest(['train', 'validation', 'test']) AS s, unnest([0.7, 0.15, 0.15])::DOUBLE AS f), tt LEFT JOIN m ON m.split = s GROUP BY s)
"""


@query("best_swap_j9", SWAP_SQL + """SELECT round((SELECT sum(pow((rows - want) / want, 2)) FROM rw), 9) AS score_before, round(min(score), 9) AS score_after FROM (
 SELECT a.l_suppkey AS a, b.l_suppkey AS b, sum(pow((rows + CASE WHEN s = a.split THEN b.n_rows - a.n_rows WHEN s = b.split THEN a.n_rows - b.n_rows ELSE 0 END - want) / want, 2)) AS score
 FROM m a JOIN m b ON a.l_suppkey < b.l_suppkey AND a.split <> b.split, rw GROUP BY 1, 2)""")
def _(spark, sf):
    manifest = S.group_split(lines(spark, sf), "l_suppkey", FRACTIONS, SEED)
    return rounded(S.best_swap(manifest, "l_suppkey", FRACTIONS).select("score_before", "score_after"), 9)


@query("lightest_group_folds_sp7", LINES.replace("WITH lines", "WITH RECURSIVE lines", 1) + """, g AS MATERIALIZED (SELECT l_partkey, count(*) AS n_rows,
 row_number() OVER (ORDER BY count(*) DESC, md5(l_partkey::VARCHAR), l_partkey) AS k FROM lines GROUP BY 1),
 w AS (SELECT 0::BIGINT AS k, [0, 0, 0, 0, 0]::BIGINT[] AS loads, 0::BIGINT AS fold UNION ALL
  SELECT g.k, list_transform(w.loads, lambda x, i: x + CASE WHEN i = list_position(w.loads, list_min(w.loads)) THEN g.n_rows ELSE 0 END), list_position(w.loads, list_min(w.loads)) - 1 FROM w JOIN g ON g.k = w.k + 1)
SELECT l_partkey, n_rows, w.fold FROM g JOIN w ON w.k = g.k""")
def _(spark, sf):
    return S.lightest_folds(lines(spark, sf), "l_partkey", 5)


@query("group_folds_sp7", LINES + """SELECT l_orderkey, n_rows, k AS position, CASE WHEN k % 10 < 5 THEN k % 10 ELSE 9 - k % 10 END AS fold FROM (
 SELECT l_orderkey, n_rows, row_number() OVER (ORDER BY n_rows DESC, md5(l_orderkey::VARCHAR), l_orderkey) - 1 AS k FROM (SELECT l_orderkey, count(*) AS n_rows FROM lines GROUP BY 1))""")
def _(spark, sf):
    return S.group_folds(lines(spark, sf), "l_orderkey", 5)


@query("row_folds_sp7", LINES + f"SELECT row_id, ('0x' || substr(md5(row_id || '|{SEED}'), 1, 8))::BIGINT % 5 AS fold FROM lines")
def _(spark, sf):
    return S.row_folds(lines(spark, sf).select("row_id"), "row_id", 5, SEED)


@query("eligible_groups_sp8", LINES + "SELECT l_suppkey, count(*) AS n_rows FROM lines GROUP BY 1 HAVING count(*) >= 50")
def _(spark, sf):
    return S.eligible_groups(lines(spark, sf), "l_suppkey", 50)


@query("fold_sizes_sp8", LINES + "SELECT l_suppkey AS evaluation_fold, count(*) AS heldout_rows, (SELECT count(*) FROM lines) - count(*) AS train_rows FROM lines GROUP BY 1 HAVING count(*) >= 50")
def _(spark, sf):
    return S.fold_sizes(lines(spark, sf), "l_suppkey", 50)


@query("shared_roles_sp9", LINES + f"SELECT 'shared_group_test' AS evaluation_fold, l_suppkey, n_rows, split, CASE split WHEN 'train' THEN 'train' WHEN 'validation' THEN 'calibration' ELSE 'heldout' END AS role FROM {group_split_sql('l_suppkey', 'lines')}")
def _(spark, sf):
    return S.shared_roles(S.group_split(lines(spark, sf), "l_suppkey", FRACTIONS, SEED))


@query("held_group_roles_sp9", LINES + f"""SELECT '7' AS evaluation_fold, l_suppkey, n_rows, split AS base_split, CASE WHEN l_suppkey = 7 THEN 'heldout' WHEN split = 'validation' THEN 'calibration' ELSE 'train' END AS role,
 false AS assignment_uses_target_values FROM {group_split_sql('l_suppkey', 'lines')}""")
def _(spark, sf):
    d = lines(spark, sf)
    return S.held_group_roles(S.group_sizes(d, "l_suppkey"), S.group_split(d, "l_suppkey", FRACTIONS, SEED), "l_suppkey", 7)


@query("rows_by_role_sp9", LINES + f"SELECT row_id, CASE m.split WHEN 'train' THEN 'train' WHEN 'validation' THEN 'calibration' ELSE 'heldout' END AS role FROM lines JOIN {group_split_sql('l_suppkey', 'lines')} m USING (l_suppkey)")
def _(spark, sf):
    d = lines(spark, sf).select("row_id", "l_suppkey")
    return S.apply_manifest(d, S.shared_roles(S.group_split(d, "l_suppkey", FRACTIONS, SEED)), "l_suppkey", "role").select("row_id", "role")


@query("carve_calibration_sp10", SPLIT_LINES + f"SELECT row_id, CASE WHEN split = 'train' AND {md5_unit_sql('l_suppkey', 7)} < 0.15::DOUBLE THEN 'calibration' ELSE split END AS role FROM sl")
def _(spark, sf):
    d = split_lines(spark, sf).select("row_id", "l_suppkey", F.col("split").alias("role"))
    return S.carve_calibration(d, "l_suppkey", 0.15, 7).select("row_id", "role")


# ---- audits --------------------------------------------------------------------------------
@query("split_summary_a18", SPLIT_LINES + """SELECT split, count(*) AS n_rows, count(DISTINCT l_suppkey) AS n_groups, round(avg(l_extendedprice), 5) AS target_mean, round(stddev_samp(l_extendedprice), 5) AS target_std,
 min(l_extendedprice) AS target_min, max(l_extendedprice) AS target_max, (count(*) * 2 - count(amount) - count(discount)) AS missing_predictor_cells,
 round((count(*) * 2 - count(amount) - count(discount)) / count(*)::DOUBLE, 8) AS missing_predictor_cells_per_row, round(count(*) * 100 / (SELECT count(*) FROM sl)::DOUBLE, 8) AS row_percentage FROM sl GROUP BY 1""")
def _(spark, sf):
    out = A.split_summary(split_lines(spark, sf), split="split", group="l_suppkey", target="l_extendedprice", features=["amount", "discount"])
    return rounded(out, 8, target_mean=5, target_std=5)


LEAK_SQL = """, o AS (SELECT l_suppkey, max((split = 'train')::INT) a, max((split = 'validation')::INT) b, max((split = 'test')::INT) c, count(*) n FROM sl GROUP BY 1),
 k AS (SELECT count(*) FILTER (a + b = 2) ab, count(*) FILTER (a + c = 2) ac, count(*) FILTER (b + c = 2) bc, sum(n)::BIGINT AS n FROM o),
 lk AS (SELECT 'train_validation_group_overlap' AS "check", ab::VARCHAR AS value, CASE WHEN ab = 0 THEN 'pass' ELSE 'fail' END AS status FROM k
 UNION ALL SELECT 'train_test_group_overlap', ac::VARCHAR, CASE WHEN ac = 0 THEN 'pass' ELSE 'fail' END FROM k UNION ALL SELECT 'validation_test_group_overlap', bc::VARCHAR, CASE WHEN bc = 0 THEN 'pass' ELSE 'fail' END FROM k
 UNION ALL SELECT 'assignment_uses_target_values', 'false', 'pass' UNION ALL SELECT 'all_rows_assigned', n::VARCHAR, 'pass' FROM k)
"""


@query("leakage_audit_a19", SPLIT_LINES + LEAK_SQL + "SELECT * FROM lk")
def _(spark, sf):
    return A.leakage_audit(split_lines(spark, sf), split="split", group="l_suppkey", names=["train", "validation", "test"])


@query("readiness_audit_a19", SPLIT_LINES + LEAK_SQL + """SELECT * FROM lk UNION ALL SELECT split || '_has_rows', count(*)::VARCHAR, 'pass' FROM sl GROUP BY split
 UNION ALL SELECT unnest(['target_complete', 'group_complete', 'row_ids_unique', 'all_source_rows_represented']), count(*)::VARCHAR, 'pass' FROM sl
 UNION ALL VALUES ('target_not_a_predictor', 'l_extendedprice', 'pass'), ('lineage_columns_excluded_from_predictors', '0', 'pass')""")
def _(spark, sf):
    source = table(spark, sf, "lineitem").agg(F.count(F.lit(1)).alias("n"))
    return A.readiness_audit(
        split_lines(spark, sf), split="split", group="l_suppkey", target="l_extendedprice", row_id="row_id",
        features=["amount", "kind", "discount"], lineage=["l_suppkey", "row_id"], names=["train", "validation", "test"], expected_rows=source)


@query("role_summary_a19", SPLIT_LINES + "SELECT split, 'row_random' AS evaluation_fold, count(*) AS n_rows, count(DISTINCT l_suppkey) AS n_groups FROM sl GROUP BY 1")
def _(spark, sf):
    return A.role_summary(split_lines(spark, sf), role="split", group="l_suppkey", fold="row_random")


@query("crossing_groups_a20", SPLIT_LINES + f""", g AS (SELECT {HASH_SQL} AS h, count(DISTINCT split) s, count(*) n FROM sl GROUP BY 1)
 SELECT count(*) AS groups, count(*) FILTER (s > 1) AS crossing_groups, count(*) FILTER (n > 1) AS repeated_groups, coalesce(sum(n) FILTER (s > 1), 0)::BIGINT AS rows_in_crossing_groups FROM g""")
def _(spark, sf):
    return A.crossing_groups(S.feature_hash_group(split_lines(spark, sf), HASHED), key="feature_group", split="split")


@query("alignment_audit_j5", LINES + """, k AS (SELECT kind, discount, l_quantity, amount, count(*) c, min(row_id) AS id FROM lines WHERE amount IS NOT NULL GROUP BY 1, 2, 3, 4)
 SELECT (SELECT count(*) FROM lines) AS source_rows, (SELECT count(*) FROM lines WHERE amount IS NULL) AS missing_target_rows_removed, 0::BIGINT AS missing_groups,
 count(*) AS modeling_rows, sum(c - 1)::BIGINT AS exact_duplicate_rows_removed, 4::BIGINT AS modeling_columns, 0::BIGINT AS metadata_columns_in_predictors, count(DISTINCT id) = count(*) AS row_ids_unique FROM k""")
def _(spark, sf):
    return A.alignment_audit(lines(spark, sf), row_id="row_id", target="amount", group="l_suppkey",
                             predictors=["kind", "discount", "l_quantity"], lineage=["l_suppkey", "row_id"])
