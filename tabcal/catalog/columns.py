"""Projection, filters, outlier rules, joins, ordering and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabcal.catalog.base import FRACTIONS, LINES, PRED, SEED, SPLIT_LINES, lines, predictions, query, r, rounded, table
from tabcal.operators import columns as C, joins as J, ordering as O
from tabcal.operators.splits import random_split

TRAIN = "split = 'train'"


def split_lines(spark, sf):
    return random_split(lines(spark, sf), "row_id", FRACTIONS, SEED)


@query("feature_target_p1", LINES + "SELECT row_id, l_quantity, l_discount, l_tax, l_extendedprice FROM lines")
def _(spark, sf):
    return C.features_and_target(lines(spark, sf), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", "row_id")


@query("column_finder_io4", "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders")
def _(spark, sf):
    d = C.require_columns(table(spark, sf, "orders"), ["o_orderkey"])
    return d.select(*C.matching_columns(d.columns, ["O_ORDERKEY", "totalprice", "priority", "nothing"]))


@query("valid_target_p2", LINES + "SELECT row_id, amount FROM lines WHERE amount IS NOT NULL")
def _(spark, sf):
    return C.valid_target_rows(lines(spark, sf).select("row_id", "amount"), "amount")


@query("target_summary_p2", LINES + """SELECT 'total_rows' AS metric, count(*)::DOUBLE AS value FROM lines
 UNION ALL SELECT 'valid_target_rows', count(amount)::DOUBLE FROM lines UNION ALL SELECT 'missing_target_rows', (count(*) - count(amount))::DOUBLE FROM lines
 UNION ALL SELECT 'valid_target_percent', round(count(amount) * 100.0::DOUBLE / count(*), 9) FROM lines""")
def _(spark, sf):
    return rounded(C.target_summary(lines(spark, sf), "amount"), 9)


@query("drop_unused_p3", LINES + "SELECT row_id, l_suppkey, amount, discount FROM lines WHERE amount IS NOT NULL")
def _(spark, sf):
    d = lines(spark, sf).select("row_id", "l_suppkey", "amount", "discount", "status", "empty")
    return C.drop_unused(d, "amount", ["status", "empty"])


@query("prefix_candidates_p4", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus FROM lineitem")
def _(spark, sf):
    d = lines(spark, sf)
    return d.select(*C.candidates_by_prefix(d.columns, ["l_"], "l_extendedprice"))


@query("excluded_columns_p5", LINES + """SELECT "column", reason, round(missing, 8) + 0.0 AS missing_fraction FROM (
 SELECT unnest(['row_id', 'l_orderkey', 'l_partkey', 'l_suppkey', 'l_linenumber', 'sparse', 'empty']) AS "column", unnest(['identifier', 'lineage', 'lineage', 'lineage', 'lineage', 'outside_scope', 'outside_scope']) AS reason,
 unnest([avg((row_id IS NULL)::INT), avg((l_orderkey IS NULL)::INT), avg((l_partkey IS NULL)::INT), avg((l_suppkey IS NULL)::INT), avg((l_linenumber IS NULL)::INT), avg((sparse IS NULL)::INT), avg((empty IS NULL)::INT)]) AS missing FROM lines)""")
def _(spark, sf):
    d = lines(spark, sf)
    selected = ["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "amount", "kind", "discount", "status"]
    return rounded(C.excluded_columns_audit(d, selected, "l_extendedprice", [("row_id", "identifier"), ("l_", "lineage")], "outside_scope"), 8)


@query("type_partition_p6", LINES + "SELECT row_id, l_quantity + l_discount + l_tax AS numeric_sum, concat_ws('|', l_returnflag, l_linestatus) AS labels FROM lines")
def _(spark, sf):
    d = lines(spark, sf)
    numeric, labels = C.type_partition(d, ["l_quantity", "l_discount", "l_returnflag", "l_tax", "l_linestatus"])
    return d.select("row_id", sum((F.col(c) for c in numeric[1:]), F.col(numeric[0])).alias("numeric_sum"), F.concat_ws("|", *labels).alias("labels"))


POLICY_COLUMNS = ["amount", "discount", "status", "sparse", "empty", "l_tax"]


def share_rows(template, columns=POLICY_COLUMNS, source="lines"):
    return " UNION ALL ".join("SELECT " + template.replace("$c", c) + f" FROM {source}" for c in columns)


@query("missingness_policy_p7", LINES + share_rows("""'$c' AS feature, round(count(*) FILTER ($c IS NULL) / count(*)::DOUBLE, 9) AS missing_fraction_before_semantic_recode,
 round(count(*) FILTER ($c IS NULL) * 100 / count(*)::DOUBLE, 9) AS missing_percentage_before_semantic_recode, 0.5::DOUBLE AS missing_threshold,
 count(*) FILTER ($c IS NULL) / count(*)::DOUBLE <= 0.5::DOUBLE AS kept,
 CASE WHEN count(*) FILTER ($c IS NULL) / count(*)::DOUBLE <= 0.5::DOUBLE THEN '' ELSE 'missing_fraction_above_0.5' END AS drop_reason"""))
def _(spark, sf):
    return rounded(C.missingness_policy(lines(spark, sf), POLICY_COLUMNS, 0.5), 9)


@query("drop_sparse_p7", LINES + "SELECT row_id, amount, discount, status, l_tax FROM lines")
def _(spark, sf):
    return C.drop_sparse_columns(lines(spark, sf).select("row_id", *POLICY_COLUMNS), POLICY_COLUMNS, 0.5)


@query("shared_normaliser_p8", LINES + "SELECT row_id, coalesce(amount, 0) AS amount, coalesce(discount, 0) AS discount, l_extendedprice FROM lines")
def _(spark, sf):
    d = lines(spark, sf).select("row_id", "l_suppkey", "amount", "discount", "empty", "l_extendedprice")
    return C.normalize_shared_table(d, artefacts=["empty"], zero_fill=["amount", "discount"], target="l_extendedprice", key="l_suppkey")


@query("ablation_p9", LINES + "SELECT row_id, amount, kind, discount, status, sparse, empty FROM lines")
def _(spark, sf):
    return C.ablate(lines(spark, sf), prefixes=["L_"])


BOUNDS = ", bd AS (SELECT quantile_cont(l_extendedprice, 0.025) AS lo, quantile_cont(l_extendedprice, 0.975) AS hi FROM sl WHERE split = 'train')"


@query("target_trim_p10", SPLIT_LINES + BOUNDS + " SELECT row_id, split, l_extendedprice FROM sl, bd WHERE split <> 'train' OR l_extendedprice BETWEEN lo AND hi")
def _(spark, sf):
    return C.trim_train_target(split_lines(spark, sf).select("row_id", "split", "l_extendedprice"), "l_extendedprice", TRAIN, 0.025, 0.975)


@query("trim_audit_p10", SPLIT_LINES + BOUNDS + """ SELECT 0.025::DOUBLE AS lower_quantile, 0.975::DOUBLE AS upper_quantile, round(max(lo), 6) AS lower_threshold, round(max(hi), 6) AS upper_threshold,
 count(*) AS training_rows_before, count(*) FILTER (l_extendedprice BETWEEN lo AND hi) AS training_rows_after,
 count(*) FILTER (NOT l_extendedprice BETWEEN lo AND hi) AS training_rows_removed FROM sl, bd WHERE split = 'train'""")
def _(spark, sf):
    return rounded(C.trim_audit(split_lines(spark, sf), "l_extendedprice", TRAIN, 0.025, 0.975))


@query("sd_filter_p11", SPLIT_LINES + """, b AS (SELECT avg(amount) a1, stddev_samp(amount) s1, avg(l_extendedprice) a2, stddev_samp(l_extendedprice) s2 FROM sl WHERE split = 'train')
 SELECT row_id, split, amount, l_extendedprice FROM sl, b WHERE amount BETWEEN a1 - 1.5 * s1 AND a1 + 1.5 * s1 AND l_extendedprice BETWEEN a2 - 1.5 * s2 AND a2 + 1.5 * s2""")
def _(spark, sf):
    d = split_lines(spark, sf).select("row_id", "split", "amount", "l_extendedprice")
    return C.within_sd(d, ["amount", "l_extendedprice"], TRAIN, 1.5)


IQR_COLUMNS = ["l_quantity", "l_extendedprice", "spiked"]
IQR_SQL = LINES + """, x AS (SELECT row_id, l_quantity, l_extendedprice, CASE WHEN l_orderkey % 97 = 0 THEN l_tax * 100 + 50 ELSE l_tax END AS spiked FROM lines),
 u AS (UNPIVOT x ON l_quantity, l_extendedprice, spiked INTO NAME "column" VALUE value),
 q AS (SELECT "column", quantile_cont(value, 0.25) - 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS lower,
   quantile_cont(value, 0.75) + 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS upper FROM u GROUP BY 1)
"""


def spiked(spark, sf):
    return lines(spark, sf).withColumn("spiked", F.expr("CASE WHEN l_orderkey % 97 = 0 THEN l_tax * 100 + 50 ELSE l_tax END"))


@query("iqr_bounds_p12", IQR_SQL + 'SELECT "column", round(lower, 6) + 0.0 AS lower, round(upper, 6) + 0.0 AS upper FROM q')
def _(spark, sf):
    return rounded(C.iqr_bounds(spiked(spark, sf), IQR_COLUMNS))


@query("iqr_outlier_rows_p12", IQR_SQL + 'SELECT row_id, u."column", value FROM u JOIN q USING ("column") WHERE value < lower OR value > upper')
def _(spark, sf):
    return C.iqr_outlier_rows(spiked(spark, sf), "row_id", IQR_COLUMNS)


@query("iqr_outlier_summary_p12", IQR_SQL + """SELECT "column", count(*) FILTER (value < lower OR value > upper) AS outlier_count,
 round(count(*) FILTER (value < lower OR value > upper) * 100.0::DOUBLE / count(*), 6) AS outlier_percent FROM u JOIN q USING ("column") GROUP BY 1 HAVING outlier_count > 0""")
def _(spark, sf):
    return rounded(C.iqr_outlier_summary(spiked(spark, sf), IQR_COLUMNS))


BY_CUST = """WITH m AS (SELECT o_custkey, count(*) AS n_rows, avg(abs(o_totalprice - 250000) / 7) AS MAE, avg(CASE WHEN o_totalprice < 400000 THEN 1.0::DOUBLE ELSE 0 END) AS coverage FROM orders GROUP BY 1)"""


def by_customer(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg(F.abs(F.col("o_totalprice") - 250000) / 7).alias("MAE"),
        F.avg((F.col("o_totalprice") < 400000).cast("double")).alias("coverage"))


@query("stable_results_p13", BY_CUST + " SELECT o_custkey, n_rows, round(MAE, 4) AS MAE, round(coverage, 6) AS coverage FROM m WHERE NOT (MAE >= 17000 AND n_rows <= 8)")
def _(spark, sf):
    return rounded(C.stable_results(by_customer(spark, sf), 17000.0, 8), 6, MAE=4)


@query("poor_coverage_p13", BY_CUST + " SELECT o_custkey, n_rows, round(MAE, 4) AS MAE, round(coverage, 6) AS coverage FROM m WHERE coverage < 0.9::DOUBLE")
def _(spark, sf):
    return rounded(C.poor_coverage(by_customer(spark, sf), 0.9), 6, MAE=4)


@query("distinct_complete_p14", LINES + "SELECT DISTINCT amount, kind, discount FROM lines WHERE amount IS NOT NULL AND kind IS NOT NULL AND discount IS NOT NULL")
def _(spark, sf):
    return C.distinct_complete_rows(lines(spark, sf), ["amount", "kind", "discount"])


@query("distinct_rows_u4", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def _(spark, sf):
    return table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").dropDuplicates()


@query("label_columns_p15", "SELECT 'semantic_50' AS policy, 'default' AS preprocessing_policy, l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def _(spark, sf):
    counts = table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    return C.add_labels(counts, {"policy": "semantic_50", "preprocessing_policy": "default"})


@query("align_columns_u3", LINES + "SELECT l_quantity, l_tax, 0.0::DOUBLE AS never_seen FROM lines")
def _(spark, sf):
    return C.align_columns(lines(spark, sf), ["l_quantity", "l_tax", "never_seen"])


# ---- joins ------------------------------------------------------------------------------
@query("many_to_one_j1", "SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity, s_name AS supplier_name, s_acctbal FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey")
def _(spark, sf):
    d = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    right = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name", "s_acctbal")
    return J.many_to_one(d, right, ["l_suppkey"], {"s_name": "supplier_name"})


MANIFEST = "(SELECT s_suppkey AS l_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'calibration' WHEN s_suppkey % 5 = 1 THEN 'heldout' ELSE 'train' END AS role FROM supplier)"


def supplier_manifest(spark, sf):
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"),
        F.expr("CASE WHEN s_suppkey % 5 = 0 THEN 'calibration' WHEN s_suppkey % 5 = 1 THEN 'heldout' ELSE 'train' END").alias("role"))


@query("complete_lookup_j2", LINES + f"SELECT row_id, l_suppkey, m.role FROM lines JOIN {MANIFEST} m USING (l_suppkey)")
def _(spark, sf):
    return J.complete_lookup(lines(spark, sf).select("row_id", "l_suppkey"), supplier_manifest(spark, sf), "l_suppkey", "role")


@query("unassigned_groups_j3", LINES + "SELECT l_suppkey, count(*) AS n_rows FROM lines WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY 1")
def _(spark, sf):
    manifest = table(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return J.unassigned_groups(lines(spark, sf), manifest, "l_suppkey")


@query("append_lineage_j4", LINES + "SELECT row_id, l_quantity AS Actual, 25.0::DOUBLE AS Predicted, l_suppkey, l_orderkey FROM lines")
def _(spark, sf):
    d = lines(spark, sf)
    scored = d.select("row_id", F.col("l_quantity").alias("Actual"), F.lit(25.0).alias("Predicted"))
    return J.append_lineage(scored, d.select("row_id", F.lit(0.0).alias("Actual"), "l_suppkey", "l_orderkey"))


@query("reattach_key_j6", LINES + "SELECT row_id, amount, discount, l_suppkey FROM lines WHERE amount IS NOT NULL")
def _(spark, sf):
    d = lines(spark, sf)
    cleaned = d.select("row_id", "amount", "discount").where("amount IS NOT NULL")
    return J.append_lineage(cleaned, d.select("row_id", "l_suppkey"))


@query("semi_join_j7", LINES + "SELECT row_id, l_orderkey FROM lines WHERE l_orderkey IN (SELECT l_orderkey FROM lines GROUP BY 1 HAVING count(DISTINCT l_suppkey) >= 3)")
def _(spark, sf):
    d = lines(spark, sf).select("row_id", "l_orderkey", "l_suppkey")
    many = d.groupBy("l_orderkey").agg(F.count_distinct("l_suppkey").alias("s")).where("s >= 3")
    return J.rows_with_keys(d.select("row_id", "l_orderkey"), many, ["l_orderkey"])


@query("unseen_values_j8", SPLIT_LINES + """, c AS (SELECT split, 'l_partkey' AS "column", l_partkey::VARCHAR AS value FROM sl UNION ALL SELECT split, 'kind', kind FROM sl
 UNION ALL SELECT split, 'l_orderkey', l_orderkey::VARCHAR FROM sl)
 SELECT "column", value, count(*) AS n_rows FROM c WHERE split = 'test' AND value IS NOT NULL
 AND NOT EXISTS (SELECT 1 FROM c t WHERE t.split = 'train' AND t."column" = c."column" AND t.value = c.value) GROUP BY 1, 2""")
def _(spark, sf):
    d = split_lines(spark, sf)
    return J.unseen_values(d.where(TRAIN), d.where("split = 'test'"), ["l_partkey", "kind", "l_orderkey"])


# ---- windows, ordering, sets ---------------------------------------------------------------
@query("forward_fill_w1", """SELECT o_orderkey, last_value(k IGNORE NULLS) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS o_custkey
 FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 3 THEN o_custkey END AS k FROM orders)""")
def _(spark, sf):
    d = table(spark, sf, "orders").select("o_orderkey", F.expr("CASE WHEN o_orderkey % 7 = 3 THEN o_custkey END").alias("o_custkey"))
    return O.forward_fill(d, "o_orderkey", ["o_custkey"], block_rows=1000)


@query("rank_models_w2", PRED + """SELECT model, split, round(RMSE, 6) AS RMSE, rank() OVER (PARTITION BY split ORDER BY RMSE) AS rank
 FROM (SELECT model, split, sqrt(avg(SquaredError)) AS RMSE FROM pr GROUP BY 1, 2)""")
def _(spark, sf):
    m = predictions(spark, sf).groupBy("model", "split").agg(F.sqrt(F.avg("SquaredError")).alias("RMSE"))
    return rounded(O.rank_by(m, ["split"], "RMSE"))


@query("group_median_w3", LINES + "SELECT row_id, l_suppkey, l_extendedprice, round(median(l_extendedprice) OVER (PARTITION BY l_suppkey), 6) AS typical FROM lines")
def _(spark, sf):
    d = lines(spark, sf).select("row_id", "l_suppkey", "l_extendedprice")
    return O.group_median_to_rows(d, "l_suppkey", "l_extendedprice", "typical").withColumn("typical", r("typical"))


@query("first_per_group_w4", LINES + "SELECT row_id, l_suppkey, l_extendedprice FROM lines QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, row_id) <= 3")
def _(spark, sf):
    d = lines(spark, sf).select("row_id", "l_suppkey", "l_extendedprice")
    return O.first_per_group(d, ["l_suppkey"], [F.desc("l_extendedprice"), F.asc("row_id")], 3)


@query("duplicate_flags_w6", LINES + """SELECT row_id, count(*) OVER (PARTITION BY amount, kind, discount) AS copies,
 row_number() OVER (PARTITION BY amount, kind, discount ORDER BY row_id) > 1 AS is_later_copy FROM lines""")
def _(spark, sf):
    d = lines(spark, sf).select("row_id", "amount", "kind", "discount")
    return O.duplicate_flags(d, ["amount", "kind", "discount"], "row_id").select("row_id", "copies", "is_later_copy")


@query("keep_first_w6", LINES + "SELECT amount, kind, discount, min(row_id) AS row_id, count(*) AS copies FROM lines GROUP BY 1, 2, 3")
def _(spark, sf):
    return O.keep_first(lines(spark, sf), ["amount", "kind", "discount"], "row_id")


@query("order_statistic_w8", LINES + """SELECT l_suppkey, count(*) AS n, min(l_extendedprice) FILTER (k = least(cnt, ceil(cnt * 0.25::DOUBLE)::BIGINT)) AS q
 FROM (SELECT l_suppkey, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) AS k, count(*) OVER (PARTITION BY l_suppkey) AS cnt FROM lines) GROUP BY 1""")
def _(spark, sf):
    from tabcal.operators.scale import order_statistics

    return order_statistics(lines(spark, sf), ["l_suppkey"], "l_extendedprice", {"q": (0.25, F.ceil(F.col("_n") * 0.25))})


@query("report_sort_o1", LINES + "SELECT kind, status, count(*) AS n FROM lines GROUP BY 1, 2 ORDER BY n DESC NULLS LAST, kind NULLS LAST, status NULLS LAST")
def _(spark, sf):
    return lines(spark, sf).groupBy("kind", "status").agg(F.count(F.lit(1)).alias("n")).orderBy(
        F.desc_nulls_last("n"), F.asc_nulls_last("kind"), F.asc_nulls_last("status"))


@query("worst_rows_o2", PRED + "SELECT model, row_id, round(AbsoluteError, 6) AS AbsoluteError FROM pr WHERE split = 'test' ORDER BY pr.AbsoluteError DESC, row_id, model LIMIT 50")
def _(spark, sf):
    p = predictions(spark, sf).where("split = 'test'").select("model", "row_id", "AbsoluteError")
    return rounded(O.top_k(p, [F.desc("AbsoluteError"), F.asc("row_id"), F.asc("model")], 50))


@query("ragged_union_u1", LINES + """SELECT 'by_kind' AS report, kind, NULL AS status, count(*) AS n FROM lines GROUP BY kind
 UNION ALL SELECT 'by_status', NULL, status, count(*) FROM lines GROUP BY status""")
def _(spark, sf):
    d = lines(spark, sf)
    count = lambda c, name: d.groupBy(c).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("report"), c, "n")
    return O.union_ragged([count("kind", "by_kind"), count("status", "by_status")])


@query("key_sets_u2", """SELECT count(DISTINCT l_partkey) AS left_keys, (SELECT count(*) FROM part) AS right_keys,
 (SELECT count(*) FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)) AS shared_keys,
 count(DISTINCT l_partkey) = (SELECT count(*) FROM part) AND count(DISTINCT l_partkey) = (SELECT count(*) FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)) AS equal_sets
 FROM lineitem""")
def _(spark, sf):
    left = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("k"))
    return O.key_set_comparison(left, table(spark, sf, "part").select(F.col("p_partkey").alias("k")), "k")
