import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import rows
from tabcal.functions import rules as R, text as T
from tabcal.operators import audit as A, columns as C, encode as E, joins as J, ordering as O, recode as K, splits as S
from tabcal.operators.evaluate import prediction_table, regression_metrics
from tabcal.plans.clean_split import run_policies
from tabcal.sources import readers as RD, writers as WR

FRACTIONS = {"train": 0.6, "validation": 0.2, "test": 0.2}


def test_range_midpoints(spark):
    df = spark.createDataFrame([("60 - 65",), ("85–96",), ("42.5",), (None,)], "t string")
    assert [r[0] for r in df.select(T.range_midpoint(F.col("t"))).collect()] == ["62.5", "90.5", "42.5", None]


def test_semantic_recode_truth_table(spark):
    cases = [(a, t) for a in (None, 0.0, 5.0) for t in (None, "x")]
    out = rows(K.recode_pairs(spark.createDataFrame(cases, "a double, t string"), [("p", "a", "t")]))
    assert out == [(0.0, "not_applicable"), (None, "x"), (0.0, "not_applicable"), (0.0, "x"), (5.0, "unknown_type"), (5.0, "x")]
    strong = rows(K.recode_with_dependents(spark.createDataFrame(cases, "a double, t string"), "p", "a", "t"))
    assert [x[1] for x in strong] == ["not_applicable"] * 4 + ["unknown_type", "x"]
    assert [x[2] for x in strong] == [1.0, 1.0, 0.0, 0.0, 0.0, 0.0]


@pytest.mark.parametrize("text,label", [
    ("PCE-based", "superplasticizer_polycarboxylate"), ("CEM II/B", "cement_portland"), ("Blended Cement", "cement_blended"),
    ("E-Glass", "fiber_glass"), ("apple pie", "apple_pie"), ("GGB FS", "slag_ggbfs"), ("Class (F)", "fly_ash_class_f"), ("  ", "missing_reported_gap"), (None, "missing_reported_gap"),
])
def test_domain_groups(spark, text, label):
    assert spark.createDataFrame([(text,)], "t string").select(R.domain_group(F.col("t"))).first()[0] == label


def test_curing_last_match_wins(spark):
    df = spark.createDataFrame([("standard then autoclave",), ("hot water",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(R.curing_regime(F.col("t"))).collect()] == ["autoclave", "water", "unknown_or_missing", "unknown_or_missing"]


def test_balanced_manifest(spark):
    data = spark.createDataFrame([(g,) for g in "aaabbccdef"], "g string")
    manifest = S.balanced_manifest(data, "g", FRACTIONS, 42, 20)
    refined = S.swap_refine(manifest, "g", FRACTIONS).collect()
    assert sorted(r.g for r in refined) == list("abcdef") and {r.split for r in refined} == set(FRACTIONS)
    assert sum(r.n_rows for r in refined) == 10
    gap = lambda found: sum((sum(r.n_rows for r in found if r.split == s) / (10 * f) - 1) ** 2 for s, f in FRACTIONS.items())
    assert gap(refined) <= gap(manifest.collect()) + 1e-12


def test_splits_do_not_depend_on_partitioning(spark):
    df = spark.range(3000).select(F.concat(F.lit("r"), "id").alias("row_id"), (F.col("id") % 97).alias("g"))
    for make in (lambda d: S.random_split(d, "row_id", FRACTIONS, 1), lambda d: S.group_split(d, "g", FRACTIONS, 1), lambda d: S.group_folds(d, "g", 5)):
        a, b = (sorted(map(tuple, make(d).collect())) for d in (df.repartition(1), df.repartition(13)))
        assert a == b
    grouped = S.apply_manifest(df, S.group_split(df, "g", FRACTIONS, 1), "g")
    assert A.crossing_groups(grouped, key="g", split="split").first().crossing_groups == 0 and grouped.count() == 3000


def test_duplicates_keep_the_first_row(spark):
    df = spark.createDataFrame([(0, 700.0, 120.0, "a"), (1, 700.0, 120.0, "a"), (2, 900.0, 160.0, "b")], "id int, x double, y double, g string")
    assert sorted(r.id for r in O.keep_first(df, ["x", "y"], "id").collect()) == [0, 2]
    audit = A.alignment_audit(df, row_id="id", target="y", group="g", predictors=["x"], lineage=["g", "id"]).first()
    assert (audit.exact_duplicate_rows_removed, audit.modeling_rows, audit.metadata_columns_in_predictors) == (1, 2, 0)
    swapped = spark.createDataFrame([("a", None), (None, "a")], "p string, q string")
    assert O.keep_first(swapped.withColumn("id", F.lit(1)), ["p", "q"], "id").count() == 2
    assert swapped.select(O.content_key(["p", "q"])).distinct().count() == 2


def test_forward_fill_crosses_blocks(spark):
    df = spark.createDataFrame([(i, "k" if i == 2 else None) for i in range(50)], "pos long, key string").repartition(5)
    assert [r.key for r in O.forward_fill(df, "pos", ["key"], block_rows=7).orderBy("pos").collect()] == [None] * 2 + ["k"] * 48


def test_joins_fail_on_bad_keys(spark):
    left, right = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "a"), (1, "b")], "k int, role string")
    with pytest.raises(Exception, match="not unique"):
        J.many_to_one(left, right, ["k"]).collect()
    with pytest.raises(Exception, match="no role"):
        J.complete_lookup(left, right.limit(1), "k", "role").collect()


def test_metrics_of_degenerate_groups(spark):
    df = spark.createDataFrame([("one", 1, 5.0, 4.0), ("flat", 2, 3.0, 3.0), ("flat", 3, 3.0, 3.0)], "m string, id int, a double, p double")
    table = prediction_table(df, row_id="id", actual="a", predicted="p", labels={"model": F.col("m")})
    out = {r.model: r for r in regression_metrics(table, ["model"]).collect()}
    assert out["one"].R2 is None and out["one"].R is None and out["flat"].R2 == 1.0 and out["one"].Bias == 1.0


def test_rare_categories_respect_limits(spark):
    labels = [(f"v{i:02d}",) for i in range(30) for _ in range(10 + i)] + [("rare",)]
    df = spark.createDataFrame(labels, "c string")
    kept = E.rare_category_map(df, ["c"])
    assert kept.count() == 19 and kept.where("has_rare").count() == 19
    out = E.group_rare(spark.createDataFrame([("v29",), ("v00",), ("new",), (None,)], "c string"), kept, ["c"])
    assert [r.c for r in out.collect()] == ["v29", "__infrequent__", "__infrequent__", "__infrequent__"]


def test_multi_row_header(spark, tmp_path):
    path = os.path.join(tmp_path, "raw.csv")
    with open(path, "w", encoding="latin-1") as f:
        f.write("Mix,Mix,Unnamed: 2\nCement,Cement,Note\nkg,kg,\n400,10,ok\n500,NaN,\n")
    df = RD.read_multi_header(spark, path, header_rows=2, units_rows=1)
    assert df.columns == ["Mix | Cement", "Mix | Cement_1", "Note"] and df.count() == 2
    plain = RD.read_multi_header(spark, path, header_rows=2, units_rows=1, names=["a", "b", "c"], drop=["c"])
    fixed = C.repair_types(T.normalize_blanks(plain), ["a", "b"])
    assert rows(fixed, "a") == [(400.0, 10.0), (500.0, None)]


def test_nan_becomes_null_and_params_round_trip(spark, tmp_path):
    path = os.path.join(tmp_path, "t")
    spark.createDataFrame([(1.0,), (float("nan"),)], "x double").write.parquet(path)
    assert RD.load_table(spark, path).where("x IS NULL").count() == 1
    WR.save_params(spark, {"b": 1, "a": [2]}, os.path.join(tmp_path, "p"))
    assert WR.load_params(spark, os.path.join(tmp_path, "p")) == {"a": [2], "b": 1}


def test_policy_runner_drops_and_reports(spark):
    pdf = pd.DataFrame({"id": [f"r{i}" for i in range(60)], "g": ["x"] * 60, "y": [float(i) for i in range(60)], "a": [None if i % 3 else 1.0 for i in range(60)], "t": ["u", None] * 30})
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "id string, g string, y double, a double, t string")
    tables, reports = run_policies(df, {"raw": None, "half": 0.5}, row_id="id", group="g", target="y", features=["a", "t"], pairs=[("p", "a", "t")], fractions=FRACTIONS, seed=1)
    assert "a" in tables["raw"].columns and "a" not in tables["half"].columns
    assert {(r.policy, r.applied) for r in reports["recode_summary"].collect()} == {("raw", True), ("half", False)}


def test_exchanges_go_on_until_none_helps(spark):
    """More than twenty exchanges are needed here."""
    data = [(i, 1 + (i % 2) * 9, "train" if i % 2 else ("validation" if i % 4 else "test")) for i in range(120)]
    manifest = spark.createDataFrame(data, "g int, n_rows long, split string")
    refined = S.swap_refine(manifest, "g", FRACTIONS)
    last = S.best_swap(refined, "g", FRACTIONS).first()
    assert last is None or last.score_after >= last.score_before - 1e-15
    moved = refined.alias("a").join(manifest.alias("b"), "g").where("a.split <> b.split").count()
    assert moved > 40


def test_header_rows_are_removed_by_place(spark, tmp_path):
    for name in ("a.csv", "b.csv"):
        with open(os.path.join(tmp_path, name), "w", encoding="latin-1") as f:
            f.write("x,y\nkg,m\n" + f"{name},1\nx,y\nkg,m\n")
    df = RD.read_multi_header(spark, str(tmp_path), header_rows=1, units_rows=1)
    assert df.columns == ["x", "y"]
    assert rows(df, "x", "y") == [("a.csv", "1"), ("b.csv", "1"), ("kg", "m"), ("kg", "m"), ("x", "y"), ("x", "y")]


def test_only_one_row_becomes_the_header(spark):
    df = spark.createDataFrame([(1, "name"), (1, "value"), (2, "other")], "o int, c string").coalesce(1)
    out = RD.promote_first_row(df, "o")
    assert out.columns == ["o", "name"] and rows(out, "o") == [(1, "value"), (2, "other")]


@pytest.mark.parametrize("record_bytes", [10, 1 << 20])
def test_file_fingerprints(spark, tmp_path, record_bytes):
    import hashlib

    contents = {"a b.bin": b"x" * 100_000, "small": b"tiny"}
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    got = RD.file_fingerprints(spark, str(tmp_path), record_bytes).collect()
    assert {(r.file, r.bytes, r.sha256) for r in got} == {(n, len(c), hashlib.sha256(c).hexdigest()) for n, c in contents.items()}


def test_chosen_columns_become_one_vector(spark):
    df = spark.createDataFrame([(f"r{i}", "train" if i < 40 else "test", i % 3, float(i), f"c{i % 8}" if i % 9 else None, f"d{i % 3}") for i in range(60)] + [("new", "test", 0, 1.0, "unseen", "d0")],
                               "id string, split string, fold int, y double, c string, d string")
    p = E.TablePreprocessor(numeric=["y"], one_hot_columns=["d"], vectors=["c"], target="y", folds=3)
    out = p.fit_transform(df)
    assert p.wide == {"c": 9} and sorted(p.categories) == ["d"]
    got = {r["id"]: r for r in out.collect()}
    assert len(got["r1"]["features"]) == 1 + 3 + 9 and got["new"]["c_onehot"].numNonzeros() == 0
    assert all(r["c_onehot"].numNonzeros() == 1 for i, r in got.items() if i != "new")
    assert len({int(r["c_onehot"].indices[0]) for i, r in got.items() if i != "new"}) == 9
    assert len(E.train_categories(df, ["c"])["c"]) == 10


def test_lightest_fold_equals_the_walk_over_groups(spark):
    import hashlib

    rng = np.random.default_rng(6)
    for k, draws in ((3, rng.integers(1, 6, 200)), (5, np.concatenate([[300, 90, 90, 7], rng.integers(1, 40, 120)])), (4, np.ones(50, dtype=int)), (7, np.array([5, 5]))):
        rows = [(f"g{i}",) for i, n in enumerate(draws) for _ in range(int(n))] + [(None,)] * 3
        df = spark.createDataFrame(rows, "g string")
        got = {r["g"]: (r["n_rows"], r["fold"]) for r in S.lightest_folds(df, "g", k).collect()}
        sizes = {f"g{i}": int(n) for i, n in enumerate(draws)} | {None: 3}
        loads, want = [0] * k, {}
        for g in sorted(sizes, key=lambda g: (-sizes[g], hashlib.md5((g or "").encode()).hexdigest(), g or "")):
            fold = loads.index(min(loads))
            want[g] = (sizes[g], fold)
            loads[fold] += sizes[g]
        assert got == want
    assert S.lightest_folds(df.limit(0), "g", 3).count() == 0
