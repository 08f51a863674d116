"""Text cleaning, classifiers, recodes and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabcal.catalog.base import FRACTIONS, LINES, SEED, SPLIT_LINES, lines, query, r, rounded, table
from tabcal.functions import features as X, rules as R, text as T
from tabcal.operators import columns as C, recode as K
from tabcal.operators.splits import random_split

# Raw label texts dealt to part rows by key (NULL included), so every rule is exercised at scale.
FIBERS = ["Hooked-end steel", " Twisted ", "straight steel", "Steel Fibre 13mm", "PE", "polyethylene 12", "PVA", "glass",
          "Carbon tow", "pp", "cellulose x", "Wollastonite", "medium length", "basalt chopped", None]
CURINGS = ["Autoclave 10h", "steam 90C", "Hot Water bath", "oven dried", "moist room", "open air", "Standard", "normal cure",
           "stnadrad curing", "sealed bag", "water tank", "", None]
CEMENTS = ["High sulfate HS", "Type III", "white OPC", "CEM II/A", "blast furnace", "Pozzolanic", "OPC + GGBS", "53 grade",
           "P.O 52.5R", "P.I 42,5", "ordinary portland", "unknown_type", "not_applicable", "type i/ii", "", None]
PLASTICIZERS = ["VMA agent", "naphthalene based", "acrylic polymer", "PCE 40%", "polycarboxylic ether", "Polycarboxylate",
                "high range water reducer", "liquid", "unknown_type", None]
LABELS = ["PCE-based", "snf", "Melamine", "lignosulphonate", "Steel_hooked", "PP", "uhmwpe (12mm)", "polyvinyl alcohol", "carbon",
          "E-glass", "basalt", "CEM II/B", "white cement", "Calcium  Aluminate", "sulphoaluminate", "Class F", "c", "GGB FS", "blast furnace",
          "quartz [fine]", "silica", "river sand", "CaCO3", "rice husk", "metakaolin", "none", "not reported", "some, odd;label", " ", None]


def dealt(spark, sf, values, name="raw"):
    d = table(spark, sf, "part")
    options = F.array(*[F.lit(v).cast("string") for v in values])
    return d.select("p_partkey", "p_name", "p_brand", "p_type", "p_size", options[(F.col("p_partkey") % len(values)).cast("int")].alias(name))


def dealt_sql(values, name="raw"):
    items = ", ".join("NULL" if v is None else f"'{v}'" for v in values)
    return f"(SELECT p_partkey, p_name, p_brand, p_type, p_size, ([{items}])[CAST(p_partkey % {len(values)} AS INTEGER) + 1] AS {name} FROM part) p"


def sql_tests(text, tests):
    out = []
    for kind, words in tests:
        if kind == "is":
            out.append(f"{text} IN ({', '.join(repr(w) for w in words)})")
        elif kind == "token":
            out += [f"list_contains(string_split({text}, ' '), '{w}')" for w in words]
        elif kind == "compact":
            out += [f"contains(replace({text}, ' ', ''), '{w}')" for w in words]
        elif kind == "has_all":
            out.append("(" + " AND ".join(f"contains({text}, '{w}')" for w in words) + ")")
        elif kind == "has":
            out += [f"contains({text}, '{w}')" for w in words]
        else:
            out += [f"regexp_matches({text}, '{w}')" for w in words]
    return " OR ".join(out)


def sql_case(text, rules, otherwise):
    return "CASE " + " ".join(f"WHEN {sql_tests(text, tests)} THEN '{label}'" for label, tests in rules) + f" ELSE {otherwise} END"


def initcap_sql(text):
    return f"array_to_string(list_transform(string_split(lower(trim({text})), ' '), lambda w: upper(w[1:1]) || w[2:]), ' ')"


BLANKS = ", ".join(f"'{m}'" for m in T.BLANK_MARKERS)


@query("blank_markers_s1", LINES + f"SELECT row_id, CASE WHEN trim(status) NOT IN ({BLANKS}) THEN trim(status) END AS status FROM lines")
def _(spark, sf):
    return T.normalize_blanks(lines(spark, sf).select("row_id", "status"), ["status"])


@query("lower_strip_s2", f"SELECT p_partkey, lower(trim(raw)) AS raw, lower(trim(p_name)) AS p_name FROM {dealt_sql(FIBERS)}")
def _(spark, sf):
    return T.lower_strip(dealt(spark, sf, FIBERS).select("p_partkey", "raw", "p_name"), ["raw", "p_name"])


MIXED = """(SELECT row_id, CASE WHEN l_orderkey % 13 = 0 THEN '5d' WHEN l_orderkey % 13 = 1 THEN ' 12.50 ' WHEN l_orderkey % 13 = 2 THEN 'abc'
 WHEN l_orderkey % 13 = 3 THEN '1e3' WHEN l_orderkey % 13 = 4 THEN '-7' WHEN l_orderkey % 13 = 5 THEN NULL
 WHEN l_orderkey % 13 = 6 THEN '60 - 65' WHEN l_orderkey % 13 = 7 THEN '85–96' WHEN l_orderkey % 13 = 8 THEN '1.2 MPa for 4h'
 ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END AS mixed, CAST(l_linenumber AS VARCHAR) AS clean FROM lines)"""


def mixed(spark, sf):
    d = lines(spark, sf)
    k = F.col("l_orderkey") % 13
    texts = {0: "5d", 1: " 12.50 ", 2: "abc", 3: "1e3", 4: "-7", 6: "60 - 65", 7: "85–96", 8: "1.2 MPa for 4h"}
    chain = F.when(k == 5, F.lit(None).cast("string"))
    for i, v in texts.items():
        chain = chain.when(k == i, F.lit(v))
    return d.select("row_id", chain.otherwise(F.col("l_quantity").cast("int").cast("string")).alias("mixed"),
                    F.col("l_linenumber").cast("string").alias("clean"))


NUM = T.NUMERIC_TEXT
NUM_SQL = f"CASE WHEN regexp_matches(mixed, '{NUM}') THEN try_cast(trim(mixed) AS DOUBLE) END"


@query("numeric_coercion_s3", LINES + f"SELECT row_id, {NUM_SQL} AS value FROM {MIXED}")
def _(spark, sf):
    return mixed(spark, sf).select("row_id", T.to_number(F.col("mixed")).alias("value"))


@query("coercion_report_s4", LINES + f"""SELECT 'mixed' AS "column", count(*) FILTER (mixed IS NULL) AS missing_before_numeric_coercion,
 count(*) FILTER (({NUM_SQL}) IS NULL) AS missing_after_numeric_coercion,
 count(*) FILTER (({NUM_SQL}) IS NULL) - count(*) FILTER (mixed IS NULL) AS new_missing_from_numeric_coercion FROM {MIXED}
 UNION ALL SELECT 'clean', 0, 0, 0""")
def _(spark, sf):
    return C.coercion_report(mixed(spark, sf), ["mixed", "clean"])


@query("schema_repair_s5", LINES + f"SELECT row_id, mixed, CAST(clean AS DOUBLE) AS clean FROM {MIXED}")
def _(spark, sf):
    return C.repair_types(mixed(spark, sf), ["mixed", "clean"])


@query("first_number_s6", LINES + f"SELECT row_id, try_cast(nullif(regexp_extract(mixed, '(\\d+\\.?\\d*)', 1), '') AS DOUBLE) AS value FROM {MIXED}")
def _(spark, sf):
    return mixed(spark, sf).select("row_id", T.first_number(F.col("mixed")).alias("value"))


RANGE_SQL = "'^\\s*([+-]?\\d+(?:\\.\\d+)?)\\s*[-–]\\s*([+-]?\\d+(?:\\.\\d+)?)\\s*$'"


@query("range_midpoint_s7", LINES + f"""SELECT row_id, CASE WHEN regexp_matches(mixed, {RANGE_SQL})
 THEN CAST((CAST(regexp_extract(mixed, {RANGE_SQL}, 1) AS DOUBLE) + CAST(regexp_extract(mixed, {RANGE_SQL}, 2) AS DOUBLE)) / 2 AS VARCHAR)
 ELSE mixed END AS value FROM {MIXED}""")
def _(spark, sf):
    return mixed(spark, sf).select("row_id", T.range_midpoint(F.col("mixed")).alias("value"))


@query("range_cell_report_s7", LINES + f"""SELECT count(*) FILTER (regexp_matches(mixed, {RANGE_SQL})) AS range_cells,
 array_to_string(list_sort(list(DISTINCT mixed) FILTER (regexp_matches(mixed, {RANGE_SQL})))[1:3], '; ') AS examples FROM {MIXED}""")
def _(spark, sf):
    # the three smallest examples: a bounded top-k per column instead of a collected set
    cells = mixed(spark, sf).where(T.is_range(F.col("mixed"))).groupBy("mixed").agg(F.count(F.lit(1)).alias("c"))
    examples = cells.orderBy("mixed").limit(3).agg(F.array_join(F.array_sort(F.collect_list("mixed")), "; ").alias("examples"))
    return cells.agg(F.sum("c").alias("range_cells")).crossJoin(F.broadcast(examples))


@query("class_code_s8", f"""SELECT p_partkey, CASE WHEN right(trim(p_brand || (['F', 'C ', 'x'])[CAST(p_partkey % 3 AS INTEGER) + 1]), 1) IN ('F', 'C')
 THEN 'class ' || right(trim(p_brand || (['F', 'C ', 'x'])[CAST(p_partkey % 3 AS INTEGER) + 1]), 1)
 ELSE right(trim(p_brand || (['F', 'C ', 'x'])[CAST(p_partkey % 3 AS INTEGER) + 1]), 1) END AS class_code FROM part""")
def _(spark, sf):
    suffix = F.array(F.lit("F"), F.lit("C "), F.lit("x"))[(F.col("p_partkey") % 3).cast("int")]
    return table(spark, sf, "part").select("p_partkey", T.class_code(F.concat("p_brand", suffix)).alias("class_code"))


@query("title_case_s9", f"SELECT p_partkey, {initcap_sql('p_name')} AS name FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.title_case(F.col("p_name")).alias("name"))


@query("fiber_classifier_s10", f"SELECT p_partkey, CASE WHEN raw IS NOT NULL THEN {sql_case('lower(trim(raw))', R.FIBER_RULES, initcap_sql('raw'))} END AS label FROM {dealt_sql(FIBERS)}")
def _(spark, sf):
    return R.classify(dealt(spark, sf, FIBERS), "raw", R.fiber_type, "label").select("p_partkey", "label")


@query("curing_classifier_s11", f"""SELECT p_partkey, CASE WHEN label = 'Stnadrad Curing' THEN 'Standard Curing' WHEN label = 'Curing  At 90 Oc' THEN 'Heat Curing' ELSE label END AS label
 FROM (SELECT p_partkey, CASE WHEN raw IS NOT NULL THEN {sql_case('lower(trim(raw))', R.CURING_RULES, initcap_sql('raw'))} END AS label FROM {dealt_sql(CURINGS)})""")
def _(spark, sf):
    return R.classify(dealt(spark, sf, CURINGS), "raw", R.curing_method, "label").select("p_partkey", "label")


def pattern_sql(rules, default):
    return f"CASE WHEN raw IS NULL OR raw IN ('unknown_type', 'not_applicable') THEN raw ELSE {sql_case('lower(raw)', rules, repr(default))} END"


@query("cement_patterns_s12", f"SELECT p_partkey, {pattern_sql(R.CEMENT_RULES, 'OPC_unknown')} AS label FROM {dealt_sql(CEMENTS)}")
def _(spark, sf):
    return R.classify(dealt(spark, sf, CEMENTS), "raw", R.cement_label, "label").select("p_partkey", "label")


@query("plasticizer_patterns_s12", f"SELECT p_partkey, {pattern_sql(R.SUPERPLASTICIZER_RULES, 'Unspecified')} AS label FROM {dealt_sql(PLASTICIZERS)}")
def _(spark, sf):
    return R.classify(dealt(spark, sf, PLASTICIZERS), "raw", R.superplasticizer_label, "label").select("p_partkey", "label")


GRADE = "CASE WHEN p_size % 5 = 0 THEN 52.5::DOUBLE WHEN p_size % 5 = 1 THEN 42.5::DOUBLE WHEN p_size % 5 = 2 THEN 53::DOUBLE WHEN p_size % 5 = 3 THEN 32.5::DOUBLE END"


@query("cement_resolver_s13", f"""SELECT p_partkey, CASE WHEN label IN ('HS_cement','OPC_III','CEM_II','white_cement','pozzolan_cement','OPC_I_GGBS','BFS_cement') THEN label
 WHEN grade = 52.5 THEN 'OPC_52.5' WHEN grade = 42.5 THEN 'OPC_42.5' WHEN grade = 53 THEN 'OPC_53'
 WHEN label IN ('OPC_52.5','OPC_42.5','OPC_53') THEN label WHEN label = 'OPC_unknown' THEN 'OPC_I' ELSE 'Unknown' END AS label
 FROM (SELECT p_partkey, {pattern_sql(R.CEMENT_RULES, 'OPC_unknown')} AS label, {GRADE} AS grade FROM {dealt_sql(CEMENTS)})""")
def _(spark, sf):
    grade = F.expr("CASE WHEN p_size % 5 = 0 THEN 52.5D WHEN p_size % 5 = 1 THEN 42.5D WHEN p_size % 5 = 2 THEN 53D WHEN p_size % 5 = 3 THEN 32.5D END")
    d = dealt(spark, sf, CEMENTS).select("p_partkey", R.cement_label(F.col("raw")).alias("label"), grade.alias("grade"))
    return d.select("p_partkey", R.resolve_cement(F.col("label"), F.col("grade")).alias("label"))


@query("cement_ladder_s14", "SELECT p_partkey, " + sql_case("lower(trim(coalesce(raw, 'nan')))", R.CEMENT_LADDER, "'Other'") + f" AS label FROM {dealt_sql(CEMENTS)}")
def _(spark, sf):
    return R.classify(dealt(spark, sf, CEMENTS), "raw", R.cement_ladder, "label").select("p_partkey", "label")


NORMAL_SQL = "trim(regexp_replace(translate(lower(trim(raw)), '_-/\\|,;()[]', '           '), '\\s+', ' ', 'g'))"


@query("domain_groups_s15", f"""SELECT p_partkey, CASE WHEN t IS NULL THEN 'missing_reported_gap' ELSE {sql_case('t', R.DOMAIN_RULES, "replace(t, ' ', '_')")} END AS label
 FROM (SELECT p_partkey, {NORMAL_SQL} AS t FROM {dealt_sql(LABELS)})""")
def _(spark, sf):
    return R.classify(dealt(spark, sf, LABELS), "raw", R.domain_group, "label").select("p_partkey", "label")


PAIRS = [("quantity", "amount", "kind"), ("discount", "discount", "status"), ("absent", "no_amount", "no_type")]
RECODED = """, b AS (SELECT row_id, amount, kind, discount, CASE WHEN trim(status) <> 'N/A' THEN trim(status) END AS status FROM lines),
 rc AS (SELECT row_id,
 CASE WHEN (amount IS NULL OR amount = 0) AND kind IS NULL THEN 0 ELSE amount END AS amount,
 CASE WHEN amount > 0 AND kind IS NULL THEN 'unknown_type' WHEN (amount IS NULL OR amount = 0) AND kind IS NULL THEN 'not_applicable' ELSE kind END AS kind,
 CASE WHEN (discount IS NULL OR discount = 0) AND status IS NULL THEN 0 ELSE discount END AS discount,
 CASE WHEN discount > 0 AND status IS NULL THEN 'unknown_type' WHEN (discount IS NULL OR discount = 0) AND status IS NULL THEN 'not_applicable' ELSE status END AS status FROM b)
"""


def blanked(spark, sf):
    return T.normalize_blanks(lines(spark, sf).select("row_id", "amount", "kind", "discount", "status"), ["kind", "status"])


@query("semantic_recode_s16", LINES + RECODED + "SELECT * FROM rc")
def _(spark, sf):
    return K.recode_pairs(blanked(spark, sf), PAIRS)


def summary_sql(pair, amount, kind):
    return f"""SELECT '{pair}' AS pair, '{amount}' AS amount_col, '{kind}' AS type_col, true AS applied, 'semantic_rules_applied' AS reason,
 count(*) FILTER (b.{amount} IS NULL) AS amount_missing_before, count(*) FILTER (b.{kind} IS NULL) AS type_missing_before,
 count(*) FILTER (b.{amount} IS NULL AND b.{kind} IS NULL) AS both_missing_before,
 count(*) FILTER (b.{amount} > 0 AND b.{kind} IS NULL) AS amount_positive_type_missing_to_unknown_type,
 count(*) FILTER ((b.{amount} IS NULL OR b.{amount} = 0) AND b.{kind} IS NULL) AS amount_zero_or_missing_type_missing_to_not_applicable,
 count(*) FILTER (b.{amount} IS NULL AND b.{kind} IS NOT NULL) AS type_present_amount_missing_left_missing,
 count(*) FILTER (rc.{amount} IS NULL) AS amount_missing_after, count(*) FILTER (rc.{kind} IS NULL) AS type_missing_after,
 count(*) FILTER (rc.{amount} = 0) AS amount_zero_after, count(*) FILTER (rc.{kind} = 'unknown_type') AS unknown_type_after,
 count(*) FILTER (rc.{kind} = 'not_applicable') AS not_applicable_after FROM b JOIN rc USING (row_id)"""


@query("recode_summary_a6", LINES + RECODED + summary_sql(*PAIRS[0]) + " UNION ALL " + summary_sql(*PAIRS[1]) + """
 UNION ALL SELECT 'absent', 'no_amount', 'no_type', false, 'amount_or_type_column_not_in_policy',
 NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL""")
def _(spark, sf):
    return K.recode_summary(blanked(spark, sf), PAIRS)


@query("dependent_recode_s17", LINES + """SELECT row_id, coalesce(amount, 0) AS amount,
 CASE WHEN amount IS NULL OR amount = 0 THEN 'not_applicable' WHEN kind IS NULL THEN 'unknown_type' ELSE kind END AS kind,
 CASE WHEN amount IS NULL OR amount = 0 THEN 0 ELSE discount END AS discount,
 CASE WHEN amount IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS quantity_amount_is_missing FROM lines""")
def _(spark, sf):
    d = lines(spark, sf).select("row_id", "amount", "kind", "discount")
    return K.recode_with_dependents(d, "quantity", "amount", "kind", ["discount"])


@query("conditional_impute_s18", SPLIT_LINES + """, tr AS (SELECT * FROM sl WHERE split = 'train'),
 gm AS (SELECT kind, avg(amount) AS a, avg(discount) AS d FROM tr WHERE kind IS NOT NULL GROUP BY kind),
 am AS (SELECT avg(amount) AS a, avg(discount) AS d FROM tr)
 SELECT row_id, label AS kind, round(coalesce(l.amount, gm.a, am.a), 6) AS amount, round(coalesce(l.discount, gm.d, am.d), 6) AS discount
 FROM (SELECT *, coalesce(kind, CASE WHEN amount >= 0 OR discount >= 0 THEN 'unknown_type' ELSE 'not_applicable' END) AS label FROM lines) l
 LEFT JOIN gm ON gm.kind = l.label CROSS JOIN am""")
def _(spark, sf):
    d = random_split(lines(spark, sf).select("row_id", "kind", "amount", "discount"), "row_id", FRACTIONS, SEED)
    return rounded(K.conditional_group_impute(d, d.where("split = 'train'"), "kind", ["amount", "discount"]).drop("split"))


@query("usage_group_s19", LINES + """SELECT row_id, CASE WHEN amount IS NOT NULL AND discount IS NOT NULL AND amount + discount = 0 THEN 'no_fiber_reported'
 WHEN amount > 0 OR discount > 0 THEN 'fiber_used' ELSE 'fiber_amount_unknown' END AS usage_group FROM lines""")
def _(spark, sf):
    return lines(spark, sf).select("row_id", R.usage_group([F.col("amount"), F.col("discount")]).alias("usage_group"))


@query("curing_regime_s20", f"SELECT p_partkey, {sql_case('t', R.CURING_REGIME_RULES[::-1], repr('other'))} AS regime FROM (SELECT p_partkey, lower(trim(coalesce(raw, ''))) AS t FROM {dealt_sql(CURINGS)})")
def _(spark, sf):
    return R.classify(dealt(spark, sf, CURINGS), "raw", R.curing_regime, "regime").select("p_partkey", "regime")


@query("temperature_regime_s20", LINES + "SELECT row_id, CASE WHEN amount <= 30 THEN 'normal_temperature' WHEN amount > 30 THEN 'elevated_temperature' ELSE 'unknown_temperature' END AS regime FROM lines")
def _(spark, sf):
    return lines(spark, sf).select("row_id", R.temperature_regime(F.col("amount")).alias("regime"))


@query("safe_ratio_s21", LINES + "SELECT row_id, CASE WHEN abs(amount) > 1e-9 THEN l_extendedprice / amount END AS safe, l_discount / (l_tax + 1e-8::DOUBLE) AS shifted FROM lines")
def _(spark, sf):
    return lines(spark, sf).select(
        "row_id", X.safe_ratio(F.col("l_extendedprice"), F.col("amount")).alias("safe"),
        X.epsilon_ratio(F.col("l_discount"), F.col("l_tax")).alias("shifted"))


@query("log_features_s22", LINES + "SELECT row_id, round(ln(1 + l_quantity), 9) AS log_l_quantity, round(ln(1 + l_tax), 9) AS log_l_tax FROM lines")
def _(spark, sf):
    return rounded(X.add_logs(lines(spark, sf).select("row_id", "l_quantity", "l_tax"), ["l_quantity", "l_tax"]).drop("l_quantity", "l_tax"), 9)


REPRESENT = dict(parts=["l_quantity", "l_discount", "l_tax"], water="price_k", admixture="l_discount", age="l_linenumber")
REP_SQL = LINES + """, f AS (SELECT row_id, l_quantity, l_discount, l_tax, l_linenumber, l_extendedprice / 1000 AS price_k, l_quantity + l_discount + l_tax AS tb FROM lines),
 g AS (SELECT *, price_k / (tb + 1e-8::DOUBLE) AS wb, ln(1 + l_linenumber) AS la FROM f)
 SELECT row_id, round(tb, 6) AS total_binder, round(price_k / (l_quantity + 1e-8::DOUBLE), 6) AS water_to_main, round(wb, 6) AS water_to_binder,
 round(l_discount / (tb + 1e-8::DOUBLE), 9) AS admixture_to_binder, round(l_tax / (tb + 1e-8::DOUBLE), 9) AS l_tax_to_binder"""


@query("interaction_features_s23", REP_SQL + """, round(tb * la, 6) AS binder_age, round(wb * la, 6) AS water_binder_age, round(l_quantity * la, 6) AS main_age,
 round(l_discount * la, 9) AS admixture_age, l_quantity * price_k AS main_water, tb * price_k AS binder_water FROM g""")
def _(spark, sf):
    d = lines(spark, sf).select("row_id", "l_quantity", "l_discount", "l_tax", "l_linenumber", (F.col("l_extendedprice") / 1000).alias("price_k"))
    out = X.represent(d, "interactions", **REPRESENT)
    keep = ["row_id", "total_binder", "water_to_main", "water_to_binder", "admixture_to_binder", "l_tax_to_binder", "binder_age",
            "water_binder_age", "main_age", "admixture_age", "main_water", "binder_water"]
    exact = ["main_water", "binder_water"]  # one multiplication: equal to the bit in both engines
    digits = {"admixture_to_binder": 9, "l_tax_to_binder": 9, "admixture_age": 9}
    return out.select(*[F.col(c) if c in ("row_id", *exact) else r(c, digits.get(c, 6)).alias(c) for c in keep])


@query("representation_s24", REP_SQL + " FROM g")
def _(spark, sf):
    d = lines(spark, sf).select("row_id", "l_quantity", "l_discount", "l_tax", "l_linenumber", (F.col("l_extendedprice") / 1000).alias("price_k"))
    keep = ["row_id", "total_binder", "water_to_main", "water_to_binder", "admixture_to_binder", "l_tax_to_binder"]
    return rounded(X.represent(d, "ratios", **REPRESENT).select(*keep), 6, admixture_to_binder=9, l_tax_to_binder=9)


@query("row_sums_s25", LINES + """SELECT row_id, round(amount + discount + l_tax, 6) AS strict_total,
 CASE WHEN coalesce(amount, discount) IS NOT NULL THEN round(coalesce(amount, 0) + coalesce(discount, 0), 6) END AS lenient_total FROM lines""")
def _(spark, sf):
    c = [F.col(x) for x in ("amount", "discount", "l_tax")]
    return lines(spark, sf).select("row_id", r(X.strict_sum(c)).alias("strict_total"), r(X.lenient_sum(c[:2])).alias("lenient_total"))


@query("composite_ratios_s26", LINES + """, t AS (SELECT row_id, l_quantity, l_tax, l_extendedprice, l_linenumber, amount + l_quantity AS tb, l_quantity AS scm, discount + l_discount AS tf FROM lines)
 SELECT row_id, round(tb, 6) AS total_binder, round(scm, 6) AS total_scm, round(tf, 6) AS total_fiber_amount,
 CASE WHEN abs(tb) > 1e-9 THEN l_extendedprice / tb END AS water_binder_ratio, round(CASE WHEN abs(tb) > 1e-9 THEN scm / tb END, 9) AS scm_binder_ratio,
 round(CASE WHEN abs(tb) > 1e-9 THEN l_linenumber / tb END, 9) AS sand_binder_ratio, round(CASE WHEN abs(tb) > 1e-9 THEN l_tax / tb END, 9) AS superplasticizer_binder_ratio,
 round(CASE WHEN abs(tb) > 1e-9 THEN tf / tb END, 9) AS fiber_binder_ratio FROM t""")
def _(spark, sf):
    d = lines(spark, sf).select("row_id", "amount", "l_quantity", "discount", "l_discount", "l_tax", "l_extendedprice", "l_linenumber")
    out = X.composite_ratios(d, binder=["amount", "l_quantity"], fibers=["discount", "l_discount"], water="l_extendedprice", sand="l_linenumber", admixture="l_tax")
    digits = {"total_binder": 6, "total_scm": 6, "total_fiber_amount": 6}
    return out.drop("l_tax", "l_extendedprice", "l_linenumber").select(*[
        F.col(c) if c in ("row_id", "water_binder_ratio") else r(c, digits.get(c, 9)).alias(c)
        for c in out.columns if c not in ("l_tax", "l_extendedprice", "l_linenumber")])


@query("right_closed_bins_s27", """SELECT o_orderkey, CASE WHEN v <= 120 THEN '<=120' WHEN v <= 150 THEN '120-150' WHEN v <= 180 THEN '150-180' WHEN v > 180 THEN '>180' END AS bin
 FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN (ARRAY[120, 150, 180])[CAST(o_orderkey % 3 AS INTEGER) + 1]::DOUBLE ELSE o_totalprice / 1000 END AS v FROM orders)""")
def _(spark, sf):
    v = F.expr("CASE WHEN o_orderkey % 10 = 0 THEN CAST(array(120, 150, 180)[CAST(o_orderkey % 3 AS INT)] AS DOUBLE) ELSE o_totalprice / 1000 END")
    return table(spark, sf, "orders").select("o_orderkey", X.right_closed_bin(v).alias("bin"))


@query("constant_fill_s28", LINES + "SELECT row_id, coalesce(amount, 0) AS amount, coalesce(kind, 'None') AS kind, coalesce(discount, 0) AS discount FROM lines")
def _(spark, sf):
    return T.fill_constants(lines(spark, sf).select("row_id", "amount", "kind", "discount"), 0.0, "None")
