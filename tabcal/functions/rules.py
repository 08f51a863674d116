"""Ordered keyword and pattern rules compiled to one CASE expression each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

UNKNOWN_TYPE = "unknown_type"
NOT_APPLICABLE = "not_applicable"
MISSING_GAP = "missing_reported_gap"

# A rule is (label, tests); tests is a list of (kind, words) of which one must hold.
#   has      any word is a substring          has_all  every word is a substring
#   is       the text equals a word           token    a blank-separated token equals a word
#   compact  substring once blanks are removed  regex  the pattern is found

# ---- Fixed values: fiber type labels, first match wins --------------------------------
FIBER_RULES = [
    ("Hooked Steel Fiber", [("has", ["hooked"])]),
    ("Twisted Steel Fiber", [("has", ["twisted"])]),
    ("Straight Steel Fiber", [("has", ["straight"]), ("has_all", ["steel", "fiber"]), ("has_all", ["steel", "fibre"])]),
    ("PE Fiber", [("is", ["pe"]), ("has", ["polyethylene"])]),
    ("PVA Fiber", [("has", ["pva"])]),
    ("Glass Fiber", [("has", ["glass"])]),
    ("Carbon Fiber", [("has", ["carbon"])]),
    ("PP Fiber", [("is", ["pp"])]),
    ("Cellulose Fiber", [("has", ["cellulose"])]),
    ("Wollastonite Fiber", [("has", ["wollastonit"])]),
    ("Straight Steel Fiber", [("has", ["medium", "short", "long"])]),
]
# ---- Fixed values: curing method labels, first match wins -----------------------------
CURING_RULES = [
    ("Autoclave Curing", [("has", ["autoclave"])]),
    ("Steam Curing", [("has", ["steam"])]),
    ("Hot Water Curing", [("has", ["hot water", "warm water", "warm bath"])]),
    ("Heat Curing", [("has", ["heat", "hot", "oven"])]),
    ("Water Curing", [("has", ["water", "moist"])]),
    ("Air Curing", [("has", ["air"])]),
    ("Standard Curing", [("has", ["standard", "normal"])]),
]
CURING_TYPOS = {"Curing  At 90 Oc": "Heat Curing", "Stnadrad Curing": "Standard Curing"}
# ---- Fixed values: cement type patterns, first match wins -----------------------------
CEMENT_RULES = [
    ("HS_cement", [("regex", [r"high.?sulfate|type.?hs"])]),
    ("OPC_III", [("regex", [r"type.?iii|type.?3\b"])]),
    ("white_cement", [("regex", [r"white"])]),
    ("CEM_II", [("regex", [r"cem.?ii|cem2|cemii"])]),
    ("BFS_cement", [("regex", [r"blast.?furnace"])]),
    ("pozzolan_cement", [("regex", [r"pozzolan"])]),
    ("OPC_I_GGBS", [("regex", [r"ggbs"])]),
    ("OPC_53", [("regex", [r"53.?grade|grade.?53|\b53\b"])]),
    ("OPC_52.5", [("regex", [r"52[.,]?5"])]),
    ("OPC_42.5", [("regex", [r"42[.,]?5"])]),
]
# ---- Fixed values: superplasticizer patterns, first match wins ------------------------
SUPERPLASTICIZER_RULES = [
    ("VMA", [("regex", [r"vma|viscosity.modif"])]),
    ("SNF_SP", [("regex", [r"naphthalene|sulfonat"])]),
    ("Other_Polymer_SP", [("regex", [r"acrylic|acrylate|poly.acrylic.ester"])]),
    ("PCE_HRWRA", [("regex", [r"polycarboxylic\s+ether|polycarboxylic.based|pce|hyperplastic"])]),
    ("PCE_SP", [("regex", [r"polycarboxylate|polycarboxilate|carboxylate.based"])]),
    ("HRWRA", [("regex", [r"hrwra|hrwr|high.range.water|high.performance.water"])]),
]
# ---- Fixed values: contains-ladder for cement, first match wins -----------------------
CEMENT_LADDER = [
    ("OPCGrade_52_5", [("has", ["52.5"])]),
    ("OPCGrade_42_5", [("has", ["42.5", "42,5"])]),
    ("OPCGrade_53", [("has", ["53"])]),
    ("Type_HS", [("has", ["hs"])]),
    ("OPC_I_II", [("has", ["i/ii"])]),
    ("OPC_III", [("has", ["iii"])]),
    ("Unspecified", [("has", ["unspecified"]), ("is", ["nan", ""])]),
    ("Other", [("has", ["blast", "ggbs", "white", "ii"])]),
    ("OPC_I", [("has", ["portland", "ordinary", "28", "i", "opc", "1"])]),
]
# ---- Fixed values: domain grouping of normalised labels, first match wins -------------
DOMAIN_PUNCTUATION = "_-/\\|,;()[]"
DOMAIN_RULES = [
    (MISSING_GAP, [("is", ["", "missing reported gap"])]),
    (NOT_APPLICABLE, [("is", ["not applicable", "none", "no", "nil"])]),
    (UNKNOWN_TYPE, [("is", ["unknown type", "unknown", "not reported"])]),
    ("superplasticizer_polycarboxylate", [("has", ["polycarboxylate"]), ("token", ["pce"])]),
    ("superplasticizer_naphthalene", [("has", ["naphthalene"]), ("token", ["snf"])]),
    ("superplasticizer_melamine", [("has", ["melamine"]), ("token", ["smf"])]),
    ("superplasticizer_lignosulfonate", [("has", ["lignosulfonate", "lignosulphonate"])]),
    ("fiber_steel", [("has", ["steel"])]),
    ("fiber_polypropylene", [("has", ["polypropylene"]), ("token", ["pp"])]),
    ("fiber_polyethylene", [("has", ["polyethylene"]), ("token", ["pe", "hdpe", "uhmwpe"])]),
    ("fiber_pva", [("has", ["polyvinyl alcohol"]), ("token", ["pva"])]),
    ("fiber_carbon", [("has", ["carbon"])]),
    ("fiber_glass", [("has", ["glass"])]),
    ("fiber_basalt", [("has", ["basalt"])]),
    ("cement_portland", [("has", ["cem i", "portland"]), ("token", ["opc"])]),
    ("cement_blended", [("has", ["cem ii", "blended cement"])]),
    ("cement_white", [("has", ["white cement"])]),
    ("cement_calcium_aluminate", [("has", ["calcium aluminate"])]),
    ("cement_sulfoaluminate", [("has", ["sulfoaluminate", "sulphoaluminate"])]),
    ("fly_ash_class_f", [("is", ["f"]), ("has", ["class f"])]),
    ("fly_ash_class_c", [("is", ["c"]), ("has", ["class c"])]),
    ("slag_ggbfs", [("compact", ["ggbfs"]), ("has", ["ground granulated"])]),
    ("slag_blast_furnace", [("has", ["blast furnace", "slag"])]),
    ("sand_or_filler_quartz", [("has", ["quartz"])]),
    ("sand_or_filler_silica", [("has", ["silica"])]),
    ("sand_river", [("has", ["river"])]),
    ("filler_limestone", [("has", ["limestone", "calcium carbonate"]), ("compact", ["caco3"])]),
    ("scm_rice_husk_ash", [("has", ["rice husk"])]),
    ("scm_metakaolin", [("has", ["metakaolin"])]),
]
# ---- Fixed values: broad curing regime, LAST match wins -------------------------------
CURING_REGIME_RULES = [
    ("unknown_or_missing", [("is", [""])]),
    ("standard_or_normal", [("has", ["standard", "normal"])]),
    ("heat", [("has", ["heat", "hot"])]),
    ("steam", [("has", ["steam"])]),
    ("water", [("has", ["water"])]),
    ("autoclave", [("has", ["autoclave"])]),
]
# ---- Fixed values: cement labels that a grade column never overrides ------------------
UNGRADED_CEMENTS = (
    "HS_cement", "OPC_III", "CEM_II", "white_cement", "pozzolan_cement", "OPC_I_GGBS", "BFS_cement",
)
CEMENT_GRADES = {52.5: "OPC_52.5", 42.5: "OPC_42.5", 53.0: "OPC_53"}


def _holds(text: Column, kind: str, words: list[str]) -> Column:
    if kind == "is":
        return text.isin(*words)
    if kind == "token":
        return F.arrays_overlap(F.split(text, " "), F.array(*[F.lit(w) for w in words]))
    if kind == "compact":
        text, kind = F.replace(text, F.lit(" "), F.lit("")), "has"
    tests = [text.rlike(w) if kind == "regex" else text.contains(w) for w in words]
    return reduce((lambda a, b: a & b) if kind == "has_all" else (lambda a, b: a | b), tests)


def first_match(text: Column, rules: list, otherwise: Column) -> Column:
    """One CASE expression: the first rule with a passing test gives the label."""
    chain = F
    for label, tests in rules:
        condition = reduce(lambda a, b: a | b, [_holds(text, kind, words) for kind, words in tests])
        chain = chain.when(condition, F.lit(label))
    return chain.otherwise(otherwise)


def last_match(text: Column, rules: list, otherwise: Column) -> Column:
    return first_match(text, rules[::-1], otherwise)


def keep_null(c: Column, expression: Column) -> Column:
    return F.when(c.isNotNull(), expression)


def _lower_trim(c: Column) -> Column:
    return F.lower(F.trim(c))


def fiber_type(c: Column, text: Column | None = None) -> Column:
    text = _lower_trim(c) if text is None else text
    return keep_null(c, first_match(text, FIBER_RULES, F.initcap(text)))


def curing_method(c: Column, text: Column | None = None) -> Column:
    text = _lower_trim(c) if text is None else text
    label = first_match(text, CURING_RULES, F.initcap(text))
    for typo, right in CURING_TYPOS.items():
        label = F.when(label == typo, F.lit(right)).otherwise(label)
    return keep_null(c, label)


def _pattern_label(c: Column, text: Column | None, rules: list, default: str) -> Column:
    passes = c.isNull() | c.isin(UNKNOWN_TYPE, NOT_APPLICABLE)
    return F.when(passes, c).otherwise(first_match(F.lower(c) if text is None else text, rules, F.lit(default)))


def cement_label(c: Column, text: Column | None = None) -> Column:
    return _pattern_label(c, text, CEMENT_RULES, "OPC_unknown")


def superplasticizer_label(c: Column, text: Column | None = None) -> Column:
    return _pattern_label(c, text, SUPERPLASTICIZER_RULES, "Unspecified")


def resolve_cement(label: Column, grade: Column) -> Column:
    """Special label, then the grade column, then a graded label, then the defaults."""
    chain = F.when(label.isin(*UNGRADED_CEMENTS), label)
    for number, name in CEMENT_GRADES.items():
        chain = chain.when(grade == number, F.lit(name))
    return (
        chain.when(label.isin(*CEMENT_GRADES.values()), label)
        .when(label == "OPC_unknown", F.lit("OPC_I"))
        .otherwise(F.lit("Unknown"))
    )


def _ladder_text(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit("nan"))))


def cement_ladder(c: Column, text: Column | None = None) -> Column:
    return first_match(_ladder_text(c) if text is None else text, CEMENT_LADDER, F.lit("Other"))


def normalized_label(c: Column) -> Column:
    """Lower case, listed punctuation to blanks, blanks collapsed."""
    spaced = F.translate(F.lower(F.trim(c)), DOMAIN_PUNCTUATION, " " * len(DOMAIN_PUNCTUATION))
    return F.trim(F.regexp_replace(spaced, r"\s+", " "))


def domain_group(c: Column, text: Column | None = None) -> Column:
    """Domain label of a category value, or its snake_case text when no rule applies."""
    text = normalized_label(c) if text is None else text
    return F.when(c.isNull(), F.lit(MISSING_GAP)).otherwise(
        first_match(text, DOMAIN_RULES, F.replace(text, F.lit(" "), F.lit("_")))
    )


def _regime_text(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def curing_regime(c: Column, text: Column | None = None) -> Column:
    """Broad curing regime of a method text; the last matching rule wins."""
    return last_match(_regime_text(c) if text is None else text, CURING_REGIME_RULES, F.lit("other"))


_TEXT_OF = {
    fiber_type: _lower_trim, curing_method: _lower_trim, cement_label: F.lower, superplasticizer_label: F.lower,
    cement_ladder: _ladder_text, domain_group: normalized_label, curing_regime: _regime_text,
}


def classify(df: DataFrame, column: str, classifier, out: str) -> DataFrame:
    """Add a classifier's label; the normalised text is computed once per row, not once per rule."""
    prepared = df.withColumn("_text", _TEXT_OF[classifier](F.col(column)))
    return prepared.withColumn(out, classifier(F.col(column), F.col("_text"))).drop("_text")


def temperature_regime(c: Column) -> Column:
    """Fallback regime from a numeric temperature (cut at 30 degrees)."""
    return (
        F.when(c <= 30, F.lit("normal_temperature"))
        .when(c > 30, F.lit("elevated_temperature"))
        .otherwise(F.lit("unknown_temperature"))
    )


def usage_group(amounts: list[Column], used="fiber_used", unused="no_fiber_reported", unknown="fiber_amount_unknown"):
    """Used if any amount > 0; unused if all are known and sum to 0; unknown otherwise."""
    any_positive = reduce(lambda a, b: a | b, [F.coalesce(a > 0, F.lit(False)) for a in amounts])
    all_known = reduce(lambda a, b: a & b, [a.isNotNull() for a in amounts])
    total = reduce(lambda a, b: a + b, [F.coalesce(a, F.lit(0.0)) for a in amounts])
    return F.when(all_known & (total == 0), F.lit(unused)).when(any_positive, F.lit(used)).otherwise(F.lit(unknown))
