"""Mixing sources to target weights by Efraimidis-Spirakis sampling. DataFrame functions throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from tabcal.llm.common import others, sized, stored, table, unused

WEIGHTS, TOTAL_SHARE, MAX_EPOCHS, SEED = (3, 1, 2), 1.5, 2, 42
WORD = r"[^\x20\x09-\x0D]+"
LEAST_QUALITY = 0.05
#: Rows of one source in one bin of the key; bins grow with the rows.
BIN_ROWS, LEAST_BINS = 65_536, 1024


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def letter_share(text: Column) -> Column:
    """Quality weight of a text: the share of its code points that are letters, at least LEAST_QUALITY."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    return F.coalesce(F.greatest(F.lit(LEAST_QUALITY), letters / F.nullif(F.length(text), F.lit(0))), F.lit(LEAST_QUALITY))


def _digest_number(ident: Column, seed: int, start: int) -> Column:
    text = F.concat(F.coalesce(ident.cast("string"), F.lit("")), F.lit(f"|{seed}"))
    return F.conv(F.substring(F.md5(text.cast("binary")), start, 13), 16, 10).cast("long")


def sampling_key(ident: Column, weight: Column, seed: int = SEED) -> Column:
    """Exponential key of rate `weight` from a hash of the id: the smallest keys are a weighted sample without replacement."""
    return -F.log((_digest_number(ident, seed, 1) + 0.5) / F.lit(float(1 << 52))) / weight


def source_targets(sizes: DataFrame, source_col: str, weights=WEIGHTS, total_share: float = TOTAL_SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source with its target, from one row per source with `source_size`.

    Sources in code-point order (null last) take the weights in turn. Sources are filled in the order of the share at which they
    reach max_epochs times their size: all before the first that stays below it are full, the rest share by weight.
    The windows run over one row per source.
    """
    cap, w, rest, weight_rest = "cap", "weight", "rest", "weight_rest"
    by_name = W.orderBy(F.col(source_col).asc_nulls_last())
    cycle = F.array(*[F.lit(x) for x in weights])
    ranked = sizes.withColumn("_rank", F.row_number().over(by_name)).withColumns({
        w: F.get(cycle, F.pmod(F.col("_rank") - 1, F.lit(len(weights)))).cast("double"),
        cap: (F.col("source_size") * max_epochs).cast("double"),
    })
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = W.orderBy(F.col(cap) / F.col(w), "_rank").rowsBetween(W.unboundedPreceding, -1)
    filled = ranked.withColumns({
        rest: F.sum("source_size").over(everything) * F.lit(total_share) - F.coalesce(F.sum(cap).over(before), F.lit(0.0)),
        weight_rest: F.sum(w).over(everything) - F.coalesce(F.sum(w).over(before), F.lit(0.0)),
    })
    fits = F.when(F.col(w) * F.col(rest) / F.col(weight_rest) <= F.col(cap), F.struct(-F.col(weight_rest), rest, weight_rest))
    level = F.min(fits).over(everything)
    share = F.col(w) * level[rest] / level[weight_rest]
    return filled.withColumn("target", F.least(F.col(cap), share)).select(source_col, "source_size", "target")


def mix_sources(
    docs: DataFrame, size: Column, weight: Column, id_col: str = "doc_id", source_col: str = "source", weights=WEIGHTS,
    total_share: float = TOTAL_SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED,
    size_col: str = "size", copies_col: str = "copies", source_size_col: str = "source_size", target_col: str = "target",
) -> DataFrame:
    """docs with their size, their source's size and target, and how often the mix takes each row.

    A source's whole epochs come first; the rest of its target goes to rows in the order of their sampling key, as long as
    more than half of a row fits. Rows that share an id and weight share a key and are taken together. Null source is a source of its own, null id the
    empty id, null or negative size 0. Deterministic in (id, weight, seed). Empty table: empty result.

    Keys are counted in bins per source; only the bin in which a source's target ends is sorted. The result is one
    row per source, so the decision on a row needs no shuffle.
    """
    n, key, tie, bin_, s, first, tk, tt, full, whole, aim = unused(
        docs, "_n", "_key", "_tie", "_bin", "_source", "_first", "_tk", "_tt", "_full", "_whole", "_aim")
    rows = docs.withColumns({n: F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)).cast("long"), key: sampling_key(F.col(id_col), weight, seed), tie: _digest_number(F.col(id_col), seed, 14)})
    slim = stored(rows.select(F.col(source_col).alias(s), n, key, tie))
    bins = max(LEAST_BINS, -(-slim.count() // BIN_ROWS))
    bin_of = F.least(F.floor(F.col(key) / (F.col(key) + 1) * bins), F.lit(bins - 1))
    binned = slim.withColumn(bin_, bin_of)
    counts = stored(binned.groupBy(s, bin_).agg(F.sum(n).alias("bin_size")))
    targets = source_targets(counts.groupBy(s).agg(F.sum("bin_size").alias("source_size")), s, weights, total_share, max_epochs)
    epochs = F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0))
    targets = stored(targets.withColumn(full, epochs).withColumn("rest", F.col("target") - F.col(full) * F.col("source_size")))
    by_bin = W.partitionBy(s).orderBy(bin_).rowsBetween(W.unboundedPreceding, -1)
    ends = counts.withColumn("before", F.coalesce(F.sum("bin_size").over(by_bin), F.lit(0))).alias("c").join(
        targets.alias("t"), F.col(f"c.{s}").eqNullSafe(F.col(f"t.{s}"))).where("before < rest").groupBy(f"c.{s}").agg(
        F.max(F.struct(bin_, "before", "rest")).alias("end")).select(s, f"end.{bin_}", "end.before", "end.rest")
    ends = sized(ends)
    inside = binned.alias("b").join(ends.alias("e"), F.col(f"b.{s}").eqNullSafe(F.col(f"e.{s}")) & (F.col(f"b.{bin_}") == F.col(f"e.{bin_}")))
    groups = inside.groupBy(f"b.{s}", key, tie).agg(F.sum(n).alias("g"), F.first("before").alias("before"), F.first("rest").alias("rest"))
    along = W.partitionBy(s).orderBy(key, tie).rowsBetween(W.unboundedPreceding, 0)
    last = groups.withColumn("middle", F.col("before") + F.sum("g").over(along) - F.col("g") / 2).where("middle <= rest").groupBy(s).agg(
        F.max(F.struct(key, tie)).alias("last"))
    plan = targets.alias("t").join(ends.alias("e"), F.col(f"t.{s}").eqNullSafe(F.col(f"e.{s}")), "left").join(
        last.alias("l"), F.col(f"t.{s}").eqNullSafe(F.col(f"l.{s}")), "left").select(
        F.col(f"t.{s}").alias(s), F.col("source_size").alias(whole), F.col("target").alias(aim), full,
        F.col(bin_).alias(first), F.col(f"last.{key}").alias(tk), F.col(f"last.{tie}").alias(tt))
    chosen = (bin_of < F.col(first)) | (bin_of == F.col(first)) & (
        (F.col(key) < F.col(tk)) | (F.col(key) == F.col(tk)) & (F.col(tie) <= F.col(tt)))
    copies = F.col(full) + F.when(chosen, 1).otherwise(0)
    return rows.join(sized(plan), F.col(f"`{source_col}`").eqNullSafe(F.col(s)), "left").select(
        *[F.col(f"`{c}`") for c in others(docs, size_col, copies_col, source_size_col, target_col)], F.col(n).alias(size_col), F.col(whole).alias(source_size_col),
        F.col(aim).alias(target_col), copies.cast("int").alias(copies_col))


def op3_source_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sizes = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("words"), letter_share(F.col("text")).alias("quality")))
    mixed = mix_sources(sizes, F.col("words"), F.col("quality"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


SQL = r"""WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
  coalesce(greatest(0.05::DOUBLE, length(regexp_replace(text, '[^\p{L}]+', '', 'g'))::DOUBLE / nullif(length(text), 0)), 0.05::DOUBLE) AS w,
  md5(coalesce(doc_id::VARCHAR, '') || '|42') AS h FROM documents),
k AS (SELECT *, -ln((('0x' || substr(h, 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) / w AS key, ('0x' || substr(h, 14, 13))::BIGINT AS tie FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rnk FROM s),
w AS (SELECT *, ([3, 1, 2])[1 + (rnk - 1) % 3]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM r),
f AS (SELECT *, total - coalesce(sum(cap) OVER b, 0) AS rest, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS weight_rest FROM w
  WINDOW b AS (ORDER BY cap / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT arg_max(rest, weight_rest) AS rest, max(weight_rest) AS weight_rest FROM f WHERE weight * rest / weight_rest <= cap),
t AS (SELECT source, source_size, least(cap, weight * v.rest / v.weight_rest) AS target FROM f, v),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t),
g AS (SELECT k.*, e.source_size, e.target, e.epochs, sum(size) OVER (PARTITION BY k.source ORDER BY key, tie) - sum(size) OVER (PARTITION BY k.source, key, tie) / 2.0::DOUBLE AS middle
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (size * (epochs + CASE WHEN target - epochs * source_size > 0 AND middle <= target - epochs * source_size THEN 1 ELSE 0 END))::BIGINT AS taken FROM g"""

QUERIES = {"op3_source_mixing": (op3_source_mixing, SQL)}
