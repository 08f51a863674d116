"""Hard negatives by exact integer scores: several candidates' components packed into one wide integer and multiplied at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tabcal.llm.common import hash128, stored, table

POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these shares (in percent) of its positive's.
LEAST_PERCENT, MOST_PERCENT = 30, 90
#: Bytes of vectors, as 64-bit components, in a block; a tile is a block of anchors against a block of rows.
BLOCK_BYTES = 4 << 20
#: Bits of an integer that a double holds exactly.
EXACT_BITS = 53


def field_bits(dims: int, most_a: int, most_b: int) -> int:
    """Bits that hold a sum of `dims` products of numbers from 0 to most_a and from 0 to most_b."""
    return max(1, (dims * most_a * most_b).bit_length())


def packed_products(anchors, rows, bits: int = EXACT_BITS):
    """Exact inner products (anchors x rows) of integer matrices, as int64 or, where they may not fit, as Python integers.

    Components are biased to start at 0, so fields never borrow from each other. The components of `per` rows lie in fields of one
    integer, one multiplication by an anchor's component serves them all, and the sums of the fields are cut out and freed of
    the bias. Integers of up to 53 bits are carried by doubles, whose products and sums are exact below that; where not even one field
    fits, Python integers carry eight fields.
    """
    import numpy as np

    dims = rows.shape[1]
    if not len(anchors) or not len(rows):
        return np.zeros((len(anchors), len(rows)), dtype=np.int64)
    if not dims:
        return np.zeros((len(anchors), len(rows)), dtype=np.int64)
    low_a, low_r = int(anchors.min()), int(rows.min())
    most_a, most_r = int(anchors.max()) - low_a, int(rows.max()) - low_r
    size = field_bits(dims, most_a, most_r)
    wide = size > bits or max(abs(low_a), abs(low_r), most_a, most_r) >= 1 << (62 - dims.bit_length()) // 2
    per = 8 if wide else bits // size
    kind = object if wide else np.int64
    a, r = (anchors.astype(object), rows.astype(object)) if wide else (anchors.astype(np.int64), rows.astype(np.int64))
    whole = -(-len(r) // per) * per
    biased = np.zeros((whole, dims), dtype=kind)
    biased[:len(r)] = r - low_r
    packed = np.zeros((whole // per, dims), dtype=kind)
    for k in range(per):
        packed = packed + (biased[k::per] << (size * k))
    products = (a - low_a) @ packed.T if wide else ((a - low_a).astype(np.float64) @ packed.astype(np.float64).T).astype(np.int64)
    fields = np.zeros((len(a), whole), dtype=kind)
    mask = (1 << size) - 1
    for k in range(per):
        fields[:, k::per] = (products >> (size * k)) & mask
    # (a - A)(r - R) = a r - A sum(r) - R sum(a) + d A R
    return fields[:, :len(r)] + low_a * r.sum(axis=1)[None, :] + low_r * a.sum(axis=1)[:, None] - dims * low_a * low_r


def first_of(scores, allowed, most: int):
    """Places of the `most` highest allowed scores, the first place first among equals."""
    import numpy as np

    at = np.nonzero(allowed)[0]
    if len(at) > most:
        got = scores[at]
        at = at[got >= np.partition(got, len(got) - most)[len(got) - most]]
    return at[np.argsort(-scores[at], kind="stable")][:most]


def _whole(vectors):
    """floor(256 x) of all components: integers of 64 bits, or Python integers if some are larger."""
    import numpy as np

    levels = np.floor(256 * np.vstack(vectors.to_numpy()).astype(np.float64))
    if np.abs(levels).max(initial=0) < 2.0 ** 53:
        return levels.astype(np.int64)
    return np.array([[int(x) for x in row] for row in levels.tolist()], dtype=object)


def _as_long(score) -> int:
    return max(-(1 << 63), min((1 << 63) - 1, int(score)))


def _tile(pdf):
    """The anchors and the rows of a tile, rows in ascending order of id."""
    rows = pdf[~pdf["asks"]].sort_values(["id", "h1", "h2"])
    return pdf[pdf["asks"]], rows


def _positives(most: int):
    def best(pdf):
        import pandas as pd

        anchors, rows = _tile(pdf)
        out = []
        if len(anchors) and len(rows):
            scores = packed_products(_whole(anchors["v"]), _whole(rows["v"]))
            label, ident = rows["label"].to_numpy(), rows["id"].to_numpy()
            for i, a in enumerate(anchors.itertuples()):
                for j in first_of(scores[i], (label == a.label) & (ident != a.id), most):
                    out.append((a.h1, a.h2, a.id, int(ident[j]), _as_long(scores[i, j])))
        return pd.DataFrame(out, columns=["h1", "h2", "anchor_id", "positive_id", "positive_score"])

    return best


def _negatives(most: int, least_percent: int, most_percent: int):
    def best(pdf):
        import pandas as pd

        anchors, rows = _tile(pdf)
        out = []
        if len(anchors) and len(rows):
            scores = packed_products(_whole(anchors["v"]), _whole(rows["v"]))
            label, ident = rows["label"].to_numpy(), rows["id"].to_numpy()
            for i, a in enumerate(anchors.itertuples()):
                other, own = (label != a.label) & (ident != a.id), scores[i]
                for place, positive in enumerate(a.positive_scores):
                    # Whole numbers n with least * p <= 100 n <= most * p.
                    low, high = -(-least_percent * int(positive) // 100), most_percent * int(positive) // 100
                    for j in first_of(own, other & (own >= low) & (own <= high), most):
                        out.append((a.h1, a.h2, place, int(ident[j]), _as_long(own[j])))
        return pd.DataFrame(out, columns=["h1", "h2", "place", "negative_id", "negative_score"])

    return best


def mine_hard_negatives(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", asks: str = "pmod(vec_id, 100) = 0",
    positives: int = POSITIVES, negatives: int = NEGATIVES, least_percent: int = LEAST_PERCENT, most_percent: int = MOST_PERCENT,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor (a row for which `asks` holds) and each of
    its first `positives` other rows of its label, the first `negatives` rows of other labels whose score lies in least_percent to
    most_percent of the positive's.

    A component x counts floor(256 x); a score is the integer inner product with the anchor; higher scores come first, then smaller
    ids. Rows with a null id, label or vector, or with a null, NaN or infinite component, take no part, nor do pairs of vectors of different
    lengths. Rows equal in id, label and vector are one row; rows with the anchor's id are no partners of it. An anchor without
    positives, or a positive without negatives, gives no row; no rows: empty result. Scores beyond 64 bits are given as the nearest
    64-bit number. Other columns are not read.

    All anchors meet all rows, in tiles of two blocks of bounded bytes; a row's block follows the hash of its whole content, so neither
    a label nor an id makes a block large. Each vector goes to one tile per block of anchors, twice (for positives, then for negatives); a
    tile returns at most 5 rows per anchor or 10 per positive, and these are cut again by rank before they are shuffled.
    """
    number = F.transform(F.col(f"`{vector_col}`"), lambda x: x.cast("double"))
    h1, h2 = hash128("id", "label", "v")
    good = rows.select(F.expr(asks).alias("asks"), F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), number.alias("v")).where(
        F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(256 * x) < float("inf"))))
    slim = stored(good.select(
        F.coalesce("asks", F.lit(False)).alias("asks"), "id", "label", F.transform("v", lambda x: x + F.lit(0.0)).alias("v")).withColumns({"h1": h1, "h2": h2}).dropDuplicates(["h1", "h2"]))
    facts = slim.agg(
        F.sum(8 * F.size("v")).alias("all"), F.sum(F.when(F.col("asks"), 8 * F.size("v"))).alias("asking")).first()
    blocks, ask_blocks = (max(1, -(-(x or 0) // block_bytes)) for x in (facts["all"], facts["asking"]))
    wide = slim.withColumn("d", F.size("v"))
    to_ask, to_rows = F.pmod("h2", F.lit(ask_blocks)).cast("int"), F.pmod("h1", F.lit(blocks)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = wide.withColumn("asks", F.lit(False)).withColumn("c", to_rows).withColumn("a", each(ask_blocks))

    def tiles(anchors, *more):
        asking = anchors.withColumn("a", to_ask).withColumn("c", each(blocks))
        missing = [F.lit(None).cast(anchors.schema[m].dataType).alias(m) for m in more]
        columns = ["d", "a", "c", "asks", "id", "label", "h1", "h2", "v"]
        return asking.select(*columns, *more).unionByName(candidates.select(*columns, *missing)).groupBy("d", "a", "c")

    anchors = wide.where("asks")
    near = tiles(anchors).applyInPandas(_positives(positives), "h1 long, h2 long, anchor_id long, positive_id long, positive_score long")
    order = W.partitionBy("h1", "h2").orderBy(F.desc("positive_score"), "positive_id")
    chosen = stored(near.withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < positives))
    known = chosen.groupBy("h1", "h2").agg(F.sort_array(F.collect_list(F.struct("place", "positive_score"))).alias("p")).select(
        "h1", "h2", F.col("p.positive_score").alias("positive_scores"))
    far = tiles(anchors.join(known, ["h1", "h2"]), "positive_scores").applyInPandas(
        _negatives(negatives, least_percent, most_percent), "h1 long, h2 long, place int, negative_id long, negative_score long")
    ranks = W.partitionBy("h1", "h2", "place").orderBy(F.desc("negative_score"), "negative_id")
    mined = far.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= negatives)
    return mined.join(chosen, ["h1", "h2", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(rows.withColumn("label", moved))


SQL = """WITH v AS (SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding::DOUBLE[], lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.id % 100 = 0 AND a.id <> b.id AND len(a.q) = len(b.q)),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank,
  id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) <= 10"""

QUERIES = {"op12_hard_negatives": (op12_hard_negatives, SQL)}
