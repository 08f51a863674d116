"""Embedding near-dedup: exact cosine links by int8 tile products with error bounds per vector."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tabcal.llm.common import connected_components, hash128, join_by_class, others, stored, table

THRESHOLD = 0.95
#: Vectors in one block; a tile is a block against a block.
BLOCK_ROWS = 4_096
#: Added to every error bound for the rounding of double arithmetic.
SLACK = 1e-9


def quantise(unit):
    """Rows of unit length as int8 values times a scale per row, and the length of what is lost per row."""
    import numpy as np

    scale = np.abs(unit).max(axis=1) / 127
    levels = np.rint(unit / scale[:, None]).astype(np.int8)
    lost = np.sqrt(((unit - levels * scale[:, None]) ** 2).sum(axis=1))
    return levels, scale, lost


def tile_links(a, b, norm_a, norm_b, qa, qb, threshold: float, same: bool):
    """Pairs (i, j) of two blocks with cosine >= threshold in double precision, in slices of rows.

    With u = s q + e and |u| = 1: |u.v - s t (q.r)| <= |s q| |f| + |e| (f the loss of v). The product q.r is exact in float32,
    as |q.r| <= 127 * 127 * d < 2^24 for d <= 1040; longer vectors are summed in parts. Pairs whose upper bound stays
    below the threshold are done, those whose lower bound reaches it are links, only the rest is recomputed.
    """
    import numpy as np

    (la, sa, ea), (lb, sb, eb) = qa, qb
    fa, fb = la.astype(np.float32), lb.astype(np.float32)
    size_a = np.sqrt((fa.astype(np.float64) ** 2).sum(axis=1)) * sa
    for at in range(0, len(fa), 512):
        rows = slice(at, at + 512)
        dot = np.zeros((len(fa[rows]), len(fb)))
        for k in range(0, fa.shape[1], 1024):
            dot += fa[rows, k:k + 1024] @ fb[:, k:k + 1024].T
        near = dot * sa[rows, None] * sb[None, :]
        bound = size_a[rows, None] * eb[None, :] + ea[rows, None] + SLACK
        i, j = np.nonzero(near + bound >= threshold)
        if same:
            i, j = i[i + at < j], j[i + at < j]
        sure = near[i, j] - bound[i, j] >= threshold
        i += at
        for p in range(0, len(i), 65_536):
            part = slice(p, p + 65_536)
            ii, jj, ok = i[part], j[part], sure[part]
            ask = np.nonzero(~ok)[0]
            if len(ask):
                exact = np.einsum("nd,nd->n", a[ii[ask]], b[jj[ask]]) / (norm_a[ii[ask]] * norm_b[jj[ask]])
                ok = ok.copy()
                ok[ask] = exact >= threshold
            if ok.any():
                yield ii[ok], jj[ok]


class _Forest:
    """Pairs that connect what all the pairs given so far connect: at most n - 1 of them."""

    def __init__(self, n: int):
        import numpy as np

        self.parent, self.pairs = np.arange(n), []

    def add(self, x, y) -> None:
        import numpy as np

        while len(x):
            part = self.parent[x] != self.parent[y]
            x, y = x[part], y[part]
            parent = self.parent
            for p, q in zip(x[:2048].tolist(), y[:2048].tolist(), strict=True):
                a, b = p, q
                while parent[a] != a:
                    a = parent[a]
                while parent[b] != b:
                    b = parent[b]
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    self.pairs.append((p, q))
            while (parent[parent] != parent).any():
                parent = parent[parent]
            self.parent = np.asarray(parent)


def _tile(threshold: float):
    def links(pdf):
        import numpy as np
        import pandas as pd

        row_block, col_block = int(pdf["r"].iloc[0]), int(pdf["c"].iloc[0])
        same = row_block == col_block
        vectors = np.vstack(pdf["v"].to_numpy()).astype(np.float64)
        vectors /= np.abs(vectors).max(axis=1)[:, None]
        norms = np.sqrt((vectors ** 2).sum(axis=1))
        levels = quantise(vectors / norms[:, None])
        copies, block = pdf["copies"].to_numpy(), pdf["block"].to_numpy()
        left, right = np.nonzero(block == row_block)[0], np.nonzero(block == col_block)[0]
        linked = np.zeros(len(pdf), dtype=np.int64)
        forest = _Forest(len(pdf))
        if len(left) and len(right):
            take = lambda q, rows: tuple(x[rows] for x in q)
            for i, j in tile_links(vectors[left], vectors[right], norms[left], norms[right], take(levels, left), take(levels, right), threshold, same):
                x, y = left[i], right[j]
                linked += np.bincount(x, copies[y], len(pdf)).astype(np.int64) + np.bincount(y, copies[x], len(pdf)).astype(np.int64)
                forest.add(x, y)
        h1, h2 = pdf["h1"].to_numpy(), pdf["h2"].to_numpy()
        counted = np.nonzero(linked)[0]
        tree = np.array(forest.pairs, dtype=np.int64).reshape(-1, 2)
        a, b = tree[:, 0], tree[:, 1]
        none = np.zeros(len(counted), dtype=np.int64)
        return pd.DataFrame({
            "h1": np.concatenate([h1[counted], h1[a]]), "h2": np.concatenate([h2[counted], h2[a]]),
            "o1": np.concatenate([none, h1[b]]), "o2": np.concatenate([none, h2[b]]),
            "links": np.concatenate([linked[counted], np.zeros(len(tree), dtype=np.int64)]),
        })

    return links


def link_vectors(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, block_rows: int = BLOCK_ROWS,
    links_col: str = "n_links", component_col: str = "component_id", kept_col: str = "kept",
) -> DataFrame:
    """rows with the number of other rows at cosine >= threshold, the smallest id reachable by links, and whether that is its own.

    Null vectors, zero vectors and those with null or non-finite components link with nothing: no links, own component. Vectors
    of different lengths don't link. Equal vectors are one class; its members are linked with each other without pairs.
    A null id has the smallest id of its component, or null. Repeated ids are rows of their own. Empty table: empty result.

    All classes are compared, in tiles of two blocks of at most about 1.1 block_rows vectors; a block goes to one tile per other block
    (n * n / block_rows vectors move in all, the price of an exact answer). A tile returns per vector the number of its links and a
    forest of the links, so a dense group of m vectors returns 2 m rows and never its m * m pairs.
    """
    names = {c: f"c{i}" for i, c in enumerate(rows.columns)}
    ident, vector = names[id_col], names[vector_col]
    v = F.col(vector)
    number = rows.schema[vector_col].dataType.elementType
    valid = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    h1, h2 = hash128(F.transform(v, lambda x: x + F.lit(0).cast(number)))  # -0.0 becomes 0.0
    usable = F.coalesce(valid, F.lit(False))
    slim = rows.toDF(*names.values()).withColumns({"h1": F.when(usable, h1), "h2": F.when(usable, h2)})
    good = slim.where(F.col("h1").isNotNull())
    classes = stored(good.groupBy("h1", "h2").agg(
        F.count("*").alias("copies"), F.min(ident).alias("low"), F.first(vector).alias("v")).withColumn("d", F.size("v")))
    blocks = max(1, -(-classes.count() // block_rows))
    block = F.pmod(F.col("h2"), F.lit(blocks)).cast("int")
    # Block b meets every block: as row of the tiles to its right and as column of the tiles above it.
    tiles = classes.withColumn("block", block).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(
        "*", F.least("block", "t").alias("r"), F.greatest("block", "t").alias("c")).drop("t")
    found = stored(tiles.groupBy("d", "r", "c").applyInPandas(_tile(threshold), "h1 long, h2 long, o1 long, o2 long, links long"))
    links = found.groupBy("h1", "h2").agg(F.sum("links").alias("links"))
    node = lambda a, b: F.concat(F.hex(a), F.lit("-"), F.hex(b))
    edges = found.where("links = 0").select(node("h1", "h2").alias("a"), node("o1", "o2").alias("b"))
    parts = connected_components(edges)
    member = classes.select("h1", "h2", "copies", "low", node("h1", "h2").alias("node")).join(parts, "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    lowest = member.groupBy("component").agg(F.min("low").alias("lowest"), F.count("*").alias("members"))
    per_class = join_by_class(member, lowest, ["component"], "members").join(links, ["h1", "h2"], "left").select(
        "h1", "h2", "copies", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("_links"), F.col("lowest").alias("_lowest"))
    joined = join_by_class(good, per_class, ["h1", "h2"], "copies", "left").unionByName(
        slim.where(F.col("h1").isNull()).withColumns(
            {"copies": F.lit(1).cast("long"), "_links": F.lit(0).cast("long"), "_lowest": F.col(ident)}))
    return joined.select(
        *[F.col(names[c]).alias(c) for c in others(rows, links_col, component_col, kept_col)], F.col("_links").alias(links_col),
        F.col("_lowest").alias(component_col), F.col(ident).eqNullSafe(F.col("_lowest")).alias(kept_col))


def op6_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return link_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).select("vec_id", "n_links", "component_id", "kept")


SQL = """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding::DOUBLE[], lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(embedding::DOUBLE[], lambda x: x <> 0)) > 0),
p AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT reach.x, p.y FROM reach JOIN p ON reach.y = p.x),
c AS (SELECT x AS vec_id, min(y) AS component_id FROM reach GROUP BY x),
n AS (SELECT x, count(*) AS n FROM p GROUP BY x)
SELECT c.vec_id, coalesce(n.n, 0) AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN n ON n.x = c.vec_id"""

QUERIES = {"op6_embedding_near_dedup": (op6_embedding_near_dedup, SQL)}
