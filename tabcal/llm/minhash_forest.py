"""MinHash near-dedup by an LSH forest: several sorted signature orders whose neighbours are candidates, links confirmed on full sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tabcal.llm.common import (
    BROADCAST_ROWS, append_columns, connected_components, hash128, join_by_class, others, sized, stored, table, unused,
)

SHINGLE, PERCENT = 5, 85
#: Orders, values of the signature that two rows must share to be compared in one, further values that sort them.
ORDERS, DEPTH, DEEPER = 16, 3, 4
VALUES = ORDERS * (DEPTH + DEEPER)
#: Rows of a region that are all compared with each other; rows of it sorted in one task.
SMALL, REGION_ROWS = 5, 1_024
#: Rows of a block when a region is finished exactly; they hold full sets.
BLOCK_ROWS = 512
#: Standard deviations below the threshold at which an estimate rules a pair out.
DEVIATIONS = 6.5
#: Confirming rounds in which each row asks for its best partner in another component, before all the rest is asked.
ROUNDS = 1


class Sketcher:
    """Shingle sets of texts as sorted 64-bit hashes, and their minimum hashes."""

    def __init__(self, shingle: int = SHINGLE, values: int = VALUES):
        import numpy as np

        draw = np.random.default_rng(20240601)
        self.shingle = shingle
        self.multiply = draw.integers(1, 2**63, values, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.add = draw.integers(0, 2**63, values, dtype=np.uint64)
        self.steps = draw.integers(1, 2**63, shingle, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.known: dict[bytes, int] = {}

    def word_hashes(self, words: list[bytes]):
        import numpy as np
        import xxhash

        known = self.known
        if len(known) > 100_000:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        return np.array([known[w] for w in words], dtype=np.uint64)

    def shingles(self, text: str | None):
        """Sorted distinct hashes of the runs of `shingle` words; with fewer words, one hash of all; without words, none."""
        import numpy as np
        import xxhash

        words = (text or "").encode().lower().split()  # of bytes: A-Z only, and the six ASCII white-space characters
        if not words:
            return np.empty(0, dtype=np.uint64)
        if len(words) < self.shingle:
            return np.array([xxhash.xxh3_64_intdigest(b"\x00" + b" ".join(words))], dtype=np.uint64)
        h = self.word_hashes(words)
        n = len(h) - self.shingle + 1
        total = np.zeros(n, dtype=np.uint64)
        for k in range(self.shingle):
            total += h[k:k + n] * self.steps[k]
            total ^= total >> np.uint64(29)
        return np.unique(total * np.uint64(0x9E3779B97F4A7C15))

    def signatures(self, sets: list):
        """One row of 32-bit minimum hashes per non-empty set."""
        import numpy as np

        out = np.zeros((len(sets), len(self.multiply)), dtype=np.uint32)
        at = 0
        while at < len(sets):
            end, size = at, 0
            while end < len(sets) and (end == at or size + len(sets[end]) <= 65_536):
                size += len(sets[end])
                end += 1
            flat = np.concatenate(sets[at:end])
            starts = np.cumsum([0] + [len(s) for s in sets[at:end - 1]])
            for k, (m, a) in enumerate(zip(self.multiply, self.add, strict=True)):
                out[at:end, k] = np.minimum.reduceat(((flat * m + a) >> np.uint64(32)).astype(np.uint32), starts)
            at = end
        return out


def sketch(docs: DataFrame, text_col: str, keep: list[str], shingle: int, with_sets: bool) -> DataFrame:
    """n_shingles, fp (a 128-bit hash of the set; null for an empty set), and the signature or the set as bytes."""
    def start():
        from hashlib import blake2b

        sketcher = Sketcher(shingle)

        def call(texts):
            sets = [sketcher.shingles(t) for t in texts]
            prints = [blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            if with_sets:
                return [len(s) for s in sets], prints, [s.tobytes() for s in sets]
            full = [s for s in sets if len(s)]
            rows = iter([r.tobytes() for r in sketcher.signatures(full)] if full else [])
            return [len(s) for s in sets], prints, [next(rows) if len(s) else None for s in sets]

        return call

    return append_columns(docs, [text_col], f"n_shingles bigint, fp binary, {'shingles' if with_sets else 'signature'} binary", start, keep)


def _regions(batches):
    """Per class and order: the region (its first DEPTH values), the key that sorts it (DEEPER more, 16 bits each)."""
    import numpy as np
    import pyarrow as pa

    mix = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        values = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.uint32).reshape(n, ORDERS, DEPTH + DEEPER).astype(np.uint64)
        region = np.broadcast_to(np.arange(1, ORDERS + 1, dtype=np.uint64) * mix[3], (n, ORDERS)).copy()
        for k in range(DEPTH):
            region = (region ^ values[:, :, k]) * mix[k]
            region ^= region >> np.uint64(31)
        key = np.zeros((n, ORDERS), dtype=np.uint64)
        for k in range(DEPTH, DEPTH + DEEPER):
            key = (key << np.uint64(16)) | (values[:, :, k] >> np.uint64(16))
        rows = pa.array(np.repeat(np.arange(n), ORDERS))
        order = np.tile(np.arange(ORDERS, dtype=np.int32), n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(region.ravel().view(np.int64)), pa.array(key.ravel().view(np.int64)), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(order)],
            ["region", "key", "fp", "n", "order"])


def _neighbours(percent: int):
    """From rows sorted by region, salt and key: pairs of successive rows, and all pairs among the first SMALL of a region. The
    successor is the row with the longest common prefix, so the depth at which rows are paired follows the region."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        held = None
        for batch in batches:
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            n = batch.num_rows
            if not n:
                continue
            region, salt, size = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 4))
            new = np.ones(n, dtype=bool)
            new[1:] = (region[1:] != region[:-1]) | (salt[1:] != salt[:-1])
            starts = np.nonzero(new)[0]
            rank = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
            # Rows of the last region so far stay for the next batch: the last one, or all while it is small.
            tail = starts[-1] if n - starts[-1] < SMALL else n - 1
            carried = 0 if held is None else held.num_rows
            left, right = [], []
            for s in range(1, SMALL):
                i = np.arange(n - s)
                ok = (rank[s:] >= s) & ((s == 1) | (rank[s:] < SMALL))
                ok &= i + s >= carried if carried else True
                ok &= np.minimum(size[:-s], size[s:]) * 100 >= percent * np.maximum(size[:-s], size[s:])
                left.append(i[ok])
                right.append(i[ok] + s)
            a, b = batch.column(3).take(pa.array(np.concatenate(left))), batch.column(3).take(pa.array(np.concatenate(right)))
            held = batch.slice(int(tail))
            yield pa.RecordBatch.from_arrays([a, b], ["a", "b"])

    return run


def _estimates(floor: float):
    """Keeps pairs (a, b, low bytes of both signatures) whose share of equal values reaches `floor`."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            n = batch.num_rows
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint8).reshape(n, VALUES) for i in (2, 3))
            share = (x == y).mean(axis=1)
            keep = pa.array(np.nonzero(share >= floor)[0])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(keep), batch.column(1).take(keep), pa.array(share[share >= floor])], ["a", "b", "share"])

    return run


def _linked(x, y, percent: int) -> bool:
    """Whether two sorted sets of distinct hashes reach the threshold."""
    import numpy as np

    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirm(percent: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            sets = [[np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in batch.column(k)] for k in (2, 3)]
            keep = pa.array([i for i, (x, y) in enumerate(zip(*sets, strict=True)) if _linked(x, y, percent)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(k).take(keep) for k in (0, 1)], ["a", "b"])

    return run


def _across(floor: float, percent: int):
    """Links between one block of rows outside a region's main component and one block of all its rows: for each asking row
    one link to each other component that it has. A pair that shares several regions is compared in the first."""
    def run(pdf):
        import numpy as np
        import pandas as pd

        values = np.frombuffer(b"".join(pdf["signature"]), dtype=np.uint32).reshape(len(pdf), ORDERS, DEPTH + DEEPER)
        low = (values.reshape(len(pdf), -1) & 255).astype(np.uint8)
        heads, order = values[:, :, :DEPTH], int(pdf["order"].iloc[0])
        component, n, fp = pd.factorize(pdf["component"])[0], pdf["n"].to_numpy(), pdf["fp"].to_numpy()
        sets = [np.frombuffer(v, dtype=np.uint64) for v in pdf["shingles"]]
        asks, targets = np.nonzero(pdf["asks"].to_numpy())[0], np.nonzero(~pdf["asks"].to_numpy())[0]
        a, b = [], []
        for i in asks:
            fit = targets[(component[targets] != component[i]) & (np.minimum(n[targets], n[i]) * 100 >= percent * np.maximum(n[targets], n[i]))]
            share = (low[fit] == low[i]).mean(axis=1)
            fit, share = fit[share >= floor], share[share >= floor]
            first = (heads[fit] == heads[i]).all(axis=2).argmax(axis=1) == order
            reached: set[int] = set()
            for j in fit[first][np.argsort(-share[first], kind="stable")]:
                if component[j] not in reached and _linked(sets[i], sets[j], percent):
                    reached.add(component[j])
                    a.append(i)
                    b.append(j)
        return pd.DataFrame({"a": fp[a], "b": fp[b]})

    return run


def near_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT,
    count_col: str = "n_shingles", component_col: str = "component_id", kept_col: str = "kept", carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per row of docs: id_col and the columns `carry`, the size of its shingle set, the smallest id reachable by links, and
    whether that is its own. Two sets are linked if 100 * |A and B| >= percent * |A or B|.

    Null or empty text, or no words: empty set, linked with nothing, own component. A null id has the smallest id of its
    component, or null. Rows that share an id are rows of their own. Empty table: empty result.

    Rows with equal sets are one class. Each of ORDERS orders sorts the classes by its own values of the signature; in a region (DEPTH equal
    values) each row is paired with its neighbour in the order, and all pairs of a small region are taken. Two sets at 85% miss each
    other in all orders with probability (1 - 0.85^DEPTH)^ORDERS = 2e-7. A large region is sorted in several parts. Estimates rule out
    far pairs, full sets confirm the rest: first each class's best partner in another component, then all pairs left between
    components. Last, regions that still hold several components are compared exactly: each row outside its main component with all
    rows of the region, in blocks that hold the full sets and return one link per row and component reached.
    """
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    ident, text = names[id_col], names[text_col]
    source = docs.toDF(*names.values())
    carried = [names[c] for c in others(docs.select(*carry), id_col, count_col, component_col, kept_col)]
    features = stored(sketch(source, text, [ident, *carried], shingle, with_sets=False))
    classes = stored(features.where(F.col("fp").isNotNull()).groupBy("fp").agg(
        F.count("*").alias("copies"), F.min(ident).alias("low_id"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature")))
    low_bytes = stored(append_columns(classes.select("fp", "n", "signature"), ["signature"], "low binary", lambda: lambda rows: ([r[::4] for r in rows],), keep=["fp", "n"]))

    rows = classes.select("fp", "n", "signature").mapInArrow(_regions, "region long, key long, fp binary, n long, order int")
    large = stored(rows.groupBy("region").agg(F.count("*").alias("members")).where(F.col("members") > SMALL))
    large = F.broadcast(large) if large.count() <= BROADCAST_ROWS else large
    parts = F.coalesce(F.ceil(F.col("members") / REGION_ROWS), F.lit(1))
    dealt = rows.join(large, "region", "left").withColumn("salt", F.pmod(F.xxhash64("fp", "region"), parts).cast("int")).select(
        "region", "salt", "key", "fp", "n")
    pairs = dealt.repartition("region", "salt").sortWithinPartitions("region", "salt", "key", "fp").mapInArrow(
        _neighbours(percent), "a binary, b binary").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    j = percent / 100
    floor = j - DEVIATIONS * (j * (1 - j) / VALUES) ** 0.5
    low = low_bytes.select("fp", "low")
    candidates = stored(
        pairs.join(low.select(F.col("fp").alias("a"), F.col("low").alias("la")), "a").join(low.select(F.col("fp").alias("b"), F.col("low").alias("lb")), "b")
        .select("a", "b", "la", "lb").mapInArrow(_estimates(floor), "a binary, b binary, share double"))

    def sets_of(nodes: DataFrame) -> DataFrame:
        """Full sets of these classes, from the texts of the classes' first ids."""
        first = classes.join(sized(nodes.distinct()), "fp", "left_semi").select("fp", F.col("low_id").alias("low"))
        first = sized(first)
        some = source.join(first.select("low").distinct(), F.col(ident).eqNullSafe(F.col("low")), "left_semi")
        full = sketch(some, text, [], shingle, with_sets=True).select("fp", "shingles")
        return stored(full.join(first, "fp", "left_semi").groupBy("fp").agg(F.first("shingles").alias("shingles")))

    def ends(p: DataFrame) -> DataFrame:
        return p.select(F.col("a").alias("fp")).unionByName(p.select(F.col("b").alias("fp")))

    def confirmed(p: DataFrame, sets: DataFrame) -> DataFrame:
        left, right = sets.select(F.col("fp").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("fp").alias("b"), F.col("shingles").alias("sb"))
        return stored(p.select("a", "b").distinct().join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(_confirm(percent), "a binary, b binary"))

    def with_components(p: DataFrame, found: DataFrame) -> DataFrame:
        ca = found.select(F.col("node").alias("a"), F.col("component").alias("pa"))
        cb = found.select(F.col("node").alias("b"), F.col("component").alias("pb"))
        return p.join(ca, "a", "left").join(cb, "b", "left").where(F.coalesce("pa", "a") != F.coalesce("pb", "b")).drop("pa", "pb")

    sets = sets_of(ends(candidates))
    links, open_pairs, found = None, candidates, None
    for round_ in range(ROUNDS + 1):
        ask = open_pairs
        if round_ < ROUNDS:
            both = open_pairs.unionByName(open_pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "share"))
            best = both.groupBy("a").agg(F.max(F.struct("share", "b")).alias("m")).select("a", "m.b")
            ask = best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        new = confirmed(ask, sets)
        links = new if links is None else links.unionByName(new)
        found = connected_components(links)
        asked = ask.select("a", "b").distinct()
        open_pairs = stored(with_components(open_pairs.join(asked, ["a", "b"], "left_anti"), found)) if round_ < ROUNDS else None

    # Regions in which not all rows could be each other's neighbours, if they still hold several components.
    placed = rows.join(large, "region").join(found.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp"))
    by_part = placed.groupBy("region", "component").agg(F.count("*").alias("rows"), F.first("members").alias("members"))
    mixed = by_part.groupBy("region").agg(
        F.max(F.struct("rows", "component")).alias("main"), F.sum("rows").alias("members")).where(F.col("main.rows") < F.col("members"))
    mixed = stored(mixed.select("region", F.col("main.component").alias("main"), F.col("main.rows").alias("main_rows"), "members"))
    n_mixed = mixed.count()
    if n_mixed:
        mixed = F.broadcast(mixed) if n_mixed <= BROADCAST_ROWS else mixed
        members = placed.drop("members", "key").join(mixed, "region").withColumns({
            "asks": F.col("component") != F.col("main"),
            "bt": F.ceil(F.col("members") / BLOCK_ROWS), "ba": F.ceil((F.col("members") - F.col("main_rows")) / BLOCK_ROWS)})
        members = stored(members)
        full = sets_of(members.select("fp")).join(classes.select("fp", "signature"), "fp")
        members = members.join(full, "fp")
        own = lambda k: F.pmod(F.xxhash64(F.lit(3), "fp"), F.col(k)).cast("int")
        every = lambda k: F.explode(F.sequence(F.lit(0), (F.col(k) - 1).cast("int")))
        as_target = members.withColumns({"t": own("bt")}).withColumn("q", every("ba")).withColumn("asks", F.lit(False))
        as_asking = members.where("asks").withColumns({"q": own("ba")}).withColumn("t", every("bt"))
        rest = as_target.unionByName(as_asking).select("region", "order", "t", "q", "fp", "n", "component", "signature", "shingles", "asks").groupBy(
            "region", "t", "q").applyInPandas(_across(floor, percent), "a binary, b binary")
        rest = stored(rest)
        if not rest.isEmpty():
            links = links.unionByName(rest)
            found = connected_components(links)

    member = classes.select("fp", "copies", "low_id", F.col("fp").alias("node")).join(found, "node", "left").withColumn(
        "component", F.coalesce("component", "fp"))
    lowest = member.groupBy("component").agg(F.min("low_id").alias("lowest"), F.count("*").alias("members"))
    per_class = join_by_class(member, lowest, ["component"], "members").select("fp", "copies", "lowest")
    slim = features.select(ident, *carried, "n_shingles", "fp")
    marked = join_by_class(slim.where(F.col("fp").isNotNull()), per_class, ["fp"], "copies", "left").unionByName(
        slim.where(F.col("fp").isNull()).withColumns({"copies": F.lit(1).cast("long"), "lowest": F.col(ident)}))
    back = {v: k for k, v in names.items()}
    return marked.select(
        *[F.col(c).alias(back[c]) for c in (ident, *carried)], F.col("n_shingles").alias(count_col), F.col("lowest").alias(component_col),
        F.col(ident).eqNullSafe(F.col("lowest")).alias(kept_col))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs without the rows that near_dedup doesn't keep: one id of each group of near copies stays. Rows that repeat an id
    and its text are one document and stay or go together."""
    h1, h2, ident, a, b = unused(docs, "_h1", "_h2", "_id", "_a", "_b")
    one, two = hash128(F.coalesce(F.col(text_col), F.lit("")))
    hashed = docs.withColumns({h1: one, h2: two})
    marks = near_dedup(hashed, id_col, text_col, shingle, percent, carry=(h1, h2))
    lost = stored(marks.where("NOT kept").select(F.col(id_col).alias(ident), F.col(h1).alias(a), F.col(h2).alias(b)).distinct())
    lost = F.broadcast(lost) if lost.count() <= BROADCAST_ROWS else lost
    same = F.col(id_col).eqNullSafe(F.col(ident)) & (F.col(h1) == F.col(a)) & (F.col(h2) == F.col(b))
    return hashed.join(lost, same, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op5_minhash_near_dedup": (op5_minhash_near_dedup, None)}
