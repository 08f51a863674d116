"""Near-duplicate operators against brute force over all pairs, with hot groups and forced small blocks."""

import math
import random

import numpy as np
import pytest

import corpus_pipeline
from tabcal.llm import common, embedding_dedup, minhash_forest

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def components(nodes, links):
    parent = {n: n for n in nodes}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[top(a)] = top(b)
    return {n: top(n) for n in nodes}


# MinHash

def shingles(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return frozenset()
    return frozenset([tuple(words)]) if len(words) < 5 else frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4))


def brute_near(rows):
    sets = [shingles(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    top = components(range(len(rows)), links)
    low = {}
    for i, (ident, _) in enumerate(rows):
        if ident is not None:
            low[top[i]] = min(low.get(top[i], math.inf), ident)
    return sorted(((r[0], len(s), low.get(top[i]), r[0] == low.get(top[i])) for i, (r, s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def near_rows(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(LETTERS) for _ in range(5))

    def changed(text, n):
        words = text.split()
        for _ in range(n):
            words[rng.randrange(len(words))] = word()
        return " ".join(words)

    texts = []
    for size, edits in ((2, 1), (3, 2), (8, 1), (60, 2), (25, 3), (2, 4)):
        base = " ".join(word() for _ in range(rng.randint(60, 160)))
        texts += [base] + [changed(base, rng.randint(0, edits)) for _ in range(size)]
    chain = " ".join(word() for _ in range(120))
    for _ in range(6):
        texts.append(chain)
        chain = changed(chain, 1)
    texts += [None, "", "  \n", "one two", "ONE two", "one two three", "É a", "é a", texts[0].upper(), texts[0] + "\n"]
    texts += ["same words " * 4000, "same words " * 4000 + "end"]
    rows = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows + [rows[0], rows[3], (None, texts[0]), (None, "alone text"), (5, texts[40])]


@pytest.mark.parametrize("seed", [1, 2])
def test_near_dedup_equals_all_pairs(spark, seed):
    rows = near_rows(seed)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, component_id string")
    got = minhash_forest.near_dedup(df).collect()
    assert sorted((tuple(r) for r in got), key=repr) == [(*x[:3], bool(x[3]) if x[0] is not None else x[2] is None) for x in brute_near(rows)]


def test_large_regions_are_finished_exactly(spark, monkeypatch):
    """With few neighbours, small parts and no broadcast, the last step has to find what the orders miss."""
    monkeypatch.setattr(minhash_forest, "REGION_ROWS", 8)
    monkeypatch.setattr(minhash_forest, "BLOCK_ROWS", 7)
    monkeypatch.setattr(minhash_forest, "BROADCAST_ROWS", 1)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 1)
    monkeypatch.setattr(minhash_forest, "ROUNDS", 1)
    rows = [r for r in near_rows(3) if r[0] is not None]
    got = minhash_forest.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_near(rows)


def test_one_document_of_each_group_stays(spark):
    rows = [r for r in near_rows(4) if r[0] is not None]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, kept string")
    left = minhash_forest.drop_near_duplicates(df)
    assert left.columns == df.columns
    keep = {(r[0], t) for r, (_, t) in zip(sorted(brute_near(rows), key=repr), sorted(rows, key=lambda r: repr(r)), strict=False) if r[3]}
    ids = sorted({r[0] for r in brute_near(rows) if r[3]})
    assert sorted({r["doc_id"] for r in left.collect()}) == ids and keep


def test_pipeline_stage_links_from_80_percent_on(spark):
    """Edits far apart cost five shingles each: of 96, two edits leave 86 of 106 (0.81) and three 81 of 111 (0.73)."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice(LETTERS) for _ in range(7))
    rows = []
    for group in range(12):
        words = [word() for _ in range(100)]
        for edits in ((), (20, 60), (20, 40, 60), (20, 60, 70, 90), (10,)):
            rows.append((len(rows), " ".join(word() if k in edits else w for k, w in enumerate(words))))
    rows = [(100 - i, t) for i, t in rows] + [(200, rows[1][1]), (None, "alone text")]
    sets = [shingles(t) for _, t in rows]
    links = {p: [(i, j) for i in range(len(rows)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= p * len(sets[i] | sets[j])] for p in (80, 85)}
    assert len(links[80]) > len(links[85])
    top, low = components(range(len(rows)), links[80]), {}
    for i, (ident, _) in enumerate(rows):
        low[top[i]] = min(low.get(top[i], math.inf), math.inf if ident is None else ident)
    left = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    got = [r["doc_id"] for r in left.collect()]
    assert sorted(got, key=repr) == sorted((r[0] for i, r in enumerate(rows) if r[0] is None or r[0] == low[top[i]]), key=repr)


def test_no_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert minhash_forest.near_dedup(empty).count() == 0 and minhash_forest.drop_near_duplicates(empty).count() == 0


def test_components_of_chains_stars_and_rings(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 90)] + [(200 + i, 200 + (i + 1) % 20) for i in range(20)] + [(300, 300), (301, 302), (302, 301)]
    edges += [(rng.randrange(400, 500), rng.randrange(400, 500)) for _ in range(80)]
    got = {r["node"]: r["component"] for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    edges = [(a, b) for a, b in edges if a != b]
    nodes = {x for e in edges for x in e}
    want = components(nodes, edges)
    assert set(got) == nodes
    assert len({(got[n], want[n]) for n in nodes}) == len(set(want.values())) == len(set(got.values()))
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# Embeddings

def brute_vectors(rows, threshold=0.95):
    def good(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)

    vectors = [np.array(v, dtype=float) if good(v) else None for _, v in rows]
    links = []
    for i, a in enumerate(vectors):
        for j, b in enumerate(vectors[:i]):
            if a is not None and b is not None and len(a) == len(b):
                x, y = a / np.abs(a).max(), b / np.abs(b).max()
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                    links.append((i, j))
    top = components(range(len(rows)), links)
    n, low = [0] * len(rows), {}
    for i, j in links:
        n[i] += 1
        n[j] += 1
    for i, (ident, _) in enumerate(rows):
        low[top[i]] = min(low.get(top[i], math.inf), ident)
    return sorted((r[0], n[i], low[top[i]], r[0] == low[top[i]]) for i, r in enumerate(rows))


@pytest.mark.parametrize("block", [16, 4096])
def test_vectors_equal_all_pairs(spark, block):
    rng = np.random.default_rng(6)
    vectors = []
    for size, spread in ((1, 0), (40, 0.05), (25, 0.22), (30, 0.3)):
        base = rng.normal(size=12)
        vectors += [(base + rng.normal(size=12) * spread * np.linalg.norm(base) / 12 ** 0.5).astype(np.float32).tolist() for _ in range(size)]
    vectors += [vectors[3]] * 20 + [[2 * x for x in vectors[5]], [0.0] * 12, None, [], [1.0, None] * 6, [float("nan")] * 12, [float("inf")] + [1.0] * 11]
    vectors += [[-0.0, 1.0], [0.0, 1.0], [0.0, 5.0], [1e-30, 1e-30], [1e30, 1e30], [1.0, 0.95]]
    rows = [(i, v) for i, v in enumerate(vectors)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, h1 string, n_links int")
    out = embedding_dedup.link_vectors(df, block_rows=block)
    assert sorted(out.columns) == ["component_id", "embedding", "h1", "kept", "n_links", "vec_id"]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in out.collect())
    assert got == brute_vectors([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows])


def test_bounds_hold_for_each_pair():
    rng = np.random.default_rng(7)
    a, b = rng.normal(size=(60, 33)), rng.normal(size=(50, 33)) * rng.uniform(0.01, 9, size=(50, 1))
    norm = lambda m: np.sqrt((m ** 2).sum(axis=1))
    ua, ub = a / norm(a)[:, None], b / norm(b)[:, None]
    (la, sa, ea), (lb, sb, eb) = embedding_dedup.quantise(ua), embedding_dedup.quantise(ub)
    near = (la.astype(float) @ lb.astype(float).T) * sa[:, None] * sb[None, :]
    bound = norm(la.astype(float))[:, None] * sa[:, None] * eb[None, :] + ea[:, None]
    assert (np.abs(near - ua @ ub.T) <= bound + 1e-12).all()


def test_no_vectors_and_null_ids(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert embedding_dedup.link_vectors(empty).count() == 0
    some = spark.createDataFrame([(None, [1.0, 0.0]), (4, [1.0, 0.01]), (None, None), (4, [1.0, 0.01])], "vec_id long, embedding array<double>")
    got = sorted(map(repr, [(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.link_vectors(some).collect()]))
    assert got == sorted(map(repr, [(None, 2, 4, False), (4, 2, 4, True), (4, 2, 4, True), (None, 0, None, True)]))
