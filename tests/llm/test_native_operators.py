"""Line dedup, source mixing and sharding against plain Python, with nulls, ties, repeats and clashing columns."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest

from pyspark.sql import functions as F

from tabcal.llm import common, line_dedup, sharding, source_mixing

SCHEMA = "doc_id long, text string, source string, n_lines string, size double, shard string"
SPACES = " \t\n\x0b\f\r"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute_lines(rows, min_chars=20, min_docs=3):
    key = lambda x: lower(x).strip(SPACES)
    holders = defaultdict(set)
    for r in rows:
        for line in (r[1] or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(r[0])
    keeper = {k: max((i for i in v if i is not None), default=None) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        stay = [x for x in lines if not (key(x) in keeper and keeper[key(x)] != r[0])]
        out.append((r[0], len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


def random_docs(seed):
    rng = random.Random(seed)
    common_lines = [f"  This LINE number {i} is repeated in documents É\t" for i in range(6)] + ["\r\x0bShort line", "", "İstanbul ΑΒΓ is a long enough line here"]
    rows = []
    for i in range(60):
        text = "\n".join(rng.choice(common_lines) if rng.random() < 0.6 else f"own line {i} {rng.random()}" for _ in range(rng.randint(0, 8)))
        rows.append((rng.choice([i, i, 7, None]), rng.choice([text, text, text, text.upper(), None, ""]), rng.choice(["b", "a", None]), "x", 1.0, "y"))
    long_text = "\n".join(f"{'Z' * 30} {k % 50}" for k in range(5000))
    rows += [(1000, long_text, "a", None, None, None), (1001, long_text, "a", None, None, None), (1002, long_text, "é", None, None, None)]
    return rows + rows[:10]


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup_equals_brute_force(spark, seed):
    rows = random_docs(seed)
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA))
    assert Counter(out.columns)["n_lines"] == 1 and "shard" in out.columns
    got = [(r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in out.collect()]
    assert sorted(got, key=repr) == sorted(brute_lines(rows), key=repr)


def test_hot_lines_join_apart(spark, monkeypatch):
    rows = random_docs(3)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 2)
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA))
    got = [(r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in out.collect()]
    assert sorted(got, key=repr) == sorted(brute_lines(rows), key=repr)


def test_ascii_lower_changes_only_ascii(spark):
    words = ["ABC", "ÀÉÖ ABC", "ǅ Ⅷ Ⓐ AB", "İI", "straße Q", "", "ΣΑΣ X"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(common.ascii_lower(F.col("w"))).collect()
    assert [r[0] for r in got] == [lower(w) for w in words]


def jump(key, shards):
    at, following = -1, 0
    while following < shards:
        at = following
        key = (key * 2862933555777941757 + 1) % 2**64
        following = int((at + 1) * (2147483648.0 / ((key >> 33) + 1)))
    return at


def test_jump_hash_by_definition(spark):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), 12345678901234567, -987654321]
    df = spark.createDataFrame([(k,) for k in keys], "k long").select(
        "k", *[sharding.jump_shard(F.col("k"), n).alias(f"s{n}") for n in (1, 2, 40, 41, 300)])
    for r in df.collect():
        for n in (1, 2, 40, 41, 300):
            assert r[f"s{n}"] == jump(r["k"] % 2**64, n)


def test_shards_move_only_into_the_new_one_and_places_have_no_gap(spark):
    rows = random_docs(4) + [(i, f"t{i}", "a", None, None, None) for i in range(2000)]
    got = sharding.assign_shards(spark.createDataFrame(rows, SCHEMA), 7).collect()
    assert len(got) == len(rows)
    places, homes = defaultdict(list), defaultdict(set)
    for r in got:
        key = int(hashlib.md5(("" if r["doc_id"] is None else str(r["doc_id"])).encode()).hexdigest()[:16], 16)
        assert r["shard"] == jump(key, 7)
        assert r["grown_shard"] in (r["shard"], 7)
        places[r["shard"]].append(r["slot"])
        homes[r["doc_id"]].add(r["shard"])
    assert all(sorted(v) == list(range(len(v))) for v in places.values())
    assert all(len(v) == 1 for v in homes.values())


def test_written_shards_hold_all_rows(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(300)], "doc_id long, text string")
    sharded = sharding.assign_shards(docs, 5)
    sharding.write_shards(sharded, str(tmp_path / "out"), rows_per_file=20)
    again = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r["doc_id"], r["shard"], r["slot"]) for r in again.collect()) == sorted((r["doc_id"], r["shard"], r["slot"]) for r in sharded.collect())


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, target = share * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(w[s] for s in free)
        full = {s for s in free if w[s] * level > most * sizes[s]}
        for s in full or free:
            target[s] = most * sizes[s] if full else w[s] * level
            left -= target[s] if full else 0
        if not full:
            break
        free -= full
    return target


@pytest.mark.parametrize("seed", [5, 6])
def test_mixing_targets_epochs_and_order(spark, seed):
    rng = random.Random(seed)
    rows = [(i, " ".join(["word"] * rng.randint(0, 9)), rng.choice(["b", "a", "ä", "Z", None, "c"][: 2 + seed % 5]), "x", rng.random(), "y") for i in range(400)]
    rows += [(400, None, None, None, None, None), (401, "", "b", None, None, None), (None, "one two", "a", None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    mixed = source_mixing.mix_sources(df, source_mixing.word_count(F.col("text")), source_mixing.letter_share(F.col("text")))
    got = mixed.collect()
    assert Counter(mixed.columns)["size"] == 1 and len(got) == len(rows)
    sizes = Counter()
    for r in rows:
        sizes[r[2]] += len((r[1] or "").split())
    targets = brute_targets(sizes)
    taken, largest = Counter(), 0
    for r in got:
        assert r["size"] == len((r["text"] or "").split()) and r["source_size"] == sizes[r["source"]]
        assert math.isclose(r["target"], targets[r["source"]], abs_tol=1e-6)
        assert 0 <= r["copies"] <= 2
        taken[r["source"]] += r["size"] * r["copies"]
        largest = max(largest, r["size"])
    for s, t in targets.items():
        assert abs(taken[s] - t) <= largest / 2 + 1e-6
    again = source_mixing.mix_sources(df.repartition(3), source_mixing.word_count(F.col("text")), source_mixing.letter_share(F.col("text"))).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_better_documents_are_taken_more_often(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source"))
    weight = F.when(F.col("doc_id") % 2 == 0, 1.0).otherwise(0.2)
    mixed = source_mixing.mix_sources(df, F.lit(3), weight, total_share=0.3)
    by = {r["k"]: r["n"] for r in mixed.groupBy((F.col("doc_id") % 2).alias("k")).agg(F.sum("copies").alias("n")).collect()}
    assert by[0] > 2.5 * by[1] and abs(by[0] + by[1] - 1200) <= 1


def test_hot_repeated_rows_and_one_source(spark):
    rows = [(1, "a b c", "s")] * 300 + [(i, "a b c", "s") for i in range(2, 302)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = source_mixing.mix_sources(df, source_mixing.word_count(F.col("text")), F.lit(1.0)).collect()
    assert len({r["copies"] for r in got if r["doc_id"] == 1}) == 1 and len(got) == 600


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert line_dedup.dedup_lines(empty).count() == 0
    assert sharding.assign_shards(empty).count() == 0
    assert source_mixing.mix_sources(empty, source_mixing.word_count(F.col("text")), source_mixing.letter_share(F.col("text"))).count() == 0


def test_columns_named_like_helpers_pass_through(spark):
    """Every name that the operators use inside is free for the input, and comes back as it was."""
    helpers = ["_lines", "_places", "_id", "_t1", "_t2", "_own1", "_own2", "_a_t1", "_b_t2", "id", "t1", "t2", "hashes", "a", "b", "h", "place", "docs", "keeper"]
    rows = [(i, f"a line that many documents hold here\nown line number {i} of this document", *[f"{c}{i}" for c in helpers]) for i in range(4)]
    df = spark.createDataFrame(rows, ["doc_id", "text", *helpers])
    out = line_dedup.dedup_lines(df)
    assert out.columns == [*df.columns, "n_lines", "n_dropped"]
    for r in out.collect():
        assert [r[c] for c in helpers] == [f"{c}{r['doc_id']}" for c in helpers] and r["n_dropped"] == int(r["doc_id"] < 3)
    names = ["_n", "_key", "_tie", "_bin", "_source", "__source", "_first", "_tk", "_tt", "_full", "_whole", "_aim", "rest", "before", "end", "last"]
    some = spark.createDataFrame([(i, "s", *[f"{c}{i}" for c in names]) for i in range(6)], ["doc_id", "source", *names])
    mixed = source_mixing.mix_sources(some, F.lit(10), F.lit(0.5))
    assert mixed.columns[:len(some.columns)] == some.columns
    for r in mixed.collect():
        assert [r[c] for c in names] == [f"{c}{r['doc_id']}" for c in names] and r["copies"] in (1, 2)
