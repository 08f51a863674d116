"""Sharding by jump consistent hashing: an id and the number of shards decide. DataFrame functions throughout."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from tabcal.llm.common import hash128, others, sized, table, unused

SHARDS, ROW_BYTES = 40, 16
MULTIPLIER = 2862933555777941757  # fixed value of the published jump hash
#: Rows numbered in one sorted cell, and the least number of cells per shard.
CELL_ROWS, LEAST_CELLS = 65_536, 32


def stable_key(ident: Column) -> Column:
    """The first 64 bits of the md5 of the id's text; a null id is the empty text."""
    digest = F.md5(F.coalesce(ident.cast("string"), F.lit("")).cast("binary"))
    half = lambda start: F.conv(F.substring(digest, start, 8), 16, 10).cast("long")
    return F.shiftleft(half(1), 32).bitwiseOR(half(9))


def _next_key(key: Column) -> Column:
    """key * MULTIPLIER + 1 modulo 2^64, by 16-bit limbs: no product or sum leaves 64 bits, so ANSI mode never fails."""
    mask = F.lit(0xFFFF)
    k = [F.shiftrightunsigned(key, 16 * i).bitwiseAND(mask) for i in range(4)]
    m = [(MULTIPLIER >> 16 * i) & 0xFFFF for i in range(4)]
    out, carry = [], F.lit(1).cast("long")
    for i in range(4):
        total = reduce(lambda x, y: x + y, [k[j] * m[i - j] for j in range(i + 1)]) + carry
        out.append(F.shiftleft(total.bitwiseAND(mask), 16 * i))
        carry = F.shiftrightunsigned(total, 16)
    return reduce(lambda x, y: x.bitwiseOR(y), out)


def jump_shard(key: Column, shards: int) -> Column:
    """Shard of a 64-bit key. Adding one shard moves 1/(shards + 1) of the keys, all of them into the new shard.

    Each step draws the next number of shards at which the key would move; `shards` steps always end it, about
    ln(shards) do any work.
    """
    def step(s: Column, _: Column) -> Column:
        key = _next_key(s["key"])
        jump = F.floor((s["next"] + 1).cast("double") * (F.lit(2147483648.0) / (F.shiftrightunsigned(key, 33) + 1).cast("double")))
        return F.when(s["next"] < shards, F.struct(key.alias("key"), s["next"].alias("at"), jump.cast("long").alias("next"))).otherwise(s)

    start = F.struct(key.alias("key"), F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("next"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda s: s["at"].cast("int"))


def assign_shards(
    docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text",
    shard_col: str = "shard", slot_col: str = "slot", grown_col: str = "grown_shard",
) -> DataFrame:
    """docs with its shard, its place in the shard (gapless from 0) and its shard if there were one more.

    Rows that share an id share a shard. Places follow a hash of id and text, then the id; equal rows take successive
    places, in any order. Null ids are one key, null text is its own value. Empty table: empty result.

    A shard is cut into cells by that hash, so that no task sorts a whole shard; the number of cells grows with the
    rows, and a cell's first place comes from a table with one row per cell.
    """
    kept = others(docs, shard_col, slot_col, grown_col)
    docs = docs.select(*[F.col(f"`{c}`") for c in kept])
    h1, h2, cell, first = unused(docs, "_h1", "_h2", "_cell", "_first")
    a, b = hash128(F.col(id_col), F.col(text_col))
    key = stable_key(F.col(id_col))
    placed = docs.withColumns({shard_col: jump_shard(key, shards), grown_col: jump_shard(key, shards + 1), h1: a, h2: b})
    cells = max(LEAST_CELLS, -(-docs.count() // (CELL_ROWS * shards)))
    placed = placed.withColumn(cell, F.pmod(F.col(h1), F.lit(cells)))
    counts = placed.groupBy(shard_col, cell).agg(F.count("*").alias("n"))
    before = W.partitionBy(shard_col).orderBy(cell).rowsBetween(W.unboundedPreceding, -1)
    starts = sized(counts.select(shard_col, cell, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(first)))
    order = W.partitionBy(shard_col, cell).orderBy(h1, h2, id_col)
    slot = F.col(first) + F.row_number().over(order) - 1
    return placed.join(starts, [shard_col, cell]).withColumn(slot_col, slot.cast("long")).select(
        *[F.col(f"`{c}`") for c in kept], shard_col, slot_col, grown_col)


def write_shards(sharded: DataFrame, path: str, shard_col: str = "shard", slot_col: str = "slot", rows_per_file: int = 1_000_000) -> None:
    """One folder per shard; files in it hold successive ranges of places, sorted."""
    part, = unused(sharded, "part")
    cut = sharded.withColumn(part, F.floor(F.col(slot_col) / rows_per_file))
    cut.repartition(shard_col, part).sortWithinPartitions(shard_col, part, slot_col).write.partitionBy(shard_col, part).parquet(path)


def op7_sharding(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    sharded = assign_shards(docs, SHARDS, text_col="text_crc32")
    return sharded.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


QUERIES = {"op7_sharding": (op7_sharding, None)}
