"""Helpers of the corpus operators: scratch tables, size-checked joins, connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tabcal.session import ensure_checkpoint_dir

#: A table is broadcast only after its rows were counted and found to be at most this many.
BROADCAST_ROWS = 100_000
#: Bytes of input that a Python function gets at once.
SLICE_BYTES = 2 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The six ASCII white-space characters 0x09-0x0D and 0x20.
SPACES = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Write df as Parquet under the shared checkpoint folder and read it back: lineage is cut, and a lost
    executor costs a re-read. The folder goes when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def sized(df: DataFrame) -> DataFrame:
    """A stored table, marked for broadcast only if it is small by count; otherwise the join shuffles."""
    df = stored(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else. lower() does the same where no other capital letter occurs, and is much faster."""
    other_capitals = r"[\p{javaUpperCase}\p{Lt}&&[^A-Z]]"
    return F.when((F.octet_length(text) == F.length(text)) | ~text.rlike(other_capitals), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def hash128(*columns: Column) -> list[Column]:
    """Two independent 64-bit hashes; a clash needs both to agree."""
    return [F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns)]


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores put before those that df already has (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of `edges` (columns a, b); a component is named by one of its nodes.

    Each round, every node points to the neighbour (or itself) that comes first in a random order, pointers are followed
    four steps, and the graph is contracted along them; a fixed share of the nodes goes each round whatever its shape.
    Rounds are written to the shared folder. A hub's edges are combined before the shuffle.
    """
    left = stored(edges.where(F.col("a") != F.col("b")).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    steps: list[DataFrame] = []
    while not left.isEmpty():
        seed = F.lit(len(steps))
        both = left.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
            left.select(F.col("b").alias("node"), F.col("a").alias("other")))
        first = both.groupBy("node").agg(F.min(F.struct(F.xxhash64(seed, "other").alias("h"), F.col("other").alias("n"))).alias("m"))
        own = F.struct(F.xxhash64(seed, "node").alias("h"), F.col("node").alias("n"))
        points = stored(first.select("node", F.least(own, "m")["n"].alias("to")))
        for _ in range(2):
            after = points.select(F.col("node").alias("to"), F.col("to").alias("then"))
            points = points.join(after, "to").select("node", F.col("then").alias("to"))
        points = stored(points)
        steps.append(points)
        moved = (
            left.join(points.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a")
            .join(points.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b")
            .where(F.col("ta") != F.col("tb"))
        )
        left = stored(moved.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct())
    if not steps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = steps[-1].select("node", F.col("to").alias("component"))
    for points in reversed(steps[:-1]):
        after = found.select(F.col("node").alias("to"), F.col("component").alias("then"))
        found = points.join(after, "to", "left").select("node", F.coalesce("then", "to").alias("component"))
    return stored(found)


def join_by_class(rows: DataFrame, classes: DataFrame, keys: list[str], copies: str, how: str = "inner", hot_rows: int = 100_000) -> DataFrame:
    """rows joined to classes (unique on `keys`, with about their number of rows in `copies`), inner or left.

    Few classes (by count) are broadcast. Else classes of more than hot_rows rows, of which there are at most
    rows / hot_rows, meet their rows apart from the others, which shuffle with no key above hot_rows rows.
    """
    classes = stored(classes)
    if classes.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(classes), keys, how)
    hot = sized(classes.where(F.col(copies) > hot_rows))
    cold = classes.where(F.col(copies) <= hot_rows)
    return rows.join(hot.select(*keys), keys, "left_anti").join(cold, keys, how).unionByName(rows.join(hot, keys))


def others(df: DataFrame, *new: str) -> list[str]:
    """The columns of df that stay beside new ones: a column named like a new one (in any case) gives way to it."""
    taken = {c.lower() for c in new}
    return [c for c in df.columns if c.lower() not in taken]


def _values(column) -> list:
    """An Arrow column as a list; lists of numbers as numpy arrays (which share its memory)."""
    import pyarrow as pa

    if not pa.types.is_list(column.type) or not pa.types.is_integer(column.type.value_type) or column.null_count or column.values.null_count:
        return column.to_pylist()
    values, at = column.values.to_numpy(), column.offsets.to_pylist()
    return [values[a:b] for a, b in zip(at, at[1:])]


def _slices(batch, n_kept: int, slice_bytes: int):
    """(first row, rows) of slices of a batch whose input values take at most slice_bytes, or of one row: cut by the rows' own sizes."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    sizes = np.zeros(batch.num_rows, dtype=np.int64)
    for column in batch.columns[n_kept:]:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            sizes += np.asarray(pc.binary_length(column).fill_null(0), dtype=np.int64)
        else:
            sizes += np.array([column.slice(i, 1).nbytes for i in range(len(column))], dtype=np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        after = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + slice_bytes, side="right")))
        yield at, after - at
        at = after


def give_back() -> None:
    """Hand memory that is free in this Python worker back to the system: workers are used again, and idle ones keep what they have."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def append_columns(df: DataFrame, inputs: list[str], outputs: str, start, keep: list[str] | None = None, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """df's columns `keep` (default all) and the columns of the DDL string `outputs`, made by a Python function in each task.
    A column of df that is named like an output gives way to it.

    `start()` runs once per task and returns a function from lists of input values to lists of output values, one
    list per column; it is called on slices of at most slice_bytes (or one row), so memory does not follow the batch size. What the
    function's `close` attribute names, if it has one, is called at the end of the task.
    """
    fields = T.StructType.fromDDL(outputs).fields
    kept = others(df.select(*[F.col(f"`{c}`") for c in (df.columns if keep is None else keep)]), *[f.name for f in fields])
    source = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)], *[F.col(f"`{c}`").alias(f"i{i}") for i, c in enumerate(inputs)])
    inner = T.StructType([T.StructField(f"k{i}", source.schema[i].dataType) for i in range(len(kept))] + [T.StructField(f"o{i}", f.dataType) for i, f in enumerate(fields)])
    n_kept = len(kept)

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(f.dataType) for f in fields]
        call = start()
        try:
            for batch in batches:
                for at, rows in _slices(batch, n_kept, slice_bytes):
                    part = batch.slice(at, rows)
                    made = call(*[_values(part.column(i)) for i in range(n_kept, part.num_columns)])
                    yield pa.RecordBatch.from_arrays(
                        part.columns[:n_kept] + [v if isinstance(v, pa.Array) else pa.array(v, t) for v, t in zip(made, types, strict=True)], inner.names)
                    del part, made
        finally:
            getattr(call, "close", int)()
            del call
            give_back()

    done = source.mapInArrow(run, inner)
    return done.toDF(*kept, *[f.name for f in fields])
