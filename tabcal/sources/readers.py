"""Readers: explicit schemas, multi-row headers, split tables, file fingerprints."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabcal.functions.text import nan_to_null
from tabcal.session import written

RECORD_BYTES = 64 << 20  # files up to this size are hashed as one record, larger ones as a stream


def load_table(spark: SparkSession, path: str, *, fmt: str = "parquet", schema=None, encoding: str = "UTF-8") -> DataFrame:
    """CSV (with header), JSON, ORC or Parquet; a missing path fails; NaN becomes NULL."""
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True).option("encoding", encoding)
    return nan_to_null(reader.load(path))


def clean_header_part(value: object) -> str:
    """Stripped, blanks collapsed; placeholder names become empty."""
    text = re.sub(r"\s+", " ", "" if value is None else str(value)).strip()
    return "" if text.lower() in ("", "nan", "none") or text.startswith("Unnamed") else text


def flatten_header(rows: Sequence[Sequence[object]], separator: str = " | ") -> list[str]:
    """One name per column from k header rows, repeated names suffixed _1, _2, ..."""
    names, seen = [], {}
    for parts in zip(*rows):
        kept: list[str] = []
        for part in map(clean_header_part, parts):
            if part and (not kept or kept[-1] != part):
                kept.append(part)
        name = separator.join(kept) or "column"
        count = seen.get(name, 0)
        seen[name] = count + 1
        names.append(f"{name}_{count}" if count else name)
    return names


def read_multi_header(
    spark: SparkSession, path: str, *, header_rows: int, keep_level: int | None = None, names: Sequence[str] | None = None,
    units_rows: int = 0, drop: Sequence[str] = (), encoding: str = "ISO-8859-1", separator: str = " | ",
) -> DataFrame:
    """CSV whose first rows are header levels (and units); every column is read as text.

    The first header_rows + units_rows lines of every file are removed by their place, whatever they hold; the names come
    from the first file by path.  Only header rows reach the driver.
    """
    raw = spark.read.option("header", False).option("encoding", encoding).csv(path)
    placed = raw.select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line")
    )
    # within a task lines are numbered in order, so a file's first lines are those next to its smallest number
    starts = placed.where("_block = 0").groupBy("_file").agg(F.min("_line").alias("_first"))
    first_file = starts.orderBy("_file").first()
    skipped = header_rows + units_rows
    top = [] if first_file is None else placed.where(
        (F.col("_file") == first_file["_file"]) & (F.col("_block") == 0) & (F.col("_line") < first_file["_first"] + header_rows)
    ).orderBy("_line").select(*raw.columns).collect()
    header = [list(row) for row in top]
    if names is None:
        names = [str(v) for v in header[keep_level]] if keep_level is not None else flatten_header(header, separator)
    is_header = (F.col("_block") == 0) & (F.col("_line") < F.col("_first") + skipped)
    rows = placed.join(starts, "_file").where(~is_header)
    return rows.select(*raw.columns).toDF(*names).drop(*drop)


def promote_first_row(df: DataFrame, order: str) -> DataFrame:
    """Use the first row (by ``order``, then by its place in the input) as column names and drop that row only.

    The numbered rows are written once, so the row that is read is the row that is dropped, whatever is computed again.
    """
    placed = written(df.withColumn("_line", F.monotonically_increasing_id()))
    first = placed.orderBy(order, "_line").first()
    names = [c if c == order else clean_header_part(first[c]) or c for c in df.columns]
    return placed.where(F.col("_line") != first["_line"]).drop("_line").toDF(*names)


def load_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One split of a partitioned table (only its folder is read); features, target and lineage stay in one row."""
    return spark.read.parquet(path).where(F.col("split") == split)


def _stream_sha256(path: str) -> str:
    """SHA-256 of one file, read in pieces where its path is known (local or any store that Arrow reaches)."""
    import hashlib

    from pyarrow import fs

    local = re.match("file:/+(/.*)", path.replace("file:/", "file:///", 1))
    store, place = (fs.LocalFileSystem(), local[1]) if local else fs.FileSystem.from_uri(path)
    digest = hashlib.sha256()
    with store.open_input_stream(place) as f:
        while piece := f.read(8 << 20):
            digest.update(piece)
    return digest.hexdigest()


def file_fingerprints(spark: SparkSession, path: str, record_bytes: int = RECORD_BYTES) -> DataFrame:
    """(file, bytes, sha256) of every file under a path; large files are hashed as a stream by the task that holds their path."""
    def stream(batches):
        for pdf in batches:
            yield pdf.assign(sha256=[_stream_sha256(p) for p in pdf["path"]])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    small = files.where(F.col("length") <= record_bytes).select("path", "length", F.sha2("content", 256).alias("sha256"))
    large = files.where(F.col("length") > record_bytes).select("path", "length").mapInPandas(stream, "path string, length long, sha256 string")
    return small.unionByName(large).select(
        F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), "sha256"
    )
