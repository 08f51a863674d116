"""Line dedup: lines that occur in many documents stay in one of them only. DataFrame functions throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tabcal.llm.common import SPACES, ascii_lower, hash128, join_by_class, others, stored, table, unused

MIN_CHARS, MIN_DOCS = 20, 3


def line_keys(text: Column) -> Column:
    """The lines of a text without white space at their ends, A-Z lower-cased."""
    return F.transform(F.split(ascii_lower(text), "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)))


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
    total_col: str = "n_lines", dropped_col: str = "n_dropped",
) -> DataFrame:
    """docs with text_col rewritten and two counts added.

    A key (see line_keys) of at least min_chars code points found in at least min_docs documents loses its lines
    except in the document with the largest id that holds it; the other lines stay, in their order.
    Null or empty text: one empty line, kept as the empty string. A null id is one document, which keeps a line only
    if no other holds it. Rows that share an id are one document: they count once and keep or lose a line together.
    Empty table: empty result. Other columns pass through.

    Lines are hashed to 128 bits per document; only the hashes are counted, by (hash, id) and then by hash, so a line that
    sits in every document is combined before the shuffle, and frequent lines meet their places without one. The rows return by (id, text hash), so that only the
    places of dropped lines, not the lines, are shuffled and sorted back to their document.
    """
    lines, places, ident, h1, h2, own1, own2 = unused(docs, "_lines", "_places", "_id", "_t1", "_t2", "_own1", "_own2")
    text = F.coalesce(F.col(text_col), F.lit(""))
    t1, t2 = hash128(text)
    hashes = F.transform(line_keys(text), lambda key: _key_hash(key, min_chars))
    keyed = stored(docs.select(F.col(id_col).alias("id"), t1.alias("t1"), t2.alias("t2"), hashes.alias("hashes")).where(
        F.exists("hashes", lambda x: x.isNotNull())))
    own = F.array_distinct(F.filter("hashes", lambda x: x.isNotNull()))
    per_doc = keyed.select("id", F.explode(own).alias("h")).select("id", "h.a", "h.b").distinct()
    common = per_doc.groupBy("a", "b").agg(F.count("*").alias("docs"), F.max("id").alias("keeper")).where(F.col("docs") >= min_docs)
    placed = keyed.select("id", "t1", "t2", F.posexplode("hashes").alias("place", "h")).where("h IS NOT NULL").select(
        "id", "t1", "t2", "place", "h.a", "h.b")
    lost = join_by_class(placed, common, ["a", "b"], "docs").where(~F.col("id").eqNullSafe(F.col("keeper")))
    lost = lost.groupBy("id", "t1", "t2").agg(F.collect_set("place").alias(places))
    lost = lost.withColumnsRenamed({"id": ident, "t1": h1, "t2": h2})

    split = docs.withColumn(lines, F.split(text, "\n", -1)).withColumn(own1, t1).withColumn(own2, t2)
    joined = split.join(
        lost, F.col(id_col).eqNullSafe(F.col(ident)) & (F.col(own1) == F.col(h1)) & (F.col(own2) == F.col(h2)), "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(places))
    kept = F.when(F.col(places).isNull(), text).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col(lines), i)), "\n"))
    return joined.select(
        *[kept.alias(c) if c == text_col else F.col(f"`{c}`") for c in others(docs, total_col, dropped_col)],
        F.size(lines).cast("long").alias(total_col), F.coalesce(F.size(F.col(places)), F.lit(0)).cast("long").alias(dropped_col),
    )


def _key_hash(key: Column, min_chars: int) -> Column:
    a, b = hash128(key)
    return F.when(F.length(key) >= min_chars, F.struct(a.alias("a"), b.alias("b")))


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    kept = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""WITH l AS (SELECT doc_id, i, x, trim(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
   ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k
 FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
c AS (SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT l.doc_id, l.i, l.x, c.k IS NOT NULL AND l.doc_id <> c.keeper AS gone FROM l LEFT JOIN c ON l.k = c.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
 sha256(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id"""

QUERIES = {"op1_line_dedup": (op1_line_dedup, SQL)}
