"""Document fingerprints: a Merkle tree over the pieces, paragraphs and sections of a text."""

from __future__ import annotations

import re
from collections import Counter
from hashlib import blake2b, sha256
from zlib import crc32

from pyspark.sql import DataFrame, functions as F

from tabcal.llm.common import append_columns, stored, table

#: A piece is a sentence of a paragraph (a line), or this many code points of a longer one and what ends it.
PIECE_CHARS = 24
#: Fixed width of a piece in a fingerprint: four characters of hash, one of length.
PIECE_CODE = 5
_CODE = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz-_"
_LENGTH = {c: i for i, c in enumerate(_CODE)}
_PIECE = re.compile(r"[^.!?\n]{1,%d}[.!?]{0,9}[^\S\n]?|[.!?]{1,%d}[^\S\n]?" % (PIECE_CHARS, PIECE_CHARS))
#: A section ends after a blank line, or after a paragraph whose hash is divisible by this.
SECTION = 8
#: Rows of one sorted range, bounds of the number of ranges, rows drawn for each split point.
RANGE_ROWS, LEAST_RANGES, MOST_RANGES, SAMPLED = 4_096, 256, 65_536, 8


def _digest(data: bytes, size: int) -> bytes:
    return blake2b(data, digest_size=size).digest()


def piece_code(piece: str) -> str:
    h = crc32(piece.encode())
    return _CODE[h & 63] + _CODE[h >> 6 & 63] + _CODE[h >> 12 & 63] + _CODE[h >> 18 & 63] + _CODE[len(piece)]


def tree(text: str) -> list[list[tuple[str, str]]]:
    """Sections of paragraphs; a paragraph is (its text with its line break, the codes of its pieces). Every character is in one
    piece; the line break that ends a paragraph belongs to its last piece."""
    sections: list[list[tuple[str, str]]] = [[]]
    lines, last, blank = text.split("\n"), 1, False
    for number, line in enumerate(lines):
        pieces = _PIECE.findall(line)
        if number + 1 < len(lines):
            pieces = [*pieces[:-1], pieces[-1] + "\n"] if pieces else ["\n"]
            paragraph = line + "\n"
        elif not line:
            break
        else:
            paragraph = line
        if sections[-1] and (blank or last % SECTION == 0):
            sections.append([])
        sections[-1].append((paragraph, "".join(map(piece_code, pieces))))
        last, blank = crc32(paragraph.encode()), not line.strip()
    return sections


def fingerprint(text: str) -> str:
    """root:section/section/... where a section is paragraph;paragraph;... and a paragraph the codes of its pieces.

    The root is a 128-bit hash over the sections' hashes, those over their paragraphs' hashes, those over the paragraphs' whole
    texts: equal texts have equal fingerprints, and equal roots mean equal texts.
    """
    sections = tree(text)
    nodes = [_digest(b"".join(_digest(p.encode(), 16) for p, _ in section), 16) for section in sections]
    return f"{_digest(b''.join(nodes), 16).hex()}:{'/'.join(';'.join(codes for _, codes in section) for section in sections)}"


def root(print_: str) -> str:
    return print_[:32]


def size_of(codes: str) -> int:
    """Code points of a run of piece codes."""
    return sum(map(_CODE.index, codes[PIECE_CODE - 1::PIECE_CODE]))


def leaves(print_: str) -> Counter:
    """Number of pieces by code, from a fingerprint."""
    body = print_[33:].replace("/", "").replace(";", "")
    return Counter([body[i:i + PIECE_CODE] for i in range(0, len(body), PIECE_CODE)])


def likeness(a: Counter, b: Counter) -> float:
    """Share of the code points of both texts that lie in pieces common to both; two empty texts are alike."""
    size = lambda c: sum(n * _LENGTH[k[-1]] for k, n in c.items())
    total = size(a) + size(b)
    if not total:
        return 1.0
    few, many = (a, b) if len(a) < len(b) else (b, a)
    return 2 * sum(min(n, many[k]) * _LENGTH[k[-1]] for k, n in few.items() if k in many) / total


def locate_edits(a: str, b: str) -> list[tuple[int, int]]:
    """(start, end) code points of the first text in paragraphs that the second lacks: equal roots end at once, equal sections
    are passed over."""
    if root(a) == root(b):
        return []
    other = b[33:].split("/")
    sections, paragraphs = Counter(other), Counter(p for s in other for p in s.split(";"))
    edits, at = [], 0
    for section in a[33:].split("/"):
        same = sections[section] > 0
        sections[section] -= same
        for paragraph in section.split(";"):
            size = size_of(paragraph)
            if same or paragraphs[paragraph] > 0:
                paragraphs[paragraph] -= 1
            elif size:
                edits.append((at, at + size))
            at += size
    return edits


def fingerprint_documents(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, out_col: str = "fingerprint") -> DataFrame:
    """docs with the fingerprint of each text. Null text is empty. Rows are independent; nothing is shuffled."""
    return append_columns(docs, [text_col], f"{out_col} string", lambda: lambda texts: ([fingerprint(t or "") for t in texts],), keep)


def _ranges(keys: DataFrame) -> list[tuple]:
    """Split points (known, id, hash) of about even ranges, from the rows with the smallest hashes. They decide where the work
    is cut, never a result; there are at most MOST_RANGES."""
    n = min(MOST_RANGES, max(LEAST_RANGES, keys.count() // RANGE_ROWS))
    drawn = keys.select("id", "h", F.xxhash64("id", "h").alias("draw")).orderBy("draw").limit(SAMPLED * n)
    sample = sorted((r["id"] is not None, r["id"] or 0, r["h"]) if r["id"] is not None else (False, 0, r["h"]) for r in drawn.collect())
    lowest = keys.agg(F.min(F.struct("id", "h")).alias("m")).first()["m"]
    if lowest is None:
        return []
    first = (lowest["id"] is not None, lowest["id"] if lowest["id"] is not None else 0, lowest["h"])
    return [first, *sorted({sample[len(sample) * i // n] for i in range(1, n)} - {first})]


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's fingerprint, that of an edited text, and the likeness of both and of the next row's text.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next row's text.
    Rows go by id (null first), rows of one id by a hash of their text; the last row's next is the first. Null text is empty;
    repeated rows are rows of their own. Columns: id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next; other columns are not read. Empty table: empty result.

    Rows are cut into ranges of (id, hash). The first row of a range also goes to the range before it, that of the first
    range to the last, so one shuffle of the texts brings each row to its next.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("h"))
    starts = _ranges(stored(rows.select("id", "h")))
    kind = docs.schema[id_col].dataType.simpleString()

    def deal(batches):
        from bisect import bisect_right

        import numpy as np
        import pyarrow as pa

        begins = {k: i for i, k in enumerate(starts)}
        for batch in batches:
            take, ranges, after = [], [], []
            for row, (i, h) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                key = (i is not None, 0 if i is None else i, h)
                at = bisect_right(starts, key) - 1
                take.append(row)
                ranges.append(at)
                after.append(0)
                if key in begins:
                    take.append(row)
                    ranges.append(at - 1 if at else len(starts) - 1)
                    after.append(1)
            part = batch.take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(np.array(ranges, np.int32)), pa.array(np.array(after, np.int32))], ["id", "text", "h", "range", "after"])

    def walk(batches):
        import pyarrow as pa

        names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        held = None  # the row that waits for its next: range, id, text, fingerprint, leaves
        for batch in batches:
            out = [[] for _ in names]
            for i, text, number, after in zip(*[batch.column(k).to_pylist() for k in (0, 1, 3, 4)], strict=True):
                if after and held is None:
                    continue
                own = fingerprint(text)
                own_leaves = leaves(own)
                if held is not None:
                    _, was, old, old_print, old_leaves = held
                    half = len(old) // 2
                    edited = old[:len(old) - half] + text[:half]
                    edited_print = fingerprint(edited)
                    row = (was, len(old), sha256(edited.encode()).hexdigest(), old_print, edited_print,
                           likeness(old_leaves, leaves(edited_print)), likeness(old_leaves, own_leaves))
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                held = None if after else (number, i, text, own, own_leaves)
            kinds = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], names)

    dealt = rows.mapInArrow(deal, f"id {kind}, text string, h bigint, range int, after int")
    ordered = dealt.repartition("range").sortWithinPartitions("range", "after", "id", "h", "text")
    return ordered.mapInArrow(
        walk, f"id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    ).withColumnRenamed("id", id_col)


def op10_document_fingerprint(spark, sf_dir: str) -> DataFrame:
    return compare_with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op10_document_fingerprint": (op10_document_fingerprint, None)}
