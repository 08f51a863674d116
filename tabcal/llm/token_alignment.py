"""Alignment of two tokenizers: which tokens overlap, with counts of id pairs from inverted, compressed document bitmaps.

Blocks of documents are encoded by both tokenizers. Per block an inverted index maps each id pair to planes of document bitmaps
(plane k holds the documents in which 2^k is part of the pair's number of links). ORed planes count documents, popcounts of planes
weighted by 2^k count links; the counts of all blocks go back along the postings to the documents.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F, types as T

from tabcal.llm.common import give_back, sized, stored, table

TOKENIZER_A = "/opt/tokenizers/byte_bpe_50k.json"
TOKENIZER_B = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text in a block (one more document at most), and bytes encoded at once.
BLOCK_BYTES, STEP_BYTES = 4 << 20, 1 << 19
#: A pair in more than one in so many documents of a block has bits instead of a list of documents.
DENSE = 16
# Fixed value: how byte-level tokenizers cut texts into words before merging.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts of these characters, whose classes are the same in all Unicode versions, are encoded by merging ranks.
COMMON = re.compile("[\t\n\r -~\u00a1-\u024f\u2010-\u2027]*")


def byte_letters() -> dict[str, int]:
    """The printable characters that byte-level tokenizers write for the 256 bytes: printable Latin-1 for itself, others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers and the bytes of their ids."""

    def __init__(self, model_a: str, model_b: bytes):
        import os

        import numpy as np
        from sentencepiece import SentencePieceProcessor

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(model_a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=model_b)
        letters, special = byte_letters(), {t["content"] for t in json.loads(model_a).get("added_tokens", [])}
        vocabulary = self.a.get_vocab()
        self.merging = self._merging(json.loads(model_a), letters)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = token.encode() if token in special else bytes(letters[c] for c in token)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(s[3:5], 16)]) if self.b.is_byte(i) else s.replace("▁", " ").encode() for i, s in enumerate(names)]
        self.size_a, self.size_b = (np.array([len(x) for x in table], dtype=np.int64) for table in (self.bytes_a, self.bytes_b))
        # Ids as text, then the same with what may follow them: another id, the other side, another group.
        self.text_a = [f"{i}{mark}".encode() for mark in ",|" for i in range(len(self.bytes_a))]
        self.text_b = [f"{i}{mark}".encode() for mark in ",;" for i in range(len(self.bytes_b))]

    def _merging(self, model: dict, letters: dict[str, int]):
        """A as an encoder that merges neighbours by the rank of what they make, which is several times faster; None if it may differ.

        It takes any two neighbours that make a token, the tokenizer only listed ones. They agree if ids follow the order of merges and
        every token's own bytes are encoded as that token: two other neighbours that make it would then have stood side by side there too,
        and stayed so.
        """
        import tiktoken

        cut, bpe = model.get("pre_tokenizer") or {}, model.get("model") or {}
        plain = model.get("normalizer") is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
        odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
        if not plain or bpe.get("type") != "BPE" or any(bpe.get(k) for k in odd):
            return None
        merged = [bpe["vocab"].get("".join(m.split(" ") if isinstance(m, str) else m)) for m in bpe["merges"]]
        ranks = {bytes(letters[c] for c in token): i for token, i in bpe["vocab"].items()}
        ordered = None not in merged and all(x < y for x, y in zip(merged, merged[1:])) and all(bytes([b]) in ranks for b in range(256))
        if not ordered or len(ranks) != 256 + len(merged) or any(len(self.a.model.tokenize(token)) != 1 for token in bpe["vocab"]):
            return None
        return tiktoken.Encoding("a", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})

    def _ids_a(self, texts: list[str]) -> list:
        """Ids of space+text; lists or arrays."""
        out: list = [None] * len(texts)
        rest = []
        for i, t in enumerate(texts):
            if self.merging is not None and COMMON.fullmatch(t):
                out[i] = self.merging.encode_to_numpy(" " + t, disallowed_special=())
            else:
                rest.append(i)
        for i, coded in zip(rest, self.a.encode_batch_fast([" " + texts[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = coded.ids
        return out

    def encode(self, texts: list[str | None]) -> list[tuple]:
        """(ids of A, ids of B) per text; none where the text is empty or a tokenizer doesn't give the bytes of space+text."""
        plain, out = [t or "" for t in texts], []
        for t, a, b in zip(plain, self._ids_a(plain), self.b.encode(plain, num_threads=1), strict=True):
            whole = b" " + t.encode()
            same = t != "" and b"".join(map(self.bytes_b.__getitem__, b)) == whole
            same = same and b"".join(map(self.bytes_a.__getitem__, a if isinstance(a, list) else a.tolist())) == whole
            out.append((a, b) if same else ([], []))
        return out

    def align(self, texts: list[str | None]):
        """Per text the numbers of tokens, groups and links and the digest of the groups; and (text, pair of ids, links) of all."""
        import numpy as np

        coded = self.encode(texts)
        n_a, n_b = (np.array([len(x[k]) for x in coded], dtype=np.int64) for k in (0, 1))
        a, b = (np.concatenate([np.zeros(0, dtype=np.int64), *[np.asarray(x[k], dtype=np.int64) for x in coded]]) for k in (0, 1))
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        start_a, start_b = end_a - self.size_a[a], end_b - self.size_b[b]
        # Two tokens overlap in one stretch between neighbouring borders, and each stretch lies in one token of either side.
        borders = np.union1d(start_a, start_b)
        in_a, in_b = np.searchsorted(start_a, borders, "right") - 1, np.searchsorted(start_b, borders, "right") - 1
        of_a, of_b = np.repeat(np.arange(len(texts)), n_a), np.repeat(np.arange(len(texts)), n_b)
        n_links = np.bincount(of_a[in_a], minlength=len(texts)) if len(borders) else np.zeros(len(texts), dtype=np.int64)
        last_a, last_b = np.isin(end_a, end_b), np.isin(end_b, end_a)  # the last token of its group
        n_groups = np.bincount(of_a[last_a], minlength=len(texts))
        written = self._written(a, b, last_a, last_b, n_a, n_b)
        digests = [hashlib.sha256(w).hexdigest() if w else "" for w in written]
        pairs, place = np.unique(a[in_a] << 32 | b[in_b], return_inverse=True)
        entries, links = np.unique(place * len(texts) + of_a[in_a], return_counts=True)
        return (n_a, n_b, n_groups, n_links, digests), (entries % len(texts), pairs[entries // len(texts)], links)

    def _written(self, a, b, last_a, last_b, n_a, n_b) -> list[bytes]:
        """The groups of each text: ids of A, a bar, ids of B, a semicolon."""
        import numpy as np

        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        words = np.empty(len(a) + len(b), dtype=object)
        before = np.searchsorted(group_b, group_a, "left")  # tokens of B in earlier groups
        after = np.searchsorted(group_a, group_b, "right")  # tokens of A in groups up to this one
        words[np.arange(len(a)) + before] = [self.text_a[i] for i in (a + last_a * len(self.bytes_a)).tolist()]
        words[np.arange(len(b)) + after] = [self.text_b[i] for i in (b + last_b * len(self.bytes_b)).tolist()]
        ends = np.cumsum(n_a + n_b).tolist()
        return [b"".join(words[lo:hi].tolist())[:-1] for lo, hi in zip([0, *ends[:-1]], ends, strict=True)]


class Postings:
    """Pairs of a block in ascending order, each with planes of compressed document bitmaps: sparse ones as lists of documents,
    dense ones as bits."""

    def __init__(self, pairs, n_docs: int, planes: list[tuple]):
        self.pairs, self.n_docs, self.planes = pairs, n_docs, planes

    @classmethod
    def of(cls, docs, pairs, links, n_docs: int) -> Postings:
        """From entries (document, pair, links), each document and pair once."""
        import numpy as np

        order = np.lexsort((docs, pairs))
        docs, pairs, links = docs[order], pairs[order], links[order]
        distinct, place = np.unique(pairs, return_inverse=True)
        planes = []
        for k in range(int(links.max(initial=0)).bit_length()):
            has = (links >> k & 1).astype(bool)
            planes.append(cls._plane(docs[has], place[has], len(distinct), n_docs))
        return cls(distinct, n_docs, planes)

    @staticmethod
    def _plane(docs, place, n_pairs: int, n_docs: int):
        """(number of documents per sparse pair, its documents, dense pairs, their bits)."""
        import numpy as np

        sizes = np.bincount(place, minlength=n_pairs)
        dense = np.nonzero(sizes * DENSE > max(n_docs, DENSE))[0]
        row = np.full(n_pairs, -1)
        row[dense] = np.arange(len(dense))
        is_dense = row[place] >= 0
        bits = np.zeros((len(dense), -(-n_docs // 8)), dtype=np.uint8)
        np.bitwise_or.at(bits, (row[place[is_dense]], docs[is_dense] >> 3), (1 << (docs[is_dense] & 7)).astype(np.uint8))
        sizes[dense] = 0
        return sizes.astype(np.int32), docs[~is_dense].astype(np.int32), dense.astype(np.int32), bits

    def link_counts(self):
        """Links of each pair: popcounts of the planes, plane k times 2^k."""
        import numpy as np

        total = np.zeros(len(self.pairs), dtype=np.int64)
        for k, (sizes, _, dense, bits) in enumerate(self.planes):
            total += sizes.astype(np.int64) << k
            total[dense] += np.bitwise_count(bits).sum(axis=1, dtype=np.int64) << k
        return total

    def document_counts(self):
        """Documents of each pair: the popcount of its ORed planes."""
        import numpy as np

        total, width = np.zeros(len(self.pairs), dtype=np.int64), -(-self.n_docs // 8)
        lists, rows = [np.zeros(0, dtype=np.int64)], {}
        for sizes, docs, dense, bits in self.planes:
            lists.append(np.repeat(np.arange(len(self.pairs)), sizes) * self.n_docs + docs)
            for pair, own in zip(dense.tolist(), bits, strict=True):
                rows[pair] = rows[pair] | own if pair in rows else own
        flat = np.unique(np.concatenate(lists))
        pair, doc = flat // max(1, self.n_docs), flat % max(1, self.n_docs)
        joined = np.array(sorted(rows), dtype=np.int64)
        bits = np.vstack([rows[p] for p in joined.tolist()]) if rows else np.zeros((0, width), dtype=np.uint8)
        at = np.searchsorted(joined, pair)
        in_bits = np.isin(pair, joined)
        bits = bits.copy()
        np.bitwise_or.at(bits, (at[in_bits], doc[in_bits] >> 3), (1 << (doc[in_bits] & 7)).astype(np.uint8))
        total += np.bincount(pair[~in_bits], minlength=len(self.pairs))
        total[joined] += np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        return total

    def scores(self, values):
        """Per document the sum of its pairs' values, each as often as the pair is linked in it."""
        import numpy as np

        out = np.zeros((self.n_docs, values.shape[1]), dtype=np.int64)
        for k, (sizes, docs, dense, bits) in enumerate(self.planes):
            given = values << k
            np.add.at(out, docs, given[np.repeat(np.arange(len(self.pairs)), sizes)])
            for pair, own in zip(dense.tolist(), bits, strict=True):
                out[np.nonzero(np.unpackbits(own, count=self.n_docs, bitorder="little"))[0]] += given[pair]
        return out

    def pack(self) -> bytes:
        import numpy as np

        parts = [np.array([self.n_docs, len(self.pairs), len(self.planes)], dtype=np.int64).tobytes(), self.pairs.astype(np.int64).tobytes()]
        for sizes, docs, dense, bits in self.planes:
            parts += [np.array([len(docs), len(dense)], dtype=np.int64).tobytes(), sizes.tobytes(), docs.tobytes(), dense.tobytes(), bits.tobytes()]
        return zlib.compress(b"".join(parts), 1)

    @classmethod
    def unpack(cls, packed: bytes) -> Postings:
        import numpy as np

        data, at = zlib.decompress(packed), 0

        def take(kind, n):
            nonlocal at
            out = np.frombuffer(data, dtype=kind, count=n, offset=at)
            at += out.nbytes
            return out

        n_docs, n_pairs, n_planes = take(np.int64, 3).tolist()
        pairs, planes, width = take(np.int64, n_pairs), [], -(-n_docs // 8)
        for _ in range(n_planes):
            n_sparse, n_dense = take(np.int64, 2).tolist()
            planes.append((take(np.int32, n_pairs), take(np.int32, n_sparse), take(np.int32, n_dense), take(np.uint8, n_dense * width).reshape(n_dense, width)))
        return cls(pairs, n_docs, planes)


@dataclass
class Alignment:
    """documents: the columns of docs kept, and their numbers; pairs: (id_a, id_b, links, documents, best) of the whole corpus."""

    documents: DataFrame
    pairs: DataFrame


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")
_MADE = (*_COUNTS, "groups_sha256", "n_best", "count_sum")


def _blocks(docs: DataFrame, names: list[str], text: str, model_a: str, model_b: str, block_bytes: int) -> DataFrame:
    """One row per block of documents: their kept columns and numbers as arrays, the block's pairs with counts, and its postings."""
    with open(model_a, encoding="utf-8") as f, open(model_b, "rb") as g:
        models = docs.sparkSession.sparkContext.broadcast((f.read(), g.read()))
    kept = T.StructType([T.StructField(f"k{i}", docs.schema[c].dataType) for i, c in enumerate(names)])
    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("rows", T.ArrayType(kept) if names else T.IntegerType()),
        *[T.StructField(c, T.ArrayType(T.LongType())) for c in _COUNTS], T.StructField("groups_sha256", T.ArrayType(T.StringType())),
        *[T.StructField(c, T.ArrayType(T.LongType())) for c in ("pairs", "links", "documents")], T.StructField("postings", T.BinaryType())])

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        # A task loads both tokenizers and gives their memory back: workers are used again by stages that need none.
        coder, arrow, number = None, to_arrow_schema(schema), TaskContext.get().partitionId() << 32
        for batch in batches:
            coder = coder or Tokenizers(*models.value)
            sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(0)), 0), dtype=np.int64) + 64
            ends = np.cumsum(sizes)
            at = 0
            while at < batch.num_rows:
                floor = ends[at] - sizes[at]
                stop = min(batch.num_rows, int(np.searchsorted(ends, floor + block_bytes, "left")) + 1)
                made, entries, lo = [], [], at
                while lo < stop:
                    hi = min(stop, int(np.searchsorted(ends, ends[lo] - sizes[lo] + STEP_BYTES, "left")) + 1)
                    numbers, (docs_of, pairs, links) = coder.align(batch.column(0).slice(lo, hi - lo).to_pylist())
                    made.append(numbers)
                    entries.append((docs_of + (lo - at), pairs, links))
                    lo = hi
                postings = Postings.of(*[np.concatenate(x) for x in zip(*entries, strict=True)], stop - at)
                own = batch.slice(at, stop - at)
                rows = own.columns[1] if not names else pa.StructArray.from_arrays(own.columns[1:], fields=list(arrow.field("rows").type.value_type))
                row = {
                    "block": pa.array([number], pa.int64()),
                    "rows": pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows) if names else pa.array([len(rows)], pa.int32()),
                    **{c: pa.array([np.concatenate([m[i] for m in made])], pa.list_(pa.int64())) for i, c in enumerate(_COUNTS)},
                    "groups_sha256": pa.array([[d for m in made for d in m[4]]], pa.list_(pa.string())),
                    "pairs": pa.array([postings.pairs], pa.list_(pa.int64())), "links": pa.array([postings.link_counts()], pa.list_(pa.int64())),
                    "documents": pa.array([postings.document_counts()], pa.list_(pa.int64())), "postings": pa.array([postings.pack()], pa.binary()),
                }
                yield pa.RecordBatch.from_arrays([row[f.name].cast(f.type) if f.name != "rows" else row["rows"] for f in arrow], schema=arrow)
                number, at = number + 1, stop
                del made, entries, postings, row
        del coder
        give_back()

    source = docs.select(F.col(f"`{text}`").alias("text"), *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(names)])
    return stored(source.mapInArrow(run, schema))


def _scores(blocks, pairs):
    """Per block: what its postings give its documents, from the corpus-wide count of each pair and whether it is its B id's best."""
    import numpy as np
    import pandas as pd

    if not len(blocks):
        return pd.DataFrame({"block": [], "n_best": [], "count_sum": []})
    postings = Postings.unpack(blocks["postings"].iloc[0])
    values = np.zeros((len(postings.pairs), 2), dtype=np.int64)
    at = np.searchsorted(postings.pairs, pairs["pair"].to_numpy(np.int64))
    values[at, 0], values[at, 1] = pairs["best"].to_numpy(np.int64), pairs["links"].to_numpy(np.int64)
    got = postings.scores(values)
    return pd.DataFrame({"block": [blocks["block"].iloc[0]], "n_best": [got[:, 0]], "count_sum": [got[:, 1]]})


def align_tokenizers(
    docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, tokenizer_a: str = TOKENIZER_A, tokenizer_b: str = TOKENIZER_B,
    block_bytes: int = BLOCK_BYTES,
) -> Alignment:
    """docs (or its columns `keep`) with n_a, n_b (tokens), n_groups, n_links, n_best, count_sum and groups_sha256, and the pairs of ids.

    A encodes space+text, B (which adds the space itself) the text; strings of special tokens are plain text. Places where tokens
    of both end cut them into groups; an A and a B token are linked where their bytes overlap; a pair's count is its number of links in
    the whole corpus. n_best counts links whose pair has the highest count of its B id (all of equal ones), count_sum adds the counts.

    Null and empty texts, and texts whose tokens do not give back space+text in both, have no tokens: zeros and an empty digest. Rows
    are independent, so null or repeated ids and repeated rows change nothing but the counts. Columns named like a new one give way to it;
    other names are free. Empty table: empty results. Very long texts are encoded whole; a text is never cut.

    Shuffled are a block's pairs with their counts (far fewer than its links) and its postings; a pair is in a block once, so no key
    has more rows than there are blocks. Model files are paths on the driver; their content goes to the tasks.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() not in _MADE]
    blocks = _blocks(docs, names, text_col, tokenizer_a, tokenizer_b, block_bytes)
    held = blocks.select(F.col("block").alias("in_block"), F.explode(F.arrays_zip("pairs", "links", "documents")).alias("p")).select("in_block", "p.*")
    counts = held.groupBy(F.col("pairs").alias("pair")).agg(F.sum("links").alias("links"), F.sum("documents").alias("documents"))
    counts = stored(counts.withColumns({"id_a": F.shiftright("pair", 32), "id_b": F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))}))
    # One row per id of B: as many as its vocabulary has.
    top = sized(counts.groupBy("id_b").agg(F.max("links").alias("top")))
    pairs = stored(counts.join(top, "id_b").select("pair", "id_a", "id_b", "links", "documents", (F.col("links") == F.col("top")).alias("best")))
    back = held.select("in_block", F.col("pairs").alias("pair")).join(pairs.select("pair", "links", "best"), "pair")
    scored = blocks.select("block", "postings").groupBy("block").cogroup(back.groupBy("in_block")).applyInPandas(
        _scores, "block long, n_best array<long>, count_sum array<long>")
    parts = [*_COUNTS, "groups_sha256", "n_best", "count_sum"]
    joined = blocks.select("block", *(["rows"] if names else []), *_COUNTS, "groups_sha256").join(scored, "block")
    rows = joined.select(F.explode(F.arrays_zip(*(["rows"] if names else []), *parts)).alias("r"))
    documents = rows.select(*[F.col(f"r.rows.k{i}").alias(c) for i, c in enumerate(names)], *[F.col(f"r.{c}").alias(c) for c in parts])
    return Alignment(documents, pairs.drop("pair"))


def op13_token_alignment(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return align_tokenizers(docs, keep=["doc_id"]).documents


QUERIES = {"op13_token_alignment": (op13_token_alignment, None)}
