"""Tokenizer alignment against a plain walk over all token pairs, and postings against plain counters."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tabcal.llm.token_alignment import COMMON, TOKENIZER_A, TOKENIZER_B, Postings, Tokenizers, align_tokenizers, byte_letters


def spans(pieces):
    at, out = 0, []
    for p in pieces:
        out.append((at, at + len(p)))
        at += len(p)
    return out


def naive(texts):
    """Per text (n_a, n_b, n_groups, n_links, n_best, count_sum, digest), and the pairs' links and documents."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(TOKENIZER_A)
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=TOKENIZER_B)
    letters = byte_letters()
    rows, counts, documents = [], Counter(), Counter()
    for text in texts:
        links, groups = [], []
        if text:
            ids_a = a.encode(" " + text, add_special_tokens=False).ids
            ids_b = b.encode(text)
            bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
            bytes_b = [bytes([int(b.id_to_piece(i)[1:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or not b"".join(bytes_a) == b"".join(bytes_b) == b" " + text.encode():
            rows.append(((0, 0, 0), [], ""))
            continue
        at_a, at_b = spans(bytes_a), spans(bytes_b)
        links = [(x, y) for x, (s, e) in zip(ids_a, at_a, strict=True) for y, (u, v) in zip(ids_b, at_b, strict=True) if s < v and u < e]
        cuts = sorted({e for _, e in at_a} & {e for _, e in at_b})
        low = 0
        for cut in cuts:
            groups.append(",".join(str(i) for i, (s, e) in zip(ids_a, at_a, strict=True) if low <= s and e <= cut) + "|"
                          + ",".join(str(i) for i, (s, e) in zip(ids_b, at_b, strict=True) if low <= s and e <= cut))
            low = cut
        counts.update(links)
        documents.update(set(links))
        rows.append(((len(ids_a), len(ids_b), len(cuts)), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    top = Counter()
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    return [(*n, len(k), sum(counts[p] == top[p[1]] for p in k), sum(counts[p] for p in k), d) for n, k, d in rows], counts, documents, top


TEXTS = [
    "The quick brown fox", "the quick  brown\n\nfox jumps", None, "", " ", "▁ marks are lost", "ünïcodé 日本語 \U0001f600 naïve", "<|endoftext|> and <s> here",
    "a" * 300, "word " * 200, "tab\tand\r\nnewline\x00nul", "The quick brown fox", "Ænima—dash…", "x", "​zero", "0123456789 3.14", "  leading", "trailing  ",
]


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_alignment_equals_the_walk_over_all_pairs(spark, block_bytes):
    made = align_tokenizers(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(2), keep=["doc_id"], block_bytes=block_bytes)
    rows, counts, documents, top = naive(TEXTS)
    got = {r["doc_id"]: (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in made.documents.collect()}
    assert got == dict(enumerate(rows))
    assert {(r["id_a"], r["id_b"]): (r["links"], r["documents"], r["best"]) for r in made.pairs.collect()} == {
        p: (n, documents[p], n == top[p[1]]) for p, n in counts.items()}


def test_repeated_rows_null_ids_other_columns_and_no_rows(spark):
    rows = [(None, "same text", 1, "k"), (None, "same text", 2, None), (5, None, 3, "z"), (5, "same text", None, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_links int, block string")
    made = align_tokenizers(docs).documents
    assert made.columns == ["doc_id", "text", "block", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    got = sorted(((r["doc_id"], r["text"], r["block"], r["n_links"], r["count_sum"]) for r in made.collect()), key=repr)
    n = got[0][3]
    assert n > 0 and [g[3] for g in got] == [0 if g[1] is None else n for g in got] and {g[2] for g in got} == {"k", None, "z", "y"}
    assert all(g[4] == (3 * n if g[1] else 0) for g in got)  # every link of the text is in three documents
    empty = align_tokenizers(docs.limit(0))
    assert empty.documents.collect() == [] and empty.pairs.collect() == []


def test_a_very_long_text_is_aligned_whole(spark):
    text = "long words and numbers 12345 " * 60_000
    made = align_tokenizers(spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string"), keep=["doc_id"]).documents
    got = {r["doc_id"]: r for r in made.collect()}
    assert got[1]["n_links"] == got[1]["n_a"] + got[1]["n_b"] - got[1]["n_groups"] and got[1]["n_a"] > 300_000


@pytest.mark.parametrize("seed", range(4))
def test_postings_equal_plain_counters(seed):
    rng = random.Random(seed)
    n_docs = rng.choice([1, 7, 40, 300])
    entries = {(rng.randrange(n_docs), rng.choice([3, 5, 2**40 + 1, rng.randrange(50)])): rng.randrange(1, 40) for _ in range(800)}
    docs, pairs = (np.array(x, dtype=np.int64) for x in zip(*entries, strict=True))
    made = Postings.unpack(Postings.of(docs, pairs, np.array(list(entries.values())), n_docs).pack())
    links, documents = Counter(), Counter()
    for (_, p), n in entries.items():
        links[p] += n
        documents[p] += 1
    assert dict(zip(made.pairs.tolist(), made.link_counts().tolist(), strict=True)) == dict(links)
    assert dict(zip(made.pairs.tolist(), made.document_counts().tolist(), strict=True)) == dict(documents)
    values = {p: (rng.randrange(1000), rng.randrange(2)) for p in links}
    want = np.zeros((n_docs, 2), dtype=np.int64)
    for (d, p), n in entries.items():
        want[d] += np.array(values[p]) * n
    assert (made.scores(np.array([values[p] for p in made.pairs.tolist()])) == want).all()


def test_merging_by_rank_equals_the_tokenizer():
    with open(TOKENIZER_A, encoding="utf-8") as f, open(TOKENIZER_B, "rb") as g:
        model_a, model_b = f.read(), g.read()
    both = Tokenizers(model_a, model_b)
    assert both.merging is not None
    rng = random.Random(2)
    letters = "aaeeiinnstthrEA  \t\n.,;'!?$&0123456789-_éèüßñÀž’—…¿"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 400))) for _ in range(300)]
    texts += [" ".join(rng.choice(["the", "don't", "we'LL", "naïve", "x" * 40, "  ", "\n\n", "3.14", "<|endoftext|>"]) for _ in range(50)) for _ in range(100)]
    assert all(COMMON.fullmatch(t) for t in texts)
    want = [x.ids for x in both.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
    assert [list(map(int, x)) for x in both._ids_a(texts)] == want
    both.merging = None
    assert [list(x) for x in both._ids_a(texts)] == want
    odd = ["日本", "a\u00a0b", "x\u2028y", "\x85", "\x1c"]
    assert not any(COMMON.fullmatch(t) for t in odd)


def test_a_model_that_might_differ_is_not_merged_by_rank():
    import json

    with open(TOKENIZER_A, encoding="utf-8") as f, open(TOKENIZER_B, "rb") as g:
        model, model_b = json.load(f), g.read()
    merges = model["model"]["merges"]
    model["model"]["merges"] = [merges[1], merges[0], *merges[2:]]
    assert Tokenizers(json.dumps(model), model_b).merging is None
