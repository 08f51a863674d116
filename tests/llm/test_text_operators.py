"""License scan, toxicity, pieces, chats and fingerprints against brute force, exact round trips and held-out accuracy."""

import hashlib
import math
import os
import random
import re
from collections import Counter

import pytest

from pyspark.sql import functions as F

from tabcal.llm import chat_format, license_scan, merkle, sentence_pieces, toxicity

SF = os.environ.get("TABCAL_TEST_SF", "/root/testdata/sf0.001")
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")
needs_model = pytest.mark.skipif(not os.path.isfile(sentence_pieces.MODEL), reason="needs the tokenizer files")
ODD = [None, "", " ", "\n", "a", "É", "x" * 5000, "word " * 3000, "\x00\x01", "é 😀 ​", "▁▁ a", "  two  spaces  ", "tab\tand\r\nline"]


def table(spark, texts, start=0):
    rows = [(start + i, t, "en", "score", "labels") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, LANG string, score string, Labels string")


# License scan

def base_places(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    found = [(i, label) for phrase, label in license_scan.PHRASES for i in range(len(w)) if w[i:i + len(phrase.split())] == phrase.split()]
    return len(w), len(found), min((i for i, _ in found), default=None), max((i for i, _ in found), default=None), ",".join(sorted({x for _, x in found}))


def license_texts():
    rng = random.Random(1)
    pool = "mit license apache general public gnu the of under terms a Ä9".split()
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(80)]
    return texts + ODD + ["MIT-License; the GNU GENERAL\npublic license", "mit license " * 2000, "mitlicense", "Apache, License"]


def test_base_phrases_equal_brute_force(spark):
    texts = license_texts()
    out = license_scan.scan_licenses(table(spark, texts))
    assert Counter(c.lower() for c in out.columns)["labels"] == 1
    for r in out.collect():
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base_places(texts[r["doc_id"]])
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1


def test_matching_statistics_equal_brute_force():
    rng = random.Random(2)
    for _ in range(30):
        sequences = [[b"abcde"[rng.randrange(4):][:1] for _ in range(rng.randint(1, 12))] for _ in range(3)]
        automaton = license_scan.Automaton(sequences)
        factors = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
        stream, state, length = [b"abcde"[rng.randrange(5):][:1] for _ in range(40)], 0, 0
        for i, token in enumerate(stream):
            state, length = automaton.step(state, length, token)
            assert length == max((k for k in range(i + 2) if tuple(stream[i + 1 - k:i + 1]) in factors or k == 0))
            if length:
                found = tuple(stream[i + 1 - length:i + 1])
                places = {(n, e) for n, s in enumerate(sequences) for e in range(len(s)) if tuple(s[e + 1 - length:e + 1]) == found and e + 1 >= length}
                assert set(automaton.places[state]) == places


def test_changed_templates_are_found_and_placed(spark):
    body = dict((label, text) for label, text in reversed(license_scan.TEMPLATES))
    words = body["bsd"].split()
    changed = "intro words " + " ".join(words[:20] + ["ACME"] + words[21:]) + " and more"
    out = {r["doc_id"]: r for r in license_scan.scan_licenses(table(spark, [changed, " ".join(words[:6]), "clean text"])).collect()}
    assert out[0]["labels"] == "bsd" and out[0]["base_labels"] == "" and 0.9 < out[0]["score"] < 1
    span = out[0]["license_spans"][0]
    assert span["start"] == 2 and span["end"] == 2 + len(license_scan.words(body["bsd"]))
    assert out[1]["labels"] == out[2]["labels"] == "" and out[2]["score"] == 0


def test_cut_templates_have_a_score_without_a_label(spark):
    body = dict((label, license_scan.words(text)) for label, text in reversed(license_scan.TEMPLATES))
    cut = {k: b" ".join(body[k][:len(body[k]) * part // 100]).decode() for k, part in (("mit", 50), ("bsd", 59))}
    out = {r["doc_id"]: r for r in license_scan.scan_licenses(table(spark, [cut["mit"], "of bees " + cut["bsd"], "bees and flowers"])).collect()}
    for i, label in enumerate(("mit", "bsd")):
        share = len(body[label]) * (50, 59)[i] // 100 / len(body[label])
        assert out[i]["labels"] == out[i]["base_labels"] == "" and out[i]["n_base"] == 0
        assert abs(out[i]["score"] - share) < 1e-9
        assert [(s["start"], s["end"]) for s in out[i]["license_spans"] if s["label"] == label] == [(2 * i, out[i]["n_words"])]
    assert out[2]["score"] == 0 and out[2]["license_spans"] == []


# Toxicity

def test_folding():
    assert toxicity.fold("An 1d10t, а МОRОN!") == " an idiot a moron "
    assert toxicity.fold(None) == toxicity.fold("") == " "
    assert toxicity.fold("in 2013 $$$ stu​pid") == " in stupid "


def test_folding_at_the_end_of_words():
    assert [toxicity.fold(t) for t in ("1d107", "w0rthl355", "a55", "a$$", "A5!", "5 $ x")] == [" idiot ", " worthless ", " ass ", " ass ", " as ", " x "]
    assert toxicity.readings("in 2013, idiot1 go") == [" in idioti go ", " in idiot go "]
    lexicon = toxicity.Lexicon({" idiot ": 3.0, " ass ": 2.0, " trash ": 1.0})
    assert lexicon.features("you 1d107 and idiot1!")[1:] == (4, 2)
    assert lexicon.features("a55 a$$ a5")[::2] == (2.0 * (1 + math.log(2)), 2)
    assert lexicon.features("trash can5, trash1 can, trash can")[2] == 0


def test_lexicon_matches_exceptions_and_nested_terms():
    lexicon = toxicity.Lexicon({" trash ": 2.0, " tras": 1.0, " idiot ": 3.0})
    assert lexicon.features("trash can and trash")[:2] == (2.0, 4)
    assert lexicon.features("idiot idiot")[2] == 2 and lexicon.features("")[:2] == (0, 0)
    assert toxicity.Lexicon({}, ()).features("any")[0] == 0


def toxic_tables(spark, n=1500):
    rng = random.Random(3)
    plain = [f"{a}{b}{c}" for a in ("ba", "to", "mi", "re") for b in ("lan", "so", "ki") for c in ("", "n", "ta")]
    docs, labels = [], []
    for i in range(n):
        toxic = int(rng.random() < 0.3)
        words = [rng.choice(plain) for _ in range(rng.randint(1, 200))]
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words) + 1), rng.choice(["gr0mble", "GROMBLE", "wuxi" + rng.choice("abc") + "on", "wuxi" + rng.choice("xyz") + "el"]))
        docs.append((i, " ".join(words), toxic))
        if i % 2 == 0:
            labels.append((i, toxic))
    docs += [(n + i, t, 0) for i, t in enumerate(ODD)] + [(None, "gromble", 1), docs[0]]
    labels += [(None, 1), (0, None), (4, 0), (4, 1)]
    return (spark.createDataFrame(docs, "doc_id long, text string, truth int"), spark.createDataFrame(labels, "doc_id long, toxic int"))


def test_learned_lexicon_on_held_out_rows(spark):
    docs, labels = toxic_tables(spark)
    lexicon = toxicity.learn(docs, labels)
    out = toxicity.score_toxicity(docs, lexicon).withColumn("held_out", toxicity.held_out(F.col("doc_id"))).collect()
    assert len(out) == docs.count()
    unseen = [r for r in out if r["held_out"] or r["doc_id"] is None or r["doc_id"] % 2]
    assert sum(r["predicted"] == r["truth"] for r in unseen) / len(unseen) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)


def test_rare_terms_are_learned_from_many_rows(spark):
    """Each of 160 words is in 0.6% of the toxic texts, which hold no other sign."""
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefghiklmnoprstuvz") for _ in range(n))
    plain, rare = [word(6) for _ in range(500)], [word(7) for _ in range(160)]
    texts = [" ".join(rng.choices(plain, k=20) + [rng.choice(rare)] * (i % 2)) for i in range(8000)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(8000)], "doc_id long, toxic int")
    out = toxicity.score_toxicity(docs, toxicity.learn(docs, labels)).where(toxicity.held_out(F.col("doc_id"))).collect()
    for truth in (0, 1):
        rows = [r for r in out if r["doc_id"] % 2 == truth]
        assert len(rows) > 500 and sum(r["predicted"] == truth for r in rows) / len(rows) > 0.9


def test_toxicity_without_labels_or_rows(spark):
    docs, labels = toxic_tables(spark, 20)
    lexicon = toxicity.learn(docs, labels.limit(0))
    got = toxicity.score_toxicity(spark.createDataFrame([(1, "you idiot, you moron"), (2, "fine day")], "doc_id long, text string"), lexicon).collect()
    assert {r["doc_id"]: r["predicted"] for r in got} == {1: 1, 2: 0}
    assert toxicity.score_toxicity(docs.limit(0), toxicity.learn(docs.limit(0), labels)).count() == 0


# SentencePiece

@needs_model
@needs_tables
def test_pieces_equal_the_library(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.MODEL)
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + ODD
    out = sentence_pieces.encode_pieces(table(spark, texts).withColumn("IDS", F.lit(1)))
    assert [c.lower() for c in out.columns].count("ids") == 1
    back = sentence_pieces.decode_pieces(out)
    for r in back.collect():
        text = texts[r["doc_id"]] or ""
        assert list(r["ids"]) == library.encode(text) and r["n_pieces"] == len(r["ids"])
        assert r["decoded"] == text.replace("▁", " ")
    assert sentence_pieces.encode_pieces(table(spark, [])).count() == 0


def small_model(kind):
    rng = random.Random(4)
    names = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(2, 4))) for _ in range(25)} | {"▁a", "▁ab", "▁▁"}, key=lambda _: rng.random())
    names = ["<unk>", *names, *"abc▁", *[f"<0x{b:02X}>" for b in range(256)]]
    scores = [-float(i) / (3 if kind == "unigram" else 1) for i in range(len(names))]
    return sentence_pieces.Pieces(names, scores, {0, *range(len(names) - 256, len(names))}, len(names) - 256, kind)


def test_shared_prefixes_give_the_merges_of_each_word():
    rng, model = random.Random(5), small_model("bpe")
    words = {"".join(rng.choice("abc▁d") for _ in range(rng.randint(1, 9))) for _ in range(400)}
    words = {w for word in words for w in model.word.findall(word)}
    got = model.encode_words(words)
    numbers = lambda w: [model.ids.get(p, len(model.names) + ord(p[0])) for p in model.merged(w)]
    assert got == {w: model._bytes(numbers(w)) for w in words}


def test_unigram_finds_the_best_sum():
    rng, model = random.Random(6), small_model("unigram")
    words = {"".join(rng.choice("abcd") for _ in range(rng.randint(1, 7))) for _ in range(150)}

    def best(word):
        if not word:
            return 0.0
        options = [model.scores.get(word[:k], model.unknown_score if k == 1 else None) for k in range(1, len(word) + 1)]
        return max(s + best(word[k + 1:]) for k, s in enumerate(options) if s is not None)

    import numpy as np

    for word, ids in model.encode_words(words).items():
        pieces, score, at = np.frombuffer(ids, dtype=np.int32).tolist(), 0.0, 0
        while at < len(word):
            i = pieces.pop(0)
            name = model.names[i] if i < model.bytes_from else word[at]
            score += model.scores.get(name, model.unknown_score)
            at += len(name)
        assert abs(score - best(word)) < 1e-9


# Chat formatting

@needs_model
def test_chats_can_be_read_back(spark):
    control = ["<|im_end|>", "<|im_start|>assistant ok", "<\\|im_end|>", "<\\\\|", "ends with <", "|x", "\n\nstarts with lines", "a\n", "<|endoftext|>"]
    rng, rows = random.Random(7), []
    for conv in range(40):
        for turn in range(rng.randint(1, 6)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "assistant", "sys\ntem\\n<|", None]), rng.choice(control + ODD), "x"))
    rows += [rows[0], (None, 1, "assistant", "none", "x"), (5, None, "assistant", "no turn", "x"), (99, 0, "user", "only user", "x"), (98, 0, "assistant", None, "x")]
    chats = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, formatted string"))
    whole = {}
    for r in rows:
        whole.setdefault(r[0], []).append(((r[1] is not None, r[1] or 0), r[2] or "", r[3] or ""))
    got = {r["conv_id"]: r for r in chat_format.digests(chats).collect()}
    assert set(got) == set(whole)
    for conv, turns in whole.items():
        turns.sort(key=lambda t: (t[0], t[1].encode(), t[2].encode()))
        said = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r["formatted_chars"] == len(chat_format.render([(a, b) for _, a, b in turns]))


@needs_model
def test_masks_follow_the_tokens(spark):
    rows = [(1, 0, "user", "hello"), (1, 1, "assistant", "fine é😀 day")]
    r = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()[0]
    covered = {c for s, e, m in zip(r["starts"], r["ends"], r["loss_mask"], strict=True) if m for c in range(s, e)}
    at = r["formatted"].index("fine")
    assert covered == set(range(at, at + len("fine é😀 day")))
    assert {c for s, e in zip(r["starts"], r["ends"], strict=True) for c in range(s, e)} == set(range(len(r["formatted"])))


@needs_model
def test_no_conversations(spark):
    empty = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    assert chat_format.digests(chat_format.format_chats(empty)).count() == 0


# Fingerprints

def edit(text, after):
    half = len(text) // 2
    return text[:len(text) - half] + after[:half]


@pytest.mark.parametrize("n", [0, 1, 2, 300])
def test_neighbours_and_edits(spark, n, monkeypatch):
    monkeypatch.setattr(merkle, "LEAST_RANGES", 16)
    rng = random.Random(8)
    texts = [rng.choice(ODD) or " ".join(f"w{rng.randrange(50)}{rng.choice(['', '.', chr(10)])}" for _ in range(rng.randint(0, 80))) for _ in range(n)]
    ids = rng.sample(range(10 * n + 1), n)
    got = {r["doc_id"]: r for r in merkle.compare_with_next(spark.createDataFrame(
        [(i, t, "x") for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, n_chars string").repartition(3)).collect()}
    assert len(got) == n
    order = sorted(zip(ids, texts, strict=True))
    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % n][1] or ""
        r, new = got[i], edit(text, after)
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (merkle.fingerprint(text), merkle.fingerprint(new))
        leaves = [merkle.leaves(merkle.fingerprint(t)) for t in (text, new, after)]
        assert r["near_edited"] == merkle.likeness(leaves[0], leaves[1]) and r["near_next"] == merkle.likeness(leaves[0], leaves[2])


def test_repeated_and_null_ids_stay_rows(spark):
    rows = [(None, "a"), (None, None), (3, "x"), (3, "x"), (3, "y"), (4, "")]
    got = merkle.compare_with_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    assert Counter(r["fingerprint"] for r in got) == Counter(merkle.fingerprint(r[1] or "") for r in rows)


def test_tree_covers_the_text_and_locates_edits():
    rng = random.Random(9)
    for text in [t for t in ODD if t] + ["".join(rng.choice("ab .\n") for _ in range(500)) for _ in range(50)]:
        sections = merkle.tree(text)
        assert "".join(p for s in sections for p, _ in s) == text
        assert sum(merkle.size_of(c) for s in sections for _, c in s) == len(text)
        assert merkle.locate_edits(merkle.fingerprint(text), merkle.fingerprint(text)) == []
        assert merkle.likeness(*[merkle.leaves(merkle.fingerprint(text))] * 2) == 1
    lines = [f"paragraph number {i} has some words of its own" for i in range(60)]
    changed = lines[:30] + ["something else"] + lines[31:]
    a, b = "\n".join(lines), "\n".join(changed)
    (start, end), = merkle.locate_edits(merkle.fingerprint(a), merkle.fingerprint(b))
    assert a[start:end] == lines[30] + "\n"
    assert merkle.fingerprint("a") != merkle.fingerprint("a\n") != merkle.fingerprint("a\n\n")


def test_fingerprint_column(spark):
    got = merkle.fingerprint_documents(table(spark, ODD)).collect()
    assert all(r["fingerprint"] == merkle.fingerprint(r["text"] or "") for r in got)


def test_learning_does_not_depend_on_partitions(spark):
    docs, labels = toxic_tables(spark, 600)
    one, two = toxicity.learn(docs, labels), toxicity.learn(docs.repartition(7).sortWithinPartitions("text"), labels.repartition(5))
    assert (one.terms, one.fit) == (two.terms, two.fit)
