"""Toxicity: a weighted lexicon, matched by Aho-Corasick on folded text, normalised by length."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from tabcal.llm.common import append_columns, stored, table

# Letters of other scripts that look like Latin ones, and what stands for them.
HOMOGLYPHS = str.maketrans(
    "авсԁеѕіјкмнорԛгтуԝхһԍɡαβεικνορτυχωı",
    "abcdesijkmhopqrtywxhggabeiknoptuxwi",
) | {0xFF41 + i: ord("a") + i for i in range(26)}
# Digits and signs written for letters.
SUBSTITUTES = str.maketrans("0134578@$!", "oieastbasi")
# Zero-width characters and the soft hyphen.
INVISIBLE = re.compile("[­​-‏⁠﻿]")
_SWAPPED = re.compile(r"[0134578@$!]+(?=[^\W\d_])")
_ENDING = re.compile(r"(?<=[^\W\d_])[0134578@$!]*[0134578@$]")
_WORD = re.compile(r"[^\W\d_]+")
# Terms that are in the lexicon whatever the labels say, and phrases in which a term means no harm.
SEED_TERMS = ("idiot", "moron", "scum", "stupid", "worthless", "pathetic", "loser")
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "disgusting smell")

#: Labelled rows used for learning, per class; terms in the lexicon; least documents and least log odds of a term.
TOXIC_ROWS, CLEAN_ROWS, TERMS, LEAST_DOCS, LEAST_ODDS = 6_000, 12_000, 2_000, 3, 2.5
#: Least share of the toxic documents for common terms; of the toxic documents without any, rarer terms are learned whose log odds lie
#: so many standard deviations above 0.
LEAST_SHARE, DEVIATIONS = 0.01, 2.0
PREFIXES = (4, 5, 6)


def readings(text: str | None) -> list[str]:
    """Lower case, look-alike letters and digits written for letters made Latin, each word between single blanks. Digits and signs at
    the end of a word are letters ("1d107") in the first reading and none of the word ("idiot1") in the second, if there are any."""
    text = (text or "").lower()
    if not text.isascii():
        text = INVISIBLE.sub("", text).translate(HOMOGLYPHS)
    swap = lambda m: m[0].translate(SUBSTITUTES)
    text = _SWAPPED.sub(swap, text)
    ended = _ENDING.sub(swap, text)
    return [" ".join(["", *_WORD.findall(t), ""]) for t in ([text] if ended == text else [ended, text])]


def fold(text: str | None) -> str:
    """The first reading."""
    return readings(text)[0]


@dataclass
class Lexicon:
    """Terms with weights; " term " is a whole word or phrase, " term" the beginning of a word. Then the weights of
    (1, log of the matched weight, log of the matched weight per 100 words)."""

    terms: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    fit: tuple[float, float, float] = (-4.0, 2.0, 1.0)
    _automaton: object = field(default=None, repr=False)

    def __getstate__(self):
        return (self.terms, self.exceptions, self.fit)

    def __setstate__(self, state):
        self.terms, self.exceptions, self.fit = state
        self._automaton = None

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            a = ahocorasick.Automaton()
            for term, weight in self.terms.items():
                a.add_word(term, (len(term), weight, term.count(" ")))
            for phrase in self.exceptions:
                term = fold(phrase)
                a.add_word(term, (len(term), None, term.count(" ")))
            a.make_automaton()
            self._automaton = a
        return self._automaton

    def features(self, text: str | None) -> tuple[float, float, int]:
        """Matched weight, words, matches. Of terms that begin at one word, in any reading, the heaviest counts, a word found n times
        counts 1 + log n times; a match within an exception phrase doesn't count."""
        texts = readings(text)
        found: dict[int, tuple[float, str]] = {}
        spared: set[int] = set()
        for folded in texts if len(self.terms) + len(self.exceptions) else []:
            blanks = at = 0
            for end, (size, weight, own) in self.automaton().iter(folded):
                blanks, at = blanks + folded.count(" ", at, end + 1), end + 1
                word, start = blanks - own, end + 1 - size
                if weight is None:
                    spared.update(range(word, word + own - 1))
                elif word not in found or weight > found[word][0]:
                    found[word] = (weight, folded[start + 1:folded.index(" ", start + 1)])
        for word in spared & found.keys():
            del found[word]
        times = Counter(found.values())
        return math.fsum(w * (1 + math.log(n)) for (w, _), n in times.items()), texts[0].count(" ") - 1, len(found)

    def score(self, weight: float, n_words: int) -> float:
        x = self.fit[0] + self.fit[1] * math.log1p(weight) + self.fit[2] * math.log1p(100 * weight / max(1, n_words))
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, x))))


def held_out(ident: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, toxic_rows: int, clean_rows: int) -> DataFrame:
    """At most toxic_rows + clean_rows labelled texts (id, label, text, part), the ids with the smallest hashes in each class; rows that are
    held out, unlabelled or without id are left out. An id of several texts gives its first; equal texts count once."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(
        "id IS NOT NULL AND label IN (0, 1)").where(~held_out(F.col("id"))).groupBy("id").agg(F.max("label").alias("label"))
    chosen = known.where("label = 1").orderBy(F.xxhash64("id"), "id").limit(toxic_rows).unionByName(
        known.where("label = 0").orderBy(F.xxhash64("id"), "id").limit(clean_rows))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(stored(chosen)), "id")
    texts = texts.groupBy("id", "label").agg(F.min("text").alias("text")).groupBy("text", "label").agg(F.min("id").alias("id"))
    return stored(texts.withColumn(
        "part", F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(4)).cast("int")))


def _terms(texts: list[str]) -> set[str]:
    words = {w for folded in texts for w in folded.split()}
    return {f" {w} " for w in words if len(w) > 2} | {f" {w[:n]}" for w in words for n in PREFIXES if len(w) >= n}


def learn_lexicon(rows: DataFrame, terms: int = TERMS, least_docs: int = LEAST_DOCS, least_share: float = LEAST_SHARE, least_odds: float = LEAST_ODDS, deviations: float = DEVIATIONS, exceptions=EXCEPTIONS) -> Lexicon:
    """Terms are words and beginnings of words whose log odds (toxic against clean documents that hold them) are high, from three
    quarters of the rows; the score is fitted on the other quarter. Both parts are bounded by training_rows. Words that only go along with
    common terms are no terms: a term has a share of the toxic documents, or is found in toxic documents that hold no such term, in
    numbers that don't grow with the rows."""
    def count(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part, toxic, clean = batch.slice(at, 500), {}, {}
                for text, label in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    into = toxic if label else clean
                    for t in _terms(readings(text)):
                        into[t] = into.get(t, 0) + 1
                names = list(toxic.keys() | clean.keys())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.string()), pa.array([toxic.get(t, 0) for t in names], pa.int64()), pa.array([clean.get(t, 0) for t in names], pa.int64())],
                    ["term", "toxic", "clean"])

    learn = rows.where("part > 0").repartition(24, "id")
    n = {r["label"]: r["n"] for r in learn.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = n.get(1, 0), n.get(0, 0)

    def found(some, least, deviations, limit):
        counts = some.select("text", "label").mapInArrow(count, "term string, toxic bigint, clean bigint").groupBy("term").agg(
            F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
        error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
        rows = counts.withColumn("odds", odds).where((F.col("toxic") >= least) & (F.col("odds") >= F.greatest(F.lit(least_odds), deviations * error))).orderBy(
            F.desc(F.col("odds") * F.sqrt("toxic")), "term").limit(5 * limit).collect()
        return _pruned({r["term"]: (r["odds"], r["toxic"]) for r in rows}, limit)

    lexicon = Lexicon(found(learn, max(least_docs, least_share * n_toxic), 0.0, terms), tuple(exceptions))
    for seed in SEED_TERMS:
        lexicon.terms.setdefault(f" {seed} ", 3.0)
    common = Lexicon(dict(lexicon.terms), lexicon.exceptions)
    alone = stored(append_columns(
        learn.where("label = 1"), ["text"], "n_matches bigint", lambda: lambda texts: ([common.features(t)[2] for t in texts],),
        keep=["text", "label"]).where("n_matches = 0").drop("n_matches"))
    room = terms - len(lexicon.terms)
    if room > 0 and alone.count() >= least_docs:
        rare = found(alone.unionByName(learn.where("label = 0").select("text", "label")), least_docs, deviations, room)
        lexicon.terms.update({t: w for t, w in rare.items() if t not in lexicon.terms})
    fitted = append_columns(
        rows.where("part = 0"), ["text"], "weight double, n_words bigint",
        lambda: lambda texts: tuple(zip(*[lexicon.features(t)[:2] for t in texts], strict=True)) or ([], []), keep=["label"])
    lexicon.fit = _fitted(sorted((r["label"], r["weight"], r["n_words"]) for r in fitted.collect()), lexicon.fit)
    return lexicon


def _pruned(found: dict[str, tuple[float, int]], terms: int) -> dict[str, float]:
    """Of nested terms, the one that says most: a longer one that is nearly as frequent, else the common stem."""
    def shorter(term: str):
        body = term.strip()
        return [p for k in PREFIXES if k <= len(body) and (p := f" {body[:k]}") in found and p != term]

    gone = {p for term, (_, n) in found.items() for p in shorter(term) if n >= 0.9 * found[p][1]}
    for term, (odds, n) in found.items():
        if any(p not in gone and found[p][0] >= odds - 1 and found[p][1] > n for p in shorter(term)):
            gone.add(term)
    return dict([(t, round(odds, 4)) for t, (odds, _) in found.items() if t not in gone][:terms])


def _fitted(rows: list[tuple[int, float, int]], default: tuple[float, float, float]) -> tuple[float, float, float]:
    """Logistic regression with a small penalty, slopes not negative; the default where a class is missing."""
    import numpy as np

    if len({r[0] for r in rows}) < 2:
        return default
    y = np.array([r[0] for r in rows], dtype=float)
    w, n = np.array([r[1] for r in rows]), np.maximum(1, np.array([r[2] for r in rows], dtype=float))
    x = np.column_stack([np.ones_like(y), np.log1p(w), np.log1p(100 * w / n)])
    use = [0, 1, 2]
    for _ in range(3):
        b = np.zeros(3)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x[:, use] @ b[use], -50, 50)))
            h = (x[:, use] * (p * (1 - p))[:, None]).T @ x[:, use] + 0.01 * np.eye(len(use))
            b[use] += np.linalg.solve(h, x[:, use].T @ (y - p) - 0.01 * b[use])
        bad = [k for k in use if k and b[k] < 0]
        if not bad:
            break
        use = [k for k in use if k not in bad]
    return tuple(float(v) if k in use else 0.0 for k, v in enumerate(b))


def score_toxicity(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns `keep`) with score (0 to 1), predicted (1 from 0.5 on) and n_matches, from the text alone.

    Null text is empty and scores as a text without matches. Whole texts; rows are independent; nothing is shuffled.
    """
    def call(texts):
        got = [lexicon.features(t) for t in texts]
        scores = [lexicon.score(w, n) for w, n, _ in got]
        return scores, [int(s >= 0.5) for s in scores], [g[2] for g in got]

    return append_columns(docs, [text_col], "score double, predicted int, n_matches bigint", lambda: call, keep)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Lexicon:
    return learn_lexicon(training_rows(docs, labels, id_col, text_col, label_col, TOXIC_ROWS, CLEAN_ROWS))


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = learn(docs, table(spark, sf_dir, "labels"))
    scored = score_toxicity(docs, lexicon, keep=["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_matches")


QUERIES = {"op4_toxicity": (op4_toxicity, None)}
