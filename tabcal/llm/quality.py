"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, probabilities calibrated by temperature."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from tabcal.llm.common import append_columns, give_back, stored, table

#: Labelled texts used for learning, about so many per class (their ids' hashes lie below a bound); one in CALIBRATION of them is kept
#: for the temperature.
CLASS_ROWS, CALIBRATION = 4_000, 5
#: Words share so many buckets, so every word has a vector, whatever their number; the vectors' length; entries of an index vector.
BUCKETS, DIMS, ENTRIES = 1 << 14, 64, 4
#: Words to either side that make up a word's contexts.
WINDOW = 2
#: Neurons of the first layer, steps of its fit, step size, penalty on weights.
HIDDEN, STEPS, RATE, PENALTY = 32, 400, 0.01, 1e-3
#: Least score of a good document.
LEAST_SCORE = 0.3
#: Words pooled at once.
CHUNK = 1 << 16
_WORD = re.compile(r"[^\W_]+|[^\w\s]+|_+")


def held_out(ident: Column) -> Column:
    """Rows whose crc32(id as text) is divisible by 5 are never learned from."""
    return F.pmod(F.crc32(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def shape(word: str) -> str:
    """How a word is written: small, capital or mixed letters, or the kinds of characters in order of their first place; signs stand for themselves."""
    if word.isalpha():
        return "a" if word.islower() else "Aa" if word.istitle() and len(word) > 1 else "A" * min(2, len(word)) if word.isupper() else "aA"
    return "".join(dict.fromkeys("A" if c.isupper() else "0" if c.isdigit() else "a" if c.isalpha() else c for c in word))[:4]


def index_vectors(seed: int = 11):
    """A sparse random vector per bucket: ENTRIES places with 1 or -1."""
    import numpy as np

    rng = np.random.default_rng(seed)
    out = np.zeros((BUCKETS, DIMS), dtype=np.int8)
    for _ in range(ENTRIES):
        out[np.arange(BUCKETS), rng.integers(0, DIMS, BUCKETS)] += rng.choice(np.array([-1, 1], dtype=np.int8), BUCKETS)
    return out


class Reader:
    """Buckets of the words of texts: of a word itself (in small letters) and of its shape."""

    def __init__(self):
        self.known: dict[str, tuple[int, int]] = {}

    def _buckets(self, word: str) -> tuple[int, int]:
        found = self.known[word] = (zlib.crc32(word.lower().encode()) % BUCKETS, zlib.crc32(b"\0" + shape(word).encode()) % BUCKETS)
        return found

    def read(self, texts: list[str | None]):
        """(buckets of all words: n x 2, words per text, distinct words per text)."""
        import numpy as np

        if len(self.known) > 200_000:
            self.known.clear()
        get, flat, sizes, distinct = self.known.get, [], [], []
        for t in texts:
            words = _WORD.findall(t or "")
            flat += [get(w) or self._buckets(w) for w in words]
            sizes.append(len(words))
            distinct.append(len(set(words)))
        return np.array(flat, dtype=np.int32).reshape(-1, 2), np.array(sizes, dtype=np.int64), np.array(distinct, dtype=np.int64)


def contexts(buckets, sizes, index):
    """(bucket, vector) of the words of texts: the sum of the index vectors of the words around them, those before rotated by one place
    against those after."""
    import numpy as np

    of = np.repeat(np.arange(len(sizes)), sizes)
    total = np.zeros((BUCKETS, DIMS), dtype=np.int64)
    turned = np.roll(index, 1, axis=1)
    for step in range(1, WINDOW + 1):
        same = of[step:] == of[:-step]
        first, second = buckets[:-step][same], buckets[step:][same]
        for word, other, vectors in ((first, second, index), (second, first, turned)):
            for own in (0, 1):
                for lo in range(0, len(word), CHUNK):
                    w, o = word[lo:lo + CHUNK, own], other[lo:lo + CHUNK]
                    np.add.at(total, w, vectors[o[:, 0]].astype(np.int64) + vectors[o[:, 1]])
    return total


def pooled(buckets, sizes, distinct, vectors):
    """Per text the mean of its words' vectors (word plus shape), the logarithm of its number of words and the share of distinct words."""
    import numpy as np

    sums = np.zeros((len(sizes), DIMS))
    of = np.repeat(np.arange(len(sizes)), sizes)
    for lo in range(0, len(of), CHUNK):
        texts, part = of[lo:lo + CHUNK], buckets[lo:lo + CHUNK]
        starts = np.concatenate([[0], np.nonzero(np.diff(texts))[0] + 1])
        sums[texts[starts]] += np.add.reduceat(vectors[part[:, 0]] + vectors[part[:, 1]], starts, axis=0)
    n = np.maximum(1, sizes)
    return np.column_stack([sums / n[:, None], np.log1p(sizes), distinct / n])


@dataclass
class Network:
    """Standardised inputs, a hidden layer of tanh neurons, one output; its logit is divided by the temperature."""

    mean: object
    spread: object
    w1: object
    b1: object
    w2: object
    b2: float
    temperature: float = 1.0

    def logits(self, x):
        import numpy as np

        return np.tanh((x - self.mean) / self.spread @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x):
        import numpy as np

        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -50, 50)))


def fit_network(x, y, seed: int = 11) -> Network:
    """Least log loss plus a small penalty, by Adam on all rows at once; the same rows give the same network."""
    import numpy as np

    rng = np.random.default_rng(seed)
    mean, spread = x.mean(axis=0), x.std(axis=0)
    spread = np.where(spread > 1e-12, spread, 1.0)
    z = (x - mean) / spread
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.array(np.log(share / (1 - share)))]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for step in range(1, STEPS + 1):
        h = np.tanh(z @ p[0] + p[1])
        d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -50, 50))) - y) / len(y)
        dh = d[:, None] * p[2][None, :] * (1 - h * h)
        grads = [z.T @ dh + PENALTY * p[0], dh.sum(axis=0), h.T @ d + PENALTY * p[2], d.sum()]
        for k, g in enumerate(grads):
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
            p[k] = p[k] - RATE * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
    return Network(mean, spread, p[0], p[1], p[2], float(p[3]))


def fit_temperature(logits, y) -> float:
    """The temperature of least log loss on rows that the network was not fitted on, from 0.25 to 16 (golden section on its logarithm)."""
    import numpy as np

    def loss(log_t):
        z = logits / np.exp(log_t)
        return float(np.mean(np.logaddexp(0, z) - y * z))

    lo, hi, ratio = np.log(0.25), np.log(16.0), (np.sqrt(5) - 1) / 2
    a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
    for _ in range(60):
        if loss(a) <= loss(b):
            hi, b = b, a
            a = hi - ratio * (hi - lo)
        else:
            lo, a = a, b
            b = lo + ratio * (hi - lo)
    return float(np.exp((lo + hi) / 2))


@dataclass
class Quality:
    """Vectors of the buckets and the network; without labels of both classes only a constant."""

    vectors: object = None
    network: Network | None = None
    constant: float = 0.5
    _reader: Reader = field(default_factory=Reader, repr=False)

    def scores(self, texts: list[str | None]) -> list[float]:
        if self.network is None:
            return [self.constant] * len(texts)
        return self.network.scores(pooled(*self._reader.read(texts), self.vectors)).tolist()

    def forget(self) -> None:
        self._reader.known.clear()


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, class_rows: int) -> DataFrame:
    """(id, label, text, part) of about class_rows labelled texts per class: those whose id's hash lies below a share of all hashes.

    Held-out ids, null ids and labels other than 0 and 1 are left out; an id of several labels has the largest, an id of several texts
    its first; a text that occurs again counts once.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(
        "id IS NOT NULL AND label IN (0, 1)").where(~held_out(F.col("id"))).groupBy("id").agg(F.max("label").alias("label"))
    known = stored(known)
    n = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    below = F.lit(False)
    for label, rows in n.items():
        below = below | ((F.col("label") == label) & (F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(min(1.0, class_rows / rows) * (1 << 30))))
    # About 2 * class_rows rows, whatever the size of the tables: small enough to broadcast.
    chosen = F.broadcast(stored(known.where(below)))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(chosen, "id")
    texts = texts.groupBy("id", "label").agg(F.min("text").alias("text")).groupBy("text", "label").agg(F.min("id").alias("id"))
    return stored(texts.withColumn("part", F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(CALIBRATION)).cast("int")))


def word_vectors(rows: DataFrame):
    """Unit vectors of all buckets (zeros where no word fell), from the contexts of the words of `text`: each task adds up its own words, the
    sums meet by bucket. At most BUCKETS rows come back, whatever the number of texts."""
    import numpy as np

    def add(batches):
        import pyarrow as pa

        reader, index, total = Reader(), index_vectors(), None
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                buckets, sizes, _ = reader.read(batch.column(0).slice(at, 200).to_pylist())
                if len(buckets):
                    found = contexts(buckets, sizes, index)
                    total = found if total is None else total + found
        if total is not None:
            used = np.nonzero(total.any(axis=1))[0]
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(used) + 1) * DIMS, DIMS, dtype=np.int32)), pa.array(total[used].reshape(-1)))
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), flat], ["bucket", "v"])
        give_back()

    sums = rows.repartition(12, "id").select("text").mapInArrow(add, "bucket int, v array<bigint>").groupBy("bucket").agg(
        *[F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(DIMS)])
    out = np.zeros((BUCKETS, DIMS))
    for r in sums.collect():
        out[r[0]] = r[1:]
    length = np.sqrt((out ** 2).sum(axis=1))
    seen = length > 0
    out[seen] /= length[seen, None]
    return out


def learn_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", class_rows: int = CLASS_ROWS) -> Quality:
    """Vectors from the sample's texts, the network from four fifths of them, the temperature from the rest. The driver gets the vectors of
    the buckets and one pooled vector per sampled text, both bounded by parameters."""
    import numpy as np

    sample = labelled_sample(docs, labels, id_col, text_col, label_col, class_rows)
    seen = sorted(r["label"] for r in sample.groupBy("label").count().collect())
    if len(seen) < 2:
        return Quality(constant=float(seen[0]) if seen else 0.5)
    model = Quality(word_vectors(sample.where("part > 0")))

    def pool(texts):
        return (pooled(*Reader().read(texts), model.vectors).tolist(),)

    got = append_columns(sample, ["text"], "x array<double>", lambda: pool, keep=["id", "label", "part"]).collect()
    got.sort(key=lambda r: repr(r["id"]))
    x, y, part = np.array([r["x"] for r in got]), np.array([r["label"] for r in got], dtype=float), np.array([r["part"] for r in got])
    fit, rest = part > 0, part == 0
    if len(set(y[fit].tolist())) < 2:
        fit = np.ones(len(y), dtype=bool)
    model.network = fit_network(x[fit], y[fit])
    if len(set(y[rest].tolist())) == 2:
        model.network.temperature = fit_temperature(model.network.logits(x[rest]), y[rest])
    return model


def score_quality(docs: DataFrame, model: Quality, text_col: str = "text", keep: list[str] | None = None, least_score: float = LEAST_SCORE) -> DataFrame:
    """docs (or its columns `keep`) with score (0 to 1, higher: better) and predicted (1 from least_score on), from the text alone.

    Null and empty texts have no words: a zero vector, which the network scores like any other. Whole texts, however long; rows are
    independent, so null or repeated ids and repeated rows have their own results; nothing is shuffled. Columns named score or predicted
    give way to the new ones. Empty table: empty result. With labels of one class only, or none, the score is that class or 0.5.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        own = shared.value

        def call(texts):
            scores = own.scores(texts)
            return scores, [int(s >= least_score) for s in scores]

        call.close = own.forget
        return call

    return append_columns(docs, [text_col], "score double, predicted int", start, keep, 1 << 20)


def op11_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, learn_quality(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


QUERIES = {"op11_quality": (op11_quality, None)}
