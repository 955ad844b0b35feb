"""Language ID: sparse multinomial logistic regression on TF-IDF of character n-grams.

A text is lower-cased, every run of other characters than letters becomes one space, and its runs of two and three characters are hashed
to :data:`BUCKETS` features. A feature's value is its share of the text's n-grams times its inverse document frequency, which is counted
over all documents to learn from. The weights are trained with follow-the-regularised-leader (one rate per weight, L1 and L2 penalties) on
:data:`SAMPLE` of these documents, dealt over the languages: a language with no more than its equal share of the sample gives all its
documents, the others share what is left, each giving its first by the hash of the id. What that changes in the shares of the languages is
taken back in the probabilities, by full counts. Every fifth document of a language is left out and sets the temperature of the
probabilities. Prediction reads whole texts and is a sum of weights.

Defined results: null text or text without a letter is ``und`` with score 0, and so is everything when nothing can be learned from; rows
repeated under one id are predicted alike; ties go to the language first in the alphabet; an empty table gives an empty table; columns
other than ``doc_id``, ``text`` and, for learning, ``lang`` are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litprops.llm.store import Scratch
from litprops.llm.words import batches

BITS = 15
BUCKETS = 1 << BITS
#: Documents that the weights are trained on at most.
SAMPLE = 4000
SCALE = 30.0
UNKNOWN = "und"
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``row, bucket`` of every n-gram, and whether each text has a letter."""
    low = [(t or "").lower() for t in texts]
    sizes = np.fromiter(map(len, low), np.int64, len(low))
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(low), dtype=np.int32), sizes)
    letter = _letter_table()[codes]
    has = np.bincount(row[letter], minlength=len(low)) > 0
    stay = letter.copy()
    stay[1:] |= letter[:-1] & (row[1:] == row[:-1])  # the first character after a letter becomes the space, the rest of the run goes
    codes, row, letter = codes[stay].astype(np.uint64), row[stay], letter[stay]
    codes[~letter] = 32
    rows, buckets = [], []
    for n in (2, 3):
        m = len(codes) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n * 0x9E3779B97F4A7C15 % (1 << 64), np.uint64)
        for k in range(n):
            h = (h ^ codes[k : k + m]) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(29)
        same = row[:m] == row[n - 1 :]
        rows.append(row[:m][same])
        buckets.append(((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int32)[same])
    if not rows:
        return np.empty(0, np.int32), np.empty(0, np.int32), has
    return np.concatenate(rows), np.concatenate(buckets), has


def _small(iterator):
    return batches(iterator, rows=200, size=1 << 20)


def _frequencies(iterator):
    """Document frequencies of the documents of one task."""
    total = np.zeros(BUCKETS, np.int64)
    n = 0
    for piece in _small(iterator):
        texts = piece.column(0).to_pylist()
        row, bucket, has = ngrams(texts)
        present = np.zeros((len(texts), BUCKETS), bool)
        present[row, bucket] = True
        total += present.sum(axis=0)
        n += int(has.sum())
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], n))], names=["bucket", "n"])


def _counts(iterator):
    for piece in _small(iterator):
        texts = piece.column(0).to_pylist()
        row, bucket, _ = ngrams(texts)
        key, count = np.unique(row.astype(np.int64) * BUCKETS + bucket, return_counts=True)
        cut = np.searchsorted(key, np.arange(len(texts) + 1) * BUCKETS)
        at = [(key[a:b] % BUCKETS).astype(np.int32).tobytes() for a, b in zip(cut[:-1], cut[1:])]
        n = [count[a:b].astype(np.int32).tobytes() for a, b in zip(cut[:-1], cut[1:])]
        yield pa.RecordBatch.from_arrays([piece.column(1), piece.column(2), pa.array(at, pa.binary()), pa.array(n, pa.binary())], names=["nth", "lang", "at", "n"])


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # BUCKETS x languages, with the inverse document frequencies in them
    bias: np.ndarray
    temperature: float
    prior: np.ndarray  # logarithm of a language's share of all documents over its share of the sample


class FollowTheLeader:
    """FTRL-proximal for multinomial logistic regression; weights below the L1 penalty are exactly zero."""

    def __init__(self, features: int, classes: int, alpha=0.5, beta=1.0, l1=0.02, l2=0.1):
        self.z, self.n = np.zeros((features, classes)), np.zeros((features, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def learn(self, at, x, label: int) -> None:
        w = self.weights(at)
        p = softmax(x @ w)
        p[label] -= 1.0
        g = x[:, None] * p[None, :]
        n = self.n[at]
        grown = n + g * g
        self.z[at] += g - (np.sqrt(grown) - np.sqrt(n)) / self.alpha * w
        self.n[at] = grown


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _temperature(logits: np.ndarray, labels: np.ndarray, prior: np.ndarray) -> float:
    """The temperature with the least log loss over documents as frequent as all are, by golden sections over its logarithm."""
    if not len(labels):
        return 1.0
    at, weight = np.arange(len(labels)), np.exp(prior)[labels]
    loss = lambda t: -(weight * np.log(np.maximum(softmax(logits / np.exp(t) + prior)[at, labels], 1e-12))).sum()
    lo, hi, r = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def quotas(counts: dict[str, int], sample: int) -> dict[str, int]:
    """How many documents each language gives: the smallest first, each at most an equal share of what is left, and at least one."""
    out, left = {}, sample
    for i, lang in enumerate(sorted(counts, key=lambda x: (counts[x], x))):
        out[lang] = max(1, min(counts[lang], left // (len(counts) - i)))
        left -= out[lang]
    return out


def _sample(docs: DataFrame, sample: int) -> tuple[DataFrame, dict[str, int], dict[str, int]]:
    """``doc_id, lang`` of the sample; the documents and the quota of each language. No language is sorted as a whole: counts of ranges of
    the hash say which range its last document is in."""
    spark, place = docs.sparkSession, F.shiftrightunsigned(F.xxhash64("doc_id"), 52)
    ids = docs.filter("doc_id is not null").select("doc_id", "lang").distinct().withColumn("place", place)
    scratch = Scratch(spark, "langid")
    ranges = scratch.put(ids.groupBy("lang", "place").agg(F.count("*").alias("n")), "ranges")
    counts = {r.lang: r.n for r in ranges.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    quota = quotas(counts, sample)
    wanted = F.broadcast(spark.createDataFrame(list(quota.items()), "lang string, quota long"))
    upto = F.sum("n").over(Window.partitionBy("lang").orderBy("place"))
    last = ranges.withColumn("upto", upto).join(wanted, "lang").filter(F.col("upto") - F.col("n") < F.col("quota"))
    last = last.groupBy("lang", "quota").agg(F.max("place").alias("last"))
    near = ids.join(F.broadcast(last), "lang").filter("place <= last")
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("place", F.xxhash64("doc_id"), "doc_id"))
    chosen = scratch.put(near.withColumn("nth", nth).filter("nth <= quota").select("doc_id", "lang"), "chosen")
    scratch.drop("ranges")
    return chosen, counts, quota


def train(docs: DataFrame, sample: int = SAMPLE, epochs: int = 3) -> Model | None:
    """A model from ``doc_id, text, lang``; None if no document has a language and a letter."""
    docs = docs.select("doc_id", "text", "lang").filter("lang is not null and text is not null")
    df = docs.select("text").mapInArrow(_frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    seen = {r.bucket: r.n for r in df}
    total = seen.pop(-1, 0)
    if not total:
        return None
    idf = np.zeros(BUCKETS)
    at = np.fromiter(seen, np.int64, len(seen))
    idf[at] = np.log((1 + total) / (1 + np.fromiter(seen.values(), np.int64, len(seen)))) + 0.1
    chosen, counts, quota = _sample(docs, sample)
    chosen = chosen.withColumn("nth", F.xxhash64(F.lit(1), "doc_id"))  # another order, as only small languages have documents of large hashes
    texts = docs.join(F.broadcast(chosen), ["doc_id", "lang"]).select("text", "nth", "lang")
    rows = texts.mapInArrow(_counts, "nth long, lang string, at binary, n binary").collect()
    rows = sorted(((r.nth, r.lang, bytes(r.at), bytes(r.n)) for r in rows if len(r.at)), key=lambda r: r[:3])
    languages = sorted({r[1] for r in rows})
    if not rows:
        return None
    data = []
    for _, lang, where, n in rows:
        where, n = np.frombuffer(where, np.int32).astype(np.int64), np.frombuffer(n, np.int32)
        data.append((np.append(where, BUCKETS), np.append(n / n.sum() * idf[where] * SCALE, 1.0), languages.index(lang)))
    prior = np.log([counts[x] / quota[x] * sum(quota.values()) / sum(counts.values()) for x in languages])
    fit, check, met = [], [], [0] * len(languages)
    for d in data:
        met[d[2]] += 1
        (fit if met[d[2]] % 5 else check).append(d)
    leader = FollowTheLeader(BUCKETS + 1, len(languages))
    for _ in range(epochs):
        for where, x, label in fit:
            leader.learn(where, x, label)
    w = leader.weights(np.arange(BUCKETS + 1))
    logits = np.array([x @ w[where] for where, x, _ in check])
    t = _temperature(logits, np.array([label for *_, label in check], np.int64), prior)
    return Model(languages, w[:-1] * idf[:, None] * SCALE, w[-1], t, prior)


def _predict(model: Model | None):
    def run(iterator):
        for piece in _small(iterator):
            texts = piece.column(1).to_pylist()
            row, bucket, has = ngrams(texts)
            if model is None:
                names, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            else:
                n = np.maximum(np.bincount(row, minlength=len(texts)), 1)
                sums = np.stack([np.bincount(row, weights=model.weights[bucket, c], minlength=len(texts)) for c in range(len(model.languages))], axis=1)
                p = softmax((sums / n[:, None] + model.bias) / model.temperature + model.prior)
                best = p.argmax(axis=1)
                names = [model.languages[b] if h else UNKNOWN for b, h in zip(best.tolist(), has.tolist())]
                score = np.where(has, p[np.arange(len(texts)), best], 0.0)
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_predict(model), "doc_id long, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """One document in four, by the checksum of its id; never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))
