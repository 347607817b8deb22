"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + <w, x> + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)), which is linear in the
number of words. x holds each text's hashed-word frequencies (2^``bits`` buckets), structure statistics and
metadata that follow from the text itself (its number of words, their mean length, words a line); labels, lang, source and doc_id are never inputs.

Training: labelled rows whose crc32(doc_id as text) mod 4 is not 2, at most ``train_rows`` of them, chosen
by the smallest hash of their identifier; Adam on the driver with numpy, a fixed seed. Scoring: one Arrow
pass over whole texts, no shuffle; the model is 2^bits x (factors + 1) numbers in the task's closure.

Defined cases: null and empty texts score like a text without words; labels that are null, or conflict
for one document, count by their mean; without labelled rows every score is ``prior``; a document labelled
twice is trained on once; of several texts under one identifier the one with the smallest hash is trained on; a
null identifier is not held out and has no label; repeated rows are scored one by one; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _features as S
from . import _text as X


@dataclass(frozen=True)
class Params:
    bits: int = 13
    factors: int = 8
    train_rows: int = 8000  # bound of the training sample
    epochs: int = 30
    batch: int = 256
    rate: float = 0.02
    decay: float = 1e-4
    threshold: float = 0.7
    prior: float = 0.5
    seed: int = 5


def held_out():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))


def word_weights(words: X.Words, h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets, values and offsets by text: counts of hashed words, scaled to length 1, so long texts don't dominate."""
    key, count = np.unique(words.docs() << bits | (h >> np.uint64(64 - bits)).astype(np.int64), return_counts=True)
    doc, count = key >> bits, count.astype(np.float32)
    offs = np.searchsorted(doc, np.arange(len(words.offs)))
    norm = np.sqrt(X.per_doc(count.astype(np.float64) ** 2, offs))
    return key & ((1 << bits) - 1), (count / norm[doc]).astype(np.float32), offs


class Machine:
    """Parameters and the linear-time score."""

    def __init__(self, p: Params):
        n, rng = (1 << p.bits) + len(S.STRUCTURE), np.random.default_rng(p.seed)
        self.p, self.words = p, 1 << p.bits
        self.w0, self.w = np.zeros(1, np.float32), np.zeros(n, np.float32)
        self.v = (rng.standard_normal((n, p.factors)) * 0.01).astype(np.float32)
        self.mean, self.scale = np.zeros(len(S.STRUCTURE), np.float32), np.ones(len(S.STRUCTURE), np.float32)

    def raw(self, bucket: np.ndarray, value: np.ndarray, offs: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Margins, and the factor sums that gradients need."""
        n = len(offs) - 1
        table = np.hstack([self.w[:, None], self.v, (self.v**2)])
        k = self.p.factors
        flat = np.zeros((n, 1 + 2 * k), np.float32)
        some = np.flatnonzero(np.diff(offs) > 0)
        step = 1 << 16
        if len(some):
            doc = np.repeat(np.arange(n), np.diff(offs))
            for a in range(0, len(bucket), step):
                rows = table[bucket[a : a + step]]
                x = value[a : a + step, None]
                rows[:, : 1 + k] *= x
                rows[:, 1 + k :] *= x * x
                d = doc[a : a + step]
                new = np.flatnonzero(np.diff(d, prepend=-1))
                flat[d[new]] += np.add.reduceat(rows, new, axis=0)
        z = (stats - self.mean) / self.scale
        own = table[self.words :]
        flat[:, : 1 + k] += z @ own[:, : 1 + k]
        flat[:, 1 + k :] += (z * z) @ own[:, 1 + k :]
        sums = flat[:, 1 : 1 + k]
        return self.w0[0] + flat[:, 0] + 0.5 * (sums**2 - flat[:, 1 + k :]).sum(1), sums

    def fit(self, bucket, value, offs, stats, label) -> Machine:
        p, rng = self.p, np.random.default_rng(self.p.seed)
        self.mean, self.scale = stats.mean(0), np.maximum(stats.std(0), 1e-3)
        params = [self.w0, self.w, self.v]
        first, second, t = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params], 0
        positive = float(np.clip(label.mean(), 1e-3, 1 - 1e-3))
        weight = np.where(label > 0.5, 0.5 / positive, 0.5 / (1 - positive)).astype(np.float32)
        for _ in range(p.epochs):
            order = rng.permutation(len(label))
            for a in range(0, len(order), p.batch):
                rows = order[a : a + p.batch]
                sizes = offs[rows + 1] - offs[rows]
                o = np.concatenate([[0], np.cumsum(sizes)])
                at = np.arange(o[-1]) + np.repeat(offs[rows] - o[:-1], sizes)
                b, x, z = bucket[at], value[at], (stats[rows] - self.mean) / self.scale
                margin, sums = self.raw(b, x, o, stats[rows])
                g = ((1 / (1 + np.exp(-np.clip(margin, -30, 30))) - label[rows]) * weight[rows] / len(rows)).astype(np.float32)
                gw, gv = np.zeros_like(self.w), np.zeros_like(self.v)
                doc = np.repeat(np.arange(len(rows)), sizes)
                gx = g[doc] * x
                gw[: self.words] = np.bincount(b, gx, self.words)
                gw[self.words :] = g @ z
                for f in range(p.factors):
                    gv[: self.words, f] = np.bincount(b, gx * (sums[doc, f] - self.v[b, f] * x), self.words)
                gv[self.words :] = z.T @ (g[:, None] * sums) - self.v[self.words :] * (g @ (z * z))[:, None]
                t += 1
                for i, grad in enumerate((np.array([g.sum()], np.float32), gw + p.decay * self.w, gv + p.decay * self.v)):
                    first[i] += 0.1 * (grad - first[i])
                    second[i] += 0.001 * (grad * grad - second[i])
                    params[i] -= (p.rate * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self


def features(part: pa.RecordBatch, bits: int):
    text = X.text_bytes(part.column("text"))
    words = X.find_words(text)
    h = X.hash_words(words)
    lowered = X.find_words(text, lower=True)
    return *word_weights(lowered, X.hash_words(lowered), bits), S.structure(text, words, h)


def train(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> Machine | None:
    """A machine fitted on the bounded sample of labelled rows, or None without any."""
    known = labels.filter("quality is not null").filter(~held_out()).groupBy("doc_id").agg(F.avg("quality").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.train_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # broadcast: at most train_rows rows
    rows = rows.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("tie"), "text")).alias("m")).select("doc_id", "label", F.col("m.text").alias("text"))

    def make():
        def run(part):
            bucket, value, offs, stats = features(part, p.bits)
            packed = [bucket[a:b].astype(np.uint16).tobytes() + value[a:b].tobytes() for a, b in zip(offs[:-1], offs[1:], strict=True)]
            return [part.column("label"), pa.array(packed, pa.binary()), pa.array([s.tobytes() for s in stats], pa.binary())]

        return run

    got = X.map_texts(rows, make, "label double, words binary, stats binary", ("text", "label")).collect()  # train_rows rows of a few kB
    if not got:
        return None
    got.sort(key=lambda r: r.doc_id)
    bucket, value, sizes = [], [], []
    for r in got:
        n = len(r.words) // 6
        bucket.append(np.frombuffer(r.words, np.uint16, n).astype(np.int64))
        value.append(np.frombuffer(bytes(r.words[2 * n :]), np.float32))
        sizes.append(n)
    stats = np.stack([np.frombuffer(r.stats, np.float32) for r in got])
    label = np.array([r.label for r in got], np.float32)
    return Machine(p).fit(np.concatenate(bucket), np.concatenate(value), np.concatenate([[0], np.cumsum(sizes)]), stats, label)


def classify(docs: DataFrame, machine: Machine | None, p: Params = Params(), row: bool = False) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""

    def run(part):
        if machine is None:
            return [pa.array(np.full(part.num_rows, p.prior))]
        margin, _ = machine.raw(*features(part, p.bits))
        return [pa.array(1 / (1 + np.exp(-np.clip(margin.astype(np.float64), -30, 30))))]

    scored = X.map_texts(docs, lambda: run, "score double", row=row)
    return scored.withColumn("held_out", held_out()).withColumn("predicted", (F.col("score") >= p.threshold).cast("int"))


def quality_classifier(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    return classify(docs, train(docs, labels, p), p)
