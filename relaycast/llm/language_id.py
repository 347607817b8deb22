"""Language identification with error-correcting output codes.

Each learned language has a codeword; each bit of it is predicted by a logistic classifier over hashed byte
n-grams (one to three bytes, with word edges). Decoding adds up every bit's logistic loss against each
codeword, weighted by how reliable that bit was in training, and takes the codeword of least loss; when the
runner-up is nearly as near, the answer is flagged as ambiguous. Up to six languages get exhaustive codes
(every way to split them in two), more get the best of seeded random codes.

Training: texts with a lang whose crc32(doc_id as text) mod 3 is not 1, at most ``train_rows`` of them and
at most an equal share of each language, chosen by the smallest hash of their identifier. Their n-grams are
counted on executors over whole texts, and only these counts reach the driver. lang, source and doc_id are
never inputs of a prediction. Scoring: one Arrow pass over whole texts; n-grams are looked up
once for each distinct word of a chunk.

Defined cases: null texts and texts without a letter are ``und`` with score 0; without training rows every
other text is ``und`` too, with score 0; with one learned language all are that language; equal losses go
to the first language by name; a null identifier is not held out; repeated rows are judged one by one; other columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import _text as X


@dataclass(frozen=True)
class Params:
    bits: int = 13  # of hashed n-grams
    train_rows: int = 4000  # bound of the training sample; one row for each language where these are more
    epochs: int = 25
    rate: float = 0.05
    decay: float = 1e-5
    scale: float = 30.0
    ambiguous: float = 0.2  # relative gap to the runner-up
    seed: int = 8


def held_out():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))


def codes(k: int, seed: int) -> np.ndarray:
    """k codewords of -1 and 1, far from one another; no column is constant."""
    if k < 2:
        return np.ones((k, 1), np.float32)
    if k <= 6:
        columns = [[1, *(1 if c >> i & 1 else -1 for i in range(k - 1))] for c in range((1 << (k - 1)) - 1)]
        return np.array(columns, np.float32).T
    rng, best = np.random.default_rng(seed), None
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], (k, int(np.ceil(10 * np.log2(k))))).astype(np.float32)
        code = code[:, np.abs(code.sum(0)) < k]
        apart = ((code.shape[1] - code @ code.T) / 2 + np.eye(k) * 1e9).min()
        if best is None or apart > best[0]:
            best = (apart, code)
    return best[1]


def word_grams(words: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of the words, and the word that each comes from."""
    raw = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint64)
    word = np.cumsum(raw == 32) - 1
    out, of, n = [], [], len(raw)
    for size in (1, 2, 3):
        at = np.arange(n - size + 1)
        at = at[raw[at] != 32] if size == 1 else at[raw[at + 1] != 32] if size == 3 else at
        if size == 2:
            at = at[(raw[at] != 32) | (raw[at + 1] != 32)]
        value = np.full(len(at), size, np.uint64)
        for j in range(size):
            value = value << np.uint64(8) | raw[at + j]
        out.append((X.mix(value) >> np.uint64(64 - bits)).astype(np.int64))
        of.append(np.minimum(word[at], len(words) - 1))
    return np.concatenate(out), np.concatenate(of)


def _distinct(words: X.Words) -> tuple[list[bytes], np.ndarray]:
    _, at, back = np.unique(X.hash_words(words), return_index=True, return_inverse=True)
    return [words.data[s:e].tobytes() for s, e in zip(words.starts[at], words.ends[at], strict=True)], back


def gram_counts(words: X.Words, bits: int):
    """Yields how often each hashed n-gram stands in each text."""
    distinct, back = _distinct(words)
    gram, of = word_grams(distinct, bits) if distinct else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    order = np.argsort(of, kind="stable")
    gram, start = gram[order], np.searchsorted(of[order], np.arange(len(distinct) + 1))
    for a, b in zip(words.offs[:-1], words.offs[1:], strict=True):
        own = back[a:b]
        many = start[own + 1] - start[own]
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(start[own], many)
        yield np.bincount(gram[at], minlength=1 << bits)


def pack(counts: np.ndarray) -> bytes:
    """Places and values of the counts that are not 0, compressed."""
    at = np.flatnonzero(counts)
    return zlib.compress(np.concatenate([at, counts[at]]).astype("<i4").tobytes(), 1)


def unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zlib.decompress(raw), "<i4")
    return both[: len(both) // 2], both[len(both) // 2 :].astype(np.int64)


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray  # languages x bits
    weight: np.ndarray  # n-grams x bits
    bias: np.ndarray
    trust: np.ndarray  # of each bit, from training
    p: Params

    def margins(self, words: X.Words) -> np.ndarray:
        n, k = len(words.offs) - 1, self.code.shape[1]
        out = np.zeros((n, k + 1), np.float32)
        if len(words.starts):
            distinct, back = _distinct(words)
            gram, of = word_grams(distinct, self.p.bits)
            order = np.argsort(of, kind="stable")
            rows = np.hstack([self.weight[gram[order]], np.ones((len(gram), 1), np.float32)])
            each = np.add.reduceat(rows, np.flatnonzero(np.diff(of[order], prepend=-1)), axis=0)
            some = np.flatnonzero(words.counts)
            out[some] = np.add.reduceat(each[back], words.offs[some], axis=0)
        return out[:, :k] * self.p.scale / np.maximum(out[:, k:], 1) + self.bias

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its share of belief, and whether the runner-up is as near."""
        loss = np.stack([(np.logaddexp(0, -margins * c) * self.trust).sum(1) for c in self.code], 1)
        best = loss.argmin(1)
        belief = np.exp(loss.min(1, keepdims=True) - loss)
        score = 1 / belief.sum(1)
        two = np.partition(loss, 1, 1)[:, :2] if loss.shape[1] > 1 else np.stack([loss[:, 0], loss[:, 0] + 1e9], 1)
        return best, score, two[:, 1] - two[:, 0] < self.p.ambiguous * np.maximum(two[:, 1], 1e-9)


def train(docs: DataFrame, p: Params = Params()) -> Model | None:
    known = docs.filter("lang is not null and text is not null").filter(~held_out()).select("doc_id", "lang", "text")
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).collect()  # one row a language: all are learnt
    if not counts:
        return None
    langs = sorted(r.lang for r in counts)
    each = max(1, p.train_rows // len(langs))
    # A range of hashes that holds about twice the rows wanted goes first, so that no language meets in one task.
    share = {r.lang: min(1.0, 2.0 * each / r.n + 100 / r.n) for r in counts}
    limits = docs.sparkSession.createDataFrame([(k, int(-(1 << 63) + v * ((1 << 64) - 1)) if v < 1 else (1 << 63) - 1) for k, v in share.items()], "lang string, most long")
    some = known.withColumn("h", F.xxhash64(F.col("doc_id").cast("string"))).join(F.broadcast(limits), "lang").filter("h <= most")  # one row a language, counted above
    some = some.select("doc_id", "h", "lang", F.xxhash64("text").alias("tie"), "text")

    def counted(part):
        words = X.find_words(X.text_bytes(part.column("text")), X.ALNUM, lower=True)
        return [part.column("h"), part.column("lang"), part.column("tie"), pa.array([pack(c) for c in gram_counts(words, p.bits)], pa.binary())]

    found = X.map_texts(some, lambda: counted, "h long, lang string, tie long, grams binary", ("text", "h", "lang", "tie"))
    ranked = found.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("h", "tie"))).filter(F.col("r") <= each)
    rows = sorted(ranked.select("h", "lang", "tie", "grams").collect(), key=lambda r: (r.h, r.lang, r.tie))  # counts of at most train_rows rows
    code = codes(len(langs), p.seed)
    dim = 1 << p.bits
    x = np.zeros((len(rows), dim), np.float32)
    for i, r in enumerate(rows):
        gram, many = unpack(r.grams)
        if len(gram):
            x[i, gram] = many * (p.scale / many.sum())
    number = {k: i for i, k in enumerate(langs)}
    y = code[[number[r.lang] for r in rows]]
    weight, bias, rng = np.zeros((dim, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32), np.random.default_rng(p.seed)
    speed, speed_bias = np.full_like(weight, 1e-8), np.full_like(bias, 1e-8)
    for _ in range(p.epochs):
        for at in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 500)):
            g = -y[at] / (1 + np.exp(np.clip(y[at] * (x[at] @ weight + bias), -30, 30))) / len(at)
            for param, accumulated, grad in ((weight, speed, x[at].T @ g + p.decay * weight), (bias, speed_bias, g.sum(0))):
                accumulated += grad * grad
                param -= p.rate * grad / np.sqrt(accumulated)
    right = ((x @ weight + bias) * y > 0).mean(0)
    trust = np.clip(np.log(np.clip(right, 0.5, 0.999) / (1 - np.clip(right, 0.5, 0.999))), 0.05, None)
    return Model(langs, code, weight, bias, (trust / trust.mean()).astype(np.float32), p)


_ASCII_LETTER = np.array([0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A for b in range(256)])


def has_letter(text: X.Bytes) -> np.ndarray:
    letters = X.per_doc(_ASCII_LETTER[text.data].astype(np.int32), text.offs) > 0
    for i in np.flatnonzero(~letters & (np.diff(text.offs) > 0)):
        raw = text.data[text.offs[i] : text.offs[i + 1]]
        letters[i] = (raw >= 0x80).any() and any(c.isalpha() for c in raw.tobytes().decode())
    return letters


def predict(docs: DataFrame, model: Model | None, row: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous for every document."""

    def run(part):
        text = X.text_bytes(part.column("text"))
        n, letters = part.num_rows, has_letter(text)
        if model is None:
            return [pa.array(["und"] * n, pa.string()), pa.array(np.zeros(n)), pa.array(np.ones(n, bool))]
        best, score, close = model.decode(model.margins(X.find_words(text, X.ALNUM, lower=True)).astype(np.float64))
        names = [model.langs[b] if ok else "und" for b, ok in zip(best.tolist(), letters.tolist(), strict=True)]
        return [pa.array(names, pa.string()), pa.array(np.where(letters, score, 0.0)), pa.array(close | ~letters)]

    return X.map_texts(docs, lambda: run, "lang_pred string, score double, ambiguous boolean", row=row).withColumn("held_out", held_out())


def language_id(docs: DataFrame, p: Params = Params()) -> DataFrame:
    return predict(docs, train(docs, p))
