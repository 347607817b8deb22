"""Quality rules by distribution divergence.

A text's histogram over character classes and its histogram over the commonest words are compared, by
Jensen-Shannon distance, with references gathered from the whole corpus for each language. A text is
rejected when its distance to *every* language's reference is above the limit and it is long enough for
the histogram to mean something (minimum-length guards). Counts (words, symbols, repeated lines, repeated
three-word windows) are exact over the whole text.

Two scans, no shuffle of texts: the first counts all words of all texts by language (combined within a task
before they leave it) and the commonest make the references, so these do not depend on how rows lie; a few
kB a language travel in the task closure of the second, which judges texts against them block by block.

Defined cases: null or empty text has no words, fails the base rule (fewer than 50 words) and is not kept;
a null ``lang`` gathers under ''; a language with fewer than ``guard_words`` words in the whole corpus has no
reference; without any reference no text is rejected for its distance; an empty table gives no rows; repeated
rows are judged one by one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import _text as X

# The classes of characters that are counted, those beyond ASCII by the first byte in UTF-8, which
# tells the scripts apart.
CLASSES = (
    "lower", "upper", "digit", "space", "sentence", "symbol", "other", "latin", "greek", "cyrillic", "hebrew_armenian",
    "arabic_syriac", "indic_thai", "georgian_to_khmer", "punctuation", "kana", "han", "hangul", "compatibility", "supplementary",
)
LEADS = ((0xC2, 7), (0xCD, 8), (0xD0, 9), (0xD4, 10), (0xD8, 11), (0xE0, 12), (0xE1, 13), (0xE2, 14), (0xE3, 15), (0xE4, 16), (0xEA, 17), (0xEE, 18), (0xF0, 19))
N = len(CLASSES)
SYMBOLS = b"#*$%&|<>"
SENTENCE = b".,;:?!'\"()-"


def _byte_class(b: int) -> int:
    if 0x61 <= b <= 0x7A:
        return 0
    if 0x41 <= b <= 0x5A:
        return 1
    if 0x30 <= b <= 0x39:
        return 2
    if b in X.ASCII_SPACE:
        return 3
    if b in SENTENCE:
        return 4
    if b in SYMBOLS:
        return 5
    if b < 0x80:
        return 6
    return max((c for lead, c in LEADS if b >= lead), default=N)  # N: continuation bytes, not counted


CLASS_OF = np.array([_byte_class(b) for b in range(256)], dtype=np.int64)


@dataclass(frozen=True)
class Rules:
    """Production parameters."""

    min_words: int = 50  # base rule
    repeat_percent: int = 50  # base rule
    top_words: int = 48  # common words of a language in its reference
    guard_chars: int = 150  # shorter texts aren't judged by characters
    guard_words: int = 50  # shorter texts aren't judged by words
    char_distance: float = 0.30
    word_distance: float = 0.46


def class_counts(text: X.Bytes) -> np.ndarray:
    """Rows: texts; columns: CLASSES, then continuation bytes."""
    n, k = len(text.offs) - 1, N + 1
    place = CLASS_OF[text.data]
    place += np.repeat(np.arange(n) * k, np.diff(text.offs))
    return np.bincount(place, minlength=n * k).reshape(n, k)


class _Counts:
    """(language, item) counts of a task, combined now and then; ``drain`` yields them as a batch."""

    def __init__(self, most: int = 1 << 20):
        self.most, self.names, self.parts, self.size = most, {}, [], 0

    def add(self, lang: str, item: np.ndarray, n: np.ndarray) -> bool:
        """True when the counts should be drained."""
        code = self.names.setdefault(lang, len(self.names))
        self.parts.append((np.full(len(item), code), item, n))
        self.size += len(item)
        if self.size > self.most:
            self._combine()
        return 2 * self.size > self.most

    def _combine(self):
        lang, item, n = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((item, lang))
        lang, item, n = lang[order], item[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], (lang[1:] != lang[:-1]) | (item[1:] != item[:-1])]))
        self.parts = [(lang[first], item[first], np.add.reduceat(n, first))]
        self.size = len(first)

    def drain(self):
        if self.size:
            self._combine()
            lang, item, n = self.parts[0]
            yield pa.RecordBatch.from_arrays([pa.array(list(self.names), pa.string()).take(pa.array(lang)), pa.array(item, pa.int64()), pa.array(n, pa.int64())], names=["lang", "item", "n"])
        self.names, self.parts, self.size = {}, [], 0


def references(docs: DataFrame, rules: Rules = Rules()) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By language: class shares, hashes of its common words, their shares (last: all other words); exact counts."""

    def count(batches):
        counts = _Counts()
        for batch in batches:
            for part in X.chunks(batch):
                text = X.text_bytes(part.column("text"))
                words = X.find_words(text, lower=True)
                h, classes = X.hash_words(words), class_counts(text)
                langs = part.column("lang").fill_null("").dictionary_encode()
                code, full = np.asarray(langs.indices), False
                of_word = np.repeat(code, words.counts)
                for k, lang in enumerate(langs.dictionary.to_pylist()):
                    keys, many = np.unique(h[of_word == k] >> np.uint64(2), return_counts=True)
                    own = np.append(classes[code == k].sum(0)[:N], many.sum())
                    full |= counts.add(lang, np.concatenate([np.append(-1 - np.arange(N), -100), keys.astype(np.int64)]), np.concatenate([own, many]).astype(np.int64))
                if full:
                    yield from counts.drain()
        yield from counts.drain()

    counts = docs.select("text", "lang").mapInArrow(count, "lang string, item long, n long").groupBy("lang", "item").agg(F.sum("n").alias("n"))
    ranked = counts.withColumn("r", F.row_number().over(W.partitionBy("lang", F.col("item") < 0).orderBy(F.desc("n"), "item")))
    # A bound that Spark pushes below the shuffle, so no task gathers a language's whole vocabulary.
    rows = ranked.filter(F.col("r") <= max(rules.top_words, N + 1)).filter((F.col("item") < 0) | (F.col("r") <= rules.top_words)).drop("r")
    by: dict[str, dict[int, int]] = {}
    for r in rows.toLocalIterator():  # some seventy rows a language
        by.setdefault(r.lang, {})[r.item] = r.n
    out = {}
    for lang, got in sorted(by.items()):
        if got.get(-100, 0) >= rules.guard_words:
            classes = np.array([got.get(-1 - i, 0) for i in range(N)], float)
            keys = np.array(sorted(k for k in got if k >= 0), np.int64)
            many = np.array([got[int(k)] for k in keys], float)
            out[lang] = (classes / max(classes.sum(), 1), keys, np.append(many, got[-100] - many.sum()) / got[-100])
    return out


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Root of the Jensen-Shannon divergence in bits: 0 for equal rows of p and q, 1 for disjoint ones."""
    m = (p + q) / 2

    def kl(a):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(a > 0, a * np.log2(a / m), 0.0).sum(-1)

    return np.sqrt(np.clip((kl(p) + kl(np.broadcast_to(q, p.shape))) / 2, 0, 1))


def distances(classes: np.ndarray, words: X.Words, lower_hash: np.ndarray, refs: dict, at_once: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """The least distance of each text to any reference, by characters and by words (0 without references)."""
    n = len(classes)
    shares = classes[:, :N] / np.maximum(classes[:, :N].sum(1, keepdims=True), 1)
    by_char, by_word = np.full(n, 1.0 if refs else 0.0), np.full(n, 1.0 if refs else 0.0)
    key, many, doc = (lower_hash >> np.uint64(2)).astype(np.int64), np.maximum(words.counts, 1), words.docs()
    each = list(refs.values())
    for block in (each[i : i + at_once] for i in range(0, len(each), at_once)):
        known = np.unique(np.concatenate([keys for _, keys, _ in block]))
        at = np.searchsorted(known, key)
        hit = np.flatnonzero(known[np.minimum(at, len(known) - 1)] == key)
        hist = np.bincount(doc[hit] * len(known) + at[hit], minlength=n * len(known)).reshape(n, len(known)) / many[:, None]
        for own, keys, ref in block:
            by_char = np.minimum(by_char, js_distance(shares, own))
            mine = hist[:, np.searchsorted(known, keys)]
            rest = np.where(words.counts > 0, 1 - mine.sum(1), 0)[:, None]
            by_word = np.minimum(by_word, js_distance(np.hstack([mine, np.maximum(rest, 0)]), ref))
    return by_char, by_word


def dup_lines(text: X.Bytes, words: X.Words) -> np.ndarray:
    """Lines with a word that equal an earlier line of the same text."""
    n = len(text.offs) - 1
    out = np.zeros(n, np.int64)
    lines = X.find_words(text, is_word=np.array([b != 10 for b in range(256)]))
    if not len(lines.starts):
        return out
    worded = np.searchsorted(words.starts, lines.ends) > np.searchsorted(words.starts, lines.starts)
    doc, h = lines.docs()[worded], X.hash_words(lines)[worded]
    return out + per_key_repeats(doc, h, n, first_too=False)


def per_key_repeats(doc: np.ndarray, h: np.ndarray, n: int, first_too: bool) -> np.ndarray:
    order = np.lexsort((h, doc))
    d, k = doc[order], h[order]
    same = (d[1:] == d[:-1]) & (k[1:] == k[:-1])
    again = np.concatenate([[False], same]) if len(d) else np.zeros(0, bool)
    if first_too and len(d):
        again = again | np.concatenate([same, [False]])
    return np.bincount(d[again], minlength=n)


def repeat_words(words: X.Words, h: np.ndarray, size: int = 3) -> np.ndarray:
    """Words inside windows of ``size`` words that occur twice or more in the same text."""
    first, doc = X.windows(words.counts, size)
    if not len(first):
        return np.zeros(len(words.offs) - 1, np.int64)
    key = X.combine(h, first, size) ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    k = key[order]
    same = k[1:] == k[:-1]
    twice = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    return X.per_doc(X.cover(words.offs, first[order[twice]], size, len(h)), words.offs)


def score(docs: DataFrame, refs: dict, rules: Rules = Rules(), row: bool = False) -> DataFrame:
    """Every document's counts, distances and verdict against given references."""

    def judge(part):
        text = X.text_bytes(part.column("text"))
        words = X.find_words(text)
        lowered = X.find_words(text, lower=True)
        classes = class_counts(text)
        chars, spread = distances(classes, lowered, X.hash_words(lowered), refs)
        n, code_points = words.counts, classes[:, :N].sum(1)
        repeated = repeat_words(words, X.hash_words(words))
        failed = (n < rules.min_words) | (100 * repeated > rules.repeat_percent * n)
        odd = ((code_points >= rules.guard_chars) & (chars > rules.char_distance)) | ((n >= rules.guard_words) & (spread > rules.word_distance))
        counts = [n, code_points - classes[:, 3], classes[:, 5], dup_lines(text, words), repeated]
        return [*(pa.array(c.astype(np.int64)) for c in counts), pa.array(failed), pa.array(~failed & ~odd), pa.array(chars), pa.array(spread)]

    out = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, char_distance double, word_distance double"
    return X.map_texts(docs, lambda: judge, out, row=row)


def quality_rules(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    return score(docs, references(docs, rules), rules)
