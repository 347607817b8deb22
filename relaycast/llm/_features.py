"""Features of texts for the trained models: hashed words and structure, vectorised."""

from __future__ import annotations

import numpy as np

from . import _text as X

# Groups of bytes whose shares are counted.
_GROUPS = (
    b"abcdefghijklmnopqrstuvwxyz",
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    b"0123456789",
    b" ",
    b"\n",
    b".,;:?",
    b"!",
    b"|",
    b"#*$%&<>",
    b"\"'()-",
    b"@/\\_=+~^`[]{}",
)
_GROUP_OF = np.full(256, len(_GROUPS), np.int64)
for _i, _g in enumerate(_GROUPS):
    _GROUP_OF[list(_g)] = _i
N_GROUPS = len(_GROUPS) + 1
STRUCTURE = tuple(f"share_{i}" for i in range(N_GROUPS)) + ("log_words", "word_length", "distinct_share", "line_words", "upper_start", "repeat_share")


def structure(text: X.Bytes, words: X.Words, h: np.ndarray) -> np.ndarray:
    """One row of STRUCTURE values for each text; all of moderate size."""
    n = len(text.offs) - 1
    out = np.zeros((n, len(STRUCTURE)), np.float32)
    for i in range(n):
        out[i, :N_GROUPS] = np.bincount(_GROUP_OF, np.bincount(text.data[text.offs[i] : text.offs[i + 1]], minlength=256), N_GROUPS)
    newlines = out[:, 4].copy()
    out[:, :N_GROUPS] /= np.maximum(np.diff(text.offs), 1)[:, None]
    many = np.maximum(words.counts, 1)
    out[:, N_GROUPS] = np.log1p(words.counts) / 10
    out[:, N_GROUPS + 1] = X.per_doc(words.ends - words.starts, words.offs) / many / 10
    key = h ^ X.mix(words.docs().astype(np.uint64) + np.uint64(1))
    order = np.argsort(key)
    new = np.ones(len(key), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    doc = words.docs()[order]
    out[:, N_GROUPS + 2] = np.bincount(doc[new], minlength=n) / many
    out[:, N_GROUPS + 3] = np.log1p(words.counts / (newlines + 1)) / 5
    first = words.data[words.starts] if len(words.starts) else np.zeros(0, np.uint8)
    out[:, N_GROUPS + 4] = X.per_doc((first >= 65) & (first <= 90), words.offs) / many
    # How much the commonest word of a text repeats.
    begin = np.flatnonzero(new)
    runs = np.diff(np.append(begin, len(key)))
    most = np.zeros(n, np.int64)
    np.maximum.at(most, doc[begin], runs)
    out[:, N_GROUPS + 5] = most / many
    return out
