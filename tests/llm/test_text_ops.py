"""op11, op12, op13 against the library and brute force, and on odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from relaycast.llm import _agenda, queries, sentencepiece_bpe, source_audit, spelling
from relaycast.llm import _text as X
from relaycast.llm._automaton import Automaton, Strings

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
AZ = {c: c + 32 for c in range(65, 91)}


@pytest.fixture(scope="module")
def odd_rows():
    rng = random.Random(8)
    stems = ["colour", "color", "colours", "über", "überall", "fiancée", "fiancee", "abcdefg"]
    prose = " ".join(rng.choice(stems) + rng.choice(["", "s", "x", ""]) for _ in range(400))
    texts = [None, "", " \n\t", "one", prose, prose, prose.upper(), "x" * 3000 + " 漢字 😀 <s> </s> ▁", "a  b\n\n   c", "É×÷ß", "w" * 700 + "\n", "aaaaa aaaaab aaaab " * 40]
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else "s", None) for i, t in enumerate(texts)]
    return [*rows, rows[4], (6, prose + " end", "en", "t", 3), (None, prose, "de", "s", None), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


def clashing(df):
    return df.withColumns({n: F.lit(n) for n in ("row", "word", "n", "term", "item", "value", "rank", "part", "p", "ids", "root", "form", "back", "n_tokens")})


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ---------------------------------------------------------------- op11


@pytest.fixture(scope="module")
def model():
    return sentencepiece_bpe.load(queries.tokenizer_path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path("piece_bpe_32k.model"))


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def test_op11(spark, sf_dir, library):
    got = {r.doc_id: r for r in queries.op11_sentencepiece(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for i, text in docs:
        ids = library.encode(text or "", add_eos=True)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)))


def test_op11_odd(spark, odd, odd_rows, library):
    path = queries.tokenizer_path("piece_bpe_32k.model")
    key = lambda rows: sorted(rows, key=repr)
    got = sentencepiece_bpe.encode_decode(clashing(odd), path, row=True).collect()
    want = [(r[0], ids := library.encode(r[1] or "", add_eos=True), library.decode(ids)) for r in odd_rows]
    assert key((r.doc_id, list(r.ids), r.decoded) for r in got) == key(want)
    assert sentencepiece_bpe.encode_decode(empty(spark), path).count() == 0


@pytest.mark.parametrize(
    "alphabet, longest",
    [("ACGT", 3000), ("abcdefghijklmnopqrstuvwxyz", 2000), ("ab", 600), (" ▁a", 200), ("aaaab", 2500), ("0123456789.,", 300), ("".join(map(chr, [*range(32, 127), *range(0xA0, 0x250), *range(0x3B0, 0x400), *range(0x4E00, 0x4F00), *range(0x1F600, 0x1F620)])), 400), (["the", " ", "ing", "\n", "  ", "é", "▁", "\x00"], 300)],
)
def test_op11_random_texts(model, library, alphabet, longest):
    rng = random.Random(11)
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, longest))) for _ in range(60)]
    ids, offs = model.encode(X.text_bytes(pa.array(texts)))
    want = library.encode(texts, add_eos=True)
    assert [ids[a:b].tolist() for a, b in zip(offs[:-1], offs[1:], strict=True)] == want
    assert model.decode(ids, offs) == library.decode(want)


def test_op11_text_of_five_megabytes(spark, library):
    text = " ".join(["whole", "texts", "stay", "whole"] * 250_000)
    got = sentencepiece_bpe.encode_decode(spark.createDataFrame([(1, text)], "doc_id long, text string"), queries.tokenizer_path("piece_bpe_32k.model"), digests=True).first()
    ids = library.encode(text, add_eos=True)
    assert (got.n_tokens, got.ids_sha256, got.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(text))


def test_op11_fails_where_the_library_differs(monkeypatch):
    own = sentencepiece_bpe.SentencePieceBpe(queries.tokenizer_path("piece_bpe_32k.model"))
    text = X.text_bytes(pa.array(["unspeakably misremembered counterexamples, zqxjkv"]))
    with monkeypatch.context() as m:
        m.setattr(own.agenda, "rank", own.agenda.rank.max() - own.agenda.rank)
        with pytest.raises(ValueError, match="otherwise"):
            own.encode(text)


def test_agenda_in_parts_equals_one_heap(monkeypatch):
    """Short parts and narrow spans force repairs; scores that don't grow with length force late merges."""
    rng = random.Random(3)
    for _ in range(30):
        alphabet = "abc"
        entries = {"".join(rng.choices(alphabet, k=rng.randint(2, 5))) for _ in range(25)}
        strings = sorted(entries | set(alphabet))
        number = {s: i for i, s in enumerate(strings)}
        score = {s: rng.randint(0, 12) for s in entries}
        pairs = sorted((number[s[:k]] << 32 | number[s[k:]], score[s], number[s]) for s in entries for k in range(1, len(s)) if s[:k] in number and s[k:] in number)
        keys, rank, made = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        agenda = _agenda.Agenda(keys, rank, made, np.array([len(s) for s in strings]))
        texts = [rng.choices([number[c] for c in alphabet], k=rng.randint(1, 120)) for _ in range(40)]
        monkeypatch.setattr(_agenda, "PART", rng.choice([2, 3, 7]))
        monkeypatch.setattr(_agenda, "WIDE", rng.choice([4, 9, 300]))
        flat, many = agenda.merge(np.array([t for x in texts for t in x], np.int64), np.cumsum([0, *map(len, texts)]))
        ends = np.cumsum(many)
        assert [flat[b - m : b].tolist() for b, m in zip(ends, many, strict=True)] == [agenda.one(list(x)) for x in texts]


# ---------------------------------------------------------------- op12


def is_near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(rows, rule):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(AZ)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run if h % rule.noise else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: c for w, c in counts.items() if len(w) >= rule.min_chars and c >= rule.min_count}
    near = {w: [v for v in n if is_near(w, v)] for w in n}
    best = {w: min(v, key=lambda x: (-n[x], x)) for w, v in near.items() if v}
    form = {w: b if b and n[b] >= rule.ratio * n[w] else None for w in n for b in [best.get(w)]}
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n[w], len(near[w]), form[w], form[w] and n[form[w]], root))
    return sorted(out)


COLUMNS = ["word", "n", "n_near", "form", "form_n", "root"]


@pytest.mark.parametrize("bucket", [60_000, 40])
def test_op12(spark, sf_dir, bucket):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rule = spelling.Spelling(bucket=bucket)
    rows = docs.select("doc_id", "text").limit(40).collect()
    got = spelling.spelling_variants(spark.createDataFrame(rows), rule).select(COLUMNS).collect()
    want = variants(rows, rule)
    assert sorted(map(tuple, got)) == want and sum(r[3] is not None for r in want) > 3


@pytest.mark.parametrize("rule", [spelling.Spelling(), spelling.Spelling(noise=3), spelling.Spelling(min_chars=1, min_count=1, noise=5), spelling.Spelling(min_chars=1, min_count=1, bucket=3)])
def test_op12_odd(spark, odd, odd_rows, rule):
    got = spelling.spelling_variants(clashing(odd), rule).select(COLUMNS).collect()
    assert sorted(map(tuple, got)) == variants([r[:2] for r in odd_rows], rule)


def test_op12_nothing(spark):
    assert spelling.spelling_variants(empty(spark)).collect() == []


def test_op12_hot_half_is_split(spark):
    """All words share their first half; the bucket becomes a grid."""
    rng = random.Random(4)
    words = sorted({"prefix" + "".join(rng.choices("abc", k=6)) for _ in range(900)})
    rows = [(i, " ".join(w for w in words for _ in range(3 + len(w) % 3 + (i + ord(w[-1])) % 5))) for i in range(2)]
    rule = spelling.Spelling(bucket=50)
    got = spelling.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string"), rule).select(COLUMNS).collect()
    assert sorted(map(tuple, got)) == variants(rows, rule)


def test_op12_checksums_of_long_words():
    words = ["a", "é" * 40, "b" * 64, "c" * 65, "é" * 1000]
    runs = spelling.letter_runs(X.text_bytes(pa.array([" ".join(words), "x", None])))
    assert spelling.checksums(runs, [b"12", b"", b"7"]).tolist() == [*(zlib.crc32(f"12:{w}".encode()) for w in words), zlib.crc32(b":x")]


@pytest.mark.parametrize("seed", range(6))
def test_automaton(seed):
    """Word numbers are places in the sorted list, and one error behind the exact part is all and only what loops find."""
    rng = random.Random(seed)
    words = sorted({"".join(rng.choices("abé", k=rng.randint(0, 7))) for _ in range(rng.randint(1, 250))})
    strings = Strings.of_latin(pa.array(words))
    strings = strings.take(strings.order())
    machine = Automaton(strings)
    assert machine.words[machine.root] == len(words) and machine.numbers(strings).tolist() == list(range(len(words)))
    assert machine.numbers(Strings.of_latin(pa.array(["zz", "abcabc" * 3]))).tolist() == [-1, -1]
    who, found = machine.one_error(strings, strings.size // 2)
    want = {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if is_near(a, b) and a[: len(a) // 2] == b[: len(a) // 2]}
    assert len(who) == len(want) and set(zip(who.tolist(), found.tolist(), strict=True)) == want


def test_automaton_is_minimal():
    words = sorted(a + b for a in ("ab", "cd", "x") for b in ("ing", "ed", "s"))
    strings = Strings.of_latin(pa.array(words))
    assert len(Automaton(strings.take(strings.order())).final) == len({frozenset(w[len(p) :] for w in words if w.startswith(p)) for v in words for p in (v[:k] for k in range(len(v) + 1))})


# ---------------------------------------------------------------- op13


def audited(rows, audit):
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")
        terms = [t.translate(AZ) for t in terms]
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= audit.min_docs]
        sources = [s for x, s in counts if x == lang]

        def weights(count, kept=kept):
            below = sum(count[t] for t in kept) + audit.added * len(kept)
            return {t: 1 + audit.scale * (count[t] + audit.added) // below for t in kept}

        whole = weights(sum((counts[lang, s] for s in sources), Counter()))
        p = {s: weights(counts[lang, s]) for s in sources}
        for s in sources:
            found = [("pair", o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s]
            found += [("term", t, p[s][t] - whole[t]) for t in kept if counts[lang, s][t] and p[s][t] > whole[t]]
            for part, top in (("pair", None), ("term", audit.top)):
                ranked = sorted((x for x in found if x[0] == part), key=lambda x: (-x[2], x[1].encode()))[:top]
                out += [(lang, s, *x, r) for r, x in enumerate(ranked, 1)]
    return sorted(out)


@pytest.mark.parametrize("audit", [source_audit.Audit(), source_audit.Audit(min_docs=3, block_cells=50, most_cells=60), source_audit.Audit(min_docs=1000)])
def test_op13(spark, sf_dir, audit):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source")
    assert sorted(map(tuple, source_audit.source_audit(docs, audit).collect())) == audited(docs.collect(), audit)


@pytest.mark.parametrize("audit", [source_audit.Audit(), source_audit.Audit(min_docs=1, added=1, scale=7, top=3, block_cells=4)])
def test_op13_odd(spark, odd, odd_rows, audit):
    got = source_audit.source_audit(clashing(odd), audit).collect()
    assert sorted(map(tuple, got)) == audited([r[1:4] for r in odd_rows], audit)
    assert source_audit.source_audit(empty(spark), audit).collect() == []


def test_op13_weak_hashes_change_nothing():
    batch = pa.record_batch({"text": ["ab ba ab c abc", "ba cd ab", None], "lang": ["x", "x", None], "source": ["s", None, "s"]})
    rows = lambda b: sorted((tuple(r.values()) for r in b.to_pylist()), key=repr)
    assert rows(source_audit.chunk_counts(batch, digest=len)) == rows(source_audit.chunk_counts(batch))
    assert rows(source_audit.chunk_counts(batch, digest=lambda s: 1)) == rows(source_audit.chunk_counts(batch))


def test_op13_divergences():
    rng = np.random.default_rng(1)
    for rows, width in ((1, 3), (5, 40), (7, 1), (3, 0)):
        base, full = rng.integers(0, 50, rows), rng.integers(0, 50, (rows, width))
        there = rng.random((rows, width)) < 0.3
        dense = np.where(there, full, base[:, None])
        r, c = np.nonzero(there)
        got = source_audit.divergences(np.searchsorted(r, np.arange(rows + 1)), c, full[r, c], base, width)
        assert [x.tolist() for x in got] == [np.abs(dense[g] - dense[g + 1 :]).sum(1).tolist() for g in range(rows - 1)]
