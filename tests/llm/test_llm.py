"""The pipeline operators against brute force, and on nulls, empty and long texts, ties, repeats, empty tables, odd columns."""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
from tokenizers import Tokenizer  # noqa: E402

from relaycast.llm import bpe, chat, decontaminate, factorisation_machine, language_id, line_dedup, near_dedup, pieces, quality_rules, queries, sstable, substring_dedup  # noqa: E402
from relaycast.llm import _text as X  # noqa: E402
from relaycast.llm._graph import components  # noqa: E402
from relaycast.llm.fm_index import FMIndex  # noqa: E402

AZ = {c: c + 32 for c in range(65, 91)}
SPACED, ALNUM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


@pytest.fixture(scope="module")
def documents(sf_dir):
    return duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall()


@pytest.fixture(scope="module")
def odd_rows():
    """Nulls everywhere, empty, blank, long and repeated texts, ties, rows twice."""
    rng = random.Random(5)
    prose = " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(120))
    lines = "\n".join(" ".join("".join(rng.choices("klmnop", k=5)) for _ in range(9)) for _ in range(8))
    texts = [None, "", "  \n\t ", "one", "one two", "One TWO", prose, prose, prose + " end", prose.upper(), lines, "x\n" + lines, lines + "\ny", "ä ö ü 漢字 😀   é", "a" * 5000, ("w " * 30_000).strip(), "'s don't <|endoftext|> it'll  \n\n x", "\n\n\n"]
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else "s", None) for i, t in enumerate(texts)]
    return [*rows, rows[6], (6, "other text of the same id", "en", "s", 3), (None, prose, None, None, None), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, None) for i in range(12)] + [(3, None, 1), (3, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([("a", "one two"), ("b", "ONE!"), ("c", None), ("d", ""), ("e", "... --")], "item_id string, text string")


def clashing(df):
    names = ["row", "words", "ids", "spans", "score", "bands", "kept", "id", "text_hash", "lines", "n_words", "component", "ranges", "section", "h", "at"]
    return df.withColumns({n: F.lit(n) for n in names})


def crc(i) -> int:
    return zlib.crc32(str(i).encode())


# ---------------------------------------------------------------- brute force


def base_rules(t):
    w = SPACED.findall(t or "")
    tri = defaultdict(list)
    for i in range(len(w) - 2):
        tri[tuple(w[i : i + 3])].append(i)
    again = {j for at in tri.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
    seen, dups = set(), 0
    for line in (t or "").split("\n"):
        if SPACED.search(line):
            dups += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), dups, len(again), failed


def test_op1_counts(spark, sf_dir, documents):
    got = {r.doc_id: r for r in queries.op1_quality_rules(spark, sf_dir).collect()}
    for i, t in documents:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_rules(t)
        assert not (r.kept and r.base_failed)


def test_op1_rejects_junk_and_keeps_clean(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")  # references need some hundred texts
    got = queries.op1_quality_rules(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").filter("n_words >= 50").collect()
    assert all(r.kept for r in got if r.quality == 1)
    assert np.mean([not r.kept for r in got if r.quality == 0]) >= 0.75


def test_op1_odd(odd, odd_rows, empty):
    got = quality_rules.quality_rules(odd).collect()
    assert sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == sorted(base_rules(r[1])[:5] for r in odd_rows)
    assert quality_rules.quality_rules(empty).count() == 0
    assert quality_rules.quality_rules(clashing(odd)).count() == len(odd_rows)


def quality_by_hand(docs, rules):
    """References from counters, distances from dictionaries; docs: (id, text, lang)."""
    from collections import Counter

    N, cls = quality_rules.N, quality_rules.CLASS_OF
    kinds, words = defaultdict(Counter), defaultdict(Counter)
    for _, t, lang in docs:
        kinds[lang or ""].update(cls[b] for b in (t or "").encode() if cls[b] < N)
        words[lang or ""].update(SPACED.findall((t or "").translate(AZ)))

    def js(p, q):
        kl = lambda a, b: sum(x * math.log2(x / b[k]) for k, x in a.items() if x)
        m = {k: (p.get(k, 0) + q.get(k, 0)) / 2 for k in {*p, *q}}
        return math.sqrt(max(0, (kl(p, m) + kl(q, m)) / 2))

    def share(c, keep=None):
        n = max(1, sum(c.values()))
        out = {k: v / n for k, v in c.items() if keep is None or k in keep}
        return out if keep is None else out | {None: 1 - sum(out.values()) if c else 0}

    refs = []
    for lang, c in words.items():
        if sum(c.values()) >= rules.guard_words:
            hashed = {w: int(h >> np.uint64(2)) for w, h in zip(c, X.hash_words(X.find_words(X.text_bytes(pa.array([" ".join(c)])))), strict=True)}
            top = set(sorted(c, key=lambda w: (-c[w], hashed[w]))[: rules.top_words])
            refs.append((share(kinds[lang]), share(c, top), top))
    out = {}
    for d, t, _ in docs:
        k, c = Counter(cls[b] for b in (t or "").encode() if cls[b] < N), Counter(SPACED.findall((t or "").translate(AZ)))
        far = min(js(share(k), r) for r, _, _ in refs), min(js(share(c, top), r) for _, r, top in refs)
        odd = (sum(k.values()) >= rules.guard_chars and far[0] > rules.char_distance) or (sum(c.values()) >= rules.guard_words and far[1] > rules.word_distance)
        out[d] = (*far, not base_rules(t)[5] and not odd)
    return out


def test_op1_equals_brute_force_in_any_layout(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = quality_by_hand([(r.doc_id, r.text, r.lang) for r in docs.collect()], quality_rules.Rules())
    for parts in (1, 23):
        for r in quality_rules.quality_rules(docs.repartition(parts)).collect():
            assert (r.char_distance, r.word_distance) == pytest.approx(want[r.doc_id][:2], abs=1e-6) and r.kept == want[r.doc_id][2]


def test_op1_many_languages(spark):
    """Each of 300 languages has its reference."""
    rows = [(i, " ".join(f"l{i % 300}w{j % 9}" for j in range(60)), f"lang{i % 300}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(quality_rules.references(docs)) == 300
    assert all(r.word_distance < 1e-6 for r in quality_rules.quality_rules(docs).collect())


def test_js_distance():
    p = np.array([[0.5, 0.5, 0.0], [0.0, 0.0, 1.0]])
    assert quality_rules.js_distance(p, np.array([0.5, 0.5, 0.0])) == pytest.approx([0, 1])


def contamination(docs, items):
    windows = defaultdict(set)
    for item, t in items:
        w = ALNUM.findall((t or "").translate(AZ))
        for i in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[i : i + 13])].add(str(item))
    sizes, out = sorted({len(k) for k in windows}), []
    for d, t in docs:
        w, items_hit = ALNUM.findall((t or "").translate(AZ)), set()
        hit = [False] * len(w)
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in windows:
                    items_hit |= windows[k]
                    hit[i : i + n] = [True] * n
        out.append((d, len(w), sum(hit), sorted(items_hit), sum(hit) > 0 and 20 * sum(hit) >= len(w)))
    return out


def key(rows):
    return sorted(rows, key=repr)


def test_op2(spark, sf_dir, documents):
    items = duckdb.sql(f"SELECT item_id, text FROM '{sf_dir}/benchmark.parquet'").fetchall()
    want = [(d, n, h, len(i), sha(",".join(i)), c) for d, n, h, i, c in contamination(documents, items)]
    assert key(map(tuple, queries.op2_decontaminate(spark, sf_dir).collect())) == key(want)
    assert any(r[5] for r in want)


@pytest.mark.parametrize("block", [1 << 20, 3])
def test_op2_odd(odd, odd_rows, empty, bench, block):
    rules = decontaminate.Contamination(block_bytes=block)
    want = contamination([r[:2] for r in odd_rows], [tuple(r) for r in bench.collect()])
    got = decontaminate.decontaminate(odd, bench, rules, row=True)
    assert key((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in got.collect()) == key(want)
    assert key(map(tuple, got.select("row.*").collect())) == key(odd_rows)
    assert decontaminate.decontaminate(empty, bench).count() == 0
    assert decontaminate.decontaminate(odd, bench.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.decontaminate(clashing(odd), clashing(bench), rules, row=True).count() == len(odd_rows)


def test_fm_index_counts_and_locates():
    rng = np.random.default_rng(1)
    sym = rng.integers(0, 4, 3000)
    sym[-1] = 0
    index = FMIndex(sym, 3, sample=5)
    for n in (1, 2, 3, 6):
        pats = rng.integers(1, 4, (40, n))
        for p, lo, hi in zip(pats, *index.search(pats), strict=True):
            want = [i for i in range(len(sym) - n + 1) if (sym[i : i + n] == p).all()]
            assert sorted(index.locate(np.arange(lo, hi)).tolist()) == want


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(queries.tokenizer_path())


def start_key(r):
    return (r[0] is not None, r[0] or 0)


def test_op2_items_without_identifier(spark):
    """Their text is found like any other; only the list of items leaves them out."""
    words = [f"w{i}" for i in range(20)]
    docs = spark.createDataFrame([(1, "x " + " ".join(words) + " y"), (2, "p q r"), (3, "known item")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, " ".join(words)), ("k", "known item"), (None, "known item"), (None, None)], "item_id string, text string")
    for rules in (decontaminate.Contamination(), decontaminate.Contamination(block_bytes=10)):
        got = {r.doc_id: (r.n_hit, r.items, r.contaminated) for r in decontaminate.decontaminate(docs, bench, rules).collect()}
        assert got == {1: (20, [], True), 2: (0, [], False), 3: (2, ["k"], True)}


def test_op3(spark, sf_dir, documents, library):
    at, want = 0, []
    for d, t in sorted(documents):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, queries.op3_token_shards(spark, sf_dir).collect())) == want


def test_op3_odd(spark, odd, odd_rows, empty, library, tmp_path):
    layout = sstable.Layout(least_shard_bytes=3000, block_bytes=600)
    path = f"file://{tmp_path}/shards"
    sstable.write_shards(clashing(odd), path, queries.tokenizer_path(), layout)
    got = sorted(sstable.read_shards(spark, path, with_ids=True).collect(), key=lambda r: r.start)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.ids) for r in got) == sorted((r[0] is not None, r[0] or 0, [*library.encode(r[1] or "", add_special_tokens=False).ids, 2]) for r in odd_rows)
    assert [start_key(r) for r in got] == sorted(start_key(r) for r in got)
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    files = [sstable.Reader(f.read_bytes()) for f in (tmp_path / "shards").glob("part-*") if f.stat().st_size]
    assert len(files) > 1
    by = {r.doc_id: r.ids for r in got if r.doc_id not in (None, 6)}
    for d, ids in by.items():
        assert [x.tolist() for f in files if (x := f.lookup(d)) is not None] == [ids]
    assert all(f.lookup(999_999) is None for f in files)
    assert all(f.block(i)[0] <= f.block(i + 1)[0] for f in files for i in range(f.n_blocks - 1))
    with pytest.raises(ValueError):
        sstable.Reader(b"short")
    assert sstable.token_shards(empty, queries.tokenizer_path()).count() == 0


@pytest.mark.parametrize("least", [4 << 20, 2000])
def test_op3_string_identifiers(spark, library, tmp_path, least):
    rows = [(None if i == 5 else f"k{i * 7919 % 400:03d}", f"text {i} " * (i % 9)) for i in range(300)]
    path, docs = f"file://{tmp_path}/strings", spark.createDataFrame(rows, "doc_id string, text string")
    sstable.write_shards(docs, path, queries.tokenizer_path(), sstable.Layout(least_shard_bytes=least, block_bytes=300))
    got = sorted(sstable.read_shards(spark, path, integer_keys=False, with_ids=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((d for d, _ in rows), key=lambda d: d or "")
    want = {d: [*library.encode(t, add_special_tokens=False).ids, 2] for d, t in rows}
    assert all(r.ids == want[r.doc_id] for r in got)
    files = [sstable.Reader(f.read_bytes()) for f in (tmp_path / "strings").glob("part-*") if f.stat().st_size]
    assert (len(files) > 1) == (least < 4 << 20)
    for d, ids in want.items():
        assert [x.tolist() for f in files if (x := f.lookup(d)) is not None] == [ids]


def near_components(docs, k, percent):
    sets = {}
    for d, t in docs:
        w = SPACED.findall((t or "").translate(AZ))
        sets[d] = frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(d for d in sets if sets[d])
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted((d, len(sets[d]), find(d), find(d) == d) for d in sets)


def test_op4(spark, sf_dir, documents):
    want = near_components(documents, 3, 85)
    assert sorted(map(tuple, queries.op4_near_dedup(spark, sf_dir).collect())) == want
    assert any(not r[3] for r in want)


@pytest.mark.parametrize(("count", "least", "most", "limit"), [(150, 0, 9, {"part": 4}), (60, 4, 9, {"part_bytes": 1500})])
def test_op4_across_parts(spark, count, least, most, limit):
    """Groups of near copies, dense or barely linked, cut into parts of four: links across parts are found, chains included."""
    rng = random.Random(count + least)
    base = [f"w{i}" for i in range(60)]
    docs = []
    for d in range(count):
        w = base.copy()
        for _ in range(rng.randint(least, most)):
            w[rng.randrange(60)] = f"x{rng.randrange(30)}"
        docs.append((d, " ".join(w)))
    want = near_components(docs, 3, 85)
    got = near_dedup.near_dedup(spark.createDataFrame(docs, "doc_id long, text string"), near_dedup.Similar(shingle=3, percent=85, **limit))
    assert sorted(map(tuple, got.collect())) == want


def test_op4_odd(odd, odd_rows, empty):
    got = near_dedup.near_dedup(clashing(odd)).collect()
    assert len(got) == len(odd_rows)
    assert all(r.kept and r.component_id is None for r in got if r.doc_id is None)
    by = {r.doc_id: r for r in got if r.doc_id not in (None, 6)}
    assert by[7].component_id == by[8].component_id == by[9].component_id == 6
    assert by[1].n_shingles == 0 and by[1].kept and by[4].component_id == 4 and by[5].component_id == 4
    assert near_dedup.near_dedup(empty).count() == 0


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(0)
    common, a, b = rng.integers(0, 1 << 62, 800), rng.integers(0, 1 << 62, 100), rng.integers(0, 1 << 62, 100)
    sets = [np.concatenate([common, a]), np.concatenate([common, b]), common[:1]]
    s = near_dedup.sketch(np.concatenate(sets).astype(np.uint64), np.cumsum([0, 900, 900, 1]), 500)
    assert (s != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
    assert (s[0] == s[1]).mean() == pytest.approx(0.8, abs=0.06)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(1, i) for i in range(2, 30)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, **{i: 1 for i in range(1, 30)}}


def test_op5(spark, sf_dir):
    a = {r.doc_id: r for r in queries.op5_factorisation_machine(spark, sf_dir).collect()}
    truth = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{sf_dir}/labels.parquet'").fetchall())
    held = [d for d in truth if a[d].held_out]
    assert all(a[d].held_out == (crc(d) % 4 == 2) and 0 <= a[d].score <= 1 and a[d].predicted == (a[d].score >= 0.7) for d in a)
    assert np.mean([a[d].predicted == truth[d] for d in held]) >= 0.95


def test_op5_never_learns_from_held_out_rows(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    p = factorisation_machine.Params(epochs=2)
    flipped = labels.withColumn("quality", F.when(factorisation_machine.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (factorisation_machine.train(docs, x, p) for x in (labels, flipped))
    assert (one.w == two.w).all() and (one.v == two.v).all()


def test_op5_sum_of_squares_identity():
    m = factorisation_machine.Machine(factorisation_machine.Params(bits=4, factors=3))
    rng = np.random.default_rng(0)
    m.w, m.v = rng.standard_normal(m.w.shape).astype(np.float32), rng.standard_normal(m.v.shape).astype(np.float32)
    stats = rng.standard_normal((1, len(m.mean))).astype(np.float32)
    x = np.concatenate([np.eye(16)[3] * 0.5 + np.eye(16)[7] * 0.25, stats[0]])
    pairs = sum(m.v[i] @ m.v[j] * x[i] * x[j] for i in range(len(x)) for j in range(i))
    got, _ = m.raw(np.array([3, 7]), np.array([0.5, 0.25], np.float32), np.array([0, 2]), stats)
    assert got[0] == pytest.approx(m.w @ x + pairs, rel=1e-4)


def pairwise_score(m, t):
    """A text's score from its features by the definition: all pairs, no identity."""
    from relaycast.llm import _features

    w, v = np.asarray(m.w, float), np.asarray(m.v, float)
    text = X.text_bytes(pa.array([t], pa.string()))
    words = X.find_words(text)
    x = np.zeros(len(w))
    for word in SPACED.findall((t or "").translate(AZ)):
        x[int(X.hash_words(X.find_words(X.text_bytes(pa.array([word]))))[0] >> np.uint64(64 - m.p.bits))] += 1
    x /= max(np.linalg.norm(x), 1e-30)
    x[m.words :] = (_features.structure(text, words, X.hash_words(words))[0] - m.mean) / m.scale
    on = np.flatnonzero(x)
    z = v[on] * x[on, None]
    margin = float(m.w0[0]) + w @ x + sum(float(z[i] @ z[:i].sum(0)) for i in range(1, len(on)))
    return 1 / (1 + math.exp(-margin))


def test_op5_scores_equal_pairwise_sums(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    m = factorisation_machine.train(docs, labels, factorisation_machine.Params(epochs=3))
    got = {r.doc_id: r.score for r in factorisation_machine.classify(docs, m).collect()}
    for r in docs.collect()[:60]:
        assert got[r.doc_id] == pytest.approx(pairwise_score(m, r.text), abs=1e-3)


def test_op5_trains_alike_in_any_layout(spark):
    rows = [(i % 40, f"word{i} {'good' if i % 2 else 'bad'} text {i % 7}") for i in range(120)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    a, b = (factorisation_machine.train(d, labels, factorisation_machine.Params(epochs=2)) for d in (docs.repartition(1), docs.orderBy(F.desc("text")).repartition(9)))
    assert (a.w == b.w).all() and (a.v == b.v).all()
    assert [r.held_out for r in factorisation_machine.classify(spark.createDataFrame([(None, "x")], "doc_id long, text string"), a).collect()] == [False]


def test_op5_odd(odd, odd_rows, empty, labels):
    p = factorisation_machine.Params(epochs=2)
    got = factorisation_machine.quality_classifier(clashing(odd), clashing(labels), p)
    assert got.filter("score between 0 and 1").count() == len(odd_rows)
    assert factorisation_machine.quality_classifier(empty, labels, p).count() == 0
    assert {r.score for r in factorisation_machine.quality_classifier(odd, labels.limit(0), p).collect()} == {0.5}


def without_repeats(docs, k=20):
    seen, out = {}, []
    order = sorted({(d if d is not None else -(1 << 63), t, d is None) for d, t in docs}, key=lambda x: (x[0], x[1] or ""))
    for d, t, null in order:
        w = SPACED.findall(t or "")
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if tuple(w[i : i + k]) in seen:
                gone[i : i + k] = [True] * k
            else:
                seen[tuple(w[i : i + k])] = 1
        out.append(((None if null else d, t), (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return dict(out)


def test_op6(spark, sf_dir, documents):
    want = {d: (n, g, sha(t)) for (d, _), (n, g, t) in without_repeats(documents).items()}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op6_substring_dedup(spark, sf_dir).collect()}
    assert got == want and sum(g for _, g, _ in want.values())


def test_op6_hot_minimisers_and_passes_change_nothing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = sorted(map(tuple, substring_dedup.substring_dedup(docs).collect()))
    for p in (substring_dedup.Params(windows=100), substring_dedup.Params(windows=5000, partitions=2), substring_dedup.Params(windows=3000, sample_docs=20, sample_every=4)):
        assert sorted(map(tuple, substring_dedup.substring_dedup(docs, p).collect())) == want
    assert len(substring_dedup.hot_minimisers(docs, substring_dedup.Params(windows=100)))


def test_op6_odd(odd, odd_rows, empty):
    got = substring_dedup.substring_dedup(clashing(odd)).collect()
    want = without_repeats([r[:2] for r in odd_rows])
    assert len(got) == len(odd_rows)
    assert key((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got if r.doc_id != 6) == key((r[0], *want[r[0], r[1]]) for r in odd_rows if r[0] != 6)
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_op7(spark, sf_dir):
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{sf_dir}/conversations.parquet'").fetchall() + [(-7, 0, "user", queries.FORGED), (-7, 1, "assistant", queries.FORGED)]
    by = defaultdict(list)
    for c, t, r, x in sorted(rows):
        by[c].append((r, x or ""))
    learnt = {c: "".join(x for r, x in v if r == "assistant") for c, v in by.items()}
    want = sorted((c, len(v), sha("".join(f"{r}\n{x}\n" for r, x in v)), len(learnt[c]), sha(learnt[c])) for c, v in by.items())
    assert sorted(tuple(r)[:5] for r in queries.op7_chat_format(spark, sf_dir).collect()) == want


def test_op7_is_reversible(spark):
    rng = random.Random(3)
    bits = ["\\", "#", "<", ":", "h", "l", "c", "\n", " ", "### ", ": ", " </turn>\n", "a", "é", "😀", "\\\\", "<|image:0|>"]
    rows = [(i // 3, i % 3, rng.choice(["user", "assistant", "a:b#<\\", ""]), "".join(rng.choices(bits, k=rng.randint(0, 12)))) for i in range(300)]
    made = chat.format_chats(chat.text_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    for r in chat.read_chats(made).collect():
        own = [(a, x) for c, _, a, x in rows if c == r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == own and r.learnt == "".join(x for a, x in own if a == "assistant")


def test_op7_parts(spark):
    part = dict.fromkeys(("text", "ref", "width", "height", "seconds", "pages"))
    rows = [(1, 0, "user", [part | {"kind": "text", "text": "see <"}, part | {"kind": "image", "ref": "i.png", "width": 33, "height": 16}, part | {"kind": "audio", "ref": "a.wav", "seconds": 2.0}, part | {"kind": "document", "ref": "d", "pages": 2}, None]), (1, 1, "assistant", [part | {"kind": "text", "text": "yes"}]), (1, 2, None, None)]
    r = chat.format_chats(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")).first()
    assert r.formatted == "### user: see \\l<|image:1|><|audio:2|><|document:3|> </turn>\n### assistant: yes </turn>\n### :  </turn>\n"
    assert [(a.part, a.kind, a.ref, a.tokens) for a in r.attachments] == [(1, "image", "i.png", 3), (2, "audio", "a.wav", 50), (3, "document", "d", 512)]
    assert r.attachment_tokens == 565 and [r.formatted[m.start : m.start + m.chars] for m in r.loss] == ["yes"]


def test_op7_very_many_parts(spark):
    """Offsets of 16,000 parts are right, and a message's time doesn't follow the square of its parts."""
    import time

    def message(n):
        parts = [("text", f"a{i}", None, None, None, None, None) if i % 3 else ("image", None, "r", 32, 32, None, None) for i in range(n)]
        return spark.createDataFrame([(1, 0, "assistant", parts)], f"conv_id long, turn int, role string, parts array<{chat.PART}>")

    took = {}
    for n in (1000, 16_000):
        began = time.time()
        (r,) = chat.format_chats(message(n)).collect()
        took[n] = time.time() - began
        assert [r.formatted[m.start : m.start + m.chars] for m in r.loss] == [f"a{i}" for i in range(n) if i % 3]
    assert took[16_000] < 4 + 8 * took[1000]


def test_identifier_types(spark):
    """Integers of any width give the same; others fail with one message."""
    rows = [(i, "same words in every text of these few rows " * 5 + ("x" if i == 2 else ""), "en", "s", 1) for i in range(4)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for run in (near_dedup.near_dedup, substring_dedup.substring_dedup, line_dedup.line_dedup):
        want = sorted(map(tuple, run(docs).collect()))
        for kind in ("int", "smallint"):
            assert sorted(map(tuple, run(docs.withColumn("doc_id", F.col("doc_id").cast(kind))).collect())) == want
        with pytest.raises(TypeError, match="doc_id must be an integer, not string"):
            run(docs.withColumn("doc_id", F.col("doc_id").cast("string")))


def test_op7_odd(spark):
    rows = [(1, None, None, None), (1, 0, "assistant", "same"), (1, 0, "assistant", "same"), (None, 1, "user", "x"), (2, 5, "assistant", "y" * 50_000)]
    df = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in chat.read_chats(chat.format_chats(chat.text_messages(df))).collect()}
    assert [tuple(t) for t in got[1].turns] == [("", ""), ("assistant", "same"), ("assistant", "same")] and got[1].learnt == "samesame"
    assert [tuple(t) for t in got[None].turns] == [("user", "x")] and got[2].learnt == "y" * 50_000
    assert chat.format_chats(chat.text_messages(df.limit(0))).count() == 0


def test_op8(spark, sf_dir):
    got = queries.op8_language_id(spark, sf_dir).collect()
    truth = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{sf_dir}/documents.parquet'").fetchall())
    assert all(r.held_out == (crc(r.doc_id) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in got if r.held_out]) >= 0.97


def test_op8_odd(odd, odd_rows, empty, spark):
    p = language_id.Params(epochs=2, bits=8)
    got = language_id.language_id(clashing(odd), p).collect()
    assert len(got) == len(odd_rows)
    for r in got:
        if r.doc_id in (0, 1, 2, 17):
            assert (r.lang_pred, r.score) == ("und", 0)
    assert language_id.language_id(empty, p).count() == 0
    assert {r.lang_pred for r in language_id.language_id(odd.withColumn("lang", F.lit(None).cast("string")), p).collect()} == {"und"}
    many = spark.createDataFrame([(i, f"{'abcdefghij'[i % 10] * 3} word{i % 10}", f"l{i % 10}", None, None) for i in range(60)], SCHEMA)
    assert language_id.language_id(many, language_id.Params(bits=10)).filter("lang_pred = 'und'").count() == 0


def test_op8_predictions_equal_decoding_by_hand(spark, sf_dir):
    """Margins from n-grams counted one by one, then the loss of every codeword."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(80)
    m = language_id.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), language_id.Params(epochs=3))
    got = {r.doc_id: r for r in language_id.predict(docs, m).collect()}
    for r in docs.collect():
        grams = []
        for word in ALNUM.findall((r.text or "").translate(AZ)):
            raw = b" " + word.encode() + b" "
            grams += [raw[i : i + n] for n in (1, 2, 3) for i in range(len(raw) - n + 1) if raw[i : i + n].strip()]
        value = np.array([int.from_bytes(bytes([len(g)]) + g, "big") for g in grams], np.uint64)
        own = m.weight[(X.mix(value) >> np.uint64(64 - m.p.bits)).astype(np.int64)].astype(float).sum(0) * m.p.scale / max(len(grams), 1) + m.bias
        loss = [sum(math.log1p(math.exp(-x * b)) * t for x, b, t in zip(own, code, m.trust, strict=True)) for code in m.code]
        best = int(np.argmin(loss))
        if any(c.isalpha() for c in r.text or ""):
            assert got[r.doc_id].lang_pred == m.langs[best] or sorted(loss)[1] - sorted(loss)[0] < 1e-4
            assert got[r.doc_id].score == pytest.approx(1 / sum(math.exp(min(loss) - x) for x in loss), abs=1e-3)
        else:
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0)


def test_op8_learns_every_language(spark):
    rows = [(i, f"q{i % 600}q z{i % 600}z k{i % 600}k", f"l{i % 600:03d}", None, None) for i in range(3000)]
    m = language_id.train(spark.createDataFrame(rows, SCHEMA), language_id.Params(epochs=1, bits=8))
    assert m.langs == sorted({r[2] for r in rows if crc(r[0]) % 3 != 1}) and len(m.langs) > 512


def test_op8_learns_from_whole_texts(spark):
    """Texts whose languages differ only after a long opening that they share."""
    opening = "lorem ipsum dolor sit amet " * 200
    word = {"aa": "kaka tata papa", "bb": "zizi vivi nini"}
    rows = [(i, opening + f"{word[lang]} " * 300, lang, None, None) for i in range(60) for lang in ("ab"[i % 2] * 2,)]
    rows += [(100 + i, f"{word[lang]} {i}", None, None, None) for i in range(20) for lang in ("ab"[i % 2] * 2,)]
    got = {r.doc_id: r.lang_pred for r in language_id.language_id(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[100 + i] == "ab"[i % 2] * 2 for i in range(20))


def test_op8_codes_are_apart():
    for k in (2, 4, 6, 9, 40):
        c = language_id.codes(k, 1)
        assert len({tuple(r) for r in c.tolist()}) == k and (np.abs(c.sum(0)) < k).all()


def test_op9(spark, sf_dir, documents, library):
    want = []
    for d, t in documents:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, queries.op9_bpe_encode_decode(spark, sf_dir).collect())) == sorted(want)


def test_op9_odd(odd, odd_rows, empty, library):
    path = queries.tokenizer_path()
    got = bpe.encode_decode(clashing(odd), path).collect()
    assert key((r.doc_id, list(r.ids), r.decoded) for r in got) == key((r[0], library.encode(r[1] or "", add_special_tokens=False).ids, r[1] or "") for r in odd_rows)
    assert bpe.encode_decode(empty, path).count() == 0


def test_op9_matches_the_library_on_random_texts(library):
    rng = random.Random(1)
    al = [*"  \n\t\r\x0b\x1c'''sdmtrevlLl.,!?-09aZé²½ñ", "'s", "'re", " 's", "'ll", "  ", "<|endoftext|>", "…", "—", "\xa0", "中", "😀", "ß", "ж", "٣", "<|"]
    texts = ["".join(rng.choices(al, k=rng.randint(0, 40))) for _ in range(2000)] + ["ab" * 3000, " " * 700, "'" * 90]
    texts += ["".join(chr(c) for c in rng.choices([*range(32, 0xD800), *range(0xE000, 0x20000), 0x20000, 0x30000, 0x10FFFF], k=30)) for _ in range(300)]
    texts += ["a<|endoftext|>b", "<|endoftext|><|endoftext|> c", "<|endof", "text|>", "\u3000 \xa0x", " \u2003"]
    own = bpe.load(queries.tokenizer_path())
    small = pieces.PieceCache(own.encode_pieces, limit=400)  # generations change all the time
    lib = pieces.PieceCache(pieces.library_encoder(library, own.token_bytes), limit=400)
    for cache in (own.cache, small, lib, lib):
        for a in range(0, len(texts), 300):
            part = texts[a : a + 300]
            ids, offs = pieces.encode_chunk(X.text_bytes(pa.array(part)), cache, own.cutter)
            assert [ids[x:y].tolist() for x, y in zip(offs[:-1], offs[1:], strict=True)] == [library.encode(t, add_special_tokens=False).ids for t in part]


def test_piece_cache_verifies_bytes(monkeypatch):
    """Pieces with equal hashes keep their own ids."""
    cache = pieces.PieceCache(lambda data, at, size: (data[at].astype(np.int32), np.ones(len(at), np.int32)))
    monkeypatch.setattr(pieces.X, "hash_words", lambda words: np.zeros(len(words.starts), np.uint64))
    for _ in range(2):
        flat, start, size = cache.ids(np.frombuffer(b"abc", np.uint8), np.arange(3), np.ones(3, np.int64))
        assert flat[start].tolist() == [97, 98, 99] and size.tolist() == [1, 1, 1]


def test_speculation_equals_merging():
    own, rng = bpe.load(queries.tokenizer_path()), random.Random(4)
    strings = [bytes(rng.choices(b"abcdehinorst ", k=rng.randint(1, 30))) for _ in range(3000)]
    at = np.cumsum([0, *map(len, strings)])
    ids, sizes = own.encode_pieces(np.frombuffer(b"".join(strings), np.uint8), at[:-1], np.diff(at))
    ends = np.cumsum(sizes)
    assert [ids[e - n : e].tolist() for e, n in zip(ends, sizes, strict=True)] == [own.id_of[own.merge(x)].tolist() for x in strings]


@pytest.mark.parametrize("alphabet, most", [("abcdefghijklmnopqrstuvwxyz", 3000), ("ACGT", 3000), ("ab", 400), ("a", 900), ("".join(map(chr, range(0x4E00, 0x5200))), 700), ("éàüß漢字aei", 500), ("0123456789abcdef", 2000)])
def test_long_pieces_equal_the_library(library, alphabet, most):
    """Runs of letters without a space: repaired spans give what the library gives."""
    own, rng = bpe.load(queries.tokenizer_path()), random.Random(9)
    texts = ["".join(rng.choices(alphabet, k=rng.randint(most // 2, most))) for _ in range(40)]
    ids, offs = own.encode(X.text_bytes(pa.array(texts)))
    assert [ids[a:b].tolist() for a, b in zip(offs[:-1], offs[1:], strict=True)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def line_runs(docs, alone=20):
    """Lines of each text, the numbers of those with a word, and what goes: pairs of them and long ones that stand earlier."""
    seen, gone, seqs = set(), defaultdict(set), {}
    for d, t in sorted(docs, key=lambda x: x[0]):
        raw = (t or "").split("\n")
        at = [i for i, x in enumerate(raw) if SPACED.search(x)]
        seqs[d] = (raw, at)
        runs = [((raw[i], raw[j]), i, j) for i, j in zip(at, at[1:])] + [((raw[i],), i, i) for i in at if len(SPACED.findall(raw[i])) >= alone]
        for run, i, j in runs:
            if run in seen:
                gone[d] |= set(range(i, j + 1))
            seen.add(run)
    return seqs, gone


def test_op10_exact_case(spark):
    rows = [(1, "a a\nb b\nc c\nd d\ne e"), (2, "x\nb b\nc c\nd d\ne e\ny"), (3, "b b\n\nc c\nd d\ne e"), (4, "q\nc c\nz"), (5, "m\nn\no\np\nm\nn\no\np\n"), (5, None)]
    got = sorted((r.doc_id, r.n_removed, r.kept_text) for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.kept_text is not None)
    assert got == [(1, 0, rows[0][1]), (2, 4, "x\ny"), (3, 5, ""), (4, 0, "q\nc c\nz"), (5, 4, "m\nn\no\np\n")]


def test_op10(spark, sf_dir, documents):
    """All of what stands earlier goes, and no other line."""
    seqs, gone = line_runs(documents)
    got = {r.doc_id: r for r in line_dedup.line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()}
    assert set(got) == set(seqs) and any(gone.values())
    for d, (raw, _) in seqs.items():
        assert (got[d].n_lines, got[d].n_removed) == (len(raw), len(gone[d]))
        assert got[d].kept_text == "\n".join(x for i, x in enumerate(raw) if i not in gone[d])


def test_op10_random_lines(spark):
    """Few different lines, so that windows, ties and overlaps of all kinds occur; blank and long lines between."""
    rng = random.Random(6)
    pool = ["a", "b b", "c", "d d d", "", "  ", "long " * 20 + "x", "long " * 19 + "y", "long " * 25]
    docs = [(d, "\n".join(rng.choices(pool + [f"own {d} {i}" for i in range(6)], k=rng.randint(0, 12)))) for d in range(120)]
    _, gone = line_runs(docs)
    got = {r.doc_id: r.kept_text for r in line_dedup.line_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in docs}


def test_op10_one_line_repeated(spark):
    docs = [(1, "\n".join(["same"] * 100_000)), (2, "\n".join(["x y", "z"] * 40_000))]
    got = {r.doc_id: r.kept_text for r in line_dedup.line_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    _, gone = line_runs(docs)
    assert got == {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in docs}


def test_op10_short_runs(spark):
    """Runs of two and three lines go from anywhere in a text, and where their parts stand first in different texts."""
    first = [f"first line {i}" for i in range(40)]
    rows = [(1, "\n".join(first)), (2, "p\nq\nfirst line 39\nfirst line 0"), (3, "q\nfirst line 39")]
    want = {1: 0, 2: 0, 3: 2}
    for i in range(38):
        rows.append((100 + i, "\n".join([f"a {i}", first[i], "", first[i + 1], f"b {i}"])))
        rows.append((200 + i, "\n".join([f"c {i}", *first[i : i + 3], f"d {i}"])))
        want |= {100 + i: 3, 200 + i: 3}
    rows.append((300, "x\nfirst line 38\nfirst line 39\nfirst line 0\ny"))
    want[300] = 3
    got = {r.doc_id: r.n_removed for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_op10_odd(odd, odd_rows, empty):
    got = line_dedup.line_dedup(clashing(odd), row=True).collect()
    assert len(got) == len(odd_rows) and all((r.kept_text is None) == (r.row.text is None) for r in got)
    by = {r.doc_id: r for r in got if r.doc_id not in (None, 6)}
    assert by[10].n_removed == 0 and by[11].kept_text == "x" and by[12].kept_text == "y"
    assert line_dedup.line_dedup(empty).count() == 0


def test_op10_is_native(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for df in (line_dedup.line_dedup(docs), queries.op7_chat_format(spark, sf_dir)):
        plan = df._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, sf_dir)
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_word_hashes_know_words(documents):
    texts = [t for _, t in documents] + [None, "", "z" * 3_000_000 + " z"]
    words = X.find_words(X.text_bytes(pa.array(texts, pa.string())))
    h = X.hash_words(words)
    all_words = [w for t in texts for w in (t or "").encode().split()]
    assert len(h) == len(all_words) and len(set(h.tolist())) == len(set(all_words))
