"""The corpus pipeline: each stage's decisions on its own input, against brute force."""

from __future__ import annotations

import pytest

import corpus_pipeline
from relaycast.llm import factorisation_machine
from relaycast.llm.queries import tokenizer_path

from .test_llm import SPACED, contamination, line_runs, near_components, pairwise_score

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    from relaycast.llm._store import stored
    from relaycast.session import table

    out = [table(spark, sf_dir, "documents")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], sf_dir), name))
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "minhash_near_dedup", "benchmark_decontamination", "bpe_encode_decode"]
    assert all(s.columns == COLUMNS for s in steps[:-1])


def test_quality(spark, sf_dir, steps):
    """What stays is what all pairs of features score at 0.7 or more; scores at the limit itself may round either way."""
    machine = factorisation_machine.train(steps[0], spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scores = {d: pairwise_score(machine, r.text) for d, r in rows(steps[0]).items()}
    clear = {d for d, s in scores.items() if abs(s - 0.7) > 2e-3}
    kept = set(rows(steps[1]))
    assert len(clear) > 0.95 * len(scores) and 0 < len(kept) < len(scores)
    assert {d for d in kept if d in clear} == {d for d in clear if scores[d] >= 0.7}


def test_lines(steps):
    before, after = rows(steps[1]), rows(steps[2])
    seqs, gone = line_runs([(d, r.text) for d, r in before.items()])
    for d, r in before.items():
        if d not in after:
            assert gone[d] >= set(seqs[d][1])
        elif not gone[d]:
            assert after[d] == r
        else:
            assert after[d].text == "\n".join(x for i, x in enumerate(seqs[d][0]) if i not in gone[d])
            assert SPACED.search(after[d].text) and after[d].n_chars == len(after[d].text)


def test_near(steps):
    before = [(d, r.text) for d, r in rows(steps[2]).items()]
    assert set(rows(steps[3])) == {d for d, _, _, kept in near_components(before, 5, 80) if kept}


def test_contamination(spark, sf_dir, steps):
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    before = [(d, r.text) for d, r in rows(steps[3]).items()]
    assert set(rows(steps[4])) == {d for d, *_, bad in contamination(before, items) if not bad}


def test_encoding(steps):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    texts = rows(steps[4])
    assert {d: (list(r.ids), r.decoded) for d, r in rows(steps[5]).items()} == {d: (t.encode(r.text or "", add_special_tokens=False).ids, r.text or "") for d, r in texts.items()}
