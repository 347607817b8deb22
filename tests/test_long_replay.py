"""Missions played by chunks against the replay that holds a mission whole."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pytest

from relaycast.operators import long_replay, replay

from .test_replay import CFG, ONLINE, rows, table_of

RUNS = [
    *((m, m, CFG) for m in replay.POLICIES),
    *((f"buffer-{m}", m, replace(CFG, capacity=40)) for m in ("fifo", "score_first", "random")),
    *((f"wide-{m}", m, replace(CFG, downlink_fraction=0.9, compute_fraction=3.0)) for m in ("score_first", "oracle")),
    ("unlimited", "greedy_ratio", replace(CFG, unlimited_compute=True)),
    ("online", "greedy_ratio", ONLINE),
    ("feedback", "score_first", replace(ONLINE, ground_feedback=True)),
    ("free", "fifo", replace(CFG, compress_cycles=0.0)),
]


def same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return bool(np.isclose(a, b, rtol=1e-12, atol=0))
    return a == b


@pytest.mark.parametrize("undated", [False, True])
def test_chunks_change_nothing(spark, monkeypatch, undated):
    monkeypatch.setattr(long_replay, "CHUNK", 100)
    monkeypatch.setattr(long_replay, "KEYS", 0)  # 16 keys of a chunk, so that cuts take several rounds
    found = [r | {"sol": None if undated and r["idx"] % 9 == 0 else r["sol"]} for r in rows(900)]
    frames = table_of(spark, found)
    for log in (True, False):
        whole, parts = ({(r.run, r.window if log else 0): r.asDict() for r in replay.run_all(frames, RUNS, log=log, fit=replay.principal(2), whole=n).collect()} for n in (10**9, 100))
        assert whole.keys() == parts.keys() and {r for r, _ in whole} == {r for r, *_ in RUNS}
        for k, want in whole.items():
            assert want.keys() == parts[k].keys()
            wrong = {c: (x, parts[k][c]) for c, x in want.items() if not same(x, parts[k][c])}
            assert not wrong, (k, wrong)
