"""Every query with an oracle gives what DuckDB gives on the same tables; the others give rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from relaycast import plans


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        c.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(name, spark, sf_dir, duck):
    df = plans.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name not in plans.ORACLE_SQL:
        assert got
        return
    q = duck.sql(plans.ORACLE_SQL[name])
    assert sorted(q.columns) == cols
    names = list(q.columns)
    want = sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in q.fetchall()), key=repr)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or isinstance(x, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=2e-6), (a, b)


def test_windows_of_every_user(spark, sf_dir, duck):
    """Against simple loops over each user's days."""
    want, first = [], {}
    for u, sol in duck.sql("SELECT DISTINCT user_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS sol FROM events ORDER BY ALL").fetchall():
        if u not in first or sol >= first[u][1] + 4:
            first[u] = (first[u][0] + 1 if u in first else 0, sol)
            want.append((u, *first[u]))
    assert [(len(first),)] == duck.sql("SELECT count(DISTINCT user_id) FROM events").fetchall()
    assert sorted(map(tuple, plans.QUERIES["anchored_windows_by_user"](spark, sf_dir).collect())) == want


def test_stream_replay_returns_the_last_window(spark, sf_dir, duck):
    """Against a simple replay of each run, its last window included."""
    want = []
    frames = duck.sql("""SELECT CAST(user_id % 4 AS VARCHAR), date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS sol, event_id, event_type = 'purchase', length(props) * 8.0::DOUBLE, value FROM events ORDER BY 1, 2, 3""").fetchall()
    for run in sorted({f[0] for f in frames}):
        own, held, window = [f for f in frames if f[0] == run], [], 0
        while own:
            first = own[0][1]
            new = [f for f in own if f[1] < first + 4]
            own, last = own[len(new) :], new[-1][1]
            fresh = [f for f in held + new if last - f[1] <= 10]
            expired, used, sent = len(held) + len(new) - len(fresh), 0.0, []
            for f in sorted(fresh, key=lambda f: (-f[5], f[2])):
                if used + f[4] <= 6000.0:
                    used += f[4]
                    sent.append(f)
            held = [f for f in fresh if f not in sent]
            want.append((run, window, first, last, len(new), len(fresh), len(sent), expired, used, sum(f[3] for f in sent), 0))
            window += 1
    got = sorted(map(tuple, plans.QUERIES["stream_replay"](spark, sf_dir).collect()))
    assert got == want and sum(r[4] for r in got) == len(frames)
