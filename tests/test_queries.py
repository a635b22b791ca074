"""Registered queries against their SQL, at the smallest scale."""

import math
import numbers
import os

import duckdb
import pandas as pd
import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def rows(df):
    clean = lambda v: None if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)) else float(v) if isinstance(v, numbers.Number) and not isinstance(v, bool) else str(v)
    return sorted(([clean(v) for v in r] for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


def names():
    from cityweave import registry

    return sorted(registry.queries())


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", names())
def test_query(spark, sql, name):
    from cityweave import registry

    got = registry.queries()[name](spark, SF).toPandas()
    oracle = registry.oracle_sql().get(name)
    if oracle:
        assert rows(got) == rows(sql.execute(oracle).df())
    else:
        CHECKS[name](got, sql)


def named_areas(got, sql):
    """Brute force over all areas and roads: distance of a square to a stretch."""
    lanes = sql.execute("SELECT l_partkey AS road, l_orderkey AS junction, l_suppkey AS aoi FROM lineitem WHERE l_linenumber <= 1").df()
    areas = sql.execute("SELECT s_suppkey AS id, s_nationkey AS n, s_name AS name FROM supplier").df()
    at = {r.id: (float((r.id * r.id * 13 + r.id * 6007 + 13) % 10007), float((r.id * r.id * 7 + r.id * 3001 + r.n * 397 + 29) % 10009), 1200.0 if r.id % 10 == 0 else 350.0, r.name) for r in areas.itertuples()}
    start = {}
    for r in lanes.itertuples():
        p = (r.junction, *at[r.aoi][:2])
        start[r.road] = min(start.get(r.road, p), p)
    names = dict(sql.execute("SELECT p_partkey, p_name FROM part").fetchall())

    def apart(cx, cy, half, x, y):  # along the stretch, finely: its distance to the square
        def far(t):
            dx, dy = abs(x + 120 * t - cx) - half, abs(y + 60 * t - cy) - half
            return math.hypot(max(dx, 0), max(dy, 0))

        lo, hi = 0.0, 1.0  # the distance to a convex shape is convex along a line
        for _ in range(100):
            a, b = lo + (hi - lo) / 3, hi - (hi - lo) / 3
            lo, hi = (lo, b) if far(a) <= far(b) else (a, hi)
        return min(far(0.0), far(1.0), far((lo + hi) / 2))

    for r in got.itertuples():
        cx, cy, half, name = at[r.aoi_id]
        if r.aoi_id % 3:
            assert r.name == name
            continue
        near = sorted((round(apart(cx, cy, half, x, y), 6), names[road]) for road, (_, x, y) in start.items())
        best = [f"{n} nearby" for d, n in near if d <= near[0][0] + 1e-5] if near[0][0] <= max(8 * half, 800) else [""]
        assert r.name in best


def similarities(got, sql):
    """All four measures again, in another way: n-grams as joined strings, the longest common
    subsequence from the full table."""
    said = sql.execute("SELECT conv_id, role, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations").df()
    said = said[(said.role == "user") & said.next.notna() & said.text.notna()]
    assert set(got.conv_id) == set(said.conv_id)

    def grams(x, n):
        return [" ".join(x[i : i + n]) for i in range(len(x) - n + 1)]

    def common(a, b):
        return sum(min(a.count(g), b.count(g)) for g in set(a))

    def measures(pred, ref):
        x, y = pred.split(), ref.split()
        rouge = [2 * common(grams(x, n), grams(y, n)) / (len(grams(x, n)) + len(grams(y, n)) or 1) for n in (1, 2)]
        table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, a in enumerate(x):
            for j, b in enumerate(y):
                table[i + 1][j + 1] = table[i][j] + 1 if a == b else max(table[i][j + 1], table[i + 1][j])
        rougel = 2 * table[-1][-1] / (len(x) + len(y) or 1)
        if not x or not y or not common(x, y):
            return 0.0, *rouge, rougel
        bleu = math.exp(min(0.0, 1 - len(y) / len(x)))
        for n in range(1, 5):
            bleu *= ((common(grams(x, n), grams(y, n)) or 0.1) / max(1, len(grams(x, n)))) ** 0.25
        return bleu, *rouge, rougel

    rows = said.assign(m=[measures(a, b) for a, b in zip(said.text, said.next, strict=True)]).groupby("conv_id").m.agg(list)
    for r in got.itertuples():
        want = [sum(c) / len(c) for c in zip(*rows[r.conv_id], strict=True)]
        assert (r.bleu4, r.rouge1, r.rouge2, r.rougel) == pytest.approx(want, abs=3e-6)


CHECKS = {"j2_name_areas": named_areas, "e4_similarity": similarities}


def test_entry_imports():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
