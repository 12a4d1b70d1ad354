"""Prominences and picks against the rules themselves, over tiles of any size."""

import random

import pytest

from leafmark.operators import series


def plain_prominence(values, k):
    walls = []
    for step in (-1, 1):
        wall, j = values[k], k
        while 0 <= j < len(values) and values[j] >= values[k]:
            wall, j = max(wall, values[j]), j + step
        walls.append(wall)
    return min(walls) - values[k]


@pytest.mark.parametrize("tile", [1, 3, 7, 50, 4096])
def test_prominences_do_not_depend_on_tiles(spark, tile):
    rng = random.Random(tile)
    groups = {g: [float(rng.randint(0, 9)) for _ in range(n)] for g, n in (("a", 120), ("b", 31), ("c", 3), ("up", 0))}
    groups["up"] = [float(k // 2) for k in range(60)]
    groups["down"] = groups["up"][::-1]
    groups["flat"] = [2.0] * 20
    rows = [(g, k, v) for g, vs in groups.items() for k, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "grp string, position long, smooth double")
    asked = df.filter("position % 2 = 0 or smooth < 3")
    got = {(r.grp, r.position): r.prominence for r in series.prominences(asked, df, tile=tile).collect()}
    assert got == {(g, k): plain_prominence(groups[g], k) for g, k, v in rows if k % 2 == 0 or v < 3}


@pytest.mark.parametrize("apart", [0, 1, 2, 5])
def test_picks_equal_the_greedy_rule(spark, apart):
    rng = random.Random(apart)
    rows = [(g, p, float(rng.randint(0, 6))) for g in "abc" for p in sorted(rng.sample(range(-40, 200), 70))]
    df = spark.createDataFrame(rows, "grp string, position long, score double")
    for most in (4, 1000):
        want = []
        for g in "abc":
            picked = []
            for _, p in sorted((-s, p) for h, p, s in rows if h == g):
                if len(picked) < most and all(abs(p - q) >= apart for q in picked):
                    picked.append(p)
            want += [(g, k + 1, p) for k, p in enumerate(picked)]
        got = sorted((r.grp, r["rank"], r.position) for r in series.strongest_apart(df, most, apart).collect())
        assert got == sorted(want)


def test_profiles_spread_no_component_over_its_rows(spark):
    rows = [(1, 5, 3, 10), (1, 6, 2, 7), (1, 12, 1, 4), (1, 5, 3, 1), (2, 0, 2, 3)]
    components = spark.createDataFrame(rows, "line long, y long, h long, w long")
    found = series.profile(components, "line")
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    want = {}
    for line, y, h, w in rows:
        for k in range(y, y + h):
            want[line, k] = want.get((line, k), 0) + w
    want |= {(1, k): 0 for k in range(8, 12)}
    assert {(r.grp, r.position): r.value for r in found.collect()} == want
