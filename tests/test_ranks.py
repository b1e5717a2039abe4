"""Rank statistics against brute force, with groups that fit no single task."""

import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from levelwise.functions.ranks import MEAN, MEDIAN, ROWS, Stat, describe
from levelwise.plans import bounds

STATS = [
    MEAN,
    MEDIAN,
    ROWS,
    Stat("valid", "valid"),
    Stat("median", "mid"),
    Stat("trimmed", "t20", 0.2),
    Stat("trimmed", "t05", 0.05),
    Stat("quantile", "q05", 0.05),
    Stat("quantile", "q25", 0.25),
    Stat("quantile", "q95", 0.95),
]


PLANS = ["direct", "sorted", "ranked", "split"]


def brute(values):
    known = sorted(v for v in values if v is not None)
    n, out = len(known), {"n": len(values), "valid": len(known)}
    if not known:
        return {**out, **{s.name: None for s in STATS if s.name not in out}}
    out["mean"] = math.fsum(known) / n
    out["mid"] = (known[(n - 1) // 2] + known[n // 2]) / 2
    out["median"] = out["mid"] if n == len(values) else None
    for name, p in (("t20", 0.2), ("t05", 0.05)):
        k = math.floor(n * p)
        out[name] = math.fsum(known[k : n - k]) / (n - 2 * k)
    for name, p in (("q05", 0.05), ("q25", 0.25), ("q95", 0.95)):
        out[name] = float(np.quantile(np.array(known), p))
    return out


def check(spark, groups, plan):
    rows = [(k, v) for k, values in groups.items() for v in values]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, x double").repartition(3)
    found = {r["k"]: r.asDict() for r in describe(df, ["k"], "x", STATS, plan=plan).collect()}
    assert set(found) == set(groups)
    for k, values in groups.items():
        for name, want in brute(values).items():
            got = found[k][name]
            if want is None:
                assert got is None, (k, name)
            else:
                assert got == pytest.approx(want, rel=1e-9, abs=1e-12), (k, name)


def shapes_of_data():
    r = random.Random(7)
    return {
        "unique": [r.gauss(100, 15) for _ in range(900)],
        "ties": [float(r.randrange(5)) for _ in range(700)],
        "heavy tail": [math.exp(r.gauss(0, 12)) for _ in range(600)],
        "both signs": [r.choice([-1, 1]) * math.exp(r.gauss(0, 3)) for _ in range(500)],
        "one hot value": [5.0] * 800 + [r.random() * 10 for _ in range(100)],
        "narrow": [1e6 + i * 1e-9 for i in range(400)],
        # One-sided: opposite outliers would cancel in any floating-point mean.
        "high outlier": [r.random() for _ in range(300)] + [1e300],
        "low outlier": [r.random() for _ in range(300)] + [-1e300],
        "gaps": [None] * 40 + [r.random() for _ in range(60)],
        "all missing": [None] * 5,
        "constant": [3.0] * 50,
        "single": [42.0],
        None: [r.random() * 1000 for _ in range(333)],
    }


@pytest.mark.parametrize("limit", [1_000_000, 40, 3])
def test_ranked_plan_equals_brute_force(spark, monkeypatch, limit):
    """Small limits force several cuts, down to intervals of a few rows."""
    monkeypatch.setattr(bounds, "ONE_TASK_ROWS", limit)
    check(spark, shapes_of_data(), plan="ranked")


@pytest.mark.parametrize("plan", ["direct", "sorted"])
def test_one_shuffle_plans_equal_brute_force(spark, plan):
    check(spark, shapes_of_data(), plan=plan)


@pytest.mark.parametrize("heavy, broadcast_rows", [(100_000, 100_000), (450, 100_000), (450, 0), (1, 100_000)])
def test_split_plan_equals_brute_force(spark, monkeypatch, heavy, broadcast_rows):
    """No group heavy, some, some without a broadcast, and all of several rows."""
    monkeypatch.setattr(bounds, "HEAVY_ROWS", heavy)
    monkeypatch.setattr(bounds, "BROADCAST_ROWS", broadcast_rows)
    monkeypatch.setattr(bounds, "ONE_TASK_ROWS", 20)
    check(spark, shapes_of_data(), plan="split")


@pytest.mark.parametrize("broadcast_rows", [0, 100_000])
def test_ranked_plan_without_broadcast(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr(bounds, "BROADCAST_ROWS", broadcast_rows)
    monkeypatch.setattr(bounds, "ONE_TASK_ROWS", 20)
    check(spark, shapes_of_data(), plan="ranked")


def test_spread_is_the_same_in_all_plans(spark, monkeypatch):
    monkeypatch.setattr(bounds, "ONE_TASK_ROWS", 20)
    monkeypatch.setattr(bounds, "HEAVY_ROWS", 450)
    groups = {k: v for k, v in shapes_of_data().items() if k is None or "outlier" not in k}
    rows = [(k, v) for k, values in groups.items() for v in values]
    df = spark.createDataFrame(rows, "k string, x double").repartition(3)
    for plan in PLANS:
        got = describe(df, ["k"], "x", [Stat("median", "m"), ROWS], plan=plan, spread=True)
        found = {r["k"]: r for r in got.collect()}
        assert set(found) == set(groups)
        for k, values in groups.items():
            known = np.array([v for v in values if v is not None])
            if not len(known):
                assert (found[k].sd, found[k].lo, found[k].hi) == (None, None, None)
                continue
            assert (found[k].lo, found[k].hi) == (known.min(), known.max())
            if len(known) == 1:
                assert found[k].sd is None
            else:
                want = np.std(known - known.mean(), ddof=1)
                # A mean is known no better than the rounding of the values.
                ulps = 4 * np.spacing(np.abs(known).max())
                assert found[k].sd == pytest.approx(want, rel=1e-9, abs=ulps), k


def test_infinite_and_not_a_number(spark):
    inf = float("inf")
    rows = [("k", v) for v in (inf, -inf, 1.0, 2.0, 3.0, float("nan"))]
    df = spark.createDataFrame(rows, "k string, x double")
    for plan in PLANS:
        got = describe(df, ["k"], "x", [Stat("median", "m"), ROWS], plan=plan).first()
        assert (got.m, got.n) == (2.0, 6)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.dictionaries(
        st.sampled_from(["a", "b", None]),
        st.lists(
            st.one_of(st.none(), st.floats(-1e12, 1e12), st.integers(-3, 3).map(float)),
            min_size=1,
            max_size=60,
        ),
        min_size=1,
    )
)
def test_plans_agree_on_any_values(spark, groups):
    rows = [(k, v) for k, values in groups.items() for v in values]
    df = spark.createDataFrame(rows, "k string, x double")
    stats = [Stat("median", "m"), Stat("quantile", "q", 0.3), Stat("strict_median", "s"), ROWS]

    def found(plan):
        return {r["k"]: tuple(r) for r in describe(df, ["k"], "x", stats, plan=plan).collect()}

    before = bounds.ONE_TASK_ROWS, bounds.HEAVY_ROWS
    bounds.ONE_TASK_ROWS = bounds.HEAVY_ROWS = 2
    try:
        assert found("direct") == found("sorted") == found("ranked") == found("split")
    finally:
        bounds.ONE_TASK_ROWS, bounds.HEAVY_ROWS = before
