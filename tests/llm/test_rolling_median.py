"""Rolling medians against windows taken one by one."""

import datetime
import random
import statistics

import numpy as np
import pytest

from chronoweave.llm import rolling_median as rm

SCHEMA = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, n int, block string, unit int, series string"
START = datetime.datetime(2024, 3, 10, 1, 59)
WINDOW = datetime.timedelta(minutes=15)


def brute(rows):
    once = {}
    for r in rows:
        k = (r[1] is None, r[2] or datetime.datetime.min, r[1] or START, r[4] is not None, r[4] or "", r[5] is not None, r[5] or 0.0)
        if r[0] not in once or k < once[r[0]][0]:
            once[r[0]] = (k, r)
    kept = [(i, r[1], r[4], None if r[5] is None or not abs(100 * r[5]) < rm.LARGEST else int(np.floor(100 * r[5] + 0.5))) for i, (_, r) in once.items() if r[1] is not None]
    out = set()
    for i, ts, kind, cents in kept:
        held = [c for _, t, k, c in kept if k == kind and ts - WINDOW < t <= ts and c is not None]
        if not held:
            out.add((i, kind, 0, None, None, None))
            continue
        m2 = int(2 * statistics.median(held))
        mad4 = int(2 * statistics.median([abs(2 * c - m2) for c in held]))
        out.add((i, kind, len(held), m2, mad4, None if cents is None else 2 * abs(2 * cents - m2) > 2 * mad4))
    return out


def clicks(seed, n, seconds, kinds=("a", "b", None, ""), values=300):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        ts = None if rng.random() < 0.02 else START + datetime.timedelta(microseconds=rng.choice([rng.randrange(seconds * 1_000_000), rng.randrange(20) * 450_000_000]))
        value = rng.choice([None, float("nan"), 1e300, rng.randrange(values) / 100, -rng.randrange(values) / 100, rng.randrange(values) / 100 + 0.005, 5.0])
        rows.append((i, ts, START + datetime.timedelta(seconds=rng.randrange(99)), 1, rng.choice(kinds), value, 1, "x", 2, "y"))
    rows += [r[:2] + (START + datetime.timedelta(seconds=200),) + r[3:5] + (9.0,) + r[6:] for r in rows[:20]]  # later rows of the same clicks
    rows += [r[:1] + (None,) + r[2:] for r in rows[20:30]] + [(None, START, None, 1, "a", 3.0, 1, "x", 2, "y")] * 2
    return rows


def found(spark, rows, **kw):
    df = rm.rolling_medians(spark.createDataFrame(rows, SCHEMA), **kw)
    assert df.columns == ["click_id", "kind", "n", "median2", "mad4", "far"]
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("seconds", [3, 2_000, 40_000])
def test_windows(spark, seconds):
    rows = clicks(seconds, 1500, seconds)
    got = found(spark, rows)
    assert len(got) == len(set(got)) and set(got) == brute(rows)


@pytest.mark.parametrize("seconds", [2, 5_000])
def test_dense_blocks_are_dealt_over_tasks(spark, seconds):
    rows = clicks(seconds, 500, seconds, ("a", None))
    got = found(spark, rows, most=60)
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_one_moment_and_no_rows(spark):
    rows = [(i, START, None, 1, "a", float(i % 7), 1, "x", 2, "y") for i in range(400)]
    assert set(found(spark, rows)) == brute(rows) == set(found(spark, rows, most=50))
    assert found(spark, []) == []
    none = [(1, None, None, 1, "a", 1.0, 1, "x", 2, "y"), (2, START, None, 1, "a", None, 1, "x", 2, "y")]
    assert found(spark, none) == [(2, "a", 0, None, None, None)]


def test_the_session_zone_does_not_matter(spark):
    rows = [(i, START + datetime.timedelta(minutes=i), None, 1, "a", float(i), 1, "x", 2, "y") for i in range(120)]  # over a change of clocks
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert set(found(spark, rows)) == brute(rows)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_a_pane_length_is_found_for_bursts():
    rng = np.random.default_rng(1)
    ts = np.concatenate([np.sort(rng.integers(0, 900, 3000)), rng.integers(0, 3_600_000_000, 500)])
    runs = rm.Runs(np.zeros(len(ts), np.int64), ts, rng.integers(0, 10**6, len(ts)), rm.WINDOW_US)
    assert len(runs.below) + len(runs.earlier) < 64 * len(ts) ** 1.5
