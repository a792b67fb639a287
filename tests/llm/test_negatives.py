"""Hard negatives against a plain-Python version with exact integers."""

import math
import random

import pytest

from verdikt.llm import negatives

from .fixtures import CLASH

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, every=100, positives=5, k=10, low=30, high=90):
    """The result's rows of ``rows`` in the order of the table."""
    used = []
    for at, (i, v, label) in enumerate(rows):
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            used.append((i, at, label, [math.floor(256 * x) for x in v]))
    out = []
    for i, at, label, a in used:
        if i % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), j, pos, other) for j, pos, other, b in used if pos != at and len(b) == len(a))
        for p, j, _, _ in [s for s in scored if s[3] == label][:positives]:
            p = -p
            inside = [(-s, n) for s, n, _, other in scored if other != label and low * p <= -100 * s <= high * p][:k]
            out += [(i, j, r, n, p, s) for r, (s, n) in enumerate(inside, 1)]
    return sorted(out)


def mined(spark, rows, df=None, **more):
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1) if df is None else df
    out = negatives.hard_negatives(df, **more)
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in out.collect())


def made(n, seed, dims=6, labels=4):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0.2, 0.4) for _ in range(dims)], rng.randrange(labels)) for i in range(n)]


def test_equals_brute_force_over_many_blocks(spark, monkeypatch):
    rows = made(700, 1)
    monkeypatch.setattr(negatives, "LEAST_ROWS", 40)
    got = mined(spark, rows, every=20)
    assert len(got) > 500 and got == brute(rows, 20)


def test_ties_repeats_nulls_and_lengths(spark, monkeypatch):
    monkeypatch.setattr(negatives, "LEAST_ROWS", 8)
    rng = random.Random(2)
    rows = [(i % 60, [rng.choice([0.0, 0.25, 0.5, 1.0]) for _ in range(3)], rng.randrange(3)) for i in range(240)]  # few scores, ids four times
    rows += [(None, [1.0, 1.0, 1.0], 1), (100, None, 1), (200, [1.0, None, 0.0], 1), (300, [1.0, math.nan, 0.0], 1), (400, [1.0, math.inf, 0.0], 1), (500, [1.0, 0.0, 0.0], None)]
    rows += [(0, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (2, [0.5, 0.5], 2), (0, [], 1), (1, [], 1), (2, [], 0), (100, [-1.0, -1.0, -1.0], 9), (101, [1.0, 1.0, 1.0], 9)]
    assert mined(spark, rows, every=20) == brute(rows, 20)


def test_large_numbers_are_exact(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([-1, 1]) * rng.random() * 1e6 for _ in range(4)], i % 2) for i in range(60)]
    assert mined(spark, rows, every=10) == brute(rows, 10)
    wide = [(i, [rng.random() * 2e7, 3e6 * rng.random() + 1 / 256], i % 2) for i in range(30)]  # sums beyond 2^53
    assert mined(spark, wide, every=10) == brute(wide, 10)


def test_scores_beyond_long_raise(spark):
    with pytest.raises(Exception, match="outside the range"):
        mined(spark, [(0, [1e9], 1), (1, [1e9], 1), (2, [1e9], 2)])


def test_empty_hot_label_and_clashing_names(spark):
    assert mined(spark, []) == [] == mined(spark, [(0, None, 1)]) == mined(spark, [(0, [1.0], 1), (1, [1.0], 2)])
    rows = [(i, [1.0, i / 300], 1 if i % 10 else 2) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in [*CLASH, "row", "n", "grid", "block", "anchors", "positives", "place"]:
        if c not in df.columns:
            df = df.withColumn(c, df["label"])
    assert mined(spark, rows, df) == brute(rows)


def test_query_moves_labels(spark):
    df = spark.createDataFrame([(0, [1.0], 9), (7, [1.0], 4), (8, [1.0], 9), (None, [1.0], 9), (14, [1.0], None)], SCHEMA)
    assert [r["label"] for r in negatives.relabelled(df).collect()] == [0, 5, 9, 9, None]
