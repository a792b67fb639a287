"""The gate's areas, verdicts and overlaps, and window labels, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from verdikt.operators import gate as G
from verdikt.operators import speech as S


def area(pairs):
    right, wrong = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((a > b) + (a == b) / 2 for a in right for b in wrong) / (len(right) * len(wrong)) if right and wrong else None


def test_areas_of_all_conditions(spark):
    rng = random.Random(1)
    rows = [(rng.choice("tu"), rng.choice(["p", "q", None]), rng.choice([round(rng.random(), 1), rng.random(), None, float("nan")]), rng.random() * 3 - 1, rng.random() < 0.4, rng.choice([True, False, None])) for _ in range(600)]
    rows += [("v", "p", 0.5, 0.5, True, True)] * 3
    df = spark.createDataFrame(rows, "task string, cond string, a double, b double, e boolean, c boolean").repartition(4)
    got = {(r["task"], r["detector"], r["whole"], r["condition"], r["label"]): r for r in G.areas(df, ["task"], ["a", "b"], ["e", "c"], "cond").collect()}
    for (task, detector, whole, cond, label), r in got.items():
        own = [x for x in rows if x[0] == task and (whole or x[1] == cond)]
        s = {"a": 2, "b": 3}[detector]
        own = [(x[s], bool(x[{"e": 4, "c": 5}[label]])) for x in own if x[s] is not None and x[s] == x[s]]
        assert r["n"] == len(own) and r["positives"] == sum(y for _, y in own) and r["auroc"] == (None if area(own) is None else pytest.approx(area(own)))
    assert len(got) == 2 * 2 * (2 * 4 + 2) and got["v", "a", True, None, "e"]["auroc"] is None


def test_verdicts(spark):
    def gates(judge, plain, other, large, precision=0.7, noise=0.1):
        found = [("x", d, True, None, k, v) for d, own in (("j", judge), ("p", plain), ("o", other), ("l", large)) for k, v in zip(("E", "C"), own, strict=True)]
        found += [("x", "j", False, "k", "E", 0.1)]
        df = spark.createDataFrame(found, "task string, detector string, whole boolean, condition string, label string, auroc double")
        one = lambda n, v: spark.createDataFrame([("x", v)], f"task string, {n} double")
        return G.verdicts(df, ["task"], "E", "C", "p", "j", "o", "l", one("precision", precision), one("noise", noise)).first().asDict()

    r = gates((0.9, 0.8), (0.8, 0.7), (0.95, 0.85), (0.9, 0.9))
    assert r["first_ok"] and r["second_judged"] and r["second_ok"] and r["plain_ok"] and r["worth_adding"] and r["other_ok"] and not r["hopeless"]
    r = gates((0.69, 0.8), (0.66, 0.7), (0.9, 0.84), (0.6, 0.9), 0.7, 0.3)
    assert not r["first_ok"] and not r["second_judged"] and r["second_ok"] is None and not r["plain_ok"] and not r["worth_adding"] and not r["other_ok"] and r["hopeless"]
    assert not gates((0.9, 0.8), (0.8, 0.7), (0.9, 0.8), (0.9, 0.9), precision=0.59)["first_ok"]
    r = gates((None, 0.8), (0.8, 0.7), (0.9, 0.8), (0.9, 0.9))
    assert not r["first_ok"] and r["gain_first"] is None and not r["hopeless"]


def test_overlaps_equal_all_pairs(spark):
    rng = random.Random(2)

    def windows(n):
        out = []
        for k in range(n):
            t = rng.choice([-7.5, 0.0, 10.0]) + rng.randrange(40) / 2
            out.append((rng.choice("ab"), k, t, t + rng.choice([0.0, 0.5, 2.0, 10.0, 60.0])))
        return out + [("a", n, None, 3.0), ("a", n + 1, 5.0, 4.0)]

    schema = "k string, i int, t0 double, t1 double"
    a, b = windows(60), windows(80)
    want = sorted((x[1], y[1], min(x[3], y[3]) - max(x[2], y[2])) for x in a for y in b if x[0] == y[0] and None not in x + y and x[2] < x[3] and y[2] < y[3] and min(x[3], y[3]) > max(x[2], y[2]))
    for width in (0.7, 4.0, 1000.0):
        got = G.overlaps(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ["k"], "t0", "t1", width)
        assert sorted((r["i"], r["i_r"], r["overlap"]) for r in got.collect()) == want


def test_window_classes_shares_and_confidences(spark):
    df = spark.createDataFrame([(e, c) for e in (True, False) for c in (True, False)], "e boolean, c boolean")
    assert [r[0] for r in df.select(S.window_class(F.struct("e", "c"))).collect()] == ["D", "B", "C", "A"]
    block = "array<struct<op:string,i1:int,i2:int,j1:int,j2:int>>"
    df = spark.createDataFrame([([("replace", 0, 3, 0, 1), ("insert", 4, 4, 2, 4)],), ([],)], f"b {block}")
    assert [r[0] for r in df.select(S.edited_share(F.col("b"), F.lit(10))).collect()] == [0.5, 0.0]
    seg = "array<struct<mean:double,min:double,n:int,n_low:int>>"
    df = spark.createDataFrame([([(-0.1, -0.5, 3, 0), (-0.4, -2.0, 1, 1)],), ([(-0.1, -0.5, 3, 0), None],), ([(-0.2, -0.3, 0, 0)],), ([],)], f"s {seg}")
    got = [r[0] for r in df.select(S.window_confidence(F.col("s"))).collect()]
    assert (got[0]["mean"], got[0]["min"], got[0]["low"]) == (pytest.approx((-0.3 - 0.4) / 4), -2.0, 0.25) and got[1] is None and got[2]["mean"] == 0.0 and got[3] is None
