"""Small fixtures worked by hand, one for each trap, and properties that must hold for any rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdikt.functions import expr as E
from verdikt.operators import calibrate as C
from verdikt.operators import metrics as M
from verdikt.operators import paired as P
from verdikt.operators import policy as Y
from verdikt.operators import quality as Q
from verdikt.operators import rank as R
from verdikt.operators import series as S
from verdikt.operators import split, text


def one(df, expr):
    return df.select(expr.alias("x")).first()[0]


def decisions(spark, rows):
    return spark.createDataFrame([("t", float(c), bool(k)) for c, k in rows], "task string, conf double, correct boolean")


def test_risk_cut_keeps_ties_together(spark):
    cal = decisions(spark, [(0.9, 1), (0.8, 0), (0.8, 1), (0.7, 1)])
    assert Y.risk_cut(cal, [0.5], ["task"]).first()["cut"] == 0.7


def test_risk_cut_needs_enough_rows(spark):
    few = decisions(spark, [(0.5 + i / 100, 1) for i in range(18)])
    enough = decisions(spark, [(0.5 + i / 100, 1) for i in range(19)])
    assert Y.risk_cut(few, [0.05], ["task"]).first()["cut"] == math.inf
    assert Y.risk_cut(enough, [0.05], ["task"]).first()["cut"] == 0.5


def test_risk_cut_is_monotone_in_eps(spark):
    rng = random.Random(3)
    cal = decisions(spark, [(round(rng.random(), 2), rng.random() < 0.8) for _ in range(300)])
    cuts = [r["cut"] for r in Y.risk_cut(cal, [0.1, 0.2, 0.3, 0.5], ["task"]).orderBy("eps").collect()]
    assert cuts == sorted(cuts, reverse=True)


def test_first_bin_is_closed(spark):
    df = spark.createDataFrame([(0.0,), (0.1,), (1.0,)], "conf double")
    assert [r[0] for r in df.select(M.bin_index("conf")).collect()] == [0, 0, 9]


def test_mcnemar(spark):
    pairs = spark.createDataFrame(list(zip([1, 1, 0, 0, 1], [1, 0, 1, 0, 0], strict=True)), "a int, b int").select(F.lit(1).alias("t"), F.col("a").cast("boolean").alias("correct_a"), F.col("b").cast("boolean").alias("correct_b"))
    r = P.mcnemar(pairs, ["t"]).first()
    assert (r["only_a"], r["only_b"], r["p_value"]) == (2, 1, pytest.approx(1.0))
    assert one(spark.range(1), P.mcnemar_p(F.lit(0), F.lit(0))) == 1.0
    assert one(spark.range(1), P.mcnemar_p(F.lit(3000), F.lit(2800))) == pytest.approx(0.00897, rel=0.02)
    assert one(spark.range(1), P.mcnemar_p(F.lit(9), F.lit(2))) == one(spark.range(1), P.mcnemar_p(F.lit(2), F.lit(9)))


def test_auroc(spark):
    df = spark.createDataFrame([(0.2, 0), (0.5, 1), (0.5, 0), (0.9, 1)], "s double, y int").withColumn("t", F.lit(1))
    assert M.auroc(df, ["t"], "s", F.col("y") == 1).first()["auroc"] == 0.875
    assert M.auroc(df.where("y = 1"), ["t"], "s", F.col("y") == 1).first()["auroc"] is None


def test_ndcg_and_reciprocal_rank(spark):
    df = spark.createDataFrame([(1, i + 1, r) for i, r in enumerate([0, 2, 1, 0, 0])], "q int, rank int, rel int")
    want = (3 / math.log2(3) + 1 / math.log2(4)) / (3 + 1 / math.log2(3))
    assert R.ndcg(df, ["q"]).first()["ndcg"] == pytest.approx(want)
    assert R.ndcg(df.withColumn("rel", F.lit(0)), ["q"]).first()["ndcg"] == 0
    r = R.reciprocal_rank(df, ["q"], F.col("rel") == 2).first()
    assert (r["rr"], r["recalled"]) == (0.5, True)


def test_confidences_and_levels(spark):
    df = spark.range(1)
    half = F.array(F.lit(0.5), F.lit(0.5))
    assert (one(df, E.argmax(half)), one(df, E.margin(half)), one(df, E.entropy_confidence(half))) == (0, 0.0, pytest.approx(0.0))
    outer, low = F.array(F.lit(0.5), F.lit(0.0), F.lit(0.5)), F.array(F.lit(0.5), F.lit(0.5), F.lit(0.0))
    assert (one(df, E.round_half_down_level(outer)), one(df, E.round_half_down_level(low))) == (1, 0)
    assert (one(df, E.median_level(outer)), one(df, E.median_level(low))) == (0, 0)


def test_missing_letters(spark):
    df = spark.range(1).select(F.create_map(F.lit("A"), F.lit(0.0), F.lit("B"), F.lit(-1.0)).alias("raw"))
    assert one(df, E.logits("raw", ["A", "B", "C"])) == [0.0, -1.0, -30.0]
    present = one(df, E.present_probs("raw"))
    assert set(present) == {"A", "B"} and sum(present.values()) == pytest.approx(1)
    assert one(df, E.option_mass("raw")) == pytest.approx(1 + math.exp(-1))
    assert one(df, E.option_mass(F.create_map().cast("map<string,double>"))) == 0.0


def test_softmax_sums_to_one_and_temperature_keeps_argmax(spark):
    rows = [([random.Random(i).uniform(-40, 40) for _ in range(4)],) for i in range(50)]
    df = spark.createDataFrame(rows, "z array<double>")
    r = df.select(E.total(E.softmax("z")).alias("s"), E.argmax(E.softmax("z")).alias("a"), E.argmax(E.softmax("z", 7.0)).alias("b")).collect()
    assert all(x["s"] == pytest.approx(1) and x["a"] == x["b"] for x in r)


def test_group_key(spark):
    df = spark.createDataFrame([("", "i"), (None, "i"), ("p", "i")], "p string, i string")
    assert [r[0] for r in df.select(E.group_key("p", "i")).collect()] == ["i", "i", "p"]


def test_rotation_and_permutation_round_trip(spark):
    df = spark.range(1).select(F.array(*map(F.lit, [0.1, 0.2, 0.7])).alias("p"))
    pos = F.array(F.lit(0.7), F.lit(0.1), F.lit(0.2))  # option j at position (j + 1) mod 3
    assert one(df, E.rotate(pos, 1)) == [0.1, 0.2, 0.7]
    assert one(df, E.unpermute(F.array(F.lit(0.7), F.lit(0.1), F.lit(0.2)), F.array(F.lit(2), F.lit(0), F.lit(1)))) == [0.1, 0.2, 0.7]


def spc(spark, points, cl=0.0, ucl=3.0, lcl=-3.0):
    df = spark.createDataFrame([(1, i, float(x), cl, ucl, lcl) for i, x in enumerate(points)], "s int, i int, x double, cl double, ucl double, lcl double")
    return S.spc_stats(df, ["s"], ["i"], "x", "cl", "ucl", "lcl").withColumn("d", S.spc_decision(F.lit(False))).first()


def test_spc(spark):
    r = spc(spark, [1] * 7)
    assert (r["side_run"], r["monotone_run"], r["two_of_three"], r["d"]) == (7, 1, 0, "B")
    assert spc(spark, [0, 1, 2, 1, 2, 3])["monotone_run"] == 3
    assert spc(spark, [1, 1, 0, 1, 1])["side_run"] == 2
    assert spc(spark, [4, 4])["d"] == "D" and spc(spark, [4, 0])["d"] == "C"
    assert spc(spark, [2.5, 0, 2.5])["two_of_three"] == 2
    assert spc(spark, [1, 2, 3, 4, 5, 6])["monotone_run"] == 6


def brute_spc(points):
    side = best = 0
    last = 0
    for x in points:
        s = (x > 0) - (x < 0)
        side = 0 if s == 0 else side + 1 if s == last else 1
        last, best = s, max(best, side)
    mono, run, d0 = 1, 1, 0
    for a, b in zip(points, points[1:]):
        d = (b > a) - (b < a)
        run = 1 if d == 0 else run + 1 if d == d0 else 2
        d0, mono = d, max(mono, run)
    return best, mono


def test_spc_against_a_loop(spark):
    for seed in range(5):
        pts = [random.Random(seed * 100 + i).randint(-2, 2) for i in range(30)]
        r = spc(spark, pts)
        assert (r["side_run"], r["monotone_run"]) == brute_spc(pts)


def test_greedy_windows(spark):
    segs = [(1, 0, 0.0, 3.0, 5), (1, 1, 3.0, 7.0, 5), (1, 2, 7.0, 9.0, 5), (1, 3, 9.0, 10.0, 5)]
    df = spark.createDataFrame(segs, "k int, i int, s double, e double, t int")
    rows = S.greedy_windows(df, ["k"], ["i"], "s", "e", "t").orderBy("w").collect()
    assert [(r["t0"], r["t1"], r["n_seg"]) for r in rows] == [(0.0, 9.0, 3), (9.0, 10.0, 1)]


def test_kappa_and_wilson(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 1), (1, 0)], "a int, b int").withColumn("t", F.lit(1))
    assert M.kappa(df, ["t"], "a", "b").first()["kappa"] == pytest.approx((0.75 - 0.5) / 0.5)
    same = spark.createDataFrame([(1, 1)], "a int, b int").withColumn("t", F.lit(1))
    assert M.kappa(same, ["t"], "a", "b").first()["kappa"] == 1.0
    low, high = P.wilson(F.lit(8), F.lit(10))
    assert one(spark.range(1), low) == pytest.approx(0.4902, abs=1e-3) and one(spark.range(1), high) == pytest.approx(0.9433, abs=1e-3)


def test_split_is_half_and_keeps_groups(spark):
    df = spark.createDataFrame([("t", f"g{i % 11}", str(i)) for i in range(60)], "task string, group_id string, id string")
    rows = split.group_split(df).collect()
    by = {}
    for r in rows:
        by.setdefault(r["group_id"], set()).add(r["cal"])
    assert all(len(v) == 1 for v in by.values()) and sum(v == {True} for v in by.values()) == 5


def test_parity_split(spark):
    df = spark.createDataFrame([(g,) for g in "abcdef"], "group_id string")
    got = {r["group_id"]: r["cal"] for r in split.group_split_parity(df, 0).collect()}
    order = list("abcdef")
    random.Random(0).shuffle(order)
    assert {g for g, c in got.items() if c} == set(order[:3])


def test_lock_holds_against_itself(spark, data):
    from verdikt.plans.scoring import split_rows

    x = split_rows(spark, data).drop("p", "conf", "chosen", "correct")
    lock, eps = Y.threshold_run(x, [0.05, 0.1], k=3)
    assert Y.check_lock(x.where("not cal"), lock, eps, k=3).where("not ok").count() == 0


def test_temperature_is_found():
    rng = np.random.default_rng(1)
    z = rng.normal(size=(4000, 3)) * 2
    p = C._softmax(z)
    y = np.array([rng.choice(3, p=q) for q in p])
    q = C.calibrated("temperature", 3 * z, y, np.arange(len(y)), 3 * z)
    assert np.abs(q - p).mean() < 0.02


@pytest.mark.parametrize("method", C.METHODS[1:])
def test_methods_lower_the_loss(method):
    rng = np.random.default_rng(2)
    z = rng.normal(size=(1500, 3)) * 2
    y = np.array([rng.choice(3, p=q) for q in C._softmax(z)])
    g = np.arange(len(y)).astype(str)
    new = C.calibrated(method, 3 * z[:1000], y[:1000], g[:1000], 3 * z[1000:])
    raw = C._softmax(3 * z[1000:])
    loss = lambda p: -np.log(np.maximum(p[np.arange(500), y[1000:]], 1e-12)).mean()
    assert new.sum(1) == pytest.approx(1) and loss(new) < loss(raw)


def test_isotonic_is_monotone():
    x, fit = C.isotonic(np.array([0.1, 0.2, 0.2, 0.3, 0.9]), np.array([0.0, 1.0, 0.0, 0.0, 1.0]))
    assert list(x) == [0.1, 0.2, 0.3, 0.9] and (np.diff(fit) >= 0).all() and fit[1] == fit[2] == pytest.approx(1 / 3)


def test_text_functions(spark):
    df = spark.range(1)
    assert one(df, text.parse_letter(F.lit('{"answer": "B"} A'), ["A", "B"])) == "B"
    assert one(df, text.join_tokens(F.array(*map(F.lit, ["ab", "cd", "好", "e"])))) == "ab cd好e"
    assert one(df, text.contains_run(F.array(*map(F.lit, "abcd")), ["b", "c"])) is True
    assert one(df, text.source_id(F.lit("x-D1-D1-y"), "-D1")) == "x-D1"
    assert one(df, text.plain_number(F.lit(2.50))) == "2.5" and one(df, text.plain_number(F.lit(3.0))) == "3"
    assert one(df, text.render("a{x}b{y}", x=F.lit(1), y=F.lit(None).cast("string"))) == "a1b"
    assert one(df, text.compact_json(F.lit(1).alias("a"), F.lit(None).cast("string").alias("b"))) == '{"a":1,"b":null}'
    ops = one(df, text.opcodes(F.array(*map(F.lit, "abxd")), F.array(*map(F.lit, "abcd"))))
    assert [o["op"] for o in ops] == ["equal", "replace", "equal"]


def test_quality_rules(spark):
    rows = [("1", "t", "A", "p"), ("1", "t", "A", "p"), ("2", "t", "Z", None), ("3", "t", None, "q")]
    df = spark.createDataFrame(rows, "id string, task string, gold string, pair_id string")
    got = {(r["rule"], r["id"]) for r in Q.validate_rows(df, ["A", "B"], ["gold"]).collect()}
    assert got == {("id_repeats", "1"), ("gold_not_an_option", "2"), ("gold_not_an_option", "3"), ("missing_gold", "3"), ("pair_same_gold", "p"), ("pair_size", "q")}
    assert one(spark.range(1), Q.first_difference(F.array(F.lit(1), F.lit(2)), F.array(F.lit(1)))) == 1
    assert one(spark.range(1), Q.first_difference(F.array(F.lit(1)), F.array(F.lit(1)))) is None
