"""Fits over partitions against the same fits on one array."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdikt.operators import calibrate as C
from verdikt.operators import fit

ROWS = "task string, id string, group_id string, gold int, logits array<double>, fold int"


def made(seed, n=400, task="a", k=3, classes=None):
    rng = np.random.default_rng(seed)
    true = rng.normal(0, 1.5, (n, k)) + np.linspace(0, 0.5, k)
    p = np.exp(true) / np.exp(true).sum(1, keepdims=True)
    gold = [int(rng.choice(k, p=x)) for x in p]
    if classes:
        gold = [g if g in classes else classes[0] for g in gold]
    z = np.round(true * 2 + rng.normal(0, 0.3, (n, k)), 2)
    return [(task, f"{task}{i}", f"g{i // 2}", gold[i], z[i].tolist(), i // 2 % 3) for i in range(n)]


def arrays(rows, task, fold):
    own = [r for r in rows if r[0] == task and r[5] != fold]
    return np.array([r[4] for r in own]), np.array([r[3] for r in own]), np.array([r[2] for r in own])


def loss(p, y):
    return -np.log(np.maximum(p[np.arange(len(y)), y], 1e-12)).mean()


@pytest.fixture(scope="module")
def fitted(spark):
    rows = made(1) + made(2, 300, "b", 4) + made(3, 120, "c", 3, [0, 2]) + made(4, 60, "d", 3, [1])
    return rows, C.fit_folds(spark.createDataFrame(rows, ROWS).repartition(5))


def test_every_method_equals_the_fit_on_one_array(fitted):
    rows, models = fitted
    for task in "abcd":
        for fold in range(3):
            z, y, groups = arrays(rows, task, fold)
            inner = np.array([zlib.crc32(g.encode()) % 3 for g in groups])
            for method in C.METHODS:
                want, got = C.fit_method(method, z, y, groups, inner), models[task, method, fold]
                assert set(want) - {"classes"} == set(got) - {"classes"}, (task, method)
                if "t" in want:
                    assert got["t"] == want["t"]
                if "w" in want:
                    # the fit on one array ends when its loss hardly falls any more, so it lies near the minimum
                    a, b = C.apply_method(got, z), C.apply_method(want, z)
                    assert np.abs(a - b).max() < 2e-3 and loss(a, y) <= loss(b, y) + 5e-5, (task, method, fold)
                if "knots" in want:
                    at = np.linspace(0, 1, 2001)
                    assert np.allclose(np.interp(at, got["knots"], got["values"]), np.interp(at, want["knots"], want["values"]), atol=1e-9)


def test_solutions_are_minima_to_six_digits(fitted):
    """The gradient at the solution vanishes, so parameters are those of the minimum to 1e-6."""
    rows, models = fitted
    for task in "ab":
        z, y, groups = arrays(rows, task, 1)
        k = z.shape[1]
        x, hot = C.log_probs(z), np.eye(k)[y]
        inner = np.array([zlib.crc32(g.encode()) % 3 for g in groups])
        for method in ("vector", "dirichlet"):
            w, b = np.array(models[task, method, 1]["w"]), np.array(models[task, method, 1]["b"])
            off = C._softmax(x @ w.T + b) - hot
            gw, gb = off.T @ x / len(x), off.mean(0)
            if method == "vector":
                assert np.abs(np.diag(gw) + 2e-4 * (np.diag(w) - 1)).max() < 1e-7 and np.abs(gb).max() < 1e-7
                assert (w == np.diag(np.diag(w))).all()
            else:
                s = C.best_strength(x, y, groups, inner)
                assert np.abs(gw + 2 * s * w * (1 - np.eye(k)) / (k * (k - 1))).max() < 1e-7 and np.abs(gb + 2 * s * b / k).max() < 1e-7


def test_cross_validation_predicts_every_row_and_survives_odd_tasks(spark):
    rows = made(5, 90) + [("one", "o1", "g", 0, [1.0, 0.0], 0)] + [("two", f"t{i}", f"g{i}", 1, [0.0, 5.0], i % 3) for i in range(6)]
    got = C.cross_validated(spark.createDataFrame(rows, ROWS)).collect()
    assert len(got) == len(rows) * len(C.METHODS)
    assert all(abs(sum(r["p"]) - 1) < 1e-9 for r in got)
    assert C.cross_validated(spark.createDataFrame([], ROWS)).count() == 0


def isotonic_by_array(x, y):
    return C.isotonic(np.array(x), np.array(y, float))


@pytest.mark.parametrize(("n", "values"), [(1, 1), (500, 500), (2000, 12), (3000, 3000)])
def test_isotonic_blocks_equal_the_fit_on_one_array(spark, n, values):
    rng = np.random.default_rng(n)
    rows = []
    for c in ("p", "q"):
        x = np.round(rng.random(n) * values) / values
        rows += [(c, float(v), float(rng.random() < 0.3 + 0.5 * v)) for v in x]
    rows += [("p", None, 1.0), (None, 0.5, 1.0), ("r", 0.9, 1.0), ("r", 0.1, 0.0)]
    got = {}
    for r in fit.isotonic_curves(spark.createDataFrame(rows, "c string, x double, y double").repartition(6), "c", "x", "y").collect():
        got.setdefault(r["curve"], []).append((r["lo"], r["hi"], r["weight"], r["total"]))
    assert set(got) == {"p", "q", "r"} and fit.knots(got["r"]) == ([0.1, 0.9], [0.0, 1.0])
    at = np.linspace(-0.1, 1.1, 4001)
    for c in ("p", "q"):
        own = [(v, y) for k, v, y in rows if k == c and v is not None]
        want = isotonic_by_array(*zip(*own, strict=True))
        assert np.allclose(np.interp(at, *fit.knots(got[c])), np.interp(at, *want), atol=1e-12)
        assert sum(b[2] for b in got[c]) == len(own)


def test_one_value_for_most_rows(spark):
    df = spark.range(5000).select(F.lit("c").alias("c"), F.when(F.col("id") % 10 > 0, 0.99).otherwise(F.col("id") / 5000).alias("x"), (F.col("id") % 3 > 0).cast("double").alias("y"))
    own = [tuple(r) for r in df.select("x", "y").collect()]
    blocks = [(r["lo"], r["hi"], r["weight"], r["total"]) for r in fit.isotonic_curves(df, "c", "x", "y").collect()]
    want = isotonic_by_array(*zip(*own, strict=True))
    at = np.linspace(0, 1, 999)
    assert np.allclose(np.interp(at, *fit.knots(blocks)), np.interp(at, *want))


def test_top_confidence_leaves_the_others_proportions():
    p = np.array([[0.5, 0.3, 0.2], [1.0, 0.0, 0.0], [0.4, 0.4, 0.2]])
    got = C.with_top(p, np.array([0.8, 0.7, 0.1]))
    assert np.allclose(got, [[0.8, 0.12, 0.08], [0.7, 0, 0], [0.1, 0.6, 0.3]])


def test_too_many_parameters_are_refused(spark):
    wide = fit.Problem("a", (), 20, 400, np.ones(8020, bool), np.zeros(8020), np.zeros(8020), lambda n: np.zeros(8020))
    with pytest.raises(ValueError, match="parameters"):
        fit.fit_linear(spark.createDataFrame([], "task string, gold int, x array<double>"), [wide])


def test_left_out_fusion_equals_standardised_regressions(spark):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(400):
        y = int(rng.random() < 0.4)
        rows.append((i, "abc"[i % 3], float(rng.normal(y, 1)), float(rng.normal(3 - 20 * y, 30)), y))
    rows += [(900, "d", 1.0, 2.0, 1), (901, "a", None, 1.0, 1)]
    df = spark.createDataFrame(rows, "id long, flag string, a double, b double, y int")
    got = {r["id"]: r["fused"] for r in C.left_out_fusion(df, "flag", ["a", "b"], "y").collect()}
    assert len(got) == len(rows) and got[901] is None
    for held in "abcd":
        on = [r for r in rows if r[1] != held and r[2] is not None]
        f, y = np.array([r[2:4] for r in on]), np.array([r[4] for r in on])
        _, w, b = C.logistic((f - f.mean(0)) / f.std(0), y)
        for r in rows:
            if r[1] == held and r[2] is not None:
                v = (np.array(r[2:4]) - f.mean(0)) / f.std(0) @ (w[-1] - w[0]) + b[-1] - b[0]
                assert got[r[0]] == pytest.approx(1 / (1 + np.exp(-v)), abs=2e-3)
    one = spark.createDataFrame([(1, "a", 1.0, 1.0, 1), (2, "b", 1.0, 2.0, 0)], df.schema)
    assert {r["fused"] for r in C.left_out_fusion(one, "flag", ["a", "b"], "y").collect()} == {None}


def test_learning_curve_and_crossover_equal_plain_fits(spark):
    import hashlib

    rows = made(11, 160) + made(12, 120, "b")
    curve = C.learning_curve(spark.createDataFrame(rows, ROWS), [10, 40], 2, hold=12, methods=("temperature", "affine"))
    got = {(r["task"], r["method"], r["size"], r["rep"]): r for r in curve.collect()}
    assert len(got) == 2 * 2 * 2 * 2
    mean: dict = {}
    for task in "ab":
        own = sorted((r for r in rows if r[0] == task), key=lambda r: r[1])
        for rep in range(2):
            order = sorted({r[2] for r in own}, key=lambda g: (hashlib.md5(f"{g}:{rep}".encode()).hexdigest(), g))  # noqa: B023
            test, rest = set(order[:12]), order[12:]
            for size in (10, 40):
                taken: list = []
                for g in rest:
                    if sum(r[2] in taken for r in own) >= size:
                        break
                    taken.append(g)
                part = lambda groups: [np.array(v) for v in zip(*((r[4], r[3]) for r in own if r[2] in groups), strict=True)]  # noqa: B023,E731
                (z, y), (new, gold) = part(taken), part(test)
                for m in ("temperature", "affine"):
                    p = C.calibrated(m, z, y, np.arange(len(y)), new)
                    r = got[task, m, size, rep]
                    bins = [[i for i, c in enumerate(p.max(1)) if (c > b / 10 or b == 0) and c <= (b + 1) / 10] for b in range(10)]
                    ece = sum(abs(p.max(1)[b].mean() - (p.argmax(1) == gold)[b].mean()) * len(b) for b in bins if b) / len(gold)
                    assert r["accuracy"] == pytest.approx((p.argmax(1) == gold).mean(), abs=1e-9) and r["loss"] == pytest.approx(loss(p, gold), abs=1e-3) and r["ece"] == pytest.approx(ece, abs=1e-3)
                    mean.setdefault((m, size), {}).setdefault(task, []).append(r["ece"])
    level = {k: np.mean([np.mean(v) for v in by.values()]) for k, by in mean.items()}
    want = min((s for s in (10, 40) if level["affine", s] < level["temperature", s]), default=None)
    assert [tuple(r) for r in C.crossover(curve).collect()] == [("affine", want)]


def test_fixed_split_fits_on_the_calibration_rows(spark):
    rows = made(13, 200)
    df = spark.createDataFrame(rows, ROWS).withColumn("cal", F.col("fold") < 1).drop("fold")
    got = {(r["method"], r["id"]): r for r in C.fixed_split(df).collect()}
    assert len(got) == 200 * len(C.METHODS) and all(r["cal"] == (rows[int(i[1:])][5] < 1) for (_, i), r in got.items())
    cal = [r for r in rows if r[5] < 1]
    z, y, g = np.array([r[4] for r in cal]), np.array([r[3] for r in cal]), np.array([r[2] for r in cal])
    inner = np.array([zlib.crc32(v.encode()) % 3 for v in g])
    for m in C.METHODS:
        p = C.apply_method(C.fit_method(m, z, y, g, inner), np.array([r[4] for r in rows]))
        assert np.abs(np.array([got[m, r[1]]["p"] for r in rows]) - p).max() < 3e-3
