"""Pairwise agreement, guardrail and stability against plain Python."""

import math
import random
from itertools import combinations

import pytest

from verdikt.operators import arms as R

ROWS = "arm string, task string, id string, chosen int, correct boolean, conf double"


def made(seed, n=200):
    rng = random.Random(seed)
    out = []
    for t in "xy":
        for i in range(n):
            gold = rng.randrange(3)
            for arm, wrong in (("A", 0.2), ("B", 0.25), ("C", 0.2), ("D", 0.5)):
                if rng.random() < 0.9 and not (t == "y" and arm == "D"):
                    chosen = (gold + (rng.random() < wrong)) % 3 if rng.random() > 0.03 else None
                    out.append((arm, t, f"{t}{i}", chosen, chosen == gold, round(rng.random(), 2)))
    return out


def by_item(rows, t, need):
    found = {}
    for arm, task, i, *x in rows:
        if task == t:
            found.setdefault(i, {})[arm] = x
    return [v for v in found.values() if set(need) <= set(v)]


def test_pairwise_counts(spark):
    rows = made(1)
    got = {(r["task"], r["a"], r["b"]): r for r in R.pairwise(R.item_vectors(spark.createDataFrame(rows, ROWS).repartition(4), ["task"], list("ABCD")), ["task"], list("ABCD")).collect()}
    assert set(got) == {(t, a, b) for t in "xy" for a, b in combinations("ABCD", 2) if (t, b) != ("y", "D")}
    for (t, a, b), r in got.items():
        items = by_item(rows, t, [a, b])
        flips = [v for v in items if v[a][0] != v[b][0]]
        assert (r["n"], r["same"], r["flips"], r["sure_flips"]) == (len(items), len(items) - len(flips), len(flips), sum(v[a][2] > 0.9 for v in flips))
        assert (r["only_a"], r["only_b"]) == (sum(v[a][1] and not v[b][1] for v in items), sum(v[b][1] and not v[a][1] for v in items))
        assert (r["right_a"], r["right_b"]) == (sum(v[a][1] for v in items), sum(v[b][1] for v in items))


def area(pairs):
    right, wrong = [c for ok, c in pairs if ok], [c for ok, c in pairs if not ok]
    return sum((a > b) + (a == b) / 2 for a in right for b in wrong) / (len(right) * len(wrong)) if right and wrong else None


@pytest.mark.parametrize(("base", "new", "others"), [("A", "C", []), ("A", "D", ["B"]), ("A", "B", ["D"])])
def test_guardrail(spark, base, new, others):
    rows = made(2)
    got = {r["task"]: r.asDict() for r in R.guardrail(spark.createDataFrame(rows, ROWS), ["task"], base, new, others).collect()}
    assert set(got) == ({"x"} if new == "D" else {"x", "y"})
    for t, r in got.items():
        need = [base, new, *(o for o in others if any(x[0] == o and x[1] == t for x in rows))]
        items = by_item(rows, t, need)
        mean = lambda a: sum(v[a][1] for v in items) / len(items)  # noqa: B023,E731
        b, c = sum(v[base][1] and not v[new][1] for v in items), sum(v[new][1] and not v[base][1] for v in items)
        p = min(1.0, 2 * sum(math.comb(b + c, k) for k in range(min(b, c) + 1)) / 2 ** (b + c))
        areas = [area([(v[a][1], v[a][2]) for v in items]) for a in (base, new)]
        assert r["n"] == len(items) and r["gap"] == pytest.approx(mean(new) - mean(base)) and r["p_value"] == pytest.approx(p)
        assert [r[f"auroc_{base}"], r[f"auroc_{new}"]] == pytest.approx(areas) and all(r[f"accuracy_{a}"] == pytest.approx(mean(a)) for a in need)
        assert r["ok"] == (abs(mean(new) - mean(base)) <= 0.02 + 1e-12 and p >= 0.05 and areas[1] >= areas[0] - 0.05)


def test_guardrail_of_one_class_passes_without_areas(spark):
    rows = [(a, "x", str(i), 1, True, 0.5) for a in "AB" for i in range(5)]
    r = R.guardrail(spark.createDataFrame(rows, ROWS), ["task"], "A", "B").first()
    assert r["ok"] and r["auroc_A"] is None and r["p_value"] == 1.0
    assert R.guardrail(spark.createDataFrame([], ROWS), ["task"], "A", "B").count() == 0


def test_stability_verdicts(spark):
    rows = []
    for i in range(1000):
        rows += [("A", "x", str(i), 1, True, 0.95), ("B", "x", str(i), 1 + (i == 0), True, 0.5), ("C", "x", str(i), 1 + (i < 6), True, 0.5)]
    rows += [("A", "y", "0", 1, True, 0.3), ("B", "y", "0", 1, True, 0.3), ("C", "y", "0", None, False, 0.3)]
    got = {(r["task"], r["a"], r["b"]): r for r in R.stability(R.item_vectors(spark.createDataFrame(rows, ROWS), ["task"], list("ABC")), "task", list("ABC")).collect()}
    assert not got["x", "A", "B"]["stable"] and got["x", "A", "B"]["sure_flips"] == 1  # one sure flip
    assert got["x", "B", "C"]["stable"] and got["x", "B", "C"]["flips"] == 5  # 99.5 % agree
    assert not got[None, "B", "C"]["stable"] and got[None, "B", "C"]["n"] == 1001
    assert got["y", "A", "B"]["stable"] and not got["y", "A", "C"]["stable"]
