import random

import pytest

from verdikt.llm import near_dup
from verdikt.llm.components import connected_components

from .fixtures import frame, prose


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = {d: d for d, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(rows[i][0]), find(rows[j][0])))
                parent[b] = a
    return {d: (len(s), find(d), find(d) == d) for (d, _), s in zip(rows, sets, strict=True)}


def copies(seed, base, n, edits):
    rng, w = random.Random(seed), base.split()
    out = []
    for _ in range(n):
        v = list(w)
        for _ in range(edits):
            v[rng.randrange(len(v))] = "zz%d" % rng.randrange(10**6)
        out.append(" ".join(v))
    return out


def check(spark, rows, **kw):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(frame(spark, rows, **kw)).collect()}
    assert got == brute(rows)


def test_groups_equal_brute_force(spark):
    texts = [prose(i, 60) for i in range(15)]
    for k, edits in enumerate((1, 2, 3, 4)):
        texts += copies(k, prose(100 + k, 80), 6, edits)
    texts += [texts[0].upper(), texts[0].replace(" ", "\n\t"), "a b c", "a b c", "a b", "", "  \n"]
    random.Random(1).shuffle(texts)
    check(spark, list(enumerate(texts)), clash=True)


def test_large_bucket_of_borderline_copies(spark, monkeypatch):
    """Members that link with the base or not: the block stage finds what the first round doesn't."""
    monkeypatch.setattr(near_dup, "SMALL", 3)
    monkeypatch.setattr(near_dup, "BLOCK", 4)
    rows = list(enumerate(copies(7, prose(7, 120), 60, 4)))
    check(spark, rows)


def test_nulls_repeats_and_long_texts(spark):
    long = prose(9, 30_000)
    rows = [(5, None), (4, long), (3, long + " end"), (2, "x"), (2, "x")]
    got = near_dup.near_duplicates(frame(spark, rows)).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in got) == [(2, 2, True), (2, 2, True), (3, 3, True), (4, 3, False), (5, 5, True)]
    none = near_dup.near_duplicates(frame(spark, [(None, "x y"), (None, None)])).collect()
    assert [(r["component_id"], r["kept"]) for r in none] == [(None, False)] * 2


def test_empty_table(spark):
    assert near_dup.near_duplicates(frame(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


def test_recall_of_long_borderline_pairs(spark):
    """Pairs of 2,000 to 20,000 shingles whose similarity lies just at or over the limit, edited at scattered places."""
    rng, rows, want = random.Random(77), [], set()
    for i in range(60):
        n = rng.choice([2000, 5000, 20_000])
        w = prose(9000 + i, n).split()
        v, at = list(w), rng.randrange(n // 2)
        # a changed word takes five shingles with it; a changed stretch of m words m + 4
        lost = int((n - 4) / 7) - rng.randint(0, 40)
        if i % 2:
            v[at : at + lost - 4] = prose(9500 + i, lost - 4).split()
        else:
            for k in rng.sample(range(5, n - 5, 6), lost // 5):
                v[k] = "zz%d" % k
        a, b = shingles(" ".join(w)), shingles(" ".join(v))
        assert 75 * len(a | b) <= 100 * len(a & b) <= 79 * len(a | b)
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
        want.add(2 * i)
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(frame(spark, rows)).collect()}
    assert sum(got[i + 1] == i for i in want) == 60


def test_repeated_rows_of_a_pivot(spark):
    base = prose(1, 80)
    rows = [(1, base)] * 5 + list(enumerate(copies(3, base, 6, 1), 2)) + [(1, base)]
    got = near_dup.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows) and {r["component_id"] for r in got} == {1}
