import numpy as np
import pyarrow as pa
import pytest

from verdikt.llm.embedding_dup import embedding_duplicates, passes_for

SHAPE = "vec_id long, embedding array<float>, label int"


def brute(rows, least=0.93):
    n, links, parent = len(rows), [0] * len(rows), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ok = []
    for _, v, lab in rows:
        x = None if v is None or lab is None or any(c is None for c in v) else np.array(v, np.float32).astype(float)
        ok.append(x if x is not None and len(x) and np.isfinite(x).all() and x.any() else None)
    for i in range(n):
        for j in range(i):
            if ok[i] is not None and ok[j] is not None and rows[i][2] == rows[j][2] and len(ok[i]) == len(ok[j]):
                if ok[i] @ ok[j] / np.linalg.norm(ok[i]) / np.linalg.norm(ok[j]) >= least:
                    links[i] += 1
                    links[j] += 1
                    a, b = sorted((find(i), find(j)), key=lambda k: rows[k][0])
                    parent[b] = a
    return [(rows[i][0], links[i], rows[find(i)][0], rows[find(i)][0] == rows[i][0]) for i in range(n)]


def got(spark, rows, **kw):
    out = embedding_duplicates(spark.createDataFrame(rows, SHAPE), **kw)
    return [tuple(r) for r in out.select("vec_id", "n_links", "component_id", "kept").collect()]


def clusters(seed, n, noise, dim=32):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(n):
        c = rng.normal(size=dim)
        for _ in range(int(rng.integers(1, 9))):
            rows.append((len(rows), [float(x) for x in (c + noise * rng.normal(size=dim)).astype(np.float32)], len(rows) % 2))
    return rows


def test_edges_equal_brute_force(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [1.0, 0.0], 1), (4, None, 0), (5, [0.0, 0.0], 0), (6, [nan, 1.0], 0), (7, [inf, 1.0], 0), (8, [1.0, None], 0), (9, [1.0, 0.0], None), (10, [], 0), (11, [1.0, 0.0, 0.0], 0), (12, [1.0, 0.0], 0), (13, [0.0, 1.0], 0), (14, [-0.0, 1.0], 0)]
    assert sorted(got(spark, rows)) == sorted(brute(rows))
    assert got(spark, []) == []


def test_clashing_names_null_ids_and_doubles(spark):
    from pyspark.sql import functions as F

    from .fixtures import CLASH

    rows = [(None, [1.0, 0.0], 0), (5, [1.0, 0.001], 0), (4, [1.0, 0.0], 0), (None, [0.0, 1.0], 0), (7, [1.0, 1e-9], 1), (8, [1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for c in [*CLASH, "raw", "unit", "size", "pass", "part", "place", "grp", "border", "links"]:
        df = df.withColumn(c, F.lit("x"))
    out = [tuple(r) for r in embedding_duplicates(df).select("vec_id", "n_links", "component_id", "kept").collect()]
    assert sorted(out, key=str) == sorted([(None, 2, 4, False), (5, 2, 4, False), (4, 2, 4, True), (None, 0, None, False), (7, 1, 7, True), (8, 1, 7, False)], key=str)


@pytest.mark.parametrize("parts", [3, 50, 400])
def test_short_and_empty_partitions_and_equal_keys(spark, parts):
    """One pass whose window spans all rows finds every link, however few rows a partition holds."""
    rows = clusters(5, 12, 0.1) + [(500 + i, [1.0] * 31 + [1.0 + i / 1000], 0) for i in range(20)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        have = got(spark, rows, passes=1, window=len(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(have) == sorted(brute(rows))


def test_repeated_ids(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [0.0, 1.0], 0)]
    assert sorted(got(spark, rows)) == [(1, 1, 1, True), (1, 1, 1, True), (2, 0, 2, True)]


@pytest.mark.parametrize("noise", [0.05, 0.15, 0.19])
def test_recall_against_brute_force(spark, noise):
    rows = clusters(3, 120, noise)
    want = {r[0]: r for r in brute(rows)}
    have = {r[0]: r for r in got(spark, rows)}
    links = sum(r[1] for r in want.values())
    assert links > 100
    assert sum(r[1] for r in have.values()) >= 0.98 * links
    assert all(have[i][1] <= want[i][1] for i in want)


def test_recall_in_a_large_label(spark):
    """Lone pairs at the cosine limit in a label of 100,000 vectors: no third vector helps to find them."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(99_000, 64))
    a = x[:1000] / np.linalg.norm(x[:1000], axis=1, keepdims=True)
    b = rng.normal(size=a.shape)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    x = np.vstack([x, 0.9302 * a + np.sqrt(1 - 0.9302**2) * b]).astype(np.float32)
    n = len(x)
    vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, 64 * n + 1, 64, dtype=np.int32)), pa.array(x.ravel()))
    t = pa.table({"vec_id": pa.array(np.arange(n)), "embedding": vectors, "label": pa.array(np.zeros(n, np.int32))})
    found = embedding_duplicates(spark.createDataFrame(t)).where("n_links = 1").count()
    assert 0.995 * 2000 <= found <= 2000
    assert passes_for(10_000_000) > passes_for(1_000_000) > passes_for(100_000) > 12


def test_group_beyond_the_window(spark):
    """A group of copies far larger than the window keeps every link."""
    rng = np.random.default_rng(1)
    c = rng.normal(size=16)
    rows = [(i, [float(x) for x in (c + 0.02 * rng.normal(size=16)).astype(np.float32)], 0) for i in range(150)] + [(1000 + i, [float(x) for x in c.astype(np.float32)], 0) for i in range(40)]
    have = got(spark, rows, window=4, passes=6)
    assert {r[1] for r in have} == {189} and {r[2] for r in have} == {0}
