import numpy as np
import pytest

from verdikt.llm import quality as Q
from verdikt.llm.common import crc_mod

from .fixtures import frame, prose


def test_held_out_auc(spark, data):
    data = data.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    x = Q.describe(docs)
    out = Q.score(x, Q.fit(x, labels.where(crc_mod("doc_id", 5) != 0))).join(labels.where(crc_mod("doc_id", 5) == 0), "doc_id").toPandas()
    good, bad = out.score[out.quality == 1].to_numpy(), out.score[out.quality == 0].to_numpy()
    assert len(bad) > 3 and (good[:, None] > bad[None, :]).mean() > 0.95
    assert out.score.between(0, 1).all()


def test_density_difference():
    rng = np.random.default_rng(0)
    d = len(Q.FEATURES)
    a, b = rng.normal(size=(400, d)), rng.normal(size=(300, d)) * 2 + 1
    sums = {k: np.hstack([np.ones((len(m), 1)), m]).T @ np.hstack([np.ones((len(m), 1)), m]) for k, m in ((1, a), (0, b))}
    m = Q.Model(sums, pooled=0.0, identity=0.0)
    lean = {k: d / (d + len(x)) for k, x in ((1, a), (0, b))}
    cov = {1: np.cov(a.T, bias=True), 0: np.cov(b.T, bias=True)}
    within = (400 * cov[1] + 300 * cov[0]) / 700
    x = rng.normal(size=(5, d))

    def log(k, mean, n):
        c = (1 - lean[k]) * cov[k] + lean[k] * within
        z = x - mean
        return np.log(n / 700) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(c), z)

    assert m.margin(x) == pytest.approx(log(1, a.mean(0), 400) - log(0, b.mean(0), 300))


def test_edges(spark):
    docs = frame(spark, [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "b"), (4, prose(1, 40_000))], clash=True)
    x = Q.describe(docs)
    lab = lambda *r: spark.createDataFrame(list(r), "doc_id long, quality int")
    for labels, want in ((lab((9, None)), 0.5), (lab((3, 1), (9, 0)), 1.0)):
        rows = Q.score(x, Q.fit(x, labels)).collect()
        assert len(rows) == 6 and {r["score"] for r in rows} == {want}
    rows = Q.score(x, Q.fit(x, lab((1, 0), (4, 1), (3, 1)))).collect()
    assert all(np.isfinite(r["score"]) for r in rows)
    assert Q.score(Q.describe(frame(spark, [])), Q.fit(x, lab((1, 0), (4, 1)))).count() == 0


def test_statistics_do_not_depend_on_neighbours(spark):
    texts = [prose(i, 30) + "\nA!! B##\n" * i for i in range(6)]
    together = {r["doc_id"]: r["x"] for r in Q.describe(frame(spark, list(enumerate(texts))).coalesce(1)).collect()}
    for i, t in enumerate(texts):
        assert Q.describe(frame(spark, [(i, t)])).first()["x"] == pytest.approx(together[i])


def plain(text):
    """The statistics by loops over one text's bytes, words and lines."""
    import math
    import re
    from collections import Counter

    b = (text or "").encode()
    n, groups = len(b), (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:?!", b"#$%&*@^~+=<>/\\", b"|_{}[]", b"\"'()`-", b" \t\n\r\x0b\x0c")
    kind = [next((i for i, g in enumerate(groups, 1) if c in g), 9 if c >= 128 else 0) for c in b]
    by = Counter(kind)
    words = re.findall(rb"[^ \t\n\r\x0b\x0c]+", b)
    lower = Counter(w.lower() for w in words)
    lines = [x for x in b.split(b"\n") if x]
    marks = sum(4 <= kind[i] <= 6 and 4 <= kind[i - 1] <= 6 for i in range(1, n))

    def logit(share, m):
        p = (share * m + 0.5) / (m + 1)
        return math.log(p / (1 - p))

    s, w, ln = max(n, 1), max(len(words), 1), max(len(lines), 1)
    share = lambda k: logit(by[k] / s, n)
    return [
        math.log1p(n), logit((by[1] + by[2] + by[9]) / s, n), *map(share, range(2, 10)), math.log1p(n / w), logit(sum(len(x) > 12 for x in words) / w, len(words)),
        logit(len(lower) / w, len(words)), logit(max(lower.values(), default=0) / w, len(words)), math.log1p(len(lines)), logit(len(set(lines)) / ln, len(lines)), math.log1p(n / ln),
        logit(sum(65 <= x[0] <= 90 for x in words) / w, len(words)), logit(marks / s, n),
    ]


def test_statistics_equal_loops(spark, data):
    texts = [r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").limit(80).collect()]
    texts += [None, "", " ", "\n\n", "a", "Über É\n\nÜber\tX!! ##|| 12 ---\n\x00\x1f end", "same same SAME\nsame same SAME\n", "x" * 50_000]
    got = {r["doc_id"]: r["x"] for r in Q.describe(frame(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(plain(t)), (i, t)


def test_sample_of_repeated_rows_is_bounded(spark):
    """A labelled document that is repeated many times, and a sample that is empty."""
    docs = frame(spark, [(1, prose(1, 20))] * 50 + [(2, "!!! ###")] * 50 + [(3, prose(3, 9))])
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, quality int")
    x = Q.describe(docs)
    for rows in (3, 1, 0):
        s = {r["doc_id"]: r["score"] for r in Q.score(x, Q.fit(x, labels, rows)).collect()}
        assert s[1] > 0.5 > s[2]
