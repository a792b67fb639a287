"""Importance resampling against a plain-Python version."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from verdikt.llm import resampling

from .fixtures import CLASH, DOCS, prose


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def features(text, lo, hi, buckets):
    w = split(text)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(lo, hi + 1) for i in range(len(w) - n + 1)]


def brute(docs, target, lo=1, hi=1, buckets=10_000, seed=2024, percent=10, least=20):
    s, t = (Counter(b for text in texts for b in features(text, lo, hi, buckets)) for texts in ([x for _, x in docs], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    rows = []
    for i, text in docs:
        f = features(text, lo, hi, buckets)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in f)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(split(text)) >= least])
    able = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = k
    return Counter(tuple(r[:5]) for r in rows)


def drawn(spark, docs, target, df=None, **more):
    df = spark.createDataFrame(docs, DOCS) if df is None else df
    out = resampling.resample(df, spark.createDataFrame([(x,) for x in target], "text string"), **more)
    return Counter(tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in out.collect())


ODD = [(900, None), (901, ""), (902, "..., ; -"), (None, "one two three " * 9), (903, "Ärger ÉCLAT 東京 東京 naïve x9 9x " * 5), (904, "A-b_c'd " * 30), (None, None)]


@pytest.mark.parametrize(("lo", "hi"), [(1, 1), (1, 2), (2, 3), (3, 3)])
def test_equals_plain_python(spark, lo, hi):
    rng = random.Random(lo * 10 + hi)
    docs = [(k, prose(k % 40, rng.randint(0, 60))) for k in range(120)] + ODD
    target = [prose(k, 30) for k in range(5)] + [None, "", "one two"]
    got = drawn(spark, docs, target, shortest=lo, longest=hi, buckets=500, percent=25)
    assert got == brute(docs, target, lo, hi, 500, percent=25)


def test_repeated_rows_are_rows_of_their_own(spark):
    copy = (5, "word " * 30)
    docs = [copy] * 40 + [(5, "other " * 25), (6, "word " * 30), (900, None), (900, None), (901, ""), (901, "")]
    for hi in (1, 2):
        got = drawn(spark, docs, ["word other"], longest=hi, percent=50)
        want = brute(docs, ["word other"], 1, hi, percent=50)
        assert sum(got.values()) == len(docs) and Counter(x[:4] for x in got.elements()) == Counter(x[:4] for x in want.elements())
        assert sorted(x[4] for x in got.elements() if x[4]) == list(range(1, 22))
        if hi == 1:
            assert got == want


def test_long_text_empty_tables_and_clashing_names(spark):
    docs = [(k, prose(k, 25)) for k in range(30)] + [(99, prose(1, 120_000))]
    df = spark.createDataFrame(docs, DOCS)
    for c in [*CLASH, "bucket", "run", "n", "first", "gain", "ws", "pos", "word", "copies", "place", "part", "rank", "eligible", "weight"]:
        if c not in df.columns:
            df = df.withColumn(c, df["doc_id"])
    assert drawn(spark, docs, ["a b"], df) == brute(docs, ["a b"])
    assert drawn(spark, [], ["a"]) == Counter()
    assert drawn(spark, docs[:5], []) == brute(docs[:5], [])


def test_more_of_the_target_is_drawn(spark):
    docs = [(k, prose(1 if k % 2 else 2, 400)[k : k + 300]) for k in range(200)]
    got = drawn(spark, docs, [prose(1, 400)], percent=20)
    chosen = [x[0] for x in got if x[4]]
    assert len(chosen) == 40 and sum(k % 2 for k in chosen) == 40
    with pytest.raises(ValueError, match="at least one word"):
        drawn(spark, docs, [], shortest=0)
