"""Greedy windows in chunks against the loop."""

import random

import pytest

from verdikt.operators import series as S

ROWS = "a string, b int, i long, start double, end double, tokens long"


def loop(rows, seconds=8.0, most=25, cap=15.0):
    out = {}
    for key in {r[:2] for r in rows}:
        cur, t0, tok, wins = [], None, 0, []
        for _, _, _, s, e, t in sorted((r for r in rows if r[:2] == key), key=lambda r: r[2]):
            e = s if e is None else e
            if cur and e - t0 > cap:
                wins.append((t0, cur[-1], len(cur), tok))
                cur, tok = [], 0
            if not cur:
                t0 = s
            cur.append(e)
            tok += t
            if e - t0 >= seconds or tok >= most:
                wins.append((t0, e, len(cur), tok))
                cur, tok = [], 0
        if cur:
            wins.append((t0, cur[-1], len(cur), tok))
        out |= {(*key, w): x for w, x in enumerate(wins)}
    return out


def made(seed, lengths, pause=1.0, zero=0.1):
    rng = random.Random(seed)
    out = []
    for k, n in enumerate(lengths):
        at = 0.0
        for i in range(n):
            at = round(at + rng.random() * pause, 3)
            end = None if rng.random() < 0.05 else round(at + rng.random() * 3 - (rng.random() < 0.05) * 5, 3)
            out.append((None if k == 1 else f"s{k}", k, i, at, end, 0 if rng.random() < zero else rng.randrange(12)))
    return out


def windows(spark, rows, short):
    got = S.greedy_windows(spark.createDataFrame(rows, ROWS).repartition(3), ["a", "b"], ["i"], "start", "end", "tokens", short=short).collect()
    return {(r["a"], r["b"], r["w"]): (r["t0"], r["t1"], r["n_seg"], r["n_tok"]) for r in got}


@pytest.mark.parametrize(("short", "pause", "zero"), [(7, 1.0, 0.1), (12, 0.05, 0.95), (30, 9.0, 0.5), (4, 2.0, 0.3)])
def test_chunks_equal_the_loop(spark, short, pause, zero):
    """Windows inside a chunk, over borders, over whole chunks (short pauses, few tokens), and closed by the cap (long pauses)."""
    rows = made(short, [70, 45, 13, 5, 1], pause, zero)
    assert windows(spark, rows, short) == loop(rows)


def test_short_series_are_folded_alike(spark):
    rows = made(9, [60, 30, 3])
    assert windows(spark, rows, 2048) == loop(rows) and windows(spark, [], 5) == {}


def test_a_long_series_spans_tasks(spark):
    """200,000 segments of one series in chunks of 2,048 (a million take the same way; see README)."""
    n = 200_000
    df = spark.range(n, numPartitions=6).selectExpr("'x' a", "1 b", "id i", "id * 1.25D start", "id * 1.25D + id % 4 end", "(id * 7919) % 11 tokens")
    got = S.greedy_windows(df, ["a", "b"], ["i"], "start", "end", "tokens").collect()
    want = loop([("x", 1, i, i * 1.25, i * 1.25 + i % 4, i * 7919 % 11) for i in range(n)])
    assert {(r["a"], r["b"], r["w"]): (r["t0"], r["t1"], r["n_seg"], r["n_tok"]) for r in got} == want
