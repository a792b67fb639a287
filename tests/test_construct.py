"""Construction of rows against plain-Python loops."""

import random

import pytest
from pyspark.sql import functions as F

from verdikt.operators import construct as K
from verdikt.operators.running import numbered

PAIRS = "lang string, generator string, draw long, state_a string, gold_a string, state_b string, gold_b string"


def random_pairs(seed, n, states):
    rng = random.Random(seed)
    out = []
    for draw in range(n):
        for g in ("f", "g"):
            a, b = rng.randrange(states), rng.randrange(states)
            out.append((rng.choice(["zh", "zh", "en"]), g, draw, f"s{a}", "A", f"s{b}", rng.choice("AB")))
    return out


def loop(pairs, quotas=None, tries=40):
    """Rows of the loop that accepts a pair unless a state of it was accepted before."""
    seen, out, pair = set(), [], 0
    for lang, quota in (quotas or {None: None}).items():
        made = 0
        for k, (own, g, _, sa, ga, sb, gb) in enumerate(sorted((p for p in pairs if lang in (None, p[0])), key=lambda p: (p[2], p[1]))):
            if quota is not None and (made >= quota or k >= quota * tries):
                break
            if sa == sb or ga == gb or sa in seen or sb in seen:
                continue
            seen |= {sa, sb}
            for side, (s, gold) in enumerate(((sa, ga), (sb, gb))):
                out.append((f"t-e{2 * pair + side:04d}", f"t-ep{pair:03d}", s, gold, g, own))
            pair, made = pair + 1, made + 2
    return sorted(out)


@pytest.mark.parametrize(("seed", "n", "states", "small"), [(1, 300, 400, 0), (2, 300, 60, 0), (3, 200, 150, 40), (4, 150, 10_000, 20_000)])
def test_twins_equal_the_loop(spark, seed, n, states, small):
    pairs = random_pairs(seed, n, states)
    df = spark.createDataFrame(pairs, PAIRS).repartition(3)
    got = K.expand_twins(df, "t", small=small)
    assert sorted(map(tuple, got.select("id", "pair_id", "state", "gold", "generator", "lang").collect())) == loop(pairs)


def test_twins_quotas_by_language(spark):
    pairs = random_pairs(5, 300, 500)
    for quotas, tries in (({"zh": 41, "en": 30}, 40), ({"en": 400, "zh": 20}, 1), ({"zh": 0, "en": 4}, 3)):
        got = K.expand_twins(spark.createDataFrame(pairs, PAIRS), "t", quotas, tries, small=10)
        assert sorted(map(tuple, got.select("id", "pair_id", "state", "gold", "generator", "lang").collect())) == loop(pairs, quotas, tries)


def test_twins_along_a_chain_and_without_pairs(spark):
    chain = [("zh", "g", k, f"s{k}", "A", f"s{k + 1}", "B") for k in range(9)] + [("zh", "g", 20, None, "A", "x", "B")]
    for small in (0, 100):
        got = K.expand_twins(spark.createDataFrame(chain, PAIRS), "t", small=small)
        assert sorted(r["state"] for r in got.collect()) == [f"s{k}" for k in range(10)]
    assert K.expand_twins(spark.createDataFrame([], PAIRS), "t").count() == 0


def test_blocked_pairs_block_nothing(spark):
    """The second pair is rejected, so its other state is free for the third."""
    pairs = [("zh", "g", 0, "a", "A", "b", "B"), ("zh", "g", 1, "b", "A", "c", "B"), ("zh", "g", 2, "c", "A", "d", "B")]
    got = K.expand_twins(spark.createDataFrame(pairs, PAIRS), "t", small=0)
    assert sorted(r["state"] for r in got.collect()) == ["a", "b", "c", "d"]


def test_numbered_counts_on_over_ranges(spark):
    rows = [(k * 37 % 1000, k % 7) for k in range(1000)]
    got = numbered(spark.createDataFrame(rows, "x long, y long").repartition(5), ["x"], "place").collect()
    assert sorted((r["x"], r["place"]) for r in got) == [(k, k + 1) for k in range(1000)]


GOLD = lambda b, s: "B" if b is not None and b < 10 else "C" if s == "x" else "A"


def ablated(spark, rows, drop, **more):
    df = spark.createDataFrame(rows, "id string, b double, s string, n long")
    gold = lambda r: F.when(r["b"] < 10, "B").when(r["s"] == "x", "C").otherwise("A")
    derived = {"low": lambda r: (r["b"] < 10).cast("string"), "named": lambda r: (r["s"] == "x").cast("string"), "big": lambda r: (r["n"] > 5).cast("string")}
    others = [c for c in ("b", "s", "n") if c not in ([drop] if isinstance(drop, str) else drop)]
    return {r["id"]: r.asDict() for r in K.ablate(df, "id", drop, others, gold, derived, **more).collect()}


@pytest.mark.parametrize("n", [1, 2, 40, 1500])
def test_ablation_tries_all_values(spark, n):
    """Substitutes from the cover decide as all values of the table would, at every size; the number's own scaled values too."""
    rng = random.Random(n)
    rows = [(f"i{k}", rng.choice([1.0, 5.0, 9.99, 12.0, 30.0]) + (rng.random() if n > 100 else 0), rng.choice("xyz"), k) for k in range(n)]
    got = ablated(spark, rows, "b")
    for i, b, s, _ in rows:
        tried = {GOLD(v, s) for _, v, _, _ in rows} | {GOLD(round(b * f, 2), s) for f in K.SCALES}
        assert got[i]["valid"] == (len(tried) > 1) and got[i]["irrelevant"] == (tried == {GOLD(b, s)})
        changes = any((v < 10) != (b < 10) for v in [v for _, v, _, _ in rows] + [round(b * f, 2) for f in K.SCALES])
        assert got[i]["low"] == (None if changes else str(b < 10).lower()) and got[i]["named"] == str(s == "x").lower()
    got = ablated(spark, rows, "s")
    for i, b, s, _ in rows:
        tried = {GOLD(b, v) for _, _, v, _ in rows}
        assert got[i]["valid"] == (len(tried) > 1) and got[i]["irrelevant"] == (tried == {GOLD(b, s)})


def test_ablation_of_two_fields_takes_values_that_stand_together(spark):
    rows = [("1", 1.0, "y", 1), ("2", 20.0, "x", 2), ("3", 30.0, "y", 9)]
    got = ablated(spark, rows, ["b", "s"], depends={"b": ["big"]})
    assert all(r["valid"] and r["low"] is None and r["named"] is None and r["big"] is None for r in got.values())
    alike = ablated(spark, [("1", 20.0, "x", 1), ("2", 30.0, "x", 2)], ["b", "s"])
    assert not any(r["valid"] for r in alike.values()) and all(r["irrelevant"] and r["big"] == "false" for r in alike.values())


def test_cover_reaches_both_ends_of_every_field(spark):
    rows = [(f"i{k}", float(k), f"w{k % 400:03d}", k) for k in range(3000)]
    df = spark.createDataFrame(rows, "id string, b double, s string, n long")
    cover = K.value_cover(df, ["b", "s"], 20)
    assert len(cover) <= 40 and {0.0, 2999.0} <= {b for b, _ in cover} and {"w000", "w399"} <= {s for _, s in cover}
    assert all(s == f"w{int(b) % 400:03d}" for b, s in cover)
    assert K.value_cover(df.limit(0), ["b"]) == [] and len(K.value_cover(df, ["n"], 65)) == 65


def test_percentiles_interpolate_between_neighbours(spark):
    import numpy as np

    from verdikt.operators.running import percentiles, unit_bucket

    rng = random.Random(8)
    rows = [("a", rng.random()) for _ in range(101)] + [("b", rng.choice([0.25, 0.5])) for _ in range(40)] + [("c", 0.75), ("a", None), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    for bucket in (None, unit_bucket("_v")):
        got = {r["g"]: r for r in percentiles(df, ["g"], "v", {"lo": 0.05, "mid": 0.5, "hi": 0.99, "all": 1.0}, bucket).collect()}
        assert set(got) == {"a", "b", "c"}
        for g, r in got.items():
            own = [v for k, v in rows if k == g and v is not None]
            assert [r["lo"], r["mid"], r["hi"], r["all"]] == pytest.approx(np.quantile(own, [0.05, 0.5, 0.99, 1.0]))
    assert percentiles(df, [], F.col("v") * -1000, {"x": 0.3}).first()["x"] == pytest.approx(np.quantile([-1000 * v for _, v in rows if v is not None], 0.3))


def test_reads_with_look_alikes(spark):
    from verdikt.operators.rank import gold_reads, read_difficulty

    rng = random.Random(6)
    rows, right = [], {}
    for q in range(40):
        gold = rng.randrange(12)
        ranks = rng.sample(range(1, 13), 12)
        for g in range(3):
            members = list(range(g * 4, g * 4 + 4))
            best = rng.choice(members)
            rows += [(q, c, gold, ranks[c], g, c == best) for c in members]
        right[q] = rng.random() < 0.5 and any(r[0] == q and r[1] == gold and r[5] for r in rows)
    dealt = spark.createDataFrame(rows, "q int, cand int, gold int, rank int, g int, wins boolean")
    reads = gold_reads(dealt, ["q"], spark.createDataFrame(list(right.items()), "q int, correct boolean"), 5)
    got = {(r["q"], r["n"]): (r["size"], r["look"], r["lost"]) for r in reads.collect()}
    want = {}
    for q, ok in right.items():
        own = [r for r in rows if r[0] == q]
        mine = next(r for r in own if r[1] == r[2])
        sets = [[r for r in own if r[4] == mine[4]]] + ([[r for r in own if r[5]]] if mine[5] else [])
        for n, members in enumerate(sets):
            want[q, n] = (len(members), sum(r[3] <= 5 and r[1] != r[2] for r in members), not ok and n == len(sets) - 1)
    assert got == want
    r = read_difficulty(reads, [], F.lit(40)).first()
    hard, easy = [v for v in want.values() if v[1]], [v for v in want.values() if not v[1]]
    assert r["hard_reads"] == len(hard) / 40 and r["lost_hard"] == pytest.approx(sum(v[2] for v in hard) / len(hard)) and r["lost_easy"] == (pytest.approx(sum(v[2] for v in easy) / len(easy)) if easy else None)


def test_perturbations_follow_their_rules(spark):
    pairs = [("數值", "數植"), ("停線", "停現"), ("異常", "異長"), ("值異", "XX")]
    texts = ["the machine stopped again because pressure dropped", "ab cd 停線數值異常停線", "", "short one", "Alarm 7: MACHINE Stopped, machine-stop", "數值異常數值"] * 8
    df = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "id string, t string")
    key = F.col("id")
    cut = K.without_cues(F.col("t"), key, ["異常", "數值異常", "停線"], ["machine", "stopped"], ["狀況", "情形"])
    rows = df.select("id", "t", K.typos(F.col("t"), key).alias("typo"), K.swapped_terms(F.col("t"), key, pairs).alias("swapped"), cut.alias("cut")).collect()
    counts = set()
    for r in rows:
        before, after = r["t"].split(" "), r["typo"].split(" ")
        changed = [(x, y) for x, y in zip(before, after, strict=True) if x != y]
        long = [w for w in before if w.isascii() and w.isalpha() and len(w) >= 5]
        assert len(changed) <= 2 and all(x in long and x[0] == y[0] and len(x) - len(y) in (0, 1) for x, y in changed)
        counts.add((len(long) > 1, len(changed)))
        for x, y in changed:
            drops = {x[:k] + x[k + 1 :] for k in range(1, len(x) - 1)}
            assert y in drops | {x[:k] + x[k + 1] + x[k] + x[k + 2 :] for k in range(1, len(x) - 1)}
        held = [p for p in pairs if p[0] in r["t"]]
        ways = {r["t"]} if not held else {r["t"].replace(*p, 1) for p in held} | {r["t"].replace(*p, 1).replace(*q, 1) for p in held for q in held if p != q}
        assert r["swapped"] in ways and (not held or r["swapped"] != r["t"])
        removed, left = [], r["t"]
        for term in ("數值異常", "停線", "異常"):
            if term in left:
                removed.append(term)
                left = left.replace(term, "狀況")
        words = [w for w in ("machine", "stopped") if w in r["t"].lower()]
        assert r["cut"]["removed"] == removed + words
        assert "異常" not in r["cut"]["text"] and "停線" not in r["cut"]["text"] and "machine" not in r["cut"]["text"].lower().replace("machine-", "x") and r["cut"]["text"].count("ISSUE") == sum(r["t"].lower().count(w) for w in words)
    assert (True, 1) in counts and (True, 2) in counts


def test_graded_answers_follow_the_procedures(spark):
    import hashlib

    rows = [
        ("p1", ["a", "b", "c", "d", "e"], ["key", "key", "minor", "key", "minor"], 1, "X", [2, 3], "p2"),
        ("p2", ["f", "g"], ["key", "key"], 0, "Y", None, "p9"),
        ("p3", ["h"], ["key"], 0, "Z", [], "p1"),
        ("p4", [], [], 0, "W", [], "p3"),
    ]
    df = spark.createDataFrame(rows, "pid string, steps array<string>, kinds array<string>, danger_at int, danger_text string, danger_removes array<int>, off_pid string")
    got = {(r["pid"], r["level"]): (r["fault"], r["difficulty"], r["steps"]) for r in K.graded_answers(df).collect()}
    want = {}
    for pid, steps, kinds, at, text, removes, off in rows:
        first = lambda places, pid=pid: min(places, key=lambda i: hashlib.md5(f"{pid}:{i}".encode()).hexdigest(), default=None)
        minor = first([i for i, k in enumerate(kinds) if k == "minor"])
        keys = [i for i, k in enumerate(kinds) if k == "key"]
        key = first([i for i in keys if i != at] or keys)
        want[pid, 5] = (None, "easy", steps)
        if minor is not None:
            want[pid, 4] = ("minor_missing", "hard", steps[:minor] + steps[minor + 1 :])
        if key is not None:
            want[pid, 3] = ("key_missing", "hard", steps[:key] + steps[key + 1 :])
        want[pid, 2] = ("danger", "easy", [text if i == at else s for i, s in enumerate(steps) if i not in (removes or [])])
        other = {r[0]: r[1] for r in rows}.get(off)
        if other is not None:
            want[pid, 1] = ("offtopic", "easy", other)
    assert got == want
