import math
import random
import re
from collections import Counter

import pytest

from verdikt.llm import decontam

from .fixtures import frame, prose


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))


def shingles(w):
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def brute(docs, items):
    best = {}
    for d, t in docs:
        w = words(t)
        for i, u in items:
            v = words(u)
            if not w or not v:
                continue
            n = len(v)
            for s in range(max(1, len(w) - n + 1)):
                a, b = shingles(w[s : s + n]), shingles(v)
                both = sum((a & b).values())
                sim = both / (sum(a.values()) + sum(b.values()) - both)
                if sim >= 0.75 and (d, i) not in best or sim > best.get((d, i), (2,))[0]:
                    best[d, i] = (sim, s)
    return {k: v for k, v in best.items() if v[0] >= 0.75}


def got(spark, docs, items, **kw):
    b = spark.createDataFrame(items, "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): (r["similarity"], r["word"]) for r in decontam.contaminations(frame(spark, docs, **kw), b).collect()}


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_ITEMS", 4)  # several blocks of items
    rng = random.Random(5)
    items = [(i, prose(200 + i, rng.randint(12, 60))) for i in range(8)] + [(20, "only three words"), (21, None), (22, "..."), (23, "again " * 12)]
    docs = []
    for i, text in items[:8]:
        w = text.split()
        edited = list(w)
        edited[len(w) // 2] = "changed"
        docs += [prose(400 + i, 30) + " " + text.upper().replace(" ", ", ") + ". " + prose(500 + i, 20), " ".join(edited) + " " + prose(600 + i, 9), " ".join(w[: len(w) // 2]), prose(700 + i, 50), prose(800 + i, 7) + " " + " ".join(w[:-2] + ["new", "end"] + w[-2:])]
    docs += ["here are only three words", "again " * 30, None, "", items[0][1], prose(9, 5000) + " " + items[1][1]]
    docs = list(enumerate(docs))
    docs.append(docs[0])
    a, b = got(spark, docs, items, clash=True), brute(docs, items)
    assert a.keys() == b.keys()
    assert all(a[k][0] == pytest.approx(b[k][0]) and a[k][1] == b[k][1] for k in b)


def test_passages_changed_at_the_end(spark):
    """Edge-truncated passages at 0.75 to 0.8: all changed words at one end, so that many words differ."""
    items, docs = [], []
    for i in range(120):
        n, lost = [(39, 5), (60, 8), (30, 3)][i % 3]
        w = prose(3000 + i, n).split()
        items.append((i, " ".join(w)))
        cut = w[: n - lost] if i % 2 else w[lost:]
        rest = prose(4000 + i, 12).split()
        docs.append((i, " ".join(cut + rest if i % 2 else rest + cut)))
    a, b = got(spark, docs, items), brute(docs, items)
    assert len(b) == 120 and all(0.75 <= v[0] < 0.8 for v in b.values())
    assert a.keys() == b.keys()
    assert all(a[k][0] == pytest.approx(b[k][0]) and a[k][1] == b[k][1] for k in b)


def test_passages_with_parts_swapped(spark):
    items, docs = [], []
    for i, (n, at) in enumerate([(100, 50), (59, 30), (59, 20), (200, 100)]):
        w = prose(5000 + i, n).split()
        items.append((i, " ".join(w)))
        docs += [(10 * i, prose(5100 + i, 40) + " " + " ".join(w[at:] + w[:at]) + " " + prose(5200 + i, 300)), (10 * i + 1, " ".join(w[at:] + w[:at])), (10 * i + 2, " ".join(w[at + 3 :] + w[:at]))]
    items += [(10, "again and " * 9), (11, "one two"), (12, "a")]
    docs += [(90, "and again " * 40), (91, "two one two"), (92, None), (None, docs[0][1]), (93, items[0][1] + " " + items[0][1])]
    docs.append((0, "another text of the same doc_id " + items[1][1]))
    a, b = got(spark, docs, items), brute(docs, items)
    assert {(10 * i, i) for i in range(4)} <= b.keys()
    assert a.keys() == b.keys()
    assert all(a[k][0] == pytest.approx(b[k][0]) and a[k][1] == b[k][1] for k in b)


def test_empty_tables(spark):
    assert got(spark, [], [(1, "a b c d e f")]) == {}
    assert got(spark, [(1, "a b c d e f")], []) == {}
    docs = frame(spark, [(1, "a b c d e f"), (None, "q")], clash=True)
    b = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert [(r["doc_id"], r["text"]) for r in decontam.clean(docs, b).collect()] == [(None, "q")]


def test_long_item_with_many_equal_shingles(spark, monkeypatch):
    """A block larger than what may be broadcast, and thousands of equal shingles in one item."""
    monkeypatch.setattr(decontam, "BLOCK_SHINGLES", 1000)
    item = "again and " * 3000 + prose(1, 200)
    docs = [(1, prose(2, 20) + " " + item), (2, item.replace("and", "or")), (3, prose(3, 100))]
    a = got(spark, docs, [(1, item)])
    assert a == {(1, 1): (1.0, 20)}


def test_no_python_in_the_plan(spark):
    df = decontam.contaminations(frame(spark, [(1, "a b c d e f")]), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    assert math.isclose(decontam.LEAST, 0.75)
