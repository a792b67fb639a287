import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from verdikt.llm import repeated_spans as R

from .fixtures import frame, prose


def brute(rows):
    texts = [(t or "").encode() for _, t in rows]
    n = Counter(t[i : i + R.LENGTH] for t in texts for i in range(len(t) - R.LENGTH + 1))
    out = []
    for (d, _), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - R.LENGTH + 1):
            if n[t[i : i + R.LENGTH]] > 1:
                gone[i : i + R.LENGTH] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((d, len(t), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows, **kw):
    out = R.digest(R.remove_repeated(frame(spark, rows, **kw))).collect()
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out), key=str)


def planted():
    passage, other = prose(1, 120), "é" * 150 + prose(2, 90)
    rows = [prose(10 + i, 40) + passage[i * 3 :] + prose(30 + i, 30) for i in range(12)]
    rows += [prose(50, 20) + other + prose(51, 20) + other[:-5], other[7:] + passage[:401], passage[:399], passage[:400], None, "", "x" * 3000, prose(60, 200), prose(60, 200)]
    return list(enumerate(rows))


def test_equals_brute_force(spark):
    rows = planted()
    assert got(spark, rows, clash=True) == brute(rows)


def test_hot_keys_are_split(spark, monkeypatch):
    monkeypatch.setattr(R, "HOT", 2)
    rows = planted()
    assert got(spark, rows) == brute(rows)


def test_repeated_rows_null_ids_and_empty_table(spark):
    rows = [(1, prose(3, 120)), (1, prose(3, 120)), (None, "short")]
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == []


def test_long_text_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK_BYTES", 1500)
    rows = [(1, prose(4, 1200)), (2, prose(5, 100) + prose(4, 1200)[900:4000])]
    assert got(spark, rows) == brute(rows)


@pytest.mark.parametrize("seed", range(6))
def test_matching_statistics(seed):
    rng = random.Random(seed)
    parts = []
    for k in range(8):
        parts += [rng.randint(1, 2) for _ in range(rng.randint(1, 30))] + [100 + k]
    text = np.array(parts)
    want = []
    for i in range(len(parts)):
        best = 0
        for j in range(len(parts)):
            n = 0
            while i != j and i + n < len(parts) and j + n < len(parts) and parts[i + n] == parts[j + n]:
                n += 1
            best = max(best, n)
        want.append(best)
    index = R.RunLengthIndex(text)
    assert index.matching_statistics().tolist() == want
    assert len(index.heads) <= len(text)
