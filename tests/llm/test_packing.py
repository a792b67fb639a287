import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from verdikt.llm import packing, tokens

from .fixtures import frame, prose

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def coder():
    return tokens.Ids(PATH)


def ids_of(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return [[*e.ids, packing.END] for e in t.encode_batch(texts, add_special_tokens=False)]


def check(rows, texts):
    want = ids_of([t or "" for t in texts.values()])
    want = dict(zip(texts, want, strict=True))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert pieces.keys() == want.keys()
    for d, ids in want.items():
        own = sorted(pieces[d], key=lambda r: r["start"])
        assert [x for r in own for x in r["ids"]] == ids
        at = 0
        for r in own:
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["length"] > 0
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
    padding = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding == 0


def test_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    check(packing.pack(docs, PATH).collect(), {r["doc_id"]: r["text"] for r in docs.collect()})


def test_edges(spark):
    texts = {1: None, 2: "", 3: " \n", 4: "word", 5: prose(1, 30_000), 6: "a" * 5000, 7: "<|endoftext|> x <|STARTOFTEXT|>.", 8: "Don't STOP, 'll x_y 3.14! é É é"}
    rows = packing.pack(frame(spark, list(texts.items()), clash=True).coalesce(1), PATH).collect()
    check(rows, texts)
    assert packing.pack(frame(spark, []), PATH).count() == 0
    twice = packing.pack(frame(spark, [(1, "x"), (1, "x"), (None, "y")]), PATH).collect()
    assert sorted((r["doc_id"] or 0, r["doc_tokens"]) for r in twice if r["start"] == 0) == [(0, 2), (1, 2), (1, 2)]


def test_small_slices(spark, data, monkeypatch):
    """Texts in many slices give the whole text's ids."""
    monkeypatch.setattr(tokens, "SLICE", 50)
    texts = [r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").limit(30).collect()]
    for got, ids in zip(tokens.Ids(PATH).of(texts), ids_of(texts), strict=True):
        assert got.tolist() == ids[:-1]


@given(st.lists(st.text(st.one_of(st.sampled_from("aZ09'sStTreVElLmMdD \t\n.,-\u00c9\u00e9\u0301\u03a3\u0130\u4f60\u2019\u00a0\u0001"), st.characters(codec="utf-8")), max_size=30), max_size=6))
@settings(max_examples=300, deadline=None)
def test_any_text_has_the_tokenizers_ids(coder, texts):
    for got, ids in zip(coder.of(texts), ids_of(texts), strict=True):
        assert got.tolist() == ids[:-1]


def test_few_texts_leave_the_shorter_way(coder, data):
    import pandas as pd

    slow = []
    coder._slow, whole = lambda texts: slow.extend(texts) or whole(texts), coder._slow
    texts = [*pd.read_parquet(f"{data}/documents.parquet").text.fillna(""), "na\u00efve don't \u4f60\u597d \u043f\u0440\u0438\u0432\u0435\u0442 \u2014 caf\u00c9 \U0001f600"]
    coder.of(texts)
    assert not [t for t in slow if t.isalpha()] and len(slow) <= 2


def test_packer_fills_windows_and_balances_steps():
    p = packing.Packer(packing.TIERS)
    rng = np.random.default_rng(0)
    sizes = [int(x) for x in rng.integers(1, 3000, 300)]
    for k, n in enumerate(sizes):
        p.add(k, b"\0\0\0\0" * n)
    p.pack()
    p.finish()
    done = p.taken()
    assert sum(size for size, _, _ in done) == sum(sizes)
    assert all(sum(x[2] for x in parts) == size for size, parts, _ in done)
    load = defaultdict(int)
    for size, _, g in done:
        load[g] += size
    assert max(load.values()) - min(load.values()) <= 2048
    assert {size for size, _, _ in done} >= {1024, 2048}


def test_other_tokenizers(spark):
    """A file of another kind is encoded by the library alone."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    t, texts = Tokenizer.from_file(path), ["Two  words, x_y 3.14", "", "\u4f60"]
    for got, e in zip(tokens.Ids(path).of(texts), t.encode_batch(texts, add_special_tokens=False), strict=True):
        assert got.tolist() == e.ids
