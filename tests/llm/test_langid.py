import numpy as np
import pytest
from pyspark.sql import functions as F

from verdikt.llm import langid
from verdikt.llm.common import crc_mod

from .fixtures import frame


def loop(scores, switch):
    d, back = scores[0].copy(), []
    for s in scores[1:]:
        top, arg = d.max(), int(d.argmax())
        stay = d >= top - switch
        back.append(np.where(stay, np.arange(len(d)), arg))
        d = np.where(stay, d, top - switch) + s
    path = [int(d.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


@pytest.mark.parametrize("seed", range(4))
def test_viterbi_equals_a_loop(seed):
    rng = np.random.default_rng(seed)
    sizes = [1, 3, 256, 257, 700, 2]
    rows = np.repeat(np.arange(len(sizes)), sizes)
    scores = rng.normal(size=(len(rows), 4)) + np.repeat(rng.normal(size=(len(rows) // 40 + 1, 4)) * 2, 40, 0)[: len(rows)]
    got = langid.viterbi(scores, rows, 3.0)
    want = [x for r in range(len(sizes)) for x in loop(scores[rows == r], 3.0)]
    assert got.tolist() == want
    assert langid.viterbi(np.zeros((0, 4)), np.zeros(0, np.int64), 3.0).tolist() == []


def test_held_out_accuracy(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = langid.fit(docs.where(crc_mod("doc_id", 3) != 1))
    out = langid.predict(docs, model).join(docs.where(crc_mod("doc_id", 3) == 1).select("doc_id", "lang"), "doc_id")
    right, low, high = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.min("score"), F.max("score")).first()
    assert right > 0.97 and 0 <= low <= high <= 1


def test_mixed_text_and_scripts(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    en, de = (docs.where(f"lang = '{x}'").orderBy("doc_id").first()["text"] for x in ("en", "de"))
    extra = spark.createDataFrame([("привет мир как дела хорошо спасибо", "ru")] * 3, "text string, lang string")
    model = langid.fit(docs.select("text", "lang").unionByName(extra))
    cut = lambda t, n: " ".join(t.split()[:n])
    rows = [(1, cut(en, 60) + " " + cut(de, 25)), (2, "спасибо"), (3, None), (4, "123 !!"), (5, ""), (5, ""), (None, cut(de, 30)), (6, cut(en, 30_000))]
    got = {r["doc_id"]: r for r in langid.predict(frame(spark, rows, clash=True), model).collect()}
    assert [s["lang"] for s in got[1]["spans"]] == ["en", "de"] and got[1]["lang_pred"] == "en" and 0.5 < got[1]["score"] < 1
    assert got[2]["lang_pred"] == "ru"
    assert [(got[i]["lang_pred"], got[i]["score"]) for i in (3, 4, 5)] == [("und", 0.0)] * 3
    assert got[None]["lang_pred"] == "de" and got[6]["lang_pred"] == "en"
    assert langid.predict(frame(spark, []), model).count() == 0


def test_nothing_learned(spark):
    model = langid.fit(spark.createDataFrame([(None, "en"), ("x", None)], "text string, lang string"))
    assert langid.predict(frame(spark, [(1, "word")]), model).first()["lang_pred"] == "und"


M64 = (1 << 64) - 1


def mixed(x):
    x ^= x >> 33
    x = x * 0xFF51AFD7ED558CCD & M64
    x ^= x >> 33
    x = x * 0xC4CEB9FE1A85EC53 & M64
    return x ^ (x >> 33)


def plain_words(text):
    """Runs of letters and marks, lower-cased: each one's trigram bins, script and number of letters."""
    import unicodedata

    names, out, run = list(dict.fromkeys(s[0] for s in langid.SCRIPTS)), [], ""
    for c in (text or "").lower() + "\n":
        if unicodedata.category(c)[0] in "LM":
            run += c
            continue
        if run:
            code = [0, *map(ord, run), 0]
            bins = [mixed(code[i - 1] | code[i] << 21 | code[i + 1] << 42) >> 48 for i in range(1, len(code) - 1)]
            script = next((names.index(n) + 1 for n, a, z in reversed(langid.SCRIPTS) if a <= ord(run[0]) <= z), 0)
            out.append((bins, script, sum(unicodedata.category(c)[0] == "L" for c in run)))
        run = ""
    return out


def plain_model(rows):
    langs = sorted({lang for _, lang in rows})
    n, seen = {x: np.zeros(langid.BINS) for x in langs}, {x: np.zeros(256) for x in langs}
    for text, lang in set(rows):
        for bins, script, letters in plain_words(text):
            for b in bins:
                n[lang][b] += 1
            seen[lang][script] += letters
    scores = {x: np.log((n[x] + 0.1) / (n[x].sum() + 0.1 * langid.BINS)) for x in langs}
    return langs, scores, {x: seen[x] >= 0.01 * max(seen[x].sum(), 1) for x in langs}


def test_model_and_predictions_equal_plain_python(spark, data):
    docs = [(r["text"], r["lang"]) for r in spark.read.parquet(f"{data}/documents.parquet").where("text is not null and lang is not null").limit(60).collect()]
    docs += [("привет мир, 你好 été", "ru"), ("привет мир, 你好 été", "ru"), ("спасибо", "ru")]
    model = langid.fit(spark.createDataFrame(docs, "text string, lang string"))
    langs, scores, scripts = plain_model(docs)
    assert model.languages == langs
    for k, x in enumerate(langs):
        assert model.scores[:, k] == pytest.approx(scores[x].astype(np.float32)) and (model.scripts[:, k] == scripts[x]).all()
    texts = [*(t[:3000] for t, _ in docs[:20]), "Привет the мир! 你好", "x1y2 áb", "12 -", None, docs[0][0][:400] + " спасибо " * 30]
    for r in langid.predict(frame(spark, list(enumerate(texts))), model).collect():
        words = plain_words(texts[r["doc_id"]])
        if not words:
            assert (r["lang_pred"], r["score"], r["spans"]) == ("und", 0.0, [])
            continue
        table = []
        for bins, script, _ in words:
            allowed = [scripts[x][script] for x in langs]
            s = [float(sum(model.scores[b, k].astype(float) for b in bins)) for k in range(len(langs))]
            table.append([(v if ok else -1e6) if any(allowed) else 0.0 for v, ok in zip(s, allowed, strict=True)])
        path = loop(np.array(table), langid.SWITCH)
        letters = [sum(w[2] for w, p in zip(words, path, strict=True) if p == k) for k in range(len(langs))]
        best = int(np.argmax(letters))
        assert (r["lang_pred"], r["score"]) == (langs[best], pytest.approx(letters[best] / sum(letters)))
        cuts = [i for i in range(len(path)) if not i or path[i] != path[i - 1]]
        assert [(s["lang"], s["word"], s["words"]) for s in r["spans"]] == [(langs[path[a]], a, z - a) for a, z in zip(cuts, [*cuts[1:], len(path)], strict=True)]


def test_copies_teach_once_and_languages_are_bounded(spark, monkeypatch):
    rows = [("ab ab", "xx")] * 300 + [("cd cd", "xx"), ("ef", "yy"), ("gh", "zz")]
    df = spark.createDataFrame(rows, "text string, lang string")
    model = langid.fit(df)
    assert (model.scores == langid.fit(df.distinct()).scores).all() and model.languages == ["xx", "yy", "zz"]
    monkeypatch.setattr(langid, "LANGUAGES", 2)
    assert langid.fit(df).languages == ["xx", "yy"]
