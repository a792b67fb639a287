"""Each stage against a plain version of itself, on its predecessor's output, and the packed result."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

from .fixtures import CLASH, prose
from .test_decontam import brute as brute_contaminations
from .test_line_windows import brute as brute_lines
from .test_near_dup import brute as brute_groups


@pytest.fixture(scope="module")
def stages(spark, data):
    from verdikt.llm.common import cut

    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out.append(cut(stage(spark, out[-1], data), name))
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_columns_stay(stages):
    assert all(x.columns == stages[0].columns for x in stages)


def test_language(spark, stages, data):
    from verdikt.llm import langid

    found = {r["doc_id"]: r for r in langid.predict(stages[0], langid.fit(stages[0])).collect()}
    assert texts(stages[1]).keys() == {d for d, r in found.items() if r["lang_pred"] != "und" and r["score"] >= corpus_pipeline.LEAST_LANGUAGE}
    rows = spark.createDataFrame([(10**9, "1234", None, "s", 4), (10**9 + 1, None, None, "s", 0)], stages[0].schema)
    kept = texts(corpus_pipeline.language(spark, stages[0].unionByName(rows), data))
    assert not kept.keys() & {10**9, 10**9 + 1}


def test_lines(stages):
    import hashlib

    want = brute_lines(list(texts(stages[1]).items()))
    got = texts(stages[2])
    for d, t in got.items():
        assert hashlib.sha256((t or "").encode()).hexdigest() == want[d][3]
    assert all(w[0] == w[1] or w[1] > 0 for d, w in want.items() if d not in got)


def test_near(stages):
    want = brute_groups(sorted(texts(stages[2]).items()))
    assert texts(stages[3]).keys() == {d for d, r in want.items() if r[2]}


def test_clean(spark, stages, data):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    seeds = set()
    from .test_decontam import shingles, words

    for _, t in items:
        seeds |= shingles(words(t)).keys()
    near = {d: t for d, t in texts(stages[3]).items() if shingles(words(t)).keys() & seeds}
    bad = {d for d, _ in brute_contaminations(list(near.items()), items)}
    assert texts(stages[4]).keys() == texts(stages[3]).keys() - bad


def test_run_packs_what_is_left(spark, stages, data):
    out = corpus_pipeline.run(spark, data)
    assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} == texts(stages[4]).keys()
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


SHAPE = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, folder, rows, items, clash=()):
    docs = spark.createDataFrame([(*r, "s", len(r[1] or "")) for r in rows], SHAPE)
    for c in clash:
        docs = docs.withColumn(c, F.lit("x"))
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_run_on_nulls_repeated_ids_and_clashing_names(spark, tmp_path):
    item = prose(70, 40)
    rows = [(i, prose(i, 40), "en") for i in range(8)]
    rows += [(None, prose(50, 40), "en"), (None, "1 2 3", "en"), (None, item, "en"), (None, None, None)]  # good, no language, contaminated, null
    rows += [(20, prose(60, 40), "en"), (20, "4 5 6", None), (20, prose(61, 9) + " " + item, "en")]  # an id with three texts
    rows += [(30, rows[3][1], "en"), (31, "", None), rows[5]]
    d = tables(spark, tmp_path, rows, [(1, item), (2, None)], CLASH)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    spoken = stage["language"](spark, docs, d)
    assert spoken.columns == docs.columns and sorted(r["text"] for r in spoken.collect()) == sorted(t for _, t, _ in rows if t and t[0] not in "14")
    clean = stage["clean"](spark, docs, d)
    assert clean.columns == docs.columns and sorted(str(r["text"]) for r in clean.collect()) == sorted(str(t) for _, t, _ in rows if item not in (t or ""))
    lines = stage["lines"](spark, docs, d)
    assert lines.columns == docs.columns and lines.count() == len(rows) and {r["lines"] for r in lines.collect()} == {"x"}
    near = stage["near"](spark, docs, d)
    assert near.columns == docs.columns and {r["doc_id"] for r in near.collect()} == {d for d, _, _ in rows} - {30}
    out = corpus_pipeline.run(spark, d)
    assert {r["doc_id"] for r in out.collect()} == {*range(8), None, 20}


def test_run_on_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, tables(spark, tmp_path / "a", [], [(1, "a b c")])).count() == 0
    rows = [(1, prose(1, 30), "en"), (2, prose(2, 30), "en")]
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, tables(spark, tmp_path / "b", rows, [])).collect()} == {1, 2}
