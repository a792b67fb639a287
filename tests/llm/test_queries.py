"""The registered queries equal their SQL, and have the contracts' columns."""

import pytest

from verdikt.llm import registry

from ..compare import connection, table

COLUMNS = {
    "op1": "doc_id held_out lang_pred score", "op3": "doc_id n_bytes n_removed n_spans kept_sha256", "op4": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op5": "doc_id n_shingles component_id kept", "op7": "page_id payload_bytes payload_digest record_type refers_to", "op8": "doc_id held_out score predicted",
    "op9": "doc_id start length ids_crc32 doc_tokens sequence_id offset", "op10": "vec_id n_links component_id kept",
    "op11": "page_id host path rule verdict", "op13": "doc_id n_features weight score rank",
}


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, data, name):
    got = table(registry.queries()[name](spark, data).toPandas())
    assert got == table(connection(data).sql(registry.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", [n for n in registry.queries() if n.split("_")[0] in COLUMNS])
def test_columns(spark, data, name):
    out = registry.queries()[name](spark, data)
    assert set(COLUMNS[name.split("_")[0]].split()) <= set(out.columns)
    source = {"op7": "pages", "op10": "embeddings", "op11": "pages"}.get(name.split("_")[0], "documents")
    n = spark.read.parquet(f"{data}/{source}.parquet").count()
    assert out.count() >= n if name.startswith("op9") else out.count() == n


def test_hard_negatives_columns(spark, data):
    assert set(registry.queries()["op12_hard_negatives"](spark, data).columns) >= set("anchor_id positive_id rank negative_id positive_score negative_score".split())
