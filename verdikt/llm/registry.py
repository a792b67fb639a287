"""The training-data operators' queries and SQL, as the driver reads them: each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, embedding_dup, langid, licenses, line_windows, near_dup, negatives, packing, quality, repeated_spans, resampling, urls, warc
from .common import crc_mod, cut


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(crc_mod("doc_id", 3) != 1))
    out = langid.predict(docs, model)
    return out.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "spans")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminations(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans.digest(repeated_spans.remove_repeated(_table(spark, sf_dir, "documents")))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(_table(spark, sf_dir, "documents")))


def op5_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_windows.digest(line_windows.drop_repeated_lines(_table(spark, sf_dir, "documents")))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    described = cut(quality.describe(_table(spark, sf_dir, "documents")), "described")
    labels = _table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = quality.fit(described, labels.where(crc_mod("doc_id", 5) != 0))
    out = quality.score(described, model)
    return out.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (out["score"] >= 0.3).cast("int").alias("predicted"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
    return packing.digest(out)


def op10_embedding_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dup.embedding_duplicates(_table(spark, sf_dir, "embeddings"))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return urls.digest(urls.judge(pages, urls.repeated(pages)))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(negatives.relabelled(_table(spark, sf_dir, "embeddings")))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_language_id, op2_decontamination, op3_repeated_spans, op4_license_scan, op5_minhash_near_dup, op6_line_windows, op7_warc, op8_quality, op9_packing, op10_embedding_near_dup, op11_url_filter, op12_hard_negatives, op13_importance_resampling, pipeline)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": decontam.SQL, "op3_repeated_spans": repeated_spans.SQL, "op5_minhash_near_dup": near_dup.SQL, "op10_embedding_near_dup": embedding_dup.SQL, "op6_line_windows": line_windows.SQL, "op7_warc": warc.SQL, "op11_url_filter": urls.SQL, "op12_hard_negatives": negatives.SQL, "op13_importance_resampling": resampling.SQL}
