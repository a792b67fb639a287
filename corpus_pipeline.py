"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination and packing, each over all that is left.

``run`` writes each stage's result as Parquet in the shared folder and reads it back as the next stage's documents. All
stages but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdikt.llm import decontam, langid, line_windows, near_dup, packing
from verdikt.llm.common import cut, free

#: A document goes if its language is undetermined or fewer of its letters than this lie in spans of its language.
LEAST_LANGUAGE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one learned language; mixed ones stay if most letters are of one. Every row is judged by its own text."""
    return langid.in_language(docs, langid.fit(docs), LEAST_LANGUAGE)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts less repeated line windows; a document that loses all of its text goes, one that was empty before stays. Rows
    that repeat a doc_id and its text are one document."""
    out = line_windows.drop_repeated_lines(docs)
    facts = out.columns[-1]
    out = out.where((F.trim(F.coalesce("text", F.lit(""))) != "") | (F.col(f"`{facts}`.removed") == 0))
    length = {"n_chars": F.length("text").cast(dict(docs.dtypes).get("n_chars", "long"))} if "n_chars" in docs.columns else {}
    return out.withColumns(length).select(*(F.col(f"`{c}`") for c in docs.columns))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that with the smallest doc_id; rows without an id stay, and rows that
    repeat a doc_id stay or go together."""
    kept_id = free(docs.columns, "kept_id")
    kept = near_dup.near_duplicates(docs).where("kept").select(F.col("doc_id").alias(kept_id)).distinct()
    return docs.where("doc_id is null").unionByName(docs.join(kept, docs["doc_id"] == kept[kept_id], "left_semi"))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates, judged by their texts whatever their ids."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left, in sequences of at most 2,048 ids."""
    import public_tokenizers

    return packing.digest(packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False))


STAGES = [("language", language), ("lines", lines), ("near", near), ("clean", clean), ("packed", packed)]
#: Language ID and packing aren't SQL; the tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. An empty table gives none; nulls, repeated ids and further columns are treated as each stage says."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
