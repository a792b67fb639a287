"""Retrieval, ranking and routing: scores, shortlists, tournaments, BM25 and their metrics."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import expr as E
from ..sources.shared import settled


def centroids(vectors: DataFrame) -> DataFrame:
    """label and centre, the normalised mean of its embeddings, in label order."""
    x = vectors.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    c = x.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("centre"))
    return c.withColumn("centre", F.transform("centre", lambda x: x / E.norm("centre")))


def scores(queries: DataFrame, centres: DataFrame, scale: float = 10.0) -> DataFrame:
    """queries without embedding, with cand and score = scale * cosine for every centre; centres are broadcast, one a label."""
    cos = E.dot("embedding", "centre") / E.norm("embedding")
    return queries.join(F.broadcast(centres)).select(*[c for c in queries.columns if c != "embedding"], F.col("label").alias("cand"), (cos * scale).alias("score"))


def ranked(df: DataFrame, by: list[str], score: str = "score", tie: str = "cand") -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), tie)))


def shortlist(df: DataFrame, by: list[str], k: int, catalog: str = "cand") -> DataFrame:
    """by and the k best candidates, listed in catalog order."""
    top = ranked(df, by).where(F.col("rank") <= k)
    return top.groupBy(*by).agg(F.array_sort(F.collect_list(catalog)).alias("shortlist"))


def recall_at(df: DataFrame, by: list[str], gold: str, ks: list[int]) -> DataFrame:
    """k and the share of queries whose gold candidate is among the k best."""
    r = ranked(df, by).where(F.col("cand") == F.col(gold)).select(*by, "rank").withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    n = df.select(*by).distinct().agg(F.count("*").alias("n"))
    return r.groupBy("k").agg(F.sum((F.col("rank") <= F.col("k")).cast("long")).alias("hits")).join(F.broadcast(n)).select("k", (F.col("hits") / F.col("n")).alias("recall"))


def ndcg(df: DataFrame, by: list[str], rel: str = "rel", at: int = 5) -> DataFrame:
    """Gain 2^rel - 1, discount log2(rank + 1); 0 where the ideal is 0. ``df`` has rank."""
    gain = F.pow(F.lit(2.0), F.col(rel)) - 1.0
    ideal = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(rel)))
    part = lambda r: F.sum(F.when(F.col(r) <= at, gain / F.log2(F.col(r) + 1.0)).otherwise(0.0))
    x = df.withColumn("ideal", ideal).groupBy(*by).agg(part("rank").alias("dcg"), part("ideal").alias("best"))
    return x.select(*by, F.when(F.col("best") > 0, F.col("dcg") / F.col("best")).otherwise(0.0).alias("ndcg"))


def reciprocal_rank(df: DataFrame, by: list[str], relevant: Column, at: int = 3) -> DataFrame:
    """1 / rank of the first relevant candidate (0 without), and whether one is among the first ``at``."""
    first = F.min(F.when(relevant, F.col("rank")))
    return df.groupBy(*by).agg(F.coalesce(1.0 / first, F.lit(0.0)).alias("rr"), F.coalesce(first <= at, F.lit(False)).alias("recalled"))


def tournament(df: DataFrame, by: list[str], group: int = 10, read: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """by, winner, reads and gold_in_final of tournaments: the best of each ``group`` neighbours in catalog order goes up a
    level until at most ``group`` are left, which a last read decides. ``df`` has cand, score and, for gold_in_final, gold.

    A read scores its group anew: ``read`` gives the score from the level and the group's number (and the row's columns), as
    a reader sees other candidates in each group; without it the row's score counts in every read. Rounds follow from the
    largest query's number of candidates.
    """
    largest = df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    score = read or (lambda level, g: F.col("score"))
    w = Window.partitionBy(*by).orderBy("cand")
    alive, level = df.withColumn("pos", F.row_number().over(w) - 1).withColumn("reads", F.lit(0).cast("long")), 0
    while largest > group:
        alive = alive.withColumn("n", F.count("*").over(Window.partitionBy(*by)))
        # a query with few candidates waits for the last read
        waits = F.col("n") <= group
        alive = alive.withColumn("g", F.when(waits, -F.col("pos") - 1).otherwise(F.floor(F.col("pos") / group)).cast("long"))
        alive = alive.withColumn("now", score(F.lit(level), F.col("g"))).withColumn("reads", F.col("reads") + F.when(waits, 0).otherwise(F.ceil(F.col("n") / group)))
        best = F.row_number().over(Window.partitionBy(*by, "g").orderBy(F.desc("now"), "cand"))
        alive = alive.withColumn("best", best).where("best = 1").withColumn("pos", F.row_number().over(w) - 1).drop("n", "g", "now", "best")
        largest, level = -(-largest // group), level + 1
    last = alive.withColumn("now", score(F.lit(level), F.lit(0).cast("long")))
    top = F.max_by("cand", F.struct("now", (-F.col("pos")).alias("first")))
    gold = F.max((F.col("cand") == F.col("gold")).cast("int")) == 1 if "gold" in df.columns else F.lit(None).cast("boolean")
    return last.groupBy(*by).agg(top.alias("winner"), (F.max("reads") + 1).alias("reads"), gold.alias("gold_in_final"))


def dealt_groups(df: DataFrame, by: list[str], groups: int, k: int | None = None, fillers: int = 0, filler_from: int = 50) -> DataFrame:
    """The ``k`` best candidates (all without ``k``) by rank, dealt round-robin, and ``fillers`` more for each group dealt alike
    from the rank after ``filler_from``: adds g and whether the candidate wins its group."""
    r = ranked(df, by)
    kept = F.lit(True) if k is None else (F.col("rank") <= k) | ((F.col("rank") > filler_from) & (F.col("rank") <= filler_from + groups * fillers))
    r = r.where(kept).withColumn("g", (F.when(F.col("rank") > filler_from, F.col("rank") - filler_from).otherwise(F.col("rank")) - 1) % groups if k is not None else (F.col("rank") - 1) % groups)
    return r.withColumn("wins", F.row_number().over(Window.partitionBy(*by, "g").orderBy(F.desc("score"), "cand")) == 1)


def loss_diagnosis(gold_rank: Column, k: int, won_group: Column, correct: Column) -> Column:
    """Where a query was lost."""
    return F.when(correct, "correct").when(gold_rank > k, "not_shortlisted").when(~won_group, "lost_in_group").otherwise("lost_in_final")


def gold_reads(dealt: DataFrame, by: list[str], correct: DataFrame, k: int = 10) -> DataFrame:
    """by, n, size, look and lost of the reads in which a query's gold took part: its group (0) and, where it won that, the final
    of the groups' winners (1). look: members among the ``k`` best of the whole ranking other than the gold; lost: the query
    is wrong and this is the gold's last read. dealt: by, cand, gold, rank, g and wins; correct: by, correct."""
    own = dealt.where("cand = gold").select(*by, F.col("g").alias("_g"), F.col("wins").alias("_won"))
    x = dealt.join(own, by)
    n = F.explode(F.filter(F.array(F.when(F.col("g") == F.col("_g"), 0), F.when(F.col("wins") & F.col("_won"), 1)), lambda v: v.isNotNull())).alias("n")
    alike = ((F.col("rank") <= k) & (F.col("cand") != F.col("gold"))).cast("long")
    x = x.select(*by, n, "_won", alike.alias("_alike")).groupBy(*by, "n").agg(F.count("*").alias("size"), F.sum("_alike").alias("look"), F.max("_won").alias("_won"))
    last = F.col("n") == F.col("_won").cast("int")
    return x.join(correct, by).select(*by, "n", "size", "look", (last & ~F.col("correct")).alias("lost"))


def read_difficulty(reads: DataFrame, by: list[str], queries: Column) -> DataFrame:
    """by, look-alikes in the gold's group and in its final, reads with a look-alike for each query, and the share of reads with,
    and without, a look-alike in which the gold was lost; null where there is no such read. queries: how many there are."""
    hard = F.col("look") > 0
    lost = F.col("lost").cast("double")
    return reads.groupBy(*by).agg(
        F.avg(F.when(F.col("n") == 0, F.col("look"))).alias("look_in_group"), F.avg(F.when(F.col("n") == 1, F.col("look"))).alias("look_in_final"),
        (F.sum(hard.cast("long")) / queries).alias("hard_reads"), F.avg(F.when(hard, lost)).alias("lost_hard"), F.avg(F.when(~hard, lost)).alias("lost_easy"),
    )


def bigram_codes(text: str | None) -> np.ndarray:
    """The character bigrams of a text without white space, as numbers of two code points."""
    code = np.frombuffer(re.sub(r"\s", "", text or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return code[:-1] << 21 | code[1:]


def _query_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        grams = [np.unique(bigram_codes(t)) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(grams, pa.list_(pa.int64()))], ["qid", "grams"])


def _document_counts(known: np.ndarray):
    """n, the bigrams of all texts, and how many texts hold each of the ``known`` ones: one row a partition."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, length, df = 0, 0, np.zeros(len(known), np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                g = bigram_codes(t)
                n, length, g = n + 1, length + len(g), np.unique(g)
                at = np.minimum(np.searchsorted(known, g), max(len(known) - 1, 0))
                if len(known):
                    df[at[known[at] == g]] += 1
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([length]), pa.array([df], pa.list_(pa.int64()))], ["n", "length", "df"])

    return count


def _best_texts(weights: np.ndarray, known: np.ndarray, qids: pa.Array, avg: float, k: int, k1: float, b: float):
    """Each query's ``k`` best texts of a partition: texts by bigrams times bigrams by queries, some hundred texts at a time."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, min(512, 4_000_000 // (len(known) + 1)))
        top, who = np.zeros((len(qids), k)), np.full((len(qids), k), np.iinfo(np.int64).max)
        for whole in batches:
            for begin in range(0, whole.num_rows, step):
                part = whole.slice(begin, step)
                tf = np.zeros((part.num_rows, len(known)))
                for i, t in enumerate(part.column(1).to_pylist()):
                    g = bigram_codes(t)
                    length = len(g)
                    g, n = np.unique(g, return_counts=True)
                    at = np.minimum(np.searchsorted(known, g), len(known) - 1)
                    on = known[at] == g
                    tf[i, at[on]] = n[on] * (k1 + 1) / (n[on] + k1 * (1 - b + b * length / avg))
                score = np.hstack([top, np.round(tf @ weights, 9).T])
                pid = np.hstack([who, np.broadcast_to(part.column(0).to_numpy(), (len(qids), part.num_rows))])
                order = np.lexsort((pid, -score), axis=1)[:, :k]
                top, who = np.take_along_axis(score, order, 1), np.take_along_axis(pid, order, 1)
        q, at = np.nonzero(top > 0)
        yield pa.RecordBatch.from_arrays([qids.take(pa.array(q)), pa.array(who[q, at]), pa.array(top[q, at])], ["qid", "pid", "score"])

    return best


def bm25(queries: DataFrame, corpus: DataFrame, k: int, k1: float = 1.2, b: float = 0.75, most: int = 200) -> DataFrame:
    """qid, pid, score of the ``k`` best texts of each query that share a character bigram with it, ties by pid. queries: qid,
    text; corpus: pid (a long), text. A query's bigrams are a set.

    Queries go in blocks of about ``most``. A block takes two passes over the corpus: one counts the texts that hold its
    bigrams, one number a bigram and partition; the other multiplies texts with the queries' weights and keeps each
    partition's best. So neither bigrams nor pairs of query and text become rows, however common a bigram is.
    """
    empty = queries.where("false").select("qid", F.lit(0).cast("long").alias("pid"), F.lit(0.0).alias("score"))
    kind = queries.schema["qid"]
    blocks, out = -(-queries.count() // most), empty
    texts = corpus.select(F.col("pid").cast("long").alias("pid"), "text")
    for i in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i).select("qid", "text")
        rows = own.mapInArrow(_query_grams, f"qid {kind.dataType.simpleString()}, grams array<bigint>").collect()  # bounded by the block
        known = np.unique(np.concatenate([np.zeros(0, np.int64), *(np.array(r["grams"], np.int64) for r in rows)]))
        counts = texts.select("text").mapInArrow(_document_counts(known), "n long, length long, df array<bigint>").collect()  # a row a partition
        n, df = sum(r["n"] for r in counts), sum((np.array(r["df"], np.int64) for r in counts), np.zeros(len(known), np.int64))
        if not n or not len(known):
            continue
        weights = np.zeros((len(known), len(rows)))
        for j, r in enumerate(rows):
            at = np.searchsorted(known, r["grams"])
            weights[at, j] = np.log(1 + (n - df[at] + 0.5) / (df[at] + 0.5))
        qids = pa.array([r["qid"] for r in rows], to_arrow_type(kind.dataType))
        found = texts.mapInArrow(_best_texts(weights, known, qids, sum(r["length"] for r in counts) / n, k, k1, b), f"qid {kind.dataType.simpleString()}, pid long, score double")
        out = out.unionByName(found)
    best = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "pid"))
    return out.withColumn("best", best).where(F.col("best") <= k).drop("best")


def linear_arm(rows: DataFrame, key: str, c: float = 1.0) -> DataFrame:
    """key, gold and said of the rows that aren't ``train``: a logistic regression on the vectors ``x``, learned from all train
    rows. rows: key, x, gold (int), train."""
    from .calibrate import logistic_problem
    from .fit import fit_linear

    train = rows.where("train and gold is not null and x is not null").select(F.lit("all").alias("task"), "gold", F.col("x").cast("array<double>").alias("x"))
    test = rows.where("not train").select(key, "gold", "x")
    seen = [tuple(r) for r in train.select("gold", F.size("x")).distinct().collect()]  # a row a class
    if not seen:
        return test.select(key, "gold", F.lit(None).cast("int").alias("said"))
    classes, d = np.array(sorted({g for g, _ in seen}), np.int32), seen[0][1]
    w, b = np.zeros((1, d)), np.zeros(1)
    if len(classes) > 1:
        problem = logistic_problem("all", classes.tolist(), d, c)
        (v,) = fit_linear(settled(train, "train"), [problem])
        w, b = v[: problem.k * d].reshape(problem.k, d), v[problem.k * d :]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.stack(batch.column(2).to_pylist()).astype(float)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(classes[(x @ w.T + b).argmax(1)], pa.int32())], [key, "gold", "said"])

    kind = dict(rows.dtypes)
    return test.select(key, F.col("gold").cast("int").alias("gold"), "x").mapInArrow(judge, f"{key} {kind[key]}, gold int, said int")
