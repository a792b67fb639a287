"""Paired comparison of two arms over the same rows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as E
from .running import percentiles, unit_bucket


def pair(rows: DataFrame, a: str, b: str, keys: list[str], values: list[str]) -> DataFrame:
    """keys, and each value as <value>_a and <value>_b, of the rows that both arms have."""
    side = lambda arm, s: rows.where(F.col("arm") == arm).select(*keys, *(F.col(v).alias(f"{v}_{s}") for v in values))
    return side(a, "a").join(side(b, "b"), keys)


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x >= 1, to about 12 digits: Stirling's series eight places further on."""
    y = x + 8.0
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    shift = sum((F.log(x + i) for i in range(1, 8)), F.log(x))
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - shift


def mcnemar_p(only_a: Column, only_b: Column) -> Column:
    """Exact two-sided p of the discordant counts: twice the binomial tail, added up from its greatest term down. Terms fall
    off within some standard deviations, so the sum takes in the order of sqrt(n) steps, however many pairs there are."""
    n, k = (only_a + only_b).cast("double"), F.least(only_a, only_b).cast("double")
    first = log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) - n * math.log(2.0)
    steps = F.least(k, F.ceil(12 * F.sqrt(n)) + 40).cast("int")

    def step(acc, i):
        term = acc["term"] * (k - i + 1) / (n - k + i)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    one = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    tail = F.aggregate(F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>")), one, step, lambda acc: acc["sum"])
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2.0 * F.exp(first) * tail))


def mcnemar(pairs: DataFrame, by: list[str]) -> DataFrame:
    """by, n, only_a, only_b and p from correct_a and correct_b."""
    n = lambda c: F.sum(c.cast("long"))
    s = pairs.groupBy(*by).agg(F.count("*").alias("n"), n(F.col("correct_a") & ~F.col("correct_b")).alias("only_a"), n(F.col("correct_b") & ~F.col("correct_a")).alias("only_b"))
    return s.withColumn("p_value", mcnemar_p(F.col("only_a"), F.col("only_b")))


def flips(pairs: DataFrame, by: list[str]) -> DataFrame:
    return pairs.groupBy(*by).agg(F.avg((F.col("chosen_a") == F.col("chosen_b")).cast("double")).alias("agreement"), F.sum((F.col("chosen_a") != F.col("chosen_b")).cast("long")).alias("flips"))


def equivalence(pairs: DataFrame, by: list[str]) -> DataFrame:
    """How far the two arms' probabilities lie apart at most, by row: greatest, mean, median and 99th percentile."""
    d = pairs.withColumn("d", E.max_abs_difference("p_a", "p_b"))
    out = d.groupBy(*by).agg(F.max("d").alias("max_diff"), F.avg("d").alias("mean_diff"))
    return out.join(percentiles(d, by, "d", {"median_diff": 0.5, "p99_diff": 0.99}, unit_bucket("_v")), by)


def mean_gap(rows: DataFrame, by: list[str], gap: Column) -> DataFrame:
    """Mean of a gap with 1.96 standard errors, from the population deviation."""
    s = rows.groupBy(*by).agg(F.avg(gap).alias("mean"), F.stddev_pop(gap).alias("sd"), F.count(gap).alias("n"))
    half = 1.96 * F.col("sd") / F.sqrt(F.col("n").cast("double"))
    return s.select(*by, "mean", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    n, p = n.cast("double"), hits / n
    mid, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (mid - half) / (1 + z * z / n), (mid + half) / (1 + z * z / n)


#: The Poisson(1) distribution function at 0 to 6.
POISSON = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676)


def poisson_weights(hashes: np.ndarray, draw: int) -> np.ndarray:
    """A Poisson(1) number for each 64-bit hash and a draw, the same wherever the row is computed."""
    x = hashes.view(np.uint64) + np.uint64((draw + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    u = (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)
    return sum((u >= s).astype(np.float64) for s in POISSON)


def poisson_bootstrap(rows: DataFrame, by: list[str], value: Column, draws: int = 1000, level: float = 0.95) -> DataFrame:
    """Percentile interval of a mean: each row weighs in each draw by a Poisson(1) number from a hash of its id. A partition
    adds up all draws of its rows, so what is shuffled is one number a group, draw and partition."""
    keyed = rows.select(*by, F.to_json(F.struct(*by)).alias("_key"), value.cast("double").alias("_v"), F.xxhash64("id").alias("_h"))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for b in batches:
            codes, keys = pd.factorize(b.column(0).to_pandas())
            v, h = b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            for c, key in enumerate(keys):
                at = np.flatnonzero((codes == c) & ~np.isnan(v))
                own = held.setdefault(key, np.zeros((2, draws)))
                for d in range(draws if len(at) else 0):
                    w = poisson_weights(h[at], d)
                    own[0, d] += w @ v[at]
                    own[1, d] += w.sum()
        for key, own in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([key] * draws), pa.array(np.arange(draws, dtype=np.int32)), pa.array(own[0]), pa.array(own[1])], ["_key", "draw", "s", "w"])

    sums = keyed.select("_key", "_v", "_h").mapInArrow(add_up, "_key string, draw int, s double, w double").groupBy("_key", "draw").agg((F.sum("s") / F.sum("w")).alias("m"))
    tail = (1 - level) / 2
    ends = sums.groupBy("_key").agg(F.percentile("m", F.lit(tail)).alias("low"), F.percentile("m", F.lit(1 - tail)).alias("high"))
    names = keyed.groupBy("_key").agg(*(F.first(c).alias(c) for c in by))
    return names.join(ends, "_key").select(*by, "low", "high")
