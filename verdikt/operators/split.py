"""Calibration/test splits by group, and folds."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .running import hash_cut, hash_ranks, under_cut


def group_split(df: DataFrame, seed: int = 0, by: str = "task", group: str = "group_id") -> DataFrame:
    """Adds cal: the first half of each task's groups, in the order of a hash, are for calibration. Rows are compared with
    their task's last group of the half, and not shuffled."""
    digest = F.md5(F.concat(F.col(group), F.lit(f":{seed}")).cast("binary"))
    cuts = hash_cut(df, [by], group, digest)
    own = df.withColumn("_digest", digest).join(cuts, by, "left").withColumn("cal", under_cut(F.col("_digest"), F.col(group)))
    return own.select(by, group, *(c for c in df.columns if c not in (by, group)), "cal")


def group_split_parity(df: DataFrame, seed: int = 0, group: str = "group_id") -> DataFrame:
    """The same with Python's Mersenne twister over the sorted distinct groups of one task. The groups come to the driver:
    for small tables whose split must equal a stored one; ``group_split`` is the way for large ones."""
    groups = sorted(r[0] for r in df.select(group).distinct().collect())
    random.Random(seed).shuffle(groups)
    cal = df.sparkSession.createDataFrame([(g, k < len(groups) // 2) for k, g in enumerate(groups)], f"{group} string, cal boolean")
    return df.join(cal, group)


def grouped_folds(df: DataFrame, k: int, seed: int = 0, by: str = "task", group: str = "group_id") -> DataFrame:
    """Adds fold 0 to k - 1, the same for all rows of a group, from a hash; no shuffle."""
    h = F.conv(F.substring(F.md5(F.concat(F.col(group), F.lit(f":{seed}")).cast("binary")), 1, 8), 16, 10).cast("long")
    return df.withColumn("fold", (h % k).cast("int"))


def even_folds(df: DataFrame, k: int, seed: int = 0, by: str = "task", group: str = "group_id") -> DataFrame:
    """Adds fold 0 to k - 1: each task's groups in the order of a hash, dealt in turn, so that folds differ by one group."""
    digest = F.md5(F.concat(F.col(group), F.lit(f":{seed}")).cast("binary"))
    ranks = hash_ranks(df, [by], group, digest)
    return df.join(ranks.select(by, group, ((F.col("rank") - 1) % k).cast("int").alias("fold")), [by, group])


def leave_one_out_folds(df: DataFrame, segment: str, segments: list[str]) -> DataFrame:
    """Every row once for each segment as fold, with is_train false in its own."""
    return df.withColumn("fold", F.explode(F.array(*map(F.lit, segments)))).withColumn("is_train", F.col(segment) != F.col("fold"))
