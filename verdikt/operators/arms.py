"""All arms of a test beside one another: pairwise agreement, a backend's guardrail and the stability of reruns.

Rows are gathered once by item, as one vector of every arm's answer; each partition then adds up an arms x arms table of counts,
so no pair of arms is a join of its own. An item that an arm lacks doesn't count in that arm's pairs.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import settled
from .metrics import auroc
from .paired import mcnemar_p

#: How far accuracy and AUROC may fall, the least p value; the least agreement, and from where on an answer is sure.
MOST_DIFFERENCE, MOST_AUROC_LOSS, LEAST_P = 0.02, 0.05, 0.05
LEAST_AGREEMENT, SURE = 0.995, 0.9


def item_vectors(rows: DataFrame, by: list[str], arms: list[str], row_id: str = "id") -> DataFrame:
    """by, id and a column ``arm_<k>`` (chosen, correct, conf; null where the arm has no such row) for each arm. Of rows that
    repeat an id in an arm the greatest counts."""
    one = F.struct("chosen", "correct", "conf")
    return rows.where(F.col("arm").isin(arms)).groupBy(*by, row_id).agg(*(F.max(F.when(F.col("arm") == a, one)).alias(f"arm_{k}") for k, a in enumerate(arms)))


def pairwise(vectors: DataFrame, by: list[str], arms: list[str], sure: float = SURE) -> DataFrame:
    """by, a, b, n, same, flips, sure_flips (by a's confidence), only_a, only_b (right in one arm alone), right_a and right_b of
    every pair of arms that share an item. Two missing answers agree."""
    n = lambda c: F.coalesce(c, F.lit(False)).cast("long")

    def counts(i: int, j: int):
        x, y = F.col(f"arm_{i}"), F.col(f"arm_{j}")
        same = x["chosen"].eqNullSafe(y["chosen"])
        fields = {"same": n(same), "flips": n(~same), "sure_flips": n(~same & (x["conf"] > sure)), "only_a": n(x["correct"] & ~n(y["correct"]).cast("boolean")), "only_b": n(y["correct"] & ~n(x["correct"]).cast("boolean")), "right_a": n(x["correct"]), "right_b": n(y["correct"])}
        return F.when(x.isNotNull() & y.isNotNull(), F.struct(F.lit(arms[i]).alias("a"), F.lit(arms[j]).alias("b"), *(c.alias(k) for k, c in fields.items())))

    each = F.explode(F.array_compact(F.array(*(counts(i, j) for i, j in combinations(range(len(arms)), 2))))).alias("x")
    names = ("same", "flips", "sure_flips", "only_a", "only_b", "right_a", "right_b")
    return vectors.select(*by, each).groupBy(*by, "x.a", "x.b").agg(F.count("*").alias("n"), *(F.sum(f"x.{c}").alias(c) for c in names))


def guardrail(rows: DataFrame, by: list[str], base: str, new: str, others: list[str] = ()) -> DataFrame:
    """by, n, the accuracy of every arm, the gap of ``new`` to ``base``, McNemar's p, both AUROCs of the confidence, and ok: the gap
    within two points, no significant difference, and no AUROC lost beyond five points where both are defined. Items are
    those that all arms have, ``others`` too where they have any row of the group."""
    arms = [base, new, *others]
    v = settled(item_vectors(rows, by, arms).drop("id"), "vectors")  # counts, accuracies and areas all read them
    has = v.groupBy(*by).agg(*(F.max(F.col(f"arm_{k}").isNotNull()).alias(f"_has_{k}") for k in range(2, len(arms))), F.lit(1).alias("_one"))
    v = v.join(F.broadcast(has), by)  # a row a group
    there = [F.col("arm_0").isNotNull(), F.col("arm_1").isNotNull(), *(F.col(f"arm_{k}").isNotNull() | ~F.col(f"_has_{k}") for k in range(2, len(arms)))]
    v = v.where(reduce(lambda x, y: x & y, there))
    pairs = pairwise(v, by, [base, new]).select(*by, "n", "only_a", "only_b")
    accuracy = v.groupBy(*by).agg(*(F.avg(F.col(f"arm_{k}.correct").cast("double")).alias(f"accuracy_{a}") for k, a in enumerate(arms)))
    long = v.select(*by, F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"arm_{k}.correct").alias("correct"), F.round(f"arm_{k}.conf", 12).alias("conf")) for k in (0, 1)))).alias("x")).select(*by, "x.*")
    areas = auroc(long, [*by, "k"], "conf", F.col("correct"))
    areas = areas.groupBy(*by).agg(F.max(F.when(F.col("k") == 0, F.col("auroc"))).alias(f"auroc_{base}"), F.max(F.when(F.col("k") == 1, F.col("auroc"))).alias(f"auroc_{new}"))
    out = pairs.join(accuracy, by).join(areas, by).withColumn("p_value", mcnemar_p(F.col("only_a"), F.col("only_b")))
    gap = F.col(f"accuracy_{new}") - F.col(f"accuracy_{base}")
    lost = F.coalesce(F.col(f"auroc_{new}") >= F.col(f"auroc_{base}") - MOST_AUROC_LOSS, F.lit(True))
    ok = (F.round(F.abs(gap), 12) <= MOST_DIFFERENCE) & (F.col("p_value") >= LEAST_P) & lost
    return out.drop("only_a", "only_b").withColumns({"gap": gap, "ok": ok})


def stability(vectors: DataFrame, by: str, arms: list[str]) -> DataFrame:
    """by, a, b, n, agreement, flips, sure_flips and stable of every pair of runs, for each group and, as group null, for all:
    stable if at least 99.5 % of the answers agree and no flipped answer was sure."""
    each = pairwise(vectors, [by], arms)
    names = ("n", "same", "flips", "sure_flips")
    all_ = each.groupBy("a", "b").agg(*(F.sum(c).alias(c) for c in names)).withColumn(by, F.lit(None).cast(dict(each.dtypes)[by]))
    out = each.select(by, "a", "b", *names).unionByName(all_)
    agreement = F.col("same") / F.col("n")
    return out.select(by, "a", "b", "n", agreement.alias("agreement"), "flips", "sure_flips", ((agreement >= LEAST_AGREEMENT) & (F.col("sure_flips") == 0)).alias("stable"))
