"""A gate of detectors over windows: areas of every detector, label and condition in one pass, windows joined by overlapping
time, and the gates' verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .running import unit_bucket

#: Least areas and precision of the gates, the most noise under which one is judged, the least gain, and the area
#: below which two judges together end the matter.
LEAST_FIRST, LEAST_PRECISION, LEAST_SECOND, MOST_NOISE, LEAST_PLAIN, LEAST_GAIN, HOPELESS = 0.85, 0.60, 0.75, 0.20, 0.75, 0.05, 0.70


def areas(rows: DataFrame, by: list[str], detectors: list[str], labels: list[str], condition: str, bucket: Column | None = None) -> DataFrame:
    """by, detector, whole, condition, label, n, positives and auroc, over all rows (``whole``, condition null) and for each
    condition. Rows with a null or undefined score don't count for that detector, nor do null labels count as positive; an area
    is null where a class is missing.

    Every row goes out once a detector, with its labels as counts beside it, and rows of equal score are added up before they
    are shuffled; ranks are shared by all labels, and what is left of a bucket is a row of sums a condition, from which the places
    before it follow. ``bucket`` is as in ``running_totals``.
    """
    ys = [f"y_{c}" for c in labels]
    each = F.explode(F.array(*(F.struct(F.lit(x).alias("detector"), F.col(x).cast("double").alias("score")) for x in detectors)))
    # a condition may be null; a marker stands for it
    marker = F.when(F.col(condition).isNotNull(), F.concat(F.lit("="), F.col(condition).cast("string"))).otherwise("")
    x = rows.select(*by, marker.alias("condition"), *(F.coalesce(F.col(c).cast("boolean"), F.lit(False)).cast("long").alias(y) for c, y in zip(labels, ys)), each.alias("d"))
    x = x.select(*by, "d.detector", "condition", "d.score", *ys).where("score is not null and not isnan(score)")
    x = x.withColumn("_bucket", unit_bucket("score") if bucket is None else bucket)
    part = ["_bucket", *by, "detector"]  # buckets first: they tell most rows apart when these are sorted
    one = x.groupBy(*part, "condition", "score").agg(F.count("*").alias("n"), *(F.sum(y).alias(y) for y in ys)).repartition(*part)
    run = F.sum("n").over(Window.partitionBy(*part, "condition").orderBy("score").rowsBetween(Window.unboundedPreceding, 0))

    def summed(x: DataFrame, whole: bool) -> DataFrame:
        x = x.withColumn("_rank", run - (F.col("n") - 1) / 2.0).groupBy(*part, "condition")
        return x.agg(F.lit(whole).alias("whole"), F.sum("n").alias("n"), *(F.sum(y).alias(y) for y in ys), *(F.sum(F.col("_rank") * F.col(y)).alias(f"r_{y}") for y in ys))

    # an empty text that is taken from the condition, so that both branches read the same columns and share the shuffle
    merged = one.groupBy(*part, "score").agg(F.substring(F.max("condition"), 1, 0).alias("condition"), *(F.sum(c).alias(c) for c in ("n", *ys)))
    sums, group = summed(merged, True).unionByName(summed(one, False)), [*by, "detector", "whole", "condition"]
    before = F.sum("n").over(Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.withColumn("_before", F.coalesce(before, F.lit(0)).cast("double"))
    one = sums.groupBy(*group).agg(F.sum("n").alias("n"), *(F.sum(y).alias(f"n_{c}") for c, y in zip(labels, ys)), *(F.sum(F.col("_before") * F.col(y) + F.col(f"r_{y}")).alias(f"r_{c}") for c, y in zip(labels, ys)))
    label = F.explode(F.array(*(F.struct(F.lit(c).alias("label"), F.col(f"n_{c}").alias("positives"), F.col(f"r_{c}").alias("ranks")) for c in labels))).alias("l")
    one = one.select(*by, "detector", "whole", F.when(F.col("condition") != "", F.substring("condition", 2, 1 << 30)).alias("condition"), "n", label).select(*by, "detector", "whole", "condition", "n", "l.*")
    pairs = (F.col("positives") * (F.col("n") - F.col("positives"))).cast("double")
    area = F.when(pairs > 0, (F.col("ranks") - F.col("positives") * (F.col("positives") + 1) / 2.0) / pairs)
    return one.select(*by, "detector", "whole", "condition", "label", "n", "positives", area.alias("auroc"))


def verdicts(found: DataFrame, by: list[str], first: str, second: str, plain: str, judge: str, other: str, large: str, precision: DataFrame, noise: DataFrame) -> DataFrame:
    """by and the gates of ``found`` (``areas``): first_ok (the judge finds ``first`` well and precisely), second_judged and
    second_ok (``second``, judged where the noise floor is low), plain_ok (the ``plain`` detector alone would do), worth_adding
    (the judge's gain over it), other_ok (the gain of ``other`` over the judge on both labels), and hopeless (the judge and
    the ``large`` one both fail). precision: by, precision; noise: by, noise. A gate whose area is missing isn't passed."""
    at = lambda d, label: F.max(F.when((F.col("detector") == d) & (F.col("label") == label), F.col("auroc")))
    named = {f"{d}_{k}": at(d, label) for d in dict.fromkeys((plain, judge, other, large)) for k, label in (("first", first), ("second", second))}
    x = found.where("whole").groupBy(*by).agg(*(c.alias(k) for k, c in named.items())).join(precision, by).join(noise, by)
    a = lambda d, k: F.round(F.col(f"{d}_{k}"), 12)
    yes = lambda c: F.coalesce(c, F.lit(False))
    gain = lambda d, e, k: F.round(a(d, k) - a(e, k), 12)
    judged = F.col("noise") <= MOST_NOISE
    return x.select(
        *by, yes((a(judge, "first") >= LEAST_FIRST) & (F.col("precision") >= LEAST_PRECISION)).alias("first_ok"), judged.alias("second_judged"), F.when(judged, yes(a(judge, "second") >= LEAST_SECOND)).alias("second_ok"),
        yes(a(plain, "first") >= LEAST_PLAIN).alias("plain_ok"), gain(judge, plain, "first").alias("gain_first"), gain(judge, plain, "second").alias("gain_second"), yes(gain(judge, plain, "first") >= LEAST_GAIN).alias("worth_adding"),
        yes((gain(other, judge, "first") >= LEAST_GAIN) & (gain(other, judge, "second") >= LEAST_GAIN)).alias("other_ok"), yes((a(judge, "first") < HOPELESS) & (a(large, "first") < HOPELESS)).alias("hopeless"),
    )


def overlaps(left: DataFrame, right: DataFrame, by: list[str], start: str, end: str, width: float, suffix: str = "_r") -> DataFrame:
    """Pairs of windows of equal ``by`` whose times [start, end) overlap: the left columns, the right ones with ``suffix``, and
    ``overlap``, how long. Windows without length, or with a null time, overlap nothing.

    A window stands in every slot of ``width`` that it touches, and a pair is kept in the first slot that both touch, so the
    join is by equality and no pair comes twice; a width near the windows' length keeps the slots few.
    """
    slot = lambda c: F.floor(F.col(c).cast("double") / width)
    last = F.ceil(F.col(end).cast("double") / width) - 1
    put = lambda df: df.where(F.col(start) < F.col(end)).withColumns({"_first": slot(start), "_slot": F.explode(F.sequence(slot(start), F.greatest(last, slot(start))))})
    named = put(right).select(*(F.col(c).alias(f"{c}{suffix}") for c in right.columns), F.col("_first").alias("_first_r"), F.col("_slot").alias("_slot_r"))
    same = [F.col(c) == F.col(f"{c}{suffix}") for c in by]
    x = put(left).join(named, [*same, F.col("_slot") == F.col("_slot_r")])
    long = F.least(F.col(end), F.col(f"{end}{suffix}")) - F.greatest(F.col(start), F.col(f"{start}{suffix}"))
    x = x.where((F.col("_slot") == F.greatest("_first", "_first_r")) & (long > 0))
    return x.select(*left.columns, *(f"{c}{suffix}" for c in right.columns if c not in by), long.cast("double").alias("overlap"))
