"""Metrics of decision rows. ``rows`` have the grouping columns, p (array of probabilities), gold, chosen, conf, correct."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as E
from ..sources.shared import settled
from . import running
from .running import log_bucket, order_statistics, running_totals, unit_bucket


def with_probs(df: DataFrame, temperature: Column | float = 1.0, k: int | None = None) -> DataFrame:
    """Adds p, conf, chosen and correct. With columns z0 to z(k-1) the softmax stays in generated code."""
    p = F.array(*E.softmax_columns([F.col(f"z{j}") for j in range(k)], temperature)) if k else E.softmax("logits", temperature)
    return df.withColumn("p", p).withColumns({"conf": E.top_prob("p"), "chosen": E.argmax("p")}).withColumn("correct", E.correct("chosen", "gold"))


def _rows_of(n: str | None) -> Column:
    """How many rows a group has, where ``n`` names a column of how many each row stands for."""
    return F.sum(n) if n else F.count("*")


def _mean(value: Column, n: str | None) -> Column:
    return F.sum(value * F.col(n)) / F.sum(n) if n else F.avg(value)


def accuracy(rows: DataFrame, by: list[str], n: str | None = None) -> DataFrame:
    return rows.groupBy(*by).agg(_rows_of(n).alias("n"), _mean(F.col("correct").cast("double"), n).alias("accuracy"))


def confusion(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    """Counts for each gold and chosen option, zeros included."""
    counts = rows.groupBy(*by, "gold", "chosen").agg(F.count("*").alias("n"))
    cells = rows.select(*by).distinct().withColumn("gold", F.explode(F.array(*map(F.lit, range(k))))).withColumn("chosen", F.explode(F.array(*map(F.lit, range(k)))))
    return cells.join(counts, [*by, "gold", "chosen"], "left").fillna(0, ["n"])


def macro_f1(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    """Mean F1 of the classes that occur as gold or chosen; a class without true positives has 0."""
    c = confusion(rows, by, k)
    true = c.groupBy(*by, F.col("gold").alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("gold") == F.col("chosen"), F.col("n")).otherwise(0)).alias("tp"))
    said = c.groupBy(*by, F.col("chosen").alias("class")).agg(F.sum("n").alias("said"))
    f1 = 2.0 * F.col("tp") / (F.col("support") + F.col("said"))
    return true.join(said, [*by, "class"]).where("support + said > 0").groupBy(*by).agg(F.avg(f1).alias("macro_f1"))


def bin_index(conf: Column | str, bins: int = 10, exact: bool = False) -> Column:
    """Index of the bin (lo, hi] that holds a value of [0, 1]; the first bin holds 0 too. Edges are multiples of the bin
    width in floating point, or quotients with ``exact``."""
    conf = F.col(conf) if isinstance(conf, str) else conf
    edges = [i / bins if exact else i * (1 / bins) for i in range(1, bins)]
    return sum((F.when(conf > e, 1).otherwise(0) for e in edges), F.lit(0))


def ece(rows: DataFrame, by: list[str], bins: int = 10, exact: bool = False, n: str | None = None) -> DataFrame:
    """Expected calibration error of the top option."""
    b = rows.groupBy(*by, bin_index("conf", bins, exact).alias("bin")).agg(_rows_of(n).alias("n"), _mean(F.col("conf"), n).alias("conf"), _mean(F.col("correct").cast("double"), n).alias("acc"))
    return b.groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("conf") - F.col("acc"))) / F.sum("n")).alias("ece"))


def classwise_ece(rows: DataFrame, by: list[str], bins: int = 10, n: str | None = None) -> DataFrame:
    """The mean over options of the calibration error of each option's probability."""
    x = rows.select(*by, "gold", *([n] if n else []), F.posexplode("p").alias("option", "conf")).withColumn("correct", F.col("gold") == F.col("option"))
    return ece(x, [*by, "option"], bins, n=n).groupBy(*by).agg(F.avg("ece").alias("classwise_ece"))


def reliability(rows: DataFrame, by: list[str], bins: int = 5) -> DataFrame:
    """Bins [lo, hi) of equal width; the last one holds 1."""
    b = F.least(F.floor(F.col("conf") * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(*by, b.alias("bin")).agg(F.count("*").alias("n"), F.avg("conf").alias("mean_conf"), F.avg(F.col("correct").cast("double")).alias("accuracy"))


def losses(rows: DataFrame, by: list[str], n: str | None = None) -> DataFrame:
    return rows.groupBy(*by).agg(_mean(E.brier("p", "gold"), n).alias("brier"), _mean(E.nll("p", "gold"), n).alias("nll"))


def auroc(rows: DataFrame, by: list[str], score: str, positive: Column, bucket: Column | None = None) -> DataFrame:
    """Rank-sum AUROC with ties shared; null where only one class occurs. ``bucket`` as in ``running_totals``."""
    x = rows.select(*by, F.col(score).alias("score"), positive.cast("long").alias("pos")).withColumn("n", F.lit(1).cast("long"))
    run = running_totals(x, by, "score", ["n", "pos"], unit_bucket("score") if bucket is None else bucket)
    ranked = run.withColumn("rank", F.col("run_n") - (F.col("n") - 1) / 2.0)
    s = ranked.groupBy(*by).agg(F.sum(F.col("rank") * F.col("pos")).alias("ranks"), F.sum("pos").alias("n1"), F.sum("n").alias("n"))
    pairs = (F.col("n1") * (F.col("n") - F.col("n1"))).cast("double")
    return s.select(*by, F.when(pairs > 0, (F.col("ranks") - F.col("n1") * (F.col("n1") + 1) / 2.0) / pairs).alias("auroc"))


def sorted_auroc(rows: DataFrame, by: list[str], score: str, positive: Column) -> DataFrame:
    """As ``auroc``, for scores that hardly repeat: rows are sorted by ranges once, instead of adding up equal ones and then
    dealing them by buckets. Rows are read twice, so they should be cheap to make; a null score or group doesn't count."""
    x = rows.select(*by, F.col(score).alias("score"), positive.cast("long").alias("pos")).dropna(subset=[*by, "score"])
    order, n = [*by, "score"], int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = x.repartitionByRange(n, *order).sortWithinPartitions(*order)
    x = x.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    ties = x.groupBy("_part", *order).agg(F.min("_at").alias("_lo"), F.max("_at").alias("_hi"), F.sum("pos").alias("pos"))  # in their range
    parts = ties.groupBy("_part", *by).agg(F.min("_lo").alias("_first"), F.sum(F.col("_hi") - F.col("_lo") + 1).alias("n"), F.sum("pos").alias("n1"), F.sum((F.col("_lo") + F.col("_hi")) / 2.0 * F.col("pos")).alias("_ranks"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("_ranks", F.col("_ranks") + F.col("n1") * (before - F.col("_first") + 1.0))
    s = parts.groupBy(*by).agg(F.sum("_ranks").alias("ranks"), F.sum("n1").alias("n1"), F.sum("n").alias("n"))
    pairs = (F.col("n1") * (F.col("n") - F.col("n1"))).cast("double")
    return s.select(*by, F.when(pairs > 0, (F.col("ranks") - F.col("n1") * (F.col("n1") + 1) / 2.0) / pairs).alias("auroc"))


def ovr_auroc(rows: DataFrame, by: list[str]) -> DataFrame:
    """One-versus-rest AUROC, averaged over the options for which it is defined."""
    x = rows.select(*by, "gold", F.posexplode("p").alias("option", "score"))
    return auroc(x, [*by, "option"], "score", F.col("gold") == F.col("option")).groupBy(*by).agg(F.avg("auroc").alias("ovr_auroc"))


def top2(rows: DataFrame, by: list[str]) -> DataFrame:
    """Share of rows whose gold option is among the two likeliest; at ties lower options come first."""
    mine = F.get("p", F.col("gold"))
    better = F.size(F.filter(F.transform("p", lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: (s["x"] > mine) | ((s["x"] == mine) & (s["i"] < F.col("gold")))))
    return rows.groupBy(*by).agg(F.avg((better < 2).cast("double")).alias("top2"))


def selective(rows: DataFrame, by: list[str], cuts: list[float]) -> DataFrame:
    """Accuracy and coverage of the rows with conf >= cut; null accuracy where none is."""
    x = rows.withColumn("cut", F.explode(F.array(*map(F.lit, cuts))))
    on = F.col("conf") >= F.col("cut")
    return x.groupBy(*by, "cut").agg(F.avg(F.when(on, F.col("correct").cast("double"))).alias("accuracy"), F.avg(on.cast("double")).alias("coverage"))


def percentiles(rows: DataFrame, by: list[str], value: str, qs: list[float]) -> DataFrame:
    """Linear percentiles, as columns p50, p95 and so on."""
    return running.percentiles(rows, by, value, {f"p{round(q * 100)}": q for q in qs})


def upper_elements(rows: DataFrame, by: list[str], value: str, bucket: Column | None = None) -> DataFrame:
    """The elements at n // 2 and int(0.95 n) in order, without interpolation."""
    places = {"median": F.floor(F.col("n") / 2) + 1, "p95": F.floor(F.col("n") * 0.95) + 1}
    return order_statistics(rows, by, value, places, log_bucket(value) if bucket is None else bucket)


def spearman(rows: DataFrame, by: list[str], x: str, y: str, bx: Column | None = None, by_bucket: Column | None = None) -> DataFrame:
    """Correlation of average ranks. Rows with equal pairs are counted first, so frequent values are one row each in the joins
    with their ranks, and the correlation is weighted by the counts. Average ranks have the mean (n + 1) / 2, so one
    aggregation gives all sums."""
    pairs = settled(rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, x, y).agg(F.count("*").alias("_n")), "pairs")
    rank = lambda c, bucket, name: _weighted_ranks(pairs, by, c, bucket).withColumnRenamed("rank", name)
    p = pairs.join(rank(x, bx, "_rx"), [*by, x]).join(rank(y, by_bucket, "_ry"), [*by, y])
    s = lambda a, b: F.sum(F.col("_n") * F.col(a) * F.col(b))
    sums = p.groupBy(*by).agg(F.sum("_n").alias("_all"), s("_rx", "_ry").alias("_sxy"), s("_rx", "_rx").alias("_sxx"), s("_ry", "_ry").alias("_syy"))
    mean = (F.col("_all") + 1) / 2.0
    sums = sums.select(*by, *((F.col(f"_s{c}") - F.col("_all") * mean * mean).alias(f"_{c}") for c in ("xy", "xx", "yy")))
    return sums.select(*by, F.when(F.col("_xx") * F.col("_yy") > 0, F.col("_xy") / F.sqrt(F.col("_xx") * F.col("_yy"))).alias("spearman"))


def _weighted_ranks(pairs: DataFrame, by: list[str], value: str, bucket: Column | None) -> DataFrame:
    run = running_totals(pairs.select(*by, value, F.col("_n").alias("n")), by, value, ["n"], unit_bucket(value) if bucket is None else bucket)
    return run.select(*by, value, (F.col("run_n") - (F.col("n") - 1) / 2.0).alias("rank"))


def asymmetric_errors(rows: DataFrame, by: list[str], low: int, high: int) -> DataFrame:
    """Share of the rows of gold ``high`` that were said to be ``low``, and of gold ``low`` said to be ``high``."""
    n = lambda g, c: F.sum(((F.col("gold") == g) & (F.col("chosen") == c)).cast("long"))
    of = lambda g: F.greatest(F.sum((F.col("gold") == g).cast("long")), F.lit(1))
    return rows.groupBy(*by).agg((n(high, low) / of(high)).alias("high_to_low"), (n(low, high) / of(low)).alias("low_to_high"))


def bad_sums(rows: DataFrame, by: list[str], p: str = "p", slack: float = 1e-3) -> DataFrame:
    """Rows whose probabilities don't add up to one."""
    off = F.abs(E.total(p) - 1.0) > slack
    return rows.groupBy(*by).agg(F.sum(F.coalesce(off, F.lit(True)).cast("long")).alias("bad_sum"))


def ordinal_errors(rows: DataFrame, by: list[str], level: str = "chosen") -> DataFrame:
    """Mean absolute error, share within one level, share of errors that are adjacent, share two levels too low."""
    d = F.col(level) - F.col("gold")
    wrong = F.sum((d != 0).cast("long"))
    adjacent = F.when(wrong > 0, F.sum((F.abs(d) == 1).cast("long")) / wrong)
    return rows.groupBy(*by).agg(F.avg(F.abs(d).cast("double")).alias("mae"), F.avg((F.abs(d) <= 1).cast("double")).alias("within_one"), adjacent.alias("adjacent_share"), F.avg((d <= -2).cast("double")).alias("danger"))


def recall_fpr(rows: DataFrame, by: list[str], flagged: Column, positive: Column) -> DataFrame:
    n = lambda c: F.sum(c.cast("long"))
    return rows.groupBy(*by).agg((n(flagged & positive) / F.greatest(n(positive), F.lit(1))).alias("recall"), (n(flagged & ~positive) / F.greatest(n(~positive), F.lit(1))).alias("fpr"))


def precision_at_recall(rows: DataFrame, by: list[str], score: str, positive: Column, share: float = 0.8) -> DataFrame:
    """Precision and flagged share at the first place in falling score order (peers together) that reaches the recall."""
    x = rows.select(*by, F.col(score).alias("score"), positive.cast("long").alias("pos")).withColumn("n", F.lit(1).cast("long"))
    run = running_totals(x, by, "score", ["n", "pos"], unit_bucket("score"), descending=True)
    all_ = x.groupBy(*by).agg(F.sum("pos").alias("all_pos"), F.count("*").alias("all"))
    on = run.join(all_, by).where(F.col("run_pos") >= F.ceil(F.col("all_pos") * share))
    first = on.groupBy(*by).agg(F.min_by(F.struct("run_pos", "run_n", "all"), "run_n").alias("f"))
    return first.select(*by, (F.col("f.run_pos") / F.col("f.run_n")).alias("precision"), (F.col("f.run_n") / F.col("f.all")).alias("flagged"))


def kappa(rows: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Cohen's kappa; 1 where chance agreement is complete. Three branches read the counts, a row a pair of answers, so they are
    written once; else the rows are made three times, and the joins' null checks on the answers run inside the scans."""
    c = settled(rows.groupBy(*by, a, b).agg(F.count("*").alias("n")), "counts")
    n = c.groupBy(*by).agg(F.sum("n").cast("double").alias("total"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("same"))
    side = lambda x: c.groupBy(*by, F.col(x).alias("v")).agg(F.sum("n").alias(f"n_{x}"))
    chance = side(a).join(side(b), [*by, "v"]).groupBy(*by).agg(F.sum(F.col(f"n_{a}").cast("double") * F.col(f"n_{b}")).alias("chance"))
    pe, po = F.coalesce("chance", F.lit(0.0)) / (F.col("total") * F.col("total")), F.col("same") / F.col("total")
    return n.join(chance, by, "left").select(*by, po.alias("agreement"), F.when(pe == 1, F.lit(1.0)).otherwise((po - pe) / (F.lit(1.0) - pe)).alias("kappa"))
