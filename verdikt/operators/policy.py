"""Decision policies: risk cuts, bands, cascades and the drift check. Rows have task, conf, correct and cal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as E
from ..sources.shared import settled
from . import metrics as M
from .calibrate import GRID, fit_temperature
from .running import order_statistics, ordinal_ranks, running_totals, unit_bucket


def infinity() -> Column:
    return F.lit("Infinity").cast("double")


def risk_cut(cal: DataFrame, eps: list[float], by: list[str], n: str | None = None) -> DataFrame:
    """by, eps and cut: the lowest confidence c of the rows for which (errors + 1) / (rows + 1) of all rows with conf >= c
    is at most eps; infinity where there is none. Rows of equal confidence are never parted. ``n`` names a column of how many rows each stands for."""
    many = (F.col(n) if n else F.lit(1)).cast("long")
    x = cal.select(*by, "conf", ((~F.col("correct")).cast("long") * many).alias("wrong"), many.alias("n"))
    run = running_totals(x, by, "conf", ["n", "wrong"], unit_bucket("conf"), descending=True)
    ok = (F.col("run_wrong") + 1) / (F.col("run_n") + 1) <= F.col("eps")
    run = run.withColumn("eps", F.explode(F.array(*map(F.lit, eps))))
    return run.groupBy(*by, "eps").agg(F.coalesce(F.min(F.when(ok, F.col("conf"))), infinity()).alias("cut"))


def conformal_cut(cal: DataFrame, eps: list[float], by: list[str]) -> DataFrame:
    """The order statistic number ceil((n + 1) * (1 - eps)) of 1 - p(gold); 1 beyond the last."""
    x = cal.select(*by, (1.0 - F.get("p", F.col("gold"))).alias("s"))
    names = [f"q{i}" for i in range(len(eps))]
    q = order_statistics(x, by, "s", {n: F.ceil((F.col("n") + 1) * (1.0 - e)) for n, e in zip(names, eps, strict=True)}, unit_bucket("s"))
    each = F.explode(F.array(*(F.struct(F.lit(e).alias("eps"), F.coalesce(n, F.lit(1.0)).alias("q")) for n, e in zip(names, eps, strict=True))))
    return q.select(*by, each.alias("x")).select(*by, "x.eps", "x.q")


def apply_cut(rows: DataFrame, cuts: DataFrame, by: list[str], when_empty: float | None = 0.0, n: str | None = None) -> DataFrame:
    """by, eps, cut, n, handled, coverage, error (``when_empty`` where nothing is handled) and held (error <= eps)."""
    on = F.col("conf") >= F.col("cut")
    many = (F.col(n) if n else F.lit(1)).cast("long")
    x = rows.join(F.broadcast(cuts), by).groupBy(*by, "eps", "cut").agg(F.sum(many).alias("n"), F.sum(on.cast("long") * many).alias("handled"), F.sum((on & ~F.col("correct")).cast("long") * many).alias("wrong"))
    error = F.when(F.col("handled") > 0, F.col("wrong") / F.col("handled")).otherwise(F.lit(when_empty))
    return x.withColumn("coverage", F.col("handled") / F.col("n")).withColumn("error", error).withColumn("held", F.coalesce(F.col("error") <= F.col("eps"), F.lit(True))).drop("wrong")


def threshold_run(rows: DataFrame, eps: list[float], measure: str = "top_prob", grid: list[float] = GRID, k: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Fit on cal rows, evaluate on the others. Returns the lock tables: task, temp, measure, n_cal, n_test, acc_test; and
    task, eps, cut, coverage, error, handled, held. measure ``auto`` takes for each task the one of best cal AUROC."""
    temps = fit_temperature(rows.where("cal"), "task", grid)
    x = M.with_probs(rows.join(F.broadcast(temps), "task"), F.col("temp"), k)
    if measure == "auto":
        names = list(E.MEASURES)
        long = x.withColumn("m", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), f("p").alias("conf")) for i, f in enumerate(E.MEASURES.values())))))
        a = M.auroc(long.where("cal").select("task", F.col("m.i").alias("i"), F.col("m.conf").alias("s"), "correct"), ["task", "i"], "s", F.col("correct"))
        best = a.groupBy("task").agg(F.max(F.struct(F.coalesce("auroc", F.lit(-1.0)).alias("a"), (-F.col("i")).alias("i"))).alias("b")).select("task", (-F.col("b.i")).alias("best"))
        x = long.join(F.broadcast(best), "task").where("m.i = best").withColumn("conf", F.col("m.conf")).withColumn("measure", F.element_at(F.array(*map(F.lit, names)), F.col("best") + 1))
    else:
        x = x.withColumn("conf", E.MEASURES[measure]("p")).withColumn("measure", F.lit(measure))
    x = x.withColumn("conf", F.round("conf", 12))
    test = ~F.col("cal")
    lock = x.groupBy("task", "temp", "measure").agg(F.sum(F.col("cal").cast("long")).alias("n_cal"), F.sum(test.cast("long")).alias("n_test"), F.avg(F.when(test, F.col("correct").cast("double"))).alias("acc_test"))
    return lock, apply_cut(x.where(test), settled(risk_cut(x.where("cal"), eps, ["task"]), "cuts"), ["task"])


def check_lock(rows: DataFrame, lock: DataFrame, lock_eps: DataFrame, k: int | None = None) -> DataFrame:
    """Stored temperatures and cuts on new test rows: error at most 1.5 eps or 0.03 over the stored one, coverage at most
    0.10 under the stored one."""
    x = M.with_probs(rows.join(F.broadcast(lock.select("task", "temp")), "task"), F.col("temp"), k).withColumn("conf", F.round("conf", 12))
    new = apply_cut(x, lock_eps.select("task", "eps", "cut"), ["task"]).select("task", "eps", F.col("error").alias("new_error"), F.col("coverage").alias("new_coverage"))
    ok = ((F.col("new_error") <= 1.5 * F.col("eps")) | (F.col("new_error") <= F.col("error") + 0.03)) & (F.col("new_coverage") >= F.col("coverage") - 0.10)
    return lock_eps.join(new, ["task", "eps"]).select("task", "eps", "error", "new_error", "coverage", "new_coverage", ok.alias("ok"))


def human_cut(cal: DataFrame, cuts: DataFrame, by: list[str]) -> DataFrame:
    """by, cut, human: under ``human`` at least half of the calibration rows, taken from the least confident up, are wrong."""
    x = cal.select(*by, "conf", (~F.col("correct")).cast("long").alias("wrong"), F.lit(1).cast("long").alias("n"))
    run = running_totals(x, by, "conf", ["n", "wrong"], unit_bucket("conf"))
    low = run.where(F.col("run_wrong") / F.col("run_n") >= 0.5).groupBy(*by).agg((F.max("conf") + 1e-12).alias("human"))
    return cuts.join(low, by, "left").withColumn("human", F.least(F.coalesce("human", F.lit(0.0)), F.col("cut")))


def band(conf: Column, auto: Column, human: Column) -> Column:
    return F.when(conf >= auto, "auto").when(conf < human, "human").otherwise("confirm")


def fixed_band(conf: Column) -> Column:
    return F.when(conf > 0.9, "auto").when(conf < 0.5, "human").otherwise("confirm")


def cascade(pairs: DataFrame, sent: Column) -> DataFrame:
    """Rows with the second stage's choice where ``sent``, else the first's: adds sent and final_correct."""
    return pairs.withColumn("sent", sent).withColumn("final_correct", F.when(F.col("sent"), F.col("correct_b")).otherwise(F.col("correct_a")))


def rank_fraction(df: DataFrame, by: list[str], score: str, name: str, key: str = "id") -> DataFrame:
    """``df`` with the ordinal rank by score scaled to [0, 1], ties by a hash of the key."""
    n = df.groupBy(*by).agg(F.count("*").alias("_rows"))
    x = ordinal_ranks(df, by, score, key, "_rank", unit_bucket(score)).join(F.broadcast(n), by)
    return x.select(*df.columns, F.when(F.col("_rows") > 1, (F.col("_rank") - 1) / (F.col("_rows") - 1)).otherwise(0.0).alias(name))
