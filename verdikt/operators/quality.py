"""Data-quality checks that return the rows that break them, never an exception."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as E


def violations(df: DataFrame, row_id: str, rules: dict[str, Column]) -> DataFrame:
    """rule and id of the rows for which a rule's condition isn't true."""
    bad = F.filter(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items())), lambda x: x.isNotNull())
    return df.select(F.explode(bad).alias("rule"), F.col(row_id).cast("string").alias("id"))


def validate_rows(df: DataFrame, letters: list[str], required: list[str]) -> DataFrame:
    """Required fields filled, gold among the letters, ids unique, pairs of exactly two with different gold, and a warning
    for each task in which one answer has over half of the rows."""
    rules = {f"missing_{c}": F.col(c).isNotNull() & (F.col(c).cast("string") != "") for c in required}
    rules["gold_not_an_option"] = F.col("gold").isin(letters)
    found = [violations(df, "id", rules)]
    found.append(df.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("id_repeats").alias("rule"), F.col("id").cast("string").alias("id")))
    pairs = df.where("pair_id is not null and pair_id <> ''").groupBy("pair_id").agg(F.count("*").alias("n"), F.min("gold").alias("a"), F.max("gold").alias("b"))
    found.append(pairs.where("n <> 2").select(F.lit("pair_size").alias("rule"), F.col("pair_id").cast("string").alias("id")))
    found.append(pairs.where("n = 2 and a = b").select(F.lit("pair_same_gold").alias("rule"), F.col("pair_id").cast("string").alias("id")))
    share = df.groupBy("task", "gold").agg(F.count("*").alias("n")).groupBy("task").agg(F.max("n").alias("most"), F.sum("n").alias("n"))
    found.append(share.where("most > 0.5 * n").select(F.lit("warning_unbalanced").alias("rule"), F.col("task").cast("string").alias("id")))
    return reduce(DataFrame.unionByName, found)


def validate_rules(rules: DataFrame, letters: list[str], least: int = 10, most: int = 25) -> DataFrame:
    """Of rule tables (task, ord, pattern, label, default_label): labels known, patterns not empty and not repeated, sizes."""
    known = violations(rules, "task", {"label_not_an_option": F.col("label").isin(letters), "default_not_an_option": F.col("default_label").isin(letters), "empty_pattern": F.length(F.trim("pattern")) > 0})
    again = rules.groupBy("task", "pattern").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("pattern_repeats").alias("rule"), F.col("task").cast("string").alias("id"))
    size = rules.groupBy("task").agg(F.count("*").alias("n")).where((F.col("n") < least) | (F.col("n") > most)).select(F.lit("rule_count").alias("rule"), F.col("task").cast("string").alias("id"))
    return known.unionByName(again).unionByName(size)


def stored_mismatch(rows: DataFrame, stored: str = "stored_correct") -> DataFrame:
    """Rows whose stored flag differs from the one that argmax and gold give."""
    return rows.where(F.col(stored) != F.coalesce(E.argmax("p") == F.col("gold"), F.lit(False)))


def report_mismatch(report: DataFrame, recomputed: DataFrame, keys: list[str], values: list[str], slack: float = 1e-3) -> DataFrame:
    """Cells of a report that differ from the recomputed ones by more than ``slack`` or are missing there."""
    new = recomputed.select(*keys, *(F.col(v).alias(f"new_{v}") for v in values))
    bad = reduce(lambda a, b: a | b, (~F.coalesce(F.abs(F.col(v) - F.col(f"new_{v}")) <= slack, F.lit(False)) for v in values))
    return report.join(new, keys, "left").where(bad)


def first_difference(a: Column, b: Column) -> Column:
    """First position at which two arrays differ (a length counts); null if they are equal."""
    at = F.filter(F.sequence(F.lit(0), F.greatest(F.size(a), F.size(b), F.lit(1)) - 1), lambda i: ~F.get(a, i).eqNullSafe(F.get(b, i)))
    return F.when(F.size(at) > 0, F.element_at(at, 1))


def mass_gate(rows: DataFrame, by: list[str], raw: str = "raw_logprobs", least: float = 0.9) -> DataFrame:
    return rows.groupBy(*by).agg(F.min(E.option_mass(raw)).alias("min_mass")).withColumn("ok", F.col("min_mass") >= least)
