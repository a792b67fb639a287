"""Ordered statistics that don't put a whole group into one task: bucketed running totals, ranks and selections."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import settled


def running_totals(df: DataFrame, by: list[str], order: str, sums: list[str], bucket: Column, descending: bool = False) -> DataFrame:
    """Sums over all rows up to each row's value of ``order``, peers included, as columns ``run_<name>``.

    Rows are first added up for each value; ``bucket`` must be a monotone function of ``order`` with at most some thousand
    values. Windows run inside a bucket, and buckets' totals, a small table, give what lies before it.
    """
    cols = [F.sum(c).alias(c) for c in sums]
    one = df.withColumn("_bucket", bucket).groupBy(*by, "_bucket", order).agg(*cols)
    direction = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    w = Window.partitionBy(*by, "_bucket").orderBy(direction(order)).rowsBetween(Window.unboundedPreceding, 0)
    inner = one.select("*", *(F.sum(c).over(w).alias(f"run_{c}") for c in sums))
    totals = one.groupBy(*by, "_bucket").agg(*cols)
    w = Window.partitionBy(*by).orderBy(direction("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*by, "_bucket", *(F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"_before_{c}") for c in sums))
    out = inner.join(before, [*by, "_bucket"])
    return out.select(*by, order, *sums, *((F.col(f"run_{c}") + F.col(f"_before_{c}")).alias(f"run_{c}") for c in sums))


def unit_bucket(order: str) -> Column:
    """Buckets for values of [0, 1], 64 for each factor of e in v / (1 - v), so about 3,500 down to 1e-12 from either end:
    probabilities crowd at both ends, where buckets of equal width would put half of the rows into one task."""
    v = F.least(F.greatest(F.col(order), F.lit(0.0)), F.lit(1.0))
    return F.floor((F.log(v + 1e-12) - F.log(1.0 - v + 1e-12)) * 64.0)


def average_ranks(df: DataFrame, by: list[str], value: str, bucket: Column | None = None) -> DataFrame:
    """by, value, n (rows with it) and rank, the mean of the ranks that equal values share."""
    counted = df.select(*by, value, F.lit(1).cast("long").alias("n"))
    run = running_totals(counted, by, value, ["n"], unit_bucket(value) if bucket is None else bucket)
    return run.select(*by, value, "n", (F.col("run_n") - (F.col("n") - 1) / 2.0).alias("rank"))


def hash_cut(df: DataFrame, by: list[str], key: str, digest: Column, share_num: int = 1, share_den: int = 2) -> DataFrame:
    """Of the distinct keys of each group the first n * num // den in the order of ``digest`` (hex text), then key, as the place
    where they end. Digests are counted by their first three digits. Of the boundary bucket _edge those up to _last_digest,
    and there keys up to _last_key, are taken (nulls: none); of the buckets before all. A row a group, written once, so that rows are told
    apart by their own digest instead of a join by key; ``under_cut`` does it. A null key counts, and is taken last."""
    keys = df.select(*by, key).distinct().withColumn("_bucket", _hash_bucket(digest))
    counts = keys.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_upto", F.sum("_n").over(Window.partitionBy(*by).orderBy("_bucket"))).withColumn("_all", F.sum("_n").over(Window.partitionBy(*by)))
    take, before = F.floor(F.col("_all") * share_num / share_den), F.col("_upto") - F.col("_n")
    last = (F.col("_upto") > take) | (F.col("_upto") == F.col("_all"))
    edges = settled(counts.where(last & (before <= take)).groupBy(*by).agg(F.min(F.struct(F.col("_bucket").alias("_edge"), F.least(take - before, F.col("_n")).alias("_left"))).alias("e")).select(*by, "e.*"), "edges")
    inside = df.select(*by, key).withColumn("_digest", digest).join(edges, by).where(_hash_bucket(F.col("_digest")) == F.col("_edge")).distinct()
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("_digest", key))
    inside = inside.withColumn("_rank", rank).where("_rank = _left").select(*by, F.col("_digest").alias("_last_digest"), F.col(key).alias("_last_key"))
    return settled(edges.join(inside, by, "left").drop("_left"), "cuts")


def _hash_bucket(digest: Column) -> Column:
    return F.coalesce(F.substring(digest, 1, 3), F.lit("g"))  # after all hex digits


def under_cut(digest: Column, key: Column) -> Column:
    """Whether a row joined to its group's ``hash_cut`` is of the first keys."""
    bucket = _hash_bucket(digest)
    inside = (digest < F.col("_last_digest")) | ((digest == F.col("_last_digest")) & (key <= F.col("_last_key")))
    return F.coalesce((bucket < F.col("_edge")) | ((bucket == F.col("_edge")) & inside), F.lit(False))


def parted(df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """``df`` in two: rows whose keys no other row has, and the others (with some that share a hash only), None if there are
    none. Keys are counted by a hash of 64 bits, so what is shuffled is a number a row and not the rows."""
    h = F.xxhash64(*keys)
    again = settled(df.groupBy(h.alias("_h")).agg(F.count("*").alias("n")).where("n > 1").select("_h"), "repeated")
    if again.isEmpty():
        return df, None
    x = df.withColumn("_h", h)
    return x.join(again, "_h", "left_anti").drop("_h"), x.join(again, "_h", "left_semi").drop("_h")


def log_bucket(value: Column | str) -> Column:
    """Buckets for values of any size and sign, 64 for each factor of e."""
    v = F.col(value) if isinstance(value, str) else value
    return (F.signum(v) * F.floor(F.log1p(F.abs(v)) * 64.0)).cast("long")


def order_statistics(df: DataFrame, by: list[str], value: str, places: dict[str, Column], bucket: Column) -> DataFrame:
    """by and, for each name, the value at a place of the rows in order (from 1; a column over ``n``, the rows with a value);
    null beyond the last. Rows with equal values are added up first, so no group is sorted whole."""
    return _statistics(_counted(df, by, value), by, value, places, bucket)


def _counted(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, value and n, its rows, written once, as several branches read them. Null values go only then: a check before would
    put the whole expression of a computed value into the scan's filter a second time."""
    return settled(df.groupBy(*by, value).agg(F.count("*").alias("n")), "values").where(F.col(value).isNotNull())


def _statistics(x: DataFrame, by: list[str], value: str, places: dict[str, Column], bucket: Column) -> DataFrame:
    run = running_totals(x, by, value, ["n"], bucket).select(*by, value, F.col("run_n").alias("_upto"))
    run = run.join(x.groupBy(*by).agg(F.sum("n").alias("n")), by)
    return run.groupBy(*by).agg(*(F.min(F.when(F.col("_upto") >= place, F.col(value))).alias(name) for name, place in places.items()))


def percentiles(df: DataFrame, by: list[str], value: str | Column, places: dict[str, float], bucket: Column | None = None, images: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """by and, for each name, the linear percentile at its place (0 to 1) of the values that aren't null: between the two
    neighbouring order statistics, so no group's values are held by one task. The result, a row a group, is written once. ``bucket`` as in ``running_totals``, over the
    column ``_v``; without one values may be of any size. With ``images``, functions that keep the values' order, the percentiles of
    each image of the values, as <name>_<image>: the values are counted and ordered once for all."""
    v = F.col(value) if isinstance(value, str) else value
    group = ["_all", *by]
    x = _counted(df.select(*by, F.lit(0).alias("_all"), v.cast("double").alias("_v")), group, "_v")
    at = lambda q, side: (F.floor if side == "lo" else F.ceil)(F.round((F.col("n") - 1) * F.lit(float(q)), 9)) + 1
    both = {f"_{side}_{name}": at(q, side) for name, q in places.items() for side in ("lo", "hi")}
    counts = x.groupBy(*group).agg(F.sum("n").alias("_n"))
    y = _statistics(x, group, "_v", both, log_bucket("_v") if bucket is None else bucket).join(counts, group)

    def between(name: str, q: float, image: Callable[[Column], Column], suffix: str) -> Column:
        place = F.round((F.col("_n") - 1) * F.lit(float(q)), 9)
        lo, hi = image(F.col(f"_lo_{name}")), image(F.col(f"_hi_{name}"))
        return (lo + (hi - lo) * (place - F.floor(place))).alias(name + suffix)

    of = {f"_{k}": f for k, f in images.items()} if images else {"": lambda c: c}
    return settled(y.select(*by, *(between(name, q, f, k) for name, q in places.items() for k, f in of.items())), "percentiles")


def hash_ranks(df: DataFrame, by: list[str], key: str, digest: Column) -> DataFrame:
    """by, key and rank (from 1) of the distinct keys of each group in the order of ``digest`` (hex text), then key. Keys are
    ranked inside buckets of a digest's first three digits, and small totals give what lies before a bucket."""
    keys = df.select(*by, key).distinct().withColumn("_digest", digest).withColumn("_bucket", F.substring("_digest", 1, 3))
    counts = keys.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*by, "_bucket", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    inner = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy("_digest", key))
    return keys.withColumn("_inner", inner).join(counts, [*by, "_bucket"]).select(*by, key, (F.col("_before") + F.col("_inner")).alias("rank"))


def ordinal_ranks(df: DataFrame, by: list[str], value: str, key: str, name: str, bucket: Column | None = None) -> DataFrame:
    """``df`` with the rank of each row (from 1) by value, and among equal values by the MD5 of ``key``, then key; rows with a null
    group or value are left out. Rows are sorted by ranges over the whole table, so neither a group nor a value that many rows
    share is one task's: a shuffle and a written table in all. ``bucket`` isn't needed any more."""
    there = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in [*by, value]))
    x = df.where(there).withColumn("_digest", F.unhex(F.md5(F.col(key).cast("string").cast("binary"))))
    x, before = _dealt(x, [*by, value, "_digest", key], ["_digest"])
    x = x.join(F.broadcast(before), "_part").withColumn("_at", F.col("_before") + F.col("_within"))
    first = x.groupBy(*by).agg(F.min("_at").alias("_first"))
    return x.join(F.broadcast(first), by).select(*df.columns, (F.col("_at") - F.col("_first") + 1).alias(name))


def places(df: DataFrame, by: list[str], order: list[str], place: str, rows: str, drop: list[str] = ()) -> DataFrame:
    """``df`` without the columns ``drop`` and with each row's place (from 0) in its group by a total order, and the group's rows. As
    in ``ordinal_ranks`` neither a group nor a value is one task's."""
    x, before = _dealt(df, [*by, *order], drop)
    x = x.join(F.broadcast(before), "_part").withColumn("_at", F.col("_before") + F.col("_within"))
    groups = x.groupBy(*by).agg(F.min("_at").alias("_first"), F.count("*").alias(rows))
    return x.join(F.broadcast(groups), by).select(*(c for c in df.columns if c not in drop), (F.col("_at") - F.col("_first")).alias(place), rows)


def _dealt(df: DataFrame, order: list[str], drop: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """``df`` dealt and sorted by ranges of a total order and written once without the columns ``drop``, with each row's range _part
    and place _within it (from 0); and the number of rows _before each range, a row each."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    within = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    x = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    x = settled(x.withColumns({"_part": F.spark_partition_id(), "_within": within}).drop(*drop), "numbered")
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return x, x.groupBy("_part").agg(F.count("*").alias("_size")).select("_part", F.coalesce(F.sum("_size").over(w), F.lit(0)).alias("_before"))


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with the place of each row (from 1) in a total order over the whole table. Rows are dealt by ranges and sorted
    in them once, and the sizes of the ranges before, a row each, are added to the places inside."""
    x, before = _dealt(df, order)
    return x.join(F.broadcast(before), "_part").select(*df.columns, (F.col("_before") + F.col("_within") + 1).alias(name))
