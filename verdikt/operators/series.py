"""Ordered series: control-chart statistics and rules, hourly output, windows and carries.

A series is the rows of ``by`` in the order of ``order``. Chart statistics and carries take each as short (points of one
chart, turns of one call), so their windows partition by series; ``greedy_windows`` takes series of any length.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import settled
from .running import numbered


def spc_stats(df: DataFrame, by: list[str], order: list[str], x: str, cl: str, ucl: str, lcl: str) -> DataFrame:
    """by, n_out, longest run on one side of the centre (a point on it ends a run), longest strictly monotone run, and the
    most points beyond two sigma on one side within three in a row."""
    w = Window.partitionBy(*by).orderBy(*order)
    sigma = (F.col(ucl) - F.col(cl)) / 3.0
    v = F.col(x)
    side = F.when(v > F.col(cl), 1).when(v < F.col(cl), -1).otherwise(0)
    up = F.coalesce(F.signum(v - F.lag(x).over(w)), F.lit(0.0)).cast("int")
    d = df.withColumn("_i", F.row_number().over(w)).withColumn("_side", side).withColumn("_dir", up)
    d = d.withColumn("_hi", (v > F.col(cl) + 2 * sigma).cast("int")).withColumn("_lo", (v < F.col(cl) - 2 * sigma).cast("int"))
    w = Window.partitionBy(*by).orderBy("_i")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_s", F.sum(F.coalesce((F.col("_side") != F.lag("_side").over(w)).cast("int"), F.lit(0))).over(run))
    d = d.withColumn("_m", F.sum(F.coalesce((F.col("_dir") != F.lag("_dir").over(w)).cast("int"), F.lit(0))).over(run))
    d = d.withColumn("_side_run", F.when(F.col("_side") == 0, 0).otherwise(F.count("*").over(Window.partitionBy(*by, "_s").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0))))
    # a run of d equal steps spans d + 1 points
    d = d.withColumn("_mono", F.when(F.col("_dir") == 0, 1).otherwise(1 + F.count("*").over(Window.partitionBy(*by, "_m").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0))))
    three = w.rowsBetween(-2, 0)
    full = F.count("*").over(three) == 3
    d = d.withColumn("_two", F.when(full, F.greatest(F.sum("_hi").over(three), F.sum("_lo").over(three))).otherwise(0))
    out = ((v > F.col(ucl)) | (v < F.col(lcl))).cast("long")
    return d.groupBy(*by).agg(F.count("*").alias("points"), F.sum(out).alias("n_out"), F.max("_side_run").cast("long").alias("side_run"), F.max("_mono").cast("long").alias("monotone_run"), F.max("_two").cast("long").alias("two_of_three"))


def spc_decision(recheck_out: Column) -> Column:
    """D, C, B or A from the statistics' columns."""
    odd = (F.col("side_run") >= 7) | (F.col("monotone_run") >= 6) | (F.col("two_of_three") >= 2)
    return F.when(F.col("n_out") >= 2, "D").when((F.col("n_out") == 1) & recheck_out, "D").when(F.col("n_out") == 1, "C").when(odd, "B").otherwise("A")


def hourly(df: DataFrame, by: list[str], order: list[str], x: str, target: float) -> DataFrame:
    """Mean as a share of the target, least value, greatest drop from one hour to the next (0 without)."""
    w = Window.partitionBy(*by).orderBy(*order)
    d = df.withColumn("_drop", F.lag(x).over(w) - F.col(x))
    return d.groupBy(*by).agg((F.avg(x) / target).alias("share"), F.min(x).alias("least"), F.greatest(F.coalesce(F.max("_drop"), F.lit(0.0)), F.lit(0.0)).alias("drop"))


def carry(df: DataFrame, by: list[str], order: list[str], text: str, keep: Column, name: str = "prev_text") -> DataFrame:
    """Rows that satisfy ``keep`` with the text of the one before; the others are left out before the carry."""
    return df.where(keep).withColumn(name, F.lag(text).over(Window.partitionBy(*by).orderBy(*order)))


def offsets(df: DataFrame, by: list[str], order: list[str], size: str, name: str = "offset") -> DataFrame:
    """Running total of the sizes before each row."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(size).over(w), F.lit(0)))


def greedy_windows(df: DataFrame, by: list[str], order: list[str], start: str, end: str, tokens: str, seconds: float = 8.0, most_tokens: int = 25, cap: float = 15.0, short: int = 2048) -> DataFrame:
    """by, w, t0, t1, n_seg, n_tok: segments gathered in order until a window spans ``seconds`` or holds ``most_tokens``; one
    that a segment would take beyond ``cap`` seconds is closed first. A segment without an end ends where it starts.

    Series of at most ``short`` segments are folded as an array; longer ones are cut into chunks of that size
    (``chunked_windows``), so a series may span tasks. Both give the same windows.
    """
    counts = settled(df.groupBy(*by).agg(F.count("*").alias("_n")), "series")
    long = counts.where(F.col("_n") > short)
    limits = (seconds, most_tokens, cap)
    if long.limit(1).count() == 0:
        return _folded(df, by, order, start, end, tokens, *limits)
    same = lambda x: [F.col(f"x.{c}").eqNullSafe(x[c]) for c in by]
    few, many = (df.alias("x").join(side, same(side), "left_semi") for side in (counts.where(F.col("_n") <= short), long))
    return _folded(few, by, order, start, end, tokens, *limits).unionByName(chunked_windows(many, by, order, start, end, tokens, *limits, short))


def _folded(df: DataFrame, by: list[str], order: list[str], start: str, end: str, tokens: str, seconds: float, most_tokens: int, cap: float) -> DataFrame:
    seg = F.struct(*(F.col(c).alias(f"o{i}") for i, c in enumerate(order)), F.col(start).cast("double").alias("s"), F.coalesce(F.col(end).cast("double"), F.col(start).cast("double")).alias("e"), F.col(tokens).cast("long").alias("k"))
    one = "struct<t0:double,t1:double,n:bigint,k:bigint>"
    none = F.lit(None).cast(one)
    state = F.struct(F.array().cast(f"array<{one}>").alias("done"), none.alias("open"))

    def step(a, x):
        over = a["open"].isNotNull() & (x["e"] - a["open"]["t0"] > cap)
        done = F.when(over, F.concat(a["done"], F.array(a["open"]))).otherwise(a["done"])
        held = F.when(over, none).otherwise(a["open"])
        new = F.struct(F.coalesce(held["t0"], x["s"]).alias("t0"), x["e"].alias("t1"), (F.coalesce(held["n"], F.lit(0).cast("long")) + 1).alias("n"), (F.coalesce(held["k"], F.lit(0).cast("long")) + x["k"]).alias("k"))
        full = (new["t1"] - new["t0"] >= seconds) | (new["k"] >= most_tokens)
        return F.struct(F.when(full, F.concat(done, F.array(new))).otherwise(done).alias("done"), F.when(full, none).otherwise(new).alias("open"))

    fold = F.aggregate("segs", state, step, lambda a: F.when(a["open"].isNotNull(), F.concat(a["done"], F.array(a["open"]))).otherwise(a["done"]))
    out = df.groupBy(*by).agg(F.array_sort(F.collect_list(seg)).alias("segs")).select(*by, F.posexplode(fold).alias("w", "x"))
    return out.select(*by, "w", "x.t0", "x.t1", F.col("x.n").alias("n_seg"), F.col("x.k").alias("n_tok"))


LINK = "k string, c long, j long, nxt long, t0 double, t1 double, tok long, stops boolean"


def chunked_windows(df: DataFrame, by: list[str], order: list[str], start: str, end: str, tokens: str, seconds: float, most_tokens: int, cap: float, size: int) -> DataFrame:
    """``greedy_windows`` of series of any length, in chunks of ``size`` segments.

    Each segment gets a link to the segment with which the next window would begin if one began here; links that leave a chunk
    are followed into the chunks after it. Of a chunk only the places matter where a link from before it lands: each leads to
    a place in a later chunk, and those that lie on the way from a series' first segment are found by doubling the steps,
    in as many rounds as the number of chunks has binary digits. Every chunk then lists its own windows.
    """
    spark = df.sparkSession
    key = F.to_json(F.struct(*by), {"ignoreNullFields": "false"})
    x = df.select(*by, key.alias("k"), *(F.col(c).alias(f"o{i}") for i, c in enumerate(order)), F.col(start).cast("double").alias("s"), F.coalesce(F.col(end).cast("double"), F.col(start).cast("double")).alias("e"), F.col(tokens).cast("long").alias("t"))
    x = settled(numbered(x, ["k", *(f"o{i}" for i in range(len(order))), "s", "e", "t"], "g"), "segments")
    names = settled(x.groupBy("k").agg(*(F.first(c).alias(c) for c in by), F.min("g").alias("g0"), F.count("*").alias("n")), "series")  # a row a long series
    i = F.col("g") - F.col("g0")
    segs = settled(x.join(names.select("k", "g0"), "k").select("k", i.alias("i"), F.floor(i / size).alias("c"), "s", "e", "t"), "segments")

    def walk(e, t, i, t0, tok, last, first):
        """From place ``i`` of a chunk on: the place after the window (or none), its end and tokens."""
        while i < len(e):
            if not first and e[i] - t0 > cap:
                return i, last, tok
            first, last, tok = False, e[i], tok + t[i]
            i += 1
            if last - t0 >= seconds or tok >= most_tokens:
                return i, last, tok
        return None, last, tok

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        s, e, t, at = (pdf[c].tolist() for c in ("s", "e", "t", "i"))
        out = []
        for j in range(len(s)):
            nxt, t1, tok = walk(e, t, j, s[j], 0, s[j], True)
            out.append((pdf["k"].iloc[0], pdf["c"].iloc[0], at[j], None if nxt is None else at[0] + nxt, s[j], t1, tok, nxt is not None))
        return _links(out)

    def further(name: tuple, pdf: pd.DataFrame, opened: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        e, t, at, out = pdf["e"].tolist(), pdf["t"].tolist(), pdf["i"].tolist(), []
        for r in opened.itertuples(index=False):
            nxt, t1, tok = walk(e, t, 0, r.t0, r.tok, r.t1, False)
            out.append((r.k, r.c, r.j, None if nxt is None else at[0] + nxt, r.t0, t1, tok, nxt is not None or not at))
        return _links(out)

    found = settled(segs.groupBy("k", "c").applyInPandas(links, LINK), "links")
    done, opened = [found.where("stops")], found.where("not stops")
    ahead = 1
    while opened.limit(1).count():
        seek = opened.withColumn("d", F.col("c") + ahead)
        there = segs.join(seek.select(F.col("k").alias("_k"), F.col("d").alias("_d")).distinct(), (F.col("k") == F.col("_k")) & (F.col("c") == F.col("_d")), "left_semi")
        found = settled(there.groupBy("k", "c").cogroup(seek.groupBy("k", "d")).applyInPandas(further, LINK), "links")
        done, opened, ahead = [*done, found.where("stops")], found.where("not stops"), ahead + 1
    ends = names.select("k", "n")
    link = reduce(DataFrame.unionByName, done).join(ends, "k")
    link = settled(link.withColumn("nxt", F.coalesce("nxt", "n")).select("k", "c", "j", "nxt", "t0", "t1", "tok"), "links")
    chunk = F.floor(F.col("p") / size)
    landed = link.where(F.floor(F.col("nxt") / size) > F.col("c")).select("k", F.col("nxt").alias("p"))
    entries = settled(landed.unionByName(names.select("k", F.lit(0).cast("long").alias("p"))).distinct().withColumn("c", chunk), "entries")

    def through(name: tuple, own: pd.DataFrame, entered: pd.DataFrame) -> pd.DataFrame:
        to, last = dict(zip(own["j"], own["nxt"], strict=True)), own["j"].max()
        out = []
        for p in entered["p"] if len(own) else ():
            q = p
            while q <= last:
                q = to[q]
            out.append((name[0], p, q))
        return pd.DataFrame(out, columns=["k", "p", "q"])

    jump = settled(link.groupBy("k", "c").cogroup(entries.groupBy("k", "c")).applyInPandas(through, "k string, p long, q long"), "jumps")
    reached = names.select("k", F.lit(0).cast("long").alias("p"))
    most = names.agg(F.max("n")).first()[0]
    for _ in range((most // size + 1).bit_length()):
        ahead_ = reached.join(jump, ["k", "p"]).select("k", F.col("q").alias("p"))
        reached = settled(reached.unionByName(ahead_).distinct(), "reached")
        then = jump.select("k", F.col("p").alias("q"), F.col("q").alias("r"))
        jump = settled(jump.join(then, ["k", "q"]).select("k", "p", F.col("r").alias("q")), "jumps")

    def listed(name: tuple, own: pd.DataFrame, entered: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(own) and len(entered):
            at, last, q = own.set_index("j"), own["j"].max(), entered["p"].min()
            while q <= last:
                r = at.loc[q]
                out.append((name[0], name[1], len(out), r["t0"], r["t1"], int(r["nxt"]) - q, int(r["tok"])))
                q = int(r["nxt"])
        return pd.DataFrame(out, columns=["k", "c", "v", "t0", "t1", "n_seg", "n_tok"])

    own = settled(link.groupBy("k", "c").cogroup(reached.withColumn("c", chunk).groupBy("k", "c")).applyInPandas(listed, "k string, c long, v long, t0 double, t1 double, n_seg long, n_tok long"), "windows")
    sizes = own.groupBy("k", "c").agg(F.count("*").alias("_n"))  # a row a chunk
    before = sizes.select("k", "c", F.coalesce(F.sum("_n").over(Window.partitionBy("k").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    out = own.join(before, ["k", "c"]).join(names.select("k", *by), "k")
    return out.select(*by, (F.col("v") + F.col("_b")).cast("int").alias("w"), "t0", "t1", "n_seg", "n_tok")


def _links(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["k", "c", "j", "nxt", "t0", "t1", "tok", "stops"])
    return out.astype({"nxt": "Int64"})
