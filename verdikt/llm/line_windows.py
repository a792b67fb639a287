"""Line dedup by overlapping windows of three lines.

Lines are split at line feeds and compared as they are. Every three consecutive lines of a text are a window; windows of
white space only don't count. Of equal windows the one with the smallest doc_id, and there the smallest line, stays; the
lines that later ones cover are merged and removed, judged on the input. So a window may lose lines to a later one that
overlaps it; in a run of four or more equal lines one line stays.

Windows are counted by a 128-bit digest with partial sums; only windows that occur twice are joined back to their places,
a join whose hot keys can be split on the place side, as the other side has one row a window.

Defined results: a null text is empty and stays null in ``text``; texts under three lines lose nothing; rows that repeat
a doc_id and its text are one document, and each gets the document's result; null doc_ids order before others; an empty
table gives no rows; further columns are passed through, whatever their names. Everything stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut, free

LINES = 3


def _without(lines, starts):
    """What is left of an array of lines without the windows at the sorted ``starts``, and the number of removed runs."""
    at = lambda j: F.get(starts, j)
    after = lambda j: F.when(j == 0, F.lit(0)).otherwise(at(j - 1) + LINES)
    gap = lambda j: F.slice(lines, after(j) + 1, F.greatest(F.coalesce(at(j), F.size(lines)) - after(j), F.lit(0)))
    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size(starts)), gap))
    spans = F.size(F.filter(F.transform(starts, lambda x, j: (j == 0) | (x > after(j))), lambda x: x))
    return kept, spans


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` with ``text`` less its repeated lines, and at the end a struct ``lines`` (n, removed, spans);
    where ``docs`` has a column of that name, the struct's name gets underscores."""
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = lambda x: F.unhex(F.md5(x.cast("binary")))
    lines = docs.select("doc_id", digest(text).alias("td"), F.split(text, "\n").alias("ls")).where(F.size("ls") >= LINES)
    at = lines.select("doc_id", "td", "ls", F.explode(F.sequence(F.lit(0), F.size("ls") - LINES)).alias("i"))
    window = F.concat_ws("\n", *(F.get("ls", F.col("i") + k) for k in range(LINES)))
    windows = at.select("doc_id", "td", "i", window.alias("w")).where(F.translate("w", " \t\r\n", "") != "")
    windows = cut(windows.select("doc_id", "td", "i", digest(F.col("w")).alias("w")), "line-windows")
    place = F.struct("doc_id", "td", "i")
    first = windows.groupBy("w").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("not first <=> last").drop("last")
    later = windows.join(first, "w").where(~place.eqNullSafe(F.col("first"))).select("doc_id", "td", "i")
    starts = later.groupBy("doc_id", "td").agg(F.array_sort(F.collect_set("i")).alias("starts"))
    starts = cut(starts, "line-starts")
    drop_cut(windows)

    taken = docs.columns
    td, sid, std, st, new, info = (free(taken, x) for x in ("td", "starts_id", "starts_td", "starts", "new_text", "lines"))
    starts = starts.toDF(sid, std, st)
    # the same shuffle at every size: a broadcast of what was found would only help small tables
    out = docs.withColumn(td, digest(text)).join(starts.hint("merge"), F.col("doc_id").eqNullSafe(F.col(sid)) & (F.col(td) == F.col(std)), "left")
    ls = F.split(text, "\n")
    kept, spans = _without(ls, F.col(st))
    found = F.col(st).isNotNull()
    n = F.size(ls)
    facts = F.struct(n.cast("long").alias("n"), F.when(found, n - F.size(kept)).otherwise(0).cast("long").alias("removed"), F.when(found, spans).otherwise(0).cast("long").alias("spans"))
    # under a name of its own first: in one select lambdas would read a new column "text" instead of the old one
    out = out.select("*", F.when(found, F.array_join(kept, "\n")).otherwise(F.col("text")).alias(new), facts.alias(info))
    return out.select(*(F.col(new).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns), info)


def digest(out: DataFrame) -> DataFrame:
    """The contract's columns of ``drop_repeated_lines``'s result; the facts are its last column."""
    kept, facts = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256), out.columns[-1]
    return out.select("doc_id", *(F.col(f"`{facts}`.{x}").alias(y) for x, y in (("n", "n_lines"), ("removed", "n_removed"), ("spans", "n_spans"))), kept.alias("kept_sha256"))


SQL = """
with l as (select doc_id, string_split(coalesce(text, ''), chr(10)) ls from documents),
x as (select doc_id, ls, unnest(range(1, len(ls) + 1)) k from l),
w as (select doc_id, k, ls[k] || chr(10) || ls[k + 1] || chr(10) || ls[k + 2] w from x where k <= len(ls) - 2),
r as (select doc_id, k, row_number() over (partition by w order by doc_id, k) n from w
      where translate(w, chr(32) || chr(9) || chr(13) || chr(10), '') <> ''),
c as (select distinct doc_id, k + d k from (select doc_id, k, unnest([0, 1, 2]) d from r where n > 1)),
m as (select x.doc_id, x.k, x.ls[x.k] line, c.k is not null gone, lag(c.k is not null, 1, false) over (partition by x.doc_id order by x.k) before
      from x left join c on x.doc_id = c.doc_id and x.k = c.k)
select doc_id, count(*) n_lines, count(*) filter (gone) n_removed, count(*) filter (gone and not before) n_spans,
       sha256(coalesce(string_agg(line, chr(10) order by k) filter (not gone), '')) kept_sha256
from m group by doc_id
"""
