"""Benchmark decontamination by item-sized windows that share their rarest shingles with an item, with DataFrame functions
only.

A document is contaminated by an item if one of its windows of as many words as the item has reaches a similarity of
0.75: the weighted Jaccard similarity of their 5-word shingles, each weighted by how often it stands there. Words are
those of ``WORD`` after A-Z are lower-cased. An item of fewer than five words is one shingle, its whole sequence.

Pairs of window and item are found exactly: at 0.75 at least three quarters of either one's shingles are shared, so of
both in one order, by how many items of that length have a shingle, the first quarters and one more have one in common.
Items are listed under those shingles, each window looks up its own, and the exact similarity then decides. Nothing at
0.75 or above is missed, wherever the passage is cut or changed.

Only windows that hold enough shared shingles are looked up: a full window at 0.75 has at least six in seven of its places
taken by shingles of items of its length, in whatever order, and a document shorter than the item three in seven of both
together. Shared places are listed for each text and length; the windows that hold enough of them follow from the sorted
list, and only texts that have such windows are read again for their words.

Item tables are taken in blocks of about ``BLOCK_SHINGLES`` shingles, by a hash of the item; a block is broadcast if it
holds at most twice that, else joined by shuffles; blocks run one after the other over all documents. Documents are exploded inside one code-generated stage,
and only matches leave it, with the words around them.

Defined results: null or empty texts and items match nothing; a document shorter than an item is compared whole; rows
that repeat a doc_id count as one document, which gets a row an item; null ids match like others; empty tables give no
rows; only doc_id, text, item_id are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, free

K, LEAST = 5, 0.75
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLOCK_SHINGLES, BLOCK_ITEMS = 1_000_000, 10_000


def words(col):
    """The words of a text as an array; a null text has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(col, F.lit(""))), NOT_WORD), "")


def computed_once(df: DataFrame, column, name: str) -> DataFrame:
    """``df`` with a column that later filters and projections can't repeat: the optimizer doesn't move expressions through
    a generator. Repeated, the regex runs several times a row, and the stage's method is too long to be compiled."""
    return df.select("*", F.explode(F.array(column)).alias(name))


def _shingle(array: str, at, k: int):
    return F.xxhash64(F.lit(k), *(F.get(array, at + j) for j in range(k)))


def with_shingles(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the shingles of ws, with the number of equal ones before, so that counts become distinct members."""
    n = F.size("ws")
    one = F.when(n == 0, F.array().cast("array<string>")).otherwise(F.array(F.array_join("ws", " ")))
    many = F.transform(F.sequence(F.lit(1), n - K + 1), lambda i: F.array_join(F.slice("ws", i, K), " "))
    df = computed_once(df, F.array_sort(F.when(n >= K, many).otherwise(one)), "plain")
    # in sorted order equal ones stand together: each run is numbered from 0, in time linear in the array
    m = F.size("plain")
    places = F.when(m > 0, F.sequence(F.lit(0), m - 1)).otherwise(F.array().cast("array<int>"))
    df = computed_once(df, F.filter(places, lambda i: (i == 0) | (F.get("plain", i) != F.get("plain", i - 1))), "heads")
    number = F.flatten(F.transform("heads", lambda h, j: F.sequence(F.lit(0), F.coalesce(F.get("heads", j + 1), m) - h - 1)))
    return computed_once(df, F.zip_with("plain", number, lambda x, i: F.concat_ws("#", x, i.cast("string"))), name).drop("plain", "heads")


def _firsts(size):
    """How many shingles, in one order for all, can't all be missing from a partner at 0.75: a quarter, and one."""
    return size - F.floor((size * 3 + 3) / 4) + 1


def _starts(n, m):
    """The starts of windows of n of m words that hold enough of the places in the sorted array ``at``. Of the windows whose
    first place is at[j], those that start behind at[j - 1] and reach the last place needed."""
    size = n - F.least(n, F.lit(K)) + 1
    need = F.floor((size * 6 + 6) / 7).cast("int")
    first = lambda j: F.greatest(F.get("at", j + need - 1) - size + 1, F.coalesce(F.get("at", j - 1) + 1, F.lit(0)), F.lit(0))
    last = lambda j: F.least(F.get("at", j), m - n)
    none = F.array().cast("array<int>")
    ranges = F.transform(F.sequence(F.lit(0), F.size("at") - need), lambda j: F.when(first(j) <= last(j), F.sequence(first(j), last(j))).otherwise(none))
    whole = F.size("at") * 7 >= (size + F.greatest(m - K + 1, F.lit(1))) * 3
    short = F.when(whole, F.array(F.lit(0))).otherwise(none)
    return F.when(m < n, short).when(F.size("at") >= need, F.flatten(ranges)).otherwise(none)


def item_index(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """How many items of n words have a shingle, as n, h, items; and items under their rarest ones, as n, h, row."""
    members = items.select("row", F.size("ws").alias("n"), F.size("shingles").alias("size"), F.explode("shingles").alias("s")).select("row", "n", "size", F.xxhash64("s").alias("h"))
    common = members.groupBy("n", "h").agg(F.count("*").alias("items"))
    rarest = members.join(common, ["n", "h"]).groupBy("row", "n").agg(F.first("size").alias("size"), F.array_sort(F.collect_list(F.struct("items", "h"))).alias("all"))
    return common, rarest.select("n", F.explode(F.slice("all", F.lit(1), _firsts(F.col("size")).cast("int"))).alias("first"), "row").select("n", "first.h", "row").distinct()


def _found(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """digest (of the text), doc_id, item_id, similarity and word of all windows that an item contaminates."""
    items = computed_once(benchmark.select("item_id", "text"), words(F.col("text")), "ws").drop("text").where(F.size("ws") > 0).dropDuplicates()
    items = items.withColumn("row", F.xxhash64("item_id", "ws"))
    items = with_shingles(items, "shingles")
    items = cut(items, "items")
    total = items.agg(F.sum(F.size("shingles")), F.count("*")).first()
    if not total[1]:
        none = docs.where("false").select(F.md5(F.col("text").cast("binary")).alias("digest"), "doc_id")
        kind = benchmark.schema["item_id"].dataType
        return none.select("*", F.lit(None).cast(kind).alias("item_id"), F.lit(0.0).alias("similarity"), F.lit(0).cast("long").alias("word"))
    n_blocks = max(-(-total[0] // BLOCK_SHINGLES), -(-total[1] // BLOCK_ITEMS))
    block = F.pmod("row", F.lit(n_blocks))
    # the hash deals items evenly, but one may be long: what is broadcast is checked by its size
    largest = items.groupBy(block.alias("b")).agg(F.sum(F.size("shingles")).alias("n")).agg(F.max("n")).first()[0]
    put = F.broadcast if largest <= 2 * BLOCK_SHINGLES else lambda df: df
    widths = sorted({r[0] for r in items.select(F.least(F.size("ws"), F.lit(K)).alias("k")).distinct().collect()})  # 1 to 5
    return reduce(DataFrame.unionByName, [_contaminations(docs, items.where(block == i), widths, put) for i in range(n_blocks)])


def contaminations(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity and word (the first word of the best, then earliest window) of contaminated documents."""
    best = F.max(F.struct("similarity", (-F.col("word")).alias("word"))).alias("best")
    out = _found(docs, benchmark).groupBy("doc_id", "item_id").agg(best)
    return out.select("doc_id", "item_id", "best.similarity", (-F.col("best.word")).cast("long").alias("word"))


def _contaminations(docs: DataFrame, items: DataFrame, widths: list[int], put) -> DataFrame:
    known = []
    for k in widths:
        one = items.where(F.least(F.size("ws"), F.lit(K)) == k)
        at = one.select("ws", F.size("ws").alias("n"), F.explode(F.sequence(F.lit(0), F.size("ws") - k)).alias("o"))
        known.append(at.select(_shingle("ws", F.col("o"), k).alias("h"), "n", "o").withColumn("k", F.lit(k)))
    known = reduce(DataFrame.union, known).distinct()
    known = known.groupBy("h").agg(F.collect_set("n").alias("of"))
    text = docs.select("doc_id", "text", F.md5(F.col("text").cast("binary")).alias("digest"))
    apart = computed_once(text.select("digest", "text"), words(F.col("text")), "ws").drop("text")
    places = []
    for k in widths:
        p = apart.where(F.size("ws") >= k).select("digest", F.size("ws").alias("m"), "ws", F.explode(F.sequence(F.lit(0), F.size("ws") - k)).alias("i"))
        p = p.select("digest", "m", "i", _shingle("ws", F.col("i"), k).alias("h"))
        p = p.join(put(known.where(F.exists("of", lambda n: F.least(n, F.lit(K)) == k))), "h").select("digest", "m", "i", F.explode("of").alias("n"))
        places.append(p.where(F.least(F.col("n"), F.lit(K)) == k))
    places = reduce(DataFrame.unionByName, places)
    found = places.groupBy("digest", "m", "n").agg(F.array_sort(F.collect_set("i")).alias("at"))
    starts = cut(found.select("digest", "n", F.explode(_starts(F.col("n"), F.col("m"))).alias("word")), "starts")
    per_text = cut(starts.groupBy("digest").agg(F.collect_list(F.struct("n", "word")).alias("starts")), "starts-of-texts")
    # always by shuffle: growth stays in proportion, and with both sides shuffled for it the join can be split at a text with
    # many copies
    texts = computed_once(text.join(per_text.hint("merge"), "digest"), words(F.col("text")), "ws").select("digest", "doc_id", "ws", F.explode("starts").alias("start"))
    windows = texts.select("digest", "doc_id", "start.word", "start.n", F.slice("ws", F.col("start.word") + 1, F.col("start.n")).alias("ws"))
    # equal windows are one: a passage of many documents is looked up and verified once
    windows = windows.withColumn("content", F.md5(F.array_join("ws", " ")))
    windows = cut(windows, "windows")
    contents = windows.groupBy("content", "n").agg(F.first("ws").alias("ws"))
    contents = with_shingles(contents, "own").drop("ws")
    common, rarest = item_index(items)
    # shingles that no item of that length has come first in the order, and take up places without a partner
    own = contents.select("content", "n", F.size("own").alias("size"), F.explode("own").alias("s")).select("content", "n", "size", F.xxhash64("s").alias("h"))
    own = own.join(put(common), ["n", "h"]).groupBy("content", "n").agg(F.first("size").alias("size"), F.array_sort(F.collect_list(F.struct("items", "h"))).alias("all"))
    left = _firsts(F.col("size")) - (F.col("size") - F.size("all"))
    probes = own.select("content", "n", F.explode(F.slice("all", F.lit(1), F.greatest(left, F.lit(0)).cast("int"))).alias("first")).select("content", "n", "first.h")
    pairs = probes.join(put(rarest), ["n", "h"]).select("content", "n", "row").distinct()
    pairs = pairs.join(contents, ["content", "n"]).join(put(items.select("row", "item_id", "shingles")), "row")
    both = F.size(F.array_intersect("own", "shingles"))
    pairs = pairs.select("content", "n", "item_id", (both / (F.size("own") + F.size("shingles") - both)).alias("similarity"))
    pairs = cut(pairs.where(F.col("similarity") >= LEAST), "contents")
    return windows.select("digest", "doc_id", "word", "n", "content").join(pairs, ["content", "n"]).select("digest", "doc_id", "item_id", "similarity", "word")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents whose texts no item contaminates, with all columns, whatever their ids."""
    name = free(docs.columns, "contaminated")
    bad = _found(docs, benchmark).select(F.col("digest").alias(name)).distinct()
    return docs.join(bad, F.md5(F.col("text").cast("binary")).eqNullSafe(F.col(name)), "left_anti")


#: Without the index: what a scan of the windows near an aligned shingle finds. It leaves out windows whose shared shingles
#: all lie elsewhere than in the item, which ``contaminations`` does find.
SQL = """
with d as (select doc_id, string_split(trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), ' '), ' ') ws from documents),
b as (select item_id, string_split(trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), ' '), ' ') ws from benchmark),
bs as (select item_id, len(ws) n, unnest(range(0, len(ws) - 4)) o, ws from b where len(ws) >= 5),
bk as (select item_id, n, o, array_to_string(ws[o + 1 : o + 5], ' ') s from bs),
dx as (select doc_id, len(ws) m, unnest(range(0, len(ws) - 4)) i, ws from d where len(ws) >= 5),
dk as (select doc_id, m, i, array_to_string(ws[i + 1 : i + 5], ' ') s from dx),
seeds as (select distinct doc_id, item_id, n, m, i - o a from dk join bk using (s)),
slid as (select distinct doc_id, item_id, n, m, a + unnest(range(-(cast(ceil((n - 4) / 7.0) as bigint)), cast(ceil((n - 4) / 7.0) as bigint) + 1)) x from seeds),
cand as (select distinct doc_id, item_id, n, least(greatest(x, 0), greatest(m - n, 0)) p from slid),
wk as (select cand.doc_id, cand.item_id, cand.n, cand.p, dk.s from cand join dk on dk.doc_id = cand.doc_id where dk.i >= cand.p and dk.i <= cand.p + cand.n - 5),
wc as (select doc_id, item_id, n, p, s, count(*) c from wk group by doc_id, item_id, n, p, s),
ic as (select item_id, s, count(*) c from bk group by item_id, s),
j as (select wc.doc_id, wc.item_id, wc.n, wc.p, sum(wc.c) total, sum(least(wc.c, coalesce(ic.c, 0))) shared
      from wc left join ic on ic.item_id = wc.item_id and ic.s = wc.s group by wc.doc_id, wc.item_id, wc.n, wc.p),
sim as (select doc_id, item_id, p, cast(shared as double) / (total + n - 4 - shared) similarity from j),
best as (select *, row_number() over (partition by doc_id, item_id order by similarity desc, p) r from sim where similarity >= 0.75)
select doc_id, item_id, similarity, cast(p as bigint) word from best where r = 1
"""
