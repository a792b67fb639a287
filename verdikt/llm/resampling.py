"""Importance resampling towards a target distribution, from hashed n-gram counts.

A position table holds a row for each word of a text. Runs of n words come from ``lead()`` over the positions of a
document, n - 1 of them joined to the word; runs of one word need none, so no window then. Every run is hashed into a
bucket, runs are grouped by bucket over all documents and over all target texts, and a bucket's gain is how much likelier
the target draws it (add-one smoothing over the buckets), in thousandths of a nat, floored. A document's weight is the sum
of its runs' gains: runs are joined with the gains, a table of as many rows as there are buckets, which bounds what is
broadcast, and added up by document before they are shuffled.

A Gumbel number derived from the document's id is added to its weight; the documents with the highest sums are a sample
without replacement in proportion to the weights. Ranks come from a range sort written once, with the places in a partition
counted on from the partitions before it, so no task holds more than its range.

Defined results: a null or empty text has no words, no runs and weight 0, and isn't drawn, as no text of fewer than
``least_words`` words is. Rows that repeat a doc_id are drawn on their own, with equal Gumbel numbers; equal scores go by
doc_id, null last, and then by a digest of the text. A null doc_id has the Gumbel number of an empty name. Without target
texts, or without documents, the counts are 0, and an empty table gives no rows. A text of any length is read whole; its
words are rows and its runs of one word never meet in one task; for longer runs a document's positions are one window,
which Spark sorts and spills. Only doc_id, text and the target's text are read, whatever other columns are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .decontam import computed_once, words

BUCKETS, SEED, PERCENT, LEAST_WORDS = 10_000, 2024, 10, 20


def runs(texts: DataFrame, shortest: int, longest: int) -> DataFrame:
    """The columns of ``texts`` (keys, and words ws), run (words joined by one space), n, and first: all runs of ``shortest``
    to ``longest`` words. Rows of equal keys are copies: n counts them, and first is true for one run or null of each."""
    keys = [c for c in texts.columns if c != "ws"]
    table = texts.select(*keys, F.posexplode_outer("ws").alias("pos", "word"))
    start = F.coalesce(F.col("pos") == 0, F.lit(True))
    if longest == 1:
        return table.select(*keys, F.col("word").alias("run"), F.lit(1).cast("long").alias("n"), start.alias("first"))
    table = table.groupBy(*keys, "pos", "word").agg(F.count("*").alias("n"))
    here = Window.partitionBy(*keys).orderBy("pos")
    following = [F.col("word"), *(F.lead("word", k).over(here) for k in range(1, longest))]
    # null where the text ends before the run does
    found = F.array_compact(F.array(*(F.when(following[n - 1].isNotNull(), F.concat_ws(" ", *following[:n])) for n in range(shortest, longest + 1))))
    table = table.select(*keys, "n", start.alias("start"), found.alias("found"))
    return table.select(*keys, "n", "start", F.posexplode_outer("found").alias("k", "run")).select(*keys, "run", "n", (F.col("start") & F.coalesce(F.col("k") == 0, F.lit(True))).alias("first"))


def bucket(run: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(run.cast("binary")), F.lit(buckets)).cast("int")


def hashed(texts: DataFrame, shortest: int, longest: int, buckets: int) -> DataFrame:
    """The runs' rows with their buckets, null for none."""
    return runs(texts, shortest, longest).withColumn("bucket", bucket(F.col("run"), buckets)).drop("run")


def _counted(rows: DataFrame, name: str) -> DataFrame:
    return rows.where("bucket is not null").groupBy("bucket").agg(F.sum("n").alias(name))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket and gain, a row for each bucket, from counts of ``source`` (bucket, s) and ``target`` (bucket, t)."""
    all_ = source.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    x = cut(all_.join(source, "bucket", "left").join(target, "bucket", "left").select("bucket", *(F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("s", "t"))), "run-counts")
    s, t = x.agg(F.sum("s"), F.sum("t")).first()  # two numbers
    ratio = (F.col("t") + 1) * F.lit(s + buckets) / ((F.col("s") + 1) * F.lit(t + buckets))
    return x.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def gumbel(doc_id: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)) of a number u between 0 and 1 from the id's digest."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256).substr(1, 8)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(u)))


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with ``place``, 1, 2, 3 ... in a total ``order``; no task holds more than a range of it."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    within = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    sorted_ = cut(sorted_.withColumns({"part": F.spark_partition_id(), "within": within}), "ranked")
    sizes = sorted_.groupBy("part").agg(F.count("*").alias("size"))  # a row for each partition
    before = F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("part", before.alias("before"))
    return sorted_.join(F.broadcast(starts), "part").withColumn("place", F.col("before") + F.col("within") + 1).drop("part", "within", "before")


def resample(docs: DataFrame, target: DataFrame, shortest: int = 1, longest: int = 1, buckets: int = BUCKETS, seed: int = SEED, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null: not drawn) of every document; ``target``: text."""
    if not 1 <= shortest <= longest:
        raise ValueError("runs have at least one word")
    digest = F.xxhash64("text").alias("digest")  # tells apart the texts of one doc_id, whatever the order of the rows
    texts = computed_once(docs.select("doc_id", digest, "text"), words(F.col("text")), "ws").select("doc_id", "digest", F.size("ws").alias("n_words"), "ws")
    aims = target.select(digest, words(F.col("text")).alias("ws"))
    gain = gains(_counted(hashed(texts.select("doc_id", "digest", "ws"), shortest, longest, buckets), "s"), _counted(hashed(aims, shortest, longest, buckets), "t"), buckets)
    # a row for each bucket; the runs of a document lie together, so they are added up before they are shuffled
    found = hashed(texts, shortest, longest, buckets).join(F.broadcast(gain), "bucket", "left")
    counted = F.sum(F.when(F.col("gain").isNotNull(), F.col("n")))
    found = found.groupBy("doc_id", "digest", "n_words").agg(counted.alias("features"), F.sum(F.col("n") * F.col("gain")).alias("gained"), F.sum(F.when(F.col("first"), F.col("n"))).alias("copies"))
    each = lambda c: F.call_function("div", F.coalesce(c, F.lit(0)).cast("long"), F.col("copies"))
    found = found.select("doc_id", "digest", "n_words", each("features").alias("n_features"), each("gained").alias("weight"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    scored = found.select("doc_id", "digest", "n_features", "weight", (F.col("weight") + gumbel(F.col("doc_id"), seed)).alias("score"), (F.col("n_words") >= least_words).alias("eligible"))
    out = ranked(scored, F.desc("eligible"), F.desc("score"), F.col("doc_id").asc_nulls_last(), F.col("digest"))
    drawn = out.where("eligible").count() * percent // 100
    return out.select("doc_id", "n_features", "weight", "score", F.when(F.col("eligible") & (F.col("place") <= drawn), F.col("place")).alias("rank"))


#: Arrays instead of a position table; CRC-32 from its polynomial, over different words only.
SQL = """
with crc as (select list(v order by i) tab from (select i, list_reduce(list_concat([i], range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) v from range(256) r(i))),
w as (select 'd' side, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) word from documents
  union all select 'b', item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) from benchmark),
d as (select word, hex(encode(word)) h from (select distinct word from w)),
hashed as (select word, xor(list_reduce(list_concat([4294967295], list_transform(range(length(h) // 2), lambda i: cast('0x' || substr(h, 2 * i + 1, 2) as bigint))), lambda c, b: xor(c >> 8, tab[1 + (xor(c, b) & 255)])), 4294967295) % 10000 bucket from d, crc),
f as (select side, doc_id, bucket from w join hashed using (word)),
n as (select b.bucket, (select count(*) from f where side = 'd')::double alls, (select count(*) from f where side = 'b')::double allt, count(*) filter (side = 'd')::double s, count(*) filter (side = 'b')::double t
  from range(10000) b(bucket) join f using (bucket) group by b.bucket),
g as (select bucket, floor(1000 * ln((t + 1) * (alls + 10000) / ((s + 1) * (allt + 10000))))::bigint gain from n),
x as (select doc_id, count(*) n_features, sum(gain)::bigint weight from f join g using (bucket) where side = 'd' group by doc_id),
y as (select d.doc_id, coalesce(n_features, 0) n_features, coalesce(weight, 0) weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((cast('0x' || substr(sha256('2024:' || cast(d.doc_id as varchar)), 1, 8) as bigint) + 0.5::double) / 4294967296::double)))::bigint score from documents d left join x using (doc_id)),
z as (select doc_id, row_number() over (order by score desc, doc_id) place, count(*) over () docs from y where n_features >= 20)
select y.doc_id, n_features, weight, score, case when place <= 10 * docs // 100 then place end as rank from y left join z using (doc_id)
"""
