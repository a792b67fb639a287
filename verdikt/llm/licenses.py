"""License scan by ordered signature rules, with DataFrame functions only.

A text's words (runs of anything but ASCII non-alphanumerics, A-Z lower-cased), joined by single spaces, are searched with
the ordered rules of ``license_rules``: hundreds of hand-written signatures of license texts, notices and links, and
patterns of license names, each as an SPDX tag, in a grant, and before a license word.

A rule runs only on texts that hold its keywords: sets of words, derived from its pattern, of each of which every match
holds one. Rules come as a broadcast table of fixed size, dealt by their rarest keyword.

Detections are resolved in order of priority, then length, then place, then rule: one stays if it overlaps none that
stayed before. So what lies within a better one goes, and what has gone itself pushes nothing aside. Only detections that
a chain of overlaps joins are compared, so the cost is quadratic in the longest such chain, not in the text.

Base phrases are counted apart and always stay: every place where a phrase's words stand consecutively.

Defined results: a null or empty text has no words and no labels, first and last word are null, score is 0. Rows that
repeat a doc_id each get their row; null doc_ids are kept; an empty table gives no rows; only doc_id and text are read.
The score is 1 for a tag, 0.95 for a grant, 0.8 for a name, 0.7 for a base phrase, 0.5 for a signature; the best counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .decontam import computed_once, words
from .license_rules import keywords, rules

#: Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
BASE_CONFIDENCE = 0.7
_DETECTION = "array<struct<start:bigint,stop:bigint,label:string,priority:int,confidence:double>>"


def _spaces(c):
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def whole(pattern: str) -> str:
    """The pattern for whole words of a text with single spaces."""
    return f"(?<![^ ])(?:{pattern})(?![^ ])"


def gated(rows: DataFrame) -> DataFrame:
    """doc_id, td, canon and r (a rule) of ``rows`` (doc_id, td, ws, canon), for the rules whose keywords the text holds."""
    table = [(k, label, priority, confidence, whole(pattern), keywords(pattern)) for k, (label, priority, confidence, pattern) in enumerate(rules())]
    frame = rows.sparkSession.createDataFrame(table, "rule int, label string, priority int, confidence double, regex string, needs array<array<string>>")
    by_word = frame.select(F.explode(F.get("needs", F.lit(0))).alias("keyword"), F.struct("rule", "label", "priority", "confidence", "regex", "needs").alias("r"))
    by_word = F.broadcast(by_word.groupBy("keyword").agg(F.collect_list("r").alias("rules")))  # some hundred words, by construction
    all_ = F.array(*map(F.lit, sorted({w for r in table for s in r[5] for w in s})))
    first = F.array(*map(F.lit, sorted({w for r in table for w in r[5][0]})))
    some = computed_once(rows, F.array_intersect("ws", all_), "present")
    some = some.select("doc_id", "td", "canon", "present", F.explode(F.array_intersect("present", first)).alias("keyword"))
    some = some.join(by_word, "keyword").select("doc_id", "td", "canon", "present", F.explode("rules").alias("r"))
    return some.where(F.forall("r.needs", lambda s: F.arrays_overlap(s, F.col("present")))).select("doc_id", "td", "canon", "r")


def _resolved(found):
    """Of detections in order of precedence those that overlap none kept before."""
    clear = lambda kept, x: ~F.exists(kept, lambda y: (y["start"] < x["stop"]) & (x["start"] < y["stop"]))
    one = lambda x: F.struct(*(x[c].alias(c) for c in ("start", "stop", "label", "priority", "confidence")))
    return F.aggregate(found, F.array().cast(_DETECTION), lambda kept, x: F.when(clear(kept, x), F.concat(kept, F.array(one(x)))).otherwise(kept))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, base and detections (arrays of label, word, words; detections with priority and confidence)."""
    rows = computed_once(docs.select("doc_id", "text"), words(F.col("text")), "ws").drop("text")
    rows = computed_once(rows, F.array_join("ws", " "), "canon")
    key = F.md5("canon").alias("td")
    hits = gated(rows.select("doc_id", key, "ws", "canon")).where(F.regexp_like("canon", F.col("r.regex")))
    matches = F.regexp_extract_all("canon", F.col("r.regex"), F.lit(0))
    cuts = F.posexplode(F.arrays_zip(F.split("canon", F.col("r.regex"), -1).alias("piece"), matches.alias("match"))).alias("k", "m")
    hits = hits.select("doc_id", "td", "r.rule", "r.label", "r.priority", "r.confidence", cuts).where("m.match is not null")
    hits = hits.select("doc_id", "td", "rule", "label", "priority", "confidence", "k", _spaces(F.col("m.piece")).alias("before"), _spaces(F.col("m.match")).alias("inside")).distinct()
    hits = cut(hits, "license-hits")
    w = Window.partitionBy("doc_id", "td", "rule").orderBy("k")
    start = F.sum("before").over(w) + F.coalesce(F.sum("inside").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hits = hits.withColumn("start", start).withColumn("stop", start + F.col("inside") + 1)
    # detections that no chain of overlaps joins don't concern one another
    w = Window.partitionBy("doc_id", "td").orderBy("start", F.desc("stop"), "rule")
    apart = F.coalesce(F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1)) <= F.col("start"), F.lit(True))
    hits = hits.withColumn("apart", apart.cast("long")).withColumn("island", F.sum("apart").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    precedence = F.struct("priority", (F.col("start") - F.col("stop")).alias("shortness"), "start", "rule", "stop", "label", "confidence")
    islands = hits.groupBy("doc_id", "td", "island").agg(_resolved(F.array_sort(F.collect_list(precedence))).alias("kept"))
    one = F.struct("x.start", "x.label", (F.col("x.stop") - F.col("x.start")).alias("words"), "x.priority", "x.confidence")
    hits = islands.select("doc_id", "td", F.explode("kept").alias("x")).groupBy("doc_id", "td").agg(F.array_sort(F.collect_list(one)).alias("found"))
    hits = hits.toDF("hit_id", "hit_td", "found")

    def places(phrase: str):
        parts = phrase.split(" ")
        same = lambda i: F.forall(F.array(*(F.coalesce(F.get("ws", i + j) == p, F.lit(False)) for j, p in enumerate(parts))), lambda x: x)
        at = F.filter(F.sequence(F.lit(0), F.greatest(F.size("ws") - 1, F.lit(0))), same)
        return F.transform(at, lambda i: F.struct(i.alias("start"), F.lit(BASE[phrase]).alias("label"), F.lit(len(parts)).alias("words")))

    has = F.col("canon").rlike(f"(?:^| )(?:{'|'.join(BASE)})(?: |$)")
    none = F.array().cast("array<struct<start:int,label:string,words:int>>")
    base = F.when(has, F.array_sort(F.concat(*map(places, BASE)))).otherwise(none)
    out = rows.select("doc_id", key, F.size("ws").cast("long").alias("n_words"), base.alias("base"))
    out = out.join(hits, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("td") == F.col("hit_td")), "left")
    empty = F.array().cast("array<struct<start:bigint,label:string,words:bigint,priority:int,confidence:double>>")
    found = F.coalesce("found", empty)
    as_long = lambda x: F.struct(x["label"].alias("label"), x["start"].cast("long").alias("word"), x["words"].cast("long").alias("words"))
    rich = lambda x: F.struct(x["label"].alias("label"), x["start"].cast("long").alias("word"), x["words"].cast("long").alias("words"), x["priority"].alias("priority"), x["confidence"].alias("confidence"))
    return out.select("doc_id", "n_words", F.transform("base", as_long).alias("base"), F.transform(found, rich).alias("detections"))


def digest(out: DataFrame) -> DataFrame:
    starts = F.transform("base", lambda x: x["word"])
    joined = lambda *c: F.array_join(F.array_sort(F.array_distinct(F.concat(*(F.transform(x, lambda y: y["label"]) for x in c)))), ",")
    base = F.when(F.size("base") > 0, F.lit(BASE_CONFIDENCE)).otherwise(0.0)
    best = F.greatest(base, F.coalesce(F.array_max(F.transform("detections", lambda x: x["confidence"])), F.lit(0.0)))
    return out.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), joined("base").alias("base_labels"), joined("base", "detections").alias("labels"), best.alias("score"))
