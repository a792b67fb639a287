"""Queries over vectors, retrieval and routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr as E
from ..operators import metrics as M
from ..operators import rank as R
from ..operators.running import average_ranks
from ..sources.shared import settled
from . import tables as T
from .util import Query, tidy

#: emb: one row for each vector component; cen: label, i, v (unit centroid of the centroid half); sc: test vectors by label.
EMB = f"""with ev as (select vec_id, label, embedding, {T.sql_unit("cast(vec_id as varchar) || ':c'")} u from embeddings where label is not null and embedding is not null),
emb as (select vec_id, label, u < 0.5::double half, unnest(range(1, len(embedding) + 1)) i, embedding from ev), em as (select vec_id, label, half, i, embedding[i]::double v from emb),
cm as (select label, i, avg(v) v from em where half group by label, i), cn as (select label, sqrt(sum(v * v)) nrm from cm group by label), cen as (select cm.label, i, v / nrm v from cm join cn using (label)),
vn as (select vec_id, sqrt(sum(v * v)) nrm from em where not half group by vec_id),
sc as (select em.vec_id, max(em.label) gold, cen.label cand, 10 * sum(em.v * cen.v) / max(vn.nrm) score from em join vn using (vec_id) join cen using (i) where not half group by em.vec_id, cen.label),
rk as (select *, row_number() over (partition by vec_id order by score desc, cand) r from sc)"""


def centroid_norms(spark, d):
    e = T.table(spark, d, "embeddings").where("label is not null and embedding is not null")
    c = R.centroids(e)
    return tidy(c.select(F.col("label").cast("long").alias("label"), F.get("centre", F.lit(0)).alias("first"), F.get("centre", F.lit(63)).alias("last"), E.norm("centre").alias("length")))


def routing_recall(spark, d):
    return tidy(R.recall_at(T.emb_decisions(spark, d), ["vec_id"], "gold", [1, 2, 3, 5, 10]))


def routing_metrics(spark, d):
    x = R.ranked(T.emb_decisions(spark, d), ["vec_id"]).withColumn("rel", F.when(F.col("cand") == F.col("gold"), 2).otherwise(F.when(F.abs(F.col("cand") - F.col("gold")) == 1, 1).otherwise(0)))
    a = R.ndcg(x, ["vec_id"]).join(R.reciprocal_rank(x, ["vec_id"], F.col("rel") == 2), "vec_id")
    return tidy(a.agg(F.count("*").alias("n"), F.avg("ndcg").alias("ndcg5"), F.avg("rr").alias("mrr"), F.avg(F.col("recalled").cast("double")).alias("recall3")))


METRICS = f"""{EMB}, x as (select *, case when cand = gold then 2 when abs(cand - gold) = 1 then 1 else 0 end rel from rk), y as (select *, row_number() over (partition by vec_id order by rel desc) ir from x),
q as (select vec_id, sum(case when r <= 5 then (pow(2, rel) - 1) / log2(r + 1) else 0 end) dcg, sum(case when ir <= 5 then (pow(2, rel) - 1) / log2(ir + 1) else 0 end) best, min(case when rel = 2 then r end) f from y group by vec_id)
select count(*) n, round(avg(dcg / best), 6) ndcg5, round(avg(coalesce(1::double / f, 0)), 6) mrr, round(avg((coalesce(f, 99) <= 3)::int), 6) recall3 from q"""


def shortlists(spark, d):
    s = R.shortlist(T.emb_decisions(spark, d), ["vec_id"], 3)
    return s.select("vec_id", F.array_join(F.transform("shortlist", lambda x: x.cast("string")), ",").alias("shortlist"))


def _read(level, g):
    """A read's score: the candidate's own with an error that depends on the level and the group it is read in."""
    seen = F.concat_ws(":", F.col("vec_id").cast("string"), level.cast("string"), g.cast("string"), F.col("cand").cast("string"))
    return F.round(F.col("score") + 6.0 * (E.hash_unit(seen, F.lit("r"), buckets=1000) - 0.5), 9)


def tournaments(spark, d):
    """Tournaments in groups of three over all candidates and over shortlists of seven and five, and one read of the three
    best: accuracy, recall of the final, accuracy where it is recalled, and reads."""
    x = T.emb_decisions(spark, d).withColumn("score", F.round("score", 9))
    r = R.ranked(x, ["vec_id"])
    arms = {"full": x, "seven": r.where("rank <= 7").drop("rank"), "five": r.where("rank <= 5").drop("rank"), "read": r.where("rank <= 3").drop("rank")}
    out = None
    for name, one in arms.items():
        one = R.tournament(one, ["vec_id", "gold"], 3, _read).withColumn("kind", F.lit(name))
        out = one if out is None else out.unionByName(one)
    hit = (F.col("winner") == F.col("gold")).cast("double")
    return tidy(out.groupBy("kind").agg(F.count("*").alias("n"), F.avg(hit).alias("accuracy"), F.avg(F.col("gold_in_final").cast("double")).alias("recall"), F.avg(F.when(F.col("gold_in_final"), hit)).alias("accuracy_recalled"), F.avg("reads").alias("reads")))


_SEEN = "round(score + 6 * (" + T.sql_unit("vec_id || ':{l}:' || {g} || ':' || cand || ':r'", 1000) + " - 0.5::double), 9)"
TOURNAMENTS = f"""{EMB}, al as (select 'full' kind, vec_id, gold, cand, round(score, 9) score from rk union all select 'seven', vec_id, gold, cand, round(score, 9) from rk where r <= 7
  union all select 'five', vec_id, gold, cand, round(score, 9) from rk where r <= 5 union all select 'read', vec_id, gold, cand, round(score, 9) from rk where r <= 3),
p0 as (select *, row_number() over (partition by kind, vec_id order by cand) - 1 pos, count(*) over (partition by kind, vec_id) n from al),
n0 as (select *, case when n <= 3 then -pos - 1 else pos // 3 end g from p0), s0 as (select *, {_SEEN.format(l=0, g='g')} s from n0),
w0 as (select *, case when n <= 3 then 0 else ceil(n / 3) end reads from (select *, row_number() over (partition by kind, vec_id, g order by s desc, cand) b from s0) where b = 1),
p1 as (select kind, vec_id, gold, cand, score, reads, row_number() over (partition by kind, vec_id order by cand) - 1 pos, count(*) over (partition by kind, vec_id) n from w0),
n1 as (select *, case when n <= 3 then -pos - 1 else pos // 3 end g from p1), s1 as (select *, {_SEEN.format(l=1, g='g')} s from n1),
w1 as (select * replace (reads + case when n <= 3 then 0 else ceil(n / 3) end as reads) from (select *, row_number() over (partition by kind, vec_id, g order by s desc, cand) b from s1) where b = 1),
lv as (select kind, max(n) m from p0 group by kind),
f as (select w1.*, {_SEEN.replace("':{l}:'", "':' || (case when m > 9 then 2 when m > 3 then 1 else 0 end) || ':'").format(g=0)} fin from w1 join lv using (kind)),
z as (select kind, vec_id, gold, arg_max(cand, (fin, -cand)) winner, max(reads) + 1 reads, max((cand = gold)::int) inside from f group by kind, vec_id, gold)
select kind, count(*) n, round(avg((winner = gold)::int), 6) accuracy, round(avg(inside), 6) recall, round(avg(case when inside = 1 then (winner = gold)::int end), 6) accuracy_recalled, round(avg(reads), 6) reads from z group by kind"""


def dealt(spark, d):
    """Where queries are lost with four of the best eight in each of two dealt groups and a final."""
    x = T.emb_decisions(spark, d)
    g = R.dealt_groups(R.ranked(x, ["vec_id"]).where("rank <= 8").drop("rank"), ["vec_id"], 2)
    gold = R.ranked(x, ["vec_id"]).where("cand = gold").select("vec_id", F.col("rank").alias("gold_rank"))
    won = g.where("cand = gold").select("vec_id", "wins")
    out = gold.join(won, "vec_id", "left").withColumn("where", R.loss_diagnosis(F.col("gold_rank"), 8, F.coalesce("wins", F.lit(False)), F.col("gold_rank") == 1))
    return tidy(out.groupBy("where").agg(F.count("*").alias("n")))


DEALT = f"""{EMB}, g as (select *, (r - 1) % 2 g from rk where r <= 8), w as (select *, row_number() over (partition by vec_id, g order by score desc, cand) = 1 wins from g),
o as (select rk.vec_id, rk.r gr, coalesce(w.wins, false) wins from rk left join w on w.vec_id = rk.vec_id and w.cand = rk.cand where rk.cand = rk.gold)
select case when gr = 1 then 'correct' when gr > 8 then 'not_shortlisted' when not wins then 'lost_in_group' else 'lost_in_final' end "where", count(*) n from o group by 1"""


def look_alikes(spark, d):
    """Groups dealt from the best eight, in two and in four, with a final that is read with an error: how many of the three best
    candidates stand beside the gold, and how often it is lost beside them."""
    x = settled(T.emb_decisions(spark, d).withColumn("score", F.round("score", 9)), "scores")
    n = x.select("vec_id").distinct().count()
    out = None
    for groups in (2, 4):
        g = settled(R.dealt_groups(x, ["vec_id"], groups, 8), "dealt")
        seen = F.round(F.col("score") + 6.0 * (E.hash_unit("vec_id", F.lit("final"), "cand", buckets=1000) - 0.5), 9)
        won = g.where("wins").groupBy("vec_id").agg(F.max_by("cand", F.struct(seen, -F.col("cand"))).alias("said"), F.max("gold").alias("gold"))
        reads = R.gold_reads(g, ["vec_id"], won.select("vec_id", (F.col("said") == F.col("gold")).alias("correct")), 3)
        one = R.read_difficulty(reads.withColumn("groups", F.lit(groups)), ["groups"], F.lit(n))
        out = one if out is None else out.unionByName(one)
    return tidy(out)


_LOOK = """select groups, vec_id, 0 n, sum((r <= 3 and cand <> gold)::int) look from gi where g = gg group by all union all select groups, vec_id, 1, sum((r <= 3 and cand <> gold)::int) from gi where wins and gw group by all"""
LOOK_ALIKES = f"""{EMB}, kk as (select unnest([2, 4]) as groups), gd as (select groups, vec_id, cand, gold, r, round(score, 9) score, (r - 1) % groups g, row_number() over (partition by groups, vec_id, (r - 1) % groups order by round(score, 9) desc, cand) = 1 wins from rk, kk where r <= 8),
gi as (select gd.*, o.g gg, o.wins gw from gd join (select groups, vec_id, g, wins from gd where cand = gold) o using (groups, vec_id)),
fi as (select groups, vec_id, arg_max(cand, (round(score + 6 * ({T.sql_unit("vec_id || ':final:' || cand", 1000)} - 0.5::double), 9), -cand)) = max(gold) ok from gd where wins group by groups, vec_id),
re as ({_LOOK}), ls as (select re.*, not ok and n = gw::int lost from re join fi using (groups, vec_id) join (select distinct groups, vec_id, gw from gi) using (groups, vec_id))
select groups::bigint as groups, round(avg(case when n = 0 then look end), 6) look_in_group, round(avg(case when n = 1 then look end), 6) look_in_final, round(sum((look > 0)::int) / (select count(distinct vec_id) from rk), 6) hard_reads,
 round(avg(case when look > 0 then lost::int end), 6) lost_hard, round(avg(case when look = 0 then lost::int end), 6) lost_easy from ls group by groups"""


def bm25_benchmark(spark, d):
    """The five best documents for each benchmark item by character bigrams, of whole texts."""
    q = T.table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.lower("text").alias("text"))
    c = T.table(spark, d, "documents").select(F.col("doc_id").alias("pid"), F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    s = R.bm25(q, c, 5)
    return tidy(R.ranked(s.withColumn("score", F.round("score", 9)), ["qid"], tie="pid").select("qid", "rank", "score"))


_BG = "regexp_replace({t}, '\\s', '', 'g')"
BM25 = f"""with c as (select doc_id pid, {_BG.format(t="lower(coalesce(text, ''))")} t from documents), q as (select item_id qid, {_BG.format(t="lower(text)")} t from benchmark),
cg as (select pid, substr(t, i, 2) g from (select pid, t, unnest(range(1, length(t))) i from c)), qg as (select distinct qid, substr(t, i, 2) g from (select qid, t, unnest(range(1, length(t))) i from q)),
tf as (select pid, g, count(*) tf from cg group by pid, g), ln as (select pid, greatest(length(t) - 1, 0) len from c), st as (select count(*) n, avg(len) al from ln), df as (select g, count(*) df from tf group by g),
s as (select qid, pid, round(sum(ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * len / al))), 9) score from qg join df using (g) join tf using (g) join ln using (pid), st group by qid, pid),
r as (select *, row_number() over (partition by qid order by score desc, pid) k from s) select qid, k "rank", round(score, 6) score from r where k <= 5"""


def rank_correlation(spark, d):
    """Spearman correlation of price and quantity, with the prices' average ranks summed as a check."""
    x = T.table(spark, d, "lineitem").select("l_returnflag", F.round("l_extendedprice", 0).alias("price"), "l_quantity")
    by = ["l_returnflag"]
    pb, qb = F.floor(F.col("price") / 200.0), F.floor("l_quantity")
    out = M.spearman(x, by, "price", "l_quantity", pb, qb)
    s = average_ranks(x, by, "price", pb).groupBy(*by).agg(F.sum(F.col("rank") * F.col("n")).alias("ranks"), F.max("n").alias("largest_tie"))
    return tidy(out.join(s, by))


SPEARMAN = """with x as (select l_returnflag, round(l_extendedprice, 0) p, l_quantity q from lineitem),
r as (select l_returnflag, p, rank() over (partition by l_returnflag order by p) + (count(*) over (partition by l_returnflag, p) - 1) / 2::double a, rank() over (partition by l_returnflag order by q) + (count(*) over (partition by l_returnflag, q) - 1) / 2::double b, count(*) over (partition by l_returnflag, p) n from x)
select l_returnflag, round(corr(a, b), 6) spearman, round(sum(a), 6) ranks, max(n) largest_tie from r group by l_returnflag"""


def centred(spark, d):
    """Vectors less their label's mean, at unit length: the mean cosine with the label's centroid before and after."""
    e = T.table(spark, d, "embeddings").where("label is not null and embedding is not null")
    x = e.select("vec_id", "label", F.posexplode("embedding").alias("i", "v"))
    m = x.groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    y = x.join(m, ["label", "i"]).withColumn("w", F.col("v") - F.col("m"))
    v = y.groupBy("label", "vec_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("len"), F.sum(F.abs("w")).alias("l1"))
    return tidy(v.groupBy("label").agg(F.count("*").alias("n"), F.avg("len").alias("mean_length"), F.avg(F.col("l1") / F.col("len")).alias("unit_l1")))


CENTRED = """with x as (select vec_id, label, unnest(range(1, len(embedding) + 1)) i, embedding from embeddings where label is not null and embedding is not null), y as (select vec_id, label, i, embedding[i]::double v from x),
m as (select label, i, avg(v) m from y group by label, i), v as (select y.label, vec_id, sqrt(sum(pow(y.v - m.m, 2))) len, sum(abs(y.v - m.m)) l1 from y join m on y.label = m.label and y.i = m.i group by y.label, vec_id)
select label, count(*) n, round(avg(len), 6) mean_length, round(avg(l1 / len), 6) unit_l1 from v group by label"""

def dealt_with_fillers(spark, d):
    """The best four candidates dealt to two groups, with one filler each from the ranks after six: sizes of the groups, and
    how often their winners, the likeliest of each, hold the gold one."""
    x = T.emb_decisions(spark, d)
    g = R.dealt_groups(x, ["vec_id"], 2, k=4, fillers=1, filler_from=6)
    one = g.groupBy("vec_id", "g").agg(F.count("*").alias("size"), F.max(F.when(F.col("rank") > 6, F.col("rank"))).alias("filler"), F.max((F.col("wins") & (F.col("cand") == F.col("gold"))).cast("int")).alias("gold_wins"))
    return tidy(one.groupBy("g").agg(F.count("*").alias("n"), F.avg("size").alias("size"), F.avg("filler").alias("filler"), F.avg(F.col("gold_wins").cast("double")).alias("gold_wins")))


FILLED = f"""{EMB}, g as (select *, (case when r > 6 then r - 6 else r end - 1) % 2 g from rk where r <= 4 or (r > 6 and r <= 8)), w as (select *, row_number() over (partition by vec_id, g order by score desc, cand) = 1 wins from g),
o as (select vec_id, g, count(*) size, max(case when r > 6 then r end) filler, max((wins and cand = gold)::int) gw from w group by vec_id, g) select g::bigint g, count(*) n, round(avg(size), 6) size, round(avg(filler), 6) filler, round(avg(gw), 6) gold_wins from o group by g"""

QUERIES: dict[str, Query] = {
    "a39_centroids": (centroid_norms, """with x as (select label, unnest(range(1, 65)) i, embedding from embeddings where label is not null and embedding is not null), m as (select label, i, avg(embedding[i]::double) v from x group by label, i),
 n as (select label, sqrt(sum(v * v)) nrm from m group by label) select label::bigint label, round(max(case when i = 1 then v / nrm end), 6) "first", round(max(case when i = 64 then v / nrm end), 6) "last", round(sqrt(sum(v / nrm * v / nrm)), 6) length from m join n using (label) group by label"""),
    "a31_routing_recall": (routing_recall, f"{EMB}, k as (select unnest([1, 2, 3, 5, 10]) k) select k::bigint k, round(sum((r <= k)::int) / count(*), 6) recall from rk, k where cand = gold group by k"),
    "a29_routing_metrics": (routing_metrics, METRICS),
    "t02_shortlist": (shortlists, f"{EMB} select vec_id, string_agg(cast(cand as varchar), ',' order by cand) shortlist from rk where r <= 3 group by vec_id"),
    "r01_tournament": (tournaments, TOURNAMENTS),
    "r05_loss_diagnosis": (dealt, DEALT),
    "r05_look_alikes": (look_alikes, LOOK_ALIKES),
    "r04_dealt_fillers": (dealt_with_fillers, FILLED),
    "c31_bm25": (bm25_benchmark, BM25),
    "a25_spearman": (rank_correlation, SPEARMAN),
    "a40_centred": (centred, CENTRED),
}
