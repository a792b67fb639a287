"""Composite reports: ladders, usability, interference, priors, insufficiency, mass, folds and reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr as E
from ..operators import calibrate as C
from ..operators import metrics as M
from ..operators import paired as P
from ..operators import quality as Q
from ..operators import split as S
from ..operators.running import percentiles, unit_bucket
from ..sources.shared import settled
from . import tables as T
from .policies import _PAIR
from .ranking import EMB
from .scoring import _RAW, rows
from .util import Query, tidy


def _arms(spark, d, values=("correct", "chosen", "conf", "p")):
    return P.pair(rows(spark, d, "AB"), "A", "B", ["task", "id", "hard_type", "lang", "gold"], list(values))


def ladder(spark, d):
    """Each slice's two accuracies, the paired test and a status: a difference counts from two points and p < 0.05."""
    x = _arms(spark, d)
    by = ["task", "lang"]
    m = P.mcnemar(x, by)
    a = x.groupBy(*by).agg(F.avg(F.col("correct_a").cast("double")).alias("acc_a"), F.avg(F.col("correct_b").cast("double")).alias("acc_b"))
    gap = F.col("acc_b") - F.col("acc_a")
    status = F.when(F.col("p_value") >= 0.05, "no difference").when(gap >= 0.02, "better").when(gap <= -0.02, "worse").otherwise("small")
    return tidy(a.join(m, by).select(*by, "acc_a", "acc_b", "only_a", "only_b", status.alias("status")))


LADDER = f"""{_PAIR}, x as (select pr.task, dec.lang, ca, cb from pr join dec on dec.arm = 'A' and dec.task = pr.task and dec.id = pr.id and dec.hard_type = pr.hard_type),
s as (select task, lang, avg(ca::int) acc_a, avg(cb::int) acc_b, sum((ca and not cb)::int)::bigint only_a, sum((cb and not ca)::int)::bigint only_b from x group by task, lang),
t as (select task, lang, only_a + only_b m, unnest(range(0, least(only_a, only_b) + 1)) i from s), u as (select task, lang, least(1, 2 * sum(exp(lgamma(m + 1) - lgamma(i + 1) - lgamma(m - i + 1) - m * ln(2::double)))) pv from t group by task, lang)
select task, lang, round(acc_a, 6) acc_a, round(acc_b, 6) acc_b, only_a, only_b, case when pv >= 0.05::double then 'no difference' when acc_b - acc_a >= 0.02::double then 'better' when acc_b - acc_a <= -0.02::double then 'worse' else 'small' end status from s join u using (task, lang)"""


def usability(spark, d):
    """Whether arm B can stand in for arm A: agreement of 98 %, accuracies within a point."""
    x = _arms(spark, d)
    a = x.groupBy("task").agg(F.avg((F.col("chosen_a") == F.col("chosen_b")).cast("double")).alias("agreement"), (F.avg(F.col("correct_b").cast("double")) - F.avg(F.col("correct_a").cast("double"))).alias("gap"))
    return tidy(a.withColumn("usable", (F.col("agreement") >= 0.98) & (F.abs("gap") <= 0.01)))


def interference(spark, d):
    """How often arm B loses what arm A had right, by A's confidence band, and the mean shift of confidence."""
    x = _arms(spark, d).withColumn("band", F.floor(F.least(F.col("conf_a"), F.lit(0.999999)) * 5).cast("int"))
    return tidy(x.groupBy("task", "band").agg(F.count("*").alias("n"), F.avg((F.col("correct_a") & ~F.col("correct_b")).cast("double")).alias("lost"), F.avg((~F.col("correct_a") & F.col("correct_b")).cast("double")).alias("won"), F.avg(F.col("conf_b") - F.col("conf_a")).alias("shift")))


def content_free_prior(spark, d):
    """Options' mean probabilities over the hash-chosen prior rows, and accuracy with and without their logs taken off."""
    x = rows(spark, d).withColumn("prior_row", E.hash_unit("id", F.lit("cf")) < 0.1)
    p = x.where("prior_row").select("task", F.posexplode("p").alias("k", "v")).groupBy("task", "k").agg(F.avg("v").alias("m"))
    total = p.groupBy("task").agg(F.sum("m").alias("s"))
    p = p.join(total, "task").groupBy("task").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", (F.col("m") / F.col("s")).alias("q")))), lambda v: F.log(F.greatest(v["q"], F.lit(1e-6)))).alias("prior"))
    y = x.where("not prior_row").join(F.broadcast(p), "task").withColumn("clean", F.zip_with("logits", "prior", lambda z, q: F.round(z - q, 9)))
    return tidy(y.groupBy("task").agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy"), F.avg((E.argmax("clean") == F.col("gold")).cast("double")).alias("accuracy_clean"), F.max(F.get("prior", F.lit(0))).alias("prior_0")))


CF = f"""{T.SQL}, a as (select *, {T.sql_unit("id || ':cf'")} < 0.1::double pr from p where arm = 'A'), m as (select task, avg(p0) a0, avg(p1) a1, avg(p2) a2 from a where pr group by task),
q as (select task, ln(greatest(a0 / (a0 + a1 + a2), 1e-6::double)) q0, ln(greatest(a1 / (a0 + a1 + a2), 1e-6::double)) q1, ln(greatest(a2 / (a0 + a1 + a2), 1e-6::double)) q2 from m),
c as (select a.*, q0, round(z0 - q0, 9) c0, round(z1 - q1, 9) c1, round(z2 - q2, 9) c2 from a join q using (task) where not pr)
select task, count(*) n, round(avg((chosen = gold)::int), 6) accuracy, round(avg((case when c0 >= c1 and c0 >= c2 then 0 when c1 >= c2 then 1 else 2 end = gold)::int), 6) accuracy_clean, round(max(q0), 6) prior_0 from c group by task"""


def insufficient(spark, d):
    """Ablated rows (true logits halved and halved again) against complete ones: how many fall under a confidence cut that
    keeps 95 % of the complete ones, and the accuracy above it."""
    x = T.decisions(spark, d)
    full = M.with_probs(x, k=3).withColumn("variant", F.lit("C"))
    less = M.with_probs(x.withColumns({f"z{j}": F.col(f"z{j}") / 4.0 for j in range(3)}), k=3).withColumn("variant", F.lit("M"))
    keep = ["task", "variant", "conf", "correct"]
    both = full.select(keep).unionByName(less.select(keep))
    cut = percentiles(full, ["task"], "conf", {"cut": 0.05}, unit_bucket("_v"))
    both = both.join(F.broadcast(cut), "task")
    return tidy(both.groupBy("task", "variant").agg(F.avg((F.round("conf", 9) < F.round("cut", 9)).cast("double")).alias("flagged"), F.avg(F.when(F.round("conf", 9) >= F.round("cut", 9), F.col("correct").cast("double"))).alias("accuracy")))


INSUFFICIENT = f"""{T.SQL}, a as (select task, z0, z1, z2, gold, conf, chosen = gold correct from p where arm = 'A'), cut as (select task, quantile_cont(conf, 0.05) cut from a group by task),
e4 as (select *, exp((z0 - greatest(z0, z1, z2)) / 4) + exp((z1 - greatest(z0, z1, z2)) / 4) + exp((z2 - greatest(z0, z1, z2)) / 4) den from a),
b as (select task, 'C' variant, conf c, correct from a union all select task, 'M', 1 / den, correct from e4)
select task, variant, round(avg((round(c, 9) < round(cut, 9))::int), 6) flagged, round(avg(case when round(c, 9) >= round(cut, 9) then correct::int end), 6) accuracy from b join cut using (task) group by task, variant"""


def mass_report(spark, d):
    """Option mass of correct and wrong answers, and whether it tells them apart."""
    x = T.raw_readouts(spark, d)
    z = E.logits("raw_logprobs", T.LETTERS)
    x = x.withColumn("mass", F.round(F.least(E.option_mass("raw_logprobs"), F.lit(1.0)), 9)).withColumn("correct", E.argmax(z) == F.col("gold"))
    a = x.groupBy("task").agg(F.avg(F.when(F.col("correct"), F.col("mass"))).alias("mass_correct"), F.avg(F.when(~F.col("correct"), F.col("mass"))).alias("mass_wrong")).join(percentiles(x, ["task"], "mass", {"p5": 0.05}, unit_bucket("_v")), "task")
    return tidy(a.join(M.auroc(x, ["task"], "mass", F.col("correct")), "task"))


MASS = f"""{_RAW}, x as (select task, round(least(mass, 1), 9) m, case when f0 >= f1 and f0 >= f2 then 0 when f1 >= f2 then 1 else 2 end = gold ok from fl),
r as (select *, rank() over (partition by task order by m) + (count(*) over (partition by task, m) - 1) / 2::double rk from x)
select task, round(avg(m) filter (ok), 6) mass_correct, round(avg(m) filter (not ok), 6) mass_wrong, round(quantile_cont(m, 0.05), 6) p5,
 round((sum(rk) filter (ok) - sum(ok::int) * (sum(ok::int) + 1) / 2::double) / (sum(ok::int)::double * sum((not ok)::int)), 6) auroc from r group by task"""


def folds(spark, d):
    x = S.even_folds(T.decisions(spark, d), 5)
    return tidy(x.groupBy("task", "fold").agg(F.count("*").alias("n"), F.count_distinct("group_id").alias("groups")))


def left_out_segments(spark, d):
    """Leave-one-flag-out: accuracy on the flag left out and on the others."""
    x = S.leave_one_out_folds(rows(spark, d), "hard_type", ["A", "N", "R"])
    return tidy(x.groupBy("fold", "is_train").agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy")))


def cosine_temperature(spark, d):
    """Temperature of cosine scores on a grid of its own, for half of the test vectors."""
    x = T.emb_decisions(spark, d).withColumn("score", F.col("score") / 10.0)
    x = x.groupBy("vec_id", "gold").agg(F.transform(F.array_sort(F.collect_list(F.struct("cand", "score"))), lambda s: s["score"]).alias("logits")).withColumn("task", F.lit("vectors"))
    return tidy(C.fit_temperature(x.where(E.hash_unit("vec_id", F.lit("t")) < 0.5), "task", C.COSINE_GRID))


def segment_fusion(spark, d):
    """Logistic fusion of both arms' scores for option 2, fitted without each flag in turn: AUROC on all rows of the flag. A
    fit standardises and learns from all rows of the other flags; three numbers a flag go out again."""
    x = _arms(spark, d, ("p",)).select("hard_type", "id", (F.col("gold") == 2).cast("int").alias("y"), F.get("p_a", F.lit(2)).alias("a"), F.get("p_b", F.lit(2)).alias("b"))
    out = C.left_out_fusion(settled(x, "arms"), "hard_type", ["a", "b"], "y")
    return M.auroc(out.select(F.col("hard_type").alias("held"), F.round("fused", 12).alias("score"), "y"), ["held"], "score", F.col("y") == 1)


def reconcile(spark, d):
    """Two annotators of the labelled documents: the quality label and a rule; agreements are kept, the others counted."""
    docs = T.table(spark, d, "documents").select("doc_id", "source", F.when(F.rlike(F.coalesce("text", F.lit("")), F.lit(r"[#$%&*]{3}|!!| \| ")), 0).otherwise(1).alias("rule"))
    x = docs.join(T.table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    return tidy(x.groupBy(F.when(F.col("rule") == F.col("quality"), "agreed").otherwise("disagreed").alias("status"), "quality").agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources")))


def rule_file(spark, d):
    """Violations of rule tables made of the parts, a table a brand: repeated and empty patterns, unknown labels, sizes."""
    p = T.table(spark, d, "part")
    label = F.element_at(F.array(*map(F.lit, ["A", "B", "C", "Z"])), (F.col("p_size") % 4 + 1).cast("int"))
    pattern = F.when(F.col("p_size") > 48, F.lit(" ")).otherwise(F.concat_ws(" ", "p_name", (F.col("p_partkey") % 7).cast("string")))
    rules = p.select(F.col("p_brand").alias("task"), F.col("p_partkey").alias("ord"), pattern.alias("pattern"), label.alias("label"), F.when(F.col("p_partkey") % 40 == 0, "Q").otherwise("B").alias("default_label"))
    return tidy(Q.validate_rules(rules, ["A", "B", "C"]).groupBy("rule", "id").agg(F.count("*").alias("n")))


RULE_FILE = """with r as (select p_brand task, case when p_size > 48 then ' ' else p_name || ' ' || p_partkey % 7 end pattern, ['A', 'B', 'C', 'Z'][(p_size % 4 + 1)::int] as label, case when p_partkey % 40 = 0 then 'Q' else 'B' end dl from part),
v as (select 'label_not_an_option' as "rule", task id from r where label = 'Z' union all select 'default_not_an_option', task from r where dl = 'Q' union all select 'empty_pattern', task from r where trim(pattern) = ''
 union all select 'pattern_repeats', task from (select task, pattern from r group by task, pattern having count(*) > 1) union all select 'rule_count', task from (select task from r group by task having count(*) < 10 or count(*) > 25))
select "rule", id, count(*) n from v group by 1, 2"""


def probability_keys(spark, d):
    """Letters that either of two readouts of a row has, and how far they lie apart there, missing ones as 0."""
    x = T.raw_readouts(spark, d).withColumn("pa", E.present_probs("raw_logprobs"))
    # both maps and the letters are bound once a row: inside the lambda each would be made anew for every letter
    apart = lambda k, a, b: F.abs(F.coalesce(a[k], F.lit(0.0)) - F.coalesce(b[k], F.lit(0.0)))
    both = lambda keys, a, b: F.struct(F.array_max(F.transform(keys, lambda k: apart(k, a, b))).alias("gap"), F.size(keys).cast("long").alias("keys"))
    second = lambda a, b: E.let(F.array_union(F.map_keys(a), F.map_keys(b)), lambda keys: both(keys, a, b))
    x = x.withColumn("x", E.let(F.col("pa"), lambda a: E.let(F.map_filter(a, lambda k, v: k != "B"), lambda b: second(a, b))))
    # a row without letters has no gap; a filter would make the readouts once more inside the scan
    return tidy(x.groupBy("task").agg(F.count("x.gap").alias("n"), F.avg("x.gap").alias("gap"), F.sum("x.keys").alias("keys")).where("n > 0"))


def rendered(spark, d):
    """Rows as compact JSON and as text lines: lengths and digests by priority of the order."""
    from ..operators import text as X

    o = T.table(spark, d, "orders")
    j = X.compact_json(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.lit(None).cast("string").alias("note"))
    t = X.render("order {id} is {status}", id=F.col("o_orderkey"), status=F.col("o_orderstatus"))
    return tidy(o.groupBy("o_orderpriority").agg(F.sum(F.length(j).cast("long")).alias("json_chars"), F.sum(F.length(t).cast("long")).alias("text_chars"), F.min(F.md5(j.cast("binary"))).alias("digest")))


COSINE = f"""{EMB}, t as (select vec_id, gold, cand, score / 10 s from sc where {T.sql_unit("cast(vec_id as varchar) || ':t'")} < 0.5::double),
g as (select i, exp(ln(1e-3::double) + i * (ln(5::double) - ln(1e-3::double)) / 299::double) temp from (select unnest(range(0, 300)) i)),
x as (select vec_id, gold, s, cand, max(s) over (partition by vec_id) m, row_number() over (partition by vec_id order by cand) - 1 k from t),
l as (select vec_id, i, temp, -ln(greatest(sum(case when k = gold then exp((s - m) / temp) end) / sum(exp((s - m) / temp)), 1e-12::double)) l from x, g group by vec_id, i, temp),
a as (select i, temp, round(avg(l), 10) l from l group by i, temp) select 'vectors' task, round(temp, 6) "temp" from (select temp from a order by l, i limit 1)"""
QUERIES: dict[str, Query] = {
    "x02_ladder": (ladder, LADDER),
    "x11_usability": (usability, f"{_PAIR}, s as (select task, avg((ha = hb)::int) ag, avg(cb::int) - avg(ca::int) gap from pr group by task) select task, round(ag, 6) agreement, round(gap, 6) gap, ag >= 0.98::double and abs(gap) <= 0.01::double usable from s"),
    "x07_interference": (interference, f"{_PAIR} select task, floor(least(fa, 0.999999::double) * 5)::bigint band, count(*) n, round(avg((ca and not cb)::int), 6) lost, round(avg((cb and not ca)::int), 6) won, round(avg(fb - fa), 6) shift from pr group by 1, 2"),
    "x26_content_free_prior": (content_free_prior, CF),
    "x28_insufficient": (insufficient, INSUFFICIENT),
    "x29_mass_report": (mass_report, MASS),
    "c02_folds": (folds, f"{T.SQL}, f as (select task, group_id, (dense_rank() over (partition by task order by md5(group_id || ':0'), group_id) - 1) % 5 fold from dec where arm = 'A') select task, fold, count(*) n, count(distinct group_id) groups from f group by task, fold"),
    "c03_left_out_segments": (left_out_segments, f"{T.SQL}, k as (select unnest(['A', 'N', 'R']) fold) select fold, hard_type <> fold is_train, count(*) n, round(avg((chosen = gold)::int), 6) accuracy from p, k where arm = 'A' group by 1, 2"),
    "c05_cosine_temperature": (cosine_temperature, COSINE),
    "c26_segment_fusion": (segment_fusion, None),
    "c32_reconcile": (reconcile, "with x as (select doc_id, source, quality, case when regexp_matches(coalesce(text, ''), '[#$%&*]{3}|!!| \\| ') then 0 else 1 end r from documents join labels using (doc_id)) select case when r = quality then 'agreed' else 'disagreed' end status, quality::bigint quality, count(*) n, count(distinct source) sources from x group by 1, 2"),
    "g09_rule_file": (rule_file, RULE_FILE),
    "u05_probability_keys": (probability_keys, f"{_RAW} select task, count(*) n, round(avg(case when r1 is null then 0 else exp(r1) / mass end), 6) gap, sum(letters)::bigint keys from fl where letters > 0 group by task"),
    "f09_rendered": (rendered, """select o_orderpriority, sum(length('{"id":' || o_orderkey || ',"status":"' || o_orderstatus || '","note":null}'))::bigint json_chars, sum(length('order ' || o_orderkey || ' is ' || o_orderstatus))::bigint text_chars, min(md5('{"id":' || o_orderkey || ',"status":"' || o_orderstatus || '","note":null}')) digest from orders group by o_orderpriority"""),
}
