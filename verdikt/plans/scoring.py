"""Queries over decision rows: readouts, splits, metrics and calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr as E
from ..operators import calibrate as C
from ..operators import metrics as M
from ..operators import quality as Q
from ..operators import split as S
from ..operators.running import percentiles, unit_bucket
from ..sources.shared import settled
from . import tables as T
from .util import Query, tidy

TEMPS = f"""{T.SQL}, grid as (select i, exp(ln(0.05::double) + i * (ln(50::double) - ln(0.05::double)) / 199::double) temp from (select unnest(range(0, 200)) i)),
cal as (select * from spl where cal and arm = 'A'),
ls as (select task, i, temp, round(avg(-ln(greatest(case gold when 0 then exp((z0 - greatest(z0, z1, z2)) / temp) when 1 then exp((z1 - greatest(z0, z1, z2)) / temp) else exp((z2 - greatest(z0, z1, z2)) / temp) end
  / (exp((z0 - greatest(z0, z1, z2)) / temp) + exp((z1 - greatest(z0, z1, z2)) / temp) + exp((z2 - greatest(z0, z1, z2)) / temp)), 1e-12::double))), 10) l from cal, grid group by task, i, temp),
fit as (select task, temp from (select *, row_number() over (partition by task order by l, i) r from ls) where r = 1)"""


def rows(spark, d, arms="A"):
    return M.with_probs(T.decisions(spark, d, arms), k=3)


def split_rows(spark, d, arms="A"):
    return S.group_split(rows(spark, d, arms))


def settled_rows(spark, d, arms="A"):
    """The split rows, written once: fits, cuts and evaluations all read them. What follows from a row's logits is computed
    where it is read."""
    x = settled(S.group_split(T.decisions(spark, d, arms).drop("logits")), "split")
    return M.with_probs(x.withColumn("logits", F.array("z0", "z1", "z2")), k=3)


def row_scores(spark, d):
    x = rows(spark, d)
    return tidy(x.select("id", "task", "gold", "chosen", "correct", "conf", E.margin("p").alias("margin"), E.entropy_confidence("p").alias("entropy"), E.expected_level("p").alias("level"), E.round_half_down_level("p").alias("r1"), E.median_level("p").alias("r2"), E.nll("p", "gold").alias("nll"), E.brier("p", "gold").alias("brier")))


ROW_SCORES = f"""{T.SQL} select id, task, gold::bigint gold, chosen::bigint chosen, chosen = gold correct, round(conf, 6) conf,
 round(conf - (p0 + p1 + p2 - conf - least(p0, p1, p2)), 6) + 0::double margin,
 round(1 + (greatest(p0, 1e-12::double) * ln(greatest(p0, 1e-12::double)) + greatest(p1, 1e-12::double) * ln(greatest(p1, 1e-12::double)) + greatest(p2, 1e-12::double) * ln(greatest(p2, 1e-12::double))) / ln(3::double), 6) entropy,
 round(p1 + 2 * p2, 6) level, least(greatest(ceil(p1 + 2 * p2 - 0.5::double), 0), 2)::bigint r1,
 case when p0 >= 0.5::double - 1e-12::double then 0 when p0 + p1 >= 0.5::double - 1e-12::double then 1 else 2 end::bigint r2,
 round(-ln(greatest(case gold when 0 then p0 when 1 then p1 else p2 end, 1e-12::double)), 6) + 0::double nll,
 round(pow(p0 - (gold = 0)::int, 2) + pow(p1 - (gold = 1)::int, 2) + pow(p2 - (gold = 2)::int, 2), 6) brier
 from p where arm = 'A'"""


def readout_mass(spark, d):
    x = T.raw_readouts(spark, d)
    z = E.logits("raw_logprobs", T.LETTERS)
    present = E.present_probs("raw_logprobs")
    x = x.select("id", "task", F.size("raw_logprobs").alias("letters"), E.option_mass("raw_logprobs").alias("mass"), F.get(z, F.lit(0)).alias("logit_a"), present["A"].alias("present_a"), F.get(E.softmax(z), F.lit(0)).alias("floored_a"), F.get(E.log_softmax(z), F.lit(1)).alias("norm_b"))
    return tidy(x)


_RAW = f"""{T.SQL}, raw as (select id, task, gold, {", ".join(f"case when {T.sql_unit(f'''id || ':m{j}' ''', 1000)} < 0.04::double then null else z{j} - ln(exp(z0) + exp(z1) + exp(z2)) end r{j}" for j in range(3))} from dec where arm = 'A'),
fl as (select *, coalesce(r0, -30::double) f0, coalesce(r1, -30::double) f1, coalesce(r2, -30::double) f2, coalesce(exp(r0), 0) + coalesce(exp(r1), 0) + coalesce(exp(r2), 0) mass,
 (r0 is not null)::int + (r1 is not null)::int + (r2 is not null)::int letters from raw)"""
READOUT_MASS = f"""{_RAW} select id, task, letters::bigint letters, round(mass, 6) mass, round(f0, 6) logit_a, round(case when letters > 0 then exp(r0) / mass end, 6) present_a,
 round(exp(f0) / (exp(f0) + exp(f1) + exp(f2)), 6) floored_a,
 round(greatest(-30::double, least(0::double, f1)) - ln(exp(greatest(-30::double, least(0::double, f0))) + exp(greatest(-30::double, least(0::double, f1))) + exp(greatest(-30::double, least(0::double, f2)))), 6) + 0::double norm_b from fl"""


def missing_rates(spark, d):
    x = T.raw_readouts(spark, d)
    gold = F.element_at(F.array(*map(F.lit, T.LETTERS)), F.col("gold") + 1)
    return tidy(x.groupBy("task").agg(F.avg((F.size("raw_logprobs") < 3).cast("double")).alias("missing"), F.avg((~F.map_contains_key("raw_logprobs", gold)).cast("double")).alias("gold_missing"), F.min(E.option_mass("raw_logprobs")).alias("min_mass")).join(percentiles(x, ["task"], E.option_mass("raw_logprobs"), {"median_mass": 0.5}, unit_bucket("_v")), "task"))


MISSING = f"""{_RAW} select task, round(avg((letters < 3)::int), 6) missing, round(avg((case gold when 0 then r0 when 1 then r1 else r2 end is null)::int), 6) gold_missing, round(min(mass), 6) min_mass, round(quantile_cont(mass, 0.5), 6) median_mass from fl group by task"""


def mass_gate(spark, d):
    return tidy(Q.mass_gate(T.raw_readouts(spark, d), ["task"]))


def split_sizes(spark, d):
    x = split_rows(spark, d)
    return tidy(x.groupBy("task", "cal").agg(F.count("*").alias("n"), F.count_distinct("group_id").alias("groups"), F.sum(F.crc32(F.col("id").cast("binary"))).alias("crc")).drop("crc"))


def accuracy_slices(spark, d):
    x = rows(spark, d)
    parts = [M.accuracy(x.withColumn("slice", F.concat(F.lit(f"{c}="), F.col(c))), ["task", "slice"]) for c in ("hard_type", "lang")]
    return tidy(parts[0].unionByName(parts[1]))


def confusion(spark, d):
    return tidy(M.confusion(rows(spark, d), ["task"], 3))


CONFUSION = f"""{T.SQL}, c as (select task, gold, chosen, count(*) n from p where arm = 'A' group by all), t as (select distinct task from dec), k as (select unnest([0, 1, 2]) v)
 select t.task, g.v::bigint gold, s.v::bigint chosen, coalesce(n, 0) n from t, k g, k s left join c on c.task = t.task and c.gold = g.v and c.chosen = s.v"""


def f1_and_top2(spark, d):
    x = rows(spark, d)
    return tidy(M.macro_f1(x, ["task"], 3).join(M.top2(x, ["task"]), "task"))


F1 = f"""{T.SQL}, a as (select * from p where arm = 'A'), k as (select unnest([0, 1, 2]) v),
 c as (select task, v, sum((gold = v)::int) s, sum((chosen = v)::int) d, sum((gold = v and chosen = v)::int) tp from a, k group by task, v),
 f as (select task, round(avg(2.0::double * tp / (s + d)), 6) macro_f1 from c where s + d > 0 group by task),
 t as (select task, round(avg((case gold when 0 then (p1 > p0)::int + (p2 > p0)::int when 1 then (p0 >= p1)::int + (p2 > p1)::int else (p0 >= p2)::int + (p1 >= p2)::int end < 2)::int), 6) top2 from a group by task)
 select task, macro_f1, top2 from f join t using (task)"""


def ece(spark, d):
    x = rows(spark, d)
    a = M.ece(x, ["task"]).join(M.ece(x, ["task"], exact=True).withColumnRenamed("ece", "ece_exact"), "task")
    return tidy(a.join(M.classwise_ece(x, ["task"]), "task").join(M.losses(x, ["task"]), "task"))


def _bin(c: str, exact: bool = False) -> str:
    edges = [i / 10 if exact else i * (1 / 10) for i in range(1, 10)]
    return " + ".join(f"({c} > {e!r}::double)::int" for e in edges)


ECE = f"""{T.SQL}, a as (select * from p where arm = 'A'),
 b as (select task, {_bin('conf')} b, count(*) n, avg(conf) m, avg((chosen = gold)::int) acc from a group by all), x1 as (select task, round(sum(n * abs(m - acc)) / sum(n), 6) ece from b group by task),
 b2 as (select task, {_bin('conf', True)} b, count(*) n, avg(conf) m, avg((chosen = gold)::int) acc from a group by all), x2 as (select task, round(sum(n * abs(m - acc)) / sum(n), 6) ece_exact from b2 group by task),
 o as (select task, 0 o, p0 q, (gold = 0)::int y from a union all select task, 1, p1, (gold = 1)::int from a union all select task, 2, p2, (gold = 2)::int from a),
 b3 as (select task, o, {_bin('q')} b, count(*) n, avg(q) m, avg(y) acc from o group by all), x3 as (select task, o, sum(n * abs(m - acc)) / sum(n) e from b3 group by task, o), x4 as (select task, round(avg(e), 6) classwise_ece from x3 group by task),
 x5 as (select task, round(avg(pow(p0 - (gold = 0)::int, 2) + pow(p1 - (gold = 1)::int, 2) + pow(p2 - (gold = 2)::int, 2)), 6) brier, round(avg(-ln(greatest(case gold when 0 then p0 when 1 then p1 else p2 end, 1e-12::double))), 6) nll from a group by task)
 select task, ece, ece_exact, classwise_ece, brier, nll from x1 join x2 using (task) join x4 using (task) join x5 using (task)"""


def reliability(spark, d):
    return tidy(M.reliability(rows(spark, d), ["task"]))


def auroc(spark, d):
    x = rows(spark, d).withColumn("conf", F.round("conf", 12))
    x = x.withColumn("p", F.transform("p", lambda v: F.round(v, 12)))
    return tidy(M.auroc(x, ["task"], "conf", F.col("correct")).join(M.ovr_auroc(x, ["task"]), "task"))


AUROC = f"""{T.SQL}, a as (select *, round(conf, 12) c from p where arm = 'A'),
 o as (select task, 9 o, c q, (chosen = gold)::int y from a union all select task, 0 o, round(p0, 12), (gold = 0)::int from a union all select task, 1, round(p1, 12), (gold = 1)::int from a union all select task, 2, round(p2, 12), (gold = 2)::int from a),
 r as (select task, o, y, rank() over w + (count(*) over (partition by task, o, q) - 1) / 2::double rk from o window w as (partition by task, o order by q)),
 s as (select task, o, sum(case when y = 1 then rk end) ranks, sum(y)::double n1, count(*) - sum(y)::double n0 from r group by task, o),
 u as (select task, o, case when n1 * n0 > 0 then (ranks - n1 * (n1 + 1) / 2) / (n1 * n0) end u from s)
 select task, round(max(case when o = 9 then u end), 6) auroc, round(avg(case when o < 9 then u end), 6) ovr_auroc from u group by task"""


def selective(spark, d):
    return tidy(M.selective(rows(spark, d), ["task"], [0.8, 0.9, 0.95]))


SELECTIVE = f"""{T.SQL}, k as (select unnest([0.8::double, 0.9::double, 0.95::double]) cut)
 select task, cut, round(avg(case when conf >= cut then (chosen = gold)::int end), 6) accuracy, round(avg((conf >= cut)::int), 6) coverage from p, k where arm = 'A' group by task, cut"""


def temperature(spark, d):
    return tidy(C.fit_temperature(split_rows(spark, d).where("cal")))


def pooled_temperature(spark, d):
    """Temperatures from all tasks together and from all other tasks."""
    cal = split_rows(spark, d).where("cal")
    pooled = C.fit_temperature(cal.withColumn("everything", F.lit("all")), "everything").select(F.col("temp").alias("pooled"))
    return tidy(C.fit_left_out(cal).withColumnRenamed("temp", "left_out").crossJoin(F.broadcast(pooled)))


POOLED = f"""{TEMPS}, raw as (select task, i, temp, sum(-ln(greatest(case gold when 0 then exp((z0 - greatest(z0, z1, z2)) / temp) when 1 then exp((z1 - greatest(z0, z1, z2)) / temp) else exp((z2 - greatest(z0, z1, z2)) / temp) end
  / (exp((z0 - greatest(z0, z1, z2)) / temp) + exp((z1 - greatest(z0, z1, z2)) / temp) + exp((z2 - greatest(z0, z1, z2)) / temp)), 1e-12::double))) l, count(*) n from cal, grid group by task, i, temp),
 lo as (select a.task, b.i, b.temp, round(sum(b.l) / sum(b.n), 10) l from (select distinct task from raw) a join raw b on a.task <> b.task group by a.task, b.i, b.temp),
 al as (select i, temp, round(sum(l) / sum(n), 10) l from raw group by i, temp),
 best as (select task, temp from (select *, row_number() over (partition by task order by l, i) r from lo) where r = 1)
 select task, round(temp, 6) left_out, round((select temp from al order by l, i limit 1), 6) pooled from best"""


def calibrated_metrics(spark, d):
    """Test metrics before and after the temperature."""
    x = settled_rows(spark, d)
    temps = C.fit_temperature(x.where("cal"))
    x = x.where("not cal").join(F.broadcast(temps), "task")
    raw = M.ece(x, ["task"]).join(M.losses(x, ["task"]), "task").toDF("task", "ece_raw", "brier_raw", "nll_raw")
    y = M.with_probs(x.drop("p", "conf", "chosen", "correct"), F.col("temp"), 3)
    return tidy(M.accuracy(y, ["task"]).join(M.ece(y, ["task"]), "task").join(M.losses(y, ["task"]), "task").join(raw, "task"))


CALIBRATED = f"""{TEMPS}, a as (select spl.*, fit.temp, exp((z0 - greatest(z0, z1, z2)) / temp) s0, exp((z1 - greatest(z0, z1, z2)) / temp) s1, exp((z2 - greatest(z0, z1, z2)) / temp) s2 from spl join fit using (task) where arm = 'A' and not cal),
 b as (select *, s0 / (s0 + s1 + s2) q0, s1 / (s0 + s1 + s2) q1, s2 / (s0 + s1 + s2) q2, greatest(s0, s1, s2) / (s0 + s1 + s2) qc from a),
 e1 as (select task, {_bin('conf')} b, count(*) n, avg(conf) m, avg(correct::int) acc from b group by all), f1 as (select task, round(sum(n * abs(m - acc)) / sum(n), 6) ece_raw from e1 group by task),
 e2 as (select task, {_bin('qc')} b, count(*) n, avg(qc) m, avg(correct::int) acc from b group by all), f2 as (select task, round(sum(n * abs(m - acc)) / sum(n), 6) ece from e2 group by task),
 f3 as (select task, count(*) n, round(avg(correct::int), 6) accuracy,
  round(avg(pow(p0 - (gold = 0)::int, 2) + pow(p1 - (gold = 1)::int, 2) + pow(p2 - (gold = 2)::int, 2)), 6) brier_raw, round(avg(-ln(greatest(case gold when 0 then p0 when 1 then p1 else p2 end, 1e-12::double))), 6) nll_raw,
  round(avg(pow(q0 - (gold = 0)::int, 2) + pow(q1 - (gold = 1)::int, 2) + pow(q2 - (gold = 2)::int, 2)), 6) brier, round(avg(-ln(greatest(case gold when 0 then q0 when 1 then q1 else q2 end, 1e-12::double))), 6) nll from b group by task)
 select task, n, accuracy, ece, brier, nll, ece_raw, brier_raw, nll_raw from f3 join f1 using (task) join f2 using (task)"""


def latency(spark, d):
    x = rows(spark, d)
    a = M.percentiles(x, ["task"], "latency_ms", [0.5, 0.95, 0.99]).join(M.upper_elements(x, ["task"], "latency_ms").toDF("task", "upper_median", "upper_p95"), "task")
    return tidy(a.join(x.groupBy("task").agg(F.avg("latency_ms").alias("mean"), (F.count("*") / F.sum("latency_ms") * 1000.0).alias("per_second")), "task"))


LATENCY = f"""{T.SQL}, a as (select task, latency_ms x, row_number() over (partition by task order by latency_ms) - 1 i, count(*) over (partition by task) n from dec where arm = 'A')
 select task, round(quantile_cont(x, 0.5), 6) p50, round(quantile_cont(x, 0.95), 6) p95, round(quantile_cont(x, 0.99), 6) p99, round(max(case when i = n // 2 then x end), 6) upper_median,
 round(max(case when i = floor(n * 0.95::double) then x end), 6) upper_p95, round(avg(x), 6) mean, round(count(*) / sum(x) * 1000, 6) per_second from a group by task"""


def ordinal(spark, d):
    x = rows(spark, d).withColumn("r1", E.round_half_down_level("p")).withColumn("r2", E.median_level("p"))
    out = None
    for name in ("chosen", "r1", "r2"):
        one = M.ordinal_errors(x, ["task"], name).withColumn("readout", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return tidy(out)


_LEVELS = "select task, gold, 'chosen' readout, chosen v from a union all select task, gold, 'r1', least(greatest(ceil(p1 + 2 * p2 - 0.5::double), 0), 2)::int from a union all select task, gold, 'r2', case when p0 >= 0.5::double - 1e-12::double then 0 when p0 + p1 >= 0.5::double - 1e-12::double then 1 else 2 end from a"
ORDINAL = f"""{T.SQL}, a as (select * from p where arm = 'A'), l as ({_LEVELS})
 select task, readout, round(avg(abs(v - gold)), 6) mae, round(avg((abs(v - gold) <= 1)::int), 6) within_one, round(sum((abs(v - gold) = 1)::int) / sum((v <> gold)::int), 6) adjacent_share, round(avg((v - gold <= -2)::int), 6) danger from l group by task, readout"""


def guard(spark, d):
    """Recall and false positives of option 2 at argmax and at a calibrated 95 % quantile, and precision at 80 % recall."""
    x = split_rows(spark, d).withColumn("s", F.round(F.get("p", F.lit(2)), 12))
    cut = percentiles(x.where("cal and gold <> 2"), ["task"], "s", {"q": 0.95}, unit_bucket("_v"))
    t = x.where("not cal").join(F.broadcast(cut), "task")
    pos = F.col("gold") == 2
    a = M.recall_fpr(t, ["task"], F.col("chosen") == 2, pos)
    b = M.recall_fpr(t, ["task"], F.col("s") > F.col("q"), pos).toDF("task", "recall_q", "fpr_q")
    return tidy(a.join(b, "task").join(M.precision_at_recall(t, ["task"], "s", pos), "task").join(cut, "task"))


GUARD = f"""{T.SQL}, a as (select *, round(p2, 12) s, (gold = 2)::int y from spl where arm = 'A'), q as (select task, quantile_cont(s, 0.95) q from a where cal and gold <> 2 group by task),
 t as (select a.*, q.q from a join q using (task) where not cal),
 gg as (select task, sum((chosen = 2 and y = 1)::int) / greatest(sum(y), 1) recall, sum((chosen = 2 and y = 0)::int) / greatest(sum(1 - y), 1) fpr, sum((s > q and y = 1)::int) / greatest(sum(y), 1) recall_q, sum((s > q and y = 0)::int) / greatest(sum(1 - y), 1) fpr_q, max(q) q, sum(y) pos, count(*) n from t group by task),
 run as (select task, s, sum(y) over w tp, count(*) over w k from t window w as (partition by task order by s desc range between unbounded preceding and current row)),
 fi as (select task, tp, k, row_number() over (partition by task order by k) r from run join gg using (task) where tp >= ceil(pos * 0.8::double))
 select task, round(recall, 6) recall, round(fpr, 6) fpr, round(recall_q, 6) recall_q, round(fpr_q, 6) fpr_q, round(tp / k, 6) "precision", round(k / n, 6) flagged, round(q, 6) q from gg join fi using (task) where r = 1"""


def method_cv(spark, d):
    """Calibration methods by grouped folds: every row is predicted by fits on all rows of the other folds; equal rows are counted."""
    p = settled(C.cross_validated_counts(S.even_folds(T.decisions(spark, d), 3)), "predicted").withColumns({"conf": E.top_prob("p"), "chosen": E.argmax("p")}).withColumn("correct", E.correct("chosen", "gold"))
    by = ["task", "method"]
    return M.accuracy(p, by, "n").join(M.ece(p, by, n="n"), by).join(M.classwise_ece(p, by, n="n"), by).join(M.losses(p, by, "n"), by)


def learning_curve(spark, d):
    """Twenty repetitions of four methods on growing numbers of rows, each judged on 25 groups held out."""
    x = C.learning_curve(T.decisions(spark, d), [10, 20, 50, 100], 20)
    return x.groupBy("task", "method", "size").agg(F.count("*").alias("reps"), F.avg("accuracy").alias("accuracy"), F.avg("loss").alias("loss"), F.avg("ece").alias("ece"))


def curve_crossover(spark, d):
    """The training size from which on each method is calibrated better than the temperature."""
    return C.crossover(settled(C.learning_curve(T.decisions(spark, d), [10, 20, 50, 100], 20), "curve"))


def fixed_split(spark, d):
    """Calibration methods fitted on all calibration rows, judged on the test half, with the coverage and error of the 5 % cut."""
    from ..operators import policy as Y

    x = settled(C.fixed_split_counts(S.group_split(T.decisions(spark, d))), "predicted").withColumns({"conf": F.round(E.top_prob("p"), 12), "chosen": E.argmax("p")}).withColumn("correct", E.correct("chosen", "gold"))
    by, test = ["task", "method"], x.where("not cal")
    cut = Y.apply_cut(test, settled(Y.risk_cut(x.where("cal"), [0.05], by, "n"), "cuts"), by, n="n").select(*by, "coverage", "error", "held")
    return M.accuracy(test, by, "n").join(M.ece(test, by, n="n"), by).join(M.losses(test, by, "n"), by).join(cut, by)


def data_gates(spark, d):
    """Rows whose published probabilities don't add up to one (one letter's probability is lost in some), and the two
    directions of the error between the lowest and the highest option."""
    x = rows(spark, d)
    lost = E.hash_unit("id", F.lit("lost"), buckets=1000) < 0.01
    x = x.withColumn("published", F.when(lost, F.transform("p", lambda v, i: F.when(i == 1, 0.0).otherwise(v))).otherwise(F.col("p")))
    return tidy(M.bad_sums(x, ["task"], "published").join(M.asymmetric_errors(x, ["task"], 0, 2), "task"))


DATA_GATES = f"""{T.SQL}, a as (select *, {T.sql_unit("id || ':lost'", 1000)} < 0.01::double lost from p where arm = 'A')
 select task, sum((abs(p0 + p2 + case when lost then 0 else p1 end - 1) > 0.001::double)::int)::bigint bad_sum,
 round(sum((gold = 2 and chosen = 0)::int) / greatest(sum((gold = 2)::int), 1), 6) high_to_low, round(sum((gold = 0 and chosen = 2)::int) / greatest(sum((gold = 0)::int), 1), 6) low_to_high from a group by task"""


_A = "from p where arm = 'A'"
QUERIES: dict[str, Query] = {
    "p01_row_scores": (row_scores, ROW_SCORES),
    "p05_readout_mass": (readout_mass, READOUT_MASS),
    "a13_missing_rates": (missing_rates, MISSING),
    "g13_mass_gate": (mass_gate, f"{_RAW} select task, round(min(mass), 6) min_mass, min(mass) >= 0.9::double ok from fl group by task"),
    "c01_split_sizes": (split_sizes, f"{T.SQL} select task, cal, count(*) n, count(distinct group_id) groups from spl where arm = 'A' group by task, cal"),
    "a01_accuracy_slices": (accuracy_slices, f"{T.SQL} select task, slice, count(*) n, round(avg((chosen = gold)::int), 6) accuracy from (select *, 'hard_type=' || hard_type slice {_A} union all select *, 'lang=' || lang {_A}) group by task, slice"),
    "a02_macro_f1_top2": (f1_and_top2, F1),
    "a03_confusion": (confusion, CONFUSION),
    "a04_calibration_errors": (ece, ECE),
    "a06_reliability": (reliability, f"{T.SQL} select task, least(floor(conf * 5), 4)::bigint bin, count(*) n, round(avg(conf), 6) mean_conf, round(avg((chosen = gold)::int), 6) accuracy {_A} group by 1, 2"),
    "a09_auroc": (auroc, AUROC),
    "a12_selective": (selective, SELECTIVE),
    "a15_latency": (latency, LATENCY),
    "a26_ordinal_readouts": (ordinal, ORDINAL),
    "a27_guard": (guard, GUARD),
    "c04_temperature": (temperature, f"{TEMPS} select task, round(temp, 6) temp from fit"),
    "c06_pooled_temperature": (pooled_temperature, POOLED),
    "x01_calibrated_metrics": (calibrated_metrics, CALIBRATED),
    "a14_data_gates": (data_gates, DATA_GATES),
    "x27_method_cv": (method_cv, None),
    "c23_learning_curve": (learning_curve, None),
    "x27_crossover": (curve_crossover, None),
    "x27_fixed_split": (fixed_split, None),
}
