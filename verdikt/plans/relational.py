"""Queries over joins, set operations, sampling, aggregates and derived columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import expr as E
from ..operators import paired as P
from ..operators import quality as Q
from ..operators.running import percentiles, running_totals
from . import tables as T
from .scoring import rows
from .util import Query, tidy


def gold_join(spark, d):
    """Labelled documents with their text's length, by source."""
    x = T.table(spark, d, "labels").join(T.table(spark, d, "documents").select("doc_id", "source", "n_chars"), "doc_id")
    return tidy(x.groupBy("source").agg(F.count("*").alias("n"), F.sum("quality").alias("good"), F.avg("n_chars").alias("chars")))


def common_ids(spark, d):
    """Orders that occur with every return flag: an n-way intersection by one count."""
    li = T.table(spark, d, "lineitem")
    n = li.agg(F.count_distinct("l_returnflag").alias("flags"))
    x = li.groupBy("l_orderkey").agg(F.count_distinct("l_returnflag").alias("k")).crossJoin(F.broadcast(n)).where("k = flags")
    return x.select("l_orderkey")


def semi_anti(spark, d):
    docs, lab = T.table(spark, d, "documents").select("doc_id", "lang"), T.table(spark, d, "labels").select("doc_id")
    a = docs.join(lab, "doc_id", "left_semi").groupBy("lang").agg(F.count("*").alias("labelled"))
    b = docs.join(lab, "doc_id", "left_anti").groupBy("lang").agg(F.count("*").alias("unlabelled"))
    return tidy(a.join(b, "lang", "full").fillna(0, ["labelled", "unlabelled"]))


def default_lookup(spark, d):
    """Each document's quality label, or -1."""
    x = T.table(spark, d, "documents").select("doc_id").join(T.table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return tidy(x.select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality")))


def dimension_lookup(spark, d):
    """Revenue by nation and region through small dimensions."""
    c, n, r = (T.table(spark, d, t) for t in ("customer", "nation", "region"))
    o = T.table(spark, d, "orders").select("o_custkey", "o_totalprice")
    x = o.join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.sum("o_totalprice").alias("revenue"), F.count("*").alias("n"))
    x = x.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    return x.select("r_name", "n_name", F.round("revenue", 2).alias("revenue"), "n")


def twins(spark, d):
    """Pairs of line items that are an order's only two, with different gold: how often their answers differ."""
    x = rows(spark, d)
    p = x.groupBy("task", "group_id").agg(F.count("*").alias("n"), F.min("gold").alias("g1"), F.max("gold").alias("g2"), F.min("chosen").alias("c1"), F.max("chosen").alias("c2"), F.sum(F.col("correct").cast("long")).alias("right")).where("n = 2 and g1 <> g2")
    return tidy(p.groupBy("task").agg(F.count("*").alias("pairs"), F.avg((F.col("c1") != F.col("c2")).cast("double")).alias("differ"), F.avg((F.col("right") == 2).cast("double")).alias("both_right")))


def source_ids(spark, d):
    """Ids with a suffix, which may stand twice, traced to their source rows: the sources' lengths."""
    from ..operators.text import source_id

    docs = T.table(spark, d, "documents")
    mark = F.element_at(F.array(F.lit("-D1-x"), F.lit("-D1-D1-7"), F.lit("")), F.col("doc_id").cast("int") % 3 + 1)
    x = docs.select(F.concat(F.col("doc_id").cast("string"), mark).alias("id")).withColumn("source_id", source_id(F.col("id"), "-D1"))
    full = docs.select(F.col("doc_id").cast("string").alias("source_id"), "n_chars")
    return tidy(x.join(full, "source_id", "left").select("id", "source_id", "n_chars"))


def score_grid(spark, d):
    """Rows against a small grid of temperatures: mean loss of each, without the fit."""
    x = T.decisions(spark, d).withColumn("temp", F.explode(F.array(*map(F.lit, (0.5, 1.0, 2.0, 3.0, 4.0)))))
    p = F.array(*E.softmax_columns([F.col(f"z{j}") for j in range(3)], F.col("temp")))
    return tidy(x.withColumn("p", p).groupBy("task", "temp").agg(F.avg(E.nll("p", "gold")).alias("nll")))


def set_operations(spark, d):
    """Sizes of the union, intersection and difference of the labelled and the English documents."""
    docs = T.table(spark, d, "documents")
    a, b = docs.where("lang = 'en'").select("doc_id"), T.table(spark, d, "labels").select("doc_id")
    parts = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": a.subtract(b), "union_all": a.union(b)}
    out = None
    for name, x in parts.items():
        one = x.agg(F.count("*").alias("n")).withColumn("kind", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def first_occurrence(spark, d):
    """Texts without repeats, by lower-cased text: each one's first document."""
    docs = T.table(spark, d, "documents")
    key = F.md5(F.lower(F.coalesce("text", F.lit(""))).cast("binary"))
    return docs.groupBy(key.alias("key")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def resume(spark, d):
    """What is left to do after an interrupted run that did the even documents."""
    from ..sources.files import todo

    docs = T.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source")
    return tidy(todo(docs, docs.where("id % 2 = 0")).groupBy("source").agg(F.count("*").alias("n")))


def strided(spark, d):
    """Every seventh document of each source, by id: places come from totals of blocks of ids, no source is sorted whole."""
    docs = T.table(spark, d, "documents").select("source", "doc_id", F.lit(1).cast("long").alias("n"))
    run = running_totals(docs, ["source"], "doc_id", ["n"], F.floor(F.col("doc_id") / 4096))
    return run.where((F.col("run_n") - 1) % 7 == 0).select("source", "doc_id")


def hashed_sample(spark, d):
    """Ten documents of each language by the order of a hash, without replacement."""
    w = Window.partitionBy("lang").orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id")
    return T.table(spark, d, "documents").withColumn("k", F.row_number().over(w)).where("k <= 10").select("lang", "doc_id")


def top_errors(spark, d):
    """The ten most confident errors of each task."""
    w = Window.partitionBy("task").orderBy(F.desc("c"), "id")
    x = rows(spark, d).where("not correct").withColumn("c", F.round("conf", 9)).withColumn("k", F.row_number().over(w)).where("k <= 10")
    return tidy(x.select("task", "k", "id", "c"))


def best_arm(spark, d):
    """The arm of best accuracy for each flag, the first by name at a tie."""
    x = rows(spark, d, "AB").groupBy("hard_type", "arm").agg(F.avg(F.col("correct").cast("double")).alias("a"))
    best = x.groupBy("hard_type").agg(F.min(F.struct((-F.col("a")).alias("a"), "arm")).alias("b"))
    return tidy(best.select("hard_type", "b.arm", (-F.col("b.a")).alias("accuracy")))


def distribution(spark, d):
    """Event types and their counts, commonest first, with shares and a binned curve of values."""
    e = T.table(spark, d, "events")
    b = F.when(F.col("value") < 25, "0-25").when(F.col("value") < 50, "25-50").when(F.col("value") < 75, "50-75").otherwise("75+")
    return tidy(e.groupBy("event_type", b.alias("bin")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"), F.count_distinct("user_id").alias("users")))


def speed_gates(spark, d):
    """Throughput of each ship year against the first one, and whether it is within 10 %."""
    r = rows(spark, d)
    x = r.groupBy("lang").agg(F.count("*").alias("n"), F.sum("latency_ms").alias("ms")).join(percentiles(r, ["lang"], "latency_ms", {"p50": 0.5}), "lang")
    first = x.agg(F.min_by("p50", "lang").alias("base"))
    x = x.crossJoin(F.broadcast(first))
    return tidy(x.select("lang", (F.col("n") / F.col("ms") * 1000.0).alias("per_second"), (F.col("p50") / F.col("base")).alias("ratio"), (F.col("p50") / F.col("base") <= 1.1).alias("ok")))


def threshold_derives(spark, d):
    """Limit, range, tolerance and rate checks on line items with half-even rounding."""
    li = T.table(spark, d, "lineitem")
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    x = li.select("l_returnflag", F.bround(unit, 1).alias("unit"), (unit > 1500).alias("over"), F.col("l_quantity").between(10, 20).alias("inside"), (F.abs(unit - 1000) <= 100).alias("tolerated"))
    n = lambda c: F.sum(F.col(c).cast("long")).alias(c)
    return tidy(x.groupBy("l_returnflag").agg(n("over"), n("inside"), n("tolerated"), F.count("*").alias("n")))


def tool_gate(spark, d):
    """A gate on orders: unknown customers, missing scope, role and amount, in this order of precedence."""
    o = T.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    c = T.table(spark, d, "customer").select(F.col("c_custkey"), "c_acctbal")
    x = o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    need, have = F.array(F.lit("read"), F.lit("write")), F.when(F.col("o_orderstatus") == "F", F.array(F.lit("read"), F.lit("write"))).otherwise(F.array(F.lit("read")))
    gate = F.when(F.col("c_custkey").isNull(), "unknown").when(F.size(F.array_except(need, have)) > 0, "scope").when(F.col("c_acctbal") < 0, "role").when(F.col("o_totalprice") > 200000, "confirm").otherwise("allow")
    return tidy(x.groupBy(gate.alias("gate")).agg(F.count("*").alias("n")))


def rotations(spark, d):
    """Readouts over three rotations: mean log-probability and mean probability by option, with the position prior removed.

    A row's rotations and options are columns beside one another, so rows are grouped by id once, as one row of sums each;
    the id holds the group's."""
    three = range(3)
    x = T.decisions(spark, d)
    pos = lambda r: E.log_softmax_columns([F.col(f"z{(i - r) % 3}") + (0.4 if i == 0 else 0.0) - 12.0 for i in three])
    x = x.withColumns({f"pos{r}{i}": v for r in three for i, v in enumerate(pos(r))})
    add = lambda values: reduce(lambda a, b: a + b, values)
    prior = x.groupBy("task").agg(*(F.avg(add(F.exp(f"pos{r}{i}") for r in three) / 3.0).alias(f"q{i}") for i in three))
    prior = prior.select("task", *(F.log(F.greatest(F.col(f"q{i}"), F.lit(1e-6))).alias(f"prior{i}") for i in three))
    x = x.join(F.broadcast(prior), "task")
    at = lambda name, r, o: F.col(f"{name}{r}{(o + r) % 3}")  # noqa: E731 (option o stood at position o + r)
    sums = {"l": lambda o: add(at("pos", r, o) for r in three), "p": lambda o: add(F.exp(at("pos", r, o)) for r in three), "c": lambda o: add(at("pos", r, o) - F.col(f"prior{(o + r) % 3}") for r in three)}
    y = x.groupBy("task", "id", "gold").agg(F.count("*").alias("n"), *(F.sum(f(o)).alias(f"{k}{o}") for k, f in sums.items() for o in three))
    mean = lambda k, o: F.round(F.col(f"{k}{o}") / (3.0 * F.col("n")), 9)
    best = y.select("task", "gold", *(mean(k, o).alias(f"{k}{o}") for k in sums for o in three)).select("task", "gold", *(E.argmax_columns([F.col(f"{k}{o}") for o in three]).alias(k) for k in sums))
    return tidy(best.groupBy("task").agg(F.count("*").alias("n"), *(F.avg((F.col(k) == F.col("gold")).cast("double")).alias(f"acc_{k}") for k in ("l", "p", "c")), F.sum((F.col("l") != F.col("p")).cast("long")).alias("flips")))


#: pos: log-softmax by rotation r and position; al: by option; pr: the positions' mean probabilities.
ROTATED = f"""{T.SQL}, x as (select id, task, group_id, gold, r, i, case (i - r + 3) % 3 when 0 then z0 when 1 then z1 else z2 end + case when i = 0 then 0.4::double else 0 end - 12 v from dec, (select unnest([0, 1, 2]) r), (select unnest([0, 1, 2]) i) where arm = 'A'),
k as (select *, greatest(-30::double, least(0::double, v)) c from x), pos as (select *, c - ln(sum(exp(c)) over (partition by task, id, group_id, r)) lp from k),
pr as (select task, i, ln(greatest(avg(exp(lp)), 1e-6::double)) prior from pos group by task, i),
al as (select pos.task, id, group_id, gold, r, (pos.i - r + 3) % 3 o, lp, lp - prior clean from pos join pr on pos.task = pr.task and pos.i = pr.i),
y as (select task, id, group_id, gold, o, round(avg(lp), 9) l, round(avg(exp(lp)), 9) p, round(avg(clean), 9) c from al group by task, id, group_id, gold, o),
b as (select task, id, group_id, gold, arg_min(o, (-l, o)) l, arg_min(o, (-p, o)) p, arg_min(o, (-c, o)) c from y group by task, id, group_id, gold)
select task, count(*) n, round(avg((l = gold)::int), 6) acc_l, round(avg((p = gold)::int), 6) acc_p, round(avg((c = gold)::int), 6) acc_c, sum((l <> p)::int)::bigint flips from b group by task"""


def permutations(spark, d):
    """Options read in two orders, the second with a leaning to its first place: aligned probabilities, how far they lie
    from the first order's, and how often the answer depends on the order."""
    three, order = range(3), (2, 0, 1)
    z = [F.col(f"z{j}") for j in three]
    seen = E.softmax_columns([z[o] + (1.5 if i == 0 else 0.0) for i, o in enumerate(order)])
    x = T.decisions(spark, d).withColumns({f"{name}{j}": v for name, values in (("p", E.softmax_columns(z)), ("q", E.unpermute_columns(seen, order))) for j, v in enumerate(values)})
    p, q = ([F.col(f"{name}{j}") for j in three] for name in "pq")
    x = x.select("task", "gold", F.greatest(*(F.abs(a - b) for a, b in zip(p, q, strict=True))).alias("diff"), E.argmax_columns(p).alias("chosen"), E.argmax_columns(q).alias("other"))
    return tidy(x.groupBy("task").agg(F.avg("diff").alias("mean_diff"), F.avg((F.col("other") != F.col("chosen")).cast("double")).alias("sensitive"), F.avg((F.col("other") == F.col("gold")).cast("double")).alias("accuracy")))


PERMUTED = f"""{T.SQL}, a as (select *, exp(z0 - greatest(z0, z1, z2 + 1.5::double)) e0_, exp(z1 - greatest(z0, z1, z2 + 1.5::double)) e1_, exp(z2 + 1.5::double - greatest(z0, z1, z2 + 1.5::double)) e2_ from p where arm = 'A'),
b as (select *, e0_ / (e0_ + e1_ + e2_) q0, e1_ / (e0_ + e1_ + e2_) q1, e2_ / (e0_ + e1_ + e2_) q2 from a), c as (select *, case when q0 >= q1 and q0 >= q2 then 0 when q1 >= q2 then 1 else 2 end ch from b)
select task, round(avg(greatest(abs(p0 - q0), abs(p1 - q1), abs(p2 - q2))), 6) mean_diff, round(avg((ch <> chosen)::int), 6) sensitive, round(avg((ch = gold)::int), 6) accuracy from c group by task"""


def coherence(spark, d):
    """Gap between an option's probability and one minus the others' from arm B's readout, how often both arms choose alike,
    and how far the options' probabilities move between them."""
    p = P.pair(rows(spark, d, "AB"), "A", "B", ["task", "id", "hard_type"], ["p", "chosen"])
    gap = F.abs(F.get("p_a", F.lit(0)) + F.get("p_b", F.lit(1)) + F.get("p_b", F.lit(2)) - 1.0)
    same = (F.col("chosen_a") == F.col("chosen_b")).cast("double")
    return tidy(p.groupBy("task").agg(F.avg(gap).alias("gap"), F.avg((gap > 0.1).cast("double")).alias("over"), F.avg(same).alias("agreement"), F.avg(E.max_abs_difference("p_a", "p_b")).alias("order_effect")))


def validation(spark, d):
    """Rule violations of line items as gold rows: repeated ids and pairs of wrong size, counted by rule."""
    x = T.decisions(spark, d).select("id", "task", F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), F.col("gold") + 1).alias("gold"), F.col("group_id").alias("pair_id"))
    return tidy(Q.validate_rows(x, ["A", "B"], ["id", "task"]).groupBy("rule").agg(F.count("*").alias("n")))


def stored_check(spark, d):
    """Rows whose stored flag, wrong for one in a thousand, differs from the recomputed one."""
    x = rows(spark, d).withColumn("stored_correct", F.when(E.hash_unit("id", F.lit("s"), buckets=1000) < 0.001, ~F.col("correct")).otherwise(F.col("correct")))
    return tidy(Q.stored_mismatch(x).groupBy("task").agg(F.count("*").alias("n")))


_A = f"{T.SQL}, a as (select *, chosen = gold correct from p where arm = 'A')"
QUERIES: dict[str, Query] = {
    "j01_gold_join": (gold_join, "select source, count(*) n, sum(quality)::bigint good, round(avg(n_chars), 6) chars from labels join documents using (doc_id) group by source"),
    "j02_common_ids": (common_ids, "select l_orderkey from lineitem group by l_orderkey having count(distinct l_returnflag) = (select count(distinct l_returnflag) from lineitem)"),
    "j03_semi_anti": (semi_anti, "select lang, sum((doc_id in (select doc_id from labels))::int)::bigint labelled, sum((doc_id not in (select doc_id from labels))::int)::bigint unlabelled from documents group by lang"),
    "j06_default_lookup": (default_lookup, "select d.doc_id, coalesce(quality, -1)::bigint quality from documents d left join labels l on d.doc_id = l.doc_id"),
    "j07_dimension_lookup": (dimension_lookup, "select r_name, n_name, round(sum(o_totalprice), 2) revenue, count(*) n from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by r_name, n_name"),
    "j08_twins": (twins, f"{_A}, t as (select task, group_id, count(*) n, min(gold) g1, max(gold) g2, min(chosen) c1, max(chosen) c2, sum(correct::int) r from a group by task, group_id) select task, count(*) pairs, round(avg((c1 <> c2)::int), 6) differ, round(avg((r = 2)::int), 6) both_right from t where n = 2 and g1 <> g2 group by task"),
    "j09_source_ids": (source_ids, "select doc_id || case doc_id % 3 when 0 then '-D1-x' when 1 then '-D1-D1-7' else '' end id, doc_id || case doc_id % 3 when 1 then '-D1' else '' end source_id, case when doc_id % 3 <> 1 then n_chars end n_chars from documents"),
    "j13_score_grid": (score_grid, f"{T.SQL}, k as (select unnest([0.5::double, 1::double, 2::double, 3::double, 4::double]) temp), x as (select task, gold, temp, z0, z1, z2, greatest(z0, z1, z2) m from dec, k where arm = 'A') select task, temp, round(avg(-ln(greatest(exp((case gold when 0 then z0 when 1 then z1 else z2 end - m) / temp) / (exp((z0 - m) / temp) + exp((z1 - m) / temp) + exp((z2 - m) / temp)), 1e-12::double))), 6) nll from x group by task, temp"),
    "u01_set_operations": (set_operations, "with a as (select doc_id from documents where lang = 'en'), b as (select doc_id from labels) select 'union' kind, count(*) n from (select * from a union select * from b) union all select 'intersect', count(*) from (select * from a intersect select * from b) union all select 'except', count(*) from (select * from a except select * from b) union all select 'union_all', count(*) from (select * from a union all select * from b)"),
    "u04_first_occurrence": (first_occurrence, "select md5(lower(coalesce(text, ''))) key, min(doc_id) doc_id, count(*) copies from documents group by 1"),
    "s09_resume": (resume, "select source, count(*) n from documents where doc_id % 2 <> 0 group by source"),
    "t03_strided": (strided, "select source, doc_id from (select source, doc_id, row_number() over (partition by source order by doc_id) - 1 k from documents) where k % 7 = 0"),
    "t04_hashed_sample": (hashed_sample, "select lang, doc_id from (select lang, doc_id, row_number() over (partition by lang order by md5(doc_id::varchar), doc_id) k from documents) where k <= 10"),
    "t06_top_errors": (top_errors, f"{_A}, r as (select task, id, round(conf, 9) c, row_number() over (partition by task order by round(conf, 9) desc, id) k from a where not correct) select task, k, id, round(c, 6) c from r where k <= 10"),
    "t07_best_arm": (best_arm, f"{T.SQL}, x as (select hard_type, arm, avg((chosen = gold)::int) a from p group by all), r as (select *, row_number() over (partition by hard_type order by a desc, arm) k from x) select hard_type, arm, round(a, 6) accuracy from r where k = 1"),
    "a36_distribution": (distribution, "select event_type, case when value < 25 then '0-25' when value < 50 then '25-50' when value < 75 then '50-75' else '75+' end bin, count(*) n, round(sum(value), 2) total, count(distinct user_id) users from events group by 1, 2"),
    "a38_speed_gates": (speed_gates, f"{_A}, x as (select lang, count(*) n, sum(latency_ms) ms, quantile_cont(latency_ms, 0.5) p50 from a group by lang), b as (select arg_min(p50, lang) base from x) select lang, round(n / ms * 1000, 6) per_second, round(p50 / base, 6) ratio, p50 / base <= 1.1::double ok from x, b"),
    "p29_threshold_derives": (threshold_derives, "with x as (select l_returnflag, l_extendedprice / l_quantity u, l_quantity q from lineitem) select l_returnflag, sum((u > 1500)::int)::bigint \"over\", sum((q between 10 and 20)::int)::bigint inside, sum((abs(u - 1000) <= 100)::int)::bigint tolerated, count(*) n from x group by l_returnflag"),
    "p30_tool_gate": (tool_gate, "select case when c_custkey is null then 'unknown' when o_orderstatus <> 'F' then 'scope' when c_acctbal < 0 then 'role' when o_totalprice > 200000 then 'confirm' else 'allow' end gate, count(*) n from orders left join customer on o_custkey = c_custkey group by 1"),
    "p18_rotations": (rotations, ROTATED),
    "p19_permutations": (permutations, PERMUTED),
    "p23_coherence": (coherence, f"{T.SQL}, x as (select a.task, abs(a.p0 + b.p1 + b.p2 - 1) g, a.chosen = b.chosen same, greatest(abs(a.p0 - b.p0), abs(a.p1 - b.p1), abs(a.p2 - b.p2)) m from p a join p b on a.task = b.task and a.id = b.id and a.hard_type = b.hard_type where a.arm = 'A' and b.arm = 'B') select task, round(avg(g), 6) gap, round(avg((g > 0.1::double)::int), 6) \"over\", round(avg(same::int), 6) agreement, round(avg(m), 6) order_effect from x group by task"),
    "g08_validation": (validation, f"{T.SQL}, x as (select id, task, gold, group_id from dec where arm = 'A'), pr as (select group_id, count(*) n, min(gold) a, max(gold) b from x group by group_id), sh as (select task, max(c) m, sum(c) n from (select task, gold, count(*) c from x group by task, gold) group by task) select * from (select 'gold_not_an_option' rule, count(*) n from x where gold = 2 union all select 'id_repeats', count(*) from (select id from x group by id having count(*) > 1) union all select 'pair_size', count(*) from pr where n <> 2 union all select 'pair_same_gold', count(*) from pr where n = 2 and a = b union all select 'warning_unbalanced', count(*) from sh where m > 0.5::double * n) where n > 0"),
    "g10_stored_check": (stored_check, f"{_A} select task, count(*) n from a where {T.sql_unit('id || ' + chr(39) + ':s' + chr(39), 1000)} < 0.001::double group by task"),
}
