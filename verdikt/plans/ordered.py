"""Queries over ordered series: control charts, hourly output, windows, carries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import series as S
from . import tables as T
from .util import Query, tidy


def events(spark, d):
    e = T.table(spark, d, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.withColumn("i", F.row_number().over(w))


EV = "with ev as (select *, row_number() over (partition by user_id order by ts, event_id) i from events)"


def spc(spark, d):
    """Chart statistics of each user's values around their mean, with limits at one and a half deviations, and the rule."""
    e = events(spark, d)
    lim = e.groupBy("user_id").agg(F.round(F.avg("value"), 4).alias("cl"), F.round(F.stddev_pop("value"), 4).alias("sd"))
    e = e.join(lim, "user_id").withColumn("ucl", F.col("cl") + 1.5 * F.col("sd")).withColumn("lcl", F.col("cl") - 1.5 * F.col("sd"))
    st = S.spc_stats(e, ["user_id"], ["i"], "value", "cl", "ucl", "lcl")
    return tidy(st.withColumn("decision", S.spc_decision(F.col("user_id") % 2 == 0)))


SPC = f"""{EV}, lim as (select user_id, round(avg(value), 4) cl, round(stddev_pop(value), 4) sd from ev group by user_id),
a as (select ev.user_id, i, value v, cl, cl + 1.5::double * sd ucl, cl - 1.5::double * sd lcl, (cl + 1.5::double * sd - cl) / 3 sg from ev join lim using (user_id)),
b as (select *, case when v > cl then 1 when v < cl then -1 else 0 end s, coalesce(sign(v - lag(v) over (partition by user_id order by i)), 0)::int m from a),
c as (select *, sum(case when s = ls then 0 else 1 end) over (partition by user_id order by i) sg1, sum(case when m = lm then 0 else 1 end) over (partition by user_id order by i) mg from (select *, lag(s) over (partition by user_id order by i) ls, lag(m) over (partition by user_id order by i) lm from b)),
e as (select *, row_number() over (partition by user_id, sg1 order by i) sr, row_number() over (partition by user_id, mg order by i) mr, case when i >= 3 then greatest(sum((v > cl + 2 * sg)::int) over w3, sum((v < cl - 2 * sg)::int) over w3) else 0 end two from c window w3 as (partition by user_id order by i rows between 2 preceding and current row)),
f as (select user_id, count(*) points, sum((v > ucl or v < lcl)::int)::bigint n_out, max(case when s = 0 then 0 else sr end) side_run, max(case when m = 0 then 1 else mr + 1 end) monotone_run, max(two)::bigint two_of_three from e group by user_id)
select *, case when n_out >= 2 or (n_out = 1 and user_id % 2 = 0) then 'D' when n_out = 1 then 'C' when side_run >= 7 or monotone_run >= 6 or two_of_three >= 2 then 'B' else 'A' end decision from f"""


def hourly(spark, d):
    return tidy(S.hourly(events(spark, d), ["user_id"], ["i"], "value", 50.0))


def greedy(spark, d):
    """Each user's events as segments of pseudo-times: windows of 8 units or 25 tokens, capped at 15."""
    e = events(spark, d).withColumn("start", (F.col("i") - 1) * 2.5).withColumn("end", (F.col("i") - 1) * 2.5 + F.col("event_id") % 7).withColumn("tokens", F.col("event_id") % 13)
    w = S.greedy_windows(e, ["user_id"], ["i"], "start", "end", "tokens")
    return tidy(w)


GREEDY = f"""with recursive {EV[5:]}, sg as (select user_id, i, (i - 1) * 2.5::double s, (i - 1) * 2.5::double + event_id % 7 e, event_id % 13 k from ev),
st as (select user_id, 0::bigint i, -1::bigint w, null::double t0, null::double t1, 0::bigint n, 0::bigint k, true closed from (select distinct user_id from sg)
 union all select sg.user_id, sg.i, case when st.closed or sg.e - st.t0 > 15 then st.w + 1 else st.w end, case when st.closed or sg.e - st.t0 > 15 then sg.s else st.t0 end, sg.e,
  case when st.closed or sg.e - st.t0 > 15 then 1 else st.n + 1 end, case when st.closed or sg.e - st.t0 > 15 then sg.k else st.k + sg.k end,
  case when st.closed or sg.e - st.t0 > 15 then sg.e - sg.s >= 8 or sg.k >= 25 else sg.e - st.t0 >= 8 or st.k + sg.k >= 25 end
 from st join sg on sg.user_id = st.user_id and sg.i = st.i + 1)
select user_id, w, max(round(t0, 6)) t0, round(arg_max(t1, i), 6) t1, max(n)::bigint n_seg, max(k)::bigint n_tok from st where w >= 0 group by user_id, w"""


def previous_turn(spark, d):
    """Length of each user turn and of the user turn before it in its conversation; empty turns are left out first."""
    c = T.table(spark, d, "conversations").where("role = 'user'")
    x = S.carry(c, ["conv_id"], ["turn"], "text", F.length(F.coalesce("text", F.lit(""))) > 0)
    return tidy(x.select("conv_id", "turn", F.length("text").alias("n"), F.length("prev_text").alias("n_before")))


def turn_offsets(spark, d):
    c = T.table(spark, d, "conversations").withColumn("n", F.length(F.coalesce("text", F.lit(""))))
    return tidy(S.offsets(c, ["conv_id"], ["turn"], "n").select("conv_id", "turn", "n", "offset"))


QUERIES: dict[str, Query] = {
    "p26_spc_rules": (spc, SPC),
    "p28_hourly": (hourly, f"{EV}, d as (select user_id, value, lag(value) over (partition by user_id order by i) - value dr from ev) select user_id, round(avg(value) / 50, 6) share, round(min(value), 6) least, round(greatest(coalesce(max(dr), 0), 0), 6) \"drop\" from d group by user_id"),
    "w09_greedy_windows": (greedy, GREEDY),
    "w08_previous_turn": (previous_turn, "select conv_id, turn, length(text) n, length(lag(text) over (partition by conv_id order by turn)) n_before from conversations where role = 'user' and length(coalesce(text, '')) > 0"),
    "w10_turn_offsets": (turn_offsets, "select conv_id, turn, length(coalesce(text, '')) n, coalesce(sum(length(coalesce(text, ''))) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0)::bigint \"offset\" from conversations"),
}
