"""Panel operators over orders and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import panel as P
from ..operators import verbs as V
from .registry import register, table

DAILY = """daily as (select user_id, (ts::date - date '1970-01-01')::int as day, arg_max(event_type, (ts, event_id)) as status, sum(value) as value, count(*) as n from events group by 1, 2)"""
YEARLY = """yearly as (select o_custkey, year(o_orderdate)::int as year, count(*) as n, sum(o_totalprice) as total, max(o_orderpriority) as priority from orders group by 1, 2)"""


def daily(spark, d):
    e = table(spark, d, "events").withColumn("day", F.datediff(F.to_date("ts"), F.lit("1970-01-01")))
    return e.groupBy("user_id", "day").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.sum("value").alias("value"), F.count("*").alias("n"))


def yearly(spark, d):
    o = table(spark, d, "orders").withColumn("year", F.year("o_orderdate"))
    return o.groupBy("o_custkey", "year").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"), F.max("o_orderpriority").alias("priority"))


@register("q_turnover_guarded_lag", """
with t as (select p_brand, year(o_orderdate)::int as year, l_suppkey, sum(l_extendedprice * (1 - l_discount)) as revenue from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey group by 1, 2, 3),
top as (select p_brand, year, l_suppkey from t qualify row_number() over (partition by p_brand, year order by round(revenue, 2) desc, l_suppkey) = 1),
c as (select *, case when lag(year) over w = year - 1 then (lag(l_suppkey) over w <> l_suppkey)::int end as changed from top window w as (partition by p_brand order by year))
select year, count(*) as n_brands, count(changed) as n_known, round(avg(changed), 6) as change_share from c group by year""")
def turnover(spark, d):
    """Share of part brands whose top supplier by revenue differs from the year before."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    orders = table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"))
    parts = table(spark, d, "part").select("p_partkey", "p_brand")
    t = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(parts, lines.l_partkey == parts.p_partkey).groupBy("p_brand", "year", "l_suppkey").agg(F.round(F.sum("r"), 2).alias("revenue"))
    top = V.first_per_group(t, ["p_brand", "year"], [F.desc("revenue"), "l_suppkey"])
    c = P.turnover(top, ["p_brand"], "year", "l_suppkey")
    return c.groupBy("year").agg(F.count("*").alias("n_brands"), F.count("changed").alias("n_known"), F.round(F.avg("changed"), 6).alias("change_share"))


@register("q_calendar_lag", f"""with {DAILY} select a.user_id, a.day, a.n, b.n as n_before, c.n as n_after from daily a
left join daily b on a.user_id = b.user_id and b.day = a.day - 1 left join daily c on a.user_id = c.user_id and c.day = a.day + 1""")
def calendar_lag(spark, d):
    out = P.calendar_lag(daily(spark, d), ["user_id"], "day", "n", "n_before", 1)
    return P.calendar_lag(out, ["user_id"], "day", "n", "n_after", -1).select("user_id", "day", "n", "n_before", "n_after")


_HOLES = "h as (select user_id, day, case when (user_id + day) % 3 <> 0 then status end as status from daily)"


@register("q_agreement_fill", f"""with {DAILY}, {_HOLES},
f as (select *, last_value(status ignore nulls) over (partition by user_id order by day rows between unbounded preceding and current row) as b, first_value(status ignore nulls) over (partition by user_id order by day rows between current row and unbounded following) as a,
 lag(status) over (partition by user_id order by day) as pb, lead(status) over (partition by user_id order by day) as pa from h)
select user_id, day, status, coalesce(status, case when b is null then a when a is null or a = b then b end) as agreed, b as forward, a as backward, coalesce(status, case when pb = pa then pb end) as single from f""")
def agreement_fill(spark, d):
    h = daily(spark, d).select("user_id", "day", F.when((F.col("user_id") + F.col("day")) % 3 != 0, F.col("status")).alias("status"))
    out = P.fill(h, ["user_id"], "day", "status", "agreed")
    for how in ("forward", "backward"):
        out = P.fill(out, ["user_id"], "day", "status", how, how)
    return P.fill_single_gap(out, ["user_id"], "day", "status", "single")


@register("q_episodes", f"""with {DAILY}, m as (select *, case when lag(day) over w = day - 1 and lag(status) over w is not distinct from status then 0 else 1 end as new from daily window w as (partition by user_id order by day)),
s as (select *, sum(new) over (partition by user_id order by day rows unbounded preceding) as spell from m), r as (select user_id, spell::bigint as spell, status, min(day) as begin, max(day) as "end", count(*) as length from s group by 1, 2, 3)
select *, begin = min(begin) over (partition by user_id) as censored_left, "end" = max("end") over (partition by user_id) as censored_right from r""")
def episodes(spark, d):
    return P.spells(daily(spark, d), ["user_id"], "day", "status")


@register("q_longest_run", f"""with {DAILY}, i as (select user_id, day - row_number() over (partition by user_id order by day) as island from daily) select user_id, max(n) as longest_run from (select user_id, island, count(*) as n from i group by 1, 2) group by 1""")
def longest_run(spark, d):
    return P.longest_run(daily(spark, d), ["user_id"], "day")


@register("q_gap_year", f"""with {YEARLY} select o_custkey, a.year + 1 as gap from yearly a where exists (select 1 from yearly b where b.o_custkey = a.o_custkey and b.year = a.year + 2) and not exists (select 1 from yearly b where b.o_custkey = a.o_custkey and b.year = a.year + 1)""")
def gap_year(spark, d):
    return P.gap_periods(yearly(spark, d), ["o_custkey"], "year")


@register("q_densify_panel", f"""with {YEARLY}, g as (select o_custkey, unnest(generate_series(min(year), max(year)))::int as year from yearly group by 1) select g.o_custkey, g.year, y.n from g left join yearly y using (o_custkey, year)""")
def densify(spark, d):
    return P.densify(yearly(spark, d).select("o_custkey", "year", "n"), ["o_custkey"], "year")


@register("q_future_flags", f"""with {YEARLY} select o_custkey, year, bool_or(n >= 3) over (partition by o_custkey order by year range between 1 following and unbounded following) as busy_later from yearly""")
def future_flags(spark, d):
    return P.future_any(yearly(spark, d), ["o_custkey"], "year", F.col("n") >= 3, "busy_later").select("o_custkey", "year", "busy_later")


@register("q_running_counts", f"""with {YEARLY} select o_custkey, year, (sum(n) over w)::bigint as running_sum, max(n) over w as running_max, year <> lag(year) over (partition by o_custkey order by year) + 1 as skipped from yearly window w as (partition by o_custkey order by year rows unbounded preceding)""")
def running(spark, d):
    return P.running(yearly(spark, d), ["o_custkey"], "year", "n").select("o_custkey", "year", "running_sum", "running_max", "skipped")


@register("q_values_before", f"""with {YEARLY} select o_custkey, year, array_to_string(list_sort(list_distinct(coalesce(list(priority) over (partition by o_custkey order by year rows between unbounded preceding and 1 preceding), []))), ';') as before from yearly""")
def values_before(spark, d):
    out = P.values_before(yearly(spark, d), ["o_custkey"], "year", "priority", "b")
    return out.select("o_custkey", "year", F.array_join("b", ";").alias("before"))


@register("q_event_sample", f"""with {DAILY}, e as (select user_id, day, status = 'error' as e from daily), t as (select *, min(case when e then day end) over (partition by user_id) as event_time from e),
s as (select *, count(distinct case when abs(day - event_time) <= 1 then day end) over (partition by user_id) as seen, count(case when abs(day - event_time) <= 1 and e and day <> event_time then 1 end) over (partition by user_id) as others from t)
select user_id, day, event_time, day - event_time as relative, event_time is null as never, event_time is not null and seen = 3 and others = 0 as balanced from s""")
def event_sample(spark, d):
    x = P.event_sample(daily(spark, d).select("user_id", "day", "status"), ["user_id"], "day", F.col("status") == "error", 1)
    return x.select("user_id", "day", "event_time", "relative", "never", "balanced")


@register("q_first_event", f"""with {YEARLY} select o_custkey, year, coalesce(min(case when n >= 2 and year between 1996 and 1997 then year end) over w, min(case when n >= 2 then year end) over w) as first_busy from yearly window w as (partition by o_custkey)""")
def first_event(spark, d):
    return P.first_event(yearly(spark, d), ["o_custkey"], "year", F.col("n") >= 2, "first_busy", (1996, 1997)).select("o_custkey", "year", "first_busy")


@register("q_status_flags", f"""with {DAILY}, g as (select *, case when lag(day) over w = day - 1 then lag(status) over w end as s from daily window w as (partition by user_id order by day))
select user_id, day, (status = 'error')::int as is_error, (status = 'error' and not s = 'error')::int as to_error, (s = 'error' and not status = 'error')::int as from_error, (status = 'error' and s = 'error')::int as stays_error from g""")
def status_flags(spark, d):
    return P.status_flags(daily(spark, d), ["user_id"], "day", "status", ["error"]).select("user_id", "day", "is_error", "to_error", "from_error", "stays_error")


@register("q_transition_prob", f"""with {DAILY}, g as (select status as next, case when lag(day) over w = day - 1 then lag(status) over w end as prev from daily window w as (partition by user_id order by day)),
c as (select prev, next, count(*) as n from g where prev is not null group by 1, 2) select prev, next, n, round(n / sum(n) over (partition by prev), 6) as probability from c""")
def transition_prob(spark, d):
    return P.transition_probabilities(daily(spark, d), ["user_id"], "day", "status").withColumn("probability", F.round("probability", 6))


@register("q_career_moves", """
with p as (select o_custkey, year(o_orderdate)::int as year, list_sort(list(distinct o_orderstatus)) as e, list_sort(list(distinct o_orderpriority)) as r from orders group by 1, 2),
g as (select *, case when lag(year) over w = year - 1 then lag(e) over w end as e0, case when lag(year) over w = year - 1 then lag(r) over w end as r0 from p window w as (partition by o_custkey order by year)),
f as (select *, len(list_filter(e, lambda x: not list_contains(e0, x))) > 0 as ne, len(list_filter(r, lambda x: not list_contains(r0, x))) > 0 as nr from g)
select o_custkey, year, case when e0 is not null then (not ne and nr)::int end as internal, case when e0 is not null then (ne and nr)::int end as external,
case when e0 is not null then (ne and not nr)::int end as lateral, case when e0 is not null then (ne and list_has_any(e, e0))::int end as within_system from f""")
def career_moves(spark, d):
    o = table(spark, d, "orders").withColumn("year", F.year("o_orderdate"))
    return P.career_moves(o, "o_custkey", "year", "o_orderstatus", "o_orderpriority")


@register("q_state_sequence", f"""with {YEARLY}, g as (select o_custkey, unnest(generate_series(min(year), max(year)))::int as year, min(year) as y0 from yearly group by 1), f as (select o_custkey, g.year - y0 as t, coalesce(y.priority, 'Missing') as s from g left join yearly y using (o_custkey, year))
select o_custkey, coalesce(max(s) filter (t = 0), 'Out of Sample') as t0, coalesce(max(s) filter (t = 1), 'Out of Sample') as t1, coalesce(max(s) filter (t = 2), 'Out of Sample') as t2 from f group by 1""")
def state_sequence(spark, d):
    y = yearly(spark, d).select("o_custkey", "year", "priority")
    return P.sequences(y, "o_custkey", "year", "priority", {}, [0, 1, 2])


@register("q_expand_grid_zero_filled", """with g as (select * from (select distinct o_orderstatus from orders), (select distinct o_orderpriority from orders)) select o_orderstatus, o_orderpriority, count(o_orderkey) as n from g left join orders using (o_orderstatus, o_orderpriority) group by 1, 2""")
def zero_filled(spark, d):
    o = table(spark, d, "orders")
    n = o.groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    return P.expand_grid(o, ["o_orderstatus", "o_orderpriority"]).join(n, ["o_orderstatus", "o_orderpriority"], "left").fillna(0, ["n"])
