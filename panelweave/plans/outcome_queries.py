"""Outcomes of panels over orders and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import estimation as E
from ..operators import joins as J
from ..operators import outcomes as U
from ..operators import panel as P
from .panel_queries import DAILY, YEARLY, daily, yearly
from .registry import register, table

_STATUS = "s as (select o_custkey as e, year(o_orderdate)::int as y, o_orderkey % 3 as tier, o_orderpriority as role, case o_orderstatus when 'F' then 'Active' when 'P' then 'Position does not exist' else 'Vacant' end as status, o_orderkey % 17 as person from orders)"


def _status(spark, d):
    s = F.col("o_orderstatus")
    return table(spark, d, "orders").select(
        F.col("o_custkey").alias("e"), F.year("o_orderdate").alias("y"), (F.col("o_orderkey") % 3).alias("tier"), F.col("o_orderpriority").alias("role"),
        F.when(s == "F", "Active").when(s == "P", "Position does not exist").otherwise("Vacant").alias("status"), (F.col("o_orderkey") % 17).alias("person"))


@register("q_staffing_shares", f"with {_STATUS}, r as (select e, y, tier, role, bool_or(status = 'Active') as a, bool_or(status <> 'Position does not exist') as x from s group by 1, 2, 3, 4) select e, y, tier, count(*) filter (x) as n_exist, count(*) filter (x and a) as n_active, round(count(*) filter (x and a) / nullif(count(*) filter (x), 0), 6) as share from r group by 1, 2, 3")
def staffing_shares(spark, d):
    return U.staffing_shares(_status(spark, d), ["e", "y"], "tier", "role", "status").withColumn("share", F.round("share", 6))


@register("q_people_per_role", f"with {_STATUS} select y, tier, count(distinct person) as people, count(distinct role) as roles, round(count(distinct person) / count(distinct role), 6) as per_role from s group by 1, 2")
def people_per_role(spark, d):
    return U.people_per_role(_status(spark, d), ["y", "tier"], "person", "role").withColumn("per_role", F.round("per_role", 6))


@register("q_first_match", f"with {_STATUS}, g as (select *, bool_or(role = '1-URGENT') over w as a, bool_or(role = '2-HIGH') over w as b from s window w as (partition by e, y)) select e, y, role, count(*) as n, (case when a then role = '1-URGENT' when b then role = '2-HIGH' else false end)::int as chief from g group by all")
def first_match(spark, d):
    out = U.first_match(_status(spark, d), ["e", "y"], [F.col("role") == "1-URGENT", F.col("role") == "2-HIGH"], "chief")
    return out.groupBy("e", "y", "role", "chief").agg(F.count("*").alias("n"))


@register("q_role_counts", f"with {_STATUS} select e, y, count(distinct role) as n_roles, (count(distinct role) = 1)::int as roles_1, (count(distinct role) = 2)::int as roles_2, (count(distinct role) >= 3)::int as roles_3 from s group by 1, 2")
def role_counts(spark, d):
    return U.role_counts(_status(spark, d), ["e", "y"], "role")


_HOLDER = "h as (select o_custkey as e, year(o_orderdate)::int as y, case when min(o_orderpriority) <> '3-MEDIUM' then min(o_orderpriority) end as h from orders group by 1, 2)"


def _holder(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("e"), F.year("o_orderdate").alias("y")).agg(F.min("o_orderpriority").alias("h"))
    return o.withColumn("h", F.nullif("h", F.lit("3-MEDIUM")))


@register("q_change_outcomes", f"""with {_HOLDER}, l as (select *, case when lag(y) over w = y - 1 then lag(h) over w end as h_lag1, case when lag(y, 2) over w = y - 2 then lag(h, 2) over w end as h_lag2, case when lag(y, 3) over w = y - 3 then lag(h, 3) over w end as h_lag3, lag(y) over w = y - 1 as t, lag(h) over w is null as b from h window w as (partition by e order by y))
select e, y, h, h_lag1, h_lag2, h_lag3, case when h_lag1 is not null and h_lag2 is not null and h is not null then (h_lag1 <> h or h_lag2 <> h)::int end as changed_within_2, case when h_lag1 is not null and h_lag2 is not null and h_lag3 is not null and h is not null then (h_lag1 <> h or h_lag2 <> h or h_lag3 <> h)::int end as changed_within_3,
case when t then (b and h is not null)::int end as filled, case when t then (not b and h is null)::int end as vacated from l""")
def change_outcomes(spark, d):
    return U.change_outcomes(_holder(spark, d), ["e"], "y", "h")


def _moves_sql(there: str) -> str:
    return f"""with p as (select o_custkey as k, year(o_orderdate)::int as y, list(distinct o_orderkey % 4) as e, list(distinct o_orderpriority) as r, list(distinct o_orderkey % 2) as s from orders group by 1, 2),
    l as (select *, lag(e) over w as e0, lag(r) over w as r0, lag(s) over w as s0, y - lag(y) over w as gap from p window w as (partition by k order by y)),
    n as (select *, len(list_intersect(e, e0)) < len(e) as ne, len(list_intersect(r, r0)) < len(r) as nr, len(list_intersect(s, s0)) > 0 as ss from l)
    select k, y, gap, case when {there} then (not ne and nr)::int end as internal_promotion, case when {there} then (ne and nr)::int end as external_promotion, case when {there} then (ne and not nr)::int end as lateral, case when {there} then (ne and not ss)::int end as across_system from n"""


def _moves(spark, d, consecutive):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.year("o_orderdate").alias("y"), (F.col("o_orderkey") % 4).alias("e"), F.col("o_orderpriority").alias("r"), (F.col("o_orderkey") % 2).alias("s"))
    return U.moves(o, "k", "y", "e", "r", "s", consecutive)


@register("q_moves", _moves_sql("gap = 1"))
def moves(spark, d):
    return _moves(spark, d, True)


@register("q_moves_any_gap", _moves_sql("gap is not null"))
def moves_any_gap(spark, d):
    return _moves(spark, d, False)


@register("q_trajectories", f"with {YEARLY}, t as (select *, priority as s, n >= 4 as busy from yearly) select o_custkey, year, count(*) over w > 0 as exists_later, round(max(total) over w, 2) as max_later, min(s) over w = s and max(s) over w = s as same_system_later, bool_or(busy) over w as busy_later from t window w as (partition by o_custkey order by year range between 1 following and unbounded following)")
def trajectories(spark, d):
    t = yearly(spark, d).withColumn("busy", F.col("n") >= 4)
    return U.trajectories(t, ["o_custkey"], "year", "total", "priority", ["busy"]).select("o_custkey", "year", "exists_later", F.round("max_later", 2).alias("max_later"), "same_system_later", "busy_later")


@register("q_ownership", f"""with {YEARLY}, x as (select o_custkey as i, year as y, case when n % 3 > 0 then priority end as s, case when o_custkey % 4 > 0 then o_custkey // 5 end as c, o_custkey // 7 as p from yearly),
cm as (select c, y, s from (select c, y, s, count(*) as n from x where s is not null and c is not null group by 1, 2, 3) qualify row_number() over (partition by c, y order by n desc, s) = 1), m as (select i, s from (select i, s, count(*) as n from x where s is not null group by 1, 2) qualify row_number() over (partition by i order by n desc, s) = 1),
q as (select i, y, min(s) as s from x where s is not null group by 1, 2)
select x.i, x.y, coalesce(x.s, cm.s, q.s, m.s) as owner, case when x.s is not null then 'own' when cm.s is not null then 'campus' when q.s is not null then 'parent' when m.s is not null then 'usual' end as owner_from from x left join cm on x.c = cm.c and x.y = cm.y left join q on q.i = x.p and q.y = x.y left join m on m.i = x.i""")
def ownership(spark, d):
    k = F.col("o_custkey")
    x = yearly(spark, d).select(k.alias("i"), F.col("year").alias("y"), F.when(F.col("n") % 3 > 0, F.col("priority")).alias("s"), F.when(k % 4 > 0, F.floor(k / 5)).alias("c"), F.floor(k / 7).alias("p"))
    return U.ownership(x, "i", "y", "s", "c", "p").select("i", "y", "owner", "owner_from")


@register("q_event_dummies", f"with {YEARLY}, e as (select *, year - min(case when n >= 4 then year end) over (partition by o_custkey) as r from yearly) select o_custkey, year, coalesce((greatest(-2, least(2, r)) = -2)::int, 0) as lead2, coalesce((r = 0)::int, 0) as lag0, coalesce((r = 1)::int, 0) as lag1, coalesce((r >= 2)::int, 0) as lag2 from e")
def event_dummies(spark, d):
    x = P.first_event(yearly(spark, d), ["o_custkey"], "year", F.col("n") >= 4, "e").withColumn("r", F.col("year") - F.col("e"))
    return U.event_dummies(x, "r", 2).select("o_custkey", "year", "lead2", "lag0", "lag1", "lag2")


@register("q_component_shares", "with e as (select year(o_orderdate)::int as y, o_orderstatus as c, sum(o_totalprice) as v from orders group by 1, 2), t as (select year(o_orderdate)::int as y, sum(o_totalprice) as t from orders group by 1) select y, c, round(v / t, 6) as share from e join t using (y)")
def component_shares(spark, d):
    o = table(spark, d, "orders").select(F.year("o_orderdate").alias("y"), F.col("o_orderstatus").alias("c"), F.col("o_totalprice").alias("v"))
    e = o.groupBy("y", "c").agg(F.sum("v").alias("v")).unionByName(o.groupBy("y").agg(F.sum("v").alias("v")).withColumn("c", F.lit("all")))
    return U.component_shares(e, "y", "c", "v", "all").select("y", "c", F.round("share", 6).alias("share"))


@register("q_scaled_effects", f"with {YEARLY}, e as (select *, year - min(case when n >= 4 then year end) over (partition by o_custkey) as r from yearly), f as (select r, avg(n) as b, stddev_samp(n) / sqrt(count(*)) as se from e where r between 0 and 2 group by 1), m as (select avg(n) as m from e where r < 0) select r, round(b / m, 6) as relative, round(se / m, 6) as relative_se from f, m")
def scaled_effects(spark, d):
    x = P.first_event(yearly(spark, d), ["o_custkey"], "year", F.col("n") >= 4, "e").withColumn("r", F.col("year") - F.col("e"))
    effects = x.filter("r between 0 and 2").groupBy("r").agg(F.avg("n").alias("b"), (F.stddev_samp("n") / F.sqrt(F.count("*"))).alias("se")).withColumn("outcome", F.lit("n"))
    return U.scaled_effects(effects, E.pre_means(x, "r", ["n"])).select("r", F.round("relative", 6).alias("relative"), F.round("relative_se", 6).alias("relative_se"))


@register("q_membership_shares", "with p as (select user_id, bool_or(event_type = 'purchase') as e, bool_and(value > 0.5) as o, bool_or(value > 0.5) as v from events group by 1), g as (select distinct event_type, user_id from events) select event_type, count(*) as people, round(avg(v::int), 6) as ever, round(avg(o::int), 6) as only, round(avg((v and not o)::int), 6) as both from g join p using (user_id) group by 1")
def membership_shares(spark, d):
    out = U.membership_shares(table(spark, d, "events"), "user_id", "event_type", F.col("value") > 0.5)
    return out.withColumns({c: F.round(c, 6) for c in ("ever", "only", "both")})


@register("q_joint_run", f"with {DAILY}, u as (select distinct user_id as i from daily), p as (select a.i as id1, b.i as id2 from u a join u b on a.i < b.i and a.i // 8 = b.i // 8), h as (select distinct id1, id2, day from p join daily on user_id in (id1, id2)), g as (select id1, id2, day - row_number() over (partition by id1, id2 order by day) as g from h) select id1, id2, max(n) as longest from (select id1, id2, g, count(*) as n from g group by 1, 2, 3) group by 1, 2")
def joint_run(spark, d):
    h = daily(spark, d)
    pairs = J.block_pairs(h.withColumn("b", F.floor(F.col("user_id") / 8)), ["b"], "user_id").select("id1", "id2")
    out = U.joint_run(h, pairs, "user_id", "day")
    return out.withColumnRenamed(out.columns[-1], "longest")


@register("q_slopes_by_role", "with c as (select l_returnflag as role, l_linestatus as f, count(*) as n, regr_sxx(l_extendedprice, l_quantity) as xx, regr_syy(l_extendedprice, l_quantity) as yy, regr_sxy(l_extendedprice, l_quantity) as xy from lineitem group by 1, 2), s as (select role, sum(n)::bigint as n, count(*) as c, sum(xx) as xx, sum(yy) as yy, sum(xy) as xy from c group by 1), t as (select role, n, xy / xx as b, sqrt((yy - xy * xy / xx) / (n - c - 1) / xx) as se from s) select role, n, round(b, 4) as slope, round(se, 4) as se, round(b - 1.96 * se, 4) as low, round(b + 1.96 * se, 4) as high from t")
def slopes_by_role(spark, d):
    t = table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "role")
    return U.slopes_by_role(t, "role", "l_quantity", "l_extendedprice", "l_linestatus").withColumns({c: F.round(c, 4) for c in ("slope", "se", "low", "high")})


@register("q_event_study_split", None)
def event_study_split(spark, d):
    """Effects of a user's first week with an error on events, for two halves of users in one regression; tested against a known effect."""
    w = daily(spark, d).withColumn("week", F.floor(F.col("day") / 7).cast("int")).groupBy("user_id", "week").agg(F.sum("n").alias("n"), F.max((F.col("status") == "error").cast("int")).alias("error"))
    start = w.agg(F.min("week")).first()[0]
    x = P.first_event(w, ["user_id"], "week", F.col("error") == 1, "first").withColumn("cohort", F.when(F.col("first") > start, F.lit(start + 2)))
    fit = E.event_study(x.withColumn("half", F.col("user_id") % 2), "user_id", "week", "cohort", "n", 2, split="half")
    return E.as_frame(spark, {"events": fit}).withColumns({c: F.round(c, 8) for c in ("b", "se")})
