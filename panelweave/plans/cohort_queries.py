"""Cohorts, changes of state and co-occurrence."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import cohorts as C
from .panel_queries import DAILY, YEARLY, daily, yearly
from .registry import register, table


@register("q_state_changes", f"""with {DAILY}, c as (select *, row_number() over w > 1 and lag(status) over w is distinct from status as changed from daily window w as (partition by user_id order by day))
select user_id, day, changed, (sum(changed::int) over (partition by user_id order by day rows unbounded preceding))::bigint as n_changes, max(day) over (partition by user_id, status) as last_of_state from c""")
def state_changes(spark, d):
    return C.state_changes(daily(spark, d), ["user_id"], "day", "status").select("user_id", "day", "changed", "n_changes", "last_of_state")


@register("q_cohort_membership", "select o_custkey, bool_or(o_orderstatus = 'F') as ever, bool_and(o_orderstatus = 'F') as only, count(*) as n from orders group by 1")
def cohort(spark, d):
    return C.cohort_membership(table(spark, d, "orders"), "o_custkey", F.col("o_orderstatus") == "F")


@register("q_period_median_split", f"""with {YEARLY}, m as (select year, median(n) as m from yearly group by 1) select o_custkey, year, n > m as above from yearly join m using (year)""")
def period_split(spark, d):
    return C.period_median_split(yearly(spark, d), "year", "n").select("o_custkey", "year", "above")


@register("q_pair_rates", f"""with t as (select distinct year(o_orderdate)::int as year, o_custkey, o_orderpriority as item from orders), s as (select year, count(distinct o_custkey) as n_entities from t group by 1)
select a.year, a.item as item1, b.item as item2, count(*) as n_both, any_value(n_entities) as n_entities, round(count(*) / any_value(n_entities), 6) as rate
from t a join t b on a.year = b.year and a.o_custkey = b.o_custkey and a.item < b.item join s on s.year = a.year group by 1, 2, 3""")
def pair_rates(spark, d):
    o = table(spark, d, "orders").select(F.year("o_orderdate").alias("year"), "o_custkey", "o_orderpriority")
    return C.pair_rates(o, ["o_custkey"], "o_orderpriority", ["year"]).withColumn("rate", F.round("rate", 6))


@register("q_widest_pair", """select a.p_brand, a.p_size, max(levenshtein(a.p_name, b.p_name))::int as widest from part a join part b on a.p_brand = b.p_brand and a.p_size = b.p_size group by 1, 2""")
def widest(spark, d):
    return C.widest_pair(table(spark, d, "part"), ["p_brand", "p_size"], "p_name")


@register("q_outcome_precedence", f"""with {YEARLY}, c as (select *, lag(year) over w as before, lag(priority) over w as p from yearly window w as (partition by o_custkey order by year))
select o_custkey, year, case when year = 1995 then null when before is null or before <> year - 1 then 0 when p <> priority then 1 else 0 end as value,
case when year = 1995 then 'unknown' when before is null or before <> year - 1 then 'gap' when p <> priority then 'changed' else 'constant' end as reason from c""")
def outcome_precedence(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("year")
    before = F.lag("year").over(w)
    rules = [
        ("unknown", F.col("year") == 1995, F.lit(None).cast("int")), ("gap", before.isNull() | (before != F.col("year") - 1), F.lit(0)),
        ("changed", F.lag("priority").over(w) != F.col("priority"), F.lit(1)), ("constant", F.lit(True), F.lit(0)),
    ]
    return yearly(spark, d).select("o_custkey", "year", C.precedence(rules).alias("o")).select("o_custkey", "year", "o.value", "o.reason")


@register("q_joint_outcomes", """select case when l_discount is null or l_tax is null then 'missing' when l_discount > 0.05 and l_tax > 0.04 then 'joint' when l_discount > 0.05 then 'first' when l_tax > 0.04 then 'second' else 'neither' end as outcome, count(*) as n from lineitem group by 1""")
def joint_outcomes(spark, d):
    t = table(spark, d, "lineitem").select(C.joint_outcome((F.col("l_discount") > 0.05).cast("int"), (F.col("l_tax") > 0.04).cast("int")).alias("outcome"))
    return t.groupBy("outcome").agg(F.count("*").alias("n"))


@register("q_conditional_means", """select o_orderpriority, round(avg(o_totalprice) filter (o_orderstatus = 'F'), 4) as mean, count(o_totalprice) filter (o_orderstatus = 'F') as n, count(distinct o_custkey) filter (o_orderstatus = 'F' and o_totalprice is not null) as n_entities,
round(stddev_samp(o_totalprice) filter (o_orderstatus = 'F') / sqrt(count(o_totalprice) filter (o_orderstatus = 'F')), 4) as se from orders group by 1""")
def conditional_means(spark, d):
    out = C.conditional_means(table(spark, d, "orders"), ["o_orderpriority"], "o_custkey", F.col("o_orderstatus") == "F", "o_totalprice")
    return out.withColumns({"mean": F.round("mean", 4), "se": F.round("se", 4)})
