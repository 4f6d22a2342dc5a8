"""Joins beyond equality, linkage, geography, estimation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import estimation as E
from ..operators import joins as J
from ..operators import linkage as L
from ..operators import panel as P
from .panel_queries import YEARLY, daily, yearly
from .registry import register, table


@register("q_nearest_year_match", f"""with {YEARLY}, f as (select o_custkey, year as f_year, n as f_n from yearly where n >= 3), c as (select y.*, f_year, f_year - year as time_diff from (select * from yearly where n < 3) y join f using (o_custkey) where abs(f_year - year) <= 5)
select o_custkey, year, f_year, time_diff from c qualify row_number() over (partition by o_custkey, year order by abs(time_diff), time_diff desc, f_year) = 1""")
def nearest_year(spark, d):
    y = yearly(spark, d)
    few = y.filter("n < 3").withColumn("row", F.concat_ws(":", "o_custkey", "year"))
    busy = y.filter("n >= 3").select("o_custkey", F.col("year").alias("f_year"))
    return J.nearest_time(few, busy, ["o_custkey"], "row", "year", "f_year", "f_year", 5).select("o_custkey", "year", "f_year", "time_diff")


@register("q_lev_blocked_join", "select a.p_partkey as id1, b.p_partkey as id2, levenshtein(a.p_name, b.p_name)::int as lev from part a join part b on a.p_brand = b.p_brand and a.p_size = b.p_size and a.p_partkey < b.p_partkey where levenshtein(a.p_name, b.p_name) <= 6")
def lev_join(spark, d):
    p = table(spark, d, "part")
    a = p.select("p_brand", "p_size", F.col("p_partkey").alias("id1"), F.col("p_name").alias("a"))
    b = p.select("p_brand", "p_size", F.col("p_partkey").alias("id2"), F.col("p_name").alias("b"))
    return J.levenshtein_join(a, b, ["p_brand", "p_size"], "a", "b", 6).filter("id1 < id2").select("id1", "id2", F.levenshtein("a", "b").alias("lev"))


@register("q_jw_blocked_join", "with n as (select distinct p_name as s from part) select a.s as a, b.s as b, round(jaro_winkler_similarity(a.s, b.s), 6) as similarity from n a join n b on a.s < b.s and (left(a.s, 3) = left(b.s, 3) or right(a.s, 3) = right(b.s, 3)) where jaro_winkler_similarity(a.s, b.s) >= 0.9")
def jw_join(spark, d):
    n = table(spark, d, "part").select("p_name").distinct()
    a, b = n.select(F.col("p_name").alias("a")), n.select(F.col("p_name").alias("b"))
    keys = [(F.substring("_a", 1, 3), F.substring("_b", 1, 3)), (F.substring("_a", -3, 3), F.substring("_b", -3, 3))]
    return J.similarity_join(a, b, "a", "b", 0.9, keys).filter("a < b").select("a", "b", F.round("similarity", 6).alias("similarity"))


def _unrolled(rounds: int) -> str:
    """Smallest and greatest label by so many rounds over all edges; a round reaches one edge further."""
    steps = ["l0 as (select distinct a as node, a as lo, a as hi from b)"]
    for k in range(1, rounds + 1):
        steps.append(f"l{k} as (select l.node, least(min(l.lo), min(m.lo)) as lo, greatest(max(l.hi), max(m.hi)) as hi from l{k - 1} l join b on l.node = b.a join l{k - 1} m on m.node = b.b group by 1)")
    return ", ".join(steps)


#: Eight rounds are more than the longest way between two nodes of these tables' graphs of suppliers and parts.
_COMPONENTS = f"""with e as (select distinct l_suppkey as s, 1000000 + l_partkey as p from lineitem), b as (select s as a, p as b from e union select p, s from e), {_unrolled(8)}
select node, lo as component, hi as component_max, count(*) over (partition by lo) as size from l8"""


@register("q_components", _COMPONENTS)
def components(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.lit(1000000) + F.col("l_partkey")).alias("dst"))
    return L.connected_components(e)


@register("q_pair_rules", """with s as (select c_nationkey, c_custkey as id, c_mktsegment as seg, split_part(c_mktsegment, 'I', 1) || (c_custkey % 7)::varchar as first, c_name as last, o.p as p from customer left join (select o_custkey, list(distinct o_orderpriority) as p from orders group by 1) o on o_custkey = c_custkey),
q as (select a.id as id1, b.id as id2, levenshtein(a.first, b.first) as fl, levenshtein(a.last, b.last) as ll, jaro_winkler_similarity(a.first, b.first) as fj, jaro_winkler_similarity(a.last, b.last) as lj,
 (a.seg = b.seg)::int + coalesce(len(list_intersect(a.p, b.p)), 0) as shared from s a join s b on a.c_nationkey = b.c_nationkey and a.seg = b.seg and a.id < b.id)
select case when shared > 0 and (fl < 2 or fj > 0.8) and (ll < 2 or lj > 0.8) then 'SAME' when (fl >= 3 or fj <= 0.5) and (ll >= 3 or lj <= 0.5) then 'DIFFERENT' else 'UNDECIDED' end as label, count(*) as n, sum(shared)::bigint as shared from q group by 1""")
def pair_rules(spark, d):
    c = table(spark, d, "customer").select("c_nationkey", F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("seg"), F.concat(F.split("c_mktsegment", "I")[0], (F.col("c_custkey") % 7).cast("string")).alias("first"), F.col("c_name").alias("last"))
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("p")).distinct()
    persons = c.join(o, "id", "left")
    features = L.block_features(persons, ["c_nationkey", "seg"], "id", "first", "last", ["seg", "p"])
    return L.apply_rules(features, [L.first_stage()]).groupBy("label").agg(F.count("*").alias("n"), F.sum("total_shared").alias("shared"))


@register("q_cohold_pairs", "with d as (select distinct l_orderkey, l_suppkey from lineitem) select a.l_suppkey as id1, b.l_suppkey as id2, count(*) as n from d a join d b on a.l_orderkey = b.l_orderkey and a.l_suppkey < b.l_suppkey group by 1, 2")
def cohold(spark, d):
    t = table(spark, d, "lineitem")
    tasks = max(J.JOIN_TASKS, t.count() // J.TASK_ROWS)  # so that a task's memory doesn't grow with the table
    return J.block_pairs(t, ["l_orderkey"], "l_suppkey", tasks=tasks).repartition(tasks, "id1", "id2").groupBy("id1", "id2").agg(F.count("*").alias("n"))


_XY = "select {k} as id, (({k} * 7919) % 1400) / 10.0 - 70 as lat, (({k} * 104729) % 3600) / 10.0 - 180 as lon from {t}"
_KM = "2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"


def _points(spark, d, t, k, names):
    c = F.col(k)
    return table(spark, d, t).select(c.alias(names[0]), ((c * 7919) % 1400 / 10.0 - 70).alias(names[1]), ((c * 104729) % 3600 / 10.0 - 180).alias(names[2]))


@register("q_haversine_nn", f"with a as ({_XY.format(k='c_custkey', t='customer')}), b as ({_XY.format(k='s_suppkey', t='supplier')}), p as (select a.id as id, b.id as other, {_KM} as km from a, b) select id, other, round(km, 4) as km from p where km <= 400 qualify row_number() over (partition by id order by km, other) = 1")
def haversine(spark, d):
    a, b = _points(spark, d, "customer", "c_custkey", ("id", "lat", "lon")), _points(spark, d, "supplier", "s_suppkey", ("other", "lat2", "lon2"))
    return J.nearest_point(a, b, "id", "lat", "lon", "other", "lat2", "lon2", 400.0).select("id", "other", F.round("km", 4).alias("km"))


@register("q_point_in_polygon", f"with a as ({_XY.format(k='c_custkey', t='customer')}) select id, n_nationkey from a, nation where abs(lon - (n_nationkey * 12 - 150)) + abs(lat - (n_nationkey * 3 - 36)) < 20.03")
def point_in_polygon(spark, d):
    a = _points(spark, d, "customer", "c_custkey", ("id", "lat", "lon"))
    x, y = F.col("n_nationkey") * 12.0 - 150, F.col("n_nationkey") * 3.0 - 36
    corner = lambda dx, dy: F.struct((x + dx).alias("x"), (y + dy).alias("y"))
    polygons = table(spark, d, "nation").select("n_nationkey", F.array(corner(20.03, 0.0), corner(0.0, 20.03), corner(-20.03, 0.0), corner(0.0, -20.03)).alias("ring"))
    return J.polygon_join(a, polygons, "lon", "lat", "ring", 15.0).select("id", "n_nationkey")


@register("q_parent_values", "select s.s_suppkey, s.s_acctbal, p.s_acctbal as s_acctbal_parent from supplier s left join supplier p on p.s_suppkey = s.s_suppkey // 10")
def parent_values(spark, d):
    s = table(spark, d, "supplier").withColumn("parent", F.floor(F.col("s_suppkey") / 10))
    return J.parent_values(s, "s_suppkey", "parent", ["s_acctbal"]).select("s_suppkey", "s_acctbal", "s_acctbal_parent")


@register("q_unique_holder", "with g as (select o_custkey, count(distinct case when o_orderpriority = '1-URGENT' then o_orderkey end) as n0, min(case when o_orderpriority = '1-URGENT' then o_orderkey end) as p0, count(distinct case when o_orderstatus = 'P' then o_orderkey end) as n1, min(case when o_orderstatus = 'P' then o_orderkey end) as p1 from orders group by 1) select o_custkey, case when n0 = 1 then p0 when n0 = 0 and n1 = 1 then p1 end as holder, case when n0 = 1 then 'urgent' when n0 = 0 and n1 = 1 then 'pending' end as rule from g")
def unique_holder(spark, d):
    return L.unique_holder(table(spark, d, "orders"), ["o_custkey"], "o_orderkey", [("urgent", F.col("o_orderpriority") == "1-URGENT"), ("pending", F.col("o_orderstatus") == "P")])


@register("q_ols_group", "select l_returnflag, l_linestatus, count(*) as n, round(regr_slope(l_extendedprice, l_quantity), 4) as slope, round(regr_intercept(l_extendedprice, l_quantity), 3) as intercept from lineitem group by 1, 2")
def ols_group(spark, d):
    return E.group_slopes(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity", "l_extendedprice").select("l_returnflag", "l_linestatus", "n", F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"))


@register("q_event_study", None)
def event_study(spark, d):
    """Effect on a user's events of the first week in which an error is the last event of a day."""
    w = daily(spark, d).withColumn("week", F.floor(F.col("day") / 7).cast("int")).groupBy("user_id", "week").agg(F.sum("n").alias("n"), F.max((F.col("status") == "error").cast("int")).alias("error"))
    weeks = w.agg(F.min("week")).first()[0]
    x = P.first_event(w, ["user_id"], "week", F.col("error") == 1, "first").withColumn("cohort", F.when(F.col("first") > weeks, F.floor((F.col("first") - weeks - 1) / 4) * 4 + weeks + 1))
    fit = E.event_study(x, "user_id", "week", "cohort", "n", 3)
    mean, se = E.combine(fit, {f"t{k}": 1 / 3 for k in (0, 1, 2)})
    out = E.as_frame(spark, {"events": fit})
    return out.union(spark.createDataFrame([("events", "mean t0..t2", mean, se, fit.n, fit.clusters)], out.schema)).withColumns({c: F.round(c, 8) for c in ("b", "se")})


@register("q_pre_means", f"with {YEARLY}, e as (select *, min(case when n >= 3 then year end) over (partition by o_custkey) as e from yearly), p as (select * from e where year < e) select 'n' as outcome, round(avg(n), 6) as mean, round(stddev_samp(n), 6) as sd, count(n) as n from p union all select 'total', round(avg(total), 6), round(stddev_samp(total), 6), count(total) from p")
def pre_means(spark, d):
    x = P.first_event(yearly(spark, d), ["o_custkey"], "year", F.col("n") >= 3, "e").withColumn("relative", F.col("year") - F.col("e"))
    return E.pre_means(x, "relative", ["n", "total"]).select("outcome", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "n")


@register("q_components_whole", None)
def components_whole(spark, d):
    """``q_components`` over all rows; a recursive oracle is too slow there, so a test holds it against brute force."""
    e = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.lit(1000000) + F.col("l_partkey")).alias("dst"))
    return L.connected_components(e)


_ANY_KEY = ("select a.s_suppkey, b.c_custkey, concat_ws(';', case when a.n = b.n then 'n' end, case when a.k = b.k then 'z' end) as agree from (select s_suppkey, s_nationkey as n, s_suppkey % 97 as k from supplier) a join (select c_custkey, c_nationkey as n, c_custkey % 97 as k from customer) b on a.n = b.n or a.k = b.k")


@register("q_any_key_join", _ANY_KEY)
@register("q_any_key_join_whole", _ANY_KEY)
def any_key_whole(spark, d):
    a = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n"), (F.col("s_suppkey") % 97).alias("z"))
    b = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n"), (F.col("c_custkey") % 97).alias("z"))
    return J.any_key_join(a, b, "s_suppkey", "c_custkey", ["n", "z"], ";")


_KEYWORDS = (r"""with p as (select item_id, ' ' || array_to_string(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> ''), ' ') || ' ' as k from benchmark),
t as (select doc_id, ' ' || array_to_string(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> ''), ' ') || ' ' as t from documents) select doc_id, item_id from t join p on contains(t, k) where trim(k) <> ''""")


@register("q_keyword_hits", _KEYWORDS)
@register("q_keyword_hits_whole", _KEYWORDS)
def keyword_hits_whole(spark, d):
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    b = table(spark, d, "benchmark").select("item_id", F.array_join(words, " ").alias("phrase"))
    return J.keyword_hits(table(spark, d, "documents"), b, "doc_id", "text", "item_id", "phrase")
