"""Selection, collapse, tabulation, reshaping and value verbs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import linkage as L
from ..operators import panel as P
from ..operators import tables as B
from ..operators import verbs as V
from .panel_queries import YEARLY, yearly
from .registry import register, table


@register("q_select_names", "select l_shipdate, l_orderkey, l_partkey, l_suppkey, round(l_extendedprice, 2) as l_extendedprice from lineitem where regexp_matches(l_linestatus, '^[OF]$')")
def select_names(spark, d):
    t = table(spark, d, "lineitem").filter(F.col("l_linestatus").rlike("^[OF]$"))
    return B.select_names(t, starts="l_", matches="(key|price|date)$", first=["l_shipdate"]).withColumn("l_extendedprice", F.round("l_extendedprice", 2))


@register("q_last_wins", "select o_orderkey, case when o_orderstatus = 'P' then 'pending' when o_totalprice > 300000 then 'large' when o_totalprice > 100000 then 'middle' else 'small' end as kind from orders")
def last_wins(spark, d):
    p = F.col("o_totalprice")
    return table(spark, d, "orders").select("o_orderkey", B.last_wins([(p > 100000, "middle"), (p > 300000, "large"), (F.col("o_orderstatus") == "P", "pending")], "small").alias("kind"))


@register("q_keep_first", "select o_custkey, o_orderkey, o_orderstatus from orders qualify row_number() over (partition by o_custkey, o_orderstatus order by o_orderdate desc, o_orderkey) = 1")
def keep_first(spark, d):
    return B.keep_first(table(spark, d, "orders"), ["o_custkey", "o_orderstatus"], [F.desc("o_orderdate"), "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderstatus")


@register("q_duplicates_report", "select copies, count(*) as keys, sum(copies - 1)::bigint as surplus from (select count(*) as copies from lineitem group by l_partkey, l_suppkey) group by 1")
def duplicates_report(spark, d):
    return B.duplicates_report(table(spark, d, "lineitem"), ["l_partkey", "l_suppkey"])


@register("q_row_index", "select o_orderkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey)::int as i from orders")
def row_index(spark, d):
    return B.row_index(table(spark, d, "orders"), "i", ["o_orderdate", "o_orderkey"], ["o_custkey"]).select("o_orderkey", "i")


@register("q_right_join", "select c_custkey, o_orderkey, o_orderstatus from (select * from orders where o_totalprice > 250000) right join customer on o_custkey = c_custkey")
def right_join(spark, d):
    o = table(spark, d, "orders").filter("o_totalprice > 250000").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus")
    return B.right_join(o, table(spark, d, "customer").select("c_custkey"), ["c_custkey"]).select("c_custkey", "o_orderkey", "o_orderstatus")


@register("q_left_only_pairs", "with p as (select distinct l_returnflag as f, least(l_suppkey, l_linenumber) as a, greatest(l_suppkey, l_linenumber) as b from lineitem where l_discount < 0.05), q as (select distinct l_returnflag as f, least(l_suppkey, l_linenumber) as a, greatest(l_suppkey, l_linenumber) as b from lineitem where l_discount >= 0.08) select f, a, b from p anti join q using (f, a, b)")
def left_only_pairs(spark, d):
    t = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("f"), F.col("l_suppkey").alias("a"), F.col("l_linenumber").cast("long").alias("b"), "l_discount")
    return B.left_only_pairs(t.filter("l_discount < 0.05"), t.filter("l_discount >= 0.08").select("f", F.col("b").alias("a"), F.col("a").alias("b")), "a", "b", ["f"])


@register("q_lookup", "select o_orderkey, case o_orderstatus when 'F' then 1 when 'O' then 2 else 0 end as code from orders")
def lookup(spark, d):
    return B.lookup(table(spark, d, "orders"), "o_orderstatus", {"F": 1, "O": 2}, "code", 0).select("o_orderkey", "code")


@register("q_collapse", """with t as (select *, case when l_tax > 0.04 then l_tax end as t from lineitem) select l_returnflag, l_suppkey, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) as price, round(sum(l_discount * l_quantity), 4) as discount, round(sum(l_quantity), 4) as quantity, count(t) as n_tax,
round(max(t), 4) as tax, round(arg_min(t, (l_shipdate, t)) filter (t is not null), 4) as first_tax from t group by 1, 2""")
def collapse(spark, d):
    t = table(spark, d, "lineitem").withColumn("t", F.when(F.col("l_tax") > 0.04, F.col("l_tax")))
    stats = {"price": ("mean", "l_extendedprice"), "discount": ("sum", "l_discount"), "quantity": ("rawsum", "l_quantity"), "n_tax": ("count", "t"), "tax": ("max", "t"), "first_tax": ("firstnm", "t")}
    out = B.collapse(t, ["l_returnflag", "l_suppkey"], stats, order="l_shipdate", weight="l_quantity")
    return out.withColumns({c: F.round(c, 4) for c in ("price", "discount", "quantity", "tax", "first_tax")})


@register("q_two_way", 'select o_orderpriority, count(*) filter (o_orderstatus = \'F\') as "F", count(*) filter (o_orderstatus = \'O\') as "O", count(*) as total from orders group by 1')
def two_way(spark, d):
    return B.two_way(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O"])


@register("q_weighted_counts", "select l_orderkey, l_linenumber, round(sum(l_quantity) over (partition by l_partkey), 4) as n from lineitem")
def weighted_counts(spark, d):
    return B.weighted_counts(table(spark, d, "lineitem"), ["l_partkey"], "l_quantity").select("l_orderkey", "l_linenumber", F.round("n", 4).alias("n"))


@register("q_concentration", f"with {YEARLY} select o_custkey, round(sum(n * n / 9.0), 6) as weight from yearly group by 1")
def concentration(spark, d):
    return B.concentration(yearly(spark, d), ["o_custkey"], "n").withColumn("weight", F.round("weight", 6))


@register("q_row_greatest", "select l_orderkey, l_linenumber, round(greatest(l_tax, l_discount, case when l_quantity > 25 then l_quantity / 1000 end), 6) as m from lineitem")
def row_greatest(spark, d):
    t = table(spark, d, "lineitem").withColumn("q", F.when(F.col("l_quantity") > 25, F.col("l_quantity") / 1000))
    return t.select("l_orderkey", "l_linenumber", F.round(B.row_greatest(["l_tax", "l_discount", "q"]), 6).alias("m"))


@register("q_across", "select l_shipmode, round(avg(l_tax), 6) as mean_l_tax, round(avg(l_discount), 6) as mean_l_discount from (select *, l_linenumber % 3 as l_shipmode from lineitem) group by 1")
def across(spark, d):
    t = table(spark, d, "lineitem").withColumn("l_shipmode", F.col("l_linenumber") % 3)
    return B.across(t, ["l_shipmode"], ["l_tax", "l_discount"], lambda c: F.round(F.avg(c), 6), "mean_{}")


@register("q_top_union", "with n as (select l_returnflag, l_suppkey, count(*) as n from lineitem group by 1, 2), r as (select *, rank() over (partition by l_returnflag order by n desc) + (count(*) over (partition by l_returnflag, n) - 1) / 2.0 as r from n) select l_suppkey, count(*) as groups from r where r <= 10 group by 1")
def top_union(spark, d):
    return B.top_union(table(spark, d, "lineitem"), ["l_returnflag"], "l_suppkey", 10)


@register("q_append_labelled", "select c_nationkey as nation, c_acctbal as balance, null::varchar as name, 'customer' as part from customer union all select s_nationkey, null, s_name, 'supplier' from supplier")
def append_labelled(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name"))
    return B.append_labelled({"customer": c, "supplier": s}, "part")


@register("q_exactly_one", "select o_orderkey, (o_orderstatus = 'F') <> coalesce(nullif(o_orderpriority, '2-HIGH') = '1-URGENT', false) as one from orders")
def exactly_one(spark, d):
    return table(spark, d, "orders").select("o_orderkey", B.exactly_one(F.col("o_orderstatus") == "F", F.nullif("o_orderpriority", F.lit("2-HIGH")) == "1-URGENT").alias("one"))


@register("q_pivot_several", "select o_custkey, count(*) filter (o_orderstatus = 'F') as n_F, round(coalesce(sum(o_totalprice) filter (o_orderstatus = 'F'), 0), 2) as total_F, count(*) filter (o_orderstatus = 'O') as n_O, round(coalesce(sum(o_totalprice) filter (o_orderstatus = 'O'), 0), 2) as total_O from orders group by 1")
def pivot_several(spark, d):
    return B.pivot_several(table(spark, d, "orders"), ["o_custkey"], "o_orderstatus", ["F", "O"], {"n": F.count(F.lit(1)), "total": F.round(F.sum("o_totalprice"), 2)}, 0)


@register("q_name_array", "with a as (select o_custkey, list_sort(list(distinct o_orderpriority)) as a from orders group by 1) select o_custkey, len(a)::int as n, a[1] as o_orderpriority_1, a[2] as o_orderpriority_2, a[3] as o_orderpriority_3 from a")
def name_array(spark, d):
    return B.name_array(table(spark, d, "orders"), ["o_custkey"], "o_orderpriority", 3)


@register("q_transpose", """with s as (select l_returnflag, count(*)::double as n, round(avg(l_tax), 6) as tax from lineitem group by 1) select 'n' as variable, max(n) filter (l_returnflag = 'A') as "A", max(n) filter (l_returnflag = 'N') as "N", max(n) filter (l_returnflag = 'R') as "R" from s union all select 'tax', max(tax) filter (l_returnflag = 'A'), max(tax) filter (l_returnflag = 'N'), max(tax) filter (l_returnflag = 'R') from s""")
def transpose(spark, d):
    s = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.avg("l_tax"), 6).alias("tax"))
    return B.transpose(s, "l_returnflag", ["A", "N", "R"], ["n", "tax"])


@register("q_recode", "select o_orderkey, case o_orderstatus when 'F' then 'done' when 'O' then 'open' else o_orderstatus end as status, case when o_orderpriority in ('5-LOW', '4-NOT SPECIFIED') then null else o_orderpriority end as priority, case when o_orderpriority = '5-LOW' then 'none' else 'some' end as filled from orders")
def recode(spark, d):
    p = F.col("o_orderpriority")
    low = F.nullif(p, F.lit("5-LOW"))
    return table(spark, d, "orders").select("o_orderkey", B.recode(F.col("o_orderstatus"), {"F": "done", "O": "open"}).alias("status"), B.null_if(p, ["5-LOW", "4-NOT SPECIFIED"]).alias("priority"), B.recode(low, {None: "none"}, F.lit("some")).alias("filled"))


@register("q_near_and_sets", "with s as (select o_custkey, list(distinct o_orderstatus) as a, list(distinct o_orderpriority) as p, avg(o_totalprice) as m, median(o_totalprice) as e from orders group by 1) select o_custkey, abs(m - e) < 1000 as near, list_sort(a) = ['F', 'O'] as fo, len(list_filter(['F', 'O'], lambda x: not list_contains(a, x))) = 0 as has_both, list_contains(p, '1-URGENT') as urgent from s")
def near_and_sets(spark, d):
    s = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("a"), F.collect_set("o_orderpriority").alias("p"), F.avg("o_totalprice").alias("m"), F.expr("percentile(o_totalprice, 0.5)").alias("e"))
    both = F.array(F.lit("F"), F.lit("O"))
    return s.select("o_custkey", B.near(F.col("m"), F.col("e"), 1000).alias("near"), B.same_set(F.col("a"), both).alias("fo"), B.contains_all(F.col("a"), both).alias("has_both"), F.array_contains("p", "1-URGENT").alias("urgent"))


@register("q_value_counts", "select value, count(*) as n from (select o_orderstatus as value from orders union all select nullif(o_orderpriority, '5-LOW') from orders) where value is not null group by 1")
def value_counts(spark, d):
    o = table(spark, d, "orders").withColumn("p", F.nullif("o_orderpriority", F.lit("5-LOW")))
    return B.value_counts(o, ["o_orderstatus", "p"])


@register("q_first_where", "select o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) filter (o_totalprice > 200000) as first from orders group by 1")
def first_where(spark, d):
    return B.first_where(table(spark, d, "orders"), ["o_custkey"], "o_orderdate", F.col("o_totalprice") > 200000, "o_orderkey")


@register("q_levels_and_rounding", "select distinct round(l_tax * 1.01, 2) as tax, (select count(distinct l_returnflag) from lineitem)::int as n_levels from lineitem")
def levels_and_rounding(spark, d):
    t = table(spark, d, "lineitem")
    return B.distinct_rounded(t.select((F.col("l_tax") * 1.01).alias("tax")), ["tax"], 2).withColumn("n_levels", F.lit(len(B.levels(t, "l_returnflag"))))


@register("q_most_frequent", "select l_returnflag, l_suppkey, count(*) as n from lineitem group by 1, 2 order by n desc, l_returnflag, l_suppkey limit 10")
def most_frequent(spark, d):
    return B.most_frequent(table(spark, d, "lineitem"), ["l_returnflag", "l_suppkey"], 10)


@register("q_ratio", "select o_custkey, round(sum(o_totalprice) filter (o_orderstatus = 'P') / nullif(count(*) filter (o_orderstatus = 'P'), 0), 4) as mean from orders group by 1")
def ratio(spark, d):
    s = table(spark, d, "orders").groupBy("o_custkey").agg(F.sum(F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice"))).alias("a"), F.count(F.when(F.col("o_orderstatus") == "P", 1)).alias("b"))
    return s.select("o_custkey", F.round(B.ratio(F.col("a"), F.col("b")), 4).alias("mean"))


_NEXT = "o as (select distinct o_custkey as k, year(o_orderdate)::int as y, o_orderpriority as v from orders), t as (select k, y, lead(y) over (partition by k order by y) as n from (select distinct k, y from o)), p as (select a.k, b.y, a.v as prev, b.v as next from o a join t on t.k = a.k and t.y = a.y join o b on b.k = t.k and b.y = t.n)"


@register("q_least_probability", f"with {_NEXT}, c as (select prev, next, count(*) / sum(count(*)) over (partition by prev) as p from p group by 1, 2) select k, round(min(case when c.p > 0.19 then c.p end), 6) as least from p left join c using (prev, next) group by 1")
def least_probability(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.year("o_orderdate").alias("y"), F.col("o_orderpriority").alias("v"))
    p = B.next_pairs(o, "k", "y", "v")
    c = V.share_in_group(p, ["prev"], ["next"]).withColumnRenamed("share", "p").filter("p > 0.19")
    return B.least_probability(p, ["k"], c).withColumn("least", F.round("least", 6))


@register("q_column_audit", "select * from (select 'text' as \"column\", count(text) as n, count(*) filter (regexp_matches(text, '[^\\x00-\\x7F]')) as n_beyond_ascii, count(*) filter (trim(text, ' ') <> text) as n_padded, count(*) filter (regexp_matches(text, '[\\x00-\\x1F\\x7F\\x{80}-\\x{9F}]')) as n_control from documents) union all select 'lang', count(lang), 0, 0, 0 from documents")
def column_audit(spark, d):
    return B.column_audit(table(spark, d, "documents").select("text", "lang"))


@register("q_split_by", "select 'kept' as part, count(*) as n from orders where o_totalprice > 200000 and o_orderstatus = 'F' union all select 'rest', count(*) filter (not (o_totalprice > 200000 and o_orderstatus = 'F')) from orders")
def split_by(spark, d):
    o = table(spark, d, "orders")
    kept, rest = V.split_by(o, F.nullif(F.col("o_totalprice") > 200000, F.lit(False)) & (F.col("o_orderstatus") == "F"))
    return kept.select(F.lit("kept").alias("part")).unionAll(rest.select(F.lit("rest"))).groupBy("part").agg(F.count("*").alias("n"))


@register("q_natural_join", "select c_nationkey, k, c_custkey, s_suppkey from (select c_nationkey, case when c_custkey % 3 > 0 then c_custkey % 3 end as k, c_custkey from customer) a left join (select s_nationkey as c_nationkey, case when s_suppkey % 3 > 0 then s_suppkey % 3 end as k, s_suppkey from supplier) b on a.c_nationkey = b.c_nationkey and a.k is not distinct from b.k".replace("select c_nationkey, k, c_custkey, s_suppkey", "select a.c_nationkey, a.k, c_custkey, s_suppkey", 1))
def natural_join(spark, d):
    key = lambda c: F.when(F.col(c) % 3 > 0, F.col(c) % 3).alias("k")
    a = table(spark, d, "customer").select("c_nationkey", key("c_custkey"), "c_custkey")
    return V.natural_join(a, table(spark, d, "supplier").select(F.col("s_nationkey").alias("c_nationkey"), key("s_suppkey"), "s_suppkey"))


@register("q_prioritised", "select o_custkey, case when list_contains(l, '1-URGENT') then '1-URGENT' when list_contains(l, '3-MEDIUM') then '3-MEDIUM' else coalesce(a, b) end as p from (select o_custkey, a, b, [a, b] as l from (select o_custkey, min(o_orderpriority) filter (o_orderstatus = 'F') as a, max(o_orderpriority) filter (o_orderstatus = 'O') as b from orders group by 1))")
def prioritised(spark, d):
    s = table(spark, d, "orders").groupBy("o_custkey").agg(F.min(F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority"))).alias("a"), F.max(F.when(F.col("o_orderstatus") == "O", F.col("o_orderpriority"))).alias("b"))
    return s.select("o_custkey", V.prioritised(["a", "b"], ["1-URGENT", "3-MEDIUM"]).alias("p"))


@register("q_tied_first", "select s_nationkey, s_suppkey from (select *, floor(s_acctbal / 1000) as b from supplier) qualify rank() over (partition by s_nationkey order by b desc) = 1")
def tied_first(spark, d):
    s = table(spark, d, "supplier").withColumn("b", F.floor(F.col("s_acctbal") / 1000))
    return V.first_per_group(s, ["s_nationkey"], [F.desc("b")], ties=True).select("s_nationkey", "s_suppkey")


@register("q_frame_checks", "select count(*) as n, true as same, true as strings from (select upper(trim(n_name)) from nation)")
def frame_checks(spark, d):
    n = table(spark, d, "nation")
    V.assert_row_count(n, 25)
    V.assert_exhaustive(n, "n_regionkey", range(5))
    strings = V.apply_to_strings(n, lambda c: F.lower(c))
    same = V.same_rows(n, n.orderBy(F.desc("n_name"))) and not V.same_rows(n, strings)
    return n.agg(F.count("*").alias("n")).withColumns({"same": F.lit(same), "strings": F.lit(strings.filter("n_name <> lower(n_name)").count() == 0)})


@register("q_sample_by_group", "select o_orderstatus, 5::bigint as n, true as within from (select distinct o_orderstatus from orders)")
def sample_by_group(spark, d):
    """Five rows of each status: a sample can't be told in SQL, its sizes and membership can."""
    o = table(spark, d, "orders")
    s = V.sample_rows(o, "o_orderkey", 5, seed=1, by=["o_orderstatus"])
    again = V.sample_rows(o.orderBy(F.rand(3)), "o_orderkey", 5, seed=1, by=["o_orderstatus"])
    other = V.sample_rows(o, "o_orderkey", 5, seed=2, by=["o_orderstatus"])
    within = V.same_rows(s, again) and not V.same_rows(s, other) and not s.join(o, o.columns, "left_anti").head(1)
    return s.groupBy("o_orderstatus").agg(F.count_distinct("o_orderkey").alias("n")).withColumn("within", F.lit(bool(within)))


@register("q_profiles", "with p as (select l_suppkey as b, l_partkey % 40 as id, string_agg(distinct l_returnflag, ';' order by l_returnflag) as f from lineitem where l_quantity > 49.5 group by 1, 2) select b, id, f, count(*) over (partition by b) = 1 as alone from p")
def profiles(spark, d):
    t = table(spark, d, "lineitem").filter("l_quantity > 49.5").select(F.col("l_suppkey").alias("b"), (F.col("l_partkey") % 40).alias("id"), F.col("l_returnflag").alias("f"))
    return L.profiles(t, "b", "id", ["f"]).withColumn("f", F.array_join("f", ";"))


@register("q_singletons", "with p as (select distinct l_orderkey as b, l_partkey as id from lineitem), n as (select *, count(*) over (partition by b) = 1 as alone from p) select id from n group by 1 having bool_and(alone)")
def singletons(spark, d):
    t = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("b"), F.col("l_partkey").alias("id"), "l_returnflag")
    return L.singletons(L.profiles(t, "b", "id", ["l_returnflag"]), "id")


_LABELS = "l as (select least(l_partkey, l_suppkey) as id1, greatest(l_partkey, l_suppkey) as id2, case when min(l_quantity) > 20 then 'DIFFERENT' when max(l_quantity) < 30 then 'SAME' else 'UNDECIDED' end as label from lineitem where l_partkey <> l_suppkey group by 1, 2)"


def _labels(spark, d):
    t = table(spark, d, "lineitem").filter("l_partkey <> l_suppkey").groupBy(F.least("l_partkey", "l_suppkey").alias("id1"), F.greatest("l_partkey", "l_suppkey").alias("id2"))
    return t.agg(F.when(F.min("l_quantity") > 20, "DIFFERENT").when(F.max("l_quantity") < 30, "SAME").otherwise("UNDECIDED").alias("label"))


@register("q_override", f"with {_LABELS} select id1, id2, case when id1 < 5 then 'SAME' else label end as label from l")
def override(spark, d):
    l = _labels(spark, d)
    return L.override(l, l.filter("id1 < 5").select(F.col("id2").alias("id1"), F.col("id1").alias("id2"), F.lit("SAME").alias("label")))


@register("q_closed_ids", f"with {_LABELS} select id from (select id1 as id, label from l union all select id2, label from l) group by 1 having bool_and(label = 'DIFFERENT')")
def closed_ids(spark, d):
    return L.closed_ids(_labels(spark, d))


@register("q_relabel_to_max", "with e as (select distinct c_custkey as a, c_custkey + 1 as b from customer where c_custkey % 4 < 2) select c_custkey, case when c_custkey % 4 <= 2 then c_custkey - c_custkey % 4 + 2 else c_custkey end as id from customer")
def relabel_to_max(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_custkey").alias("id"))
    links = c.filter("c_custkey % 4 < 2").select(F.col("c_custkey").alias("a"), (F.col("c_custkey") + 1).alias("b"))
    return L.relabel_to_max(c, "id", links, "a", "b").select("c_custkey", "id")


@register("q_rare_name_edges", "with n as (select w, count(distinct p_brand || p_type || p_size % 3) as n from (select p_name || p_size % 9 as w, * from part) group by 1), r as (select w from n where n = 1), f as (select w from n where n <= 10) select r.w as rare, f.w as other, round(jaro_winkler_similarity(r.w, f.w), 6) as jw from r join f on r.w <> f.w and (left(r.w, 1) = left(f.w, 1) or right(r.w, 1) = right(f.w, 1)) where jaro_winkler_similarity(r.w, f.w) > 0.85")
def rare_name_edges(spark, d):
    p = table(spark, d, "part").withColumn("w", F.concat("p_name", (F.col("p_size") % 9).cast("string")))
    n = p.groupBy("w").agg(F.count_distinct(F.concat("p_brand", "p_type", (F.col("p_size") % 3).cast("string"))).alias("n"))
    return L.rare_name_edges(n, "w", "n").withColumn("jw", F.round("jw", 6))


@register("q_typo_map", "with x as (select split_part(p_name, ' ', 1) || case when p_partkey % 50 = 0 then 's' else '' end as a, split_part(p_name, ' ', 2) as b, p_partkey // 90 as id from part), n as (select a, count(distinct id) as n from x group by 1), d as (select distinct a, b from x), p as (select distinct f.a as \"from\", t.a as \"to\", tn.n as n_to, levenshtein(f.a, t.a) / greatest(length(f.a), length(t.a)) as distance from d f join d t using (b) join n fn on fn.a = f.a join n tn on tn.a = t.a where fn.n <= 8 and f.a <> t.a and tn.n > fn.n) select \"from\", \"to\", round(distance, 6) as distance from p where distance <= 0.25 qualify row_number() over (partition by \"from\" order by n_to desc, distance, \"to\") = 1")
def typo_map(spark, d):
    x = table(spark, d, "part").select(F.concat(F.split("p_name", " ")[0], F.when(F.col("p_partkey") % 50 == 0, "s").otherwise("")).alias("a"), F.split("p_name", " ")[1].alias("b"), F.floor(F.col("p_partkey") / 90).alias("id"))
    return L.typo_map(x, "a", "b", "id", most_ids=8).withColumn("distance", F.round("distance", 6))


@register("q_impute_by_group", "with x as (select p_partkey, p_brand || p_size % 5 as g, case when p_size % 11 = 0 then null when p_size > 40 then 'M' else 'F' end as v from part), s as (select g, avg((v = 'F')::int::double) filter (v is not null) as f0, sum((v is null)::int) / count(*) as u, sum((coalesce(v, '') = 'F')::int) as nf, sum((coalesce(v, '') = 'M')::int) as nm, count(*) as n from x group by 1) select p_partkey, coalesce(v, case when nm = 0 and nf > 0 and u <= 0.2 then 'F' when nf = 0 and nm > 0 and u <= 0.2 then 'M' when abs(nf::double / n - nm::double / n) <= 0.15 then 'U' end) as v from x join s using (g)")
def impute_by_group(spark, d):
    x = table(spark, d, "part").select("p_partkey", F.concat("p_brand", (F.col("p_size") % 5).cast("string")).alias("g"), F.when(F.col("p_size") % 11 == 0, None).when(F.col("p_size") > 40, "M").otherwise("F").alias("v"))
    return L.impute_by_group(x, "g", "v", "F", "M", even="U").select("p_partkey", "v")


@register("q_staged_assignment", "with a as (select c_custkey as id, n_nationkey as c, 1 as k, 1.0 as s from customer join nation on c_nationkey = n_nationkey where c_custkey % 3 = 0), b as (select c_custkey as id, n_nationkey as c, 2 as k, (n_nationkey % 7)::double as s from customer join nation on c_nationkey % 5 = n_regionkey), u as (from a union all from b), m as (select *, max(s) over (partition by k, id) as m from u), one as (select id, min(c) as candidate, k as stage from m where s = m group by id, k having count(distinct c) = 1), f as (select * from one qualify row_number() over (partition by id order by stage) = 1) select c_custkey as id, candidate, stage, case stage when 1 then 'own' when 2 then 'region' end as rule from customer left join f on id = c_custkey")
def staged_assignment(spark, d):
    c, n = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey"), table(spark, d, "nation")
    a = c.filter("id % 3 = 0").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("id", F.col("n_nationkey").alias("candidate"), F.lit(1.0).alias("score"))
    b = c.join(n, F.col("c_nationkey") % 5 == F.col("n_regionkey")).select("id", F.col("n_nationkey").alias("candidate"), (F.col("n_nationkey") % 7).cast("double").alias("score"))
    return L.staged_assignment(c.select("id"), "id", [("own", a), ("region", b)])


@register("q_state_distance", "with h as (select o_custkey % 60 as id, year(o_orderdate)::int as y, min(o_orderpriority) as s from orders where o_orderkey % 3 = 0 group by 1, 2), p as (select a.id as id1, b.id as id2 from (select distinct id from h) a join (select distinct id from h) b on a.id < b.id and a.id // 6 = b.id // 6), m as (select a.s as s1, b.s as s2, abs(ascii(a.s) - ascii(b.s)) * 100.0::double as miles from (select distinct s from h) a, (select distinct s from h) b) select id1, id2, count(*) as periods, sum(miles) as miles from p join h a on a.id = id1 join h b on b.id = id2 and a.y = b.y join m on m.s1 = a.s and m.s2 = b.s where a.s <> b.s group by 1, 2")
def state_distance(spark, d):
    h = table(spark, d, "orders").filter("o_orderkey % 3 = 0").select((F.col("o_custkey") % 60).alias("id"), F.year("o_orderdate").alias("y"), F.col("o_orderpriority").alias("s"))
    pairs = J.block_pairs(h.withColumn("b", F.floor(F.col("id") / 6)), ["b"], "id").select("id1", "id2")
    s = h.select("s").distinct()
    miles = s.select(F.col("s").alias("a")).crossJoin(s.select(F.col("s").alias("b"))).withColumn("miles", F.abs(F.ascii("a") - F.ascii("b")) * 100.0)  # five priorities
    return L.state_distance(h, pairs, "id", "y", "s", miles)


@register("q_future_and_before", f"with {YEARLY}, y as (select *, list(priority) over (partition by o_custkey order by year rows between unbounded preceding and 1 preceding) as l from yearly) select o_custkey, year, coalesce(array_to_string(list_sort(list_distinct(l)), ';'), '') as before from y")
def future_and_before(spark, d):
    return P.values_before(yearly(spark, d), ["o_custkey"], "year", "priority", "before").select("o_custkey", "year", F.array_join("before", ";").alias("before"))


@register("q_expand_grid", "select s.o_orderstatus, p.o_orderpriority, (select count(*) from orders o where o.o_orderstatus = s.o_orderstatus and o.o_orderpriority = p.o_orderpriority and o.o_totalprice > 480000) as n from (select distinct o_orderstatus from orders) s, (select distinct o_orderpriority from orders) p")
def expand_grid(spark, d):
    o = table(spark, d, "orders")
    n = o.filter("o_totalprice > 480000").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    return P.expand_grid(o, ["o_orderstatus", "o_orderpriority"]).join(n, ["o_orderstatus", "o_orderpriority"], "left").fillna(0, subset=["n"])


@register("q_exact_quantiles", "select l_returnflag, round(quantile_cont(l_extendedprice, 0.1), 4) as a, round(quantile_cont(l_extendedprice, 0.5), 4) as b, round(quantile_cont(l_extendedprice, 0.99), 4) as c from lineitem group by 1 union all select null, round(quantile_cont(l_extendedprice, 0.1), 4), round(quantile_cont(l_extendedprice, 0.5), 4), round(quantile_cont(l_extendedprice, 0.99), 4) from lineitem")
def exact_quantiles(spark, d):
    t, q = table(spark, d, "lineitem"), F.col("q")
    cells = [F.round(q[i], 4).alias(n) for i, n in enumerate("abc")]
    return V.exact_quantiles(t, ["l_returnflag"], "l_extendedprice", [0.1, 0.5, 0.99]).select("l_returnflag", *cells).union(V.exact_quantiles(t, [], "l_extendedprice", [0.1, 0.5, 0.99]).select(F.lit(None).cast("string"), *cells))
