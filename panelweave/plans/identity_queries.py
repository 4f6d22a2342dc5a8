"""Identity: attribute cascades, names, reassignment, rule stages, organisation and leader matching."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators import identity as I
from ..operators import joins as J
from ..operators import linkage as L
from ..operators import pair_stages as S
from .registry import register, table

#: Four rows of a person each, from the parts table.
PERSONS = "persons as (select p_partkey // 4 as id, split_part(p_name, ' ', 1) as first, split_part(p_name, ' ', 2) as last, (p_size % 10)::varchar as phone, p_brand as state, 2000 + (p_partkey % 7)::int as year, p_type as title, case when p_size % 3 = 0 then 'F' when p_size % 3 = 1 then 'M' end as gender from part)"


def persons(spark, d):
    p, name = table(spark, d, "part"), F.split("p_name", " ")
    return p.select(
        F.floor(F.col("p_partkey") / 4).alias("id"), name[0].alias("first"), name[1].alias("last"), (F.col("p_size") % 10).cast("string").alias("phone"), F.col("p_brand").alias("state"),
        (2000 + F.col("p_partkey") % 7).cast("int").alias("year"), F.col("p_type").alias("title"), F.when(F.col("p_size") % 3 == 0, "F").when(F.col("p_size") % 3 == 1, "M").alias("gender"),
    )


@register("q_attribute_by_title", f"with {PERSONS}, n as (select id, title, count(*) as n from persons group by 1, 2), m as (select id, title from n qualify row_number() over (partition by id order by n desc, title) = 1) select id, case lower(title) when 'small' then 'S' when 'large' then 'L' end as value from m")
def attribute_by_title(spark, d):
    return I.attribute_by_title(persons(spark, d), "id", "title", {"Small.": "S", "LARGE": "L"})


@register("q_attribute_cascade", f"""with {PERSONS}, own as (select id, min(first) as name, case when min(gender) = max(gender) then min(gender) end as s from persons group by 1),
dict(name, v) as (values ('red', 'F'), ('old', 'M'), ('cold', 'M'), ('cold', 'F')), ok as (select name, case when min(v) = max(v) then min(v) end as v from dict group by 1),
c as (select split_part(p_name, ' ', 2) as w, split_part(p_name, ' ', 1) as name, case when p_size > 6 then 'F' else 'M' end as v, count(*) as n from part where p_size > 5 or split_part(p_name, ' ', 1) = 'new' group by all),
k as (select name, v, sum(n) as n from c group by 1, 2), t as (select name, v, n, sum(n) over (partition by name) as total from k qualify row_number() over (partition by name order by n desc, v) = 1),
y as (select name, case when n = total then v end as y, case when n >= 6 * (total - n) then v end as r from t)
select id, coalesce(s, ok.v, y, r) as value, case when s is not null then 'self' when ok.v is not null then 'dictionary' when y is not null then 'yearly' when r is not null then 'ratio' end as rule from own left join ok using (name) left join y using (name)""")
def attribute_cascade(spark, d):
    names = spark.createDataFrame([("red", "F"), ("old", "M"), ("cold", "M"), ("Cold", "F")], "name string, value string")
    first = F.split("p_name", " ")[0]
    c = table(spark, d, "part").filter((F.col("p_size") > 5) | (first == "new")).groupBy(first.alias("name"), F.when(F.col("p_size") > 6, "F").otherwise("M").alias("value"), (F.col("p_partkey") % 5).alias("year")).agg(F.count("*").alias("n"))
    return I.attribute_cascade(persons(spark, d), "id", "first", "gender", names, c)


@register("q_swapped_names", """with p as (select p_partkey // 16 as id, case when p_partkey % 3 = 0 then split_part(p_name, ' ', 2) else split_part(p_name, ' ', 1) end as f, case when p_partkey % 3 = 0 then split_part(p_name, ' ', 1) else split_part(p_name, ' ', 2) end as l from part),
n as (select id, f, l, count(*) as n from p where f <> l group by all) select a.id, a.f as wrong_first, a.l as wrong_last from n a join n b on a.id = b.id and a.f = b.l and a.l = b.f where a.n < b.n or (a.n = b.n and a.f > b.f)""")
def swapped_names(spark, d):
    x, y, odd = F.split("p_name", " ")[0], F.split("p_name", " ")[1], F.col("p_partkey") % 3 == 0
    p = table(spark, d, "part").select(F.floor(F.col("p_partkey") / 16).alias("id"), F.when(odd, y).otherwise(x).alias("f"), F.when(odd, x).otherwise(y).alias("l"))
    return I.swapped_names(p, "id", "f", "l")


@register("q_name_verdicts", f"""with {PERSONS}, n as (select id, first as f, last as l, list(distinct phone) as p from persons group by all), q as (select a.id, a.f as f1, a.l as l1, b.f as f2, b.l as l2, a.p as p1, b.p as p2 from n a join n b on a.id = b.id and (a.f < b.f or (a.f = b.f and a.l < b.l)))
select id, f1, l1, f2, l2, case when len(list_intersect(p1, p2)) > 0 then 'phone' when f1 = f2 then 'marriage' when f1 = l2 and l1 = f2 then 'swap' when (contains(f1, f2) or contains(f2, f1)) and (contains(l1, l2) or contains(l2, l1)) then 'substring'
when l1 = l2 and ((length(f1) = 1 and starts_with(f2, f1)) or (length(f2) = 1 and starts_with(f1, f2))) then 'initials' when l1 = l2 and ((f1 = 'large' and f2 = 'small') or (f1 = 'hot' and f2 = 'red')) then 'nickname'
when levenshtein(f1, f2) / greatest(length(f1), length(f2)) <= 0.3 and levenshtein(l1, l2) / greatest(length(l1), length(l2)) <= 0.3 then 'typo' else 'different' end as rule from q""")
def name_verdicts(spark, d):
    nicks = spark.createDataFrame([("Small", "large"), ("red", "hot")], "name1 string, name2 string")
    return I.name_verdicts(persons(spark, d), "id", "first", "last", "phone", nicks)


@register("q_reassign_ids", f"""with {PERSONS}, s as (select id, min(year) as t from persons group by 1), kv as (select distinct id, 'k' as k, first || state || phone as v from persons union select distinct id, 't', title || last || state || phone from persons),
f as (select k, v, min((t, id)) as b from kv join s using (id) group by 1, 2), m as (select id, min(b) as b from kv join f using (k, v) group by 1) select id, year, count(*) as n, min(m.b[2])::bigint as new_id from persons join m using (id) group by 1, 2""")
def reassign_ids(spark, d):
    p = persons(spark, d).withColumns({"k": F.concat("first", "state", "phone"), "t": F.concat("title", "last", "state", "phone")})
    return I.reassign_ids(p, "id", "year", ["k", "t"]).groupBy("id", "year").agg(F.count("*").alias("n"), F.min("new_id").alias("new_id"))


@register("q_shared_name_ids", f"""with {PERSONS}, p as (select *, first || ' ' || last || ' ' || phone as name from persons), k as (select name, count(distinct id) as n_ids, count(*) as n_rows from p group by 1 having count(distinct id) > 1), c as (select quantile_cont(n_rows, 0.25) as cut from k),
s as (select name, max(k) > 1 as s from (select name, state, count(distinct id) as k from p group by 1, 2) group by 1)
select name, n_ids, n_rows, n_rows <= cut as rare, case when n_rows <= cut and s then 'merge' when n_rows > cut and not s then 'split' else 'review' end as verdict from k join s using (name), c""")
def shared_name_ids(spark, d):
    return I.shared_name_ids(persons(spark, d).withColumn("name", F.concat_ws(" ", "first", "last", "phone")), "id", "name", "state")


@register("q_provenance", f"""with {PERSONS}, p as (select id, id - id % 3 as new_id, first || ' ' || last as name from persons), a as (select new_id, count(distinct id) > 1 as merged, count(distinct name) > 1 as many_names from p group by 1), b as (select name, count(distinct new_id) > 1 as split_name from p group by 1)
select id <> new_id as modified, merged, many_names, split_name, count(*) as n from p join a using (new_id) join b using (name) group by all""")
def provenance(spark, d):
    p = persons(spark, d).select("id", (F.col("id") - F.col("id") % 3).alias("new_id"), F.concat_ws(" ", "first", "last").alias("name"))
    return I.provenance(p, "id", "new_id", "name").groupBy("modified", "merged", "many_names", "split_name").agg(F.count("*").alias("n"))


@register("q_final_blocks", "with b as (select o_custkey as id, count(*) as n from orders group by 1) select id, n, case when id = 7 then 'SAME' when id = 13 then 'DIFFERENT' when n <= 8 then 'SAME' else 'UNDECIDED' end as label from b")
def final_blocks(spark, d):
    b = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    e = spark.createDataFrame([(7, "SAME"), (13, "DIFFERENT")], "id long, label string")
    return I.final_blocks(b, "k", "n", 8, e, "k").withColumnRenamed("k", "id")


@register("q_part_names", "with n as (select s_suppkey as i, case when s_suppkey % 4 = 0 then 'n' || (s_suppkey % 10) || '-x' || (s_suppkey % 7) else 'x' || (s_suppkey % 9) end as n from supplier), h as (select i as h, unnest(list_distinct(string_split(n, '-'))) as n from n where contains(n, '-')) select distinct least(h, i) as id1, greatest(h, i) as id2, n as part from h join n using (n) where h <> i")
def part_names(spark, d):
    k = F.col("s_suppkey")
    n = table(spark, d, "supplier").select("s_suppkey", F.when(k % 4 == 0, F.concat(F.lit("N"), (k % 10).cast("string"), F.lit("-x"), (k % 7).cast("string"))).otherwise(F.concat(F.lit("X"), (k % 9).cast("string"))).alias("n"))
    return I.part_names(n, "s_suppkey", "n")


_CODE = "upper(replace(replace(replace(split_part(p_name, ' ', 1) || split_part(p_name, ' ', 2), 'a', ''), 'e', ''), 'i', ''))"


def _codes(spark, d):
    words = F.concat(F.split("p_name", " ")[0], F.split("p_name", " ")[1])
    return table(spark, d, "part").groupBy(F.upper(F.translate(words, "aei", "")).alias("code")).agg(F.count("*").alias("n"))


@register("q_code_edges", f"""with c as (select {_CODE} as code, count(*) as n from part group by 1), e as (select a.code as x, b.code as y from c a join c b on a.code <> b.code where length(a.code) > 6 and length(b.code) > 3 and levenshtein(a.code, b.code) <= 2),
s as (select a.code as x, b.code as y from c a join c b on a.code < b.code and left(a.code, 2) = left(b.code, 2) where jaro_winkler_similarity(a.code, b.code) >= 0.9 and (a.n <= 25 or b.n <= 25))
select distinct least(x, y) as a, greatest(x, y) as b from (from e union all from s)""")
def code_edges(spark, d):
    c = _codes(spark, d)
    names = c.select(F.col("code").alias("a")), c.select(F.col("code").alias("b"))
    similar = J.similarity_join(*names, "a", "b", 0.9, [(F.substring("_a", 1, 2), F.substring("_b", 1, 2))]).filter("a < b")
    return I.code_edges(c, "code", "n", similar)


@register("q_split_giant", f"""with c as (select distinct {_CODE} as code from part), m as (select code, case when length(code) > 6 then 1 else length(code)::int end as comp from c), g as (select comp from m group by 1 order by count(*) desc, comp limit 1)
select code, comp, case when comp <> g.g then 'c:' || comp when code like '%T' then 'g:ends' else 'l:' || left(code, 1) end as part from m, (select comp as g from g) g""")
def split_giant(spark, d):
    m = _codes(spark, d).select("code", F.when(F.length("code") > 6, 1).otherwise(F.length("code")).alias("comp"))
    return I.split_giant(m, "code", "comp", m.filter(F.col("code").like("%T")).select(F.col("code").alias("node"), F.lit("ends").alias("part")))


@register("q_block_numbers", "select c_custkey, c_custkey % 9 + case when c_mktsegment = 'BUILDING' then 0 else (select max(c_custkey % 9) + 1 from customer where c_mktsegment = 'BUILDING') end as block from customer")
def block_numbers(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", (F.col("c_custkey") % 9).alias("b"))
    return I.block_numbers(c, "c_mktsegment", "b", "BUILDING").select("c_custkey", "block")


#: Features of pairs of customers of one nation and segment, from their keys.
_H = lambda a, b, m: f"((id1 * {a} + id2 * {b}) % {m})"
_FEATURES = {
    "title": _H(3, 5, 3) + " // 2", "name": _H(7, 11, 9) + " // 8", "entity": _H(13, 3, 11) + " // 10", "system": _H(5, 17, 4) + " // 3", "address": _H(19, 2, 13) + " // 12", "zip": _H(23, 29, 7) + " // 6", "state": _H(2, 7, 3) + " // 2", "states": _H(11, 3, 3) + " + 1",
    "first_lev": _H(31, 37, 7), "last_lev": _H(41, 3, 7), "old_first_lev": _H(31, 37, 7), "old_last_lev": _H(41, 3, 7), "first_jw": _H(43, 5, 101) + " / 100.0", "last_jw": _H(47, 7, 101) + " / 100.0", "old_first_jw": _H(43, 5, 101) + " / 100.0", "old_last_jw": _H(47, 7, 101) + " / 100.0",
    "nick": _H(53, 11, 10) + " = 0", "both_genders": _H(59, 3, 5) + " = 0", "both_male": _H(61, 3, 5) + " = 1", "last_n1": "id1 % 13", "last_n2": "id2 % 13", "first_freq": "id1 % 4001", "last_freq": "id2 % 3001", "miles": _H(67, 71, 1500) + " * 1.0", "apart_years": _H(73, 5, 5),
    "top": _H(79, 7, 4) + " = 0", "p_same": "case when " + _H(83, 3, 4) + " > 0 then " + _H(83, 3, 101) + " / 100.0 end", "p_diff": "case when " + _H(89, 5, 4) + " > 0 then " + _H(89, 5, 101) + " / 100.0 end",
    "pairs1": "id1 % 6 + 1", "pairs2": "id2 % 6 + 1", "linked1": "id1 % 3 = 0", "linked2": "id2 % 3 = 1", "rare_last1": "id1 % 5 = 0", "rare_last2": "id2 % 5 = 0", "rare_first1": "id1 % 7 = 0", "rare_first2": "id2 % 7 = 0", "overlap": _H(97, 3, 6),
    "one_year1": "id1 % 11 = 0", "one_year2": "id2 % 11 = 0", "mismatch": _H(101, 3, 5) + " = 2", "big": _H(103, 7, 3) + " = 0", "head": _H(107, 5, 6) + " = 0", "often": _H(109, 3, 2) + " = 0",
}
_LABEL, _PLACE = S.stage_sql()


@register("q_pair_stages", f"with c as (select c_custkey as id, c_nationkey as n, c_mktsegment as s from customer), p as (select a.id as id1, b.id as id2 from c a join c b on a.n = b.n and a.s = b.s and a.id < b.id), f as (select id1, id2, {', '.join(f'{e} as {k}' for k, e in _FEATURES.items())} from p) select id1, id2, {_LABEL} as label, {_PLACE} as stage from f")
def pair_stages(spark, d):
    c = table(spark, d, "customer")
    pairs = J.block_pairs(c, ["c_nationkey", "c_mktsegment"], "c_custkey", dealt=True).select("id1", "id2")
    # Fractions are doubles, as in SQL, and not decimals.
    features = pairs.withColumns({k: F.expr(re.sub(r"(\d\.\d+)", r"\1D", e.replace("//", "div"))) for k, e in _FEATURES.items()})
    return S.label_pairs(features).select("id1", "id2", "label", "stage")


@register("q_post_features", f"""with {PERSONS}, y as (select id, list(distinct year) as y, bool_or(title in ('LARGE', 'PROMO')) as top from persons group by 1), p as (select a.id as id1, b.id as id2, (a.id + b.id) % 3 as title, (a.id * b.id) % 2 as zip from (select distinct id from persons) a join (select distinct id from persons) b on a.id // 10 = b.id // 10 and a.id < b.id)
select id1, id2, (title > 0)::int as title_flag, (zip > 0)::int as zip_flag, len(list_intersect(a.y, b.y))::int as overlap, a.top or b.top as top, (title > 0)::int + (zip > 0)::int as total_shared from p join y a on id1 = a.id join y b on id2 = b.id""")
def post_features(spark, d):
    p = persons(spark, d)
    pairs = J.block_pairs(p.withColumn("b", F.floor(F.col("id") / 10)), ["b"], "id").select("id1", "id2", ((F.col("id1") + F.col("id2")) % 3).alias("title"), (F.col("id1") * F.col("id2") % 2).alias("zip"))
    return S.post_features(pairs, p, "id", "year", "title", ["LARGE", "PROMO"], ["title", "zip"]).drop("title", "zip")


@register("q_residual_pairs", "with p as (select distinct least(l_suppkey, l_linenumber) as id1, greatest(l_suppkey, l_linenumber) as id2 from lineitem where l_suppkey <> l_linenumber), r as (select * from p where (id1 + id2) % 3 <> 0), n as (select id, count(*) as n from (select id1 as id from r union all select id2 from r) group by 1) select id1, id2, a.n as open1, b.n as open2 from r join n a on a.id = id1 join n b on b.id = id2")
def residual_pairs(spark, d):
    p = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("id1"), F.col("l_linenumber").cast("long").alias("id2")).filter("id1 <> id2")
    return S.residual_pairs(p, p.filter("(id1 + id2) % 3 = 0").select(F.col("id2").alias("id1"), F.col("id1").alias("id2")))


@register("q_second_pass", f"""with {PERSONS}, a as (select distinct id, state, phone from persons), b as (select distinct id, first, last, title from persons), one as (select distinct x.id as id1, y.id as id2 from a x join a y on x.state = y.state and x.phone = y.phone and x.id < y.id),
two as (select x.id as id1, y.id as id2, x.first || x.title as k, x.last as l from b x join b y on x.first = y.first and x.last = y.last and x.title = y.title and x.id < y.id) select id1, id2, min((k, l))[1] as k, min((k, l))[2] as l from two anti join one using (id1, id2) group by 1, 2""")
def second_pass(spark, d):
    p = persons(spark, d).withColumn("k", F.concat("first", "title")).withColumn("l", F.col("last"))
    return S.second_blocks(p, "id", ["state", "phone"], ["k", "l"])


@register("q_two_column_join", "with n as (select distinct split_part(p_name, ' ', 1) as f, split_part(p_name, ' ', 2) as l from part), x as (select f || '|' || l as i, f, l from n) select a.i as id1, b.i as id2, levenshtein(a.f, b.f)::int as distance0, levenshtein(a.l, b.l)::int as distance1 from x a, x b where levenshtein(a.f, b.f) <= 2 and levenshtein(a.l, b.l) <= 2")
def two_column_join(spark, d):
    n = table(spark, d, "part").select(F.split("p_name", " ")[0].alias("f"), F.split("p_name", " ")[1].alias("l")).distinct()
    x = n.withColumn("id1", F.concat_ws("|", "f", "l"))
    return I.two_column_join(x, x.withColumnRenamed("id1", "id2"), "id1", "id2", ["f", "l"], ["f", "l"])


_ROWS = "select c_custkey // 3 as id, c_custkey % 3 as year, case when c_custkey % 5 > 0 then c_nationkey end as g, case c_custkey % 4 when 0 then 'nation_' || c_nationkey when 1 then 'NATION_' || c_nationkey || 'x' when 2 then 'zzz' else 'N' end as name from customer"


@register("q_entity_steps", f"""with r as ({_ROWS}), c as (select n_regionkey * 5 + n_nationkey % 5 as g, n_nationkey as c, lower(n_name) as n from nation union select n_nationkey, 100 + n_nationkey, 'nation_' || n_nationkey || 'xy' from nation where n_nationkey % 2 = 0),
p as (select r.*, c, n, lower(name) as m, jaro_winkler_similarity(lower(name), n) as s from r join c using (g)), b as (select *, max(s) over (partition by id, year) as best from p),
k as (select id, year, case when count(distinct c) = 1 then min(c) end as a1, case when count(distinct c) filter (m = n) = 1 then min(c) filter (m = n) end as a2, case when count(distinct c) filter (s = best and s >= 0.85) = 1 then min(c) filter (s = best and s >= 0.85) end as a3,
 case when count(distinct c) filter (contains(m, n) or contains(n, m)) = 1 then min(c) filter (contains(m, n) or contains(n, m)) end as a4 from b group by 1, 2),
o as (select r.id, r.year, coalesce(a1, a2, a3, a4) as v, case when a1 is not null then 'unique' when a2 is not null then 'exact' when a3 is not null then 'similar' when a4 is not null then 'within' end as step from r left join k using (id, year)),
f as (select *, last_value(v ignore nulls) over (partition by id order by year rows between unbounded preceding and 1 preceding) as x, first_value(v ignore nulls) over (partition by id order by year rows between 1 following and unbounded following) as y from o),
h as (select id, year, coalesce(v, case when x is null then y when y is null or x = y then x end) as v, coalesce(step, case when (x is null and y is not null) or (x is not null and y is null) or x = y then 'fill' end) as step from f),
n as (select id, v, count(*) as n from h where v is not null group by 1, 2), q as (select id, case when count(*) filter (n = top) = 1 then min(v) filter (n = top) end as v from (select *, max(n) over (partition by id) as top from n) group by 1)
select h.id, h.year, coalesce(h.v, q.v) as candidate, coalesce(step, case when q.v is not null then 'modal' end) as step from h left join q using (id)""")
def entity_steps(spark, d):
    k = F.col("c_custkey")
    low, up = F.concat(F.lit("nation_"), F.col("c_nationkey").cast("string")), F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string"), F.lit("x"))
    rows = table(spark, d, "customer").select(F.floor(k / 3).alias("id"), (k % 3).alias("year"), F.when(k % 5 > 0, F.col("c_nationkey")).alias("g"), F.when(k % 4 == 0, low).when(k % 4 == 1, up).when(k % 4 == 2, "zzz").otherwise("N").alias("name"))
    n = table(spark, d, "nation")
    c = n.select((F.col("n_regionkey") * 5 + F.col("n_nationkey") % 5).alias("group"), F.col("n_nationkey").alias("candidate"), F.col("n_name").alias("candidate_name")).union(
        n.filter("n_nationkey % 2 = 0").select("n_nationkey", F.col("n_nationkey") + 100, F.concat(F.lit("nation_"), F.col("n_nationkey").cast("string"), F.lit("xy"))))
    return I.entity_steps(rows, "id", "g", "name", "year", c).select("id", "year", "candidate", "step")


@register("q_validated_members", "with l as (select distinct l_suppkey as s, l_returnflag as f from lineitem) select s, f, case when s % 4 = 0 then 'system' when s % 3 = 0 and f <> 'N' then 'name' when s % 10 = 7 then 'address' end as by, s % 4 = 0 or (s % 3 = 0 and f <> 'N') or s % 10 = 7 as valid from l")
def validated_members(spark, d):
    links = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_returnflag").alias("f")).distinct()
    return I.validated_members(links, [("system", links.filter("s % 4 = 0")), ("name", links.filter("s % 3 = 0 and f <> 'N'")), ("address", links.filter("s % 10 = 7"))], ["s", "f"])


@register("q_leader_passes", """with a as (select o_custkey as e, year(o_orderdate)::int as t, min(o_orderkey) as id, 'p' || min(o_orderkey % 41) || min(o_orderpriority) as name from orders group by 1, 2),
b as (select o_custkey as e, year(o_orderdate)::int as t, 'p' || o_orderkey % 41 || o_orderpriority as n, o_orderstatus = 'P' as title, o_orderkey as person from orders where o_orderkey % 3 <> 0),
s as (select *, title and count(distinct case when title then person end) over (partition by e, t) = 1 as alone from b), j as (select a.id, s.person, s.t, abs(s.t - a.t) as k, jaro_winkler_similarity(a.name, s.n) as s, alone from a join s on a.e = s.e and abs(s.t - a.t) <= 2),
p as (select *, case when s >= 0.9 and k = 0 then 1 when alone and k = 0 then 2 when s >= 0.9 then 2 + k when alone then 100 + k end as precedence, case when s >= 0.9 and k = 0 then 'name' when alone and k = 0 then 'title' when s >= 0.9 then 'name_year' when alone then 'title_year' end as pass from j),
x as (select * from p where precedence is not null qualify row_number() over (partition by id order by precedence, s desc, t desc, person) = 1) select a.id, person, precedence, pass from a left join x using (id)""")
def leader_passes(spark, d):
    o = table(spark, d, "orders").withColumn("t", F.year("o_orderdate")).withColumnRenamed("o_custkey", "e")
    name = F.concat(F.lit("p"), (F.col("o_orderkey") % 41).cast("string"))
    a = o.groupBy("e", "t").agg(F.min("o_orderkey").alias("id"), F.concat(F.lit("p"), F.min(F.col("o_orderkey") % 41).cast("string"), F.min("o_orderpriority")).alias("name"))
    b = o.filter("o_orderkey % 3 <> 0").select("e", "t", F.concat(name, "o_orderpriority").alias("name"), (F.col("o_orderstatus") == "P").alias("title"), F.col("o_orderkey").alias("who"))
    return I.leader_passes(a, b, "id", "e", "t", "name", "title", "who").select("id", "person", "precedence", "pass")


def _level_sql(level: str, number: int) -> str:
    """One level's passes, numbered from ``number``."""
    return f"""select * from (select id, person, {number} + case when s >= 0.9 and k = 0 then 1 when alone and k = 0 then 2 when s >= 0.9 then 2 + k when alone then 100 + k end as precedence,
case when s >= 0.9 and k = 0 then 'name' when alone and k = 0 then 'title' when s >= 0.9 then 'name_year' when alone then 'title_year' end as pass, '{level}' as level, s, t from
(select a.id, b.person, b.t, abs(b.t - a.t) as k, jaro_winkler_similarity(a.name, b.n) as s, b.title and b.n_{level} = 1 as alone from a join b on a.{level} = b.{level} and abs(b.t - a.t) <= 2)) where precedence is not null qualify row_number() over (partition by id order by precedence, s desc, t desc, person) = 1"""


@register("q_leader_levels", f"""with a as (select o_custkey as e, o_custkey // 6 as g, year(o_orderdate)::int as t, min(o_orderkey) as id, 'p' || min(o_orderkey % 41) || min(o_orderpriority) as name from orders group by 1, 2, 3),
o as (select o_custkey as e, o_custkey // 6 as g, year(o_orderdate)::int as t, 'p' || o_orderkey % 41 || o_orderpriority as n, o_orderstatus = 'P' as title, o_orderkey as person from orders where o_orderkey % 7 = 0),
b as (select *, count(distinct case when title then person end) over (partition by e, t) as n_e, count(distinct case when title then person end) over (partition by g, t) as n_g from o),
f as ({_level_sql("e", 0)} union all {_level_sql("g", 1000)}), x as (select * from f qualify row_number() over (partition by id order by precedence) = 1) select a.id, person, precedence, pass, level from a left join x using (id)""")
def leader_levels(spark, d):
    """Customers as entities of systems of six; few orders are people, so that many leaders are found in the system only."""
    o = table(spark, d, "orders").withColumn("t", F.year("o_orderdate")).withColumnRenamed("o_custkey", "e").withColumn("g", F.floor(F.col("e") / 6))
    name = F.concat(F.lit("p"), (F.col("o_orderkey") % 41).cast("string"))
    a = o.groupBy("e", "g", "t").agg(F.min("o_orderkey").alias("id"), F.concat(F.lit("p"), F.min(F.col("o_orderkey") % 41).cast("string"), F.min("o_orderpriority")).alias("name"))
    b = o.filter("o_orderkey % 7 = 0").select("e", "g", "t", F.concat(name, "o_orderpriority").alias("name"), (F.col("o_orderstatus") == "P").alias("title"), F.col("o_orderkey").alias("who"))
    return I.leader_levels(a, b, "id", ["e", "g"], "t", "name", "title", "who").select("id", "person", "precedence", "pass", "level")
