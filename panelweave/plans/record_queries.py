"""Persons of the clients' table from their records: profiles, pair features, resolution in stages, distances, codes of sound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geodesy import geodesic_miles
from ..functions.text import ascii_fold, squish
from ..operators import estimation as E
from ..operators import pair_records as R
from .panel_queries import YEARLY, yearly
from .registry import register, table

TOP, HEAD = ("wholesale", "export"), ("export",)

#: A client's records: the row itself and each change of it; a city's state is the nation most of its clients are of.
_RECORDS = """home as (select city, nation_id as state from clients where city is not null and nation_id is not null group by city, nation_id qualify row_number() over (partition by city order by count(*) desc, nation_id) = 1),
seen as (select client_id as id, updated_at as ts, segment as title, city, source as system from clients union all select client_id, valid_at, segment, city, source from client_changes),
named as (select client_id as id, lower(strip_accents(trim(regexp_replace(name, '\\s+', ' ', 'g')))) as n, email from clients where client_id is not null),
worded as (select id, email, string_split(n, ' ') as w, string_split(regexp_replace(n, ' jr$', ''), ' ') as v from named where n is not null),
records as (select s.id, month(ts)::int as year, v[1] as first, v[-1] as last, w[1] as old_first, w[-1] as old_last, title, city as name, system || ':' || city as entity, system, email as address, left(email, 4) as zip, state,
 case right(v[1], 1) when 'a' then 'F' when 'o' then 'M' when 'n' then 'M' end as gender, case when title in ('retail', 'online') then 'open' when title is not null then 'trade' end as kind
 from seen s join worded using (id) left join home using (city))"""


def records(spark, d) -> DataFrame:
    clients, changes = table(spark, d, "clients"), table(spark, d, "client_changes")
    n = clients.filter("city is not null and nation_id is not null").groupBy("city", "nation_id").agg(F.count("*").alias("n"))
    home = n.groupBy("city").agg(F.min(F.struct((-F.col("n")).alias("n"), "nation_id")).alias("m")).select("city", F.col("m.nation_id").alias("state"))
    own = clients.select(F.col("client_id").alias("id"), F.col("updated_at").alias("at"), F.col("segment").alias("title"), "city", F.col("source").alias("system"))
    seen = own.union(changes.select("client_id", "valid_at", "segment", "city", "source"))
    spoken = F.lower(ascii_fold(squish(F.col("name"))))
    words = lambda c: F.split(c, " ")
    w, v = F.col("w"), F.col("v")
    worded = clients.filter("client_id is not null and name is not null").select(F.col("client_id").alias("id"), "email", words(spoken).alias("w"), words(F.regexp_replace(spoken, " jr$", "")).alias("v"))
    last = F.right(v[0], F.lit(1))
    return seen.join(worded, "id").join(home, "city", "left").select(
        "id", F.month("at").alias("year"), v[0].alias("first"), F.element_at(v, -1).alias("last"), w[0].alias("old_first"), F.element_at(w, -1).alias("old_last"), "title", F.col("city").alias("name"),
        F.concat_ws(":", "system", "city").alias("_e"), "system", F.col("email").alias("address"), F.left("email", F.lit(4)).alias("zip"), "state",
        F.when(last == "a", "F").when(last.isin("o", "n"), "M").alias("gender"), F.when(F.col("title").isin("retail", "online"), "open").when(F.col("title").isNotNull(), "trade").alias("kind"),
    ).withColumn("entity", F.when(F.col("system").isNotNull() & F.col("name").isNotNull(), F.col("_e"))).drop("_e")


#: Where a nation lies is made of its keys, as no table tells it.
_PLACES = "places as (select n_nationkey as state, n_nationkey * 6.5 - 77 as lat, (n_nationkey * 47 + n_regionkey * 11) % 360 - 180.0 as lon from nation)"
_BLOCK = "left(last, 3) || left(first, 1)"

#: Distances by Vincenty's own iteration of the longitude, which converges for these places.
_ROUND = "select s, t, u1, u2, l, sl, cl, sa, sp, cp, m, l + (1 - c) * f * sa * (atan2(sp, cp) + c * sp * (m + c * cp * (2 * m * m - 1))) as x from (select *, f / 16 * (1 - sa * sa) * (4 + f * (4 - 3 * (1 - sa * sa))) as c from (select *, case when sa * sa = 1 then 0 else cp - 2 * sin(u1) * sin(u2) / (1 - sa * sa) end as m from (select *, case when sp = 0 then 0 else cos(u1) * cos(u2) * sl / sp end as sa from (select *, sqrt(pow(cos(u2) * sl, 2) + pow(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cl, 2)) as sp, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cl as cp from (select s, t, u1, u2, l, sin(x) as sl, cos(x) as cl, 1 / 298.257223563 as f from {0})))))"
_GEODESIC = _PLACES + ", v0 as (select a.state as s, b.state as t, atan((1 - 1 / 298.257223563) * tan(radians(a.lat))) as u1, atan((1 - 1 / 298.257223563) * tan(radians(b.lat))) as u2, radians(b.lon - a.lon) as l, radians(b.lon - a.lon) as x from places a join places b on a.state < b.state), " + ", ".join(
    f"v{k} as materialized ({_ROUND.format(f'v{k - 1}')})" for k in range(1, 31)
) + """, miles as (select s as a, t as b, 6378137.0 * (1 - 1 / 298.257223563) * big * (atan2(sp, cp) - small * sp * (m + small / 4 * (cp * (2 * m * m - 1) - small / 6 * m * (4 * sp * sp - 3) * (4 * m * m - 3)))) / 1609.344 as miles
 from (select *, 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u))) as big, u / 1024 * (256 + u * (-128 + u * (74 - 47 * u))) as small from (select *, (1 - sa * sa) * (pow(1 / (1 - 1 / 298.257223563), 2) - 1) as u from v30)))"""


def distances(spark, d) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("s"), (F.col("n_nationkey") * 6.5 - 77).alias("lat"), ((F.col("n_nationkey") * 47 + F.col("n_regionkey") * 11) % 360 - 180.0).alias("lon"))
    x, y = n.select(F.col("s").alias("a"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1")), n.select(F.col("s").alias("b"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    return x.join(y, F.col("a") < F.col("b")).select("a", "b", geodesic_miles(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")).alias("miles"))


@register("q_geodesic_miles", f"with {_GEODESIC} select a, b, round(miles, 3) as miles from miles")
def q_geodesic_miles(spark, d):
    return distances(spark, d).withColumn("miles", F.round("miles", 3))


def features(spark, d) -> DataFrame:
    r = records(spark, d)
    names = r.select("first").filter("first is not null").distinct()
    # Nicknames: a first name and its beginning up to the last vowel but one, as the table has them.
    short = names.withColumn("name2", F.regexp_extract("first", "^(.{2,}?)[aeiou][^aeiou]*[aeiou]?$", 1)).filter("name2 <> '' and name2 <> first").select(F.col("first").alias("name1"), "name2")
    codes = names.select(F.col("first").alias("name"), F.regexp_replace("first", "[aeiou]", "").alias("code"))
    miles = distances(spark, d)
    both = miles.union(miles.select("b", "a", "miles"))
    blocked = r.withColumn("block", F.concat(F.left("last", F.lit(3)), F.left("first", F.lit(1))))
    return R.block_record_features(blocked, "block", short, codes, both, TOP, HEAD)


def _features_sql() -> str:
    s = {c: f"coalesce(list(distinct {c}) filter ({c} is not null), [])" for c in (*R.SHARED, "year", "gender", "kind")}
    earliest = ", ".join(f"(min({{'y': year, 'v': {c}}}) filter ({c} is not null)).v as {c}" for c in R.NAMES)
    shared = ", ".join(f"len(list_intersect(a.{c}_s, b.{c}_s))::int as {c}" for c in R.SHARED)
    total = " + ".join(f"least({c}, 1)" for c in R.SHARED if c != "state")
    scores = ", ".join(f"levenshtein(a.{c}, b.{c})::int as {c}_lev, jaro_winkler_similarity(a.{c}, b.{c}) as {c}_jw" for c in R.NAMES)
    return f"""{_RECORDS}, {_GEODESIC}, far as (select a, b, miles from miles union all select b, a, miles from miles),
own as (select id, count(*) as rows, {earliest}, {", ".join(f"{e} as {c}_s" for c, e in s.items())} from records group by id),
lastn as (select last, count(distinct id) as n, count(distinct first) as c from records where last is not null group by last), firstn as (select first, count(distinct last) as c from records where first is not null group by first),
oldf as (select old_first, count(distinct id) as first_freq from records where old_first is not null group by 1), oldl as (select old_last, count(distinct id) as last_freq from records where old_last is not null group by 1),
prof as (select o.*, (select max(n) from lastn l join (select distinct id, last from records) r on r.last = l.last where r.id = o.id) as last_n, coalesce(f.c <= {R.RARE}, false) as rare_first, coalesce(g.c <= {R.RARE}, false) as rare_last, first_freq, last_freq, regexp_replace(o.first, '[aeiou]', '', 'g') as code
 from own o left join firstn f on f.first = o.first left join lastn g on g.last = o.last left join oldf on oldf.old_first = o.old_first left join oldl on oldl.old_last = o.old_last),
blocks as (select distinct id, {_BLOCK} as b from records where {_BLOCK} is not null), pairs as (select distinct x.id as id1, y.id as id2 from blocks x join blocks y on x.b = y.b and x.id < y.id),
short as (select first as name1, regexp_extract(first, '^(.{{2,}}?)[aeiou][^aeiou]*[aeiou]?$', 1) as name2 from (select distinct first from records where first is not null)), nicks as (select name1, name2 from short where name2 <> '' and name1 <> name2 union select name2, name1 from short where name2 <> '' and name1 <> name2),
large as (select state from records where state is not null group by state having count(distinct id) * {R.LARGE_STATE} > (select count(distinct id) from records)),
held as (select distinct id, year, title from records where title is not null and year is not null), n1 as (select title as t1, count(*) as n from held group by 1),
same as (select a.title as t1, b.title as t2, count(*)::double / any_value(n) as p from held a join held b on a.id = b.id and a.year = b.year and a.title <> b.title join n1 on n1.t1 = a.title group by 1, 2),
one as (select id, year, min(title) as t from held group by 1, 2), mv as (select a.t as t1, b.t as t2, count(*)::double as m from one a join one b on a.id = b.id and b.year = a.year + 1 group by 1, 2), moves as (select t1, t2, m / sum(m) over (partition by t1) as p from mv),
psame as (select id1, id2, min(p) as p_same, true as met from pairs join held a on a.id = id1 join held b on b.id = id2 and b.year = a.year left join same on t1 = a.title and t2 = b.title group by 1, 2),
span as (select id, min({{'y': year, 't': t}}) as b, max({{'y': year, 't': t}}) as e from one group by id),
pdiff as (select id1, id2, p as p_diff from (select p.id1, p.id2, case when a.e.y <= b.b.y then a.e.t else b.b.t end as x, case when a.e.y <= b.b.y then b.b.t else a.e.t end as z from pairs p join span a on a.id = id1 join span b on b.id = id2 anti join psame s on s.id1 = p.id1 and s.id2 = p.id2) join moves on t1 = x and t2 = z),
hist as (select id, year, min(state) as s from records where year is not null group by 1, 2), gaps as (select id1, id2, count(*) as apart_years, coalesce(sum(far.miles), 0) as miles from pairs join hist a on a.id = id1 join hist b on b.id = id2 and a.year = b.year and a.s <> b.s left join far on far.a = a.s and far.b = b.s group by 1, 2),
feats as materialized (select *, {total} as total_shared from (select p.id1, p.id2, {shared}, len(list_distinct(a.state_s || b.state_s))::int as states, {scores}, coalesce(a.code = b.code, false) as same_code,
 exists (select 1 from nicks where name1 = a.first and name2 = b.first) as nick, exists (select 1 from nicks where name1 = a.old_first and name2 = b.old_first) as old_nick,
 list_contains(a.gender_s || b.gender_s, 'F') and list_contains(a.gender_s || b.gender_s, 'M') as both_genders, list_contains(a.gender_s || b.gender_s, 'M') and not list_contains(a.gender_s || b.gender_s, 'F') as both_male,
 coalesce(greatest(a.last_n, b.last_n) > {R.FREQUENT}, false) as often, a.last_n as last_n1, b.last_n as last_n2, a.rows as rows1, b.rows as rows2, a.rare_first as rare_first1, b.rare_first as rare_first2, a.rare_last as rare_last1, b.rare_last as rare_last2,
 coalesce(a.first_freq, 0) as first_freq, coalesce(a.last_freq, 0) as last_freq, len(list_intersect(a.year_s, b.year_s))::int as overlap, len(a.year_s) = 1 as one_year1, len(b.year_s) = 1 as one_year2,
 len(list_intersect(a.title_s || b.title_s, {list(TOP)})) > 0 as top, len(list_intersect(list_intersect(a.title_s, b.title_s), {list(HEAD)})) > 0 as head,
 len(a.kind_s) > 0 and len(b.kind_s) > 0 and len(list_intersect(a.kind_s, b.kind_s)) = 0 as mismatch, exists (select 1 from large where list_contains(a.state_s, state) and list_contains(b.state_s, state)) as big,
 coalesce(apart_years, 0) as apart_years, coalesce(miles, 0) as miles, p_same, p_diff
 from pairs p join prof a on a.id = p.id1 join prof b on b.id = p.id2 left join gaps g on g.id1 = p.id1 and g.id2 = p.id2 left join psame s on s.id1 = p.id1 and s.id2 = p.id2 left join pdiff d on d.id1 = p.id1 and d.id2 = p.id2))"""


_ROUNDED = [c for c in R.FEATURES if c.endswith("_jw") or c in ("miles", "p_same", "p_diff")]


@register("q_record_features", f"with {_features_sql()} select id1, id2, {', '.join(f'round({c}, {3 if c == 'miles' else 6}) as {c}' if c in _ROUNDED else c for c in R.FEATURES)} from feats")
def q_record_features(spark, d):
    return features(spark, d).withColumns({c: F.round(c, 3 if c == "miles" else 6) for c in _ROUNDED})


@register("q_record_resolution", f"with {_features_sql()}, {R.resolution_sql('feats')} select id1, id2, label, stage from resolved")
def q_record_resolution(spark, d):
    return R.resolve_in_stages(features(spark, d))


#: A panel whose effects are known: those of customers, of years, and of a cohort's years since its event; the estimate is their mean by the cohorts' shares.
_COHORT = "case o_custkey % 3 when 0 then 1997 when 1 then 1998 end"
_KNOWN = f"""{YEARLY}, x as (select o_custkey, year, {_COHORT} as cohort, o_custkey % 2 as half, greatest(-2, least(2, year - {_COHORT})) as rel from yearly),
e as (select *, case when rel >= 0 then cohort - 1990 + rel * 0.5 + half else 0 end as effect from x where cohort is not null and rel <> -1)"""


def _known_sql(group: str) -> str:
    return f"""with {_KNOWN}, m as (select *, {group} as g, avg(effect) over (partition by {group}, rel) as b, count(*) over (partition by {group}, rel) as size from e), u as (select o_custkey, g, rel, any_value(b) as b, sum((effect - b) / size) as part from m group by 1, 2, 3)
select case when g is null then '' else g || ':' end || 't' || rel as term, round(any_value(b), 6) as b, round(sqrt(sum(part * part)), 6) as se, (select count(*) from x) as n, (select count(distinct o_custkey) from x) as clusters from u group by g, rel"""


def known_fit(spark, d, split: str | None):
    cohort = F.when(F.col("o_custkey") % 3 == 0, 1997).when(F.col("o_custkey") % 3 == 1, 1998)
    x = yearly(spark, d).select("o_custkey", "year", cohort.alias("cohort"), (F.col("o_custkey") % 2).alias("half"))
    rel = F.greatest(F.lit(-2), F.least(F.lit(2), F.col("year") - F.col("cohort")))
    share = F.col("half") if split else F.lit(0)
    effect = F.when(F.col("cohort").isNotNull() & (rel >= 0), F.col("cohort") - 1990 + rel * 0.5 + share).otherwise(0.0)
    x = x.withColumn("y", F.col("o_custkey") % 7 + F.col("year") % 5 * 1.5 + effect)
    return E.as_frame(spark, {"known": E.event_study(x, "o_custkey", "year", "cohort", "y", 2, split=split)}).select("term", F.round("b", 6).alias("b"), F.round("se", 6).alias("se"), "n", "clusters")


@register("q_event_study_known", _known_sql("null::varchar").replace(" + half else", " else"))
def event_study_known(spark, d):
    return known_fit(spark, d, None)


@register("q_event_study_split_known", _known_sql("half::varchar"))
def event_study_split_known(spark, d):
    return known_fit(spark, d, "half")
