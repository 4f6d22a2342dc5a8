"""Text scalars, dates, codes of sound and faulty files over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.double_metaphone import word_codes
from ..operators import joins as J
from ..operators import similarity_joins as S
from ..sources import files
from .registry import register, table
from .source_queries import _folder

_SQUISH = lambda x: rf"trim(regexp_replace({x}, '[\s\x{{A0}}]+', ' ', 'g'))"
_BARE = lambda x: _SQUISH(rf"regexp_replace({x}, '(?i)(?:[\s,]+(?:{'|'.join(T.NAME_SUFFIXES)})\.?)+\s*$', '')")
_NO_NICK = lambda x: _SQUISH(rf"regexp_replace({x}, '\([^)]*\)', ' ', 'g')")


def clients(spark, d):
    return table(spark, d, "clients")


@register("q_person_names", rf"""with t as (select client_id, name || case client_id % 5 when 0 then '  Jr.' when 1 then ', MD, ' || coalesce(segment, '') when 2 then ' (' || coalesce(city, '') || ') III' when 3 then ' K. Esq' else '' end as n from clients),
p as (select *, {_NO_NICK("split_part(n, ',', 1)")} as whole from t), w as (select *, list_filter(string_split({_BARE("whole")}, ' '), lambda x: length(replace(x, '.', '')) > 1) as w from p)
select client_id, {_BARE("n")} as bare, nullif({_SQUISH(r"regexp_extract(n, '\(([^)]*)\)', 1)")}, '') as nick, {_NO_NICK("n")} as rest, w[1] as first, case when len(w) > 1 then w[-1] end as last,
case when contains(n, ',') then nullif({_SQUISH("substr(n, instr(n, ',') + 1)")}, '') end as title, regexp_replace(strip_accents(n), '[^\x00-\x7F]', '', 'g') as ascii from w""")
def person_names(spark, d):
    kind = F.col("client_id") % 5
    mark = F.when(kind == 0, "  Jr.").when(kind == 1, F.concat(F.lit(", MD, "), F.coalesce("segment", F.lit("")))).when(kind == 2, F.concat(F.lit(" ("), F.coalesce("city", F.lit("")), F.lit(") III"))).when(kind == 3, " K. Esq").otherwise("")
    t, n = clients(spark, d).select("client_id", F.concat("name", mark).alias("n")), F.col("n")
    p = T.person_parts(n)
    return t.select("client_id", T.drop_suffixes(n).alias("bare"), T.nickname(n).alias("nick"), T.drop_nickname(n).alias("rest"), p.first.alias("first"), p.last.alias("last"), p.title.alias("title"), T.ascii_fold(n).alias("ascii"))


@register("q_number_texts", r"""with t as (select stamp_id, raw as s, regexp_replace(split_part(raw, '-', 1), '[^0-9]', '', 'g') as z from stamps)
select stamp_id, regexp_replace(s, '^0+(.)', '\1') as stripped, case when regexp_full_match(trim(s), '[0-9.]+') then try_cast(trim(s) as double) end as number, case when length(z) > 0 then lpad(z[1:5], 5, '0') end as zip, regexp_replace(s, '[^0-9]', '', 'g') as digits, case when length(s) >= 6 then s else lpad(s, 6, '0') end as id from t""")
def number_texts(spark, d):
    s = F.col("raw")
    return table(spark, d, "stamps").select("stamp_id", T.strip_zeros(s).alias("stripped"), T.to_number(s).alias("number"), T.zip5(s).alias("zip"), T.digits(s).alias("digits"), T.pad_id(s).alias("id"))


_WORDS = [list(t) for t in (T.DIRECTIONS, T.STREET_WORDS, T.ORDINALS)]
_SHORT = T.DIRECTIONS | T.STREET_WORDS | T.ORDINALS
_PICK = lambda words, by: f"{words}[({by}) % {len(words)} + 1]"


@register("q_addresses", f"""with t as (select client_id, client_id || ' ' || {_PICK(_WORDS[0], 'client_id')} || '-' || {_PICK(_WORDS[2], 'client_id // 3')} || '  ' || coalesce(city, 'Northern') || ' ' || {_PICK(_WORDS[1], 'client_id // 7')} || ', Suite.' as a from clients)
select client_id, array_to_string(list_transform(string_split({_SQUISH(r"regexp_replace(regexp_replace(lower(a), '-', ' ', 'g'), '[^\p{L}\p{N}\s]', '', 'g')")}, ' '), lambda w: coalesce(map {_SHORT}[w], w)), ' ') as address from t""")
def addresses(spark, d):
    key = F.col("client_id")
    pick = lambda words, by: F.element_at(F.array(*map(F.lit, words)), (by % len(words) + 1).cast("int"))
    third, seventh = F.floor(key / 3), F.floor(key / 7)
    a = F.concat(key.cast("string"), F.lit(" "), pick(_WORDS[0], key), F.lit("-"), pick(_WORDS[2], third), F.lit("  "), F.coalesce("city", F.lit("Northern")), F.lit(" "), pick(_WORDS[1], seventh), F.lit(", Suite."))
    return clients(spark, d).select("client_id", T.standard_address(a).alias("address"))


@register("q_word_tests", rf"""with t as (select client_id, case when client_id % 3 = 0 then 'Saint ' else '' end || name as n, lower(name) as l, regexp_replace(split_part(email, '@', 1), '[0-9]', '', 'g') as e, segment || ' ' || source || '  ' || coalesce(city, '') as k, lower(string_split({_SQUISH("name")}, ' ')[1]) as f, string_split({_SQUISH("name")}, ' ')[-1] as g, balance from clients),
u as (select *, f[1:(client_id % 6 + 1)::int] as b, string_split(lower({_SQUISH("n")}), ' ') as w from t)
select client_id, case when w[1] = 'saint' and len(w) > 1 then w[1] || ' ' || w[2] else w[1] end as first, length(l) > 0 and length(e) > 0 and (contains(l, e) or contains(e, l)) as either, array_to_string(list_filter(string_split(k, ' '), lambda x: lower(x) not in ('web', 'retail', 'store', '')), ' ') as left_over,
format('{{:,.1f}}', (client_id % 997) / 7.0 * 100) || '%' as share, starts_with(f, b) and (length(b) = 1 or length(b) >= 3 or (length(b) > 0 and length(b) = length(f) - 1)) as variant from u""")
def word_tests(spark, d):
    n = F.concat(F.when(F.col("client_id") % 3 == 0, "Saint ").otherwise(""), "name")
    mail = F.regexp_replace(F.split("email", "@")[0], "[0-9]", "")
    first = F.split(T.squish(F.col("name")), " ")[0]
    return clients(spark, d).select(
        "client_id", T.first_word(n).alias("first"), T.contains_either(F.lower("name"), mail).alias("either"), T.drop_words(F.concat("segment", F.lit(" "), "source", F.lit("  "), F.coalesce("city", F.lit(""))), ["web", "retail", "store"]).alias("left_over"),
        T.format_share(F.col("client_id") % 997 / 7.0).alias("share"), T.initials_match(F.left(first, (F.col("client_id") % 6 + 1).cast("int")), first).alias("variant"),
    )


@register("q_spaces_and_lists", rf"""with t as (select client_id, chr(160) || ' ' || name || chr(9) || coalesce(city, chr(8203)) || chr(7) as s, segment || '; ' || source || ' ;' || coalesce(city, '') as l from clients)
select client_id, {_SQUISH(r"regexp_replace(regexp_replace(s, '[\x{A0}\x{2000}-\x{200A}\t\n]', ' ', 'g'), '[\x{200B}\x00-\x08]', '', 'g')")} as plain, list_contains(list_transform(string_split(l, ';'), lambda v: trim(v)), 'web') as has, list_contains(list_transform(string_split(l, ';'), lambda v: trim(v)), 'tail') as other from t""")
def spaces_and_lists(spark, d):
    s = F.concat(F.lit("  "), "name", F.lit("\t"), F.coalesce("city", F.lit("​")), F.lit("\u0007"))
    listed = F.concat("segment", F.lit("; "), "source", F.lit(" ;"), F.coalesce("city", F.lit("")))
    return clients(spark, d).select("client_id", T.plain_space(s).alias("plain"), T.in_list(listed, F.lit("web")).alias("has"), T.in_list(listed, F.lit("tail")).alias("other"))


_PHONE = "'(' || (200 + client_id % 700) || ') 555-' || lpad((client_id % 10000)::varchar, 4, '0') || case client_id % 4 when 0 then ' ext. ' || nation_id when 1 then ' X' || client_id when 2 then ' Ext 5 ' else '' end"


@register("q_extensions", rf"select client_id, regexp_replace(regexp_replace(lower({_PHONE}), '\s*(?:ext\.?|x)\s*[0-9]+\s*$', ''), '[^0-9]', '', 'g') as bare from clients")
def extensions(spark, d):
    return clients(spark, d).select("client_id", T.squish(T.strip_extension(F.expr(_PHONE.replace("::varchar", "").replace("lpad((client_id % 10000)", "lpad(cast(client_id % 10000 as string)")))).alias("bare"))


@register("q_mixed_dates", r"""with t as (select stamp_id, case when stamp_id % 2 = 0 then raw else 'on ' || strftime(date '2000-01-01' + (stamp_id % 9000)::int, '%B %-d, %Y') || ' - ' || coalesce(raw, '') end as s from stamps),
p as (select stamp_id, coalesce(try_cast(nullif(regexp_extract(s, '([0-9]{4}-[0-9]{2}-[0-9]{2})', 1), '') as date), try_strptime(nullif(regexp_extract(s, '([A-Z][a-z]+ [0-9]{1,2}, [0-9]{4})', 1), ''), '%B %d, %Y')::date) as day from t) select stamp_id, day, year(day)::int as year from p""")
def mixed_dates(spark, d):
    spoken = F.concat(F.lit("on "), F.date_format(F.date_add(F.lit("2000-01-01").cast("date"), (F.col("stamp_id") % 9000).cast("int")), "MMMM d, yyyy"), F.lit(" - "), F.coalesce("raw", F.lit("")))
    t = table(spark, d, "stamps").select("stamp_id", F.when(F.col("stamp_id") % 2 == 0, F.col("raw")).otherwise(spoken).alias("html"))
    p = files.page_fields(t)
    return p.select("stamp_id", F.col("date").alias("day"), F.year("date").alias("year"))


#: The published rules by hand, for every word that parts and items are named with.
_CODES = "ring RNK|bolt PLT|blue PL|cold KLT|new N NF|large LRJ LRK|red RT|plate PLT|rod RT|small SML XML|gear JR KR|gizmo JSM KSM|anvil ANFL|hot HT|old ALT|widget AJT FJT"
_CODE_ROWS = ", ".join(f"('{w}', '{a}', '{b[0] if b else ''}')" for w, a, *b in (e.split() for e in _CODES.split("|")))


@register("q_word_codes", f"with c(word, first_code, second_code) as (values {_CODE_ROWS}), w as (select distinct unnest(string_split(p_name, ' ')) as word from part union select unnest(string_split(name, ' ')) from items) select word, first_code, second_code from w left join c using (word)")
def q_word_codes(spark, d):
    names = table(spark, d, "part").select(F.col("p_name").alias("name")).union(table(spark, d, "items").select("name"))
    return word_codes(names, "name").select("word", F.col("primary").alias("first_code"), F.col("secondary").alias("second_code"))


@register("q_phonetic_codes", f"""with c(word, a, b) as (values {_CODE_ROWS}), p as (select p_partkey, case when length(a) > 1 then regexp_replace(a, 'S$', '') else a end as a from part left join c on word = split_part(p_name, ' ', 2))
select p_partkey, a as code, count(*) over (partition by a) as alike from p""")
def phonetic_codes(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.split("p_name", " ")[1].alias("word"))
    coded = p.join(word_codes(p, "word"), "word", "left").select("p_partkey", T.base_code(F.col("primary")).alias("code"))
    return coded.join(coded.groupBy("code").agg(F.count("*").alias("alike")), "code").select("p_partkey", "code", "alike")


_SORTED = lambda c: f"array_to_string(list_sort(list_filter(string_split({c}, ' '), lambda w: w <> '')), ' ')"
#: Rows of the longest common subsequence, one letter a step; a cell is the greatest of the one above and of one more than any match to its left allows.
_LCS = """lcs as (select a, b, 0 as i, list_transform(range(0, length(b) + 1), lambda z: 0) as x from texts
union all select a, b, i + 1, [0] || list_transform(range(1, length(b) + 1), lambda j: greatest(x[j + 1], coalesce(list_max(list_transform(list_filter(range(1, j + 1), lambda k: b[k] = a[i + 1]), lambda k: x[k] + 1)), 0))) from lcs where i < length(a)),
ratios as (select a, b, case when length(a) + length(b) = 0 then 100.0 else 200.0 * x[-1] / (length(a) + length(b)) end as ratio from lcs where i = length(a))"""


@register("q_token_sort", f"""with recursive n as (select brand, name, {_SORTED("name")} as s from items where brand is not null and name is not null group by all), pairs as (select p.brand, p.name as name1, q.name as name2, p.s as a, q.s as b from n p join n q on p.brand = q.brand and p.name < q.name),
texts as (select distinct a, b from pairs), {_LCS} select brand, name1, name2, round(ratio, 4) as ratio from pairs join ratios using (a, b)""")
def token_sort(spark, d):
    n = table(spark, d, "items").select("brand", "name").filter("brand is not null and name is not null").distinct()
    pairs = n.withColumnRenamed("name", "name1").join(n.withColumnRenamed("name", "name2"), "brand").filter("name1 < name2")
    scored = pairs.select("name1", "name2").distinct().withColumn("ratio", F.round(T.token_sort_ratio(F.col("name1"), F.col("name2")), 4))
    return pairs.join(scored, ["name1", "name2"]).select("brand", "name1", "name2", "ratio")


@register("q_token_sort_match", f"""with recursive p as (select p_partkey as k, p_brand as g, p_name as n, {_SORTED("p_name")} as s from part), texts as (select distinct x.s as a, y.s as b from p x join p y on x.g = y.g and x.k % 2 = 0 and y.k % 2 = 1), {_LCS},
m as (select x.k as id, y.k as other, ratio, row_number() over (partition by x.k order by round(ratio, 9) desc, y.k) as r, x.n as n1, y.n as n2 from p x join p y on x.g = y.g and x.k % 2 = 0 and y.k % 2 = 1 join ratios t on t.a = x.s and t.b = y.s)
select id, other, round(ratio, 4) as score from m where r = 1 and (ratio >= 60 or contains(n1, n2) or contains(n2, n1))""")
def token_sort_match(spark, d):
    p = table(spark, d, "part")
    side = lambda k, i, t: p.filter(f"p_partkey % 2 = {k}").select("p_brand", F.col("p_partkey").alias(i), F.col("p_name").alias(t))
    return J.best_token_sort(side(0, "id", "a"), side(1, "other", "b"), ["p_brand"], "id", "a", "b", "other", 60.0).select("id", "other", F.round("score", 4).alias("score"))


@register("q_metaphone_blocks", f"with c(word, a, b) as (values {_CODE_ROWS}), w as (select distinct unnest(string_split(p_name, ' ')) as word from part), p as (select word, case when length(a) > 1 then regexp_replace(a, 'S$', '') else a end as code from w join c using (word)) select code, count(*) as n, string_agg(word, ';' order by word) as words from p group by code")
def metaphone_blocks(spark, d):
    n = word_codes(table(spark, d, "part"), "p_name").select(F.col("word").alias("w"), T.base_code(F.col("primary")).alias("code"))
    return n.groupBy("code").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("w")), ";").alias("words"))


@register("q_similar_names", "with x as (select distinct lower(strip_accents(name)) as s from clients where name is not null), y as (select vendor_id, lower(strip_accents(name)) as t from vendors) select s, vendor_id, round(jaro_similarity(s, t), 6) as similarity from x left join y on jaro_similarity(s, t) >= 0.9")
def similar_names(spark, d):
    plain = lambda c: F.lower(T.ascii_fold(F.col(c)))
    x = clients(spark, d).select(plain("name").alias("s")).filter("s is not null").distinct()
    return S.similarity_left_join(x, table(spark, d, "vendors").select("vendor_id", plain("name").alias("t")), "s", "t", 0.1, weight=0.0).select("s", "vendor_id", F.round("similarity", 6).alias("similarity"))


_SPLIT = r"(select client_id as {0}, string_split(lower(strip_accents({1})), ' ')[1] as f, string_split(lower(strip_accents({1})), ' ')[-1] as l from clients where client_id is not null)"


@register("q_aligned_names", f"""with a as (select distinct id1, f, l from {_SPLIT.format("id1", _SQUISH("name"))}), d as (select distinct f, l from a where f is not null and l is not null),
n as (select x.f as f1, x.l as l1, y.f as f2, y.l as l2 from d x join d y on damerau_levenshtein(x.f, y.f) <= 1 and damerau_levenshtein(x.l, y.l) <= 1)
select x.id1, y.id1 as id2, damerau_levenshtein(x.f, y.f)::int as distance0, damerau_levenshtein(x.l, y.l)::int as distance1 from n join a x on x.f = f1 and x.l = l1 join a y on y.f = f2 and y.l = l2 where x.id1 < y.id1""")
def aligned_names(spark, d):
    w = F.split(F.lower(T.ascii_fold(T.squish(F.col("name")))), " ")
    n = clients(spark, d).filter("client_id is not null").select(F.col("client_id").alias("id1"), w[0].alias("f"), F.element_at(w, -1).alias("l")).distinct()
    pairs = S.aligned_join(n, n.withColumnRenamed("id1", "id2"), "id1", "id2", ["l", "f"], ["l", "f"], 1).filter("id1 < id2")
    return pairs.select("id1", "id2", F.col("distance1").alias("distance0"), F.col("distance0").alias("distance1"))


@register("q_faulty_csv", "select 'audit' as what, count(*) as rows, count(*) filter (client_id % 7 = 0 or client_id % 11 = 0) as bad from clients where client_id is not null union all select 'tolerant', count(*) filter (client_id % 7 > 0 and client_id % 11 > 0), 0 from clients where client_id is not null")
def faulty_csv(spark, d):
    """Clients as lines, where each seventh has no number and each eleventh a field too many."""
    folder = _folder(spark)
    number = F.when(F.col("client_id") % 7 == 0, "n/a").otherwise(F.coalesce(F.col("balance").cast("string"), F.lit("")))
    line = F.concat_ws(",", F.col("client_id").cast("string"), number, F.when(F.col("client_id") % 11 == 0, "more"))
    rows = clients(spark, d).filter("client_id is not null").select(line.alias("value"))
    rows.write.text(f"{folder}/b")
    rows.write.option("lineSep", "\n").text(f"{folder}/a")
    audit = files.parse_audit(spark, f"{folder}/a", "k long, v double", header=False).agg(F.sum("rows").alias("rows"), F.sum("bad").alias("bad"))
    kept = files.tolerant_csv(spark, f"{folder}/b", "k long, v double")
    return audit.select(F.lit("audit").alias("what"), "rows", "bad").unionAll(kept.agg(F.count("*")).select(F.lit("tolerant"), "count(1)", F.lit(0).cast("long")))


@register("q_ragged_names", "with l as (select brand, list(distinct lower(name)) as v from items where brand is not null and name is not null group by brand), e as (select v, unnest(v) as name1 from l), p as (select name1, unnest(v) as name2 from e) select distinct name1, name2 from p where name1 <> name2")
def ragged_names(spark, d):
    """A line for each brand with the names of its items, some fields empty."""
    folder = _folder(spark)
    names = table(spark, d, "items").filter("brand is not null and name is not null").groupBy("brand").agg(F.collect_set("name").alias("v"))
    names.select(F.concat_ws(", ", F.array_union("v", F.array(F.lit(""), F.lit("NA")))).alias("value")).write.text(folder)
    return files.equivalent_pairs(files.ragged_csv(spark, folder))
