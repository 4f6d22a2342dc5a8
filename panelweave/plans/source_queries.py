"""Sources and sinks.  Files go to the shared folder and are read again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators.graphs import shared_folder
from ..sources import files
from .registry import register, table


def _folder(spark) -> str:
    return f"{shared_folder(spark).rstrip('/')}/files-{uuid.uuid4().hex}"


@register("q_yearly_csv", "select n_nationkey::varchar as n_nationkey, n_name, case when n_regionkey > 2 then n_regionkey::varchar end as n_regionkey, 2000 + n_regionkey as year from nation where n_regionkey <> 1")
def yearly_csv(spark, d):
    """One file a region as its year; the early years lack a column, 2001 has no file."""
    folder, n = _folder(spark), table(spark, d, "nation")
    for r in (0, 2, 3, 4):
        part = n.filter(F.col("n_regionkey") == r)
        files.write_csv(part if r > 2 else part.drop("n_regionkey"), f"{folder}/x{2000 + r}.csv", 1)
    return files.yearly_csv(spark, folder, "x", range(1999, 2006)).select("n_nationkey", "n_name", "n_regionkey", "year")


@register("q_csv_round_trip", "select doc_id, text, lang from documents")
def csv_round_trip(spark, d):
    path, t = _folder(spark), table(spark, d, "documents").select("doc_id", "text", "lang")
    files.write_csv(t, path)
    return files.read_csv(spark, path, "doc_id long, text string, lang string")


@register("q_json_round_trip", "select event_id, props, case when user_id % 3 > 0 then event_type end as kind from events")
def json_round_trip(spark, d):
    path = _folder(spark)
    files.write_json(table(spark, d, "events").select("event_id", "props", F.when(F.col("user_id") % 3 > 0, F.col("event_type")).alias("kind")), path)
    return files.read_json(spark, path, "event_id long, props string, kind string")


@register("q_dta_round_trip", "select s_suppkey::bigint as s_suppkey, s_name, case when s_suppkey % 4 > 0 then round(s_acctbal, 2) end as s_acctbal from supplier")
def dta_round_trip(spark, d):
    import os
    import tempfile

    path = os.path.join(tempfile.mkdtemp(), "s.dta")  # exchange on the driver; the rows are in the frame once it is read
    files.write_dta(table(spark, d, "supplier").select("s_suppkey", "s_name", F.when(F.col("s_suppkey") % 4 > 0, F.col("s_acctbal")).alias("s_acctbal")), path)
    return files.read_dta(spark, path).select(F.col("s_suppkey").cast("long").alias("s_suppkey"), "s_name", F.round("s_acctbal", 2).alias("s_acctbal"))


@register("q_cached_lookup", "select case when s_nationkey is null then 'ask' else 'known' end as part, count(*) as n from (select distinct c_nationkey, c_mktsegment from customer) left join (select distinct s_nationkey from supplier where s_suppkey % 2 = 0) on c_nationkey = s_nationkey group by 1")
def cached_lookup(spark, d):
    cache = table(spark, d, "supplier").filter("s_suppkey % 2 = 0").select(F.col("s_nationkey").alias("c_nationkey")).distinct().withColumn("answer", F.lit(1))
    known, ask = files.cached_lookup(table(spark, d, "customer").select("c_nationkey", "c_mktsegment").distinct(), cache, ["c_nationkey"])
    per = table(spark, d, "customer").select("c_nationkey", "c_mktsegment").distinct()
    count = lambda k, name: per.join(k.select("c_nationkey"), "c_nationkey", "left_semi").select(F.lit(name).alias("part"))
    return count(known, "known").unionAll(count(ask, "ask")).groupBy("part").agg(F.count("*").alias("n"))


@register("q_staged_download", "select n_nationkey, n_name from nation")
def staged_download(spark, d):
    folder = _folder(spark)
    files.write_csv(table(spark, d, "nation").select("n_nationkey", "n_name"), f"{folder}/areas.csv", 1)
    return files.staged(spark, "https://example.org/files/areas.csv?x=1", folder, "n_nationkey int, n_name string")


@register("q_polygon_files", "select n_nationkey as id, 2005 as year, 4 as corners, (n_nationkey * 1.5)::double as x from nation where n_regionkey > 0")
def polygon_files(spark, d):
    folder, x = _folder(spark), F.col("n_nationkey") * 1.5
    text = F.when(F.col("n_regionkey") > 0, F.format_string("POLYGON ((%.1f 0, %.1f 2.5, 7 -1e1, %.1f 0))", x, x + 1, x)).otherwise("POINT (1 2)")
    table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), text.alias("wkt")).write.parquet(f"{folder}/2007.parquet")
    p = files.polygons_of_year(spark, folder, 2005, 2007).withColumn("year", F.lit(2005)) if files.existing(spark, f"{folder}/2007.parquet") else None
    return p.select("id", "year", F.size("ring").alias("corners"), F.element_at("ring", 1).x.alias("x"))


@register("q_page_details", r"""select page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', ' ', 'gs'), '[\s\x{A0}]+', ' ', 'g')) as heading, regexp_extract(url, '^[a-z]+://([^./]+)', 1) as topic, nullif(regexp_extract(url, '^[a-z]+://[^/]+/([^/?]+)', 1), '') as region, coalesce(try_cast(regexp_extract(url, '[?&]page=([0-9]+)', 1) as int), 1) as page,
length(trim(regexp_replace(regexp_replace(regexp_extract(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?is)<article[^>]*>(.*?)</article>', 1), '<[^>]*>', ' ', 'gs'), '[\s\x{A0}]+', ' ', 'g')))::int as body_chars from pages""")
def page_details(spark, d):
    return files.page_details(table(spark, d, "pages")).select("page_id", "heading", "topic", "region", "page", F.length("body").alias("body_chars"))


@register("q_page_fields", r"""select page_id, nullif(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '') as title, len(regexp_extract_all(html, '(?i)<a[ >]'))::int as n_links from pages""")
def page_fields(spark, d):
    return files.page_fields(table(spark, d, "pages")).select("page_id", "title", "n_links")


@register("q_plot_frame", "select l_returnflag as series, l_linenumber::double as x, round(avg(l_quantity), 4) as y, round(avg(l_quantity) - 1.96 * stddev_samp(l_quantity) / sqrt(count(*)), 4) as low, round(avg(l_quantity) + 1.96 * stddev_samp(l_quantity) / sqrt(count(*)), 4) as high from lineitem group by 1, l_linenumber")
def plot_frame(spark, d):
    s = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(F.avg("l_quantity").alias("m"), (F.stddev_samp("l_quantity") / F.sqrt(F.count("*"))).alias("e"))
    return files.plot_frame(s, "l_linenumber", "m", "l_returnflag", "e").withColumns({c: F.round(c, 4) for c in ("y", "low", "high")})


@register("q_sheets", "select 'region ' || n_regionkey as sheet, count(*) as n, (select max(k) from (select count(*) as k from nation group by n_regionkey)) as height from nation group by n_regionkey")
def sheets(spark, d):
    """Written as one folder a sheet and read again."""
    n = table(spark, d, "nation").select(F.concat(F.lit("region/"), F.col("n_regionkey").cast("string")).alias("region"), "n_name", "n_nationkey")
    folder = _folder(spark)
    files.write_sheets(files.sheet_rows(n, "region"), folder)
    per = spark.read.csv(folder, header=True).groupBy("sheet").agg(F.count("n_nationkey").alias("n"), F.count("*").alias("height"))
    return per.select("sheet", "n", "height")


@register("q_fuzzy_left_join", """with p as (select p_partkey as k, p_brand as b, p_size as z, split_part(p_name, ' ', 1) as f, split_part(p_name, ' ', 2) as l from part) select a.k as id, b.k as other, case when b.k is not null then (levenshtein(a.f, b.f) + levenshtein(a.l, b.l))::int end as distance
from (select * from p where k % 2 = 0) a left join (select * from p where k % 2 = 1) b on a.b = b.b and a.z = b.z and levenshtein(a.f, b.f) <= 3 and levenshtein(a.l, b.l) <= 4""")
def fuzzy_left_join(spark, d):
    name = F.split("p_name", " ")
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"), "p_brand", "p_size", name[0].alias("f"), name[1].alias("l"))
    a, b = p.filter("k % 2 = 0").withColumnRenamed("k", "id"), p.filter("k % 2 = 1").withColumnRenamed("k", "other")
    return J.fuzzy_left_join(a, b, ["p_brand", "p_size"], "id", [("f", "f", 3), ("l", "l", 4)], "other").select("id", "other", "distance")


@register("q_similarity_left_join", "with n as (select distinct p_name as s from part), b as (select distinct p_name || 's' as t from part where p_partkey % 3 = 0) select s, t, round(jaro_winkler_similarity(s, t), 6) as similarity from n left join b on left(s, 2) = left(t, 2) and jaro_winkler_similarity(s, t) >= 0.95")
def similarity_left_join(spark, d):
    p = table(spark, d, "part")
    b = p.filter("p_partkey % 3 = 0").select(F.concat("p_name", F.lit("s")).alias("t")).distinct()
    out = J.similarity_left_join(p.select(F.col("p_name").alias("s")).distinct(), b, "s", "t", 0.05, [(F.substring("_a", 1, 2), F.substring("_b", 1, 2))])
    return out.select("s", "t", F.round("similarity", 6).alias("similarity"))
