"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .best_fit_packing import pack_documents
from .filter_audit import audit
from .html_extract import extract_pages
from .jaccard_join import jaccard_classes
from .permutation_index import nearest
from .pii_feistel import pseudonymise
from .quality_classifier import score_quality
from .shard_schedule import shard_documents
from .source_mixing import duckdb_sql, mix_sources
from .substring_dedup import remove_repeats
from .time_stamps import normalise_stamps
from .tokenizer_fertility import quality_rules
from .toxicity_grammar import score_toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(_table(spark, sf_dir, "pages"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(_table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op5_tokenizer_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"))


def op6_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"))


def op8_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.withColumns({c: F.round(c, 6) for c in ("weight", "probability", "design_weight")})


def op10_pii_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(_table(spark, sf_dir, "documents"))


def op11_time_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalise_stamps(_table(spark, sf_dir, "stamps"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_shard_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(_table(spark, sf_dir, "documents"))


def queries() -> dict:
    found = (
        op1_html_extraction, op2_jaccard_join, op3_substring_dedup, op4_quality_classifier, op5_tokenizer_fertility,
        op6_permutation_index, op7_best_fit_packing, op8_toxicity_grammar, op9_source_mixing, op10_pii_feistel,
        op11_time_stamps, op12_filter_audit, op13_shard_schedule,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_substring_dedup": OP3_SQL, "op9_source_mixing": duckdb_sql(), "op11_time_stamps": OP11_SQL, "op12_filter_audit": OP12_SQL}


OP3_SQL = r"""
with docs as (select row_number() over () as r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\v\f\r]+'), lambda w: w <> '') as words from documents),
starts as (select r, doc_id, words, unnest(range(1, greatest(len(words) - 33, 1))) as i from docs),
wins as (select r, i, md5(array_to_string(words[i:i + 34], ' ')) as h from starts),
again as (select r, i from (select r, i, count(*) over (partition by h) as n from wins) where n > 1),
hit as (select r, list(distinct i + k) as gone from again, range(35) t(k) group by r)
select d.doc_id, len(words)::bigint as n_words, coalesce(len(gone), 0)::bigint as n_removed,
    sha256(array_to_string(case when gone is null then words else list_filter(words, lambda w, p: not list_contains(gone, p)) end, ' ')) as kept_sha256
from docs d left join hit using (r)
"""

OP11_SQL = r"""
with cut as (
    select stamp_id, source, zone, r, regexp_extract(r, '\A([^:]{8,11}?)(?:[T ]([0-9]{2}:[0-9]{2}(?::[0-9]{2})?)(?: ?([AP]M))?(?: ?(Z|[+-][0-9]{2}:?[0-9]{2}))?)?\z', ['d', 't', 'h', 'o']) as p
    from (select *, trim(raw, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as r from stamps)),
given as (
    select stamp_id, source, n.name as zone, regexp_full_match(r, '[0-9]{10}') as sec, regexp_full_match(r, '[0-9]{13}') as milli, r, p.d as d, p.t as t, p.h as half, p.o as o,
        try_cast(p.t[1:2] as bigint) as hh, try_cast(p.t[4:5] as bigint) as mi, case when length(p.t) = 8 then try_cast(p.t[7:8] as bigint) else 0 end as ss,
        try_cast(replace(p.o, ':', '')[2:3] as bigint) as oh, try_cast(replace(p.o, ':', '')[4:5] as bigint) as om
    from cut left join pg_timezone_names() n on n.name = zone),
clock as (
    select *, case when t = '' then 0 when mi > 59 or ss > 59 then null when half = '' then case when hh < 24 then hh * 3600 + mi * 60 + ss end
            when hh between 1 and 12 then (hh % 12 + case when half = 'PM' then 12 else 0 end) * 3600 + mi * 60 + ss end as secs,
        case when o = '' then null when o = 'Z' then 0 when oh < 15 and om < 60 then (oh * 60 + om) * case when o[1] = '-' then -1 else 1 end end as east,
        o <> '' and o <> 'Z' and (oh > 14 or om > 59) as bad_east,
        case when regexp_full_match(d, '20[0-9]{2}-[0-9]{2}-[0-9]{2}') then try_cast(d as date)
            when regexp_full_match(d, '20[0-9]{6}') then try_cast(d[1:4] || '-' || d[5:6] || '-' || d[7:8] as date)
            when regexp_full_match(d, '[0-9]{2}[.][0-9]{2}[.]20[0-9]{2}') then try_cast(d[7:10] || '-' || d[4:5] || '-' || d[1:2] as date)
            when regexp_full_match(d, '[0-9]{2} (Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) 20[0-9]{2}')
                then try_cast(d[8:11] || '-' || lpad(((strpos('JanFebMarAprMayJunJulAugSepOctNovDec', d[4:6]) + 2) // 3)::varchar, 2, '0') || '-' || d[1:2] as date) end as plain,
        case when regexp_full_match(d, '[0-9]{2}/[0-9]{2}/20[0-9]{2}') then try_cast(d[7:10] || '-' || d[4:5] || '-' || d[1:2] as date) end as dm,
        case when regexp_full_match(d, '[0-9]{2}/[0-9]{2}/20[0-9]{2}') then try_cast(d[7:10] || '-' || d[1:2] || '-' || d[4:5] as date) end as md
    from given),
valid as (
    select *, not (sec or milli) and secs is not null and not bad_east and coalesce(plain, dm, md) is not null and (east is not null or zone is not null) as ok from clock),
cast_votes as (
    select source, count(*) filter (md is null and dm is not null) as a, count(*) filter (dm is null and md is not null) as b from valid where ok group by source),
chosen as (
    select v.*, case when plain is not null then plain when dm is null or md is null or dm = md then coalesce(dm, md) when coalesce(a, 0) > 3 * coalesce(b, 0) then dm else md end as day,
        case when sec or milli then 'epoch' when not ok then 'bad' when plain is not null or dm is null or md is null or dm = md then 'plain'
            when coalesce(a, 0) > 3 * coalesce(b, 0) or coalesce(b, 0) > 3 * coalesce(a, 0) then 'votes' else 'default' end as rule
    from valid v left join cast_votes c on v.source is not distinct from c.source),
wall as (select *, epoch_us(day::timestamp) + secs * 1000000 as w from chosen),
tried as (
    select *, epoch_us(timezone(zone, make_timestamp(w))) as u from wall),
earlier as (
    select *, w - (epoch_us(timezone(zone, make_timestamptz(u - 86400000000))) - (u - 86400000000)) as v, epoch_us(timezone(zone, make_timestamptz(u))) as back from tried),
placed as (
    select *, epoch_us(timezone(zone, make_timestamptz(v))) = w and v <> u as twice, back <> w as never from earlier)
select stamp_id,
    case rule when 'bad' then null when 'epoch' then r::bigint * case when sec then 1000000 else 1000 end
        else case when east is not null then w - east * 60000000 when twice or never then v else u end end as utc_us,
    rule, coalesce(rule in ('votes', 'default') or (rule = 'plain' and east is null and (twice or never)), false) as ambiguous
from placed
"""

OP12_SQL = r"""
with docs as (select row_number() over () as r, doc_id, coalesce(text, '') as t, coalesce(source, '') as part from documents),
marks as (select doc_id, max(quality = 1) as good, max(toxic = 1) as toxic from labels group by doc_id),
firsts as (select t, min(doc_id) as least from docs group by t),
words as (select *, list_filter(string_split_regex(t, '[ \t\n\v\f\r]+'), lambda w: w <> '') as w from docs),
fails as (
    select part, coalesce(good, false) as good, coalesce(m.toxic, false) as toxic,
        [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * length(regexp_replace(d.t, '[^A-Z]', '', 'g')) > 5 * length(d.t), regexp_matches(d.t, '[#$%&*|]'), coalesce(least < d.doc_id, false)] as f
    from words d join firsts using (t) left join marks m using (doc_id)),
cells as (select part, good, toxic, f, count(*) as n from fails group by all),
letters as (select * from (values ('A', 1), ('B', 2), ('C', 3), ('D', 4), ('E', 5)) v(l, k)),
orders as (
    select a.l || b.l || c.l || d.l || e.l as filter_order, [a.k, b.k, c.k, d.k, e.k] as ks from letters a, letters b, letters c, letters d, letters e
    where len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
steps as (select filter_order, s::int as step, ks[s] as k, ks[1:s - 1] as before from orders, range(1, 6) t(s)),
met as (
    select part, filter_order, step, k, n, good, toxic, f[k] as hit, len(list_filter(before, lambda b: f[b])) > 0 as gone, len(list_filter(f, lambda x: x)) = 1 and f[k] as alone
    from cells, steps),
counted as (
    select part, filter_order, step, k, sum(n) filter (not gone and not hit) as kept, sum(n) filter (not gone and hit) as removed, sum(n) filter (gone and hit) as redundant,
        sum(n) filter (alone) as unique_fails, sum(n) filter (not gone and hit and good) as good_lost, sum(n) filter (not gone and hit and toxic) as toxic_lost
    from met group by all)
select part, filter_order, step, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed, coalesce(redundant, 0)::bigint as redundant, coalesce(unique_fails, 0)::bigint as unique_fails,
    coalesce(good_lost, 0)::bigint as good_lost, coalesce(toxic_lost, 0)::bigint as toxic_lost, (sum(coalesce(removed, 0)) over (partition by part, k))::bigint as shapley
from counted
"""
