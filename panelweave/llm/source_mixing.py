"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted in cells of source, language and topic.  The cells' token
weights are raked in turns to the three target marginals; a document is then
sampled with probability ``rate`` times its cell's weight, and keeps the ratio of
weight and probability as its design weight.  Sampling is decided by a hash of
the id, so it is the same in every run.

No probability may be over 1, so a weight is 1 over the rate at most.  That bound
is part of the raking: what it takes from a cell the next rounds give to others
of the same margins, and the selected rows meet the targets by themselves.  The
rate is lowered to ``SLACK`` over the greatest ratio of a margin's target and
stock of tokens, beyond which no sample could meet it.  Where a combination of
margins can't be met either, the last margin comes nearest.  Without ``bounded``
the weights are raked alone, a probability is 1 at most, and only the design
weights make up for the rest.

Targets may be given as a dictionary for each margin (shares of tokens; what is
not named shares the rest as it is); by default a margin's share is its token
share to the power of its temperature, which lifts what is rare.  The topic is a
column, or by default the kind of content that a text's surface shows.

Only DataFrame functions are used.  Cells are as many as there are combinations
of the three values; their weights are joined by broadcast if they are under
``MOST_BROADCAST``, and else by a shuffle of the narrow rows.

Edge cases: null values are a group of their own; null and empty texts have no
tokens, and their weight is that of their cell (1 if the cell has no tokens);
rows that repeat an id are decided alike; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .jobs import durable

MARGINS = ("source", "lang", "topic")
TEMPERATURES = {"source": 0.7, "lang": 0.8, "topic": 0.8}
ROUNDS, RATE, SLACK, MOST_BROADCAST = 12, 0.8, 0.9, 20_000


def token_count(text: Column) -> Column:
    """Words of anything but white space."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")).cast("long")


def content_topic(text: Column, tokens: Column) -> Column:
    """A topic by surface: the first of these that holds."""
    t = F.coalesce(text, F.lit(""))
    return (
        F.when(t.contains(" | "), "table").when(t.contains("!!"), "shout").when(t.contains("###"), "markup").when(t.contains("License"), "license")
        .when(t.contains("@"), "contact").when(t.rlike("[0-9]"), "figures").when(tokens >= 800, "long").when(tokens < 80, "short").otherwise("prose")
    )


def uniform(key: Column) -> Column:
    """A number in [0, 1) from the id."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def rake(cells: DataFrame, margins: tuple[str, ...], targets: dict[str, dict[str, float]], temperatures: dict[str, float], rounds: int, rate: float, bounded: bool) -> tuple[DataFrame, float]:
    """Cells with ``tokens`` get ``weight``, and the rate; windows sum only over cells, never over documents."""
    total = F.col("tokens")
    sums = {m: F.sum(total).over(Window.partitionBy(m)) for m in margins}
    c = cells
    for m in margins:
        c = c.withColumn(f"_t_{m}", sums[m].cast("double"))
    c = durable(c)
    if c.count() <= MOST_BROADCAST:
        c = c.coalesce(1)  # a few thousand cells are summed in place, without a shuffle for each margin
    # The numbers that make temperatures shares: one row of scalars.
    scale = c.agg(F.sum(total).cast("double"), *[F.sum(F.when(F.col(f"_t_{m}") > 0, total / F.col(f"_t_{m}") * F.pow(f"_t_{m}", F.lit(temperatures.get(m, 1.0))))) for m in margins]).first()
    everything = scale[0] or 0.0
    for m, z in zip(margins, scale[1:]):
        share = F.pow(f"_t_{m}", F.lit(temperatures.get(m, 1.0))) / F.lit(z or 1.0)
        if m in targets:
            named = targets[m]
            held = F.col(m).isin(list(named))
            rest = c.filter(~held | F.col(m).isNull()).agg(F.sum("tokens")).first()[0] or 0
            left = max(0.0, 1.0 - sum(named.values()))
            share = F.col(f"_t_{m}") * F.lit(left / rest if rest else 0.0)
            for value, s in named.items():
                share = F.when(F.col(m) == value, F.lit(float(s))).otherwise(share)
        c = c.withColumn(f"_s_{m}", share * F.lit(everything))
    if bounded:
        most = c.agg(F.max(F.greatest(*[F.when(F.col(f"_t_{m}") > 0, F.col(f"_s_{m}") / F.col(f"_t_{m}")).otherwise(0.0) for m in margins]))).first()[0]
        rate = min(rate, SLACK / most) if most else rate
    c = c.withColumn("weight", F.lit(1.0))
    for _ in range(rounds):
        for m in margins:
            mass = F.sum(total * F.col("weight")).over(Window.partitionBy(m))
            c = c.withColumn("weight", F.when(mass > 0, F.col("weight") * F.col(f"_s_{m}") / mass).otherwise(F.col("weight")))
        if bounded:
            c = c.withColumn("weight", F.least("weight", F.lit(1.0 / rate)))
    return c.select(*margins, "tokens", "weight"), rate


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_col: str | None = None,
    targets: dict[str, dict[str, float]] | None = None, temperatures: dict[str, float] | None = None, rounds: int = ROUNDS, rate: float = RATE, carry: bool = False, bounded: bool = True,
) -> DataFrame:
    """For each row: ``doc_id``, the three margins, ``n_tokens``, ``weight``, ``probability``, ``selected``, ``design_weight``.

    ``carry`` keeps all columns of ``docs`` instead, with the rest in a struct ``mix``.
    """
    text = F.col(text_col)
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")) if carry else docs.select(F.struct(F.col(id_col).alias(id_col)).alias("row"), F.col(source_col).alias("_s"), F.col(lang_col).alias("_l"), text.alias("_x"), *([F.col(topic_col).alias("_k")] if topic_col else []))
    pick = (lambda name, short: F.col("row")[name]) if carry else (lambda name, short: F.col(short))
    rows = named.select(
        "row", pick(source_col, "_s").cast("string").alias("source"), pick(lang_col, "_l").cast("string").alias("lang"), token_count(pick(text_col, "_x")).alias("n_tokens"),
        *([pick(topic_col, "_k").cast("string").alias("topic")] if topic_col else [pick(text_col, "_x").alias("_text")]),
    )
    if not topic_col:
        rows = rows.withColumn("topic", content_topic(F.col("_text"), F.col("n_tokens"))).drop("_text")
    cells = rows.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens"))
    raked, rate = rake(cells, MARGINS, targets or {}, TEMPERATURES | (temperatures or {}), rounds, rate, bounded)
    weights = durable(raked)
    right = weights.select(*[F.col(m).alias(f"_{m}") for m in MARGINS], "weight")
    if weights.count() <= MOST_BROADCAST:
        right = F.broadcast(right)
    match = [F.col(m).eqNullSafe(F.col(f"_{m}")) for m in MARGINS]
    joined = rows.join(right, match[0] & match[1] & match[2], "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    joined = joined.withColumn("probability", F.least(F.lit(1.0), F.lit(rate) * F.col("weight")))
    joined = joined.withColumn("selected", uniform(F.col("row")[id_col]) < F.col("probability"))
    joined = joined.withColumn("design_weight", F.when(F.col("probability") > 0, F.col("weight") / F.col("probability")))
    fields = [*MARGINS, "n_tokens", "weight", "probability", "selected", "design_weight"]
    if carry:
        return joined.select("row.*", F.struct(*fields).alias("mix"))
    return joined.select(F.col("row")[id_col].cast("long").alias("doc_id"), *fields)


def duckdb_sql(rounds: int = ROUNDS, rate: float = RATE, temperatures: dict[str, float] | None = None) -> str:
    """The same over a view ``documents`` in DuckDB's SQL."""
    power = TEMPERATURES | (temperatures or {})
    sums = ", ".join(f"sum(tokens) over (partition by {m})::double as t_{m}" for m in MARGINS)
    scale = ", ".join(f"sum(case when t_{m} > 0 then tokens / t_{m} * pow(t_{m}, {power[m]}) end) as z_{m}" for m in MARGINS)
    share = ", ".join(f"pow(t_{m}, {power[m]}) / z_{m} * everything as s_{m}" for m in MARGINS)
    steps, last = [], "w0"
    for k, m in enumerate(MARGINS * rounds, 1):
        mass = f"sum(tokens * weight) over (partition by {m})"
        raked = f"case when {mass} > 0 then weight * s_{m} / {mass} else weight end"
        if m == MARGINS[-1]:
            raked = f"least({raked}, 1.0 / (select rate from rate))"
        steps.append(f"w{k} as materialized (select source, lang, topic, tokens, {', '.join(f's_{x}' for x in MARGINS)}, {raked} as weight from {last})")
        last = f"w{k}"
    return f"""with words as (select doc_id, lang, source, coalesce(text, '') as x, len(list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\v\\f\\r]+'), lambda w: w <> '')) as n_tokens from documents),
        r as (select doc_id, lang, source, n_tokens, case when contains(x, ' | ') then 'table' when contains(x, '!!') then 'shout' when contains(x, '###') then 'markup' when contains(x, 'License') then 'license'
            when contains(x, '@') then 'contact' when regexp_matches(x, '[0-9]') then 'figures' when n_tokens >= 800 then 'long' when n_tokens < 80 then 'short' else 'prose' end as topic from words),
        cells as (select source, lang, topic, sum(n_tokens)::bigint as tokens from r group by all),
        c as (select *, {sums} from cells), z as (select sum(tokens)::double as everything, {scale} from c),
        w0 as (select source, lang, topic, tokens, {", ".join(f"t_{m}" for m in MARGINS)}, {share}, 1.0::double as weight from c, z),
        rate as (select least({rate}::double, {SLACK} / max(greatest({", ".join(f"case when t_{m} > 0 then s_{m} / t_{m} else 0.0 end" for m in MARGINS)}))) as rate from w0), {", ".join(steps)},
        j as (select r.doc_id, r.source, r.lang, r.topic, r.n_tokens, coalesce(w.weight, 1.0) as weight, least(1.0, rate.rate * coalesce(w.weight, 1.0)) as probability
            from rate cross join r left join {last} w on r.source is not distinct from w.source and r.lang is not distinct from w.lang and r.topic is not distinct from w.topic)
        select doc_id, source, lang, topic, n_tokens::bigint as n_tokens, round(weight, 6) as weight, round(probability, 6) as probability,
            ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 8))::bigint / 4294967296.0 < probability as selected, round(weight / probability, 6) as design_weight from j"""
