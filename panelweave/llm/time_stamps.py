"""Mixed time stamps to UTC: guarded parsing by layout, votes on the order of slashed dates, offsets resolved once.

Every stamp is read in one pass by a cascade of ``try_to_timestamp``, each
guarded by its layout's pattern.  Of the result, kept as a narrow table, only
slashed dates that both orders allow meet the votes of their source, and only
wall times without an offset meet the offsets of their zone, which are resolved
once for each distinct (zone, minute).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .jobs import stored

#: What is stripped from both ends.
SPACE = " \t\n\x0b\x0c\r"

#: The layouts of dates, as pattern and as format.
MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
YEAR, MONTH, DAY = "20[0-9]{2}", "(?:0[1-9]|1[0-2])", "[0-3][0-9]"
PLAIN_DATES = {
    f"{YEAR}-{MONTH}-{DAY}": "yyyy-MM-dd",
    f"{YEAR}{MONTH}{DAY}": "yyyyMMdd",
    rf"{DAY}\.{MONTH}\.{YEAR}": "dd.MM.yyyy",
    f"{DAY} (?:{MONTHS}) {YEAR}": "dd MMM yyyy",
}
DAY_FIRST = {f"{DAY}/{MONTH}/{YEAR}": "dd/MM/yyyy"}
MONTH_FIRST = {f"{MONTH}/{DAY}/{YEAR}": "MM/dd/yyyy"}

#: date | time | half of the day | offset.
WHOLE = (
    rf"\A([^:]{{8,11}}?)(?:[T ]([0-2][0-9]:[0-5][0-9](?::[0-5][0-9])?)(?: ?([AP]M))?(?: ?(Z|[+-](?:0[0-9]|1[0-4]):?[0-5][0-9]))?)?\z"
)

#: An order wins by more than so many times the votes of the other.
MAJORITY = 3
#: A source's undecided stamps and a minute's wall times are dealt into so many parts.
PARTS = 32
MINUTE = 60_000_000
DAY_US = 86_400_000_000


def _read(parts: Column, layouts: dict[str, str]) -> Column:
    """Microseconds of the wall clock by the first layout that fits, else null; ``parts`` is the split stamp."""
    date, time, half = parts[0], parts[1], parts[2]
    clock = F.when(time == "", "00:00:00").when(F.length(time) == 5, F.concat(time, F.lit(":00"))).otherwise(time)
    by_layout = []
    for guard, form in layouts.items():
        fits = date.rlike(rf"\A{guard}\z")
        # The wall time is read as one of UTC, so that the session's zone has no part in it.
        by_layout.append(F.when(fits & (half == ""), F.try_to_timestamp(F.concat_ws(" ", date, clock, F.lit("+00:00")), F.lit(f"{form} HH:mm:ss XXX"))))
        by_layout.append(F.when(fits & (half != ""), F.try_to_timestamp(F.concat_ws(" ", date, clock, half, F.lit("+00:00")), F.lit(f"{form} hh:mm:ss a XXX"))))
    return F.unix_micros(F.coalesce(*by_layout))


def _offset(text: Column) -> Column:
    """Microseconds east of UTC; null without an offset."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    minutes = F.substring(digits, 1, 2).try_cast("int") * 60 + F.substring(digits, 3, 2).try_cast("int")
    return F.when(text == "Z", F.lit(0)).when(text != "", F.when(text.startswith("-"), -minutes).otherwise(minutes)).cast("long") * F.lit(MINUTE)


def read_stamps(stamps: DataFrame, id_col: str = "stamp_id", source_col: str = "source", zone_col: str = "zone", raw_col: str = "raw") -> DataFrame:
    """One narrow row for each stamp.

    ``utc_us`` is set for epochs and dates with an offset, ``wall_us`` for wall
    times of one reading, ``day_us`` and ``month_us`` for the two readings of a
    slashed date that differ; ``vote`` is ``day`` or ``month`` where only that
    order is possible.  ``shift_us`` is the offset of a stamp that has one.
    ``read`` is ``epoch``, ``plain``, ``open`` (two readings) or ``bad``.
    """
    raw = F.trim(F.col(raw_col), F.lit(SPACE))
    epoch = F.when(raw.rlike(r"\A[0-9]{10}\z"), raw.try_cast("long") * 1_000_000).when(raw.rlike(r"\A[0-9]{13}\z"), raw.try_cast("long") * 1_000)
    parts = F.when(raw.rlike(WHOLE), F.split(F.regexp_replace(raw, WHOLE, "$1|$2|$3|$4"), "[|]", -1))
    cut = stamps.select(
        F.col(id_col).alias("stamp_id"), F.col(source_col).cast("string").alias("source"), F.col(zone_col).cast("string").alias("zone"), epoch.alias("epoch"), parts.alias("parts")
    )
    p = F.when(F.size("parts") == 4, F.col("parts"))
    read = cut.select("stamp_id", "source", "zone", "epoch", _offset(p[3]).alias("shift_us"), _read(p, PLAIN_DATES).alias("one"), _read(p, DAY_FIRST).alias("day"), _read(p, MONTH_FIRST).alias("month"))
    differ = F.col("day") != F.col("month")
    single = F.coalesce("one", F.when(F.coalesce(differ, F.lit(False)), None).otherwise(F.coalesce("day", "month")))
    kind = F.when(F.col("epoch").isNotNull(), "epoch").when(single.isNotNull(), "plain").when(differ, "open").otherwise("bad")
    vote = F.when(F.col("day").isNull() & F.col("month").isNotNull(), "month").when(F.col("month").isNull() & F.col("day").isNotNull(), "day")
    opened = kind == "open"
    return read.select(
        "stamp_id", "source", "zone", kind.alias("read"), vote.alias("vote"), "shift_us", F.coalesce("epoch", single - F.col("shift_us")).alias("utc_us"),
        F.when(F.col("shift_us").isNull(), single).alias("wall_us"), F.when(opened, F.col("day")).alias("day_us"), F.when(opened, F.col("month")).alias("month_us"),
    )


def known_zone(zone: Column) -> Column:
    """Whether Spark knows the zone; false for null."""
    return F.try_to_timestamp(F.concat(F.lit("2000-01-01 00:00 "), zone), F.lit("yyyy-MM-dd HH:mm VV")).isNotNull()


def votes(read: DataFrame) -> DataFrame:
    """``source``, ``day_votes``, ``month_votes``; a stamp of an unknown zone is bad and has no vote."""
    zone = F.when(F.col("shift_us").isNull(), F.col("zone")).otherwise("UTC")
    cast = read.filter("vote is not null").groupBy("source", zone.alias("zone"), "vote").agg(F.count("*").alias("n")).filter(known_zone(F.col("zone")))
    per = [F.coalesce(F.sum(F.when(F.col("vote") == order, F.col("n"))), F.lit(0)).alias(f"{order}_votes") for order in ("day", "month")]
    return cast.groupBy("source").agg(*per)


def decide(opened: DataFrame, counted: DataFrame) -> DataFrame:
    """``opened`` with ``wall_us`` and ``rule`` (``votes`` or ``default``); a source's stamps are dealt into PARTS parts."""
    dealt = opened.withColumn("_part", F.pmod(F.xxhash64("stamp_id", "month_us", "shift_us"), F.lit(PARTS)))
    per = counted.select(F.col("source").alias("_source"), "day_votes", "month_votes", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))).alias("_of")).hint("merge")
    met = dealt.join(per, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_part") == F.col("_of")), "left")
    day, month = (F.coalesce(f"{order}_votes", F.lit(0)) for order in ("day", "month"))
    by_day, by_month = day > MAJORITY * month, month > MAJORITY * day
    return met.withColumn("wall_us", F.when(by_day, F.col("day_us")).otherwise(F.col("month_us"))).withColumn("rule", F.when(by_day | by_month, "votes").otherwise("default"))


def zone_offsets(minutes: DataFrame) -> DataFrame:
    """``zone``, ``minute`` with ``east_us``, the offset, and ``doubtful`` for minutes that the zone skips or repeats.

    Both take the offset before the change.  An unknown or null zone has a null offset.
    """
    known = minutes.withColumn("_known", known_zone(F.col("zone"))).withColumn("_wall", F.col("minute") * MINUTE)
    at = lambda us: F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(us), F.col("zone")))
    utc = F.when(F.col("_known"), F.unix_micros(F.to_utc_timestamp(F.timestamp_micros("_wall"), F.col("zone"))))
    # The second reading of a repeated minute has the offset that holds a day later.
    placed = known.withColumn("_utc", utc).withColumn("_later", F.when(F.col("_known"), F.col("_wall") - (at(F.col("_utc") + DAY_US) - F.col("_utc") - DAY_US)))
    skipped = at(F.col("_utc")) != F.col("_wall")
    repeated = (F.col("_later") > F.col("_utc")) & (at(F.col("_later")) == F.col("_wall"))
    doubtful = F.when(F.col("_known"), skipped | repeated).otherwise(False)
    return placed.withColumn("east_us", F.col("_wall") - F.col("_utc")).withColumn("doubtful", doubtful).drop("_known", "_wall", "_utc", "_later")


def normalise_stamps(stamps: DataFrame, id_col: str = "stamp_id", source_col: str = "source", zone_col: str = "zone", raw_col: str = "raw") -> DataFrame:
    """``stamp_id``, ``utc_us``, ``rule``, ``ambiguous``: one row for each row of ``stamps``.

    Nulls, empty, impossible and other stamps are ``bad`` with a null time, and so
    is a wall time whose zone is null or unknown; bad stamps have no vote.  Rows
    without a source are a source of their own.  Ids are not looked at: rows that
    repeat one, or have none, stay rows of their own and vote each.  Other columns
    of the input are ignored, whatever their names; an empty table gives none.
    """
    read = stored(read_stamps(stamps, id_col, source_col, zone_col, raw_col))
    decided = decide(read.filter("read = 'open'"), votes(read))
    shown = lambda df, rule: df.select("stamp_id", "zone", "shift_us", "utc_us", "wall_us", rule.alias("rule"))
    settled = shown(read.filter("utc_us is not null or read = 'bad'"), F.col("read"))
    one = shown(read.filter("read = 'plain' and utc_us is null"), F.col("read"))
    offset = decided.filter("shift_us is not null").withColumn("utc_us", F.col("wall_us") - F.col("shift_us"))
    settled = settled.unionByName(shown(offset, F.col("rule")))
    walls = one.unionByName(shown(decided.filter("shift_us is null"), F.col("rule")))
    walls = walls.withColumn("minute", F.floor(F.col("wall_us") / MINUTE)).withColumn("_part", F.pmod(F.xxhash64("stamp_id", "wall_us"), F.lit(PARTS)))
    # A minute that many stamps share is resolved once and meets them in parts: PARTS at most.
    parts = walls.groupBy("zone", "minute", "_part").agg(F.lit(1)).groupBy("zone", "minute").agg(F.collect_set("_part").alias("_parts"))
    offsets = zone_offsets(parts).withColumn("_part", F.explode("_parts")).drop("_parts")
    by = {c: f"_{c}_of" for c in ("zone", "minute", "_part")}
    met = walls.join(offsets.withColumnsRenamed(by).hint("merge"), [F.col(c) == F.col(k) for c, k in by.items()], "left")
    lost = F.col("east_us").isNull()
    placed = met.select(
        "stamp_id", (F.col("wall_us") - F.col("east_us")).alias("utc_us"), F.when(lost, "bad").otherwise(F.col("rule")).alias("rule"),
        (~lost & (F.col("rule").isin("votes", "default") | F.col("doubtful"))).alias("ambiguous"),
    )
    return placed.unionByName(settled.select("stamp_id", "utc_us", "rule", F.col("rule").isin("votes", "default").alias("ambiguous")))
