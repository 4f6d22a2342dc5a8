"""Walsh-Hadamard audit of five filters: what each removes at every place of all 120 orders.

A row's failures are a mask of five bits.  For each part and label 32 signed
parity sums of the masks are aggregated; their inversion gives the counts of the
32 masks exactly, and everything about the orders follows from those.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .jobs import durable

#: The filters, in the order of their bits.
FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
#: White space between words.
SPACE = "[ \\t\\n\\x0B\\f\\r]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
REPEAT = 1 << FILTERS.index("E")


def text_mask(text: Column) -> Column:
    """Bits of the filters that a text fails by itself: A to D; null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(t, SPACE), "")
    n = F.size(words)
    fails = {
        "A": n < 50,
        "B": F.size(F.array_distinct(words)) * 100 < n * 65,
        "C": (F.length(t) - F.length(F.translate(t, CAPITALS, ""))) * 100 > F.length(t) * 5,
        "D": t.rlike("[#$%&*|]"),
    }
    return sum((F.when(hit, 1 << FILTERS.index(name)).otherwise(0) for name, hit in fails.items()), F.lit(0))


def document_masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``part``, ``good``, ``toxic``, ``mask`` and ``n``: rows of the same id, text and part are one row with its number.

    E: a smaller id has an identical text, told by its MD5 digest.  An id is
    compared with the smallest of its text in a join on (digest, id), where no
    key has more rows than there are parts, so no group of copies meets in a task.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.unhex(F.md5(F.coalesce(text_col, F.lit("")).cast("binary"))).alias("digest"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text_mask(F.col(text_col)).alias("mask"),
    )
    rows = durable(rows.groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n")))
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).filter("doc_id is not null").withColumn("first", F.lit(True))
    wanted = [F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(k) for c, k in (("quality", "good"), ("toxic", "toxic"))]
    marks = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(*wanted)
    met = rows.join(first, ["digest", "doc_id"], "left").join(marks, "doc_id", "left")
    repeats = F.col("first").isNull() & F.col("doc_id").isNotNull()
    mask = F.col("mask") + F.when(repeats, REPEAT).otherwise(0)
    return met.select("part", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"), mask.alias("mask"), "n")


def parity_sums(masks: DataFrame) -> DataFrame:
    """``part``, ``good``, ``toxic`` and ``w``: for each subset of the filters the rows with an even number of failures in it less those with an odd one."""
    sums = [F.expr(f"sum(if(bit_count(mask & {s}) % 2 = 0, n, -n)) as w{s}") for s in range(MASKS)]
    got = masks.groupBy("part", "good", "toxic").agg(*sums)
    return got.select("part", "good", "toxic", F.array(*[F.col(f"w{s}") for s in range(MASKS)]).alias("w"))


def mask_cells(sums: DataFrame) -> DataFrame:
    """``part``, ``good``, ``toxic`` and ``cells``: the inverted sums, rows by mask.  Exact, as 32 divides each."""
    cell = lambda m: F.aggregate(
        F.sequence(F.lit(0), F.lit(MASKS - 1)), F.lit(0).cast("long"),
        lambda total, s: total + F.when(F.bit_count(s.bitwiseAND(m)) % 2 == 0, F.element_at("w", s + 1)).otherwise(-F.element_at("w", s + 1)),
    )
    cells = F.transform(F.sequence(F.lit(0), F.lit(MASKS - 1)), lambda m: F.shiftright(cell(m), len(FILTERS)))
    return sums.select("part", "good", "toxic", cells.alias("cells"))


def _where(cells: str, holds) -> Column:
    """Sum of the cells whose mask ``holds``."""
    kept = F.transform(F.col(cells), lambda n, m: F.when(holds(m), n).otherwise(0))
    return F.aggregate(kept, F.lit(0).cast("long"), lambda a, b: a + b)


def _passing(cells: str) -> Column:
    """Rows that pass every filter of a set, by set."""
    return F.transform(F.sequence(F.lit(0), F.lit(MASKS - 1)), lambda s: _where(cells, lambda m: m.bitwiseAND(s) == 0))


def with_orders(per_part: DataFrame) -> DataFrame:
    """Each row for every step of every order: ``filter_order``, ``step``, ``bit`` of its filter, ``before``: bits of those before it."""
    orders = F.split(F.lit(",".join("".join(o) for o in permutations(FILTERS))), ",")
    steps = per_part.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    earlier = F.expr("left(filter_order, step - 1)")
    before = sum((F.when(earlier.contains(name), 1 << k).otherwise(0) for k, name in enumerate(FILTERS)), F.lit(0))
    return steps.withColumn("bit", F.expr(f"shiftleft(1, instr('{FILTERS}', substr(filter_order, step, 1)) - 1)")).withColumn("before", before)


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row for each part, order of the filters and step, zeros included.

    Null texts are empty and null parts the empty string.  A row without an id is
    no copy, makes none and has no label; rows that repeat an id with the same
    text are no copies of each other.  Of several labels of an id any 1 counts.
    Other columns are ignored, whatever their names; an empty table has no parts.
    """
    cells = mask_cells(parity_sums(document_masks(docs, labels, id_col, text_col, part_col)))
    # Four rows a part at most: sums of cells by label.
    by_label = {"all": "true", "good": "good", "toxic": "toxic"}
    sums = [F.expr(f"sum(if({hit}, cells[{m}], 0L)) as {name}{m}") for name, hit in by_label.items() for m in range(MASKS)]
    per = cells.groupBy("part").agg(*sums)
    per = per.select("part", *[F.array(*[F.col(f"{name}{m}") for m in range(MASKS)]).alias(name) for name in by_label])
    # The Shapley sum: of the orders, 120 / failures have a given one of a row's failing filters first.
    passed = [_passing(name).alias(f"{name}_pass") for name in by_label]
    orders = factorial(len(FILTERS))
    shares = F.transform(F.col("all"), lambda n, m: n * F.when(m == 0, 0).otherwise(F.floor(F.lit(orders) / F.bit_count(m))))
    per = per.select("part", "all", shares.alias("shares"), *passed)
    step = with_orders(per)
    after, bit = F.col("before") + F.col("bit"), F.col("bit")
    passing = lambda name, s: F.element_at(f"{name}_pass", s + 1)
    lost = lambda name: passing(name, F.col("before")) - passing(name, after)
    fails = passing("all", F.lit(0)) - passing("all", bit)
    return step.select(
        "part", "filter_order", "step", passing("all", after).alias("kept"), lost("all").alias("removed"), (fails - lost("all")).alias("redundant"),
        F.element_at("all", bit + 1).alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"),
        _where("shares", lambda m: m.bitwiseAND(bit) != 0).alias("shapley"),
    )
