"""Identity cascades: attributes of persons, ids with several names, names with several ids, organisations, leaders."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import jaro_winkler, normalized_levenshtein
from .joins import SALTS, spread_join
from .verbs import mode_per_group


def attribute_by_title(df: DataFrame, id_col: str, title: str, of: dict[str, str]) -> DataFrame:
    """``value`` from the most frequent title of an id (ties to the smallest): the first of ``of`` (title to value) that it is, without regard to case, dots and spaces; else null."""
    plain = F.regexp_replace(F.lower("mode"), r"[.\s]", "")
    found = F.coalesce(*[F.when(plain == k.lower().rstrip("."), v) for k, v in of.items()])
    return mode_per_group(df, [id_col], title).select(id_col, found.alias("value"))


def attribute_cascade(df: DataFrame, id_col: str, name: str, value: str, dictionary: DataFrame, counts: DataFrame, ratio: float = 6.0) -> DataFrame:
    """One row for each id: ``value`` and ``rule``, the first of these that gives one.

    ``self``: all non-null values of the id agree.  ``dictionary`` (name, value):
    all parts of the name that it lists (split at spaces and hyphens) have one
    value.  ``yearly``: every year's counts of the name (name, value, year, n) have
    one value only.  ``ratio``: the name's most frequent value has ``ratio`` times
    the count of all others.  The smallest name stands for an id; nulls count nowhere.
    """
    own = df.groupBy(id_col).agg(F.min(F.lower(name)).alias("_name"), F.min(value).alias("_a"), F.max(value).alias("_b"))
    out = own.select(id_col, "_name", F.when(F.col("_a") == F.col("_b"), F.col("_a")).alias("_self"))
    d = dictionary.select(F.lower("name").alias("_part"), F.col("value").alias("_v")).filter("_v is not null").distinct()
    parts = out.select("_name").filter("_name is not null").distinct().withColumn("_part", F.explode(F.split("_name", r"[\s-]+")))
    by_part = parts.join(d, "_part").groupBy("_name").agg(F.min("_v").alias("_a"), F.max("_v").alias("_b")).select("_name", F.when(F.col("_a") == F.col("_b"), F.col("_a")).alias("_dict"))
    c = counts.filter("n > 0 and value is not null").groupBy(F.lower("name").alias("_name"), "value").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("_name")
    top = c.withColumns({"_all": F.sum("n").over(w), "_r": F.row_number().over(w.orderBy(F.desc("n"), "value"))}).filter("_r = 1")
    by_count = top.select("_name", F.when(F.col("n") == F.col("_all"), F.col("value")).alias("_year"), F.when(F.col("n") >= ratio * (F.col("_all") - F.col("n")), F.col("value")).alias("_ratio"))
    out = out.join(by_part, "_name", "left").join(by_count, "_name", "left")
    names = {"self": "_self", "dictionary": "_dict", "yearly": "_year", "ratio": "_ratio"}
    rule = reduce(lambda a, kv: a.when(F.col(kv[1]).isNotNull(), kv[0]), names.items(), F.when(F.lit(False), ""))
    return out.select(id_col, F.coalesce(*names.values()).alias("value"), rule.alias("rule"))


def swapped_names(df: DataFrame, id_col: str, first: str, last: str) -> DataFrame:
    """Ids that have a name and its reverse: ``wrong_first``, ``wrong_last`` is the rarer order (ties: the greater one)."""
    n = df.filter(F.col(first).isNotNull() & F.col(last).isNotNull() & (F.col(first) != F.col(last))).groupBy(id_col, first, last).agg(F.count("*").alias("n"))
    other = n.select(F.col(id_col).alias("_id"), F.col(first).alias("_f"), F.col(last).alias("_l"), F.col("n").alias("_n"))
    both = n.join(other, (n[id_col] == F.col("_id")) & (n[first] == F.col("_l")) & (n[last] == F.col("_f")))
    wrong = (F.col("n") < F.col("_n")) | ((F.col("n") == F.col("_n")) & (F.col(first) > F.col("_f")))
    return both.filter(wrong).select(id_col, F.col(first).alias("wrong_first"), F.col(last).alias("wrong_last"))


def split_giant(members: DataFrame, node: str, component: str, groups: DataFrame | None = None) -> DataFrame:
    """Take the largest component (ties: the smallest number) apart: ``part`` is a node's group in ``groups`` (node, part), else its first letter; other components stay whole."""
    n = members.groupBy(component).agg(F.count("*").alias("_n"))
    giant = F.broadcast(n.orderBy(F.desc("_n"), component).limit(1).select(F.col(component).alias("_g")))  # one row
    out = members.join(giant, F.col(component) == F.col("_g"), "left")
    if groups is not None:
        out = out.join(groups.select(F.col("node").alias(node), F.col("part").alias("_p")), node, "left")
    else:
        out = out.withColumn("_p", F.lit(None).cast("string"))
    letter = F.upper(F.substring(F.col(node).cast("string"), 1, 1))
    part = F.when(F.col("_g").isNull(), F.concat(F.lit("c:"), F.col(component).cast("string"))).otherwise(F.coalesce(F.concat(F.lit("g:"), "_p"), F.concat(F.lit("l:"), letter)))
    return out.withColumn("part", part).drop("_g", "_p")


def code_edges(codes: DataFrame, code: str, n: str, similar: DataFrame, most: int = 2, longer: int = 6, other: int = 3, least: float = 0.9, rare: int = 25) -> DataFrame:
    """Edges (a, b), a < b, between phonetic codes: within ``most`` edits if one is longer than ``longer`` and the other than ``other``,
    or named by ``similar`` (a, b, similarity) at ``least`` or more if one of them has ``rare`` ids at most.

    Two codes within ``most`` edits share one of ``most + 1`` pieces of the longer
    one at nearly its place (pigeonhole), which is the blocking key; nothing is lost.
    """
    c = codes.select(F.col(code).alias("c")).filter("c is not null").distinct()
    pieces = most + 1

    def piece(s: Column, k: int) -> tuple[Column, Column]:
        n_ = F.length(s)
        begin = F.floor(n_ * k / pieces).cast("int")
        return begin, F.substring(s, begin + 1, F.floor(n_ * (k + 1) / pieces).cast("int") - begin)

    rows = F.array(*[F.struct(F.lit(k).alias("k"), piece(F.col("c"), k)[0].alias("at"), piece(F.col("c"), k)[1].alias("s")) for k in range(pieces)])
    long = c.filter(F.length("c") > longer).select(F.col("c").alias("x"), F.explode(rows).alias("p")).select("x", "p.*", F.length("x").alias("nx"))
    # The other code's substrings near each piece's place, for every length a longer code may have.
    lengths = [r[0] for r in long.select("nx").distinct().collect()]  # lengths of codes, a few
    if lengths:
        spots = [(n_, k, n_ * k // pieces, n_ * (k + 1) // pieces - n_ * k // pieces) for n_ in sorted(lengths) for k in range(pieces)]
        near = F.array(*[F.struct(F.lit(n_).alias("nx"), F.lit(k).alias("k"), F.substring(F.col("c"), F.lit(b + d + 1), F.lit(w)).alias("s")) for n_, k, b, w in spots for d in range(-most, most + 1) if b + d >= 0])
        short = c.filter(F.length("c") > other).select(F.col("c").alias("y"), F.explode(near).alias("p")).select("y", "p.*").filter(F.abs(F.length("y") - F.col("nx")) <= most)
        edited = long.join(short, ["nx", "k", "s"]).filter("x <> y").select("x", "y").distinct().filter(F.levenshtein("x", "y", most) >= 0)
        edges = edited.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    else:
        edges = c.select(F.col("c").alias("a"), F.col("c").alias("b")).limit(0)
    freq = codes.select(F.col(code).alias("_c"), F.col(n).alias("_n")).groupBy("_c").agg(F.max("_n").alias("_n"))
    s = similar.filter(F.col("similarity") >= least).select("a", "b").filter("a <> b")
    s = s.join(freq.select(F.col("_c").alias("a"), F.col("_n").alias("_na")), "a").join(freq.select(F.col("_c").alias("b"), F.col("_n").alias("_nb")), "b").filter(f"_na <= {rare} or _nb <= {rare}")
    return edges.unionByName(s.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()


def block_numbers(df: DataFrame, kind: str, number: str, first: str) -> DataFrame:
    """``block``: the number for rows of kind ``first``, for others shifted past its greatest (max + 1); null kinds count as others."""
    top = F.broadcast(df.agg(F.coalesce(F.max(F.when(F.col(kind) == first, F.col(number))) + 1, F.lit(0)).alias("_top")))  # one row
    own = F.coalesce(F.col(kind) == first, F.lit(False))
    return df.crossJoin(top).withColumn("block", F.when(own, F.col(number)).otherwise(F.col(number) + F.col("_top"))).drop("_top")


def name_verdicts(df: DataFrame, id_col: str, first: str, last: str, phone: str, nicknames: DataFrame, most: float = 0.3) -> DataFrame:
    """For ids with two different names, each pair of them and the first rule that explains the difference, or ``different``.

    Rules in order: ``phone`` (a shared phone), ``marriage`` (equal first names),
    ``swap``, ``substring`` (one first and one last name hold the other's),
    ``initials`` (equal last names, one first name is the other's initial),
    ``nickname`` (equal last names, first names in ``nicknames`` (name1, name2)),
    ``typo`` (both normalised distances at ``most`` or less).
    """
    n = df.filter(F.col(first).isNotNull() & F.col(last).isNotNull()).groupBy(id_col, F.lower(first).alias("f"), F.lower(last).alias("l")).agg(F.collect_set(phone).alias("p"))
    a, b = (n.select(id_col, *[F.col(c).alias(f"{c}{k}") for c in ("f", "l", "p")]) for k in (1, 2))
    pairs = a.join(b, id_col).filter("f1 < f2 or (f1 = f2 and l1 < l2)")
    known = nicknames.select(F.lower("name1").alias("x"), F.lower("name2").alias("y"))
    known = known.union(known.select("y", "x")).distinct().withColumn("_nick", F.lit(True))
    pairs = pairs.join(known, (F.col("f1") == F.col("x")) & (F.col("f2") == F.col("y")), "left").drop("x", "y")
    holds = lambda x, y: F.col(x).contains(F.col(y)) | F.col(y).contains(F.col(x))
    initial = lambda x, y: (F.length(x) == 1) & F.col(y).startswith(F.col(x))
    rule = (
        F.when(F.size(F.array_intersect("p1", "p2")) > 0, "phone").when(F.col("f1") == F.col("f2"), "marriage")
        .when((F.col("f1") == F.col("l2")) & (F.col("l1") == F.col("f2")), "swap").when(holds("f1", "f2") & holds("l1", "l2"), "substring")
        .when((F.col("l1") == F.col("l2")) & (initial("f1", "f2") | initial("f2", "f1")), "initials").when((F.col("l1") == F.col("l2")) & F.col("_nick"), "nickname")
        .when((normalized_levenshtein(F.col("f1"), F.col("f2")) <= most) & (normalized_levenshtein(F.col("l1"), F.col("l2")) <= most), "typo").otherwise("different")
    )
    return pairs.select(id_col, "f1", "l1", "f2", "l2", rule.alias("rule"))


def reassign_ids(df: DataFrame, id_col: str, time: str, keys: Sequence[str]) -> DataFrame:
    """``new_id``: among the ids that share an attribute of ``keys`` (name aside) with a row's id the one first seen earliest, ties to the smaller id.

    Attributes are one equi join over (attribute, value); null values link nothing.
    """
    kv = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(k).cast("string").alias("v")) for k in keys]))
    long = df.select(id_col, time, kv.alias("kv")).select(id_col, time, "kv.*").filter("v is not null")
    seen = df.groupBy(id_col).agg(F.min(time).alias("_t"))
    of_value = long.select(id_col, "k", "v").distinct().join(seen, id_col).groupBy("k", "v").agg(F.min(F.struct("_t", F.col(id_col).alias("_id"))).alias("_first"))
    best = long.select(id_col, "k", "v").distinct().join(of_value, ["k", "v"]).groupBy(id_col).agg(F.min("_first").alias("_first"))
    return df.join(best.select(id_col, F.col("_first._id").alias("new_id")), id_col, "left").withColumn("new_id", F.coalesce("new_id", id_col))


def shared_name_ids(df: DataFrame, id_col: str, name: str, state: str, rare_share: float = 0.25) -> DataFrame:
    """Names with several ids: ``n_ids``, ``rare`` (its number of rows is at most the ``rare_share`` quantile of all such names') and ``verdict``.

    ``merge`` if a rare name's ids share a state, ``split`` if they share none and
    the name isn't rare, else ``review``.
    """
    per = df.filter(F.col(name).isNotNull()).groupBy(name).agg(F.count_distinct(id_col).alias("n_ids"), F.count("*").alias("n_rows")).filter("n_ids > 1")
    cut = F.broadcast(per.agg(F.expr(f"percentile(n_rows, {rare_share})").alias("_cut")))  # one row
    once = df.filter(F.col(state).isNotNull()).select(name, id_col, state).distinct()
    shared = once.groupBy(name, state).agg(F.count("*").alias("_k")).groupBy(name).agg((F.max("_k") > 1).alias("_shared"))
    out = per.join(shared, name, "left").crossJoin(cut).withColumn("rare", F.col("n_rows") <= F.col("_cut"))
    s = F.coalesce("_shared", F.lit(False))
    return out.select(name, "n_ids", "n_rows", "rare", F.when(F.col("rare") & s, "merge").when(~F.col("rare") & ~s, "split").otherwise("review").alias("verdict"))


def provenance(df: DataFrame, id_col: str, new_id: str, name: str) -> DataFrame:
    """Flags of each row: ``modified`` (another id than before), ``merged`` (its new id has several old ones), ``many_names`` (of the new id), ``split_name`` (its name has several new ids)."""
    per_id = df.groupBy(new_id).agg((F.count_distinct(id_col) > 1).alias("merged"), (F.count_distinct(name) > 1).alias("many_names"))
    per_name = df.filter(F.col(name).isNotNull()).groupBy(name).agg((F.count_distinct(new_id) > 1).alias("split_name"))
    out = df.withColumn("modified", ~F.col(id_col).eqNullSafe(F.col(new_id))).join(per_id, new_id, "left").join(per_name, name, "left")
    return out.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("merged", "many_names", "split_name")})


def final_blocks(df: DataFrame, block: str, size: str, most: int, exceptions: DataFrame, id_col: str) -> DataFrame:
    """``label``: an exception's (id, label) before the rule, which is SAME for blocks of ``most`` members at most, else UNDECIDED."""
    rule = F.when(F.col(size) <= most, "SAME").otherwise("UNDECIDED")
    e = exceptions.groupBy("id").agg(F.min("label").alias("_l"))
    return df.join(e, F.col(id_col) == F.col("id"), "left").withColumn("label", F.coalesce("_l", rule)).drop("_l", "id")


def part_names(df: DataFrame, id_col: str, name: str) -> DataFrame:
    """Pairs of ids id1 < id2, one of whose hyphenated names has the other's whole name as a part, and that part.

    No pair is made twice, so none is shuffled: where both ids have the part and
    the whole name, the smaller id's hyphenated name stands for both.
    """
    n = df.select(F.col(id_col).alias("i"), F.lower(name).alias("n")).filter("n is not null").distinct()
    parts = n.filter(F.col("n").contains("-")).select("i", F.explode(F.array_distinct(F.split("n", "-"))).alias("n")).filter("n <> ''").distinct()
    plain = n.filter(~F.col("n").contains("-"))
    ends = parts.withColumn("_h", F.lit(True)).unionByName(plain.withColumn("_h", F.lit(False))).groupBy("i", "n").agg(F.bool_or("_h").alias("_h"), F.bool_or(~F.col("_h")).alias("_w"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    h = ends.filter("_h").select(F.col("i").alias("id_h"), "n", F.col("_w").alias("_both"), salts.alias("_salt"))
    w = ends.filter("_w").select("i", "n", F.col("_h").alias("_too"), F.pmod(F.xxhash64("i"), F.lit(SALTS)).cast("int").alias("_salt"))
    hit = spread_join(h, w, ["n", "_salt"]).filter("id_h < i or (id_h > i and not (_both and _too))")
    return hit.select(F.least("id_h", "i").alias("id1"), F.greatest("id_h", "i").alias("id2"), F.col("n").alias("part"))


def two_column_join(left: DataFrame, right: DataFrame, left_id: str, right_id: str, a: Sequence[str], b: Sequence[str], most: int = 2) -> DataFrame:
    """Pairs whose two columns are each within ``most`` edits (null: no pair).

    Names within ``most`` edits of each other agree in one of ``most + 1`` pieces
    up to a shift; the pieces of the first column are the key, so no pair is lost
    and none is compared that shares no piece.
    """
    pieces = most + 1
    spots = F.filter(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(pieces)), lambda k: F.array(k - 1))), lambda k: k >= 0)

    def own(c: Column) -> Column:
        n = F.length(c)
        begin = lambda k: F.floor(n * k / pieces).cast("int")
        return F.transform(spots, lambda k: F.struct(n.alias("n"), k.alias("k"), F.substring(c, begin(k) + 1, begin(k + 1) - begin(k)).alias("s")))

    def near(c: Column) -> Column:
        lengths = F.sequence(F.greatest(F.lit(0), F.length(c) - most), F.length(c) + most)
        shifts = F.sequence(F.lit(-most), F.lit(most))
        begin = lambda n, k: F.floor(n * k / pieces).cast("int")
        one = lambda n, k, d: F.struct(n.alias("n"), k.alias("k"), F.when(begin(n, k) + d >= 0, F.substring(c, begin(n, k) + d + 1, begin(n, k + 1) - begin(n, k))).alias("s"))
        return F.array_distinct(F.flatten(F.transform(lengths, lambda n: F.flatten(F.transform(spots, lambda k: F.transform(shifts, lambda d: one(n, k, d)))))))

    x = left.select(left_id, *[F.col(c).alias(f"_x{i}") for i, c in enumerate(a)])
    y = right.select(right_id, *[F.col(c).alias(f"_y{i}") for i, c in enumerate(b)])
    xs, ys = x.select("_x0").filter("_x0 is not null").distinct(), y.select("_y0").filter("_y0 is not null").distinct()
    keys = xs.select("_x0", F.explode(own(F.col("_x0"))).alias("p")).join(ys.select("_y0", F.explode(near(F.col("_y0"))).alias("p")).filter("p.s is not null"), "p")
    alike = keys.select("_x0", "_y0").distinct().filter(F.levenshtein("_x0", "_y0", most) >= 0)
    pairs = x.join(alike, "_x0").join(y, "_y0").filter(F.levenshtein("_x1", "_y1", most) >= 0)
    return pairs.select(left_id, right_id, F.levenshtein("_x0", "_y0").alias("distance0"), F.levenshtein("_x1", "_y1").alias("distance1"))


def entity_steps(df: DataFrame, id_col: str, group: str, name: str, time: str, candidates: DataFrame, least: float = 0.85) -> DataFrame:
    """Organisation ids in steps, each for rows that earlier ones left open: ``candidate`` and ``step``.

    ``candidates``: (group, candidate, candidate_name).  1 ``unique``: the group has
    one candidate.  2 ``exact``: one candidate of the group has the row's name,
    without regard to case.  3 ``similar``: the best Jaro-Winkler similarity in the
    group, ``least`` or more, has one candidate.  4 ``within``: one candidate's name
    holds or is held by the row's.  5 ``fill``: the id's nearest earlier or later
    rows agree, or only one has a value.  6 ``modal``: the id's most frequent
    candidate so far, if it is the only one so frequent.
    """
    c = candidates.select(F.col("group").alias("_g"), F.col("candidate").alias("_c"), F.lower("candidate_name").alias("_n")).distinct()
    base = df.withColumn("_row", F.struct(F.col(id_col), F.col(time)))
    p = base.select("_row", F.col(group).alias("_g"), F.lower(name).alias("_m")).distinct().join(c, "_g")
    w = Window.partitionBy("_row")
    distinct = p.select("_m", "_n").distinct().withColumn("_s", jaro_winkler(F.col("_m"), F.col("_n")))
    p = p.join(distinct, ["_m", "_n"], "left").withColumn("_best", F.max("_s").over(w))
    only = lambda test: F.when(F.size(F.collect_set(F.when(test, F.col("_c")))) == 1, F.min(F.when(test, F.col("_c"))))
    step = p.groupBy("_row").agg(
        only(F.lit(True)).alias("unique"), only(F.col("_m") == F.col("_n")).alias("exact"), only((F.col("_s") == F.col("_best")) & (F.col("_s") >= least)).alias("similar"),
        only((F.length("_m") > 0) & (F.length("_n") > 0) & (F.col("_m").contains(F.col("_n")) | F.col("_n").contains(F.col("_m")))).alias("within"),
    )
    names = ["unique", "exact", "similar", "within"]
    out = base.join(step, "_row", "left")
    out = out.withColumn("candidate", F.coalesce(*names)).withColumn("step", F.coalesce(*[F.when(F.col(n).isNotNull(), n) for n in names])).drop("_row", *names)
    t = Window.partitionBy(id_col).orderBy(time)
    before = F.last("candidate", ignorenulls=True).over(t.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("candidate", ignorenulls=True).over(t.rowsBetween(1, Window.unboundedFollowing))
    fill = F.when(before.isNull(), after).when(after.isNull() | (before == after), before)
    out = out.withColumn("_f", fill).withColumn("step", F.coalesce("step", F.when(F.col("_f").isNotNull(), "fill"))).withColumn("candidate", F.coalesce("candidate", "_f")).drop("_f")
    modal = mode_per_group(out, [id_col], "candidate", "null").select(F.col(id_col), F.col("mode").alias("_f"))
    out = out.join(modal, id_col, "left")
    return out.withColumn("step", F.coalesce("step", F.when(F.col("_f").isNotNull(), "modal"))).withColumn("candidate", F.coalesce("candidate", "_f")).drop("_f")


def validated_members(links: DataFrame, tests: Sequence[tuple[str, DataFrame]], on: Sequence[str]) -> DataFrame:
    """Links that some test's table of keys confirms: ``valid`` and ``by``, the first such test; null keys confirm nothing."""
    out = links
    for k, (_, t) in enumerate(tests):
        out = out.join(t.select(*on).distinct().withColumn(f"_t{k}", F.lit(True)), list(on), "left")
    by = F.coalesce(*[F.when(F.col(f"_t{k}"), n) for k, (n, _) in enumerate(tests)])
    return out.withColumn("by", by).withColumn("valid", F.col("by").isNotNull()).drop(*[f"_t{k}" for k in range(len(tests))])


def leader_passes(leaders: DataFrame, people: DataFrame, id_col: str, entity: str, time: str, name: str, title: str, person: str, least: float = 0.9, reach: int = 2) -> DataFrame:
    """For each leader (id, entity, time, name) the person of its entity found by the pass with the least number: ``person``, ``precedence``, ``pass``.

    Passes: ``name`` 1 (same time, similar names), ``title`` 2 (same time, holds the
    title alone), ``name_year`` 2 + k (similar names k periods apart), ``title_year``
    100 + k (holds the title alone k periods apart).  Ties go to the better
    similarity, the later period, the smaller person.
    """
    p = people.select(F.col(entity).alias("_e"), F.col(time).alias("_t"), F.col(name).alias("_n"), F.col(title).alias("_title"), F.col(person).alias("person"))
    alone = F.size(F.collect_set(F.when(F.col("_title"), F.col("person"))).over(Window.partitionBy("_e", "_t"))) == 1
    p = p.withColumn("_alone", F.col("_title") & alone)
    # Periods are dealt out to the leader's neighbourhood, so a pair is made by equality only.
    near = leaders.withColumn("_t", F.explode(F.sequence(F.col(time) - reach, F.col(time) + reach))).withColumn("_e", F.col(entity))
    j = near.join(p, ["_e", "_t"])
    pairs = j.select(F.col(name).alias("_a"), F.col("_n").alias("_b")).distinct().withColumn("_s", jaro_winkler(F.col("_a"), F.col("_b")))
    j = j.join(pairs, (F.col(name) == F.col("_a")) & (F.col("_n") == F.col("_b")), "left")
    k = F.abs(F.col("_t") - F.col(time))
    alike = F.col("_s") >= least
    number = F.when(alike & (k == 0), 1).when(F.col("_alone") & (k == 0), 2).when(alike, 2 + k).when(F.col("_alone"), 100 + k)
    kind = F.when(alike & (k == 0), "name").when(F.col("_alone") & (k == 0), "title").when(alike, "name_year").when(F.col("_alone"), "title_year")
    j = j.withColumn("precedence", number.cast("int")).withColumn("pass", kind).filter("precedence is not null")
    first = F.row_number().over(Window.partitionBy(id_col).orderBy("precedence", F.desc_nulls_last("_s"), F.desc("_t"), "person"))
    best = j.withColumn("_r", first).filter("_r = 1").select(id_col, "person", "precedence", "pass")
    return leaders.join(best, id_col, "left")


def leader_levels(leaders: DataFrame, people: DataFrame, id_col: str, levels: Sequence[str], time: str, name: str, title: str, person: str, step: int = 1000, least: float = 0.9, reach: int = 2) -> DataFrame:
    """``leader_passes`` within each of several groupings (the entity, then its system): ``person``, ``precedence``, ``pass`` and ``level``.

    Passes of the second level count from ``step``, of the third from twice that;
    the least number wins, so a wider level speaks only where no narrower one does.
    A null level of a leader or a person matches nothing there.
    """
    found = None
    for k, level in enumerate(levels):
        held = leaders.filter(F.col(level).isNotNull())
        hit = leader_passes(held, people.filter(F.col(level).isNotNull()), id_col, level, time, name, title, person, least, reach).filter("person is not null")
        hit = hit.select(id_col, "person", (F.col("precedence") + k * step).alias("precedence"), "pass", F.lit(level).alias("level"))
        found = hit if found is None else found.unionByName(hit)
    best = found.groupBy(id_col).agg(F.min(F.struct("precedence", "person", "pass", "level")).alias("_b")).select(id_col, "_b.*")
    return leaders.join(best, id_col, "left")
