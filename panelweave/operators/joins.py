"""Joins beyond equality.  Each names its equi keys, so that none becomes a nested loop."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ..functions.text import jaro_winkler, sorted_tokens, token_sort_ratio
from .pair_chunks import common_values, partner_lists

EARTH_KM = 6371.0
#: A join that may make many rows of few runs in so many tasks, however small its tables are; a frequent value's rows are dealt into SALTS parts.
JOIN_TASKS, SALTS = 96, 16
#: Fixed value: rows of a chunk; a task compares two chunks at a time.
CHUNK_ROWS = 200
#: Fixed value: rows of a task, where their number tells how many tasks there are.
TASK_ROWS = 250_000


def spread_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """An equi join of JOIN_TASKS tasks, merged from sorted runs: neither side is broadcast, and small tables don't end in one task that makes all rows."""
    return left.repartition(JOIN_TASKS, *on).join(right.repartition(JOIN_TASKS, *on).hint("merge"), list(on), how)


def chunks(df: DataFrame, on: Sequence[str], id_col: str, rows: str, size: int = CHUNK_ROWS) -> DataFrame:
    """``on``, ``_chunk`` and ``rows``, a list of structs of all columns: a key's rows are dealt by ``id_col`` into chunks of some ``size`` rows."""
    n = df.groupBy(*on).agg(F.greatest(F.lit(1), F.ceil(F.count("*") / size)).alias("_parts"))
    dealt = df.join(n.hint("merge"), list(on)) if on else df.crossJoin(F.broadcast(n))  # one row
    dealt = dealt.withColumn("_chunk", F.pmod(F.xxhash64(id_col), F.col("_parts")))
    return dealt.groupBy(*on, "_chunk").agg(F.collect_list(F.struct(*[c for c in df.columns if c not in on])).alias(rows))


def met_chunks(df: DataFrame, on: Sequence[str], id_col: str, size: int = CHUNK_ROWS, parts: int = SALTS) -> DataFrame:
    """Every two chunks of a key, and each with itself, once: ``on``, ``_chunk1 _chunk2 _rows1 _rows2``; a key's first chunks are dealt into so many ``parts`` at most.

    Which chunk is first doesn't tell which of two ids is smaller.
    """
    side = chunks(df, on, id_col, "_rows", size)
    one = side.select(*on, F.col("_chunk").alias("_chunk1"), F.col("_rows").alias("_rows1"), F.pmod("_chunk", F.lit(parts)).cast("int").alias("_salt"))
    # A chunk meets those before it and itself, which have no more parts than their numbers tell.
    two = side.select(*on, F.col("_chunk").alias("_chunk2"), F.col("_rows").alias("_rows2"), F.explode(F.sequence(F.lit(0), F.least(F.col("_chunk"), F.lit(parts - 1)).cast("int"))).alias("_salt"))
    return spread_join(one, two, [*on, "_salt"]).filter("_chunk1 <= _chunk2").drop("_salt")


def band_join(left: DataFrame, right: DataFrame, on: Sequence[str], left_time: str, right_time: str, reach: int) -> DataFrame:
    """All pairs of a key whose times differ by ``reach`` at most; ``time_diff`` is right minus left.

    Both times are dealt into bands of that width and join with the neighbouring
    bands, so a key with many periods is split.
    """
    width = max(1, reach)
    a = left.withColumn("_b", F.floor(F.col(left_time) / width))
    b = right.withColumn("_b", F.explode(F.array(*[F.floor(F.col(right_time) / width) + d for d in (-1, 0, 1)])))
    out = a.join(b, [*on, "_b"])
    return out.withColumn("time_diff", F.col(right_time) - F.col(left_time)).filter(F.abs("time_diff") <= reach).drop("_b")


def nearest_time(left: DataFrame, right: DataFrame, on: Sequence[str], id_col: str, left_time: str, right_time: str, right_id: str, reach: int, later_first: bool = True) -> DataFrame:
    """For each left row the right row nearest in time; on ties the later one, then the smallest id."""
    pairs = band_join(left, right, on, left_time, right_time, reach)
    order = [F.abs("time_diff"), F.desc("time_diff") if later_first else F.asc("time_diff"), F.asc(right_id)]
    return pairs.withColumn("_r", F.row_number().over(Window.partitionBy(id_col).orderBy(*order))).filter("_r = 1").drop("_r")


def levenshtein_join(left: DataFrame, right: DataFrame, keys: Sequence[str], a: str, b: str, most: int, how: str = "inner") -> DataFrame:
    """Equal keys and an edit distance of ``most`` at most (``how``: inner or left); the distance has a limit, so far pairs stop early.

    Different texts of a block are compared once; rows that repeat them come back by an equi join.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"{how}: only inner or left")
    x = left.select(*keys, F.col(a).alias("_a")).filter("_a is not null").distinct()
    y = right.select(*keys, F.col(b).alias("_b")).filter("_b is not null").distinct()
    near = spread_join(x, y, keys).filter(F.levenshtein("_a", "_b", most) >= 0)
    found = spread_join(near, right.withColumn("_b", F.col(b)), [*keys, "_b"]).drop("_b")
    return spread_join(left.withColumn("_a", F.col(a)), found, [*keys, "_a"], how).select(*left.columns, *[c for c in right.columns if c not in keys])


def similarity_join(left: DataFrame, right: DataFrame, a: str, b: str, least: float, keys: Sequence[tuple[Column, Column]]) -> DataFrame:
    """Jaro-Winkler pairs that share at least one blocking key (say: first letter, last letter); each pair once.

    Similarity is computed for distinct pairs of strings only.
    """
    x = left.select(F.col(a).alias("_a")).filter("_a is not null").distinct()
    y = right.select(F.col(b).alias("_b")).filter("_b is not null").distinct()
    found = None
    for k, (ka, kb) in enumerate(keys):
        p = x.withColumn("_k", F.concat_ws(":", F.lit(k), ka)).join(y.withColumn("_k", F.concat_ws(":", F.lit(k), kb)), "_k").select("_a", "_b")
        found = p if found is None else found.union(p)
    scored = found.distinct().withColumn("similarity", jaro_winkler(F.col("_a"), F.col("_b"))).filter(F.col("similarity") >= least)
    return left.join(scored, F.col(a) == F.col("_a")).join(right, F.col("_b") == F.col(b)).drop("_a", "_b")


def fuzzy_left_join(left: DataFrame, right: DataFrame, keys: Sequence[str], id_col: str, tests: Sequence[tuple[str, str, int]], right_id: str) -> DataFrame:
    """All left rows with the right rows of equal keys that are within each test's edits (left column, right column, most).

    ``distance`` is the sum over the tests; a left row without a match has nulls
    once.  Null keys and texts match nothing.  Different texts of a block are
    compared once.
    """
    own, other = [f"_s{i}" for i in range(len(tests))], [f"_t{i}" for i in range(len(tests))]
    l = left.withColumns({s: F.col(a) for s, (a, _, _) in zip(own, tests)})
    r = right.select(right_id, *keys, *[F.col(b).alias(t) for t, (_, b, _) in zip(other, tests)])
    known = lambda names: reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in names])
    met = spread_join(l.select(*keys, *own).filter(known(own)).distinct(), r.select(*keys, *other).filter(known(other)).distinct(), keys)
    near = met.filter(reduce(lambda x, y: x & y, [F.levenshtein(F.col(s), F.col(t), most) >= 0 for s, t, (_, _, most) in zip(own, other, tests)]))
    near = near.withColumn("distance", sum((F.levenshtein(F.col(s), F.col(t)) for s, t in zip(own, other)), F.lit(0)))
    found = spread_join(near, r, [*keys, *other]).select(*keys, *own, right_id, "distance")
    return spread_join(l, found, [*keys, *own], "left").select(*left.columns, right_id, "distance")


def similarity_left_join(left: DataFrame, right: DataFrame, a: str, b: str, most: float, keys: Sequence[tuple[Column, Column]]) -> DataFrame:
    """All left rows with the right rows whose Jaro-Winkler distance is ``most`` at most, among those that share a blocking key (see ``similarity_join``); null columns where none is."""
    own = left.withColumn("_own", F.col(a))
    pairs = similarity_join(own.select("_own").distinct(), right, "_own", b, 1.0 - most, [(x, y) for x, y in keys])
    return own.join(pairs, "_own", "left").drop("_own")


def best_token_sort(left: DataFrame, right: DataFrame, keys: Sequence[str], id_col: str, a: str, b: str, right_id: str, least: float = 80.0) -> DataFrame:
    """In a bucket of equal keys the right text with the best token-sort ratio (ties: the smaller right id), kept if it reaches ``least`` or one holds the other.

    Null keys and texts match nothing.  Words are sorted once a side, a ratio is
    worked out once for different texts, and a bucket's texts meet once, each
    with its smallest right id, so rows that repeat a text make no pairs.
    """
    keys = list(keys)
    l, r = left.withColumn("_a", sorted_tokens(F.col(a))), right.withColumn("_b", sorted_tokens(F.col(b)))
    held = [c for c in right.columns if c not in keys]
    texts = r.filter("_b is not null").groupBy(*keys, "_b").agg(F.min_by(F.struct(*held), F.struct(right_id)).alias("_r"))
    met = spread_join(l.filter("_a is not null").select(*keys, "_a").distinct(), texts.select(*keys, "_b", F.col("_r")[right_id].alias("_i")), keys)
    scored = met.select("_a", "_b").distinct().withColumn("score", token_sort_ratio(F.col("_a"), F.col("_b")))
    first = Window.partitionBy(*keys, "_a").orderBy(F.desc("score"), "_i")
    best = met.join(scored, ["_a", "_b"]).withColumn("_n", F.row_number().over(first)).filter("_n = 1").select(*keys, "_a", "_b", "score")
    found = l.join(best, [*keys, "_a"]).join(texts, [*keys, "_b"]).select(*left.columns, *[F.col("_r")[c].alias(c) for c in held], "score")
    one = found.withColumn("_n", F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("score"), right_id))).filter("_n = 1").drop("_n")
    return one.filter((F.col("score") >= least) | F.col(a).contains(F.col(b)) | F.col(b).contains(F.col(a)))


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    a, b, c, d = (F.radians(x) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((c - a) / 2), F.lit(2)) + F.cos(a) * F.cos(c) * F.pow(F.sin((d - b) / 2), F.lit(2))
    return F.lit(2 * EARTH_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def nearest_point(left: DataFrame, right: DataFrame, id_col: str, lat: str, lon: str, right_id: str, right_lat: str, right_lon: str, radius_km: float) -> DataFrame:
    """The nearest right point within a radius, by grid cells: latitude bands, and longitude cells as wide as the band needs.

    Null coordinates match nothing.  Cells wrap at the antimeridian.  Places meet
    once, however many rows are there; a place's smallest right id stands for it.
    """
    step = radius_km / 111.0

    def band(c):
        return F.floor(F.col(c) / step).cast("long")

    def cells(b):
        """Longitude cells of a band: none narrower than the radius at its edge farthest from the equator."""
        edge = F.greatest(F.abs(b * step), F.abs((b + 1) * step))
        wide = F.greatest(F.lit(1), F.floor(F.lit(360.0) * F.cos(F.radians(edge)) / step)).cast("long")
        return F.when(edge >= 89, F.lit(1)).otherwise(wide)  # one cell around a pole

    def cell(c, n):
        return F.pmod(F.floor((F.col(c) + 180.0) / 360.0 * n).cast("long"), n)

    near = [c for c in right.columns]
    r = right.filter(F.col(right_lat).isNotNull() & F.col(right_lon).isNotNull()).groupBy(F.col(right_lat).alias("_y"), F.col(right_lon).alias("_x")).agg(F.min_by(F.struct(*near), F.struct(right_id)).alias("_r"))
    places = r.select("_y", "_x", F.col("_r")[right_id].alias("_i"), band("_y").alias("_b")).withColumn("_c", cell("_x", cells(F.col("_b"))))
    l = left.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    own = l.select(F.col(lat).alias("_lat"), F.col(lon).alias("_lon")).distinct().withColumn("_b", F.explode(F.array(*[band("_lat") + d for d in (-1, 0, 1)])))
    n = cells(F.col("_b"))  # a band next to the pole's may reach into it
    own = own.withColumn("_c", F.explode(F.array_distinct(F.array(*[F.pmod(cell("_lon", n) + d, n) for d in (-1, 0, 1)]))))
    met = spread_join(own, places, ["_b", "_c"]).withColumn("km", haversine_km(F.col("_lat"), F.col("_lon"), F.col("_y"), F.col("_x"))).filter(F.col("km") <= radius_km)
    best = met.groupBy("_lat", "_lon").agg(F.min(F.struct("km", "_i", "_y", "_x")).alias("_m")).select("_lat", "_lon", "_m.*").drop("_i")
    found = best.join(r.hint("merge"), ["_y", "_x"]).select("_lat", "_lon", "km", *[F.col("_r")[c].alias(c) for c in near])
    pairs = l.withColumns({"_lat": F.col(lat), "_lon": F.col(lon)}).join(found.hint("merge"), ["_lat", "_lon"]).select(*left.columns, *near, "km")
    return pairs.withColumn("_r", F.row_number().over(Window.partitionBy(id_col).orderBy("km", right_id))).filter("_r = 1").drop("_r")


def in_polygon(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd rule over a ring of structs (x, y), closed or not; points on an edge may go either way."""
    n = F.size(ring)
    crosses = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get(ring, i).alias("p"), F.get(ring, (i + 1) % n).alias("q")))
    hits = F.filter(crosses, lambda e: ((e.p.y > y) != (e.q.y > y)) & (x < (e.q.x - e.p.x) * (y - e.p.y) / F.when(e.q.y == e.p.y, F.lit(1.0)).otherwise(e.q.y - e.p.y) + e.p.x))
    return F.size(hits) % 2 == 1


def polygon_join(points: DataFrame, polygons: DataFrame, x: str, y: str, ring: str, tile: float, on: Sequence[str] = ()) -> DataFrame:
    """Points with the polygons that hold them: polygons are dealt into the tiles of their bounding box, points into one tile."""
    lo = lambda c: F.floor(F.array_min(F.transform(F.col(ring), lambda p: p[c])) / tile).cast("int")
    hi = lambda c: F.floor(F.array_max(F.transform(F.col(ring), lambda p: p[c])) / tile).cast("int")
    tiles = polygons.withColumn("_tx", F.explode(F.sequence(lo("x"), hi("x")))).withColumn("_ty", F.explode(F.sequence(lo("y"), hi("y"))))
    at = points.withColumn("_tx", F.floor(F.col(x) / tile).cast("int")).withColumn("_ty", F.floor(F.col(y) / tile).cast("int"))
    return at.join(tiles, [*on, "_tx", "_ty"]).filter(in_polygon(F.col(x), F.col(y), F.col(ring))).drop("_tx", "_ty")


#: Fixed value: ids of a chunk of ``any_key_join``.
ANY_KEY_CHUNK = 1000


def any_key_join(left: DataFrame, right: DataFrame, left_id: str, right_id: str, keys: Sequence[str], separator: str | None = None) -> DataFrame:
    """Pairs of ids that agree in at least one attribute, each once: one equi join over (attribute, value); ``agree`` is the list of these attributes or, with a ``separator``, their text.

    An id's values go with it, so a pair is made at the first attribute and value
    in which it agrees and nowhere else; pairs are neither shuffled nor kept.  A
    value's ids are dealt into chunks, the right ones' into SALTS parts, and a task
    has the pairs of two chunks at a time, as a list for each left id.
    """
    def values(df: DataFrame, i: str) -> DataFrame:
        """A row for each id and value (``k v``): its values of each attribute, and those of this one that come before."""
        sets = df.filter(F.col(i).isNotNull()).groupBy(F.col(i).alias("_id")).agg(*[F.array_sort(F.collect_set(F.col(k).cast("string"))).alias(f"_s{j}") for j, k in enumerate(keys)])
        tagged = lambda j: F.transform(f"_s{j}", lambda v, at: F.struct(F.lit(j).alias("k"), v.alias("v"), F.slice(f"_s{j}", F.lit(1), at).alias("_e")))
        return sets.select("*", F.explode(F.flatten(F.array(*[tagged(j) for j in range(len(keys))]))).alias("kv")).select("kv.*", "_id", *[f"_s{j}" for j in range(len(keys))])

    side = lambda df, i, n: chunks(values(df, i), ["k", "v"], "_id", f"_rows{n}", ANY_KEY_CHUNK)
    l = side(left, left_id, 1).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).drop("_chunk")
    r = side(right, right_id, 2).withColumn("_salt", F.pmod("_chunk", F.lit(SALTS)).cast("int")).drop("_chunk")
    one, two = left.schema[left_id].dataType, right.schema[right_id].dataType
    schema = StructType([StructField("_l", one), StructField("_qs", ArrayType(two)), StructField("_agree", IntegerType())])
    found = spread_join(l, r, ["k", "v", "_salt"]).select("k", "_rows1", "_rows2").mapInArrow(_agreeing(schema, len(keys)), schema)
    agree = F.array_compact(F.array(*[F.when(F.col("_agree").bitwiseAND(F.lit(1 << j)) != 0, F.lit(k)) for k, j in sorted((k, j) for j, k in enumerate(keys))]))
    agree = agree if separator is None else F.array_join(agree, separator)
    return found.select(F.col("_l").alias(left_id), "_qs", agree.alias("agree")).select(left_id, F.explode("_qs").alias(right_id), "agree")


def _agreeing(schema: StructType, keys: int):
    def run(batches):
        for batch in batches:
            for n in range(batch.num_rows):
                here, a, b = batch.column(0)[n].as_py(), batch.column(1)[n].values, batch.column(2)[n].values
                agree = sum((common_values(a.field(f"_s{j}"), b.field(f"_s{j}")) > 0).astype(np.int32) << j for j in range(keys))
                # Neither an earlier attribute nor a smaller value of this one has the pair.
                agree[(agree & ((1 << here) - 1) != 0) | (common_values(a.field("_e"), b.field("_e")) > 0)] = 0
                for code in np.flatnonzero(np.bincount(agree.ravel(), minlength=1)):
                    if code:
                        ids, others = partner_lists(a.field("_id"), b.field("_id"), agree == code)
                        yield pa.RecordBatch.from_arrays([ids, others, pa.repeat(pa.scalar(int(code), pa.int32()), len(ids))], schema.fieldNames())

    return run


def block_sizes(df: DataFrame, block: Sequence[str], id_col: str) -> DataFrame:
    """Ids of each block, and the pairs that they make."""
    n = df.select(*block, id_col).filter(F.col(id_col).isNotNull()).distinct().groupBy(*block).agg(F.count("*").alias("ids"))
    return n.withColumn("pairs", F.floor(F.col("ids") * (F.col("ids") - 1) / 2))


def block_pairs(df: DataFrame, block: Sequence[str], id_col: str, largest: int | None = None, then: Sequence[str] = (), tasks: int | None = None, dealt: bool = False) -> DataFrame:
    """Pairs id1 < id2 of a block, each once; null ids and null keys make none.  ``tasks``: how many make them, where the table's size should say; ``dealt``: a block's ids are dealt into SALTS parts, for few large blocks.

    Blocks of more than ``largest`` ids are split by the further keys ``then``;
    without such keys they raise.
    """
    d = df.select(*block, *then, id_col).filter(F.col(id_col).isNotNull())
    d = (d.repartition(tasks, *block) if tasks else d).distinct()

    def pairs(x: DataFrame, on: list[str]) -> DataFrame:
        one, two = (x.select(*on, F.col(id_col).alias(i)).distinct() for i in ("id1", "id2"))
        if not dealt:
            return one.join(two, on).filter("id1 < id2")
        one, two = one.withColumn("_salt", F.pmod(F.xxhash64("id1"), F.lit(SALTS)).cast("int")), two.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return spread_join(one, two, [*on, "_salt"]).filter("id1 < id2").drop("_salt")

    if largest is None:
        return pairs(d, list(block))
    over = block_sizes(d, block, id_col).filter(F.col("ids") > largest).select(*block)
    if not then:
        big = over.limit(1).collect()
        if big:
            raise ValueError(f"block {big[0]} is over {largest}; add a key")
        return pairs(d, list(block))
    small = pairs(d.join(over, list(block), "left_anti"), list(block))
    split = pairs(d.join(over, list(block), "left_semi"), [*block, *then]).drop(*then)
    return small.unionByName(split).distinct()


def parent_values(df: DataFrame, id_col: str, parent: str, values: Sequence[str], on: Sequence[str] = ()) -> DataFrame:
    """The parent's values beside a row's own, as ``<name>_parent``; ``on`` (a year, say) must agree."""
    p = df.select(F.col(id_col).alias(parent), *on, *[F.col(v).alias(f"{v}_parent") for v in values])
    return df.join(p, [parent, *on], "left")


def keyword_hits(docs: DataFrame, words: DataFrame, doc_id: str, text: str, word_id: str, phrase: str, key_words: int = 3) -> DataFrame:
    """Documents that hold a phrase as whole words, case-insensitively: ``doc_id``, ``word_id``, each pair once.

    Hashes of a phrase's first ``key_words`` words meet those of the documents in
    one equi join; only documents that have a beginning are read for the phrase
    itself, so equal hashes of other words do no harm.  Phrases may be many; null
    and empty texts and phrases hold and are nothing; rows that repeat an id are
    searched each.
    """
    norm = lambda c: F.array_remove(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), "")
    spaced = lambda w: F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))
    p = words.select(word_id, norm(F.col(phrase)).alias("_w")).filter(F.size("_w") > 0)
    w = F.col("_w")
    begin = lambda n, first, at: F.xxhash64(F.lit(n), first, *[F.get(w, at + j) for j in range(1, n)])
    p = p.select(word_id, F.least(F.size(w), F.lit(key_words)).alias("_n"), w)
    lengths = sorted(r[0] for r in p.select("_n").distinct().collect())
    if not lengths:
        return docs.select(doc_id).join(words.select(word_id).limit(0), F.lit(False))
    start = F.coalesce(*[F.when(F.col("_n") == n, begin(n, F.get(w, F.lit(0)), F.lit(0))) for n in lengths])
    p = p.select(word_id, start.alias("_g"), spaced(w).alias("_p")).distinct()
    # The words are a column of their own, so that no gram splits the text again.
    worded = docs.select(doc_id, norm(F.col(text)).alias("_w"))
    grams_of = lambda n: F.transform(w, lambda first, at: begin(n, first, at))
    g = worded.select(doc_id, F.explode(F.array_distinct(F.flatten(F.array(*[grams_of(n) for n in lengths])))).alias("_g"))
    found = g.join(p, "_g").select(F.col(doc_id).alias("_doc"), word_id, "_p").distinct()
    same = F.col(doc_id).eqNullSafe(F.col("_doc"))
    begun = docs.select(doc_id, text).join(found.select("_doc").distinct(), same, "left_semi")
    held = begun.select(doc_id, spaced(norm(F.col(text))).alias("_t")).join(found, same).filter(F.contains("_t", "_p"))
    return held.select(doc_id, word_id).distinct()
