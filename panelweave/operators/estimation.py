"""Estimators: least squares by group, two-way fixed effects, interaction-weighted event studies.

Spark reduces the rows to cross products; only those small matrices, whose size
follows the number of cells and periods, are solved on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Fit:
    names: list[str]
    b: np.ndarray
    v: np.ndarray
    n: int
    clusters: int

    @property
    def se(self) -> np.ndarray:
        return np.sqrt(np.maximum(np.diag(self.v), 0))


def group_slopes(df: DataFrame, keys: Sequence[str], x: str, y: str, least: int = 3) -> DataFrame:
    """Slope, intercept and standard error of y on x for each group; null where a group is thin or x constant."""
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    s = d.groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_sxx(y, x).alias("_xx"), F.regr_syy(y, x).alias("_yy"), F.regr_sxy(y, x).alias("_xy"))
    rest = F.greatest(F.lit(0.0), F.col("_yy") - F.col("slope") * F.col("_xy"))
    ok = (F.col("n") >= least) & (F.col("_xx") > 0)
    return s.select(*keys, "n", F.when(ok, F.col("slope")).alias("slope"), F.when(ok, F.col("intercept")).alias("intercept"), F.when(ok & (F.col("n") > 2), F.sqrt(rest / (F.col("n") - 2) / F.col("_xx"))).alias("se"))


def unit_entries(df: DataFrame, unit: str, period: str, cell: str, y: str) -> DataFrame:
    """One row for each unit: ``n``, ``sy`` and ``entries``, its numbers of rows and sums of y by (period, cell).

    ``period`` and ``cell`` are column numbers of the regression (a null cell is
    none).  Rows are summed before units are gathered, so a unit's array has as
    many entries as it has periods, however many rows it repeats.
    """
    e = df.groupBy(unit, F.col(period).alias("p"), F.col(cell).alias("c")).agg(F.count("*").cast("double").alias("n"), F.sum(y).alias("sy"))
    return e.groupBy(unit).agg(F.sum("n").alias("n"), F.sum("sy").alias("sy"), F.collect_list(F.struct("p", "c", "n", "sy")).alias("entries"))


def _by_column(entries: Column, measure: Callable[[Column], Column]) -> Column:
    """Of an array of entries one struct (i, v) for each period and each cell in it: its measure."""
    periods = F.transform(entries, lambda e: F.struct(e.p.alias("i"), measure(e).alias("v")))
    cells = F.transform(F.filter(entries, lambda e: e.c.isNotNull()), lambda e: F.struct(e.c.alias("i"), measure(e).alias("v")))
    both = F.concat(periods, cells)
    seen = F.array_distinct(F.transform(both, lambda x: x.i))
    total = lambda i: F.aggregate(F.filter(both, lambda x: x.i == i), F.lit(0.0), lambda t, x: t + x.v)
    return F.transform(seen, lambda i: F.struct(i.alias("i"), total(i).alias("v")))


def _outer(units: DataFrame, vector: str, by: Column) -> DataFrame:
    """Sums over the units of v_i v_j / ``by``, as rows (i, j, v) with i <= j: as many as the regression has pairs of columns."""
    x, y = F.col("x"), F.col("y")
    one = units.select(by.alias("_by"), vector, F.explode(vector).alias("x")).select("_by", "x", F.explode(vector).alias("y")).filter(x.i <= y.i)
    return one.groupBy(x.i.alias("i"), y.i.alias("j")).agg(F.sum(x.v * y.v / F.col("_by")).alias("v"))


def _matrix(rows: DataFrame, k: int) -> np.ndarray:
    m = np.zeros((k, k))
    for i, j, v in rows.select("i", "j", "v").collect():
        m[i, j] = m[j, i] = m[i, j] + v
    return m


def _inverse(m: np.ndarray) -> np.ndarray:
    """Pseudo-inverse of a symmetric matrix; directions that only rounding fills, such as the sum of all periods, are left out."""
    return np.linalg.pinv(m, rcond=1e-9, hermitian=True) if m.size else m


def two_way_fit(df: DataFrame, unit: str, period: str, cell: str, y: str, cells: int, periods: int) -> Fit:
    """Effects of the cells (columns 0 ...) under unit and period effects (columns ``cells`` ...), variance clustered by unit.

    Unit effects are taken out by each unit's sums, which leaves the cross products
    of cells and periods; the periods are then eliminated exactly (Schur
    complement).  Two passes over the units' sums in all, each summed before its
    shuffle to one number for a pair of columns; nothing is sorted by period.
    """
    from .graphs import durable

    k = cells + periods
    units = durable(unit_entries(df, unit, period, cell, y))
    e = F.col("entries")
    counted = units.withColumn("_s", _by_column(e, lambda z: z.n))
    own = units.select(F.explode("entries").alias("e")).select("e.*")
    ends = F.array(F.struct(F.col("p").alias("i"), F.col("p").alias("j")), F.struct(F.col("c").alias("i"), F.col("c").alias("j")), F.struct(F.col("c").alias("i"), F.col("p").alias("j")))
    raw = own.select(F.explode(ends).alias("z"), "n").filter("z.i is not null").groupBy(F.col("z.i").alias("i"), F.col("z.j").alias("j")).agg(F.sum("n").alias("v"))
    a = _matrix(raw, k) - _matrix(_outer(counted, "_s", F.col("n")), k)
    sums = units.select(F.col("n").alias("_n"), F.col("sy").alias("_sy"), F.explode(_by_column(e, lambda z: z.sy - z.n * F.col("sy") / F.col("n"))).alias("x"))
    right = np.zeros(k)
    for i, v in sums.groupBy(F.col("x.i").alias("i")).agg(F.sum("x.v").alias("v")).collect():
        right[i] = v
    within = _inverse(a[cells:, cells:])
    through = a[:cells, cells:] @ within
    schur = _inverse(a[:cells, :cells] - through @ a[cells:, :cells])
    beta = schur @ (right[:cells] - through @ right[cells:])
    effects = F.array(*[F.lit(float(v)) for v in np.concatenate([beta, within @ (right[cells:] - a[cells:, :cells] @ beta)])])
    fitted = lambda z: F.get(effects, z.p) + F.coalesce(F.get(effects, z.c), F.lit(0.0))
    left = units.withColumn("_rest", F.transform(e, lambda z: F.struct(z.p.alias("p"), z.c.alias("c"), z.n.alias("n"), (z.sy - z.n * fitted(z)).alias("r"))))
    left = left.withColumn("_mean", F.aggregate("_rest", F.lit(0.0), lambda t, z: t + z.r) / F.col("n"))
    scored = left.withColumn("_g", _by_column(F.col("_rest"), lambda z: z.r - z.n * F.col("_mean")))
    g = _matrix(_outer(scored, "_g", F.lit(1.0)), k)
    take = np.hstack([np.eye(cells), -through])
    n, clusters = units.agg(F.sum("n"), F.count("*")).first()
    small = clusters / (clusters - 1) * (n - 1) / max(1, n - cells) if clusters and clusters > 1 else 1.0
    return Fit([str(i) for i in range(cells)], beta, small * schur @ (take @ g @ take.T) @ schur, int(n or 0), clusters)


def event_study(df: DataFrame, unit: str, time: str, cohort: str, y: str, reach: int, baseline: int = -1, split: str | None = None) -> Fit:
    """Interaction-weighted event study (Sun and Abraham, 2021); never-treated units (null cohort) are the control.

    Effects of each cohort and relative time come from one two-way fixed-effects
    regression; those of a relative time are averaged by the cohorts' shares in
    it.  Relative times beyond ``reach`` are joined at the ends.  The variance is
    clustered by unit and includes that of the shares.  With ``split``, a column
    that is constant within a unit, the same regression has effects of their own
    for each of its values, named ``<value>:t<k>``; treated units without one go.
    """
    extra = [split] if split else []
    d = df.select(unit, time, cohort, *extra, F.col(y).cast("double").alias("_y")).filter(F.col("_y").isNotNull())
    if split:
        d = d.filter(F.col(cohort).isNull() | F.col(split).isNotNull())
    d = d.withColumn("_group", (F.concat(F.col(split).cast("string"), F.lit(":")) if split else F.lit("")))
    d = d.withColumn("_rel", F.greatest(F.lit(-reach), F.least(F.lit(reach), F.col(time) - F.col(cohort))))
    treated = d.filter(F.col(cohort).isNotNull() & (F.col("_rel") != baseline))
    cells = [tuple(r) for r in treated.groupBy("_group", cohort, "_rel").count().orderBy("_group", cohort, "_rel").collect()]
    times = [r[0] for r in d.select(time).distinct().orderBy(time).collect()]
    cell_of = {(g, c, r): i for i, (g, c, r, _) in enumerate(cells)}
    kind = dict(d.dtypes)
    # One row a cell and one a period: as many as the regression has columns.
    numbered = df.sparkSession.createDataFrame([(*key, i) for key, i in cell_of.items()], f"_group string, `{cohort}` {kind[cohort]}, _rel {kind['_rel']}, _cell int")
    dated = df.sparkSession.createDataFrame([(t, len(cells) + i) for i, t in enumerate(times)], f"`{time}` {kind[time]}, _period int")
    placed = d.join(F.broadcast(numbered), ["_group", cohort, "_rel"], "left").join(F.broadcast(dated), time)
    fit = two_way_fit(placed, unit, "_period", "_cell", "_y", len(cells), len(times))
    terms = sorted({(g, r) for g, _, r, _ in cells})
    weights = np.zeros((len(terms), len(cells)))
    for i, (g, _, r, n) in enumerate(cells):
        weights[terms.index((g, r)), i] = n
    sizes = weights.sum(axis=1)
    weights /= sizes[:, None]
    effects = weights @ fit.b
    # A unit's part in the shares: how far its cohort's effect is from the mean, by the number of rows of the relative time.
    rows = [(g, c, r, terms.index((g, r)), float((fit.b[i] - effects[terms.index((g, r))]) / sizes[terms.index((g, r))])) for i, (g, c, r, _) in enumerate(cells)]
    if not rows:
        return Fit([], effects, weights @ fit.v @ weights.T, fit.n, fit.clusters)
    table = df.sparkSession.createDataFrame(rows, f"_group string, `{cohort}` {kind[cohort]}, _rel {kind['_rel']}, _term int, _part double")
    parts = treated.join(F.broadcast(table), ["_group", cohort, "_rel"]).groupBy(unit).agg(*[F.sum(F.when(F.col("_term") == i, F.col("_part")).otherwise(0.0)).alias(f"p{i}") for i in range(len(terms))])  # one row for each cell
    k = len(terms)
    cross = parts.agg(*[F.sum(F.col(f"p{i}") * F.col(f"p{j}")) for i in range(k) for j in range(k)]).first()
    shares = np.array([v or 0.0 for v in cross]).reshape(k, k)
    return Fit([f"{g}t{r}" for g, r in terms], effects, weights @ fit.v @ weights.T + shares, fit.n, fit.clusters)


def combine(fit: Fit, weights: dict[str, float]) -> tuple[float, float]:
    """A linear combination and its standard error."""
    w = np.array([weights.get(n, 0.0) for n in fit.names])
    return float(w @ fit.b), float(np.sqrt(max(0.0, w @ fit.v @ w)))


def as_frame(spark, fits: dict[str, Fit]) -> DataFrame:
    rows = [(label, n, float(b), float(s), f.n, f.clusters) for label, f in fits.items() for n, b, s in zip(f.names, f.b, f.se)]
    return spark.createDataFrame(rows, "model string, term string, b double, se double, n long, clusters long")


def pre_means(df: DataFrame, relative: str, outcomes: Sequence[str]) -> DataFrame:
    """Mean, sd, n and standard error of each outcome before the event (relative time under 0; the never treated stay out)."""
    pre = df.filter(F.col(relative) < 0)
    long = pre.select(*[F.col(o).cast("double").alias(o) for o in outcomes]).unpivot([], list(outcomes), "outcome", "v")
    return long.groupBy("outcome").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), F.count("v").alias("n"), (F.stddev_samp("v") / F.sqrt(F.count("v"))).alias("se"))
