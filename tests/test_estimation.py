"""Two-way fixed effects by elimination against a dense regression in numpy."""

import random

import numpy as np
import pytest

from panelweave.operators import estimation as E


def dense(rows, cells, periods):
    """Least squares on dummies of cells, periods and units; the variance of the cells clustered by unit."""
    units = sorted({u for u, *_ in rows})
    x = np.zeros((len(rows), cells + periods + len(units)))
    y = np.array([r[3] for r in rows])
    for k, (u, p, c, _) in enumerate(rows):
        x[k, p] = 1
        x[k, cells + periods + units.index(u)] = 1
        if c is not None:
            x[k, c] = 1
    b = np.linalg.lstsq(x, y, rcond=None)[0]
    others = x[:, cells:]
    d = x[:, :cells] - others @ np.linalg.lstsq(others, x[:, :cells], rcond=None)[0]
    e, inverse = y - x @ b, np.linalg.inv(d.T @ d)
    meat = sum(np.outer(s, s) for u in units for s in [sum(d[k] * e[k] for k, r in enumerate(rows) if r[0] == u)])
    n, g = len(rows), len(units)
    return b[:cells], g / (g - 1) * (n - 1) / (n - cells) * inverse @ meat @ inverse


@pytest.mark.parametrize("repeats", [1, 3])
def test_two_way_fit(spark, repeats):
    rand = random.Random(repeats)
    rows = []
    for u in range(25):
        cohort = {0: 3, 1: 4}.get(u % 3)
        for t in range(7):
            for _ in range(rand.randint(0, repeats)):
                cell = None if cohort is None or t - cohort == -1 else (0 if t < cohort else 1 if cohort == 3 else 2)
                rows.append((u, 3 + t, cell, 1e3 + u + t * 0.5 + (cell or 0) + rand.gauss(0, 1)))
    df = spark.createDataFrame(rows, "u int, p int, c int, y double")
    fit = E.two_way_fit(df, "u", "p", "c", "y", 3, 7)
    b, v = dense(rows, 3, 7)
    assert np.allclose(fit.b, b, atol=1e-8) and np.allclose(fit.v, v, atol=1e-8)
    assert (fit.n, fit.clusters) == (len(rows), len({r[0] for r in rows}))


def test_a_repeated_row_is_one_entry(spark):
    """A unit's array grows with its periods, not with its rows."""
    df = spark.range(10_000).selectExpr("1 as u", "cast(id % 2 as int) as p", "cast(null as int) as c", "1.0 as y")
    (unit,) = E.unit_entries(df, "u", "p", "c", "y").collect()
    assert unit.n == 10_000 and len(unit.entries) == 2
