"""The smoothed forecast against a plain loop."""

from __future__ import annotations

from datetime import date
from math import sin, sqrt

import pytest

from motorpool.plans import report


def month(n):
    return date(2020 + n // 12, n % 12 + 1, 1)


def plain(y, horizon, season, grid):
    best = None
    for i, (a, b, g) in enumerate(grid):
        m1, m2 = sum(y[:season]) / season, sum(y[season : 2 * season]) / season
        level, trend, seasons, error = m1, (m2 - m1) / season, [v - m1 for v in y[:season]], 0.0
        for v in y[season:]:
            old, *seasons = seasons
            new = a * (v - old) + (1 - a) * (level + trend)
            error += (v - (level + trend + old)) ** 2
            trend = b * (new - level) + (1 - b) * trend
            seasons.append(g * (v - new) + (1 - g) * old)
            level = new
        if best is None or error < best[0]:
            best = (error, i, level, trend, seasons)
    error, i, level, trend, seasons = best
    sigma = sqrt(error / (len(y) - season))
    line = [level + s * trend + seasons[(s - 1) % season] for s in range(1, horizon + 1)]
    return [(s, v, v - 1.96 * sigma * sqrt(s), v + 1.96 * sigma * sqrt(s), grid[i]) for s, v in enumerate(line, 1)]


@pytest.mark.parametrize("season", [4, 12])
def test_against_a_loop(spark, season):
    series = {
        "up": [100 + 3 * n + 20 * sin(n) for n in range(40)],
        "gap": [0.0 if n in (5, 6) else 50 + n % 5 for n in range(30)],
        "short": [1.0] * (2 * season),
    }
    rows = [(k, month(n), v / 2) for k, y in series.items() for n, v in enumerate(y) if not (k == "gap" and n in (5, 6)) for _ in range(2)]
    df = spark.createDataFrame([*rows, ("up", None, 9.0)], "site string, m date, usd double")
    got = report.forecast_smoothed(df, ["site"], "m", "usd", horizon=season + 1, season=season).collect()
    assert {r.site for r in got} == {"up", "gap"}
    for site in ("up", "gap"):
        want = plain(series[site], season + 1, season, report.GRID)
        found = sorted((r for r in got if r.site == site), key=lambda r: r.step)
        assert [r.month for r in found] == [month(len(series[site]) + s) for s in range(season + 1)]
        for r, w in zip(found, want):
            assert (r.step, r.alpha, r.beta, r.gamma) == (w[0], *w[4])
            assert (r.forecast, r.lower, r.upper) == pytest.approx(w[1:4])


def test_all_series_at_once_and_none(spark):
    df = spark.createDataFrame([("a", month(n), float(n)) for n in range(30)], "site string, m date, usd double")
    assert [r.step for r in report.forecast_smoothed(df, [], "m", "usd").collect()] == [1, 2, 3]
    assert report.forecast_smoothed(df.limit(0), ["site"], "m", "usd").count() == 0
