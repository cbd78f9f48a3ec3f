"""Exact quantiles in two scans against sorted values."""

import math
import random
import statistics

import pytest

from gapline.operators import matrix, quantiles

NAMES = ["spread", "ties", "same", "none", "few", "wide"]


def table(spark, n=3000):
    rng = random.Random(8)
    rows = []
    for i in range(n):
        wide = rng.choice([1e-9, 1e9]) * rng.random()
        rows.append((i % 3, rng.gauss(0, 1) if rng.random() > 0.1 else None, float(rng.randint(0, 2)) if rng.random() > 0.3 else math.nan, 5.0, None, 1.5 if i == 7 else None, wide))
    return rows, spark.createDataFrame(rows, "fold int, " + ", ".join(f"{c} double" for c in NAMES))


def plain(values, q):
    own = sorted(v for v in values if v is not None and not math.isnan(v))
    if not own:
        return None
    at = (len(own) - 1) * q
    low = own[math.floor(at)]
    return low + (at - math.floor(at)) * (own[math.ceil(at)] - low)


@pytest.mark.parametrize("q", [0.0, 0.37, 0.5, 1.0])
def test_all_columns_at_once(spark, q):
    rows, df = table(spark)
    got = {s["column"]: s for s in quantiles.column_statistics(df, NAMES, q)}
    for i, c in enumerate(NAMES):
        own = [r[i + 1] for r in rows if r[i + 1] is not None and not math.isnan(r[i + 1])]
        assert got[c]["quantile"] == pytest.approx(plain(own, q), rel=1e-12) if own else got[c]["quantile"] is None
        assert (got[c]["n"], got[c]["rows"]) == (len(own), len(rows))
        if own:
            assert got[c]["mean"] == pytest.approx(statistics.fmean(own), rel=1e-9, abs=1e-9)
            assert got[c]["variance"] == pytest.approx(statistics.pvariance(own), rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("sketch", [8, 2000])
def test_folds_and_sketches_that_miss(spark, monkeypatch, sketch):
    monkeypatch.setattr(quantiles, "SKETCH", sketch)
    monkeypatch.setattr(quantiles, "MARGIN", 0.0001)
    rows, df = table(spark)
    got = {(s["fold"], s["column"]): s for s in quantiles.column_statistics(df, NAMES, 0.5, "fold")}
    assert len(got) == 3 * len(NAMES)
    for (fold, c), s in got.items():
        i = NAMES.index(c) + 1
        want = plain([r[i] for r in rows if r[0] != fold], 0.5)
        assert s["quantile"] is None if want is None else s["quantile"] == pytest.approx(want, rel=1e-12)


def test_no_rows(spark):
    _, df = table(spark, 1)
    assert quantiles.column_statistics(df.where("fold < 0"), NAMES) == []
    assert quantiles.column_statistics(df, []) == []


def test_fold_fits_equal_single_fits(spark):
    _, df = table(spark)
    names = ["spread", "ties", "same"]
    per = {(r.fold, r.feature): r for r in matrix.fit_scalers(df, names, "fold").collect()}
    for fold in range(3):
        for r in matrix.fit_scaler(df.where(f"fold <> {fold}"), names).collect():
            own = per[fold, r.feature]
            assert (own.median, own.mean, own.std) == pytest.approx((r.median, r.mean, r.std), rel=1e-9)
    filled = matrix.apply_fold_scalers(df, matrix.fit_scalers(df, names, "fold"), names)
    assert filled.columns == [*[c for c in df.columns if c not in names], *names]
    assert filled.where("spread IS NULL OR same <> 0").count() == 0
