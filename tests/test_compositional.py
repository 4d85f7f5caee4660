import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import compositional as c


def columns(spark, rows, f, **kw):
    df = spark.createDataFrame([tuple(map(float, r)) for r in rows], "a double, b double, c double, d double")
    out = f([F.col(x) for x in "abcd"], **kw)
    return np.array(df.select(*(x.alias(f"o{k}") for k, x in enumerate(out))).collect())


def test_zero_replacement(spark):
    got = columns(spark, [(100, 0, 0, 0), (1, 0, 0, 0), (0, 0, 0, 0), (1, 2, 3, 4), (300, 60, 15, 0)], c.replace_zeros)
    assert got[0][1:] == pytest.approx([0.005] * 3) and got.sum(1) == pytest.approx(np.ones(5))
    assert got[1] == pytest.approx(np.array([1.5, 0.5, 0.5, 0.5]) / 3)
    assert got[2] == pytest.approx([0.25] * 4) and got[3] == pytest.approx([0.1, 0.2, 0.3, 0.4])
    assert columns(spark, [(8, 0, 1, 1)], c.replace_zeros, strength=1.0)[0] == pytest.approx([0.72, 0.1, 0.09, 0.09])


def test_scale_free_zeros(spark):
    rows = [(300, 60, 15, 0), (100, 20, 5, 0)]
    a, b = columns(spark, rows, lambda p: c.ilr(c.replace_zeros(c.to_common_total(p, 1000.0))))
    assert a == pytest.approx(b)
    a, b = columns(spark, rows, lambda p: c.ilr(c.replace_zeros(p)))
    assert abs(a - b).max() > 0.1


def test_coordinates(spark):
    p = [(0.4, 0.3, 0.2, 0.1), (0.25, 0.25, 0.25, 0.25)]
    z = columns(spark, p, c.ilr)
    assert z[0][0] == pytest.approx(np.sqrt(1 / 2) * (np.log(0.4) - np.log(0.3)))
    assert z[0][1] == pytest.approx(np.sqrt(2 / 3) * ((np.log(0.4) + np.log(0.3)) / 2 - np.log(0.2)))
    assert z[0][2] == pytest.approx(np.sqrt(3 / 4) * (np.log([0.4, 0.3, 0.2]).mean() - np.log(0.1)))
    assert z[1] == pytest.approx([0, 0, 0])
    assert columns(spark, p, lambda x: c.ilr_inverse(c.ilr(x))) == pytest.approx(np.array(p))
    assert columns(spark, p, c.alr)[0] == pytest.approx(np.log(np.array([0.4, 0.2, 0.1]) / 0.3))
    clr = np.log(p[0]) - np.log(p[0]).mean()
    d = columns(spark, p[:1], lambda x: [c.aitchison(x, [F.lit(0.25)] * 4)])
    assert d[0][0] == pytest.approx(np.sqrt((clr**2).sum()))
