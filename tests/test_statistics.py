import math

import numpy as np
import pytest

from tessella.config import CONFIG, Config
from tessella.functions import resampling
from tessella.functions import statistics as s
from tessella.operators import agreement, consensus, outliers


def test_chi_squared_tail():
    for x in (0.1, 1.0, 5.0, 30.0, 700.0):  # two degrees: exp(-x / 2)
        assert s.chi2_log_sf(x, 2) == pytest.approx(-x / 2, rel=1e-10)
    assert s.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, rel=1e-9)
    assert s.chi2_sf(36.41502850180731, 24) == pytest.approx(0.05, rel=1e-9)
    assert s.chi2_log_sf(1307.8, 24) / math.log(10) == pytest.approx(-261, abs=1)  # far in the tail
    assert s.chi2_sf(0, 3) == 1 and s.chi2_sf(float("nan"), 3) == 1


def test_studentised_range():
    assert s.studentised_range_sf(2.772, 2) == pytest.approx(0.05, abs=2e-4)
    assert s.studentised_range_sf(3.314, 3) == pytest.approx(0.05, abs=2e-4)
    assert s.studentised_range_sf(0, 5) == 1


def test_small_tests():
    assert s.binomial_upper(8, 8) == 1 / 256 and s.binomial_upper(0, 5) == 1
    assert s.holm([0.01, 0.04, 0.03, float("nan")]) == pytest.approx([0.04, 0.09, 0.09, 1.0])


def test_average_linkage():
    merges = s.average_linkage(np.array([[0, 1, 4.0], [1, 0, 6], [4, 6, 0]]))
    assert merges == [(0, 1, 1.0, 2), (2, 3, 5.0, 3)]


def test_geometric_median():
    x = np.array([[0.0, 0], [2, 0], [0, 2], [2, 2], [1, 1]])
    assert consensus.geometric_median(x) == pytest.approx([1, 1])
    far = np.vstack([np.zeros((6, 3)), np.full((1, 3), 100.0)])
    assert np.linalg.norm(consensus.geometric_median(far)) < 1e-3  # an outlier does not pull it
    assert (consensus.geometric_median(x[:1]) == x[0]).all()
    with pytest.raises(ValueError, match="no points"):
        consensus.geometric_median(x[:0])
    r = np.random.default_rng(1).normal(size=(25, 3))
    y = consensus.geometric_median(r)
    cost = np.linalg.norm(r - y, axis=1).sum()
    assert all(np.linalg.norm(r - y - d, axis=1).sum() >= cost - 1e-6 for d in np.eye(3) * 0.01)


def test_leave_one_out():
    x = np.random.default_rng(2).normal(size=(12, 3))
    center = x.mean(0)
    want = []
    for k in range(len(x)):
        cov = np.cov(np.delete(x, k, 0).T)
        cov = cov + (1e-3 * np.trace(cov) / 3 + 1e-6) * np.eye(3)
        want.append(math.sqrt((x[k] - center) @ np.linalg.inv(cov) @ (x[k] - center)))
    assert consensus.leave_one_out(x, center) == pytest.approx(want)
    assert consensus.leave_one_out(x[:4], center) == pytest.approx(np.linalg.norm(x[:4] - center, axis=1))
    alike = np.vstack([np.zeros((9, 3)), [[0.1, 0, 0]]])
    assert np.isfinite(consensus.leave_one_out(alike, np.zeros(3))).all()


def test_stacked_blocks_equal_single_ones():
    r = np.random.default_rng(7)
    x = r.normal(size=(40, 6, 3))
    x[3] = x[3, 0]  # all points alike
    x[4, 1:] = 0
    y = consensus.geometric_medians(x)
    assert y == pytest.approx(np.array([consensus.geometric_median(b) for b in x]), abs=1e-12)
    assert consensus.leave_one_out(x, y) == pytest.approx(np.array([consensus.leave_one_out(b, c) for b, c in zip(x, y, strict=True)]))


def test_a_covariance_without_inverse(monkeypatch):
    monkeypatch.setattr(consensus, "RIDGE", 0.0)
    monkeypatch.setattr(consensus, "FLOOR", 0.0)
    x = np.zeros((9, 3))
    x[:, 0] = np.arange(9)
    assert np.isfinite(consensus.leave_one_out(x, x.mean(0))).all()


@pytest.mark.parametrize("sets", [20_000, 1])  # by sets; by a hash a method
def test_slots_are_dealt_evenly(spark, monkeypatch, sets):
    monkeypatch.setattr(outliers, "SETS", sets)
    rows = [(t, 0.0, t, 300, 6) for t in (1, 2, 5)]
    got = outliers.dealt(spark.createDataFrame(rows, "block_size long, overlap_pct double, t long, nb long, m long"), Config(draws=400)).toPandas()
    for t in (1, 2, 5):
        sums = got[got.block_size == t].pivot_table(index="r", columns="j", values="n", fill_value=0).to_numpy()
        assert sums.shape == (400, 6) and (sums.sum(1) == 300 * t).all() and sums.max() <= 300
        assert sums.mean(0) == pytest.approx(np.full(6, 50 * t), rel=0.05)
        p = t / 6
        assert sums.var() == pytest.approx(300 * p * (1 - p), rel=0.2)


def test_p_values_by_their_definition(spark):
    r = np.random.default_rng(4)
    rows = [("s", 0.0, 1, b, 0, f"m{k}", float(r.normal() + (3 if k == 2 else 0))) for b in range(40) for k in range(5)]
    schema = "slide_id string, overlap_pct double, block_size long, block_x long, block_y long, nms_method string, mahalanobis_distance double"
    cells = outliers.tail_cells(spark.createDataFrame(rows, schema))
    got = {x.nms_method: x for x in outliers.permutation(cells).collect()}
    tops = []
    for k in range(CONFIG.draws):  # each block has one of five methods in its tail
        x = [pow((b * 1000003 + k * 7919 + CONFIG.seed) % resampling.P, 5, resampling.P) for b in range(40)]
        x = [pow(v + k * 104729 + b, 5, resampling.P) % 5 for b, v in enumerate(x)]
        tops.append(np.bincount(x, minlength=5).max())
    for x in got.values():
        assert x.p_value == pytest.approx((1 + sum(t >= x.n_upper for t in tops)) / (CONFIG.draws + 1))
    assert got["m2"].flagged_outlier and not got["m0"].flagged_outlier


def test_block_bootstrap(spark):
    r = np.random.default_rng(5)
    panel = r.normal(size=(1, 30, 2)) + 0.3 * r.normal(size=(4, 30, 2))
    rows = [(f"s{u % 3}", 0.0, 1, u, 0, f"m{a}", *map(float, panel[a, u])) for a in range(4) for u in range(30)]
    schema = "slide_id string, overlap_pct double, block_size long, block_x long, block_y long, nms_method string, z1 double, z2 double"
    (got,) = agreement.block_bootstrap(spark.createDataFrame(rows, schema), 4, pieces=5).collect()
    assert got.alpha == pytest.approx(brute_alpha(panel))
    boots = [brute_alpha(panel[:, r.integers(0, 30, 30)]) for _ in range(120)]
    low, high = np.percentile(boots, [2.5, 97.5])
    assert got.lo95 == pytest.approx(low, abs=0.05) and got.hi95 == pytest.approx(high, abs=0.03)


def brute_alpha(panel):
    """Alpha of (methods, blocks, coordinates) by all pairs."""
    m, n, _ = panel.shape
    within = np.mean([np.mean([((panel[a, u] - panel[b, u]) ** 2).sum() for a in range(m) for b in range(a)]) for u in range(n)])
    flat = panel.reshape(m * n, -1)
    total = np.mean([((flat[a] - flat[b]) ** 2).sum() for a in range(m * n) for b in range(a)])
    return 1 - within / total


def test_alpha_against_all_pairs(spark):
    r = np.random.default_rng(5)
    panel = r.normal(size=(1, 9, 3)) + 0.3 * r.normal(size=(4, 9, 3))
    rows = [(f"s{u % 3}", 0.0, 1, u, 0, f"m{a}", *map(float, panel[a, u])) for a in range(4) for u in range(9)]
    rows.append(("s0", 0.0, 1, 99, 0, "m0", 9.0, 9.0, 9.0))  # a block without all methods is left out
    schema = "slide_id string, overlap_pct double, block_size long, block_x long, block_y long, nms_method string, z1 double, z2 double, z3 double"
    sums = agreement.slide_sums(spark.createDataFrame(rows, schema), 4)
    (row,) = agreement.alpha(sums, 4).collect()
    assert row.n_blocks == 9 and row.alpha == pytest.approx(brute_alpha(panel))
    for k in range(3):
        assert row[f"alpha_coord_{k + 1}"] == pytest.approx(brute_alpha(panel[:, :, k : k + 1]))
    (ci,) = agreement.bootstrap(sums, 4).collect()
    assert ci.lo95 <= ci.hi95 and ci.alpha == pytest.approx(row.alpha)
    slides = np.array([f"s{u % 3}" for u in range(9)])
    boots = [brute_alpha(np.concatenate([panel[:, slides == f"s{k}"] for k in d], axis=1)) for d in drawn(3)]
    assert (ci.lo95, ci.hi95) == pytest.approx(tuple(np.percentile(boots, [2.5, 97.5])))


def drawn(n, replicates=CONFIG.draws, seed=CONFIG.seed):
    """The draws by definition, in whole numbers of any size."""
    out = []
    for r in range(replicates):
        row = []
        for k in range(n):
            x = pow((k * 1000003 + r * 7919 + seed) % resampling.P, 5, resampling.P)
            row.append(pow(x + r * 104729 + k, 5, resampling.P) % n)
        out.append(row)
    return np.array(out)


def test_draws(spark):
    got = resampling.draws(spark.createDataFrame([(7,), (7,), (4,), (0,)], "n int")).toPandas()
    for n in (4, 7):
        mine = got[got.n == n].pivot(index="r", columns="k", values="at").to_numpy()
        assert (mine == drawn(n)).all()
    assert set(got.n) == {4, 7}


def test_draws_are_even_and_independent():
    for n in (5, 76):
        at = drawn(n)
        counts = np.bincount(at.ravel(), minlength=n)
        assert ((counts - at.size / n) ** 2 / (at.size / n)).sum() < n + 5 * math.sqrt(2 * n)
        for a, b in ((at[:, :-1], at[:, 1:]), (at[:-1], at[1:])):  # next draw, next replicate
            assert abs(np.corrcoef(a.ravel(), b.ravel())[0, 1]) < 5 / math.sqrt(a.size)
        own = at.mean(1)
        assert own.std() == pytest.approx(math.sqrt((n * n - 1) / 12 / n), rel=0.1)


def test_intervals_of_medians(spark):
    r = np.random.default_rng(3)
    groups = {"a": r.normal(size=9), "b": r.normal(size=12).round(1), "c": np.array([1.0, 2.0]), "d": np.array([np.nan, 0.5, 0.5, 0.5]), "e": np.array([np.nan])}
    rows = [(g, float(x)) for g, v in groups.items() for x in v] + [("a", None)]
    got = {x.g: x for x in resampling.median_intervals(spark.createDataFrame(rows, "g string, x double"), ["g"], "x").collect()}
    for g, v in groups.items():
        v = np.sort(v[~np.isnan(v)])
        assert got[g].n == len(v)
        if len(v) < 3:
            assert all(map(math.isnan, got[g][2:]))
        else:
            ends = np.percentile(np.median(v[drawn(len(v))], axis=1), [5, 95])
            assert got[g][2:] == pytest.approx((np.median(v), *ends))
