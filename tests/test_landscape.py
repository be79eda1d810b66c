"""Landscape operators against dense references, finite differences and published values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridkin.functions import columns as C
from gridkin.functions.targets import TargetSpec
from gridkin.operators import alignment as A
from gridkin.operators import calibration as K
from gridkin.operators import mlpe as M
from gridkin.operators import models as D
from gridkin.operators import networks as N
from gridkin.operators import training as T
from gridkin.operators import wishart as W
from gridkin.operators.resistance import ResistanceError, adjoint, block_solver, dense_solver, solver_of

PLAIN = TargetSpec("distance")


def make(spark, shape, n_units, seed=0, species=None, features=2, region="valley"):
    """cells, units, observations of one region."""
    rng = np.random.default_rng(seed)
    x = rng.uniform(0.8, 1.6, (*shape, features))
    cells = [(region, r, c, [float(v) for v in x[r, c]]) for r in range(shape[0]) for c in range(shape[1])]
    at = rng.permutation(shape[0] * shape[1])[:n_units]
    units = [(region, species, f"u{i}", i, int(p // shape[1]), int(p % shape[1])) for i, p in enumerate(at)]
    obs = [(region, species, f"u{i}", f"u{j}", float(rng.uniform(0.2, 1.5))) for i in range(n_units) for j in range(i + 1, n_units)]
    return (
        spark.createDataFrame(cells, "region string, row int, col int, features array<double>"),
        spark.createDataFrame(units, "region string, species string, unit string, unit_ord int, row int, col int"),
        spark.createDataFrame(obs, "region string, species string, left string, right string, value double"),
    )


@pytest.mark.parametrize("shape", [(1, 7), (7, 1), (4, 5), (6, 3)])
def test_resistance_against_the_pseudo_inverse(shape):
    rng = np.random.default_rng(1)
    c = rng.uniform(0.1, 3, shape)
    nodes = np.array([(r, k) for r in range(shape[0]) for k in range(shape[1])])[::2]
    nodes = np.concatenate([nodes, nodes[:1]])
    np.testing.assert_allclose(block_solver(c, nodes), dense_solver(c, nodes), atol=1e-10)
    assert block_solver(c, nodes)[0, -1] == 0


def test_resistance_refuses_bad_input():
    for c, n in ((np.ones((1, 1)), [[0, 0]]), (np.array([[1.0, 0.0]]), [[0, 0]]), (np.array([[1.0, np.nan]]), [[0, 0]]), (np.ones((2, 2)), [[2, 0]])):
        with pytest.raises(ResistanceError):
            block_solver(c, np.array(n))
    with pytest.raises(ValueError):
        solver_of("fast")


def test_resistance_adjoint():
    rng = np.random.default_rng(2)
    c, left, right, w = rng.uniform(0.5, 2, (3, 4)), np.array([0, 5, 2]), np.array([11, 7, 3]), rng.normal(size=3)

    def f(c):
        n = np.stack([np.arange(12) // 4, np.arange(12) % 4], 1)
        return w @ block_solver(c, n)[left, right]

    g = adjoint(c, left, right, w)
    for at in ((0, 0), (1, 2), (2, 3)):
        up, down = c.copy(), c.copy()
        up[at] += 1e-6
        down[at] -= 1e-6
        assert (f(up) - f(down)) / 2e-6 == pytest.approx(g[at], rel=1e-5, abs=1e-8)


def dense_nll(g, x, u, d):
    z = np.zeros((len(x), g.n))
    z[np.arange(len(x)), g.left] += 1
    z[np.arange(len(x)), g.right] += 1
    v = d * np.eye(len(x)) + u * z @ z.T
    b = np.stack([np.ones(len(x)), x], 1)
    vi = np.linalg.inv(v)
    beta = np.linalg.solve(b.T @ vi @ b, b.T @ vi @ g.target)
    r = g.target - b @ beta
    return 0.5 * (len(x) * math.log(2 * math.pi) + np.linalg.slogdet(v)[1] + r @ vi @ r), u * z.T @ vi @ r


def group(n=7, seed=4, drop=3):
    rng = np.random.default_rng(seed)
    i, j = np.triu_indices(n, 1)
    keep = rng.permutation(len(i))[drop:]
    b = rng.normal(0, 0.6, n)
    s = rng.uniform(0.2, 3, len(i))
    return M.Group(s[keep], (1 + 0.5 * s + b[i] + b[j] + rng.normal(0, 0.2, len(i)))[keep], i[keep], j[keep], n)


def test_likelihood_against_the_dense_covariance():
    g = group()
    c, a = g.moments()
    x = (g.distance - c) / a
    f = M.likelihood(g, x, 0.3, 0.05)
    nll, effects = dense_nll(g, x, 0.3, 0.05)
    assert f.nll == pytest.approx(nll, rel=1e-10)
    np.testing.assert_allclose(f.effects, effects, atol=1e-10)
    h = 1e-6
    beta = f.beta
    by_u = (M.likelihood(g, x, 0.3 + h, 0.05, beta).nll - M.likelihood(g, x, 0.3 - h, 0.05, beta).nll) / (2 * h)
    by_d = (M.likelihood(g, x, 0.3, 0.05 + h, beta).nll - M.likelihood(g, x, 0.3, 0.05 - h, beta).nll) / (2 * h)
    assert (f.by_unit, f.by_noise) == (pytest.approx(by_u, rel=1e-5), pytest.approx(by_d, rel=1e-5))
    grad = M.distance_gradient(g, x, a, f)
    s = g.distance.copy()
    s[2] += h
    up = M.Group(s, g.target, g.left, g.right, g.n)
    c2, a2 = up.moments()
    assert (M.likelihood(up, (s - c2) / a2, 0.3, 0.05).nll - f.nll) / h == pytest.approx(grad[2], rel=1e-3)


def test_fit_is_a_stationary_optimum():
    g = group(9, 8, 5)
    r = M.fit_group(g)
    c, a = g.moments()
    x = (g.distance - c) / a
    at = lambda u, d: dense_nll(g, x, u, d)[0]
    u, d = r["unit_variance"], r["residual_variance"] + r["jitter"]
    assert -r["ml_log_likelihood"] == pytest.approx(at(u, d), abs=1e-8)
    for du, dd in ((1.01, 1), (0.99, 1), (1, 1.01), (1, 0.99)):
        assert at(u * du, d * dd) >= at(u, d) - 1e-9
    with pytest.raises(M.MLPEError):
        M.fit_group(M.Group(g.distance[:2], g.target[:2], g.left[:2], g.right[:2], g.n))
    with pytest.raises(M.MLPEError):
        M.fit_group(M.Group(np.ones(6), np.arange(6.0), np.arange(6), np.arange(6) + 1, 7))


def test_complete_sets_agree_with_the_kernel(spark):
    _, units, obs = make(spark, (5, 5), 6, seed=3)
    pairs = obs.withColumn("distance", F.abs(F.sin(F.xxhash64("left", "right").cast("double")))).withColumn("target", F.log1p("value"))
    a = M.nll_complete(pairs, 0.2, 0.07).first()
    b = M.nll_at(pairs, 0.2, 0.07).first()
    assert (a.nll, a.intercept, a.slope) == (pytest.approx(b.nll), pytest.approx(b.intercept), pytest.approx(b.slope))
    assert abs(b.sum_w) < 1e-9 and abs(b.sum_wx) < 1e-9
    fit = M.fit_mlpe(pairs).first()
    assert fit.converged and fit.ml_log_likelihood >= -b.nll and fit.population_ids == [f"u{i}" for i in range(6)]


def test_support_is_the_joint_gaussian():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(4, 4))
    cov, mean, left, right = a @ a.T + np.eye(4), rng.normal(size=4), np.array([0, 1, 2]), np.array([1, 3, 3])
    z = np.zeros((3, 4))
    z[np.arange(3), left] = z[np.arange(3), right] = 1
    r, noise = rng.normal(size=3), 0.3
    s = z @ cov @ z.T + noise * np.eye(3)
    m, c = M.condition(mean, cov, left, right, r, noise)
    np.testing.assert_allclose(m, mean + cov @ z.T @ np.linalg.solve(s, r - z @ mean))
    np.testing.assert_allclose(c, cov - cov @ z.T @ np.linalg.solve(s, z @ cov), atol=1e-12)


SNAPS = [
    ("down", [25.0, 15.0, 5.0], [(5, 25, 0, 0), (35, 5, 2, 3), (10, 25, 0, 1), (10, 20, 1, 1), (40, 0, 2, 3), (41, 5, 2, None), (5, 31, None, 0)]),
    ("up", [5.0, 15.0, 25.0], [(5, 25, 2, 0), (0, 30, 2, 0), (10, 10, 1, 1)]),
]


@pytest.mark.parametrize(("name", "rows", "points"), SNAPS)
def test_snapping(spark, name, rows, points):
    ticks = [("r", "row", i, v) for i, v in enumerate(rows)] + [("r", "column", i, v) for i, v in enumerate([5.0, 15.0, 25.0, 35.0])]
    t = spark.createDataFrame(ticks, "region string, dim string, idx int, center double")
    p = spark.createDataFrame([("r", str(i), float(x), float(y)) for i, (x, y, _, _) in enumerate(points)], "region string, unit string, x double, y double")
    got = {r.unit: (r.row, r.col) for r in A.snap_points(p, t).collect()}
    assert got == {str(i): (r, c) for i, (_, _, r, c) in enumerate(points)}


def test_pairs_keep_their_direction_but_match_either_way(spark):
    o = spark.createDataFrame([("r", None, "b", "a", 1.0), ("r", "s", "a", "c", 2.0)], "region string, species string, left string, right string, value double")
    w = spark.createDataFrame([("r", None, "a", "b"), ("r", "s", "c", "d")], "region string, species string, left string, right string")
    assert [(r.left, r.right) for r in A.select_pairs(o, w.where("left = 'a'")).collect()] == [("b", "a")]
    with pytest.raises(ValueError, match="c-d"):
        A.select_pairs(o, w)
    assert [(r.left, r.right) for r in A.missing_pairs(o, w).collect()] == [("c", "d")]


def test_targets_guard_their_domains(spark):
    df = spark.createDataFrame([(0.5,), (None,)], "v double")
    for t in ("identity", "log1p", "sqrt", "odds"):
        s = TargetSpec("x", transform=t)
        back = [r[0] for r in df.select(s.inverse(s.forward(F.col("v")))).collect()]
        assert back == [pytest.approx(0.5), None]
    for t, v in (("log1p", -0.1), ("odds", 1.0), ("sqrt", float("nan"))):
        with pytest.raises(Exception, match="outside the domain"):
            spark.createDataFrame([(v,)], "v double").select(TargetSpec("x", transform=t).forward(F.col("v"))).collect()
    with pytest.raises(ValueError):
        TargetSpec("x", kind="nearness")


def test_loglinear_surface_and_its_pull_back(spark):
    m = D.LogLinear(patch_size=2, beta=((0.5, 2.0),), bias=(0.3,), lowest=0.25, highest=5.0)
    p, x = m.params(), np.random.default_rng(0).normal(size=(5, 2))
    c, back = m.local(p, 0, x)
    g = back(np.arange(1.0, 6.0))
    for k, at in (("beta", (0, 1)), ("bias", (0,))):
        q = {n: v.copy() for n, v in p.items()}
        q[k][at] += 1e-6
        assert (np.arange(1.0, 6.0) @ (m.local(q, 0, x)[0] - c)) / 1e-6 == pytest.approx(g[k][at], rel=1e-4, abs=1e-6)
    df = spark.createDataFrame([(float(v),) for v in (-800, -2, 0, 1, 2, 800)], "e double")
    got = [r[0] for r in df.select(C.loglinear_conductance(F.col("e"), 0.25, 5.0)).collect()]
    assert all(0.25 <= v <= 5.0 for v in got) and got == sorted(got)


def test_training_lowers_the_loss_resumes_and_matches_adam(spark):
    cells, units, obs = make(spark, (4, 4), 5, seed=6)
    pairs = A.align_observations(obs, units)
    m = D.LogLinear(patch_size=2, beta=((0.2, -0.1),), bias=(0.3,))
    for loss in ("log1p", "mlpe"):
        whole = T.TrainingConfig(loss=loss, steps=4, eval_every=1, optimizer=T.Adam(0.02))
        _, one = T.train(cells, pairs, m, PLAIN, whole)
        _, half = T.train(cells, pairs, m, PLAIN, T.TrainingConfig(loss=loss, steps=2, eval_every=1, optimizer=T.Adam(0.02)))
        _, two = T.train(cells, pairs, m, PLAIN, whole, state=half)
        np.testing.assert_allclose(one.params["beta"], two.params["beta"], rtol=1e-9)
        losses = [v for _, s, scope, _, v in one.history if scope == "all"]
        assert losses[-1] < losses[0] and len(losses) == 5


def test_training_gradient(spark):
    cells, units, obs = make(spark, (4, 4), 5, seed=7)
    m = D.LogLinear(patch_size=2, beta=((0.2, -0.1),), bias=(0.3,))
    packed = T.pack(cells, A.align_observations(obs, units), m, PLAIN)
    for loss in ("log1p", "mlpe"):
        p = m.params() | ({"variance|valley|0": np.array([-1.0, -2.0])} if loss == "mlpe" else {})
        w = {("valley", 0): 1.0}
        _, g = T.evaluate(packed, m, loss, p, w, True)
        for k in p:
            q = {n: v.copy() for n, v in p.items()}
            at = (0,) * q[k].ndim
            q[k][at] += 1e-5
            up = T.evaluate(packed, m, loss, q, w, False)[0][0][2]
            q[k][at] -= 2e-5
            down = T.evaluate(packed, m, loss, q, w, False)[0][0][2]
            assert (up - down) / 2e-5 == pytest.approx(g[k][at], rel=1e-3, abs=1e-8), (loss, k)


def test_training_refuses_shared_pairs_and_other_settings(spark):
    cells, units, obs = make(spark, (4, 4), 4)
    pairs = A.align_observations(obs, units)
    m = D.LogLinear(patch_size=2, beta=((0.2, -0.1),), bias=(0.3,))
    with pytest.raises(ValueError, match="share pairs"):
        T.train(cells, pairs, m, PLAIN, T.TrainingConfig(steps=1), validation=pairs)
    with pytest.raises(ValueError):
        T.TrainingConfig(steps=-1)
    with pytest.raises(ValueError, match="dissimilarities"):
        T.train(cells, pairs, m, TargetSpec("k", kind="relatedness"), T.TrainingConfig(steps=1))


def test_optimizers_reach_a_bowl():
    f = lambda p: float(((p["a"] - 3) ** 2).sum())
    for opt, steps in ((T.Adam(0.3), 300), (T.Descent(0.1), 200), (T.LBFGS(), 20)):
        p = {"a": np.zeros(2)}
        s = opt.start(p)
        for _ in range(steps):
            p, s = opt.update(p, {"a": 2 * (p["a"] - 3)}, s, f(p), f)
        assert f(p) < 1e-4


def test_uniform_conductance(spark):
    rows = [(r, r / 2.5, 0.25) for r in (1.0, 2.0, 3.0, 4.0)]
    g, loss = T.uniform_conductance(spark.createDataFrame(rows, "resistance double, target double, weight double"), 0.01, 1000.0, refine=25)
    assert g == pytest.approx(2.5, rel=1e-3) and loss < 1e-6
    assert T.uncap(2.0, 0.01, 1000.0) == pytest.approx(math.log(1.99), abs=1e-6)


def test_model_round_trip_predictions_and_ensemble(spark, tmp_path):
    from gridkin.sources.store import ArtifactError, load_model, save_model

    cells, units, obs = make(spark, (6, 6), 6, seed=11)
    pairs = A.align_observations(obs, units)
    model = K.fit_head(cells, units, pairs, D.StraightLine(patch_size=1, slope=(0.3,), intercept=(0.1,)), PLAIN)
    value = {(r.left, r.right): r.value for r in model.predict(cells, units).collect()}
    assert len(value) == 15
    known = model.predict(cells, units, known_effects=True).collect()
    assert all(r.model_variance > r.effect_variance >= 0 for r in known)
    both = K.Ensemble((model, model)).predict(cells, units)
    assert all(r.value == pytest.approx(value[r.left, r.right]) and r.spread < 1e-9 for r in both.collect())
    with pytest.raises(K.PredictionError):
        K.Ensemble(())
    m = K.GeneticsModel(D.LogLinear(patch_size=2, beta=((0.5, 1.0),), bias=(0.1,)), PLAIN, ("x", "y"), model.calibrations)
    path = str(tmp_path / "model")
    save_model(spark, path, m)
    save_model(spark, path, m)
    back = load_model(spark, path, D.LogLinear(patch_size=2, beta=((0.0, 0.0),), bias=(0.0,)))
    assert back.distance.beta == ((0.5, 1.0),) and back.features == ("x", "y") and not back.calibrations.first().converged
    with pytest.raises(ArtifactError):
        load_model(spark, str(tmp_path / "none"), m.distance)


def test_as_matrix(spark):
    _, units, obs = make(spark, (3, 3), 3)
    got = {(r.left, r.right): r.value for r in K.as_matrix(obs.where("right <> 'u2'"), units).collect()}
    assert len(got) == 9 and got["u0", "u1"] == got["u1", "u0"] and math.isnan(got["u0", "u0"]) and math.isnan(got["u0", "u2"])


def test_networks():
    assert N.count(N.ResNet9.random(3).layers) == 741_761 - 257  # the rest is the head of one species
    net = N.ResNet9.random(2, (8, 8, 16))
    assert net(np.random.default_rng(0).normal(size=(3, 2, 6, 6))).shape == (3, 16)
    with pytest.raises(ValueError):
        net(np.zeros((1, 2, 3, 3)))
    u = N.UNet.random(2, 2, 8, 6)
    for shape in ((5, 7), (8, 8), (1, 2)):
        assert u(np.zeros((1, 8, *shape))).shape == (1, 6, *shape)
    assert (N.dropout_mask((2, 4), 0.5, None) == 1).all() and set(np.unique(N.dropout_mask((20, 40), 0.5, 1))) == {0.0, 2.0}


def test_wishart():
    rng = np.random.default_rng(5)
    n, markers = 5, 17
    root = rng.normal(size=(n, n)) * 0.3 + np.eye(n)
    cov = root @ root.T
    y = root @ rng.normal(size=(n, markers))
    d = ((y[:, None] - y[None]) ** 2).sum(2)
    h = W.helmert(n)
    np.testing.assert_allclose(h @ h.T, np.eye(n - 1), atol=1e-12)
    np.testing.assert_allclose(W.scatter_matrix(d, markers), h @ y @ y.T @ h.T, atol=1e-9)
    # one contrast: a scaled chi-square
    s, v, k = 2.9, 0.8, 9
    chi = (k / 2 - 1) * math.log(s / v) - s / v / 2 - k / 2 * math.log(2) - math.lgamma(k / 2) - math.log(v)
    assert W.log_density(np.array([[s]]), np.array([[v]]), k) == pytest.approx(chi)
    shift = n * (n - 1) / 2 * math.log(markers)
    assert W.log_likelihood(d / markers, cov, markers, averaged=True) == pytest.approx(W.log_likelihood(d, cov, markers) + shift)
    assert math.isfinite(W.held_out(d, cov, markers, [0, 1, 3]))
    record = W.held_out_record(d, cov, markers, [3, 0, 1], anchor=0)
    assert record["held"] == [2, 4] and record["conditional"] == pytest.approx(record["joint"] - record["training"])
    # contrasts of one kind differ from those of another by a constant factor alone
    other = W.held_out_record(d, 2 * cov, markers, [3, 0, 1], anchor=1)["conditional"] - W.held_out_record(d, cov, markers, [3, 0, 1], anchor=1)["conditional"]
    assert other == pytest.approx(W.held_out(d, 2 * cov, markers, [3, 0, 1]) - W.held_out(d, cov, markers, [3, 0, 1]))
    with pytest.raises(W.WishartError):
        W.held_out_record(d, cov, markers, [0, 1], anchor=2)
    far = np.abs(np.subtract.outer(range(n), range(n))) * 1.0
    assert W.graph_diagnostic(d, far, markers, 1.0, 0.5)["decision"] == "no_go"
    with pytest.raises(W.WishartError):
        W.scatter_matrix(d, n - 2)
    with pytest.raises(W.WishartError):  # all populations alike: the scatter is singular
        W.log_likelihood(np.zeros((4, 4)), np.eye(4), 9)
