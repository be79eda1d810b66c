"""What models, training, heads and storage promise and refuse."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridkin.functions.targets import TargetSpec
from gridkin.operators import alignment as A
from gridkin.operators import calibration as K
from gridkin.operators import mlpe as M
from gridkin.operators import models as D
from gridkin.operators import networks as N
from gridkin.operators import resistance as R
from gridkin.operators import training as T
from gridkin.sources import store

PLAIN = TargetSpec("d")


def landscape(spark, rows=8, cols=8, species=(None,), seed=3):
    """One region with two features, eight units of each species, and all pairs."""
    rng = np.random.default_rng(seed)
    x = rng.uniform(0.2, 1.5, (rows, cols, 2))
    cells = spark.createDataFrame([("r", i, j, x[i, j].tolist()) for i in range(rows) for j in range(cols)], "region string, row int, col int, features array<double>")
    places = [(0, 0), (0, 5), (2, 2), (3, 7), (5, 1), (6, 6), (7, 3), (4, 4)]
    units = spark.createDataFrame([("r", s, f"u{k}", k, a % rows, b % cols) for s in species for k, (a, b) in enumerate(places)], "region string, species string, unit string, unit_ord int, row int, col int")
    pairs = A.unit_pairs(units).withColumn("value", F.lit(0.2) + (F.col("left_ord") * 3 + F.col("right_ord") * 5) % 7 / 10.0)
    return cells, units, pairs


MODELS = {
    "line": lambda: D.StraightLine(patch_size=2, slope=(0.4,), intercept=(0.1,)),
    "loglinear": lambda: D.LogLinear(patch_size=2, beta=((0.3, -0.2),), bias=(0.1,)),
    "resnet": lambda: D.NetworkConductance(patch_size=4, encoder=N.ResNet9.random(2, (8, 8, 8), seed=4), head=((0.2,) * 8,), bias=(0.3,)),
    "unet": lambda: N.UNetEmbedding(patch_size=2, network=N.UNet.random(2, 2, 8, 4, seed=6)),
}


@pytest.mark.parametrize("name", MODELS)
@pytest.mark.parametrize("loss", ["log1p", "mlpe"])
def test_gradient_of_every_model(spark, name, loss):
    cells, units, pairs = landscape(spark)
    model = MODELS[name]()
    if name == "resnet":  # units of a patch share a vertex: distances of 0 stay
        pairs = pairs.where("left_ord < 7")
    packed = T.pack(cells, pairs, model, PLAIN)
    region, s, payload = T._over_groups(packed, None, lambda r, s, p: p)[0]
    p = {k: v + 0.3 if k.endswith("shift") else v for k, v in model.params().items()}  # away from the kink of the rectifier
    if loss == "mlpe":
        p["variance|r|0"] = np.array([-1.0, -0.5])
    how = T.loss_of(loss)
    value = lambda q: T.group_loss(model, how, q, region, s, payload)[0]
    _, g = T.group_loss(model, how, p, region, s, payload)
    rng = np.random.default_rng(0)
    for k, v in p.items():
        at = tuple(rng.integers(0, n) for n in v.shape)
        up, down = ({n: x.copy() for n, x in p.items()} for _ in range(2))
        up[k][at] += 1e-5
        down[k][at] -= 1e-5
        assert (value(up) - value(down)) / 2e-5 == pytest.approx(g[k][at], rel=2e-3, abs=2e-6), k


@pytest.mark.parametrize("name", MODELS)
def test_models_come_back_whole(spark, tmp_path, name):
    cells, units, _ = landscape(spark)
    model = K.GeneticsModel(MODELS[name](), PLAIN, ("a", "b"))
    store.save_model(spark, str(tmp_path / "m"), model)
    blank = model.distance.with_params({k: np.zeros_like(v) for k, v in model.distance.params().items()})
    back = store.load_model(spark, str(tmp_path / "m"), blank)
    for k, v in model.distance.params().items():
        np.testing.assert_array_equal(v, back.distance.params()[k])
    assert back.features == ("a", "b") and back.target == PLAIN
    other = MODELS["line" if name != "line" else "loglinear"]()
    with pytest.raises(store.ArtifactError):
        store.load_model(spark, str(tmp_path / "m"), other)


def test_models_without_parameters_are_refused(spark, tmp_path):
    class Own(D.DistanceModel):
        def pair_distances(self, cells, units, pairs):
            return pairs.withColumn("distance", F.lit(1.0))

    with pytest.raises(D.ModelError):
        store.save_model(spark, str(tmp_path / "m"), K.GeneticsModel(Own(), PLAIN))
    cells, units, pairs = landscape(spark)
    with pytest.raises(D.ModelError):
        T.train(cells, pairs, Own(), PLAIN, T.TrainingConfig(steps=1))


def test_solvers_agree_and_gradients_read_terminals():
    rng = np.random.default_rng(1)
    surface = rng.uniform(0.5, 3.0, (6, 9))
    nodes = np.array([[0, 0], [5, 8], [2, 3], [2, 3], [4, 1]])
    want = R.dense_solver(surface, nodes)
    for solver in (R.block_solver, R.cg_solver, R.default_solver):
        np.testing.assert_allclose(solver(surface, nodes), want, atol=1e-8)
    left, right, w = np.array([0, 0, 53]), np.array([53, 21, 21]), np.array([1.0, -0.5, 2.0])
    g = R.adjoint(surface, left, right, w)

    def total(c):
        r = R.block_solver(c, np.stack(np.divmod(np.array([0, 53, 21]), 9), 1))
        return w @ np.array([r[0, 1], r[0, 2], r[1, 2]])

    for at in ((0, 0), (3, 4), (5, 8)):
        up, down = surface.copy(), surface.copy()
        up[at] += 1e-5
        down[at] -= 1e-5
        assert (total(up) - total(down)) / 2e-5 == pytest.approx(g[at], abs=1e-6)
    with pytest.raises(R.ResistanceError):
        R.cg_solver(-surface, nodes)


def test_training_leaves_a_model_that_predicts(spark):
    cells, units, pairs = landscape(spark)
    model = MODELS["line"]()
    config = T.TrainingConfig(loss="mlpe", steps=3, eval_every=1, optimizer=T.Adam(0.02))
    _, units2, _ = landscape(spark)
    more = units2.union(spark.createDataFrame([("r", None, "late", 8, 1, 1)], units2.schema))
    done, state = T.train(cells, pairs.where("left_ord < 5"), model, PLAIN, config, units=more)
    trained = T.trained(spark, done, state, PLAIN, pairs=pairs.where("left_ord < 5"))
    c = trained.calibrations.collect()
    assert len(c) == 1 and not c[0].converged and c[0].population_ids == [f"u{k}" for k in range(8)] + ["late"]
    assert trained.predict(cells, more, known_effects=True).count() == 36
    query, seen = pairs.where("left = 'u5' and right = 'u6'"), pairs.where("left = 'u5' and right = 'u7'")
    assert trained.predict(cells, more, query, support=seen).count() == 1
    with pytest.raises(K.PredictionError):  # a pair of the calibration
        trained.predict(cells, more, query, support=pairs.where("left = 'u0' and right = 'u1'"))
    with pytest.raises(K.PredictionError):
        trained.predict(cells, more, query, support=query)
    assert isinstance(trained.head, K.MLPEHead) and isinstance(K.GeneticsModel(done, PLAIN).head, K.DirectHead)


def test_training_refuses_what_it_cannot_take(spark):
    cells, units, pairs = landscape(spark)
    model, config = MODELS["line"](), T.TrainingConfig(steps=1, optimizer=T.Adam(0.01))
    with pytest.raises(D.ModelError, match="not both"):
        T.train(cells, pairs.withColumn("region", F.lit("elsewhere")), model, PLAIN, config)
    with pytest.raises(D.ModelError, match="drop"):
        T.train(cells.where("row < 7"), pairs, model, PLAIN, config)
    with pytest.raises(K.PredictionError, match="individuals"):
        T.train(cells, pairs, model, PLAIN, T.TrainingConfig(loss="mlpe", steps=1), units=units.withColumn("individual_based", F.lit(True)))
    _, state = T.train(cells, pairs, model, PLAIN, config)
    from dataclasses import replace

    with pytest.raises(ValueError, match="parameters"):
        T.train(cells, pairs, model, PLAIN, config, state=replace(state, params={"slope": np.zeros(2), "intercept": np.zeros(1)}))
    with pytest.raises(ValueError, match="optimizer"):
        T.train(cells, pairs, model, PLAIN, config, state=replace(state, optimizer={"t": 0}))
    for wrong in (lambda: T.Adam(-1.0), lambda: T.Adam(1.0, decay=-1.0), lambda: T.Descent(0.0), lambda: T.LBFGS(0), lambda: T.ridge({}, -1.0)):
        with pytest.raises(ValueError):
            wrong()


def test_line_search_is_named(spark):
    cells, units, pairs = landscape(spark)

    class Sour(D.StraightLine):
        def kernel(self, p, s, shape, x, left, right, seed=None):
            if p["slope"][0] != 0.4:
                raise ValueError("sour")
            return super().kernel(p, s, shape, x, left, right, seed)

    with pytest.raises(Exception) as e:
        T.train(cells, pairs, Sour(patch_size=2, slope=(0.4,), intercept=(0.1,)), PLAIN, T.TrainingConfig(steps=1, optimizer=T.LBFGS()))
    assert e.value.__notes__ == ["in the line search", "in update 1"]


def test_queries_are_resolved_or_refused(spark):
    cells, units, pairs = landscape(spark, species=("a", "b"))
    m = K.GeneticsModel(D.StraightLine(species=("a", "b"), slope=(1.0, 2.0), intercept=(0.0, 0.0)), PLAIN, ("f", "g"))
    assert m.predict(cells, units, ["b"]).select("species").distinct().collect()[0][0] == "b"
    assert m.predict(cells, units, {"a": None}).count() == 28
    one = spark.createDataFrame([("r", "u1", "u0")], "region string, left string, right string")
    got = m.predict(cells, units, {"b": one}).collect()
    assert len(got) == 1 and (got[0].left, got[0].right, got[0].value) == ("u1", "u0", 10.0)
    for query in ({"c": None}, ["c"], {}, {"a": one.withColumn("left", F.lit("nobody"))}, pairs.withColumn("species", F.lit("c"))):
        with pytest.raises(D.ModelError):
            m.predict(cells, units, query)
    with pytest.raises(K.PredictionError):
        m.predict(cells, units, features=["g", "f"])
    assert m.predict(cells, units, ["a"], features=["f", "g"]).count() == 28
    with pytest.raises(ValueError):
        A.select_pairs(pairs, one.withColumn("species", F.lit("c")))
    with pytest.raises(ValueError):
        A.species_units(units.where("unit = 'u0'"), "a")
    assert A.species_units(units, "a").count() == 8
    both = K.Ensemble((m, m))
    with pytest.raises(D.ModelError) as e:
        both.predict(cells, units, ["c"])
    assert "in member 0" in e.value.__notes__


def test_groups_need_calibrations(spark):
    cells, units, pairs = landscape(spark, species=("a", "b"))
    line = D.StraightLine(species=("a", "b"), slope=(1.0, 2.0), intercept=(0.0, 0.0))
    fitted = K.fit_head(cells, units.where("species = 'a'"), pairs.where("species = 'a'"), line, PLAIN)
    assert fitted.predict(cells, units, ["a"]).count() == 28
    with pytest.raises(Exception, match="no calibration"):
        fitted.predict(cells, units, ["b"]).collect()
    ask, give = pairs.where("species = 'a' and left = 'u0'"), pairs.where("species = 'b' and left = 'u1'")
    with pytest.raises(K.PredictionError, match="different species"):
        fitted.predict(cells, units, ask, support=give)
    with pytest.raises(K.PredictionError):
        K.fit_head(cells, units.withColumn("individual_based", F.lit(True)), pairs, line, PLAIN)
    assert M.calibration_pairs(fitted.calibrations).count() == 28


def test_missing_species_is_not_an_empty_name(spark):
    rows = spark.createDataFrame([("x", None), ("x", ""), ("y", None)], "region string, species string")
    got = {(r.region, r.species): r.weight for r in T.loss_weights(rows).collect()}
    assert got == {("x", None): 0.25, ("x", ""): 0.5, ("y", None): 0.25}


def test_uniform_start_of_each_species(spark):
    cells, units, pairs = landscape(spark, species=("a", "b"))
    m = D.LogLinear(species=("a", "b"), patch_size=2, beta=((1.0, 1.0), (1.0, 1.0)), bias=(0.0, 0.5), lowest=0.01, highest=100.0)
    start = T.initialize_uniform_conductance(m, cells, units, pairs, PLAIN)
    assert start.beta == ((0.0, 0.0), (0.0, 0.0)) and start.bias[0] == pytest.approx(start.bias[1], abs=1e-6)
    assert T.initialize_uniform_conductance(m, cells, units, pairs, PLAIN, loss="mlpe").bias == (0.0, 0.5)

    def loss(bias):
        own = D.LogLinear(species=("a", "b"), patch_size=2, beta=start.beta, bias=(bias, bias), lowest=0.01, highest=100.0)
        d = own.distances(cells, units, pairs)
        return T.group_losses(A.join_groups(d, pairs.select("region", "species", "left", "right", "value"), ("left", "right")), PLAIN).agg(F.sum("loss")).first()[0]

    best = loss(start.bias[0])
    assert best < loss(start.bias[0] + 0.05) and best < loss(start.bias[0] - 0.05)


def test_folds(spark):
    labels = spark.createDataFrame([(f"n{i}",) for i in range(10)] * 2, "label string")
    got = A.folds(labels, 3, seed=1).collect()
    assert len(got) == 10 and sorted(sum(r.fold == k for r in got) for k in range(3)) == [3, 3, 4]
    with pytest.raises(ValueError):
        A.folds(labels, 1)


def test_groups_without_weight_are_not_solved(spark):
    cells, units, pairs = landscape(spark)

    class Sour(D.StraightLine):
        def kernel(self, p, s, shape, x, left, right, seed=None):
            raise AssertionError("solved")

    model = Sour(patch_size=2, slope=(0.4,), intercept=(0.1,))
    packed = T.pack(cells, pairs, model, PLAIN)
    losses, g = T.evaluate(packed, model, "log1p", model.params(), {("r", 0): 0.0}, True)
    assert losses == [] and all((v == 0).all() for v in g.values())


def test_batches_and_callbacks(spark):
    cells, units, pairs = landscape(spark)
    both = cells.union(cells.withColumn("region", F.lit("q")))
    observed = pairs.union(pairs.withColumn("region", F.lit("q")).withColumn("value", F.col("value") * 2))
    seen, model = [], MODELS["line"]()
    config = T.TrainingConfig(steps=4, eval_every=2, region_batch=1, optimizer=T.Descent(0.001), seed=5)
    _, state = T.train(both, observed, model, PLAIN, config, on_step=lambda s: seen.append(s.step))
    _, again = T.train(both, observed, model, PLAIN, config)
    assert seen == [0, 1, 2, 3, 4] and state.groups == (("q", 0), ("r", 0))
    np.testing.assert_array_equal(state.params["slope"], again.params["slope"])
    assert [r[0] for r in state.history if r[2] == "all"] == [0, 2, 4]
    done, still = T.train(both, observed, model, PLAIN, T.TrainingConfig(steps=9, tolerance=1e9))
    assert still.converged and still.step == 0 and done.slope == model.slope


def shuffled(spark, df):
    """Bytes that are written to shuffles until df has run."""
    sc = spark.sparkContext._jsc.sc()

    def written():
        sc.listenerBus().waitUntilEmpty()
        found = sc.statusStore().executorList(False)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))

    before = written()
    df.write.format("noop").mode("overwrite").save()
    return written() - before


class Given(D.EmbeddingModel):
    def embedding(self, cells, units):
        return units.select("region", "species", "unit", "vector")


def test_embedding_distances_move_no_vector_for_each_pair(spark):
    rng = np.random.default_rng(2)
    rows = [("r", None, f"u{i}", i, 0, 0, rng.normal(size=4).tolist()) for i in range(800)]
    units = spark.createDataFrame(rows, "region string, species string, unit string, unit_ord int, row int, col int, vector array<double>")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as for tables that are large
    try:
        out = Given().distances(units, units)
        assert out.count() == 800 * 799 // 2
        assert 0 < shuffled(spark, out) < 1_000_000  # 3 bytes a pair
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_embedding_distances_of_all_pairs_are_those_of_listed_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [
        (f"r{i % 2}", ("a", "b", "c")[i % 3], f"u{i}", i // 2 if i < 20 else i, 0, 0, (rng.normal(size=(5, 5, 5, 3)[i % 4] if i > 40 else 5)).tolist())
        for i in range(80)
    ]  # some units share an order, and have no pair; some vectors are of another length
    odd = [("r0", "a", "n0", 900, 0, 0, None), ("r0", "a", "n1", 901, 0, 0, [1.0, None, 2.0, 3.0, 4.0]), ("r0", "a", "n2", 902, 0, 0, [float("nan")] * 5), ("r0", "a", "n3", None, 0, 0, [1.0] * 5), ("r0", "a", "n4", 903, 0, 0, [])]
    units = spark.createDataFrame(rows + odd, "region string, species string, unit string, unit_ord int, row int, col int, vector array<double>")
    for m, own in ((Given(species=("a", "b")), units), (Given(), units.withColumn("species", F.when(F.col("species") != "b", F.col("species"))))):
        listed = m.distances(own, own, A.unit_pairs(m.known(own)))
        all_ = m.distances(own, own)
        assert [(f.name, f.dataType) for f in all_.schema] == [(f.name, f.dataType) for f in listed.schema]
        assert sorted(map(str, all_.collect())) == sorted(map(str, listed.collect()))
    assert Given().distances(units.limit(0), units.limit(0)).count() == 0
