"""Training distance models: a driver loop over distributed gradients.

The landscape and pairs of a region are packed into one row and kept; each update sends the
parameters to the regions, whose kernels return loss and gradient summed by task. The driver holds
parameters, and a few numbers for each region and species; rasters and pairs stay where they are.
Models and losses bring their own derivatives (see models.DistanceModel.kernel, losses.Loss).
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridkin.functions.targets import TargetSpec
from gridkin.operators import mlpe
from gridkin.operators.alignment import unmatched_regions
from gridkin.operators.calibration import GeneticsModel, refuse_individuals
from gridkin.operators.losses import LOSSES, Loss, loss_of, start_variances
from gridkin.operators.models import DistanceModel, LogLinear, ModelError
from gridkin.operators.resistance import unit_resistances

Params = dict[str, np.ndarray]
#: Value and gradient of a penalty on the parameters.
Penalty = Callable[[Params], tuple[float, Params]]


class Adam:
    """Adam, or AdamW with a weight decay."""

    def __init__(self, rate: float = 1e-3, decay: float = 0.0, b1: float = 0.9, b2: float = 0.999, eps: float = 1e-8):
        if not (rate > 0 and math.isfinite(rate) and decay >= 0 and 0 <= b1 < 1 and 0 <= b2 < 1 and eps > 0):
            raise ValueError("rate and eps must be above 0, decay 0 or more, and b1 and b2 from 0 to below 1")
        self.rate, self.decay, self.b1, self.b2, self.eps = rate, decay, b1, b2, eps

    def start(self, p: Params) -> dict:
        return {"t": 0, "m": {k: np.zeros_like(v) for k, v in p.items()}, "v": {k: np.zeros_like(v) for k, v in p.items()}}

    def update(self, p: Params, g: Params, state: dict, value: float, value_fn: Callable[[Params], float]) -> tuple[Params, dict]:
        t = state["t"] + 1
        m = {k: self.b1 * state["m"][k] + (1 - self.b1) * g[k] for k in p}
        v = {k: self.b2 * state["v"][k] + (1 - self.b2) * g[k] ** 2 for k in p}
        new = {
            k: p[k] - self.rate * (m[k] / (1 - self.b1**t) / (np.sqrt(v[k] / (1 - self.b2**t)) + self.eps) + self.decay * p[k])
            for k in p
        }
        return new, {"t": t, "m": m, "v": v}


class Descent:
    """Gradient descent with a fixed rate."""

    def __init__(self, rate: float = 1e-2):
        if not (rate > 0 and math.isfinite(rate)):
            raise ValueError("rate must be above 0")
        self.rate = rate

    def start(self, p: Params) -> dict:
        return {}

    def update(self, p: Params, g: Params, state: dict, value: float, value_fn: Callable[[Params], float]) -> tuple[Params, dict]:
        return {k: p[k] - self.rate * g[k] for k in p}, state


class LBFGS:
    """Limited-memory quasi-Newton steps with a backtracking line search on the same sample."""

    def __init__(self, memory: int = 8, halvings: int = 20):
        if memory < 1 or halvings < 1:
            raise ValueError("memory and halvings must be 1 or more")
        self.memory, self.halvings = memory, halvings

    def start(self, p: Params) -> dict:
        return {"pairs": [], "last": None}

    def update(self, p: Params, g: Params, state: dict, value: float, value_fn: Callable[[Params], float]) -> tuple[Params, dict]:
        names = sorted(p)
        flat = lambda d: np.concatenate([np.ravel(d[k]) for k in names])
        x, q, pairs = flat(p), flat(g), list(state["pairs"])
        if state["last"] is not None:
            s, y = x - state["last"][0], q - state["last"][1]
            if s @ y > 1e-12:
                pairs = [*pairs, (s, y)][-self.memory :]
        d, kept = q.copy(), []
        for s, y in reversed(pairs):
            a = (s @ d) / (s @ y)
            d -= a * y
            kept.append(a)
        d *= (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1]) if pairs else 1.0 / max(1.0, np.linalg.norm(q))
        for (s, y), a in zip(pairs, reversed(kept), strict=True):
            d += s * (a - (y @ d) / (s @ y))

        def at(size: float) -> Params:
            out, i = {}, 0
            for k in names:
                out[k] = (x - size * d)[i : i + p[k].size].reshape(p[k].shape)
                i += p[k].size
            return out

        size = 1.0
        for _ in range(self.halvings):
            if value_fn(at(size)) <= value - 1e-4 * size * (d @ q):
                return at(size), {"pairs": pairs, "last": (x, q)}
            size /= 2
        return p, {"pairs": [], "last": None}


Selector = Callable[[str], bool]


def ridge(centers: dict[str, float], deviations: dict[str, float] | float, where: str | tuple[str, ...] | Selector | None = None) -> Penalty:
    """Sum of (value - center) ** 2 / (2 deviation ** 2) over parameters.

    deviations: by name, or one for all that where names: a name, several, or a function of the name; a
    name stands for every parameter that begins with it and a dot, too.
    """
    if isinstance(deviations, dict):
        by_name = dict(deviations)
        chosen: Selector = by_name.__contains__
    else:
        names = (where,) if isinstance(where, str) else where
        chosen = names if callable(names) else (lambda k: names is None or any(k == n or k.startswith(f"{n}.") for n in names))
        by_name = {}
    every = list(by_name.values()) or [deviations]
    if any(s <= 0 or not math.isfinite(s) for s in every):
        raise ValueError("deviations must be finite and above 0")

    def penalty(p: Params) -> tuple[float, Params]:
        own = {k: by_name.get(k, deviations if not by_name else None) for k in p if chosen(k) and not k.startswith("variance|")}
        if not own:
            raise ValueError("the penalty is on no parameter")
        off = {k: p[k] - centers.get(k, 0.0) for k in own}
        value = sum(float((o**2).sum()) / (2 * own[k] ** 2) for k, o in off.items())
        return value, {k: off[k] / own[k] ** 2 if k in off else np.zeros_like(v) for k, v in p.items()}

    return penalty


@dataclass(frozen=True)
class TrainingConfig:
    """loss: log1p or mlpe. Batches sample regions, and species within them, without replacement."""

    loss: str = "log1p"
    steps: int = 100
    eval_every: int = 10
    tolerance: float = 0.0
    seed: int = 0
    region_batch: int | None = None
    species_batch: int | None = None
    optimizer: Adam | Descent | LBFGS = field(default_factory=Adam, compare=False)
    penalty: Penalty | None = None

    def __post_init__(self) -> None:
        if self.loss not in LOSSES:
            raise ValueError(f"loss must be one of {', '.join(LOSSES)}")
        if self.steps < 0 or self.eval_every < 1 or not 0 <= self.seed < 2**32 or not self.tolerance >= 0:
            raise ValueError("steps and tolerance must be 0 or more, eval_every 1 or more, seed below 2 ** 32")
        if any(b is not None and b < 1 for b in (self.region_batch, self.species_batch)):
            raise ValueError("batches must be 1 or more")


@dataclass(frozen=True)
class TrainingState:
    """What a later call continues from. history: (step, split, scope, key, loss) rows."""

    config: TrainingConfig
    step: int
    params: Params
    optimizer: dict
    groups: tuple
    history: tuple
    best: tuple[float, int, Params] | None
    converged: bool = False
    #: (region, species, calibration) of each group at the best parameters, for losses whose head has any.
    records: tuple = ()


def loss_weights(groups: DataFrame) -> DataFrame:
    """groups (region, species) with weight: 1 / (species in all * regions of the species)."""
    per = groups.groupBy(F.col("species").alias("_s")).agg(F.count(F.lit(1)).alias("_regions"))
    total = groups.agg(F.count_distinct(F.struct("species")).alias("_species"))  # a missing name counts as one of its own
    joined = groups.join(per, groups["species"].eqNullSafe(per["_s"])).join(F.broadcast(total))  # total: one row
    return joined.select("region", "species", (1.0 / (F.col("_species") * F.col("_regions"))).alias("weight"))


def group_losses(pairs: DataFrame, target: TargetSpec) -> DataFrame:
    """region, species, pairs, loss: the log1p loss of each group. pairs: region, species, distance, value."""
    off = F.log1p("distance") - F.log1p(target.forward(F.col("value")))
    return pairs.groupBy("region", "species").agg(F.count(F.lit(1)).alias("pairs"), F.avg(off * off).alias("loss"))


def history_rows(losses: DataFrame) -> DataFrame:
    """scope, key, loss: the weighted total (all), and the means of regions over species and of species over
    regions. losses: region, species, loss."""
    from gridkin.operators.alignment import join_groups

    total = join_groups(losses, loss_weights(losses.select("region", "species"))).agg(F.sum(F.col("weight") * F.col("loss")).alias("loss"))
    mean = lambda key: losses.groupBy(F.col(key).alias("key")).agg(F.avg("loss").alias("loss")).select(F.lit(key).alias("scope"), "key", "loss")
    return total.select(F.lit("all").alias("scope"), F.lit(None).cast("string").alias("key"), "loss").unionByName(mean("region")).unionByName(mean("species").where("key is not null"))


def selected_steps(history: DataFrame) -> DataFrame:
    """run, step, loss: the first step with the lowest loss of each run."""
    return history.groupBy("run").agg(F.min(F.struct("loss", "step")).alias("best")).select("run", "best.step", "best.loss")


def group_starts(pairs: DataFrame, target: TargetSpec) -> DataFrame:
    """region, species, unit, residual: the variances that a group of the MLPE loss starts with."""
    v = F.var_samp(target.forward(F.col("value")))
    one, two = start_variances(1.0)
    return pairs.groupBy("region", "species").agg(F.greatest(v * float(one), F.lit(1e-9)).alias("unit"), F.greatest(v * float(two), F.lit(1e-9)).alias("residual"))


def pack(cells: DataFrame, pairs: DataFrame, model: DistanceModel, target: TargetSpec, units: DataFrame | None = None) -> DataFrame:
    """A row for each region: region, payload (grid features, and left, right and target of each species' pairs).

    pairs: aligned observations (see align_observations()). units: those that a calibration lists, in
    unit order; the units of the pairs where none are given.
    """
    s = model.patch_size
    named = pairs if model.species == (None,) else pairs.withColumn("species", F.coalesce("species", F.lit(model.species[0] if len(model.species) == 1 else None)))
    own = named.select("region", "species", "left", "right", target.forward(F.col("value")).alias("target"), *(
        F.floor(F.col(f"{side}_{k}") / s).cast("int").alias(f"{side}_{k}") for side in ("left", "right") for k in ("row", "col")
    ))
    if units is not None:
        listed = F.transform(F.sort_array(F.collect_list(F.struct("unit_ord", "unit"))), lambda u: u["unit"])  # units of a group
        by = model.known(units).groupBy(F.col("region").alias("_r"), F.col("species").alias("_s")).agg(listed.alias("units"))
        own = own.join(by, (own["region"] == by["_r"]) & own["species"].eqNullSafe(by["_s"]), "left").drop("_r", "_s")
    else:
        own = own.withColumn("units", F.lit(None).cast("array<string>"))
    species = model.species

    def run(key: tuple, grid: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(grid) or not len(rows):
            raise ModelError(f"region {key[0]!r} has a raster or pairs, not both")
        shape = int(grid["row"].max()) + 1, int(grid["col"].max()) + 1
        if len(grid) != shape[0] * shape[1]:
            raise ModelError(f"region {key[0]!r}: the raster is not complete")
        x = np.zeros((shape[0] * shape[1], len(grid["features"].iloc[0])))
        x[grid["row"] * shape[1] + grid["col"]] = np.stack(grid["features"].to_numpy())
        parts = {}
        for name, of in rows.groupby("species", dropna=False):
            name = None if name is None or name != name else name
            if name not in species:
                raise ModelError(f"region {key[0]!r}: the model knows no species {name!r}")
            of = of.sort_values(["left", "right"])
            at = {side: (of[f"{side}_row"] * shape[1] + of[f"{side}_col"]).to_numpy(np.int64) for side in ("left", "right")}
            given = of["units"].iloc[0]
            ids = list(dict.fromkeys([*of["left"], *of["right"]])) if given is None else list(given)
            index = {u: i for i, u in enumerate(ids)}
            i, j = (of[k].map(index).to_numpy(np.int64) for k in ("left", "right"))
            parts[species.index(name)] = (at["left"], at["right"], of["target"].to_numpy(float), i, j, ids)
        return pd.DataFrame({"region": [key[0]], "payload": [pickle.dumps((shape, x, parts))]})

    return model.grid(cells).groupBy("region").cogroup(own.groupBy("region")).applyInPandas(run, "region string, payload binary")


def group_loss(model: DistanceModel, loss: Loss, p: Params, region: str, s: int, payload: tuple, fixed: tuple | None = None, seed: int | None = None) -> tuple[float, Params]:
    """Loss of a group and its gradient. fixed: what the loss says of the training group, for validation."""
    shape, x, parts = payload
    left, right, target, i, j, ids = parts[s]
    d, back = model.kernel(p, s, shape, x, left, right, seed)
    g, own = mlpe.Group(d, target, i, j, len(ids)), p.get(_name(region, s))
    if fixed is not None:
        return loss.held_out(g, fixed), {}
    value, by_distance, by_own = loss.value(g, own)
    out = back(by_distance)
    if by_own is not None:
        out[_name(region, s)] = by_own
    return value, out


def _name(region: str, s: int) -> str:
    return f"variance|{region}|{s}"


def _over_groups(packed: DataFrame, wanted, f: Callable[[str, int, tuple], object]) -> list[tuple]:
    """(region, species index, f of the group) of the wanted groups (all for None), sorted; f's results are a few
    numbers each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for region, data in zip(batch["region"], batch["payload"], strict=True):
                payload = pickle.loads(data)
                rows += [(region, s, f(region, s, payload)) for s in sorted(payload[2]) if wanted is None or (region, s) in wanted]
            yield pd.DataFrame({"rows": [pickle.dumps(rows)]})

    found = packed.mapInPandas(run, "rows binary").collect()
    return sorted((row for r in found for row in pickle.loads(bytes(r["rows"]))), key=lambda row: row[:2])


def evaluate(
    packed: DataFrame, model: DistanceModel, loss: str | Loss, p: Params, weights: dict, gradient: bool, fixed: dict | None = None, seed: int | None = None
) -> tuple[list, Params]:
    """(region, species index, loss) of the groups in weights, and the weighted gradient. Groups without
    weight are not solved; tasks add up their gradients before they leave."""
    how = loss_of(loss) if isinstance(loss, str) else loss
    shared = packed.sparkSession.sparkContext.broadcast((p, weights, fixed))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        params, wanted, held = shared.value
        total, rows = None, []
        for batch in batches:
            for region, data in zip(batch["region"], batch["payload"], strict=True):
                payload = pickle.loads(data)
                for s in sorted(payload[2]):
                    w = wanted.get((region, s), 0.0)
                    if not w:
                        continue
                    try:
                        value, g = group_loss(model, how, params, region, s, payload, held.get((region, s)) if held else None, seed)
                    except (ValueError, np.linalg.LinAlgError) as e:
                        raise ValueError(f"region {region!r}, species {model.species[s]!r}: {e}") from e
                    rows.append((region, s, value))
                    if gradient:
                        total = total or {}
                        for k, v in g.items():
                            total[k] = total.get(k, 0.0) + w * v
        if rows:
            yield pd.DataFrame({"rows": [pickle.dumps(rows)], "gradient": [pickle.dumps(total)]})

    losses, grad = [], {k: np.zeros_like(v) for k, v in p.items()}
    for r in packed.mapInPandas(run, "rows binary, gradient binary").collect():  # one row for each task
        losses += pickle.loads(bytes(r["rows"]))
        for k, v in (pickle.loads(bytes(r["gradient"])) or {}).items():
            grad[k] = grad[k] + v
    shared.destroy()
    return sorted(losses), grad


def _at_groups(packed: DataFrame, model: DistanceModel, p: Params, f: Callable[[mlpe.Group, np.ndarray | None, list], object]) -> list[tuple]:
    """f of the group's distances at p, its own parameters and its units, for every group."""

    def run(region: str, s: int, payload: tuple) -> object:
        shape, x, parts = payload
        left, right, target, i, j, ids = parts[s]
        d, _ = model.kernel(p, s, shape, x, left, right)
        return f(mlpe.Group(d, target, i, j, len(ids)), p.get(_name(region, s)), ids)

    return _over_groups(packed, None, run)


def _history(step: int, split: str, model: DistanceModel, losses: list, weights: dict) -> list[tuple]:
    """Rows of the total, the regions' means over species and the species' means over regions."""
    total = sum(weights[r, s] * v for r, s, v in losses)
    rows = [(step, split, "all", None, total)]
    for r in sorted({x[0] for x in losses}):
        rows.append((step, split, "region", r, float(np.mean([v for q, _, v in losses if q == r]))))
    if len(model.species) > 1:
        for s, name in enumerate(model.species):
            own = [v for _, t, v in losses if t == s]
            if own:
                rows.append((step, split, "species", name, float(np.mean(own))))
    return rows


def train(
    cells: DataFrame, pairs: DataFrame, model: DistanceModel, target: TargetSpec, config: TrainingConfig,
    *, units: DataFrame | None = None, validation: DataFrame | None = None, state: TrainingState | None = None,
    on_step: Callable[[TrainingState], None] | None = None,
) -> tuple[DistanceModel, TrainingState]:
    """The best model (lowest validation loss, the first of equals; without validation the last one evaluated)
    and the state to continue from, whose records trained() turns into a model that predicts.

    pairs and validation: aligned observations, of different pairs; every region of cells has pairs and the
    other way round. units: see pack(). Continuing needs the same settings, except for more steps, the same
    groups, and parameters and an optimizer state of the same form.
    """
    from gridkin.operators.alignment import shared_pairs

    loss = loss_of(config.loss)
    loss.check(target)
    if loss.head == "mlpe" and units is not None:
        refuse_individuals(units)
    model.check_patches(cells)
    lost = unmatched_regions(cells, pairs).limit(5).collect()
    if lost:
        raise ModelError("regions with a raster or pairs, not both: " + ", ".join(str(r.region) for r in lost))
    if validation is not None and not shared_pairs(pairs, validation).isEmpty():
        raise ValueError("training and validation share pairs")
    packed = pack(cells, pairs, model, target, units).persist()
    held = None
    if validation is not None:
        asked = validation.select("region").distinct()
        held = pack(cells.join(asked, "region", "left_semi"), validation, model, target, units).persist()
    seen = _over_groups(packed, None, lambda region, s, payload: (len(payload[2][s][2]), loss.start(payload[2][s][2])))
    groups = tuple((r, s) for r, s, _ in seen)
    n_pairs = sum(n for _, _, (n, _) in seen)
    of_species = {s: sum(t == s for _, t in groups) for _, s in groups}
    weights = {(r, s): 1.0 / (len(of_species) * of_species[s]) for r, s in groups}
    held_weights = weights
    if held is not None:
        there = {(r, s) for r, s, _ in _over_groups(held, None, lambda *_: None)}
        if not there <= set(groups):
            raise ValueError(f"validation has groups that training lacks: {sorted(there - set(groups))}")
        count = {s: sum(t == s for _, t in there) for _, s in there}
        held_weights = {(r, s): 1.0 / (len(count) * count[s]) for r, s in there}
    params = model.params() | {_name(r, s): start for r, s, (_, start) in seen if start is not None}
    fresh = state is None
    if state is None:
        state = TrainingState(config, 0, params, config.optimizer.start(params), groups, (), None)
    else:
        if replace(state.config, steps=config.steps) != config or config.steps < state.config.steps or state.groups != groups:
            raise ValueError("continuing needs the same settings, at least as many steps and the same groups")
        if {k: v.shape for k, v in state.params.items()} != {k: v.shape for k, v in params.items()}:
            raise ValueError("continuing needs parameters of the model's names and shapes")
        if type(state.config.optimizer) is not type(config.optimizer) or set(state.optimizer) != set(config.optimizer.start(params)):
            raise ValueError("continuing needs the state of the same kind of optimizer")

    def objective(p: Params, sample: dict, gradient: bool, seed: int | None = None) -> tuple[list, float, Params]:
        losses, g = evaluate(packed, model, loss, p, sample, gradient, seed=seed)
        value = sum(sample[r, s] * v for r, s, v in losses)
        if config.penalty:
            more, by = config.penalty(p)
            value, g = value + more / n_pairs, {k: g[k] + by[k] / n_pairs for k in g}
        return losses, value, g

    def sampled(step: int) -> dict:
        rng = np.random.default_rng([config.seed, step])
        names = sorted({r for r, _ in groups})
        n = min(config.region_batch or len(names), len(names))
        out = {}
        for r in rng.permutation(names)[:n]:
            own = [s for q, s in groups if q == r]
            k = min(config.species_batch or len(own), len(own))
            for s in rng.permutation(own)[:k]:
                out[str(r), int(s)] = weights[r, s] * len(names) / n * len(own) / k
        return out

    def assess(now: TrainingState) -> TrainingState:
        losses, _ = evaluate(packed, model, loss, now.params, weights, False)
        rows = _history(now.step, "train", model, losses, weights)
        value = rows[0][4]
        if held is not None:
            told = {(r, s): x for r, s, x in _at_groups(packed, model, now.params, lambda g, own, _: loss.fixed(g, own))}
            v, _ = evaluate(held, model, loss, now.params, held_weights, False, told)
            more = _history(now.step, "validation", model, v, held_weights)
            rows, value = rows + more, more[0][4]
        if not math.isfinite(value):
            raise FloatingPointError(f"step {now.step}: the loss is not finite")
        best = now.best
        if held is None or best is None or value < best[0]:
            best = (value, now.step, {k: x.copy() for k, x in now.params.items()})
        return replace(now, history=now.history + tuple(rows), best=best)

    def searched(p: Params, sample: dict, seed: int) -> float:
        try:
            return objective(p, sample, False, seed)[1]
        except Exception as e:
            e.add_note("in the line search")
            raise

    if fresh:
        state = assess(state)
        if on_step:
            on_step(state)
    state = replace(state, config=config)
    while state.step < config.steps and not state.converged:
        sample, seed = sampled(state.step), [config.seed, state.step, 1]
        draw = int(np.random.default_rng(seed).integers(1 << 31))
        try:
            _, value, g = objective(state.params, sample, True, draw)
            if math.sqrt(sum(float((v**2).sum()) for v in g.values())) <= config.tolerance:
                state = assess(replace(state, converged=True))
                break
            p, o = config.optimizer.update(state.params, g, state.optimizer, value, lambda p: searched(p, sample, draw))
        except Exception as e:
            e.add_note(f"in update {state.step + 1}")
            raise
        state = replace(state, step=state.step + 1, params=p, optimizer=o)
        if state.step % config.eval_every == 0 or state.step == config.steps:
            state = assess(state)
        if on_step:
            on_step(state)
    records = _at_groups(packed, model, state.best[2], lambda g, own, ids: (ids, loss.record(g, own)))
    state = replace(state, records=tuple((r, model.species[s], {"population_ids": ids, **rec}) for r, s, (ids, rec) in records if rec is not None))
    packed.unpersist()
    if held is not None:
        held.unpersist()
    return model.with_params({k: v for k, v in state.best[2].items() if not k.startswith("variance|")}), state


def trained(spark, model: DistanceModel, state: TrainingState, target: TargetSpec, features: tuple[str, ...] = (), pairs: DataFrame | None = None) -> GeneticsModel:
    """The trained model with the head that its loss calls for. Calibrations are those of the best parameters; they
    do not count as converged. pairs: the training pairs, which support may then not repeat."""
    if loss_of(state.config.loss).head == "direct":
        return GeneticsModel(model, target, features)
    columns = [c.split()[0] for c in mlpe.CALIBRATION.split(", ")]
    rows = [tuple({"region": r, "species": s, **rec}[c] for c in columns) for r, s, rec in state.records]  # a row for each group
    calibrations = spark.createDataFrame(rows, mlpe.CALIBRATION)
    return GeneticsModel(model, target, features, calibrations if pairs is None else mlpe.with_pairs(calibrations, pairs))


def uniform_grid(unit: DataFrame, lowest: float, highest: float, points: int = 256) -> DataFrame:
    """g, conductance, loss at each of points conductances on a log grid within the limits: the log1p loss of one
    conductance everywhere, whose resistances are the unit ones divided by it.

    unit: resistance (at conductance 1), target (model scale), weight (of the row).
    """
    step = (math.log(highest) - math.log(lowest)) / (points + 1)
    grid = F.explode(F.sequence(F.lit(1), F.lit(points))).alias("g")
    each = unit.select("resistance", "target", "weight", grid).withColumn("conductance", F.exp(F.lit(math.log(lowest)) + F.col("g") * step))
    off = F.log1p(F.col("resistance") / F.col("conductance")) - F.log1p("target")
    return each.groupBy("g").agg(F.min("conductance").alias("conductance"), F.sum(F.col("weight") * off * off).alias("loss"))


def grid_minimum(grid: DataFrame) -> DataFrame:
    """g, conductance, loss of the grid's first minimum."""
    return grid.agg(F.min(F.struct("loss", "g", "conductance")).alias("best")).select("best.g", "best.conductance", "best.loss")


def uniform_conductance(unit: DataFrame, lowest: float, highest: float, points: int = 256, refine: int = 40) -> tuple[float, float]:
    """(conductance, loss) of the best uniform surface: the grid's first minimum, refined by golden sections."""
    step = (math.log(highest) - math.log(lowest)) / (points + 1)
    best = grid_minimum(uniform_grid(unit, lowest, highest, points)).first()
    a, b = (math.log(lowest) + (best.g + k) * step for k in (-1, 1))
    unit = unit.select("resistance", "target", "weight").persist()

    def at(x: float) -> float:
        off = F.log1p(F.col("resistance") / math.exp(x)) - F.log1p("target")
        return unit.agg(F.sum(F.col("weight") * off * off)).first()[0]

    ratio = (math.sqrt(5) - 1) / 2
    x, y = b - ratio * (b - a), a + ratio * (b - a)
    fx, fy = at(x), at(y)
    for _ in range(refine):
        if fx <= fy:
            b, y, fy = y, x, fx
            x = b - ratio * (b - a)
            fx = at(x)
        else:
            a, x, fx = x, y, fy
            y = a + ratio * (b - a)
            fy = at(y)
    unit.unpersist()
    best = (fx, x) if fx <= fy else (fy, y)
    return math.exp(best[1]), best[0]


def uncap(conductance: float, lowest: float, highest: float) -> float:
    """The intercept at which a log-linear model without effects has this conductance."""
    top, c = math.log(highest - lowest), 0.1
    e = math.log(conductance - lowest)
    return e - c * math.log(-math.expm1((e - top) / c))


def initialize_uniform_conductance(
    model: LogLinear, cells: DataFrame, units: DataFrame, observations: DataFrame, target: TargetSpec, loss: str = "log1p"
) -> LogLinear:
    """The model with no effects and, for each species, the intercept of the best uniform conductance: resistances
    at 1 are solved once for each region, and divided by the conductances of the grid and the search.

    A loss that no common scale changes keeps the model's intercepts. observations: aligned.
    """
    how = loss_of(loss)
    how.check(target)
    none = replace(model, beta=tuple(tuple(0.0 for _ in b) for b in model.beta))
    if how.scale_free:
        return none
    from gridkin.operators.alignment import join_groups, terminals
    from gridkin.operators.models import region_shapes
    from gridkin.operators.resistance import pair_resistances

    s = model.patch_size
    shapes = region_shapes(cells).select("region", *(F.floor(F.col(c) / s).cast("int").alias(c) for c in ("n_rows", "n_cols")))
    r = unit_resistances(shapes, terminals(units, s), model.solver)
    at = {f"{side}_v{k[0]}": F.floor(F.col(f"{side}_{k}") / s).cast("int") for side in ("left", "right") for k in ("row", "col")}
    own = pair_resistances(observations.withColumns(at), r).select("region", "species", F.col("distance").alias("resistance"), target.forward(F.col("value")).alias("target"))
    own = own if model.species == (None,) else own.withColumn("species", F.coalesce("species", F.lit(model.species[0] if len(model.species) == 1 else None)))
    n = own.groupBy("region", "species").agg(F.count(F.lit(1)).alias("n"))
    weighed = join_groups(own, join_groups(n, loss_weights(n.select("region", "species")))).withColumn("weight", F.col("weight") / F.col("n")).persist()
    bias = []
    for name, before in zip(model.species, model.bias, strict=True):
        of = weighed.where(F.col("species").eqNullSafe(F.lit(name)))
        bias.append(before if of.isEmpty() else uncap(uniform_conductance(of, model.lowest, model.highest)[0], model.lowest, model.highest))
    weighed.unpersist()
    return replace(none, bias=tuple(bias))
