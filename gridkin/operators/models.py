"""Distance models: what a landscape makes of the way between two units.

A model declares its species, its patch size and, for resistance models, its solver; distances()
gives region, species, left, right, distance for pairs of units. Own models subclass one of the bases.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridkin.functions import columns as C
from gridkin.operators.alignment import join_groups, terminals, unit_pairs, unit_vertices, unknown_units, with_endpoints
from gridkin.operators.resistance import Solved, Solver, method_of, pair_resistances, resistances, solver_of
from gridkin.operators.tape import Node, Tape, flat, rebuilt


Params = dict[str, np.ndarray]
#: From the gradient by each distance to that by each parameter.
Back = Callable[[np.ndarray], Params]


class ModelError(ValueError):
    """Inputs that a model cannot take."""


def patch_means(cells: DataFrame, patch_size: int, n_features: int) -> DataFrame:
    """region, row, col, features: the mean of every feature over each patch of patch_size x patch_size cells."""
    row, col = C.patch_of(F.col("row"), patch_size), C.patch_of(F.col("col"), patch_size)
    means = cells.groupBy("region", row.alias("row"), col.alias("col")).agg(
        *(F.avg(F.get("features", F.lit(i))).alias(f"_f{i}") for i in range(n_features))
    )
    return means.select("region", "row", "col", F.array(*(F.col(f"_f{i}") for i in range(n_features))).alias("features"))


def patch_centers(ticks: DataFrame, patch_size: int) -> DataFrame:
    """region, dim, idx, center of patches: the mean of their cells' centers."""
    return ticks.groupBy("region", "dim", C.patch_of(F.col("idx"), patch_size).alias("idx")).agg(F.avg("center").alias("center"))


def indivisible(regions: DataFrame, patch_size: int) -> DataFrame:
    """Regions whose raster patches do not fill: region, drop_rows, drop_cols, message."""
    rows, cols = F.col("n_rows") % patch_size, F.col("n_cols") % patch_size
    say = F.format_string(f"%s: drop %d rows and %d columns to fill patches of {patch_size}", "region", rows, cols)
    return regions.where((rows > 0) | (cols > 0)).select("region", rows.alias("drop_rows"), cols.alias("drop_cols"), say.alias("message"))


def shared_vertices(units: DataFrame, patch_size: int) -> DataFrame:
    """Vertices with more than one unit of a species: region, species, vr, vc, units (their names, sorted)."""
    at = unit_vertices(units, patch_size).groupBy("region", "species", "vr", "vc")
    return at.agg(F.sort_array(F.collect_list("unit")).alias("units")).where(F.size("units") > 1)


def patches(cells: DataFrame, patch_size: int) -> DataFrame:
    """region, row, col, cells: the cells of each patch in row-major order, as structs row, col, features."""
    row, col = C.patch_of(F.col("row"), patch_size), C.patch_of(F.col("col"), patch_size)
    own = F.struct("row", "col", "features")
    return cells.groupBy("region", row.alias("pr"), col.alias("pc")).agg(F.sort_array(F.collect_list(own)).alias("cells")).withColumnsRenamed({"pr": "row", "pc": "col"})


def flat_patches(cells: DataFrame, patch_size: int) -> DataFrame:
    """region, row, col, features: the features of a patch's cells, cell by cell in row-major order."""
    own = patches(cells, patch_size)
    return own.select("region", "row", "col", F.flatten(F.transform("cells", lambda c: c["features"])).alias("features"))


def region_shapes(cells: DataFrame) -> DataFrame:
    """region, n_rows, n_cols."""
    return cells.groupBy("region").agg((F.max("row") + 1).alias("n_rows"), (F.max("col") + 1).alias("n_cols"))


@dataclass(frozen=True)
class DistanceModel(ABC):
    """species: names, in the order of their parameters; one None for a species without a name."""

    species: tuple[str | None, ...] = (None,)
    patch_size: int = 1

    def __post_init__(self) -> None:
        if not self.species or len(set(self.species)) < len(self.species):
            raise ModelError("species must be distinct, and one at least")
        if None in self.species and len(self.species) > 1:
            raise ModelError("a model of several species names them all")
        if self.patch_size < 1:
            raise ModelError("patch_size must be 1 or more")

    def known(self, units: DataFrame) -> DataFrame:
        """units of this model's species. A model of one named species takes units without a name as its own."""
        if self.species == (None,):
            return units
        one = self.species[0] if len(self.species) == 1 else None
        named = units.withColumn("species", F.coalesce("species", F.lit(one)))
        return named.where(F.col("species").isin(list(self.species)))

    @abstractmethod
    def pair_distances(self, cells: DataFrame, units: DataFrame, pairs: DataFrame) -> DataFrame: ...

    def params(self) -> Params:
        """What training changes and a saved model holds."""
        raise ModelError(f"a {type(self).__name__} has no parameters")

    def with_params(self, p: Params) -> DistanceModel:
        raise ModelError(f"a {type(self).__name__} has no parameters")

    def grid(self, cells: DataFrame) -> DataFrame:
        """region, row, col, features: what the model sees of each vertex."""
        raise ModelError(f"a {type(self).__name__} cannot be trained")

    def kernel(self, p: Params, s: int, shape: tuple[int, int], x: np.ndarray, left: np.ndarray, right: np.ndarray, seed: int | None = None) -> tuple[np.ndarray, Back]:
        """Distances of pairs of vertices (flat places) for species s, and the pull-back of their gradient. x: grid()'s
        features, row by row; seed: of an update in training, for what is drawn there."""
        raise ModelError(f"a {type(self).__name__} cannot be trained")

    def check_patches(self, cells: DataFrame) -> None:
        """Raise ModelError if patches do not fill a region's raster."""
        if self.patch_size > 1:
            bad = indivisible(region_shapes(cells), self.patch_size).limit(5).collect()
            if bad:
                raise ModelError("; ".join(r.message for r in bad))

    def resolved(self, units: DataFrame, query: DataFrame | dict | list | tuple | None) -> DataFrame:
        """The pairs of a query: a table of pairs, as it is; a species' name -> pairs or None (all); a list of
        species (all pairs of each); or None (all pairs). Unknown species and units raise ModelError."""
        own = self.known(units)
        if query is None:
            return unit_pairs(own)
        if not isinstance(query, DataFrame):
            wanted = dict(query) if isinstance(query, dict) else dict.fromkeys(query)
            foreign = [s for s in wanted if s not in self.species]
            if foreign or not wanted:
                raise ModelError(f"the model knows no species {foreign}" if foreign else "a query names a species")
            out = None
            for name, pairs in wanted.items():
                of = own.where(F.col("species").eqNullSafe(F.lit(name)))
                part = (unit_pairs(of) if pairs is None else pairs.withColumn("species", F.lit(name).cast("string"))).select("region", "species", "left", "right")
                out = part if out is None else out.unionByName(part)
            query = out
        named = query if self.species == (None,) else query.withColumn("species", F.coalesce("species", F.lit(self.species[0] if len(self.species) == 1 else None)))
        if self.species != (None,):
            foreign = named.where(F.col("species").isNull() | ~F.col("species").isin(list(self.species))).select("species").distinct().limit(5).collect()
            if foreign:
                raise ModelError(f"the model knows no species {[r.species for r in foreign]}")
        lost = unknown_units(named, own).limit(5).collect()
        if lost:
            raise ModelError("no such units: " + ", ".join(f"{r.region} {r.unit}" for r in lost))
        return named if "left_row" in named.columns else with_places(named, own)

    def distances(self, cells: DataFrame, units: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
        """region, species, left, right, distance: of the pairs asked for, or of all pairs of units."""
        own = self.known(units)
        return self.pair_distances(cells, own, unit_pairs(own) if pairs is None else pairs)


def with_places(pairs: DataFrame, units: DataFrame) -> DataFrame:
    """pairs (region, species, left, right) with the cells of both units."""
    own = units.select("region", "species", "unit", "row", "col")
    return with_endpoints(pairs.select("region", "species", "left", "right"), own, ["row", "col"])


@dataclass(frozen=True)
class StraightLine(DistanceModel):
    """slope * straight-line distance + intercept, in vertex spacings, for each species; features are left alone."""

    slope: tuple[float, ...] = (1.0,)
    intercept: tuple[float, ...] = (0.0,)

    def params(self) -> Params:
        return {"slope": np.array(self.slope, float), "intercept": np.array(self.intercept, float)}

    def with_params(self, p: Params) -> StraightLine:
        return replace(self, slope=tuple(p["slope"].tolist()), intercept=tuple(p["intercept"].tolist()))

    def grid(self, cells: DataFrame) -> DataFrame:
        row, col = C.patch_of(F.col("row"), self.patch_size), C.patch_of(F.col("col"), self.patch_size)
        return cells.select("region", row.alias("row"), col.alias("col")).distinct().withColumn("features", F.array(F.lit(0.0)))

    def kernel(self, p: Params, s: int, shape: tuple[int, int], x: np.ndarray, left: np.ndarray, right: np.ndarray, seed: int | None = None) -> tuple[np.ndarray, Back]:
        line = np.hypot(*((a - b).astype(float) for a, b in zip(np.divmod(left, shape[1]), np.divmod(right, shape[1]), strict=True)))

        def back(g: np.ndarray) -> Params:
            out = {k: np.zeros_like(v) for k, v in p.items()}
            out["slope"][s], out["intercept"][s] = g @ line, g.sum()
            return out

        return p["slope"][s] * line + p["intercept"][s], back

    def pair_distances(self, cells: DataFrame, units: DataFrame, pairs: DataFrame) -> DataFrame:
        s = self.patch_size
        d = lambda a, b: C.patch_of(F.col(a), s) - C.patch_of(F.col(b), s)
        line = C.straight_distance(d("left_row", "right_row"), d("left_col", "right_col"), 1.0, 0.0)
        pick = lambda v: F.coalesce(*(F.when(F.col("species").eqNullSafe(F.lit(n)), F.lit(x)) for n, x in zip(self.species, v, strict=True)))
        return pairs.select("region", "species", "left", "right", (pick(self.slope) * line + pick(self.intercept)).alias("distance"))


@dataclass(frozen=True)
class ResistanceModel(DistanceModel):
    """Distances are effective resistances over the conductance surface of each species."""

    solver: str | Solver | None = None

    @abstractmethod
    def conductance(self, cells: DataFrame) -> DataFrame:
        """region, species, row, col, conductance."""

    def local(self, p: Params, s: int, x: np.ndarray, seed: int | None = None) -> tuple[np.ndarray, Back]:
        """Conductances of the vertices of grid() for species s, and the pull-back of their gradient."""
        raise ModelError(f"a {type(self).__name__} cannot be trained")

    def kernel(self, p: Params, s: int, shape: tuple[int, int], x: np.ndarray, left: np.ndarray, right: np.ndarray, seed: int | None = None) -> tuple[np.ndarray, Back]:
        c, back = self.local(p, s, x, seed)
        surface = c.reshape(shape)
        ends, at = np.unique(np.concatenate([left, right]), return_inverse=True)
        i, j = at[: len(left)], at[len(left) :]
        solved: list[Solved] = []

        def once() -> Solved:
            if not solved:
                solved.append(Solved(surface, ends, method_of(self.solver, surface)))
            return solved[0]

        if callable(self.solver) or self.solver == "dense":
            r = solver_of(self.solver)(surface, np.stack(np.divmod(ends, shape[1]), 1))
        else:
            r = once().resistances()
        return r[i, j], lambda g: back(once().gradient(i, j, g).ravel())

    def pair_distances(self, cells: DataFrame, units: DataFrame, pairs: DataFrame) -> DataFrame:
        surface, out = self.conductance(cells), None
        s = self.patch_size
        for name in self.species:
            own = surface.where(F.col("species").eqNullSafe(F.lit(name)))
            r = resistances(own, terminals(units.where(F.col("species").eqNullSafe(F.lit(name))), s), solver=self.solver)
            at = {f"{side}_v{k[0]}": C.patch_of(F.col(f"{side}_{k}"), s) for side in ("left", "right") for k in ("row", "col")}
            asked = pairs.where(F.col("species").eqNullSafe(F.lit(name))).withColumns(at)
            part = pair_resistances(asked, r).select("region", "species", "left", "right", "distance")
            out = part if out is None else out.unionByName(part)
        return out

    def surface(self, cells: DataFrame, ticks: DataFrame | None = None) -> DataFrame:
        """Conductances with the coordinates of patch centers: region, species, row, col, conductance, y, x."""
        out = self.conductance(cells)
        if ticks is None:
            return out
        centers = patch_centers(ticks, self.patch_size)
        for dim, idx, name in (("row", "row", "y"), ("column", "col", "x")):
            own = centers.where(F.col("dim") == dim).select("region", F.col("idx").alias(idx), F.col("center").alias(name))
            out = out.join(own, ["region", idx], "left")
        return out.select("region", "species", "row", "col", "conductance", "y", "x")


@dataclass(frozen=True)
class LogLinear(ResistanceModel):
    """Conductance is exponential in patch means: features dot beta + intercept, for each species."""

    beta: tuple[tuple[float, ...], ...] = ((),)
    bias: tuple[float, ...] = (0.0,)
    lowest: float = C.MIN_CONDUCTANCE
    highest: float = C.MAX_CONDUCTANCE

    def __post_init__(self) -> None:
        super().__post_init__()
        if len(self.beta) != len(self.species) or len(self.bias) != len(self.species) or len({len(b) for b in self.beta}) != 1:
            raise ModelError("each species needs a coefficient for each feature and an intercept")
        if not 0 < self.lowest < self.highest:
            raise ModelError("limits of conductance must be above 0 and in order")

    def predictor(self, cells: DataFrame) -> DataFrame:
        """region, species, row, col, predictor."""
        means = patch_means(cells, self.patch_size, len(self.beta[0]))
        each = F.explode(F.array(*(
            F.struct(F.lit(n).cast("string").alias("species"), F.array(*map(F.lit, b)).cast("array<double>").alias("b"), F.lit(float(a)).alias("a"))
            for n, b, a in zip(self.species, self.beta, self.bias, strict=True)
        )))
        own = means.withColumn("_p", each)
        return own.select("region", F.col("_p.species").alias("species"), "row", "col", C.dot(F.col("features"), F.col("_p.b"), F.col("_p.a")).alias("predictor"))

    def conductance(self, cells: DataFrame) -> DataFrame:
        value = C.loglinear_conductance(F.col("predictor"), self.lowest, self.highest)
        return self.predictor(cells).select("region", "species", "row", "col", value.alias("conductance"))

    def saturation(self, cells: DataFrame) -> DataFrame:
        """region, species, row, col, saturated."""
        return self.predictor(cells).select("region", "species", "row", "col", C.saturated(F.col("predictor"), self.lowest, self.highest).alias("saturated"))

    def effects(self, features: list[str]) -> dict[str, dict[str | None, float]]:
        """feature -> species -> coefficient."""
        if len(features) != len(self.beta[0]):
            raise ModelError("as many feature names as coefficients are needed")
        return {f: {s: b[i] for s, b in zip(self.species, self.beta, strict=True)} for i, f in enumerate(features)}

    def params(self) -> dict[str, np.ndarray]:
        return {"beta": np.array(self.beta, float), "bias": np.array(self.bias, float)}

    def with_params(self, p: dict[str, np.ndarray]) -> LogLinear:
        return replace(self, beta=tuple(map(tuple, p["beta"].tolist())), bias=tuple(p["bias"].tolist()))

    def grid(self, cells: DataFrame) -> DataFrame:
        return patch_means(cells, self.patch_size, len(self.beta[0]))

    def local(self, p: Params, s: int, x: np.ndarray, seed: int | None = None) -> tuple[np.ndarray, Back]:
        """Conductances of patches x (patches, features) for species s, and the pull-back of their gradient."""
        top, c = np.log(self.highest - self.lowest), C.CAP_WIDTH
        eta = x @ p["beta"][s] + p["bias"][s]
        z = (top - eta) / c
        grown = np.exp(top - c * (np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z)))))
        value = np.clip(grown + self.lowest, self.lowest, self.highest)

        def back(g: np.ndarray) -> dict[str, np.ndarray]:
            by_eta = g * grown / (1 + np.exp(-np.clip(z, -700, 700)))
            out = {k: np.zeros_like(v) for k, v in p.items()}
            out["beta"][s], out["bias"][s] = x.T @ by_eta, by_eta.sum()
            return out

        return value, back


#: Parts that the units of a region and species are dealt to; a tile holds the pairs of one or two of them.
PARTS = 8
#: Pairs whose distances are computed at a time.
TILE_PAIRS = 1 << 17


@dataclass(frozen=True)
class _Vectors:
    """Units with their order and vectors, as rows of x. width: numbers in a vector, -1 for one that is or holds null."""

    unit: pa.Array
    order: np.ndarray
    x: np.ndarray
    width: np.ndarray

    @staticmethod
    def of(rows: pa.Table) -> _Vectors:
        unit, column = (rows.combine_chunks()[c].chunk(0) for c in ("unit", "vector"))
        n = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        of = np.repeat(np.arange(len(n)), n)
        flat = column.flatten()
        x = np.zeros((len(n), n.max(initial=0)))
        x[of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)] = pc.cast(pc.fill_null(flat, 0), pa.float64()).to_numpy(zero_copy_only=False)
        lost = np.bincount(of[flat.is_null().to_numpy(zero_copy_only=False)], minlength=len(n)) > 0
        lost |= column.is_null().to_numpy(zero_copy_only=False)
        return _Vectors(unit, rows["unit_ord"].to_numpy(), x, np.where(lost, -1, n))

    def pairs(self, other: _Vectors, key: tuple) -> Iterator[pa.RecordBatch]:
        """The distances between these and others, the earlier unit on the left; of these among each other, each once."""
        width = min(self.x.shape[1], other.x.shape[1])
        across, units = np.ascontiguousarray(other.x.T), pa.concat_arrays([self.unit, other.unit])
        rows = max(1, TILE_PAIRS // max(1, len(other.order)))
        for at in range(0, len(self.order), rows):
            some = slice(at, at + rows)
            total = np.zeros((len(self.order[some]), len(other.order)))
            step = np.empty_like(total)
            for k in range(width):  # in the order of a sum
                np.subtract(self.x[some, k, None], across[k], out=step)
                np.multiply(step, step, out=step)
                total += step
            before, after = self.order[some, None] < other.order, self.order[some, None] > other.order
            i, j = np.nonzero(before if other is self else before | after)
            if not len(i):
                continue
            first, second, turned = i + at, j + len(self.order), after[i, j]
            unknown = (self.width[some][i] != other.width[j]) | (other.width[j] < 0)
            region, species = (pa.repeat(x, len(i)) for x in key[:2])
            ends = (units.take(pa.array(np.where(turned, a, b))) for a, b in ((second, first), (first, second)))
            yield pa.RecordBatch.from_arrays(
                [region, species, *ends, pa.array(total[i, j], mask=unknown)], ["region", "species", "left", "right", "distance"]
            )


def _tile_distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distances of the pairs of each tile. Rows come by tile; the units of a tile's first part are held, those
    of its second part pass by."""
    key, parts, held = None, [], None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        new = np.zeros(len(batch), bool)
        new[:1] = True
        for c in ("region", "species", "a", "b", "second"):
            x = rows[c].to_pandas().to_numpy(object)
            new[1:] |= x[1:] != x[:-1]
        starts = np.flatnonzero(new)
        for at, end in zip(starts.tolist(), [*starts[1:].tolist(), len(batch)], strict=True):
            own = tuple(rows[c][at] for c in ("region", "species", "a", "b"))
            some, second = rows.slice(at, end - at), rows["second"][at].as_py()
            if key is None or [x.as_py() for x in own] != [x.as_py() for x in key]:
                yield from _among(parts, key)
                key, parts, held = own, [], None
            if not second:
                parts.append(some)
            elif parts:
                held = held or _Vectors.of(pa.concat_tables(parts))
                yield from held.pairs(_Vectors.of(some), key)
    yield from _among(parts, key)


def _among(parts: list[pa.Table], key: tuple | None) -> Iterator[pa.RecordBatch]:
    """The pairs of a tile that has one part."""
    if parts and key[2].as_py() == key[3].as_py():
        held = _Vectors.of(pa.concat_tables(parts))
        yield from held.pairs(held, key)


@dataclass(frozen=True)
class EmbeddingModel(DistanceModel):
    """Distances are squared differences of the units' vectors."""

    @abstractmethod
    def embedding(self, cells: DataFrame, units: DataFrame) -> DataFrame:
        """region, species, unit, vector."""

    def distances(self, cells: DataFrame, units: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
        """As in the base. All pairs are made where the vectors meet: what moves are units, PARTS times each, and
        never a vector for each pair."""
        if pairs is not None:
            return super().distances(cells, units, pairs)
        own = self.known(units).where(F.col("unit_ord").isNotNull()).select("region", "species", "unit", "unit_ord")
        vectors = join_groups(own, self.embedding(cells, self.known(units)).select("region", "species", "unit", "vector"), ("unit",))
        part = F.pmod(F.xxhash64("unit"), F.lit(PARTS)).cast("int")
        tiles = F.transform(
            F.sequence(F.lit(0), F.lit(PARTS - 1)),
            lambda k: F.struct(F.least(part, k).alias("a"), F.greatest(part, k).alias("b"), (part > k).alias("second")),
        )
        key = ["region", "species", "a", "b"]
        dealt = vectors.select("*", F.inline(tiles)).repartition(*key).sortWithinPartitions(*key, "second")
        kind = {f.name: f.dataType.simpleString() for f in own.schema}
        return dealt.mapInArrow(_tile_distances, f"region {kind['region']}, species {kind['species']}, left {kind['unit']}, right {kind['unit']}, distance double")

    def pair_distances(self, cells: DataFrame, units: DataFrame, pairs: DataFrame) -> DataFrame:
        v, out = self.embedding(cells, units), pairs.select("region", "species", "left", "right")
        for side in ("left", "right"):
            own = v.select(F.col("region").alias("_r"), F.col("species").alias("_s"), F.col("unit").alias("_u"), F.col("vector").alias(f"{side}_vector"))
            on = (out["region"] == own["_r"]) & out["species"].eqNullSafe(own["_s"]) & (out[side] == own["_u"])
            out = out.join(own, on).drop("_r", "_s", "_u")
        d = C.squared_distance(F.col("left_vector"), F.col("right_vector"))
        return out.select("region", "species", "left", "right", d.alias("distance"))


@dataclass(frozen=True)
class NetworkConductance(ResistanceModel):
    """Conductance from a network's value for each patch: softplus(latent dot weights + bias) + least.

    encoder: (patches, features, size, size) -> (patches, width), run on Arrow batches of patches.
    """

    encoder: Callable[[np.ndarray], np.ndarray] | None = None
    head: tuple[tuple[float, ...], ...] = ((),)
    bias: tuple[float, ...] = (0.0,)
    lowest: float = 1e-6
    #: Part of the latent channels that an update leaves out.
    dropout: float = 0.0

    def params(self) -> Params:
        own = {"head": np.array(self.head, float), "bias": np.array(self.bias, float)}
        return own | {k: v.astype(float) for k, v in flat(self.encoder.layers, "encoder").items()}

    def with_params(self, p: Params) -> NetworkConductance:
        layers = rebuilt(self.encoder.layers, "encoder", lambda k: np.asarray(p[k], np.float32))
        return replace(self, encoder=replace(self.encoder, layers=layers), head=tuple(map(tuple, p["head"].tolist())), bias=tuple(p["bias"].tolist()))

    def grid(self, cells: DataFrame) -> DataFrame:
        return flat_patches(cells, self.patch_size)

    def local(self, p: Params, s: int, x: np.ndarray, seed: int | None = None) -> tuple[np.ndarray, Back]:
        from gridkin.operators.networks import dropout_mask

        nodes = {k: Node(np.asarray(v, float)) for k, v in p.items() if k.startswith("encoder")}
        layers = rebuilt(self.encoder.layers, "encoder", lambda k: nodes[k])
        batch = x.reshape(len(x), self.patch_size, self.patch_size, -1).transpose(0, 3, 1, 2)
        out = self.encoder.run(Tape, layers, Node(batch))
        if self.dropout and seed is not None:
            out = Tape.scaled(out, dropout_mask(out.shape, self.dropout, seed))
        z = out.value @ p["head"][s] + p["bias"][s]

        def back(g: np.ndarray) -> Params:
            by_z = g / (1 + np.exp(-np.clip(z, -700, 700)))
            out.backward(by_z[:, None] * p["head"][s])
            found = {k: nodes[k].grad if k in nodes and nodes[k].grad is not None else np.zeros_like(v) for k, v in p.items()}
            found["head"][s], found["bias"][s] = out.value.T @ by_z, by_z.sum()
            return found

        return np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z))) + self.lowest, back

    def conductance(self, cells: DataFrame) -> DataFrame:
        size, encode, head, names = self.patch_size, self.encoder, self.head, self.species

        def run(batches: Any) -> Any:
            for batch in batches:
                if not len(batch):
                    continue
                x = np.stack([np.stack([np.asarray(c["features"], np.float32) for c in cs]) for cs in batch["cells"]])
                x = x.reshape(len(batch), size, size, -1).transpose(0, 3, 1, 2)
                z = np.asarray(encode(x), float) @ np.array(head, float).T + np.array(self.bias, float)
                c = np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z))) + self.lowest
                for s, name in enumerate(names):
                    yield pd.DataFrame({"region": batch["region"], "species": [name] * len(batch), "row": batch["row"], "col": batch["col"], "conductance": c[:, s]})

        return patches(cells, size).mapInPandas(run, "region string, species string, row int, col int, conductance double")
