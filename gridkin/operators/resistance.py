"""Effective resistance between vertices of four-neighbour grid graphs.

One raster is one group: a NumPy kernel factors the grid's Laplacian by block elimination over
raster rows and solves for the terminals alone. Rasters of one row need no kernel: resistance is
then a difference of running sums, in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: (conductance surface, terminal rows and columns) -> resistance matrix of the terminals.
Solver = Callable[[np.ndarray, np.ndarray], np.ndarray]


class ResistanceError(ValueError):
    """A surface or terminal that has no effective resistance."""


def check_surface(surface: np.ndarray, nodes: np.ndarray) -> None:
    if surface.ndim != 2 or surface.size < 2:
        raise ResistanceError("a conductance surface needs two dimensions and two vertices")
    if not (np.isfinite(surface).all() and (surface > 0).all()):
        raise ResistanceError("conductances must be finite and above 0")
    if nodes.ndim != 2 or nodes.shape[1] != 2 or (nodes < 0).any() or (nodes >= surface.shape).any():
        raise ResistanceError("terminals must be (row, column) pairs inside the surface")


def edge_conductances(surface: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of edges to the right, and of edges downwards: the mean of both ends."""
    return (surface[:, 1:] + surface[:, :-1]) / 2, (surface[1:] + surface[:-1]) / 2


def potentials(surface: np.ndarray, sources: np.ndarray) -> np.ndarray:
    """Solutions of the Laplacian for columns of sources (vertices, k), the last vertex at 0.

    Block elimination: the Laplacian is block tridiagonal over raster rows.
    """
    if surface.shape[1] > surface.shape[0]:  # eliminate along the longer side
        k = sources.shape[1]
        turned = sources.reshape(*surface.shape, k).swapaxes(0, 1).reshape(-1, k)
        v = potentials(np.ascontiguousarray(surface.T), turned)
        return v.reshape(*surface.T.shape, k).swapaxes(0, 1).reshape(-1, k)
    rows, cols = surface.shape
    right, down = edge_conductances(surface)
    degree = np.zeros_like(surface)
    degree[:, 1:] += right
    degree[:, :-1] += right
    degree[1:] += down
    degree[:-1] += down
    b = sources.reshape(rows, cols, -1).astype(float).copy()
    blocks = []
    for i in range(rows):
        block = np.diag(degree[i])
        if cols > 1:
            at = np.arange(cols - 1)
            block[at, at + 1] = block[at + 1, at] = -right[i]
        if i:
            solved = np.linalg.solve(blocks[-1], np.concatenate([np.diag(down[i - 1]), b[i - 1]], 1))
            block = block - down[i - 1][:, None] * solved[:, :cols]
            b[i] += down[i - 1][:, None] * solved[:, cols:]
        if i == rows - 1:  # ground the last vertex
            block[-1, :] = block[:, -1] = 0.0
            block[-1, -1] = 1.0
            b[i, -1] = 0.0
        blocks.append(block)
    v = np.empty_like(b)
    v[-1] = np.linalg.solve(blocks[-1], b[-1])
    for i in range(rows - 2, -1, -1):
        v[i] = np.linalg.solve(blocks[i], b[i] + down[i][:, None] * v[i + 1])
    return v.reshape(rows * cols, -1)


def dense_solver(surface: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Resistances by the pseudo-inverse of the whole Laplacian, for small surfaces."""
    surface, nodes = np.asarray(surface, float), np.asarray(nodes, np.int64)
    check_surface(surface, nodes)
    rows, cols = surface.shape
    ids = np.arange(rows * cols).reshape(rows, cols)
    lap = np.zeros((rows * cols, rows * cols))
    for (a, b), g in (((ids[:, :-1], ids[:, 1:]), edge_conductances(surface)[0]), ((ids[:-1], ids[1:]), edge_conductances(surface)[1])):
        np.add.at(lap, (a.ravel(), b.ravel()), -g.ravel())
        np.add.at(lap, (b.ravel(), a.ravel()), -g.ravel())
    lap -= np.diag(lap.sum(1))
    p = np.linalg.pinv(lap)
    flat = nodes[:, 0] * cols + nodes[:, 1]
    q = p[np.ix_(flat, flat)]
    r = np.diag(q)[:, None] + np.diag(q)[None, :] - q - q.T
    return np.where(flat[:, None] == flat[None, :], 0.0, (r + r.T) / 2)


def laplacian(surface: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The Laplacian of the grid times columns v (vertices, k), without the matrix."""
    x = v.reshape(*surface.shape, -1)
    right, down = edge_conductances(surface)
    out = np.zeros_like(x)
    step = right[..., None] * (x[:, :-1] - x[:, 1:])
    out[:, :-1] += step
    out[:, 1:] -= step
    step = down[..., None] * (x[:-1] - x[1:])
    out[:-1] += step
    out[1:] -= step
    return out.reshape(len(v), -1)


def cg_potentials(surface: np.ndarray, sources: np.ndarray, tolerance: float = 1e-11, most: int | None = None) -> np.ndarray:
    """potentials() by conjugate gradients, scaled by degree: memory in proportion to the vertices, whatever the
    raster's sides. Sources that do not add up to 0 drain at the last vertex."""
    surface = np.asarray(surface, float)
    b = sources.astype(float).copy()
    b[-1] -= b.sum(0)
    right, down = edge_conductances(surface)
    degree = np.zeros_like(surface)
    for part, edge in ((degree[:, 1:], right), (degree[:, :-1], right), (degree[1:], down), (degree[:-1], down)):
        part += edge
    scale = degree.reshape(-1, 1)
    x, r = np.zeros_like(b), b.copy()
    z = r / scale
    p, rz = z.copy(), (r * z).sum(0)
    goal = tolerance * np.maximum(np.sqrt((b * b).sum(0)), 1e-300)
    for _ in range(most or 20 * len(b)):
        if (np.sqrt((r * r).sum(0)) <= goal).all():
            break
        q = laplacian(surface, p)
        pq = (p * q).sum(0)
        step = np.where(pq > 0, rz / np.where(pq > 0, pq, 1.0), 0.0)
        x += step * p
        r -= step * q
        z = r / scale
        new = (r * z).sum(0)
        p = z + np.where(rz > 0, new / np.where(rz > 0, rz, 1.0), 0.0) * p
        rz = new
    else:
        raise ResistanceError("conjugate gradients did not settle")
    return x - x[-1]


class Solved:
    """Potentials of a surface for its terminals, from one solve: resistances and their gradient both read them."""

    def __init__(self, surface: np.ndarray, ends: np.ndarray, method: Callable[[np.ndarray, np.ndarray], np.ndarray] = potentials):
        """ends: distinct vertices, as places in the flat surface."""
        self.surface, self.ends = np.asarray(surface, float), np.asarray(ends, np.int64)
        check_surface(self.surface, np.stack(np.divmod(self.ends, self.surface.shape[1]), 1))
        sources = np.zeros((self.surface.size, len(self.ends)))
        sources[self.ends, np.arange(len(self.ends))] = 1.0
        sources[-1] -= 1.0  # to the ground
        self.v = method(self.surface, sources)

    def resistances(self) -> np.ndarray:
        v = self.v[self.ends]
        r = np.diag(v)[:, None] + np.diag(v)[None, :] - v - v.T
        np.fill_diagonal(r, 0.0)
        return np.maximum((r + r.T) / 2, 0.0)

    def gradient(self, left: np.ndarray, right: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """By each conductance, of sum(weight * resistance(left, right)); left and right: places among the ends.

        d R / d g of an edge is minus the squared difference of the pair's potentials at its ends; over all
        pairs that is a quadratic form in the terminals' potentials, whose matrix is a graph Laplacian of the weights.
        """
        n = len(self.ends)
        w = np.zeros((n, n))
        np.add.at(w, (left, right), weight)
        w = w + w.T
        form = np.diag(w.sum(1)) - w
        v = self.v.reshape(*self.surface.shape, n)
        g = np.zeros_like(self.surface)
        for step, one, two in ((v[:, 1:] - v[:, :-1], g[:, 1:], g[:, :-1]), (v[1:] - v[:-1], g[1:], g[:-1])):
            by_edge = -((step @ form) * step).sum(2) / 2
            one += by_edge
            two += by_edge
        return g


def _solver(method: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Solver:
    def solve(surface: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        surface, nodes = np.asarray(surface, float), np.asarray(nodes, np.int64)
        check_surface(surface, nodes)
        flat, back = np.unique(nodes[:, 0] * surface.shape[1] + nodes[:, 1], return_inverse=True)
        return Solved(surface, flat, method).resistances()[np.ix_(back, back)]

    return solve


block_solver = _solver(potentials)
cg_solver = _solver(cg_potentials)
#: Terminals alone are solved for: block by elimination over raster rows, cg without a matrix, dense by a pseudo-inverse.
SOLVERS: dict[str, Solver] = {"block": block_solver, "cg": cg_solver, "dense": dense_solver}
#: Shorter side of a raster over which the blocks of the default solver would be too large for a task.
LARGE_SIDE = 1500


def default_solver(surface: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    return (cg_solver if min(np.shape(surface)) > LARGE_SIDE else block_solver)(surface, nodes)


def solver_of(solver: str | Solver | None) -> Solver:
    if solver is None:
        return default_solver
    if callable(solver):
        return solver
    if solver not in SOLVERS:
        raise ValueError(f"unknown solver {solver!r}; one of {', '.join(SOLVERS)}, or a callable")
    return SOLVERS[solver]


def method_of(solver: str | Solver | None, surface: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """How potentials are found where gradients are wanted."""
    return cg_potentials if solver == "cg" or (solver is None and min(surface.shape) > LARGE_SIDE) else potentials


def adjoint(surface: np.ndarray, left: np.ndarray, right: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Gradient by each conductance of sum(weight * resistance(left, right)); left and right: flat vertices."""
    ends, at = np.unique(np.concatenate([left, right]), return_inverse=True)
    return Solved(surface, ends).gradient(at[: len(left)], at[len(left) :], weight)


def unit_resistances(shapes: DataFrame, terminals: DataFrame, solver: str | Solver | None = None) -> DataFrame:
    """region, r1, c1, r2, c2, resistance at a conductance of 1 everywhere. shapes: region, n_rows, n_cols.

    Regions of one shape with the same terminals have the same answer; it is solved once in a task.
    """
    solve, names = solver_of(solver), ["region", "r1", "c1", "r2", "c2", "resistance"]
    nodes = terminals.select("region", F.array("vr", "vc").alias("at")).groupBy("region").agg(F.sort_array(F.collect_set("at")).alias("at"))  # a raster's

    def run(batches):
        known: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for region, rows, cols, at in zip(batch["region"], batch["n_rows"], batch["n_cols"], batch["at"], strict=True):
                at = np.stack([np.asarray(x, np.int64) for x in at])
                key = (int(rows), int(cols), at.tobytes())
                if key not in known:
                    known = {key: solve(np.ones((int(rows), int(cols))), at)}  # the last one alone is kept
                i, j = np.triu_indices(len(at), 1)
                yield pd.DataFrame(dict(zip(names, ([region] * len(i), at[i, 0], at[i, 1], at[j, 0], at[j, 1], known[key][i, j]), strict=True)))

    sorted_ = shapes.join(nodes, "region").repartition("n_rows", "n_cols").sortWithinPartitions("n_rows", "n_cols", "at")
    return sorted_.mapInPandas(run, "region string, r1 int, c1 int, r2 int, c2 int, resistance double")


def resistances(vertices: DataFrame, terminals: DataFrame, *, value: str = "conductance", solver: str | Solver | None = None) -> DataFrame:
    """region, r1, c1, r2, c2, resistance for every two different terminals of a region, in row-major order.

    vertices: region, row, col, value, a complete grid for each region. terminals: region, vr, vc.
    The rasters of a region are one task's; regions run side by side.
    """
    solve = solver_of(solver)

    def run(key: tuple, grid: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        names = ["region", "r1", "c1", "r2", "c2", "resistance"]
        if not len(grid) or not len(nodes):
            return pd.DataFrame({n: [] for n in names})
        surface = np.full((int(grid["row"].max()) + 1, int(grid["col"].max()) + 1), np.nan)
        surface[grid["row"], grid["col"]] = grid[value]
        at = np.unique(nodes[["vr", "vc"]].to_numpy(), axis=0)
        try:
            r = solve(surface, at)
        except ResistanceError as e:
            raise ResistanceError(f"region {key[0]!r}: {e}") from e
        i, j = np.triu_indices(len(at), 1)
        return pd.DataFrame(dict(zip(names, ([key[0]] * len(i), at[i, 0], at[i, 1], at[j, 0], at[j, 1], r[i, j]), strict=True)))

    own = vertices.select("region", "row", "col", F.col(value).cast("double").alias(value)).groupBy("region")
    return own.cogroup(terminals.select("region", "vr", "vc").distinct().groupBy("region")).applyInPandas(
        run, "region string, r1 int, c1 int, r2 int, c2 int, resistance double"
    )


def chain_resistances(vertices: DataFrame, value: str = "conductance") -> DataFrame:
    """Running resistance from the first vertex of rasters of one row: region, col, at. The resistance of two
    vertices is the difference of theirs."""
    by = Window.partitionBy("region").orderBy("col")
    step = 2.0 / (F.lag(value).over(by) + F.col(value))
    stepped = vertices.withColumn("_step", F.coalesce(step, F.lit(0.0)))
    return stepped.withColumn("at", F.sum("_step").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def pair_resistances(pairs: DataFrame, resistance: DataFrame) -> DataFrame:
    """pairs with distance: the resistance of their vertices, 0 where both are one.

    pairs: region, left_vr, left_vc, right_vr, right_vc and other columns.
    """
    left, right = (F.struct(F.col(f"{side}_vr").alias("r"), F.col(f"{side}_vc").alias("c")) for side in ("left", "right"))
    ordered = pairs.withColumn("_a", F.least(left, right)).withColumn("_b", F.greatest(left, right))
    known = resistance.select(
        F.col("region").alias("_r"), F.struct(F.col("r1").alias("r"), F.col("c1").alias("c")).alias("_p"),
        F.struct(F.col("r2").alias("r"), F.col("c2").alias("c")).alias("_q"), F.col("resistance").alias("_d"),
    )
    on = (ordered["region"] == known["_r"]) & (ordered["_a"] == known["_p"]) & (ordered["_b"] == known["_q"])
    out = ordered.join(known, on, "left")
    return out.withColumn("distance", F.when(F.col("_a") == F.col("_b"), F.lit(0.0)).otherwise(F.col("_d"))).drop("_a", "_b", "_r", "_p", "_q", "_d")
