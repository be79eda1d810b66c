"""Patch networks, evaluated in NumPy: a small residual net for patches, a U-shaped net for whole grids."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from gridkin.operators.alignment import unit_vertices
from gridkin.operators.models import EmbeddingModel, Params, flat_patches, patches
from gridkin.operators.tape import Node, Plain, Tape, flat, rebuilt


def _layer(rng: np.random.Generator, out: int, into: int, *kernel: int) -> dict[str, np.ndarray]:
    bound = 1 / math.sqrt(into * math.prod(kernel))
    return {"w": rng.uniform(-bound, bound, (out, into, *kernel)).astype(np.float32), "b": rng.uniform(-bound, bound, out).astype(np.float32)}


def _norm(width: int) -> dict[str, np.ndarray]:
    return {"scale": np.ones(width, np.float32), "shift": np.zeros(width, np.float32)}


def count(tree) -> int:
    """Numbers in a tree of arrays."""
    if isinstance(tree, np.ndarray):
        return tree.size
    return sum(count(v) for v in (tree.values() if isinstance(tree, dict) else tree))


@dataclass(frozen=True)
class ResNet9:
    """(n, features, size, size) -> (n, widths[2]): three convolutions, a pool and a residual pair after each of
    the first two, and the mean over the patch. Widths are multiples of 8, patches 4 cells or more."""

    layers: tuple
    groups: int = 8

    @classmethod
    def random(cls, features: int, widths: tuple[int, int, int] = (64, 128, 256), seed: int = 0) -> ResNet9:
        if len(widths) != 3 or any(w < 8 or w % 8 for w in widths):
            raise ValueError("three widths are needed, multiples of 8")
        rng, (a, b, c) = np.random.default_rng(seed), widths
        block = lambda o, i: {**_layer(rng, o, i, 3, 3), **_norm(o)}
        return cls((block(a, features), block(a, a), block(a, a), block(b, a), block(b, b), block(b, b), block(c, b)))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.run(Plain, self.layers, x)

    def run(self, ops, layers: tuple, x):
        """ops: Plain over arrays, or Tape over nodes."""
        if min(x.shape[2:]) < 4:
            raise ValueError("patches need 4 cells a side")
        stage = lambda x, p: ops.relu(ops.group_norm(ops.conv3(x, p["w"], p["b"]), self.groups, p["scale"], p["shift"]))
        for conv, one, two in (layers[:3], layers[3:6]):
            x = ops.pool2(stage(x, conv))
            x = ops.add(x, stage(stage(x, one), two))
        return ops.mean(stage(x, layers[6]))


@dataclass(frozen=True)
class UNet:
    """(1, values of a patch, rows, cols) -> (1, width, rows, cols): patch embedding, two stages down, a
    bottleneck, two up with skips, a 1 x 1 head."""

    layers: dict

    @classmethod
    def random(cls, features: int, patch_size: int, base: int, width: int, seed: int = 0) -> UNet:
        rng = np.random.default_rng(seed)
        block = lambda o, i: {**_layer(rng, o, i, 3, 3), **_norm(o)}
        return cls({
            "embed": {**_layer(rng, base, features * patch_size**2), **_norm(base)},
            "down": [block(base, base), block(2 * base, base)], "middle": block(4 * base, 2 * base),
            "up": [{"w": _layer(rng, 4 * base, 2 * base, 2, 2)["w"], "b": np.zeros(2 * base, np.float32)}, {"w": _layer(rng, 2 * base, base, 2, 2)["w"], "b": np.zeros(base, np.float32)}],
            "merge": [block(2 * base, 4 * base), block(base, 2 * base)], "head": _layer(rng, width, base),
        })

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.run(Plain, self.layers, x)

    def run(self, ops, p: dict, x):
        """ops: Plain over arrays, or Tape over nodes."""
        width = lambda q: (q["scale"].shape)[0]
        stage = lambda x, q: ops.gelu(ops.group_norm(ops.conv3(x, q["w"], q["b"]), math.gcd(8, width(q)), q["scale"], q["shift"]))
        e = p["embed"]
        x = ops.gelu(ops.group_norm(ops.conv1(x, e["w"], e["b"]), math.gcd(8, width(e)), e["scale"], e["shift"]))
        skips = []
        for q in p["down"]:
            x = stage(x, q)
            skips.append(x)
            x = ops.pool2(x) if min(x.shape[2:]) > 1 else x
        x = stage(x, p["middle"])
        for up, merge, skip in zip(p["up"], p["merge"], reversed(skips), strict=True):
            x = ops.fitted(ops.up2(x, up["w"], up["b"]), skip)
            x = stage(ops.beside(skip, x), merge)
        return ops.conv1(x, p["head"]["w"], p["head"]["b"])


@dataclass(frozen=True)
class UNetEmbedding(EmbeddingModel):
    """A vector for each unit: the network's value at its patch. Each species has its slice of the width."""

    network: UNet | None = None

    def params(self) -> Params:
        return {k: v.astype(float) for k, v in flat(self.network.layers, "network").items()}

    def with_params(self, p: Params) -> UNetEmbedding:
        return replace(self, network=replace(self.network, layers=rebuilt(self.network.layers, "network", lambda k: np.asarray(p[k], np.float32))))

    def grid(self, cells: DataFrame) -> DataFrame:
        return flat_patches(cells, self.patch_size)

    def kernel(self, p: Params, s: int, shape: tuple[int, int], x: np.ndarray, left: np.ndarray, right: np.ndarray, seed: int | None = None):
        nodes = {k: Node(np.asarray(v, float)) for k, v in p.items() if k.startswith("network")}
        layers = rebuilt(self.network.layers, "network", lambda k: nodes[k])
        out = self.network.run(Tape, layers, Node(x.T.reshape(1, -1, *shape)))
        width = out.shape[1] // len(self.species)
        part = slice(s * width, (s + 1) * width)
        vectors = out.value[0, part].reshape(width, -1)
        step = vectors[:, left] - vectors[:, right]

        def back(by_distance: np.ndarray) -> Params:
            by = 2 * step * by_distance
            g = np.zeros_like(out.value).reshape(out.shape[1], -1)
            for k in range(width):
                g[s * width + k] = np.bincount(left, by[k], minlength=g.shape[1]) - np.bincount(right, by[k], minlength=g.shape[1])
            out.backward(g.reshape(out.shape))
            return {k: nodes[k].grad if k in nodes and nodes[k].grad is not None else np.zeros_like(v) for k, v in p.items()}

        return (step**2).sum(0), back

    def embedding(self, cells: DataFrame, units: DataFrame) -> DataFrame:
        net, size, names = self.network, self.patch_size, self.species

        def run(key: tuple, grid: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
            shape = int(grid["row"].max()) + 1, int(grid["col"].max()) + 1
            flat = np.stack([np.concatenate([np.asarray(c["features"], np.float32) for c in cs]) for cs in grid["cells"]])
            x = np.zeros((flat.shape[1], *shape), np.float32)
            x[:, grid["row"], grid["col"]] = flat.T
            z = net(x[None])[0]
            width = len(z) // len(names)
            out = []
            for r in nodes.itertuples():
                s = names.index(r.species if isinstance(r.species, str) else None)
                out.append((r.region, r.species, r.unit, z[s * width : (s + 1) * width, r.vr, r.vc].astype(float).tolist()))
            return pd.DataFrame(out, columns=["region", "species", "unit", "vector"])

        at = unit_vertices(units, size).select("region", "species", "unit", "vr", "vc")
        own = patches(cells, size).join(at.select("region").distinct(), "region", "left_semi")
        return own.groupBy("region").cogroup(at.groupBy("region")).applyInPandas(run, "region string, species string, unit string, vector array<double>")


def dropout_mask(shape: tuple[int, int], rate: float, seed: int | None) -> np.ndarray:
    """What a layer's channels are multiplied by: a part at 0 and the rest scaled up, drawn by the seed of an
    update; all ones outside training (no seed)."""
    if seed is None or rate == 0:
        return np.ones(shape)
    return (np.random.default_rng(seed).random(shape) >= rate) / (1 - rate)
