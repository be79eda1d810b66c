"""Layers of the patch networks, plain and recorded.

Plain computes arrays. Tape has the same layers over nodes that remember how to pull a gradient back,
so that a network written once can be run either way.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np


def _columns(x: np.ndarray) -> np.ndarray:
    """(n, c, 9, h, w): the 3 x 3 neighbours of each cell, 0 beyond the border."""
    h, k = x.shape[2:]
    p = np.pad(x, ((0, 0), (0, 0), (1, 1), (1, 1)))
    return np.stack([p[:, :, i : i + h, j : j + k] for i in range(3) for j in range(3)], 2)


class Plain:
    @staticmethod
    def conv3(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
        """3 x 3 convolution with a border of zeros. x: (n, in, h, w); w: (out, in, 3, 3)."""
        return np.einsum("ocq,ncqhw->nohw", w.reshape(len(w), w.shape[1], 9), _columns(x), optimize=True) + b[:, None, None]

    @staticmethod
    def conv1(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.einsum("oc,nchw->nohw", w, x, optimize=True) + b[:, None, None]

    @staticmethod
    def up2(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Transposed 2 x 2 convolution with stride 2. w: (in, out, 2, 2)."""
        y = np.einsum("nchw,coij->nohiwj", x, w, optimize=True)
        n, o, h, _, k, _ = y.shape
        return y.reshape(n, o, 2 * h, 2 * k) + b[:, None, None]

    @staticmethod
    def group_norm(x: np.ndarray, groups: int, scale: np.ndarray, shift: np.ndarray, eps: float = 1e-5) -> np.ndarray:
        g = x.reshape(len(x), groups, -1)
        g = (g - g.mean(2, keepdims=True)) / np.sqrt(g.var(2, keepdims=True) + eps)
        return g.reshape(x.shape) * scale[:, None, None] + shift[:, None, None]

    @staticmethod
    def pool2(x: np.ndarray) -> np.ndarray:
        """Maximum over 2 x 2 cells; an odd last row or column is left out."""
        n, c, h, w = x.shape
        return x[:, :, : h // 2 * 2, : w // 2 * 2].reshape(n, c, h // 2, 2, w // 2, 2).max((3, 5))

    @staticmethod
    def relu(x: np.ndarray) -> np.ndarray:
        return np.maximum(x, 0)

    @staticmethod
    def gelu(x: np.ndarray) -> np.ndarray:
        return 0.5 * x * (1 + np.tanh(math.sqrt(2 / math.pi) * (x + 0.044715 * x**3)))

    @staticmethod
    def add(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return x + y

    @staticmethod
    def mean(x: np.ndarray) -> np.ndarray:
        """Over the cells."""
        return x.mean((2, 3))

    @staticmethod
    def beside(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Channels of both."""
        return np.concatenate([x, y], 1)

    @staticmethod
    def fitted(x: np.ndarray, like: np.ndarray) -> np.ndarray:
        """Cut or padded with zeros to the rows and columns of another."""
        h, w = like.shape[2:]
        return np.pad(x[:, :, :h, :w], ((0, 0), (0, 0), (0, max(0, h - x.shape[2])), (0, max(0, w - x.shape[3]))))

    @staticmethod
    def scaled(x: np.ndarray, by: np.ndarray) -> np.ndarray:
        """Channels times fixed numbers (dropout)."""
        return x * by.reshape(*by.shape, *([1] * (x.ndim - by.ndim)))


class Node:
    """A value and how its gradient comes from that of what was made of it."""

    def __init__(self, value: np.ndarray, parents: tuple[Node, ...] = (), pull: Callable[[np.ndarray], tuple] | None = None):
        self.value, self.parents, self.pull, self.grad = value, parents, pull, None

    @property
    def shape(self) -> tuple[int, ...]:
        return self.value.shape

    def backward(self, grad: np.ndarray) -> None:
        """Leave in every node that this one depends on the gradient of sum(grad * value)."""
        order, seen, todo = [], set(), [(self, False)]
        while todo:
            node, done = todo.pop()
            if done:
                order.append(node)
            elif id(node) not in seen:
                seen.add(id(node))
                todo += [(node, True), *((p, False) for p in node.parents)]
        self.grad = grad
        for node in reversed(order):
            if node.pull is not None and node.grad is not None:
                for parent, g in zip(node.parents, node.pull(node.grad), strict=True):
                    parent.grad = g if parent.grad is None else parent.grad + g


class Tape:
    @staticmethod
    def conv3(x: Node, w: Node, b: Node) -> Node:
        cols, flat = _columns(x.value), w.value.reshape(len(w.value), w.value.shape[1], 9)
        h, k = x.value.shape[2:]

        def pull(g: np.ndarray) -> tuple:
            by_cols = np.einsum("ocq,nohw->ncqhw", flat, g, optimize=True)
            by_x = np.zeros((*x.value.shape[:2], h + 2, k + 2), g.dtype)
            for q in range(9):
                by_x[:, :, q // 3 : q // 3 + h, q % 3 : q % 3 + k] += by_cols[:, :, q]
            return by_x[:, :, 1:-1, 1:-1], np.einsum("nohw,ncqhw->ocq", g, cols, optimize=True).reshape(w.value.shape), g.sum((0, 2, 3))

        return Node(np.einsum("ocq,ncqhw->nohw", flat, cols, optimize=True) + b.value[:, None, None], (x, w, b), pull)

    @staticmethod
    def conv1(x: Node, w: Node, b: Node) -> Node:
        pull = lambda g: (np.einsum("oc,nohw->nchw", w.value, g), np.einsum("nohw,nchw->oc", g, x.value), g.sum((0, 2, 3)))
        return Node(Plain.conv1(x.value, w.value, b.value), (x, w, b), pull)

    @staticmethod
    def up2(x: Node, w: Node, b: Node) -> Node:
        def pull(g: np.ndarray) -> tuple:
            n, o, h, k = g.shape
            parts = g.reshape(n, o, h // 2, 2, k // 2, 2)
            return np.einsum("nohiwj,coij->nchw", parts, w.value, optimize=True), np.einsum("nohiwj,nchw->coij", parts, x.value, optimize=True), g.sum((0, 2, 3))

        return Node(Plain.up2(x.value, w.value, b.value), (x, w, b), pull)

    @staticmethod
    def group_norm(x: Node, groups: int, scale: Node, shift: Node, eps: float = 1e-5) -> Node:
        v = x.value.reshape(len(x.value), groups, -1)
        spread = np.sqrt(v.var(2, keepdims=True) + eps)
        unit = (v - v.mean(2, keepdims=True)) / spread

        def pull(g: np.ndarray) -> tuple:
            by = (g * scale.value[:, None, None]).reshape(v.shape)
            by_v = (by - by.mean(2, keepdims=True) - unit * (by * unit).mean(2, keepdims=True)) / spread
            return by_v.reshape(g.shape), (g * unit.reshape(g.shape)).sum((0, 2, 3)), g.sum((0, 2, 3))

        return Node(unit.reshape(x.value.shape) * scale.value[:, None, None] + shift.value[:, None, None], (x, scale, shift), pull)

    @staticmethod
    def pool2(x: Node) -> Node:
        n, c, h, w = x.value.shape
        parts = x.value[:, :, : h // 2 * 2, : w // 2 * 2].reshape(n, c, h // 2, 2, w // 2, 2)
        top = parts.max((3, 5))

        def pull(g: np.ndarray) -> tuple:
            most = parts == top[:, :, :, None, :, None]  # equal cells share
            by = np.zeros_like(x.value)
            by[:, :, : h // 2 * 2, : w // 2 * 2] = (most / most.sum((3, 5), keepdims=True) * g[:, :, :, None, :, None]).reshape(n, c, h // 2 * 2, w // 2 * 2)
            return (by,)

        return Node(top, (x,), pull)

    @staticmethod
    def relu(x: Node) -> Node:
        return Node(Plain.relu(x.value), (x,), lambda g: (g * (x.value > 0),))

    @staticmethod
    def gelu(x: Node) -> Node:
        def pull(g: np.ndarray) -> tuple:
            v, c = x.value, math.sqrt(2 / math.pi)
            t = np.tanh(c * (v + 0.044715 * v**3))
            return (g * (0.5 * (1 + t) + 0.5 * v * (1 - t * t) * c * (1 + 3 * 0.044715 * v * v)),)

        return Node(Plain.gelu(x.value), (x,), pull)

    @staticmethod
    def add(x: Node, y: Node) -> Node:
        return Node(x.value + y.value, (x, y), lambda g: (g, g))

    @staticmethod
    def mean(x: Node) -> Node:
        h, w = x.value.shape[2:]
        return Node(Plain.mean(x.value), (x,), lambda g: (np.broadcast_to(g[:, :, None, None] / (h * w), x.value.shape),))

    @staticmethod
    def beside(x: Node, y: Node) -> Node:
        c = x.value.shape[1]
        return Node(Plain.beside(x.value, y.value), (x, y), lambda g: (g[:, :c], g[:, c:]))

    @staticmethod
    def fitted(x: Node, like: Node) -> Node:
        def pull(g: np.ndarray) -> tuple:
            by = np.zeros_like(x.value)
            h, w = min(g.shape[2], by.shape[2]), min(g.shape[3], by.shape[3])
            by[:, :, :h, :w] = g[:, :, :h, :w]
            return (by,)

        return Node(Plain.fitted(x.value, like.value), (x,), pull)

    @staticmethod
    def scaled(x: Node, by: np.ndarray) -> Node:
        return Node(Plain.scaled(x.value, by), (x,), lambda g: (Plain.scaled(g, by),))


Tree = dict | list | tuple | np.ndarray


def flat(tree: Tree, prefix: str) -> dict[str, np.ndarray]:
    """The arrays of a tree by the names of their places."""
    if isinstance(tree, np.ndarray):
        return {prefix: tree}
    items = tree.items() if isinstance(tree, dict) else enumerate(tree)
    return {k: v for name, part in items for k, v in flat(part, f"{prefix}.{name}").items()}


def rebuilt(tree: Tree, prefix: str, leaf: Callable[[str], object]):
    """A tree of the same form, its leaves made from the names of their places."""
    if isinstance(tree, np.ndarray):
        return leaf(prefix)
    if isinstance(tree, dict):
        return {k: rebuilt(v, f"{prefix}.{k}", leaf) for k, v in tree.items()}
    return type(tree)(rebuilt(v, f"{prefix}.{i}", leaf) for i, v in enumerate(tree))
