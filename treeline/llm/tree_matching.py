"""Simple tree matching: the largest alignment of two ordered trees that keeps labels, parents and order."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


class Tree:
    """An ordered tree in pre-order: labels, children, sizes of subtrees. ``depth`` starts at 0 for the one root."""

    def __init__(self, depth: Sequence[int], label: Sequence[int]):
        self.depth, self.label = list(depth), list(label)
        self.children: list[list[int]] = [[] for _ in self.depth]
        self.size = [1] * len(self.depth)
        above: list[int] = []
        for at, d in enumerate(self.depth):
            del above[d:]
            if above:
                self.children[above[-1]].append(at)
            above.append(at)
        for at in range(len(self.depth) - 1, -1, -1):
            self.size[at] += sum(self.size[c] for c in self.children[at])

    def above(self) -> list[int]:
        """The parent of each node; the root's is -1."""
        found = [-1] * len(self.depth)
        for at, below in enumerate(self.children):
            for child in below:
                found[child] = at
        return found

    def shapes(self, known: dict) -> list[int]:
        """A number for each subtree, the same for equal ones; ``known`` holds the numbers given so far."""
        found = [0] * len(self.depth)
        for at in range(len(self.depth) - 1, -1, -1):
            found[at] = known.setdefault((self.label[at], *[found[c] for c in self.children[at]]), len(known))
        return found


def _row(weights: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """The weight of the best alignment of all of ``xs`` with each beginning of ``ys``."""
    row = np.zeros(len(ys) + 1, np.int64)
    for x in xs:
        row[1:] = np.maximum(row[1:], row[:-1] + weights[x, ys])
        np.maximum.accumulate(row, out=row)
    return row


def _chain(weights: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> list[tuple[int, int]]:
    """The places of one best alignment, found by halving ``xs``, so that no more than a row is held."""
    if not len(xs) or not len(ys):
        return []
    if len(xs) == 1:
        best = int(np.argmax(weights[xs[0], ys]))
        return [(0, best)] if weights[xs[0], ys[best]] else []
    half = len(xs) // 2
    apart = int(np.argmax(_row(weights, xs[:half], ys) + _row(weights, xs[half:][::-1], ys[::-1])[::-1]))
    return _chain(weights, xs[:half], ys[:apart]) + [(half + i, apart + j) for i, j in _chain(weights, xs[half:], ys[apart:])]


class _Matching:
    """Two trees with the weights of pairs of subtrees met so far, by shape."""

    def __init__(self, a: Tree, b: Tree):
        known: dict = {}
        self.a, self.b = a, b
        self.of_a, self.of_b = a.shapes(known), b.shapes(known)
        self.weights: dict[tuple[int, int], int] = {}

    def split(self, x: int, y: int) -> tuple[int, list[int], list[int]]:
        """Equal children at the front of both, how many, and what is left once equal ones at the end are off as well; both belong to a best alignment."""
        xs, ys = self.a.children[x], self.b.children[y]
        front, most = 0, min(len(xs), len(ys))
        while front < most and self.of_a[xs[front]] == self.of_b[ys[front]]:
            front += 1
        back = 0
        while back < most - front and self.of_a[xs[-1 - back]] == self.of_b[ys[-1 - back]]:
            back += 1
        return front, xs[front : len(xs) - back], ys[front : len(ys) - back]

    def known(self, x: int, y: int) -> int | None:
        if self.a.label[x] != self.b.label[y]:
            return 0
        if self.of_a[x] == self.of_b[y]:
            return self.a.size[x]
        return self.weights.get((self.of_a[x], self.of_b[y]))

    def table(self, xs: list[int], ys: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int]]]:
        """Weights by different shapes, the shapes' places of both lists, and the pairs whose weight is not known yet."""
        shapes_x, shapes_y = {self.of_a[x]: x for x in xs}, {self.of_b[y]: y for y in ys}
        place_x, place_y = {s: i for i, s in enumerate(shapes_x)}, {s: i for i, s in enumerate(shapes_y)}
        weights, missing = np.zeros((len(shapes_x), len(shapes_y)), np.int64), []
        for i, x in enumerate(shapes_x.values()):
            for j, y in enumerate(shapes_y.values()):
                weight = self.known(x, y)
                if weight is None:
                    missing.append((x, y))
                else:
                    weights[i, j] = weight
        return weights, np.array([place_x[self.of_a[x]] for x in xs], int), np.array([place_y[self.of_b[y]] for y in ys], int), missing

    def weigh(self, x: int, y: int) -> int:
        """The number of nodes in the best alignment of two subtrees; an explicit stack, as trees may be deep."""
        stack = [(x, y)]
        while stack:
            p, q = stack[-1]
            if self.known(p, q) is not None:
                stack.pop()
                continue
            front, xs, ys = self.split(p, q)
            weights, at_x, at_y, missing = self.table(xs, ys)
            if missing:
                stack.extend(missing)
                continue
            children = self.a.children[p]
            off = [*children[:front], *children[front + len(xs) :]]
            self.weights[self.of_a[p], self.of_b[q]] = 1 + sum(self.a.size[c] for c in off) + int(_row(weights, at_x, at_y)[-1])
            stack.pop()
        return self.known(x, y)


def matched(a: Tree, b: Tree) -> list[int]:
    """For each node of ``a`` its partner in ``b``, or -1: one best alignment. Roots with different labels match nothing."""
    found = [-1] * len(a.depth)
    if not found or not b.depth:
        return found
    matching = _Matching(a, b)
    pairs = [(0, 0)] if a.label[0] == b.label[0] else []
    while pairs:
        x, y = pairs.pop()
        if matching.of_a[x] == matching.of_b[y]:
            found[x : x + a.size[x]] = range(y, y + a.size[x])
            continue
        found[x] = y
        front, xs, ys = matching.split(x, y)
        pairs.extend(zip(a.children[x][:front], b.children[y][:front], strict=True))
        back_x, back_y = a.children[x][front + len(xs) :], b.children[y][front + len(ys) :]
        pairs.extend(zip(back_x, back_y, strict=True))
        for p, q in matching.table(xs, ys)[3]:
            matching.weigh(p, q)
        weights, at_x, at_y, _ = matching.table(xs, ys)
        pairs.extend((xs[i], ys[j]) for i, j in _chain(weights, at_x, at_y))
    return found
