"""A KD-tree over integer points, with subtree counts, that answers many boxes at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

LEAF = 16
#: Boxes that go down the tree together.
TOGETHER = 1024


class KdTree:
    """Points with weights. Each node knows the box around its points and their total weight, so a node inside a query is counted without going down."""

    def __init__(self, points: np.ndarray, weights: np.ndarray):
        self._order = np.arange(len(points))
        low, high, total, span, child = [], [], [], [], []
        open_ = [(0, len(points), -1)] if len(points) else []
        while open_:
            a, b, parent = open_.pop()
            mine = points[self._order[a:b]]
            node = len(total)
            if parent >= 0:
                child[parent].append(node)
            lo, hi = mine.min(axis=0), mine.max(axis=0)
            low.append(lo)
            high.append(hi)
            total.append(int(weights[self._order[a:b]].sum()))
            span.append((a, b))
            child.append([])
            if b - a > LEAF and (hi > lo).any():
                half = (b - a) // 2
                self._order[a:b] = self._order[a:b][np.argpartition(mine[:, int((hi - lo).argmax())], half)]
                open_ += [(a, a + half, node), (a + half, b, node)]
        self._low, self._high = np.array(low), np.array(high)
        self._total, self._span = np.array(total, dtype=np.int64), np.array(span, dtype=np.int64).reshape(-1, 2)
        self._child = np.array([c or [-1, -1] for c in child], dtype=np.int64).reshape(-1, 2)
        self._points, self._weights = points[self._order], weights[self._order]

    def _visit(self, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(box, node) pairs where a node lies inside a box, and (box, point) pairs found in leaves that a box cuts; level by level."""
        none = np.zeros(0, dtype=np.int64)
        for at in range(0, len(low) if len(self._total) else 0, TOGETHER):
            box = np.arange(at, min(at + TOGETHER, len(low)))
            node = np.zeros(len(box), dtype=np.int64)
            while len(box):
                meets = ((self._low[node] <= high[box]) & (self._high[node] >= low[box])).all(axis=1)
                box, node = box[meets], node[meets]
                inside = ((self._low[node] >= low[box]) & (self._high[node] <= high[box])).all(axis=1)
                yield box[inside], node[inside], none, none
                box, node = box[~inside], node[~inside]
                leaf = self._child[node, 0] < 0
                a, b = self._span[node[leaf]].T
                point = np.arange(int((b - a).sum())) + np.repeat(a - np.cumsum(b - a) + (b - a), b - a)
                who = np.repeat(box[leaf], b - a)
                fits = ((self._points[point] >= low[who]) & (self._points[point] <= high[who])).all(axis=1)
                yield none, none, who[fits], point[fits]
                box, node = np.repeat(box[~leaf], 2), self._child[node[~leaf]].ravel()

    def count(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The weight of the points in each box [low, high]."""
        out = np.zeros(len(low), dtype=np.int64)
        for box, node, who, point in self._visit(low, high):
            np.add.at(out, box, self._total[node])
            np.add.at(out, who, self._weights[point])
        return out

    def report(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (box, point) of all points in each box, points by their place in the constructor's array."""
        boxes, points = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for box, node, who, point in self._visit(low, high):
            a, b = self._span[node].T
            boxes += [np.repeat(box, b - a), who]
            points += [np.arange(int((b - a).sum())) + np.repeat(a - np.cumsum(b - a) + (b - a), b - a), point]
        return np.concatenate(boxes), self._order[np.concatenate(points)]
