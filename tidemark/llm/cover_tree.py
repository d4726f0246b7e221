"""Cover trees in numpy and a dual-tree search for the largest inner products.

The children of a node are a net of half its radius: every point lies within
half the radius of its child's centre (covering) and centres lie further apart
than that (separation).  Where a net would need more than ``WIDEST`` centres
the points do not fall into groups at that scale, and the node stays a leaf,
whatever its size; no level is ever cut short.  Radii are those measured.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

WIDEST = 32
TILE = 256  # queries of a leaf compared at once
NEVER = np.iinfo(np.int64).min  # no score
TOO_SMALL = NEVER + 1  # stands for scores that 64 bits do not hold
EXACT = 2.0**52  # floats hold whole numbers up to here
ERROR = 1e-11  # more than the relative error of a product of two vectors


@dataclass
class Node:
    """Points ``order[start:end]`` of a tree, all within ``radius`` of ``centre``."""

    start: int
    end: int
    centre: np.ndarray
    radius: float
    norm: float
    children: list[Node] = field(default_factory=list)


class CoverTree:
    def __init__(self, points: np.ndarray, leaf: int):
        self.points, self.leaf, self.order = points, leaf, np.arange(len(points))
        self.norms = np.sqrt(np.einsum("ij,ij->i", points, points))
        self.root = self._node(0, len(points), points[0])
        stack = [self.root]
        while stack:
            node = stack.pop()
            if node.end - node.start > self.leaf and node.radius > 0:
                node.children = self._split(node)
                stack += node.children

    def _node(self, start: int, end: int, centre: np.ndarray) -> Node:
        away = self.points[self.order[start:end]] - centre
        radius = float(np.sqrt(np.einsum("ij,ij->i", away, away).max()))
        return Node(start, end, centre, radius, float(np.sqrt(centre @ centre)))

    def _split(self, node: Node) -> list[Node]:
        """A net of half the radius, farthest first; none if it would be too wide."""
        own = self.order[node.start : node.end]
        points = self.points[own]
        centres, nearest = [node.centre], np.zeros(len(own), np.int64)
        away = points - node.centre
        least = np.einsum("ij,ij->i", away, away)
        while least.max() > (node.radius / 2) ** 2:
            if len(centres) == WIDEST:
                return []
            centres.append(points[least.argmax()])
            away = points - centres[-1]
            distance = np.einsum("ij,ij->i", away, away)
            nearer = distance < least
            nearest[nearer], least[nearer] = len(centres) - 1, distance[nearer]
        by_child = np.argsort(nearest, kind="stable")
        self.order[node.start : node.end] = own[by_child]
        cuts = node.start + np.searchsorted(nearest[by_child], np.arange(len(centres) + 1))
        return [self._node(a, b, c) for a, b, c in zip(cuts[:-1].tolist(), cuts[1:].tolist(), centres, strict=True) if b > a]


def bound(q: Node, d: Node) -> float:
    """No inner product of a point in ``q`` and one in ``d`` is larger."""
    slack = 1 + ERROR * (q.norm + q.radius) * (d.norm + d.radius)
    return float(q.centre @ d.centre) + q.radius * d.norm + d.radius * q.norm + q.radius * d.radius + slack


class Data:
    """Points to search, in the order of their ids, and their tree."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, rows: np.ndarray):
        order = np.lexsort((rows, ids))
        self.points, self.ids, self.rows = points[order], ids[order], rows[order]
        self.tree = CoverTree(self.points, 256)


class Search:
    """The ``k`` best points of each query, by score and then by smaller id; never its own row.

    Points hold whole numbers as floats.  Scores are exact whatever their size;
    one beyond 64 bits raises an ``OverflowError`` if it is positive and is
    ``TOO_SMALL`` if it is negative.
    """

    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, query_rows: np.ndarray, k: int, at_least: np.ndarray | None = None):
        self.tree, self.ids, self.own, self.k = CoverTree(queries, 64), query_ids, query_rows, k
        self.scores = np.full((len(queries), k), NEVER)
        self.found = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.floor = np.full(len(queries), NEVER) if at_least is None else at_least

    def least(self, q: np.ndarray) -> np.ndarray:
        """The least score that could still matter to each query."""
        least = np.maximum(self.scores[q, -1], self.floor[q])
        return np.where(least == NEVER, -np.inf, least.astype(np.float64) - np.abs(least.astype(np.float64)) * 1e-15)

    def worst(self, q: Node) -> float:
        """The least score that could still matter to a query of the node."""
        return float(self.least(self.tree.order[q.start : q.end]).min())

    def look(self, data: Data) -> None:
        """Search one more block of points."""
        other = data.tree
        stack = [(self.tree.root, other.root, bound(self.tree.root, other.root))]
        while stack:
            q, d, most = stack.pop()
            if most < self.worst(q):
                continue
            if not q.children and not d.children:
                self.leaves(q, d, data)
                continue
            if d.children and (not q.children or d.radius >= q.radius):
                pairs = [(q, c, bound(q, c)) for c in d.children]
            else:
                pairs = [(c, d, bound(c, d)) for c in q.children]
            stack += sorted(pairs, key=lambda p: p[2])  # the most promising is taken next

    def leaves(self, q: Node, d: Node, data: Data) -> None:
        """Two leaves: single points that the query node's radius rules out are left out first."""
        places = np.sort(data.tree.order[d.start : d.end])
        norms = data.tree.norms[places]
        most = data.points[places] @ q.centre + q.radius * norms + 1 + ERROR * (q.norm + q.radius) * norms
        places = places[most >= self.worst(q)]
        for at in range(q.start, q.end, TILE):
            if len(places):
                self.compare(self.tree.order[at : min(q.end, at + TILE)], places, data)

    def compare(self, q: np.ndarray, d: np.ndarray, data: Data) -> None:
        score = self.products(q, d, data)
        score[self.own[q][:, None] == data.rows[d][None, :]] = NEVER
        least = np.maximum(self.scores[q, -1], self.floor[q])
        if len(d) > 4 * self.k:  # this tile's own kth best counts as well
            least = np.maximum(least, np.partition(score, len(d) - self.k, axis=1)[:, len(d) - self.k])
        columns = np.flatnonzero(((score >= least[:, None]) & (score > NEVER)).any(axis=0))
        if not len(columns):
            return
        scores = np.concatenate([self.scores[q], score[:, columns]], axis=1)
        ids = np.concatenate([self.found[q], np.broadcast_to(data.ids[d][columns], (len(q), len(columns)))], axis=1)
        best = np.lexsort((ids, ~scores), axis=1)[:, : self.k]
        self.scores[q], self.found[q] = np.take_along_axis(scores, best, 1), np.take_along_axis(ids, best, 1)

    def products(self, q: np.ndarray, d: np.ndarray, data: Data) -> np.ndarray:
        """Exact inner products; no partial sum is beyond the product of the two norms."""
        mine, other = self.tree.points[q], data.points[d]
        close = mine @ other.T
        size = np.outer(self.tree.norms[q], data.tree.norms[d])
        if size.max() < EXACT:
            return close.astype(np.int64)
        score = np.where(size < EXACT, close, 0).astype(np.int64)
        # of the large ones, those that cannot be among the best need not be exact
        error = 1 + ERROR * size
        least = self.least(q)
        if len(d) > self.k:  # the row's own point may be among the k + 1 best
            sure = np.partition(close - error, len(d) - self.k - 1, axis=1)[:, len(d) - self.k - 1]
            least = np.maximum(least, sure)
        large = size >= EXACT
        wanted = large & (close + error >= least[:, None])
        score[large & ~wanted] = NEVER
        for i, j in np.argwhere(wanted & (self.own[q][:, None] != data.rows[d][None, :])).tolist():
            exact = sum(int(a) * int(b) for a, b in zip(mine[i].tolist(), other[j].tolist(), strict=True))
            if exact >= 1 << 63:
                raise OverflowError(f"the score of {self.ids[q[i]]} and {data.ids[d[j]]} does not fit into 64 bits: {exact}")
            score[i, j] = max(exact, int(TOO_SMALL))
        return score

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Query's row and id, id found and score of all that was found, the best first."""
        row, column = np.nonzero(self.scores > NEVER)
        return self.own[row], self.ids[row], self.found[row, column], self.scores[row, column]
