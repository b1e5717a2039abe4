"""A robust-pruned graph over unit vectors, built and searched with arrays.

Nodes enter in batches of doubling size. A greedy beam search through the graph so far proposes
neighbours for each new node. Relaxed pruning takes the nearest proposal, drops every other one that is
``RELAXED`` times nearer to it than to the node, and goes on, so that the edges kept lead in different directions.
Edges are mirrored; a node with too many is pruned in the same way. Many searches run side by side.
"""

from __future__ import annotations

import numpy as np

#: Edges of a node, nodes in a beam, relaxation of the pruning.
DEGREE, BEAM, RELAXED = 32, 64, 1.1
#: Searches side by side; their marks of visited nodes take so many bytes for each node of the graph.
TOGETHER = 512
FIRST = 32


def beam_search(
    vectors: np.ndarray, edges: np.ndarray, entry: int, queries: np.ndarray, width: int = BEAM
) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of each query's final beam, nearest first, and their squared distances.

    ``edges`` has a row of neighbours for each node, -1 where it has fewer. Missing places of a beam are -1 too.
    """
    n, m = len(vectors), len(queries)
    beam = np.full((m, width), -1, dtype=np.int64)
    far = np.full((m, width), np.inf, dtype=np.float32)
    done = np.ones((m, width), dtype=bool)
    beam[:, 0], far[:, 0], done[:, 0] = entry, ((queries - vectors[entry]) ** 2).sum(axis=1), False
    seen = np.zeros((m, n + 1), dtype=bool)  # the last column stands for a missing neighbour
    seen[:, [entry, n]] = True
    going = np.arange(m)
    while len(going):
        # Beams are sorted, so the first node not yet followed is the nearest.
        place = np.argmin(done[going], axis=1)
        open_ = ~done[going, place]
        going, place = going[open_], place[open_]
        if not len(going):
            break
        done[going, place] = True
        near = edges[beam[going, place]]
        near = np.where(near < 0, n, near)
        new = ~seen[going[:, None], near]
        seen[going[:, None], near] = True
        row, col = np.nonzero(new)
        node = near[row, col]
        apart = np.full(near.shape, np.inf, dtype=np.float32)
        step = vectors[node] - queries[going[row]]
        apart[row, col] = np.einsum("ij,ij->i", step, step)
        nodes = np.concatenate([beam[going], np.where(new, near, -1)], axis=1)
        apart = np.concatenate([far[going], apart], axis=1)
        closed = np.concatenate([done[going], ~new], axis=1)
        order = np.argsort(apart, axis=1, kind="stable")[:, :width]
        beam[going] = np.take_along_axis(nodes, order, axis=1)
        far[going] = np.take_along_axis(apart, order, axis=1)
        done[going] = np.take_along_axis(closed, order, axis=1)
    return beam, far


def robust_prune(
    vectors: np.ndarray, nodes: np.ndarray, proposals: np.ndarray, degree: int, relaxed: float
) -> np.ndarray:
    """Edges for each node out of its row of proposals (-1: none; repeats count once)."""
    apart = ((vectors[proposals] - vectors[nodes][:, None, :]) ** 2).sum(axis=2)
    apart[(proposals < 0) | (proposals == nodes[:, None])] = np.inf
    order = np.lexsort((proposals, apart))
    proposals, apart = np.take_along_axis(proposals, order, 1), np.take_along_axis(apart, order, 1)
    twice = np.zeros(proposals.shape, dtype=bool)
    twice[:, 1:] = proposals[:, 1:] == proposals[:, :-1]
    apart[twice] = np.inf
    points = vectors[proposals]
    between = np.einsum("ijk,ilk->ijl", points, points, optimize=True)
    square = np.einsum("ijk,ijk->ij", points, points)
    between = square[:, :, None] + square[:, None, :] - 2 * between
    edges = np.full((len(nodes), degree), -1, dtype=np.int32)
    free = np.isfinite(apart)
    rows = np.arange(len(nodes))
    for i in range(degree):
        first = np.argmax(free, axis=1)
        some = free[rows, first]
        if not some.any():
            break
        edges[some, i] = proposals[rows, first][some]
        # Squared distances, so the relaxation is squared as well.
        covered = relaxed**2 * between[rows, first] <= apart
        free &= ~(covered & some[:, None])
        free[rows, first] = False
    return edges


def _mirrored(
    vectors: np.ndarray, edges: np.ndarray, fresh: np.ndarray, degree: int, relaxed: float
) -> None:
    """Adds to ``edges`` those that lead back to ``fresh`` nodes."""
    row, col = np.nonzero(edges[fresh] >= 0)
    source, target = fresh[row], edges[fresh[row], col]
    apart = ((vectors[source] - vectors[target]) ** 2).sum(axis=1)
    order = np.lexsort((source, apart, target))
    source, target = source[order], target[order]
    nodes, start, count = np.unique(target, return_index=True, return_counts=True)
    rank = np.arange(len(target)) - np.repeat(start, count)
    # The nearest new ones are enough: a node keeps ``degree`` edges of all it is offered.
    kept = rank < 2 * degree
    offered = np.full((len(nodes), 2 * degree), -1, dtype=np.int64)
    offered[np.repeat(np.arange(len(nodes)), count)[kept], rank[kept]] = source[kept]
    both = np.concatenate([edges[nodes].astype(np.int64), offered], axis=1)
    for at in range(0, len(nodes), TOGETHER):
        some = slice(at, at + TOGETHER)
        edges[nodes[some]] = robust_prune(vectors, nodes[some], both[some], degree, relaxed)


def _spread(edges: np.ndarray, reached: np.ndarray, start: int) -> None:
    """Marks all nodes that can be reached from ``start``."""
    reached[start] = True
    front = np.array([start])
    while len(front):
        front = np.unique(edges[front])
        front = front[front >= 0]
        front = front[~reached[front]]
        reached[front] = True


def _joined_up(vectors: np.ndarray, edges: np.ndarray, entry: int) -> np.ndarray:
    """Edges with one more column, used where it takes an edge more to reach every node from the entry."""
    edges = np.concatenate([edges, np.full((len(edges), 1), -1, dtype=np.int32)], axis=1)
    reached = np.zeros(len(edges), dtype=bool)
    _spread(edges, reached, entry)
    for node in np.flatnonzero(~reached):
        if reached[node]:
            continue
        # The node found last has its own place free, so there is always one.
        free = np.flatnonzero(reached & (edges[:, -1] < 0))
        near = free[np.argmin(((vectors[free] - vectors[node]) ** 2).sum(axis=1))]
        edges[near, -1] = node
        _spread(edges, reached, node)
    return edges


def build(
    vectors: np.ndarray, degree: int = DEGREE, width: int = BEAM, relaxed: float = RELAXED
) -> tuple[np.ndarray, int]:
    """Edges (a row for each vector, -1 where there are fewer) and the node to enter by.

    A node has ``degree`` edges at most, and one more where another node could not be reached without it.
    The vectors should differ from one another: equal ones cover each other in pruning.
    """
    n = len(vectors)
    edges = np.full((n, degree), -1, dtype=np.int32)
    if not n:
        return np.full((n, degree + 1), -1, dtype=np.int32), 0
    middle = vectors.mean(axis=0)
    entry = int(np.argmin(((vectors - middle) ** 2).sum(axis=1)))
    # The order of entering must not follow the order of the ids; a fixed seed repeats it.
    order = np.random.default_rng(42).permutation(n)
    order = np.concatenate([[entry], order[order != entry]])
    at, size = 1, FIRST
    while at < n:
        fresh = order[at : at + size]
        for start in range(0, len(fresh), TOGETHER):
            some = fresh[start : start + TOGETHER]
            beam, _ = beam_search(vectors, edges, entry, vectors[some], width)
            if at <= FIRST:  # the first nodes see each other
                beam = np.concatenate([beam, np.broadcast_to(fresh, (len(some), len(fresh)))], axis=1)
            edges[some] = robust_prune(vectors, some, beam, degree, relaxed)
        _mirrored(vectors, edges, fresh, degree, relaxed)
        at += len(fresh)
        size = min(2 * size, at)
    return _joined_up(vectors, edges, entry), entry
