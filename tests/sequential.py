"""Louvain in one place, node after node: what the distributed moves are measured against."""

import logging

import numpy as np

log = logging.getLogger(__name__)


def _one_level(neighbours: list[dict[int, float]], loops: np.ndarray, resolution: float, order: np.ndarray, sweeps: int) -> tuple[np.ndarray, bool]:
    """Moves nodes to the neighbouring community of the largest gain until none moves or the cap is met, which is logged."""
    strength = (np.array([sum(d.values()) for d in neighbours]) + 2 * loops).tolist()  # plain lists: read a number at a time
    scale = resolution / sum(strength)
    home, held, order = list(range(len(neighbours))), strength.copy(), order.tolist()
    any_moved = False
    for _ in range(sweeps):
        moved = False
        for v in order:
            mine, own = home[v], strength[v]
            links: dict[int, float] = {}
            for u, w in neighbours[v].items():
                c = home[u]
                links[c] = links.get(c, 0.0) + w
            held[mine] -= own
            pull = scale * own
            best, gain = mine, links.get(mine, 0.0) - pull * held[mine]
            for c, w in links.items():
                if w - pull * held[c] > gain + 1e-12:
                    best, gain = c, w - pull * held[c]
            held[best] += own
            if best != mine:
                home[v], moved, any_moved = best, True, True
        if not moved:
            break
    else:
        log.warning("louvain: a level of %d nodes was cut off after %d sweeps", len(neighbours), sweeps)
    return np.array(home), any_moved


def modularity(neighbours: list[dict[int, float]], loops: np.ndarray, home: np.ndarray, resolution: float) -> float:
    strength = np.array([sum(d.values()) for d in neighbours]) + 2 * loops
    twice = strength.sum()
    inside = sum(w for v, d in enumerate(neighbours) for u, w in d.items() if home[u] == home[v]) + 2 * loops.sum()
    return inside / twice - resolution * (np.bincount(home, strength) ** 2).sum() / twice**2


def louvain(a: np.ndarray, b: np.ndarray, weight: np.ndarray, n: int, resolution: float = 10.0, seed: int = 1997, threshold: float = 1e-7, sweeps: int = 1000, max_level: int | None = None) -> np.ndarray:
    """Communities of nodes 0..n-1 joined by undirected weighted pairs (a, b), each once.

    ``threshold`` is the least gain of modularity that makes another level worth while; ``sweeps`` caps
    the passes within a level and ``max_level`` (None: no cap) the levels.
    """
    if max_level is not None and max_level <= 0:
        raise ValueError("max_level must be positive or None")
    neighbours: list[dict[int, float]] = [{} for _ in range(n)]
    for x, y, w in zip(a.tolist(), b.tolist(), weight.tolist(), strict=True):
        neighbours[x][y] = w
        neighbours[y][x] = w
    label, loops = np.arange(n), np.zeros(n)
    if not len(a):
        return label
    rng = np.random.default_rng(seed)
    quality = modularity(neighbours, loops, np.arange(n), resolution)
    level = 0
    while max_level is None or level < max_level:
        home, moved = _one_level(neighbours, loops, resolution, rng.permutation(len(neighbours)), sweeps)
        if not moved:
            break
        better = modularity(neighbours, loops, home, resolution)
        if better - quality <= threshold:
            break
        quality, level = better, level + 1
        names, home = np.unique(home, return_inverse=True)
        label = home[label]
        joined: list[dict[int, float]] = [{} for _ in names]
        inner = np.zeros(len(names))
        for v, d in enumerate(neighbours):
            inner[home[v]] += loops[v]
            for u, w in d.items():
                if home[u] == home[v]:
                    inner[home[v]] += w / 2
                else:
                    joined[home[v]][home[u]] = joined[home[v]].get(home[u], 0.0) + w
        neighbours, loops = joined, inner
    return label
