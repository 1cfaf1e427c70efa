"""Graphs of tiles: robust pose solving, scalar corrections and components, a mosaic a group.

A mosaic's graph has a few numbers for each tile; the work on it is one group of applyInPandas, and mosaics are independent."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# Weights of the prior and of the anchored node (a row of 10 in least squares is 100 here), rounds.
PRIOR, ANCHOR, ROUNDS = 0.035, 100.0, 5
SCALAR_PRIOR = 0.04


def robust_limit(residual: np.ndarray) -> float:
    middle = np.median(residual)
    return max(1.5, middle + 2.5 * max(0.35, 1.4826 * np.median(np.abs(residual - middle))))


def scalar_limit(values: np.ndarray):
    """Beyond this a constraint of a scalar graph counts less; it does not fall under a share of the values themselves."""
    least = max(1e-4, 0.05 * float(np.median(np.abs(values)))) if len(values) else 1e-4

    def limit(residual: np.ndarray) -> float:
        return 2.5 * max(least, 1.4826 * float(np.median(np.abs(residual - np.median(residual)))))

    return limit


def solve(a, b, shift, weight, prior, rounds: int = ROUNDS, hold: float = PRIOR, anchor: float = ANCHOR, limit=robust_limit, signed: bool = False) -> np.ndarray:
    """Positions x with x[b] - x[a] near shift, held weakly to prior and by node 0: reweighted least squares. limit gives the
    residual beyond which an edge counts less; signed: of one number a node, whose residuals have a sign."""
    n, x, use = len(prior), prior.copy(), weight.copy()
    for _ in range(rounds):
        m = np.zeros((n, n))
        np.add.at(m, (a, a), use)
        np.add.at(m, (b, b), use)
        np.add.at(m, (a, b), -use)
        np.add.at(m, (b, a), -use)
        held = np.full(n, hold)
        held[0] += anchor
        m[np.arange(n), np.arange(n)] += held
        right = held[:, None] * prior
        np.add.at(right, a, -use[:, None] * shift)
        np.add.at(right, b, use[:, None] * shift)
        x = np.linalg.solve(m, right)
        residual = np.sqrt(((x[b] - x[a] - shift) ** 2).sum(axis=1))
        far = limit((x[b] - x[a] - shift)[:, 0] if signed else residual)
        use = np.maximum(1e-6, weight * np.minimum(1.0, far / np.maximum(residual, 1e-9)))
    return x


def _indexed(group: pd.DataFrame):
    nodes = np.unique(np.concatenate([group["a"], group["b"]]))
    return nodes, np.searchsorted(nodes, group["a"].to_numpy()), np.searchsorted(nodes, group["b"].to_numpy())


def pose_solve(edges: DataFrame, reject: bool = False, step: tuple[float, float, int] | None = None) -> DataFrame:
    """edges(mosaic, a, b, dy, dx, weight) -> mosaic, node, y, x (least y and x are 0). reject: drop the worst edge and solve
    again, at most 8 times, while its residual is far out. step: (down, right, columns) of the stage's lattice, on which nodes
    are numbered row by row, as the prior; without it the prior is a loose solve of the same edges (see geometry for tiles
    with stage positions)."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["a", "b"])
        nodes, a, b = _indexed(group)
        shift, weight = group[["dy", "dx"]].to_numpy(float), group["weight"].to_numpy(float)
        for _ in range(9 if reject else 1):
            if step:
                prior = np.stack([nodes // step[2] * step[0], nodes % step[2] * step[1]], 1).astype(float)
                prior -= prior.min(axis=0)
            else:
                prior = solve(a, b, shift, weight, np.zeros((len(nodes), 2)), 4 * ROUNDS, 1e-6)
            x = solve(a, b, shift, weight, prior)
            residual = np.sqrt(((x[b] - x[a] - shift) ** 2).sum(axis=1))
            live = np.flatnonzero(weight > 0)
            if not reject or len(live) < 3:
                break
            middle = np.median(residual[live])
            far = min(5.0, max(2.5, middle + 6 * max(0.15, 1.4826 * np.median(np.abs(residual[live] - middle)))))
            worst = live[np.argmax(residual[live])]
            if residual[worst] <= far:
                break
            weight[worst] = 0
        x = x - x.min(axis=0)
        return pd.DataFrame({"mosaic": group["mosaic"].iloc[0], "node": nodes, "y": x[:, 0].round(6) + 0.0, "x": x[:, 1].round(6) + 0.0})

    return edges.groupBy("mosaic").applyInPandas(run, "mosaic int, node long, y double, x double")


def scalar_solve(edges: DataFrame, prior: float = SCALAR_PRIOR) -> DataFrame:
    """edges(mosaic, a, b, d, weight) -> mosaic, node, value: one number a tile, b's less a's near d, of mean 0."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["a", "b"])
        nodes, a, b = _indexed(group)
        d = group[["d"]].to_numpy(float)
        x = solve(a, b, d, group["weight"].to_numpy(float), np.zeros((len(nodes), 1)), hold=prior, anchor=0.0, limit=scalar_limit(d), signed=True)[:, 0]
        return pd.DataFrame({"mosaic": group["mosaic"].iloc[0], "node": nodes, "value": (x - x.mean()).round(6) + 0.0})

    return edges.groupBy("mosaic").applyInPandas(run, "mosaic int, node long, value double")


def components(edges: DataFrame) -> DataFrame:
    """edges(mosaic, a, b) -> mosaic, node, comp (its least node): union-find inside a mosaic."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        nodes, a, b = _indexed(group)
        root = np.arange(len(nodes))
        while True:
            low = np.minimum(root[a], root[b])
            before = root.copy()
            np.minimum.at(root, a, low)
            np.minimum.at(root, b, low)
            root = root[root]
            if (root == before).all():
                break
        return pd.DataFrame({"mosaic": group["mosaic"].iloc[0], "node": nodes, "comp": nodes[root]})

    return edges.groupBy("mosaic").applyInPandas(run, "mosaic int, node long, comp long")
