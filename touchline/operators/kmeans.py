"""k-means inside a task: many seeded starts at once, the best of them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def _seeds(x: np.ndarray, k: int, starts: int, rng: np.random.Generator) -> np.ndarray:
    """starts x k rows of x: the first at random, each next one with a chance that grows with its squared distance to those before."""
    chosen = rng.integers(len(x), size=(starts, 1))
    far = ((x[None] - x[chosen[:, 0], None]) ** 2).sum(2)
    for _ in range(1, k):
        total = far.sum(1, keepdims=True)
        chance = np.where(total > 0, far / np.where(total > 0, total, 1), 1 / len(x))
        new = np.minimum((chance.cumsum(1) < rng.random((starts, 1))).sum(1), len(x) - 1)
        chosen = np.column_stack([chosen, new])
        far = np.minimum(far, ((x[None] - x[new, None]) ** 2).sum(2))
    return x[chosen]


def kmeans(x: np.ndarray, k: int, starts: int = 30, seed: int = 42, rounds: int = 300) -> tuple[np.ndarray, np.ndarray, float]:
    """(labels, centres, inertia) of the start that ends with the least inertia.

    All starts move together. Groups are numbered by their centres, smallest first,
    so that equal input gives equal numbers. A group that loses its rows keeps its
    centre; with fewer than k rows, every row has its own.
    """
    k = min(k, len(x))
    centres = _seeds(x, k, starts, np.random.default_rng(seed))
    labels = None
    for _ in range(rounds):
        new = ((x[None, :, None] - centres[:, None]) ** 2).sum(3).argmin(2)
        if labels is not None and (new == labels).all():
            break
        labels = new
        member = labels[:, :, None] == np.arange(k)
        size = member.sum(1)[:, :, None]
        centres = np.where(size > 0, np.einsum("snk,nd->skd", member, x) / np.maximum(size, 1), centres)
    inertia = ((x[None] - np.take_along_axis(centres, labels[:, :, None], 1)) ** 2).sum((1, 2))
    best = inertia.argmin()
    order = np.lexsort(centres[best].T[::-1])
    return np.argsort(order)[labels[best]], centres[best][order], float(inertia[best])


def robust_scaler(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(middle, scale) of each column: median and 1.4826 times the median deviation, where that is nothing the standard deviation, else 1."""
    middle = np.median(x, axis=0)
    scale = 1.4826 * np.median(np.abs(x - middle), axis=0)
    scale = np.where(scale < 1e-6, x.std(0), scale)
    return middle, np.where(scale < 1e-6, 1.0, scale)


def groups_of_clips(rows: DataFrame, key: str, columns: list[str], k: int, name: str, weights: list[float] | None = None) -> DataFrame:
    """rows with the column `name`: the group (from 0) of each row among its clip's rows, by robustly scaled columns; -1 where one is null. A clip's rows meet in one task."""
    w = np.array(weights or [1.0] * len(columns))

    def grouped(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key, ignore_index=True)
        x = pdf[columns].to_numpy(np.float64)
        there = ~np.isnan(x).any(1)
        label = np.full(len(pdf), -1)
        if there.any():
            middle, scale = robust_scaler(x[there])
            label[there] = kmeans((x[there] - middle) / scale * w, k)[0]
        return pdf[["clip_id", key]].assign(**{name: label})

    shape = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("clip_id", key))
    found = rows.select("clip_id", key, *columns).groupBy("clip_id").applyInPandas(grouped, f"{shape}, {name} int")
    return rows.join(found, ["clip_id", key])
