"""Coarse centres of a bounded sample of vectors."""

from __future__ import annotations

import numpy as np


def kmeans(x: np.ndarray, lists: int, seed: int = 5, rounds: int = 12) -> np.ndarray:
    """Lloyd's centres from distinct random rows; an emptied centre stays where it was."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    centres = distinct[rng.permutation(len(distinct))[:lists]]
    for _ in range(rounds):
        near = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(axis=1)[None, :] - 2 * x @ centres.T, axis=1)
