"""Bounded, reproducible samples of labelled documents, and a small optimiser."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of


RUNS = 8  # of a long text in a sample


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, each: tuple[int, int], longest: int) -> pd.DataFrame:
    """doc_id, text, y: at most `each`[y] documents of label y, none from the held-out fold.

    The ones with the least hash of their id are taken; labels that repeat an id count as their largest
    value. Of a text of more than `longest` characters `RUNS` runs, evenly spaced from its first to its last
    character, stand for it, `longest` characters together: that bounds the driver's memory (sum of
    `each` x longest characters) and concerns the fit alone.
    """
    own = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (fold_of(F.col("doc_id"), folds) != held_out))
    own = own.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    key = F.xxhash64(F.lit(3), "doc_id")
    picked = None
    for y in (0, 1):
        part = own.where(F.col("y") == y).orderBy(key, "doc_id").limit(each[y])
        picked = part if picked is None else picked.unionByName(part)
    run = longest // RUNS
    spread = F.concat_ws(" ", *(F.col("text").substr(F.floor((F.length("text") - run) * k / (RUNS - 1)).cast("int") + 1, F.lit(run)) for k in range(RUNS)))
    texts = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.length("text") <= longest, F.col("text")).otherwise(spread).alias("text"))
    found = texts.join(F.broadcast(picked.withColumn("doc_id", F.col("doc_id").cast("long"))), "doc_id")  # at most sum of each rows
    found = found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
    return found.toPandas().sort_values("doc_id").reset_index(drop=True)


class Adam:
    """Adam over a dict of arrays, in place."""

    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            m, v = self.m[k], self.v[k]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            self.params[k] -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


class SparseAdam:
    """Adam on the rows of a table that a step touches; rows that are not `live` stay as they are."""

    def __init__(self, table: np.ndarray, live: np.ndarray):
        self.table, self.live = table, live
        self.m, self.v, self.t = np.zeros_like(table), np.zeros_like(table), np.zeros(len(table), dtype=np.int32)

    def step(self, rows: np.ndarray, grads: np.ndarray, rate: float) -> None:
        met, place = np.unique(rows, return_inverse=True)
        sums = np.stack([np.bincount(place, weights=g, minlength=len(met)) for g in grads.T], axis=1).astype(self.table.dtype)
        on = self.live[met]
        met, sums = met[on], sums[on]
        self.t[met] += 1
        t = self.t[met][:, None]
        self.m[met] = m = 0.9 * self.m[met] + 0.1 * sums
        self.v[met] = v = 0.99 * self.v[met] + 0.01 * sums * sums
        self.table[met] -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)


def frequent(rows_by_doc: Iterator[np.ndarray], size: int, least: int) -> np.ndarray:
    """Which table rows occur in `least` documents of the sample or more."""
    seen = np.zeros(size, dtype=np.int32)
    for rows in rows_by_doc:
        seen[np.unique(rows)] += 1
    return seen >= least


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))
