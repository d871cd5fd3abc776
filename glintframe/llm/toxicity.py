"""Toxicity scores by a bidirectional gated recurrent network with attention pooling.

A text's words go through the network in overlapping windows of `WINDOW` words, `STRIDE` apart, every
window of the whole text. A word's input joins a word vector (hashed table) and a character vector: the
largest and the mean over its character n-grams (3 to 5, with word borders) of a hashed n-gram table.
Two gated recurrent passes, one from each side, read a window; attention pools their states, a
logistic unit scores the pool, and a document's score is that of its most toxic window.

Training is numpy's, from random tables and weights: only documents carry labels. Every epoch scores all
windows of the sampled documents; each document then trains on its most toxic windows and as many drawn
by chance, through a soft maximum over their logits that sharpens epoch by epoch, and back through
attention, both recurrences and down to both tables (Adam on the touched rows). Table rows that only a
few documents of the sample touch stay zero, so no single document is learnt by heart.

Scale: the fit reads a bounded sample of labelled documents; scoring is one pass without a shuffle.
A word's inputs to both recurrences are computed once and kept in a bounded table, so the recurrences
add only their own products. Windows of many documents run side by side.

Edge cases: null texts and texts without words have one empty window and get its score; a document's
own id, language, source and label never enter its score; without labels of both kinds the score is
the share of label 1 in the sample (0 without any). Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold_of, in_parts, kept, slices, table
from .shingles import words
from .training import Adam, SparseAdam, frequent, labelled_sample, sigmoid

FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
WINDOW, STRIDE = 48, 32  # words
EACH = (2400, 800)  # labelled documents of label 0 and of label 1 in the fit
LONGEST = 30_000  # characters of a document in the fit; runs of longer ones
WORD_ROWS, GRAM_ROWS = 1 << 16, 1 << 18
DIM = 4  # of each table
HIDDEN = 8
STEPS, BATCH, RATE = 150, 64, 0.01  # full batches at least, within the bounds of epochs
LEAST_EPOCHS, MOST_EPOCHS = 3, 12
TABLE_RATE = 2.0  # the tables' rate over that of the rest
MOST_TOXIC = 3  # windows of a document in a training step: its most toxic ones, and as many others
LEAST_DOCUMENTS = 10  # table rows met in fewer documents of the sample are not trained (fewer in small samples)
REMEMBERED = 120_000  # words whose inputs a worker keeps

_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)


def gram_rows(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of all n-grams of all words (none empty), and where each word's begin (it has one at least)."""
    marked = [b"^" + w + b"$" for w in found]
    size = np.array([len(w) for w in marked], dtype=np.int64)
    data = np.frombuffer(b"".join(marked), dtype=np.uint8).astype(np.uint64)
    begin = np.cumsum(size) - size
    rows, owners = [], []
    owner = np.repeat(np.arange(len(found)), size)
    room = size[owner] - (np.arange(len(data)) - begin[owner])  # characters from here to the word's end
    h = data * _P + np.uint64(1)
    for n in range(2, min(6, len(data) + 1)):
        h[:len(data) - n + 1] = (h[:len(data) - n + 1] ^ (h[:len(data) - n + 1] >> np.uint64(27))) * _Q + data[n - 1:] * _P
        if n >= 3:
            at = np.flatnonzero(room >= n)
            rows.append((h[at] >> np.uint64(46)).astype(np.int64) % GRAM_ROWS)
            owners.append(owner[at])
    rows, owners = np.concatenate(rows), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return rows[order], np.searchsorted(owners[order], np.arange(len(found)))


def word_rows(found: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh32_intdigest
    return np.array([digest(w) for w in found], dtype=np.int64) % WORD_ROWS


def window_starts(n: int) -> list[int]:
    """Starts of the windows over n words; the last one reaches the last word."""
    return list(range(0, max(1, n - WINDOW + STRIDE), STRIDE))


class Vocabulary:
    """Words met so far and their table rows."""

    def __init__(self):
        self.index: dict[bytes, int] = {}
        self.words: list[bytes] = []

    def add(self, found: list[bytes]) -> list[int]:
        index = self.index
        for w in found:
            if w not in index:
                index[w] = len(self.words)
                self.words.append(w)
        return [index[w] for w in found]


#: The words a worker remembers, of the model used last: model, rows, inputs.
_met: dict = {}


class Model:
    def __init__(self, constant: float | None = None):
        self.constant = constant
        self.p: dict[str, np.ndarray] = {}

    # -- inputs ----------------------------------------------------------------------------------

    def vectors(self, found: list[bytes]) -> dict[str, np.ndarray]:
        """Word inputs x (words x 3 DIM) and what their gradient needs."""
        grams, begin = gram_rows(found)
        rows = word_rows(found)
        g = self.p["G"][grams]
        top = np.maximum.reduceat(g, begin, axis=0)
        n = np.diff(np.append(begin, len(grams)))
        mean = np.add.reduceat(g, begin, axis=0) / n[:, None]
        return {"x": np.concatenate([self.p["E"][rows], top, mean], axis=1), "rows": rows, "grams": grams, "begin": begin, "n": n, "g": g, "top": top}

    def projected(self, x: np.ndarray) -> np.ndarray:
        """Inputs of both recurrences' three gates: words x 6 HIDDEN."""
        return np.concatenate([x @ self.p["Wf"] + self.p["bf"], x @ self.p["Wb"] + self.p["bb"]], axis=1)

    # -- recurrences -----------------------------------------------------------------------------

    def recur(self, a: np.ndarray, mask: np.ndarray, U: np.ndarray, keep: bool = False):
        """States (steps x lanes x HIDDEN) from gate inputs a (steps x lanes x 3 HIDDEN); masked steps hold."""
        steps, lanes, k = a.shape[0], a.shape[1], HIDDEN
        h = np.zeros((lanes, k), dtype=a.dtype)
        out = np.empty((steps, lanes, k), dtype=a.dtype)
        tape = []
        Uzr, Uc = U[:, :2 * k], U[:, 2 * k:]
        for t in range(steps):
            zr = sigmoid(a[t, :, :2 * k] + h @ Uzr)
            z, r = zr[:, :k], zr[:, k:]
            c = np.tanh(a[t, :, 2 * k:] + (r * h) @ Uc)
            zm = z * mask[t][:, None]
            if keep:
                tape.append((h, z, r, c))
            h = h + zm * (c - h)
            out[t] = h
        return (out, tape) if keep else out

    def unroll(self, d: np.ndarray, tape: list, mask: np.ndarray, U: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of gate inputs and U from those of the states."""
        k = HIDDEN
        da, dU, dh = np.zeros((*d.shape[:2], 3 * k)), np.zeros_like(U), np.zeros(d.shape[1:])
        Uzr, Uc = U[:, :2 * k], U[:, 2 * k:]
        for t in range(len(tape) - 1, -1, -1):
            h, z, r, c = tape[t]
            m = mask[t][:, None]
            dh = dh + d[t]
            dc = dh * z * m * (1 - c * c)
            dz = dh * (c - h) * m * z * (1 - z)
            drh = dc @ Uc.T
            dr = drh * h * r * (1 - r)
            dzr = np.concatenate([dz, dr], axis=1)
            da[t] = np.concatenate([dzr, dc], axis=1)
            dU[:, :2 * k] += h.T @ dzr
            dU[:, 2 * k:] += (r * h).T @ dc
            dh = dh * (1 - z * m) + drh * r + dzr @ Uzr.T
        return da, dU

    def pool(self, both: np.ndarray, mask: np.ndarray) -> dict[str, np.ndarray]:
        """Attention over the steps of each window, and the window's logit."""
        u = np.tanh(both @ self.p["A"] + self.p["a"])
        e = u @ self.p["w"]
        e = np.where(mask, e, -30.0).astype(both.dtype)
        e = np.exp(e - e.max(axis=0))
        att = e / e.sum(axis=0)
        z = (att[:, :, None] * both).sum(axis=0)
        return {"u": u, "att": att, "z": z, "logit": z @ self.p["c"] + self.p["d"][0]}

    def windows(self, a: np.ndarray, ids: np.ndarray, mask: np.ndarray, keep: bool = False) -> dict[str, np.ndarray]:
        """Logits of windows; a: gate inputs of words, ids: steps x lanes, mask: whether a word is there."""
        k = 3 * HIDDEN
        forward = self.recur(a[:, :k][ids], mask, self.p["Uf"], keep)
        backward = self.recur(a[:, k:][ids[::-1]], mask[::-1], self.p["Ub"], keep)
        if keep:
            (forward, ft), (backward, bt) = forward, backward
        both = np.concatenate([forward, backward[::-1]], axis=2)
        out = self.pool(both, mask)
        return out | {"both": both, "ft": ft, "bt": bt} if keep else out

    # -- scoring ---------------------------------------------------------------------------------

    def known(self, every: set[bytes]) -> tuple[dict[bytes, int], np.ndarray]:
        """Row numbers of all of `every`, and the rows: inputs to both recurrences; row 0 is no word."""
        if _met.get("model") is not self or len(_met["rows"]) > REMEMBERED:
            _met.update(model=self, rows={}, inputs=np.zeros((4096, 6 * HIDDEN), dtype=np.float32))
        rows = _met["rows"]
        new = [w for w in every if w not in rows]
        if new:
            at, room = 1 + len(rows), len(_met["inputs"])
            if at + len(new) > room:  # room grows by a quarter at least, so words are seldom copied
                more = np.zeros((max(room // 4, at + len(new) - room), 6 * HIDDEN), dtype=np.float32)
                _met["inputs"] = np.concatenate([_met["inputs"], more])
            rows.update(zip(new, range(at, at + len(new))))
            for part in in_slices(new, 4000):
                _met["inputs"][at:at + len(part)] = self.projected(self.vectors(part)["x"])
                at += len(part)
        return rows, _met["inputs"]

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        split = [words(t) for t in texts]
        known, inputs = self.known(set().union(*split))
        ids = np.fromiter((known[w] for x in split for w in x), dtype=np.int64, count=sum(map(len, split)))
        starts, sizes, owner, at = [], [], [], 0
        for i, x in enumerate(split):
            s = np.asarray(window_starts(len(x)))
            starts.append(s + at)
            sizes.append(np.minimum(WINDOW, len(x) - s))
            owner.append(np.full(len(s), i))
            at += len(x)
        starts, sizes, owner = map(np.concatenate, (starts, sizes, owner))
        logits = np.empty(len(starts))
        ids = np.append(ids, np.zeros(WINDOW, dtype=np.int64))
        order = np.argsort(-sizes, kind="stable")
        for lo in range(0, len(order), 1024):
            part = order[lo:lo + 1024]
            steps = max(1, int(sizes[part].max()))
            step = np.arange(steps)[:, None]
            mask = step < sizes[part]
            own = np.where(mask, ids[starts[part] + step], 0)
            logits[part] = self.windows(inputs, own, mask)["logit"]
        best = np.maximum.reduceat(logits, np.searchsorted(owner, np.arange(len(texts))))
        return sigmoid(best)


def in_slices(items: list, n: int = 10_000) -> Iterator[list]:
    return (items[i:i + n] for i in range(0, len(items), n))


def all_grams(every: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """gram_rows of many words, a slice at a time."""
    rows, begins, at = [], [], 0
    for part in in_slices(every):
        r, b = gram_rows(part)
        rows.append(r.astype(np.int32))
        begins.append(b + at)
        at += len(r)
    return np.concatenate(rows), np.concatenate(begins)


def fit(texts: list[str], y: np.ndarray, seed: int = 3) -> Model:
    if not len(y) or y.min() == y.max():
        return Model(float(y.mean()) if len(y) else 0.0)
    rng = np.random.default_rng(seed)
    model, vocabulary = Model(), Vocabulary()
    docs = [np.array(vocabulary.add(words(t)), dtype=np.int32) for t in texts]
    every = vocabulary.words
    if not every:
        return Model(float(y.mean()))
    rows = word_rows(every)
    grams, begin = all_grams(every)
    ends = np.append(begin[1:], len(grams))
    k, p = HIDDEN, model.p
    none = [np.zeros(0, dtype=np.int32)]
    least = min(LEAST_DOCUMENTS, max(2, len(docs) // 100))
    live = {"E": frequent((rows[d] for d in docs), WORD_ROWS, least),
            "G": frequent((np.concatenate([grams[begin[w]:ends[w]] for w in np.unique(d)] or none) for d in docs), GRAM_ROWS, least)}
    del grams, begin, ends
    for name in "EG":  # rows that are not frequent stay zero
        p[name] = np.zeros((len(live[name]), DIM), dtype=np.float32)
        p[name][live[name]] = rng.normal(0, 0.1, (int(live[name].sum()), DIM))
    for side in "fb":
        p[f"W{side}"] = rng.normal(0, 0.4, (3 * DIM, 3 * k))
        p[f"b{side}"] = np.zeros(3 * k)
        p[f"U{side}"] = rng.normal(0, 0.3, (k, 3 * k))
    p |= {"A": rng.normal(0, 0.3, (2 * k, k)), "a": np.zeros(k), "w": rng.normal(0, 0.5, k), "c": rng.normal(0, 0.3, 2 * k), "d": np.zeros(1)}
    adam = Adam({name: v for name, v in p.items() if name not in "EG"}, RATE)
    tables = {name: SparseAdam(p[name], live[name]) for name in "EG"}
    # All windows of all sampled documents.
    owner = np.concatenate([np.full(len(window_starts(len(d))), i) for i, d in enumerate(docs)])
    ids = np.full((WINDOW, len(owner)), -1, dtype=np.int32)
    for j, (i, start) in enumerate((i, start) for i, d in enumerate(docs) for start in window_starts(len(d))):
        own = docs[i][start:start + WINDOW]
        ids[:len(own), j] = own
    mask = ids >= 0
    ids = np.maximum(ids, 0)
    of_doc = np.searchsorted(owner, np.arange(len(docs) + 1))
    batch = min(BATCH, max(8, len(docs) // 24))
    epochs = min(MOST_EPOCHS, max(LEAST_EPOCHS, -(-STEPS * BATCH // len(docs))))
    logits = np.zeros(len(owner))
    for epoch in range(epochs):
        adam.rate = RATE * (1 - epoch / epochs) + 0.001
        if epoch:
            fast = Model()
            fast.p = {name: v.astype(np.float32) for name, v in p.items() if name not in "EG"}
            a = np.concatenate([model.projected(model.vectors(part)["x"]).astype(np.float32) for part in in_slices(every)])
            logits = np.concatenate([fast.windows(a, ids[:, lo:lo + 1024], mask[:, lo:lo + 1024])["logit"] for lo in range(0, len(owner), 1024)])
            del a
        # Of each document the most toxic windows so far, and as many others by chance.
        chosen = []
        for lo, hi in zip(of_doc, of_doc[1:]):
            own = rng.permutation(np.arange(lo, hi))
            chosen.append(own[np.argsort(-logits[own], kind="stable")][:MOST_TOXIC] if epoch else own[:0])
            rest = own[~np.isin(own, chosen[-1])]
            chosen[-1] = np.concatenate([chosen[-1], rest[:2 * MOST_TOXIC - len(chosen[-1])]])
        order = rng.permutation(len(docs))
        sharpness = 0.5 + 2.5 * epoch / epochs
        for at in range(0, len(order), batch):
            part = order[at:at + batch]
            own = np.concatenate([chosen[i] for i in part])
            of = np.repeat(np.arange(len(part)), [len(chosen[i]) for i in part])
            train_step(model, adam, tables, every, ids[:, own], mask[:, own], of, y[part].astype(np.float64), sharpness)
    for name in p:
        p[name] = p[name].astype(np.float32)
    return model


def train_step(model: Model, adam: Adam, tables: dict[str, SparseAdam], every: list[bytes], ids: np.ndarray, mask: np.ndarray, of: np.ndarray, y: np.ndarray, sharpness: float) -> None:
    """One step on the documents 0 .. len(y) - 1; window j belongs to document of[j] (ascending, one at least)."""
    met, local = np.unique(ids, return_inverse=True)
    found = [every[w] for w in met]
    grads, dx, v = gradients(model, found, local.reshape(ids.shape), mask, of, y, sharpness)
    adam.step({name: np.clip(g, -1, 1) for name, g in grads.items()})
    # Tables: each word's row, the n-grams that gave the largest value, and all for the mean.
    tables["E"].step(v["rows"], dx[:, :DIM], TABLE_RATE * adam.rate)
    word = np.repeat(np.arange(len(met)), v["n"])
    dg = (v["g"] == v["top"][word]) * dx[word, DIM:2 * DIM] + dx[word, 2 * DIM:] / v["n"][word][:, None]
    tables["G"].step(v["grams"], dg, TABLE_RATE * adam.rate)


def gradients(model: Model, found: list[bytes], local: np.ndarray, mask: np.ndarray, of: np.ndarray, y: np.ndarray, sharpness: float) -> tuple[dict, np.ndarray, dict]:
    """Of the mean cross-entropy: dense parameters', the word inputs', and what model.vectors(found) gave.

    A document's logit is the soft maximum log(mean(exp(sharpness * logit of each window))) / sharpness.
    """
    p, k = model.p, HIDDEN
    v = model.vectors(found)
    f = model.windows(model.projected(v["x"]), local, mask, keep=True)
    begins = np.searchsorted(of, np.arange(len(y)))
    n = np.diff(np.append(begins, len(of)))
    scaled = sharpness * f["logit"]
    e = np.exp(scaled - np.maximum.reduceat(scaled, begins)[of])
    sums = np.add.reduceat(e, begins)
    logit = (np.log(sums / n) + np.maximum.reduceat(scaled, begins)) / sharpness
    ds = ((sigmoid(logit) - y) / len(y))[of] * e / sums[of]
    grads = {"c": f["z"].T @ ds, "d": np.array([ds.sum()])}
    dz = np.outer(ds, p["c"])
    datt = (f["both"] * dz[None]).sum(axis=2)
    de = f["att"] * (datt - (f["att"] * datt).sum(axis=0)) * mask
    grads["w"] = np.einsum("tl,tlk->k", de, f["u"])
    du = de[:, :, None] * p["w"] * (1 - f["u"] ** 2)
    grads["A"], grads["a"] = np.einsum("tlj,tlk->jk", f["both"], du), du.sum(axis=(0, 1))
    d = f["att"][:, :, None] * dz[None] + du @ p["A"].T
    da_f, grads["Uf"] = model.unroll(d[:, :, :k], f["ft"], mask, p["Uf"])
    da_b, grads["Ub"] = model.unroll(d[::-1, :, k:], f["bt"], mask[::-1], p["Ub"])
    dx = np.zeros(v["x"].shape)
    for side, da, where in (("f", da_f, local), ("b", da_b, local[::-1])):
        place = where.ravel()
        total = np.stack([np.bincount(place, weights=g, minlength=len(found)) for g in da.reshape(-1, 3 * k).T], axis=1)
        grads[f"W{side}"], grads[f"b{side}"] = v["x"].T @ total, total.sum(axis=0)
        dx += total @ p[f"W{side}"].T
    return grads, dx, v


SCHEMA = "doc_id long, score double"


def _score(model):
    """model: a broadcast Model; a worker keeps its copy."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            parts = in_parts(batch.column(1).to_pylist())
            scores = [model.value.scores([t or "" for t in part]) for part in parts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([np.zeros(0), *scores]), pa.float64())], names=["doc_id", "score"])
    return run


def trained(docs: DataFrame, labels: DataFrame, each: tuple[int, int] = EACH) -> Model:
    """The model, fitted on the folds that are not held out."""
    sample = labelled_sample(docs, labels, "toxic", FOLDS, HELD_OUT, each, LONGEST)
    return fit(sample["text"].tolist(), sample["y"].to_numpy())


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of `docs`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the tables' size is fixed: 6 MB
    out = docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(_score(shared), SCHEMA)
    held = F.coalesce(fold_of(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op1_toxicity_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, trained(docs, table(spark, sf_dir, "labels")))


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents scored below THRESHOLD, all columns as they are."""
    model = spark.sparkContext.broadcast(trained(docs, table(spark, sf_dir, "labels")))
    return kept(docs, model, lambda scores: scores < THRESHOLD)
