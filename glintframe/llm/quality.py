"""Quality scores by attention-based multiple-instance learning.

A document is a bag of passages of `PASSAGE` words; every passage of the whole text is encoded. A
passage's inputs are the mean of its words' vectors (a hashed table, learnt), and shares of character
classes and of word shapes (case, marks, repeats, lengths); a dense layer turns them into its
representation h. Gated attention, softmax over the document of
w . (tanh(V h) * sigmoid(U h)), weighs the passages, and the weighted representation is scored. Only
documents carry labels; word table, encoder, attention and score are trained together in numpy with Adam.
Table rows that only a few documents of the sample touch stay zero, so no document is learnt by heart.

Scale: the fit reads a bounded sample of labelled documents (`EACH`); scoring is one pass
with the model, 1 MB whatever the input, broadcast, without a shuffle.

Edge cases: null and empty texts are one passage without words and get a score like any; a document's
own id, language, source and label never enter its score; without labels of both kinds the score is
the share of label 1 in the sample (0.5 without any). Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold_of, in_parts, kept, slices, table
from .training import Adam, SparseAdam, frequent, labelled_sample, sigmoid

FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
PASSAGE = 64  # words
EACH = (2500, 2500)  # labelled documents of label 0 and of label 1 in the fit
LONGEST = 50_000  # characters of a document in the fit; runs of longer ones
HIDDEN, GATE = 24, 12
ROWS, DIM = 1 << 15, 8  # of the word table
LEAST_DOCUMENTS = 10  # table rows met in fewer documents of the sample are not trained (fewer in small samples)
EPOCHS, BATCH, RATE = 20, 64, 0.01

#: Character classes: 33 ASCII marks of their own, digits, small and capital letters, beyond ASCII, space, control.
_CLASS = np.zeros(128, dtype=np.int64)
_MARKS = [c for c in range(33, 127) if not chr(c).isalnum()]
for _i, _c in enumerate(_MARKS):
    _CLASS[_c] = _i
_DIGIT, _LOWER, _UPPER, _WIDE, _SPACE, _CONTROL = range(len(_MARKS), len(_MARKS) + 6)
for _c in range(128):
    if chr(_c).isalnum():
        _CLASS[_c] = _DIGIT if chr(_c).isdigit() else _LOWER if chr(_c).islower() else _UPPER
    elif _c in (9, 10, 11, 12, 13, 32):
        _CLASS[_c] = _SPACE
    elif _c < 32 or _c == 127:
        _CLASS[_c] = _CONTROL
CLASSES = _CONTROL + 1
INPUTS = CLASSES + 6

#: Odd multipliers that tell words apart by their characters and places.
_POWERS = np.cumprod(np.full(1 << 16, 0x9E3779B97F4A7C15 | 1, dtype=np.uint64))


class Passages(NamedTuple):
    """All passages of some texts, in order: shares (rows x INPUTS), the text each belongs to, the table row and the passage of every word."""

    x: np.ndarray
    owner: np.ndarray
    rows: np.ndarray
    bag: np.ndarray


def passages(texts: list[str]) -> Passages:
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    codes = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    kind = np.where(codes < 128, _CLASS[np.minimum(codes, 127)], _WIDE)
    text_of_char = np.repeat(np.arange(len(texts)), sizes)
    space = kind == _SPACE
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    word_text = text_of_char[starts]
    per_text = np.bincount(word_text, minlength=len(texts))
    bags = np.maximum(1, -(-per_text // PASSAGE))  # passages of each text
    first_bag = np.cumsum(bags) - bags
    nth = np.arange(len(starts)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    bag_of_word = first_bag[word_text] + nth // PASSAGE
    total = int(bags.sum())
    out = np.zeros((total, INPUTS), dtype=np.float64)
    owner = np.repeat(np.arange(len(texts)), bags)
    if not len(starts):
        return Passages(out, owner, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
    # Characters of words, by the passage of their word.
    word_of_char = np.cumsum(~space & np.concatenate([[True], space[:-1]])) - 1
    solid = ~space
    word_of_solid = word_of_char[solid]
    bag_of_char = bag_of_word[word_of_solid]
    counts = np.bincount(bag_of_char * CLASSES + kind[solid], minlength=total * CLASSES).reshape(total, CLASSES)
    chars = np.maximum(counts.sum(axis=1, keepdims=True), 1)
    out[:, :CLASSES] = counts / chars
    # Words: length, capitals only, no letters, equal to the word before or the one before that, distinct hash buckets.
    length = np.bincount(word_of_solid, minlength=len(starts))
    capital = np.bincount(word_of_solid, weights=kind[solid] == _UPPER, minlength=len(starts))
    letters = np.bincount(word_of_solid, weights=np.isin(kind[solid], (_LOWER, _UPPER, _WIDE)), minlength=len(starts))
    inside = np.flatnonzero(solid) - starts[word_of_solid]
    mixed = (codes[solid].astype(np.uint64) + np.uint64(7)) * _POWERS[inside & 0xFFFF]
    mixed ^= mixed >> np.uint64(29)
    digest = np.add.reduceat(mixed, np.flatnonzero(np.concatenate([[True], word_of_solid[1:] != word_of_solid[:-1]])))
    again = np.zeros(len(starts))
    again[1:] = (digest[1:] == digest[:-1]) & (word_text[1:] == word_text[:-1])
    second = np.zeros(len(starts))
    second[2:] = (digest[2:] == digest[:-2]) & (word_text[2:] == word_text[:-2])
    held = np.bincount(bag_of_word, minlength=total)
    n = np.maximum(held, 1)
    for k, x in enumerate((np.minimum(length, 40) / 10, (capital > 1) & (capital >= letters), letters == 0, again, second)):
        out[:, CLASSES + k] = np.bincount(bag_of_word, weights=x, minlength=total) / n
    out[:, CLASSES + 5] = held / PASSAGE
    return Passages(out, owner, ((digest * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(40)).astype(np.int64) % ROWS, bag_of_word)


def word_means(E: np.ndarray, rows: np.ndarray, bag: np.ndarray, n: int) -> np.ndarray:
    """The mean word vector of each of n passages, zero without words; bag ascends."""
    out = np.zeros((n, E.shape[1]))
    if len(rows):
        held = np.flatnonzero(np.concatenate([[True], bag[1:] != bag[:-1]]))
        out[bag[held]] = np.add.reduceat(E[rows], held, axis=0) / np.diff(np.append(held, len(bag)))[:, None]
    return out


class Model:
    """Encoder, gated attention and score; trained or constant."""

    def __init__(self, constant: float | None = None):
        self.constant = constant
        self.p: dict[str, np.ndarray] = {}

    def encode(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale

    def forward(self, x: np.ndarray, owner: np.ndarray, n: int) -> dict[str, np.ndarray]:
        """x: encoded inputs of passages in order of their owner; every owner 0..n-1 has one at least."""
        p = self.p
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"] + p["v"]), sigmoid(h @ p["U"] + p["u"])
        e = (t * g) @ p["w"]
        begins = np.searchsorted(owner, np.arange(n))
        e = np.exp(e - np.maximum.reduceat(e, begins)[owner])
        a = e / np.add.reduceat(e, begins)[owner]
        z = np.add.reduceat(a[:, None] * h, begins, axis=0)
        return {"h": h, "t": t, "g": g, "a": a, "z": z, "s": sigmoid(z @ p["c"] + p["d"])}

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        f = passages(texts)
        x = np.concatenate([self.encode(f.x), word_means(self.p["E"], f.rows, f.bag, len(f.owner))], axis=1)
        return self.forward(x, f.owner, len(texts))["s"]


def gradients(model: Model, x: np.ndarray, owner: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Of the weighted cross-entropy, for one batch; "x" is that of the inputs."""
    p, f = model.p, model.forward(x, owner, len(y))
    ds = (f["s"] - y) * weight / weight.sum()
    out = {"c": f["z"].T @ ds, "d": np.array([ds.sum()])}
    dz = np.outer(ds, p["c"])
    da = (dz[owner] * f["h"]).sum(axis=1)
    begins = np.searchsorted(owner, np.arange(len(y)))
    de = f["a"] * (da - np.add.reduceat(f["a"] * da, begins)[owner])
    out["w"] = (f["t"] * f["g"]).T @ de
    dtg = np.outer(de, p["w"])
    dt, dg = dtg * f["g"] * (1 - f["t"] ** 2), dtg * f["t"] * f["g"] * (1 - f["g"])
    out |= {"V": f["h"].T @ dt, "v": dt.sum(axis=0), "U": f["h"].T @ dg, "u": dg.sum(axis=0)}
    dh = f["a"][:, None] * dz[owner] + dt @ p["V"].T + dg @ p["U"].T
    dpre = dh * (1 - f["h"] ** 2)
    return out | {"W": x.T @ dpre, "b": dpre.sum(axis=0), "x": dpre @ p["W"].T}


def fit(texts: list[str], y: np.ndarray, share: float | None = None, seed: int = 1) -> Model:
    """share: of label 1 among all labelled documents, to which the sample's balance is brought back."""
    if not len(y) or y.min() == y.max():
        return Model(float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(seed)
    model = Model()
    parts = [passages(texts[i:i + 200]) for i in range(0, len(texts), 200)]
    at = np.cumsum([0, *(len(f.owner) for f in parts)])
    x = np.concatenate([f.x for f in parts])
    owner = np.concatenate([f.owner + 200 * i for i, f in enumerate(parts)])
    rows = np.concatenate([f.rows for f in parts])
    bag = np.concatenate([f.bag + at[i] for i, f in enumerate(parts)])
    model.mean, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    x = model.encode(x)
    width = INPUTS + DIM
    model.p = {"W": rng.normal(0, width**-0.5, (width, HIDDEN)), "b": np.zeros(HIDDEN), "V": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "v": np.zeros(GATE), "U": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "u": np.zeros(GATE), "w": rng.normal(0, GATE**-0.5, GATE), "c": rng.normal(0, HIDDEN**-0.5, HIDDEN), "d": np.zeros(1)}
    begins = np.searchsorted(owner, np.arange(len(y) + 1))
    words = np.searchsorted(bag, np.arange(len(owner) + 1))  # first word of each passage
    live = frequent((rows[words[a]:words[b]] for a, b in zip(begins, begins[1:])), ROWS, min(LEAST_DOCUMENTS, max(2, len(y) // 100)))
    table = np.zeros((ROWS, DIM), dtype=np.float32)
    table[live] = rng.normal(0, 0.1, (int(live.sum()), DIM))
    steps = SparseAdam(table, live)
    share = float(y.mean()) if share is None else share
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    adam = Adam(model.p, RATE)
    for epoch in range(EPOCHS):
        adam.rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(len(y))
        for at in range(0, len(order), BATCH):
            part = np.sort(order[at:at + BATCH])
            those = np.concatenate([np.arange(begins[i], begins[i + 1]) for i in part])
            own = np.repeat(np.arange(len(part)), begins[part + 1] - begins[part])
            n = words[those + 1] - words[those]
            near = np.repeat(np.arange(len(those)), n)  # the passage, of this batch, of each word
            place = rows[np.repeat(words[those] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            inputs = np.concatenate([x[those], word_means(table, place, near, len(those))], axis=1)
            grads = gradients(model, inputs, own, y[part].astype(np.float64), weight[part])
            dx = grads.pop("x")[:, INPUTS:] / np.maximum(n, 1)[:, None]
            adam.step({k: g + (1e-4 * model.p[k] if k in "WVUwc" else 0) for k, g in grads.items()})
            if len(place):
                steps.step(place, dx[near], adam.rate)
    model.p["E"] = table
    return model


SCHEMA = "doc_id long, score double"


def _score(model):
    """model: a broadcast Model."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            parts = in_parts(batch.column(1).to_pylist())
            scores = [model.value.scores([t or "" for t in part]) for part in parts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([np.zeros(0), *scores]), pa.float64())], names=["doc_id", "score"])
    return run


def trained(docs: DataFrame, labels: DataFrame, each: tuple[int, int] = EACH) -> Model:
    """The model, fitted on the folds that are not held out."""
    sample = labelled_sample(docs, labels, "quality", FOLDS, HELD_OUT, each, LONGEST)
    known = labels.where(F.col("quality").isin(0, 1) & (fold_of(F.col("doc_id"), FOLDS) != HELD_OUT))
    share = known.agg(F.avg("quality")).first()[0]
    return fit(sample["text"].tolist(), sample["y"].to_numpy(), share)


def score_quality(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of `docs`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(_score(shared), SCHEMA)
    held = F.coalesce(fold_of(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op5_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, trained(docs, table(spark, sf_dir, "labels")))


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents predicted to be of quality, all columns as they are."""
    model = spark.sparkContext.broadcast(trained(docs, table(spark, sf_dir, "labels")))
    return kept(docs, model, lambda scores: scores >= THRESHOLD)
