"""Near-duplicates by n-gram Jaccard similarity with Bayesian pruning of candidates.

Texts are sets of five-word shingles; two texts are linked when their Jaccard similarity is 0.8 or
more. Documents with one set form a class and are handled once, as a node.

1. Every node gets `SIZE` MinHash values. Bands of `ROWS` values make buckets; a pair at the threshold
   shares none with probability (1 - 0.8^4)^24 = 3e-6.
2. Within a bucket, values are compared 16 at a time. After m agreements in n values the posterior of
   the similarity under a uniform prior is Beta(m + 1, n - m + 1); a pair is dropped as soon as the
   probability that it reaches the threshold falls below `TOLERANCE`. Of the pairs that stay only a
   forest is emitted, at most one edge per member, whatever the size of the bucket. It leads to the least
   key of a group, which the buckets of a large group mostly have in common, so few edges differ.
3. Connected components of the forest hold every pair that stayed. Within each, pairs are compared in
   the same way, and those that stay are verified exactly, by counting common shingles; links are counted
   there and pairs are never written out.
4. Links give the final groups and, for each document, its group and number of links.

Scale: signatures move once, texts move once, to the verification of those nodes that have a candidate.
Buckets of more than `bucket_block` nodes and components of more than `component_bytes` of text are split
into blocks, and pairs of blocks go to tasks of their own, so a task's memory is bounded. Rows meet the
sizes of their bucket or component over salted keys. Nothing that grows with the corpus reaches the driver.

Edge cases: null texts and texts without words are linked to nothing and are groups of their own; texts
of one to four words have one shingle; repeated rows are copies; null ids are carried along, a group's
id is the least id in it. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, salted_join, slices, table
from .components import components
from .shingles import MinHash, groups, set_key, shingle_set

THRESHOLD = (4, 5)  # 0.8 as a fraction
SIZE = 96
ROWS = 4
STEP = 16
TOLERANCE = 1e-6

WORD = "[0-9A-Za-z]|[^\\x00-\\x7F]"  # what shingles.words finds a word in

SIGNED = "doc_id long, text_hash long, key binary, signature binary, size long"


def least_agreements(threshold: float, tolerance: float, size: int = SIZE, step: int = STEP) -> dict[int, int]:
    """For n compared values, the least m with P(similarity >= threshold | m of n agree) >= tolerance.

    Under the uniform prior that probability is the chance of at most m successes in n + 1 trials.
    """
    out = {}
    for n in range(step, size + 1, step):
        below, m = 0.0, -1
        while below < tolerance:
            m += 1
            below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


def stays(one: np.ndarray, others: np.ndarray, least: dict[int, int]) -> np.ndarray:
    """Which rows of `others` are not pruned against `one`, comparing values incrementally."""
    alive = np.arange(len(others))
    agree = np.zeros(len(others), dtype=np.int64)
    for n, m in least.items():
        block = slice(n - STEP, n)
        agree = agree + (others[alive, block] == one[block]).sum(axis=1)
        keep = agree >= m
        alive, agree = alive[keep], agree[keep]
        if not len(alive):
            break
    out = np.zeros(len(others), dtype=bool)
    out[alive] = True
    return out


def leaders(n: int, near) -> np.ndarray:
    """Components of n items, near(i, others) telling which of `others` touch i: each item's first.

    Only items without a component yet are compared, so a group of near copies costs its size.
    """
    leader = np.arange(n)
    free = np.arange(n)
    while len(free) > 1:
        start, rest, queue = free[0], free[1:], [free[0]]
        while queue and len(rest):
            touched = near(queue.pop(), rest)
            found = rest[touched]
            leader[found] = start
            queue.extend(found.tolist())
            rest = rest[~touched]
        free = rest
    return leader


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    minhash = MinHash(SIZE)
    for batch in slices(batches):
        keys, signatures, sizes = [], [], []
        for t in batch.column(2):
            s = shingle_set(t.as_py())
            sizes.append(len(t.as_py() or ""))
            keys.append(set_key(s) if len(s) else None)
            signatures.append(minhash(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(signatures, pa.binary()), pa.array(sizes, pa.int64())], names=["doc_id", "text_hash", "key", "signature", "size"])


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of the pairs that stay in each (bucket, block, block); columns: those three, own block, key, signature, in order of keys.

    Edges lead to the least key of a group. Of two blocks only those between groups of one and the other are emitted:
    the rest belongs to (block, block).
    """
    least = least_agreements(THRESHOLD[0] / THRESHOLD[1], TOLERANCE)
    a, b = [], []
    for t in groups(batches, 3):
        own, keys = t.column(3).to_numpy(), t.column(4).to_pylist()
        sig = np.frombuffer(b"".join(t.column(5).to_pylist()), dtype="<u4").reshape(len(keys), SIZE)
        every = np.arange(len(keys))
        within = every.copy()
        near = lambda i, rest: stays(sig[i], sig[rest], least)
        if t.column(1)[0] != t.column(2)[0]:
            for at in (np.flatnonzero(own == k) for k in np.unique(own)):
                within[at] = at[leaders(len(at), lambda i, rest, at=at: stays(sig[at[i]], sig[at[rest]], least))]

            def near(i, rest):
                found, other = within[rest] == within[i], own[rest] != own[i]
                found[other] = stays(sig[i], sig[rest[other]], least)
                return found
        first = leaders(len(keys), near)
        for i in np.flatnonzero((first != every) & (within == every)).tolist():
            a.append(keys[first[i]])
            b.append(keys[i])
        if len(a) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])
            a, b = [], []
    if a:
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])


def links(sets: list[np.ndarray], signatures: np.ndarray, least: dict[int, int], block: np.ndarray | None = None) -> np.ndarray:
    """Which pairs of shingle sets are not pruned and have similarity 0.8 or more: a symmetric matrix.

    block: of each set; with it, only pairs of two blocks count. Its diagonal is false.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    begins = np.cumsum(sizes) - sizes
    held = np.zeros(len(values), dtype=bool)
    linked = np.zeros((n, n), dtype=bool)
    up, down = THRESHOLD
    for i in range(n - 1):
        rest = np.arange(i + 1, n)
        if block is not None:
            rest = rest[block[rest] != block[i]]
        rest = rest[stays(signatures[i], signatures[rest], least)] if len(rest) else rest
        if not len(rest):
            continue
        own = place[begins[i]:begins[i] + sizes[i]]
        held[own] = True
        if 4 * len(rest) > n - i:  # many: the sets from here on in one run
            common = np.add.reduceat(held[place[begins[rest[0]]:]], begins[rest[0]:] - begins[rest[0]], dtype=np.int64)[rest - rest[0]]
        else:
            common = np.array([np.count_nonzero(held[place[begins[j]:begins[j] + sizes[j]]]) for j in rest], dtype=np.int64)
        held[own] = False
        # common / (|a| + |b| - common) >= up / down, in whole numbers
        linked[i, rest] = common * (down + up) >= up * (sizes[i] + sizes[rest])
    return linked | linked.T


VERIFIED = "key binary, leader binary, texts long, docs long"


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each (component, block, block); columns: those three, own block, key, n, signature, text."""
    least = least_agreements(THRESHOLD[0] / THRESHOLD[1], TOLERANCE)
    for t in groups(batches, 3):
        rows = {}
        for block, key, n, signature, text in zip(*(t.column(k).to_pylist() for k in (3, 4, 5, 6, 7))):
            rows[key] = (block, n, signature, text)
        keys = sorted(rows)
        block = np.array([rows[k][0] for k in keys])
        n = np.array([rows[k][1] for k in keys], dtype=np.int64)
        low, high = t.column(1)[0].as_py(), t.column(2)[0].as_py()
        signatures = np.frombuffer(b"".join(rows[k][2] for k in keys), dtype="<u4").reshape(len(keys), SIZE)
        # Pairs inside a block belong to (block, block).
        linked = links([shingle_set(rows[k][3]) for k in keys], signatures, least, block if low != high else None)
        first = leaders(len(keys), lambda i, rest: linked[i, rest])
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([keys[i] for i in first], pa.binary()), pa.array(linked.sum(axis=1)), pa.array((linked * n[None, :]).sum(axis=1))], names=["key", "leader", "texts", "docs"])


def _in_blocks(rows: DataFrame, total: str, most: int, by: str) -> DataFrame:
    """`rows` with own (block) and, once for each pair of blocks of its group it belongs to, low and high.

    A group has total / most blocks, rounded up.
    """
    blocks = F.greatest(F.ceil(F.col(total) / most), F.lit(1))
    own = F.pmod(F.xxhash64(by), blocks).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))))
    return rows.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))


def _classes(docs: DataFrame, bucket_block: int, component_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, key) of every row, key null without words; (key, label, least, n_links, n_text_links) of every node."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    signed = checkpointed(rows.mapInArrow(_sign, SIGNED))
    nodes = checkpointed(signed.where("key is not null").groupBy("key").agg(
        F.min(F.struct("doc_id", "text_hash")).alias("first"), F.count("*").alias("n"), F.first("signature").alias("signature"), F.min("doc_id").alias("least"), F.max("size").alias("size")), gathered=True)

    bands = F.array(*(F.xxhash64(F.lit(b), F.substring("signature", 1 + 4 * ROWS * b, 4 * ROWS)) for b in range(SIZE // ROWS)))
    banded = nodes.select("key", F.explode(bands).alias("bucket"))
    full = banded.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    members = salted_join(banded, full, "bucket", "key").join(nodes.select("key", "signature"), "key")
    members = _in_blocks(members, "members", bucket_block, "key").select("bucket", "low", "high", "own", "key", "signature")
    members = members.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high", "key")
    label = components(members.mapInArrow(_forest, "a binary, b binary"))

    todo = label.join(nodes.select(F.col("key").alias("node"), "first", "n", "signature", "size"), "node")
    todo = salted_join(todo, todo.groupBy("label").agg(F.sum("size").alias("total")), "label", "node")
    # A node's text is found by hashes of its first row's id and text; rows that repeat it are merged map-side.
    where = F.xxhash64(F.lit(9), "first.doc_id", "first.text_hash").alias("place")
    todo = todo.select("label", "total", F.col("node").alias("key"), "n", "signature", where, F.col("first.text_hash").alias("text_hash"))
    text = rows.where(F.col("text").isNotNull()).groupBy(F.xxhash64(F.lit(9), "doc_id", "text_hash").alias("place"), "text_hash").agg(F.first("text").alias("text"))
    text = text.join(todo, ["place", "text_hash"])
    text = _in_blocks(text, "total", component_bytes, "key").select("label", "low", "high", "own", "key", "n", "signature", "text")
    text = text.repartition("label", "low", "high").sortWithinPartitions("label", "low", "high")
    verified = checkpointed(text.mapInArrow(_verify, VERIFIED), gathered=True)

    grouped = components(verified.where("key != leader").select(F.col("key").alias("a"), F.col("leader").alias("b")))
    counted = verified.groupBy("key").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs")).join(grouped, F.col("key") == F.col("node"), "left")
    found = nodes.select("key", "n", "least").join(counted, "key", "left").withColumn("label", F.coalesce("label", "key"))
    found = found.select("key", "label", "least", (F.col("n") - 1 + F.coalesce("docs", F.lit(0))).alias("n_links"), F.coalesce("texts", F.lit(0)).alias("n_text_links"))
    return signed.select("doc_id", "text_hash", "key"), checkpointed(found, gathered=True)


def near_duplicates(docs: DataFrame, bucket_block: int = 8192, component_bytes: int = 16_000_000) -> DataFrame:
    """doc_id, text_hash, class_id, n_links, n_text_links, has_words of every row of `docs` (doc_id, text).

    class_id is the least doc_id of the documents that links connect (its own without links). n_links
    counts the other documents of similarity 0.8 or more, copies included; n_text_links counts the
    other shingle sets.
    """
    signed, found = _classes(docs, bucket_block, component_bytes)
    smallest = found.groupBy("label").agg(F.min("least").alias("class_id"))
    found = salted_join(found, smallest, "label", "key").select("key", "class_id", "n_links", "n_text_links")
    out = salted_join(signed, found, "key", "text_hash", "doc_id", how="left")
    return out.select("doc_id", "text_hash", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_text_links", F.lit(0)).cast("long").alias("n_text_links"), F.col("key").isNotNull().alias("has_words"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_text_links")


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group stays; the columns of documents.

    It is the one with the least id, null ids last, then with the least hash of its text; of rows that
    repeat both, any one. Documents without words are groups of their own and all stay.
    """
    signed, found = _classes(docs, 8192, 16_000_000)
    worded = signed.where("key is not null").groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("least"))
    first = worded.join(found.select("key", "label"), "key").groupBy("label").agg(F.min("least").alias("least"))
    place = F.xxhash64(F.lit(9), "doc_id", "text_hash").alias("place")
    first = first.select("least.doc_id", "least.text_hash").select(place, "text_hash")
    own = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.coalesce(F.col("text").rlike(WORD), F.lit(False)).alias("worded"))
    kept = own.where("worded").select("row", place, "text_hash").groupBy("place", "text_hash").agg(F.first("row").alias("row")).join(first, ["place", "text_hash"])
    return own.where("not worded").select("row.*").unionByName(kept.select("row.*"))
