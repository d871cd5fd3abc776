"""Approximate nearest neighbours by inner product: inverted lists scanned with an adaptive number of dimensions.

Inner product search becomes Euclidean search: with M the largest norm, x' = (x, sqrt(M^2 - |x|^2)) and
q' = (q, 0) give |x' - q'|^2 = |q|^2 + M^2 - 2 q.x. Vectors are turned by one random rotation and kept in
blocks of columns. k-means centres, fitted on a bounded sample (`sample_rows`, the rows with the least
hash of their id), define the lists, whose number grows with the square root of the table; every row is
put into its nearest list. A query probes its nearest lists, as many as the sample's own neighbours need
for a recall of `recall`: few where vectors cluster, many where they do not. Within a list the squared
distance is summed column block by column block; after d of D dimensions a candidate is abandoned when
its partial sum exceeds the kth distance * d/D * (1 + eps/sqrt(d))^2, the test at which a random rotation
would show a true neighbour with vanishing probability. Survivors get their exact inner product on the
original vectors, in double precision.

The nearest list is scanned first for all queries; the kth distances found there go along as
thresholds to the other lists.

Scale: lists larger than `part_rows` are split by a hash of the id, and the queries of a list come in
blocks, so a task holds one part and one block. Parts and queries meet in one shuffle each. The driver
holds the sample, the centres (at most an eighth of it), and counts for each list and each length of
vectors. The index has a row for each part.

Edge cases: vectors null, zero or with null or non-finite components and null ids take no part; rows
that repeat an id count once (the least vector); vectors of each length are searched apart, a length that
the sample lacks as one list; fewer than k candidates give those found; an empty table gives an empty
result. Ties in score go to the smaller id. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, matrix, one_each, table, vectors_of
from .kmeans import kmeans, nearest
from .topk import ranked

K = 20
COLUMNS = 16  # dimensions in a column block
EPS = 2.1
OUT = "query_id long, vec_id long, score double"


class Index:
    """What every task needs for vectors of one length: rotation, largest squared norm, centres (turned), lists to probe.

    Its lists are numbered from `base` on.
    """

    def __init__(self, dim: int, top: float, base: int, sample: np.ndarray, lists: int, recall: float, k: int, seed: int):
        self.rotation = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim + 1, dim + 1)))[0]
        self.top, self.base = top, base
        self.centres, self.probes = np.zeros((1, dim + 1)), 1
        if lists > 1:
            self.centres = kmeans(self.turned(sample), lists, seed)
            self.probes = self.needed(sample, recall, k)

    def turned(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        last = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.top - (x * x).sum(axis=1), 0.0))
        return np.column_stack([x, last]) @ self.rotation

    def ordered(self, q: np.ndarray) -> np.ndarray:
        """All lists, nearest first, of each query."""
        t = self.turned(q, query=True)
        return np.argsort((self.centres * self.centres).sum(axis=1)[None, :] - 2 * t @ self.centres.T, axis=1, kind="stable")

    def needed(self, sample: np.ndarray, recall: float, k: int, queries: int = 512) -> int:
        """Lists to probe so that the share `recall` of the k neighbours, within the sample, of some of it lies in them.

        The sample is thinner than the table, its neighbours lie farther apart: the table's recall is higher.
        """
        q = sample[:queries]
        scores = q @ sample.T
        scores[np.arange(len(q)), np.arange(len(q))] = -np.inf
        near = np.argsort(-scores, axis=1, kind="stable")[:, :min(k, len(sample) - 1)]
        place = np.argsort(self.ordered(q), axis=1)
        turns = np.take_along_axis(place, nearest(self.turned(sample), self.centres)[near], axis=1)
        return int(np.quantile(turns, recall, method="higher")) + 1


Indexes = dict[int, Index]  # by length of vectors


def scan_part(x: np.ndarray, ids: np.ndarray, blocks: list[np.ndarray], q: np.ndarray, qid: int, qt: np.ndarray, limit: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and exact scores of one part's candidates for one query; limit: squared distance to beat."""
    dims = sum(len(b) for b in blocks)
    alive = np.flatnonzero(ids != qid)
    if not np.isfinite(limit) and len(alive) > k:
        # No threshold yet: the first k candidates' own distances give one.
        some = alive[:k]
        own = sum(((b[:, some] - qt[s:s + len(b), None]) ** 2).sum(axis=0) for s, b in zip(range(0, dims, COLUMNS), blocks))
        limit = float(own.max())
    partial = np.zeros(len(alive))
    for start, block in zip(range(0, dims, COLUMNS), blocks):
        d = start + len(block)
        diff = block[:, alive] - qt[start:d, None]
        partial += (diff * diff).sum(axis=0)
        if np.isfinite(limit):
            slack = 1.0 + 1e-9 if d == dims else (1 + EPS / np.sqrt(d)) ** 2
            keep = partial * dims <= limit * d * slack + 1e-9
            alive, partial = alive[keep], partial[keep]
        if not len(alive):
            break
    scores = (x[alive] * q).sum(axis=1)
    return ids[alive], scores


def _pack_part(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("vec_id")
    return pd.DataFrame({"list": [int(pdf["list"].iloc[0])], "part": [int(pdf["part"].iloc[0])], "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "x": [matrix(pdf["vec"]).tobytes()]})


def _pack_queries(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"qlist": [int(pdf["list"].iloc[0])], "block": [int(pdf["block"].iloc[0])], "qids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "q": [matrix(pdf["vec"]).tobytes()], "limits": [pdf["limit"].to_numpy(np.float64).tobytes()]})


def _by_length(pdf: pd.DataFrame) -> Iterator[tuple[int, pd.DataFrame]]:
    return iter(pdf.groupby(pdf["vec"].map(len)))


def _assign(indexes: Indexes):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for dim, own in _by_length(pdf) if len(pdf) else ():
                index = indexes[dim]
                yield own.assign(list=(index.base + nearest(index.turned(matrix(own["vec"])), index.centres)).astype(np.int32))
    return run


def _route(indexes: Indexes):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for dim, own in _by_length(pdf) if len(pdf) else ():
                index = indexes[dim]
                to = index.ordered(matrix(own["vec"]))[:, :index.probes]
                yield pd.DataFrame({"vec_id": own["vec_id"].to_numpy(), "vec": own["vec"].to_numpy(), "top": index.top, "lists": list((index.base + to).astype(np.int32))})
    return run


def _scan(indexes: Indexes, k: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for row in pdf.itertuples(index=False):
                ids, qid = np.frombuffer(row.ids, np.int64), np.frombuffer(row.qids, np.int64)
                x, q = np.frombuffer(row.x).reshape(len(ids), -1), np.frombuffer(row.q).reshape(len(qid), -1)
                index = indexes[x.shape[1]]
                turned, qt = np.ascontiguousarray(index.turned(x).T), index.turned(q, query=True)
                blocks = [turned[s:s + COLUMNS] for s in range(0, len(turned), COLUMNS)]
                out = []
                for j, limit in enumerate(np.frombuffer(row.limits)):
                    found, scores = scan_part(x, ids, blocks, q[j], qid[j], qt[j], limit, k)
                    best = np.lexsort((found, -scores))[:k]
                    out.append((np.full(len(best), qid[j]), found[best], scores[best]))
                yield pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*out)))))
    return run


def nearest_by_product(vectors: DataFrame, is_query, k: int = K, recall: float = 0.93, lists: int | None = None, sample_rows: int = 16_384, part_rows: int = 8192, block_rows: int = 1024, seed: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k nearest found; vectors: vec_id, vec.

    lists: of each length of vectors; by default twice the square root of their number, and at most one for
    8 rows of the sample. recall: 1.0 probes every list that holds a neighbour within the sample.
    """
    spark = vectors.sparkSession
    vectors = checkpointed(one_each(vectors))
    squares = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)
    lengths = vectors.groupBy(F.size("vec").alias("dim")).agg(F.max(squares).alias("top"), F.count("*").alias("n")).orderBy("dim").collect()  # one row a length
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = vectors.orderBy(F.xxhash64(F.lit(seed), "vec_id"), "vec_id").limit(sample_rows).select("vec").toPandas()["vec"]
    indexes: Indexes = {}
    base = 0
    for row in lengths:
        own = matrix([v for v in sample if len(v) == row["dim"]])
        many = max(1, min(lists or round(2 * row["n"] ** 0.5), len(own) // 8))
        indexes[row["dim"]] = Index(row["dim"], row["top"], base, own, many, recall, k, seed)
        base += len(indexes[row["dim"]].centres)

    put = checkpointed(vectors.mapInPandas(_assign(indexes), "vec_id long, vec array<double>, list int"))
    sizes = {r["list"]: r["n"] for r in put.groupBy("list").agg(F.count("*").alias("n")).collect()}  # one row a list
    parts = F.broadcast(spark.createDataFrame([(c, max(1, -(-sizes.get(c, 0) // part_rows))) for c in range(base)], "list int, parts int"))  # one row a list
    part = F.pmod(F.xxhash64(F.lit(seed), "vec_id"), "parts").cast("int")
    tasks = max(8, 4 * spark.sparkContext.defaultParallelism, sum(sizes.values()) // (4 * part_rows))
    packed = checkpointed(put.join(parts, "list").withColumn("part", part).repartition(tasks, "list", "part").groupBy("list", "part").applyInPandas(_pack_part, "list int, part int, ids binary, x binary"))

    routed = checkpointed(vectors.where(is_query).mapInPandas(_route(indexes), "vec_id long, vec array<double>, top double, lists array<int>"))
    blocks = max(1, -(-routed.count() // block_rows))

    def found(rows: DataFrame) -> DataFrame:
        """rows: vec_id, vec, limit, lists; each goes once to every part of its lists."""
        rows = rows.withColumn("block", F.pmod(F.xxhash64(F.lit(seed + 1), "vec_id"), F.lit(blocks)).cast("int"))
        rows = rows.withColumn("list", F.explode("lists")).select("vec_id", "vec", "limit", "block", "list")
        packs = rows.groupBy("list", "block").applyInPandas(_pack_queries, "qlist int, block int, qids binary, q binary, limits binary")
        packs = packs.join(parts.withColumnRenamed("list", "qlist"), "qlist").withColumn("qpart", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        met = packed.repartition(tasks, "list", "part").join(packs.repartition(tasks, "qlist", "qpart"), (F.col("list") == F.col("qlist")) & (F.col("part") == F.col("qpart")))
        return met.mapInPandas(_scan(indexes, k), OUT)

    first = checkpointed(found(routed.withColumn("lists", F.slice("lists", 1, 1)).withColumn("limit", F.lit(float("inf")))), gathered=True)
    # |q' - x'|^2 = |q|^2 + M^2 - 2 q.x of the kth found so far.
    kth = ranked(first, k).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("kth"))
    rest = routed.where(F.size("lists") > 1).withColumn("lists", F.expr("slice(lists, 2, size(lists) - 1)")).join(kth, "vec_id", "left")
    rest = rest.withColumn("limit", F.coalesce(squares + F.col("top") - 2 * F.col("kth"), F.lit(float("inf"))))
    return ranked(first.unionByName(found(rest)), k)


def op8_adaptive_dimension_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors_of(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", nonzero=True)
    return nearest_by_product(v, F.col("vec_id") % 20 == 0)
