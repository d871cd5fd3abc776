"""Exact top-k by inner product: ball-tree branch and bound in each shard.

Vectors are dealt to the nearest of coarse centres (k-means on a bounded sample, the rows with the least
hash of their id), and the lists so made into shards of about `shard_rows`. Each shard becomes one row: its
vectors in tree order and the tree's nodes (centre, radius, span). A list is a ball too, so a query q
orders the lists by their bound q.c + |q| r and visits them in three rounds: the best one, the next
`ahead`, and the rest. After each round the kth score found so far is shared, and lists bounded below it
are never sent the query. In a shard, nodes are bounded alike; a subtree whose bound lies below the kth
score is left out, the leaves that remain are visited from the highest bound down, and the kth score rises
as they are read. A shard returns only what reaches it.

Scale: a task holds one shard and one block of the queries that its list may answer, whatever the table's
size. The driver holds the sample, the balls of the lists (at most an eighth of it) and counts for each
length of vectors. Vector components become whole numbers, so scores are exact and ties are real.

Edge cases: null vectors, vectors with null or non-finite components and null ids take no part; rows
that repeat an id count once (the least vector); vectors of another length than the query's are
compared on none (each length is searched apart); fewer than k candidates give them all; an empty
table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, matrix, one_each, table, vectors_of
from .kmeans import kmeans, nearest

K = 5
LEAF = 128
OUT = "query_id long, vec_id long, score long"


def ball_tree(x: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """order, spans, centres, radii; node i has children 2i+1 and 2i+2 while its span is over `leaf`.

    spans[i] = (start, end, first child or 0). Nodes split at the median of the widest coordinate.
    """
    order = np.arange(len(x))
    spans, centres, radii = [], [], []
    todo = [(0, len(x), -1, 0)]
    children: dict[int, int] = {}
    at = 0
    while at < len(todo):
        start, end, _, _ = todo[at]
        own = x[order[start:end]]
        centre = own.mean(axis=0)
        spans.append((start, end))
        centres.append(centre)
        radii.append(float(np.sqrt(((own - centre) ** 2).sum(axis=1).max())))
        if end - start > leaf and radii[-1] > 0:
            axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
            half = (end - start) // 2
            cut = np.argpartition(own[:, axis], half)
            order[start:end] = order[start:end][cut]
            children[at] = len(todo)
            todo += [(start, start + half, at, 0), (start + half, end, at, 1)]
        at += 1
    first = np.array([children.get(i, 0) for i in range(len(spans))], dtype=np.int64)
    return order, np.column_stack([np.array(spans, dtype=np.int64), first]), np.array(centres), np.array(radii)


class Best:
    """The k best (score, id) of each of n queries so far, and the kth score to reach."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.scores = np.full((n, k), -np.inf)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)
        self.floor = floor.copy()

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores: rows x candidates; -inf leaves a candidate out."""
        k = self.scores.shape[1]
        s = np.concatenate([self.scores[rows], scores], axis=1)
        i = np.concatenate([self.ids[rows], np.broadcast_to(ids, scores.shape)], axis=1)
        order = np.lexsort((i, -s), axis=-1)[:, :k]
        self.scores[rows] = np.take_along_axis(s, order, 1)
        self.ids[rows] = np.take_along_axis(i, order, 1)
        self.floor[rows] = np.maximum(self.floor[rows], self.scores[rows, -1])


def search(tree: tuple, ids: np.ndarray, x: np.ndarray, qid: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int) -> Best:
    """Branch and bound over one shard; x and ids stand in tree order."""
    spans, centres, radii = tree
    best = Best(len(q), k, floor)
    norms = np.sqrt((q * q).sum(axis=1))

    def bound(rows: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        b = np.einsum("ij,ij->i", q[rows], centres[nodes]) + norms[rows] * radii[nodes]
        return b + 1e-6 + 1e-9 * np.abs(b) + 1e-9 * norms[rows] * radii[nodes]

    rows, nodes = np.arange(len(q)), np.zeros(len(q), dtype=np.int64)
    leaf_rows, leaf_nodes, leaf_bounds = [], [], []
    while len(rows):
        b = bound(rows, nodes)
        alive = b >= best.floor[rows]
        rows, nodes, b = rows[alive], nodes[alive], b[alive]
        down = spans[nodes, 2]
        is_leaf = down == 0
        leaf_rows.append(rows[is_leaf])
        leaf_nodes.append(nodes[is_leaf])
        leaf_bounds.append(b[is_leaf])
        rows, down = rows[~is_leaf], down[~is_leaf]
        rows, nodes = np.concatenate([rows, rows]), np.concatenate([down, down + 1])
    rows, nodes, bounds = map(np.concatenate, (leaf_rows, leaf_nodes, leaf_bounds))
    order = np.lexsort((-bounds, rows))
    rows, nodes, bounds = rows[order], nodes[order], bounds[order]
    turn = np.arange(len(rows)) - np.searchsorted(rows, rows)  # the how-manieth best leaf of its query
    for t in range(int(turn.max()) + 1 if len(turn) else 0):
        now = turn == t
        r, n, b = rows[now], nodes[now], bounds[now]
        alive = b >= best.floor[r]
        r, n = r[alive], n[alive]
        if not len(r):
            break  # bounds only fall from here on
        for node in np.unique(n):
            mine = r[n == node]
            start, end, _ = spans[node]
            scores = q[mine] @ x[start:end].T
            scores[ids[start:end][None, :] == qid[mine][:, None]] = -np.inf
            scores[scores < best.floor[mine][:, None]] = -np.inf
            best.add(mine, scores, ids[start:end])
    return best


class Lists:
    """Coarse centres of each length of vectors; lists of a length are numbered from base[length] on."""

    def __init__(self, centres: dict[int, np.ndarray]):
        self.centres = centres
        self.base = dict(zip(centres, np.cumsum([0, *map(len, centres.values())]).tolist()))
        self.radius = np.zeros(sum(map(len, centres.values())))

    def bounds(self, dim: int, q: np.ndarray) -> np.ndarray:
        """The largest score that each list (of its length) can hold for each query; -inf for lists without vectors."""
        base, c = self.base[dim], self.centres[dim]
        r = self.radius[base:base + len(c)]
        norms = np.sqrt((q * q).sum(axis=1))[:, None]
        b = q @ c.T + norms * r
        return np.where(r < 0, -np.inf, b + 1e-6 + 1e-9 * np.abs(b) + 1e-9 * norms * np.abs(r))


def _assign(lists: Lists):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for dim, own in pdf.groupby(pdf["vec"].map(len)) if len(pdf) else ():
                x = matrix(own["vec"])
                near = nearest(x, lists.centres[dim])
                away = np.sqrt(((x - lists.centres[dim][near]) ** 2).sum(axis=1))
                yield own.assign(list=(lists.base[dim] + near).astype(np.int32), away=away)
    return run


def _route(lists: Lists, start: int, stop: int | None):
    """The lists start:stop, by bound, of those that reach the query's floor."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for dim, own in pdf.groupby(pdf["vec"].map(len)) if len(pdf) else ():
                b = lists.bounds(dim, matrix(own["vec"]))
                order = np.argsort(-b, axis=1, kind="stable")[:, start:stop]
                alive = np.take_along_axis(b, order, 1) >= np.maximum(own["floor"].to_numpy(np.float64), -1e300)[:, None]
                yield own.assign(lists=[(lists.base[dim] + o[a]).astype(np.int32) for o, a in zip(order, alive)])
    return run


def _packed(pdf: pd.DataFrame) -> pd.DataFrame:
    """One shard as one row: ids and vectors in tree order, and the tree."""
    pdf = pdf.sort_values("vec_id")
    x, ids = matrix(pdf["vec"]), pdf["vec_id"].to_numpy(np.int64)
    order, spans, centres, radii = ball_tree(x)
    return pd.DataFrame({"list": [int(pdf["list"].iloc[0])], "part": [int(pdf["part"].iloc[0])], "ids": [ids[order].tobytes()], "x": [x[order].tobytes()], "spans": [spans.tobytes()], "centres": [centres.tobytes()], "radii": [radii.tobytes()]})


def _query_block(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"qlist": [int(pdf["list"].iloc[0])], "block": [int(pdf["block"].iloc[0])], "qids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "q": [matrix(pdf["vec"]).tobytes()], "floor": [pdf["floor"].to_numpy(np.float64).tobytes()]})


def _search_rows(k: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for row in pdf.itertuples(index=False):
                ids, qid = np.frombuffer(row.ids, np.int64), np.frombuffer(row.qids, np.int64)
                x, q = np.frombuffer(row.x).reshape(len(ids), -1), np.frombuffer(row.q).reshape(len(qid), -1)
                tree = np.frombuffer(row.spans, np.int64).reshape(-1, 3), np.frombuffer(row.centres).reshape(-1, x.shape[1]), np.frombuffer(row.radii)
                best = search(tree, ids, x, qid, q, np.frombuffer(row.floor), k)
                there = np.isfinite(best.scores)  # what the floor leaves out stays -inf
                yield pd.DataFrame({"query_id": np.repeat(qid, k)[there.ravel()], "vec_id": best.ids[there], "score": best.scores[there].astype(np.int64)})
    return run


def ranked(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of each query, ties to the smaller id."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact_top_k(vectors: DataFrame, is_query, k: int = K, shard_rows: int = 8192, block_rows: int = 1024, sample_rows: int = 16_384, ahead: int = 8, seed: int = 2) -> DataFrame:
    """The k best of every query against all other rows; vectors: vec_id, vec (whole numbers as doubles)."""
    spark = vectors.sparkSession
    vectors = checkpointed(one_each(vectors))
    lengths = {r["dim"]: r["n"] for r in vectors.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n")).orderBy("dim").collect()}  # one row a length
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    sample = vectors.orderBy(F.xxhash64(F.lit(seed), "vec_id"), "vec_id").limit(sample_rows).select("vec").toPandas()["vec"]
    centres = {}
    for dim, n in lengths.items():
        own = matrix([v for v in sample if len(v) == dim])
        many = min(-(-n // shard_rows), len(own) // 8)
        centres[dim] = kmeans(own, many, seed) if many > 1 else np.zeros((1, dim))
    lists = Lists(centres)
    put = checkpointed(vectors.mapInPandas(_assign(lists), "vec_id long, vec array<double>, list int, away double"))
    sizes = {r["list"]: (r["n"], r["away"]) for r in put.groupBy("list").agg(F.count("*").alias("n"), F.max("away").alias("away")).collect()}  # one row a list
    lists.radius = np.array([sizes.get(c, (0, -1.0))[1] for c in range(len(lists.radius))])
    parts = F.broadcast(spark.createDataFrame([(c, max(1, -(-sizes.get(c, (0, 0))[0] // shard_rows))) for c in range(len(lists.radius))], "list int, parts int"))  # one row a list
    part = F.pmod(F.xxhash64(F.lit(seed), "vec_id"), "parts").cast("int")
    tasks = max(8, 4 * spark.sparkContext.defaultParallelism, sum(lengths.values()) // shard_rows)
    trees = put.join(parts, "list").withColumn("part", part).repartition(tasks, "list", "part").groupBy("list", "part")
    trees = checkpointed(trees.applyInPandas(_packed, "list int, part int, ids binary, x binary, spans binary, centres binary, radii binary"))

    queries = vectors.where(is_query)
    blocks = max(1, -(-queries.count() // block_rows))
    queries = checkpointed(queries.withColumn("block", F.pmod(F.xxhash64(F.lit(seed + 1), "vec_id"), F.lit(blocks)).cast("int")).withColumn("floor", F.lit(float("-inf"))), gathered=True)
    routed = "vec_id long, vec array<double>, block int, floor double, lists array<int>"

    def found(rows: DataFrame) -> DataFrame:
        packs = rows.withColumn("list", F.explode("lists")).drop("lists").groupBy("list", "block").applyInPandas(_query_block, "qlist int, block int, qids binary, q binary, floor binary")
        packs = packs.join(parts.withColumnRenamed("list", "qlist"), "qlist").withColumn("qpart", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        met = trees.repartition(tasks, "list", "part").join(packs.repartition(tasks, "qlist", "qpart"), (F.col("list") == F.col("qlist")) & (F.col("part") == F.col("qpart")))
        return met.mapInPandas(_search_rows(k), OUT)

    best = None
    for start, stop in ((0, 1), (1, 1 + ahead), (1 + ahead, None)):
        if start >= max(map(len, centres.values())):
            break
        rows = found(queries.mapInPandas(_route(lists, start, stop), routed))
        best = checkpointed(ranked(rows if best is None else best.drop("rank").unionByName(rows), k), gathered=True)
        # The kth score so far bounds each query's kth score from below.
        floor = best.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("kth"))
        queries = queries.join(floor, "vec_id", "left").withColumn("floor", F.coalesce("kth", "floor")).drop("kth")
        queries = queries.select("vec_id", "vec", "block", "floor")
    return best


def op6_ball_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors_of(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    v = v.select("vec_id", F.transform("vec", lambda x: F.floor(x * 256).cast("double")).alias("vec"))
    return exact_top_k(v, F.col("vec_id") % 50 == 0)


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS vec FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.vec, c.vec) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
