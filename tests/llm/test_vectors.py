import numpy as np
import pandas as pd
import pytest

from glintframe.llm import ann, topk

NAN, INF = float("nan"), float("inf")


@pytest.fixture
def embeddings(spark):
    def make(rows):
        return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "x", None) for i, v in rows], "vec_id long, embedding array<float>, score string, shard int")
    return make


def usable(rows, nonzero=False):
    """id -> float32 vector of the rows that take part; of rows with one id the least."""
    out = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v) or nonzero and not any(v):
            continue
        v = np.asarray(v, dtype=np.float32).astype(np.float64)
        if i not in out or tuple(v) < tuple(out[i]):
            out[i] = v
    return out


def best(vectors, every, k):
    rows = []
    for q in sorted(vectors):
        if q % every == 0:
            own = sorted((-float((vectors[c] * vectors[q]).sum()), c) for c in vectors if c != q and len(vectors[c]) == len(vectors[q]))[:k]
            rows += [(q, r + 1, c, -s) for r, (s, c) in enumerate(own)]
    return rows


BAD = [(5000, None), (5050, [1.0, None, 2.0, 3.0]), (5100, [1.0, NAN, 0.0, 0.0]), (5150, [INF, 0.0, 0.0, 0.0]), (None, [1.0, 2.0, 3.0, 4.0])]


def test_top_k_against_brute_force(spark, embeddings, folder):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=4).round(1)) for i in range(700)] + [(i, [0.5, 0.5, 0.5, 0.5]) for i in range(800, 1000)] + [(100, [9.0, 9.0, 9.0, 9.0]), (100, [9.0, 9.0, 9.0, 9.0]), *BAD]
    out = topk.op6_ball_tree_top_k(spark, folder(embeddings=embeddings(rows))).collect()
    whole = {i: np.floor(256 * v) for i, v in usable(rows).items()}
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in out) == best(whole, 50, 5)


def test_top_k_in_small_shards_and_blocks(spark):
    rng = np.random.default_rng(1)
    rows = {i: np.floor(rng.normal(size=6) * 20) for i in range(400)}
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows.items()], "vec_id long, vec array<double>")
    out = topk.exact_top_k(df, df["vec_id"] % 7 == 0, 3, shard_rows=37, block_rows=10).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in out) == best(rows, 7, 3)


def test_lists_are_left_out_and_nothing_is_missed(spark):
    """Far clusters are never sent a query, whose best rows are found all the same; ids repeat across lists."""
    rng = np.random.default_rng(8)
    rows = [(i, np.floor(rng.normal(size=5) * 9 + 200 * np.eye(5)[i % 5])) for i in range(1500)]
    rows += [(30, np.floor(200 * np.eye(5)[4])), (35, np.floor(-200 * np.eye(5)[4])), (2000, np.array([1.0, 2.0])), (2002, np.array([3.0, 1.0]))]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, vec array<double>")
    one = {}
    for i, v in rows:
        if i not in one or tuple(v) < tuple(one[i]):
            one[i] = v
    out = topk.exact_top_k(df, df["vec_id"] % 10 == 0, 3, shard_rows=60, block_rows=40, ahead=2).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in out) == best(one, 10, 3)
    lists = topk.Lists({5: 200 * np.eye(5)})
    lists.radius = np.array([30.0, 30.0, 30.0, 30.0, -1.0])
    frame = pd.DataFrame({"vec_id": [1], "vec": [[200.0, 0.0, 0.0, 0.0, 0.0]], "block": [0], "floor": [30_000.0]})
    (routed,) = topk._route(lists, 0, None)(iter([frame]))
    assert routed["lists"][0].tolist() == [0]


def test_ball_tree_holds_its_points():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1000, 5))
    order, spans, centres, radii = topk.ball_tree(x, leaf=16)
    for (start, end, first), c, r in zip(spans, centres, radii):
        assert np.sqrt(((x[order[start:end]] - c) ** 2).sum(axis=1)).max() <= r + 1e-9
        if first:
            assert (spans[first][0], spans[first][1], spans[first + 1][0], spans[first + 1][1]) == (start, spans[first][1], spans[first][1], end)
    assert sorted(order.tolist()) == list(range(1000))


def test_search_leaves_nodes_out():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(500, 4)) + 50, rng.normal(size=(500, 4)) - 50])
    order, *tree = topk.ball_tree(x, leaf=32)
    seen = []
    add = topk.Best.add
    topk.Best.add = lambda self, rows, scores, ids: (seen.append(scores.size), add(self, rows, scores, ids))[1]
    try:
        topk.search(tree, order, x[order], np.array([-1]), np.array([[1.0, 1.0, 1.0, 1.0]]), np.array([-np.inf]), 5)
    finally:
        topk.Best.add = add
    assert sum(seen) <= 500


@pytest.mark.parametrize("rows", [[], [(0, [1.0, 2.0])], [(0, [1.0, 2.0]), (1, [0.0, 1.0]), (3, [2.0, 1.0])]])
def test_few_rows(spark, embeddings, folder, rows):
    d = folder(embeddings=embeddings(rows))
    v = usable(rows)
    out = topk.op6_ball_tree_top_k(spark, d).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in out) == [w[:3] for w in best({i: np.floor(256 * x) for i, x in v.items()}, 50, 5)]
    near = ann.op8_adaptive_dimension_scan(spark, d).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in near) == [w[:3] for w in best(v, 20, 20)]


def test_neighbours_recall_scores_and_ties(spark, embeddings, folder):
    rng = np.random.default_rng(4)
    rows = [(i, v / np.linalg.norm(v)) for i, v in enumerate(rng.normal(size=(3000, 24)))]
    rows += [(i, [1.0] + [0.0] * 23) for i in range(3000, 3300)] + [(4000, [0.0] * 24), (4020, None), (None, [1.0] * 24), (4040, [NAN] * 24)]
    out = ann.op8_adaptive_dimension_scan(spark, folder(embeddings=embeddings(rows))).toPandas()
    v = usable(rows, nonzero=True)
    want = pd.DataFrame(best(v, 20, 20), columns=["query_id", "rank", "vec_id", "score"])
    hits = out.merge(want, on=["query_id", "vec_id"])
    assert len(hits) >= 0.9 * len(want) and (out.groupby("query_id").size() == 20).all() and set(out.query_id) == set(want.query_id)
    for r in out.head(300).itertuples():
        assert r.score == pytest.approx(float((v[r.query_id] * v[r.vec_id]).sum()), abs=1e-15)
    for _, g in out.groupby("query_id"):
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 21)) and list(zip(-g.score, g.vec_id)) == sorted(zip(-g.score, g.vec_id))
    tied = out[out.query_id == 3000].sort_values("rank")  # its own vector 299 times: the smallest ids come first
    assert tied.vec_id.tolist() == list(range(3001, 3021))


def test_neighbours_of_every_length(spark, embeddings, folder):
    """Each length is searched apart; none is left out, and none that the sample lacks."""
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=(4, 6, 9)[i % 3])) for i in range(900)] + [(1000, [1.0, 2.0]), (1001, [2.0, 1.0]), (40, [-9.0] * 6), (44, [-9.0] * 9), (1020, [5.0])]
    d = folder(embeddings=embeddings(rows))
    out = ann.op8_adaptive_dimension_scan(spark, d).toPandas()
    want = pd.DataFrame(best(usable(rows, nonzero=True), 20, 20), columns=["query_id", "rank", "vec_id", "score"])
    assert len(out.merge(want, on=["query_id", "vec_id"])) >= 0.9 * len(want)
    assert out.groupby("query_id").size().to_dict() == want.groupby("query_id").size().to_dict()
    v = ann.vectors_of(spark.read.parquet(f"{d}/embeddings.parquet"), "vec_id", "embedding", nonzero=True)
    few = ann.nearest_by_product(v, v["vec_id"] % 20 == 0, 20, sample_rows=1).toPandas()  # one list for each length: nothing is missed
    assert sorted(zip(few.query_id, few["rank"], few.vec_id)) == sorted(zip(want.query_id, want["rank"], want.vec_id))


def test_clustered_vectors_need_few_probes():
    rng = np.random.default_rng(7)
    middle = rng.normal(size=(40, 16)) * 6
    x = middle[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 16)) * 0.3
    x /= np.linalg.norm(x, axis=1)[:, None]
    index = ann.Index(16, 1.0, 0, x, 126, 0.93, 20, 5)
    assert index.probes <= 20 < ann.Index(16, 1.0, 0, rng.normal(size=(4000, 16)) / 8, 126, 0.93, 20, 5).probes


def test_parts_and_blocks_do_not_matter(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(500, 8)))], "vec_id long, vec array<double>")
    run = lambda **o: sorted(map(tuple, ann.nearest_by_product(df, df["vec_id"] % 20 == 0, 5, recall=1.0, lists=6, **o).collect()))
    got = run(part_rows=23, block_rows=4)
    assert [g[:3] for g in got] == [w[:3] for w in best({i: np.array(v) for i, v in ((r["vec_id"], r["vec"]) for r in df.collect())}, 20, 5)]
