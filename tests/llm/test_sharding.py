import zlib
from collections import Counter
from math import comb

import numpy as np
import pytest

from glintframe.llm import sharding


def test_hypergeometric_follows_its_law():
    rng = np.random.default_rng(0)
    good, bad, n, draws = 7, 9, 6, 20_000
    seen = Counter(sharding.hypergeometric(rng, good, bad, n) for _ in range(draws))
    for k in range(n + 1):
        p = comb(good, k) * comb(bad, n - k) / comb(good + bad, n)
        assert abs(seen[k] - draws * p) <= 5 * (draws * p) ** 0.5 + 1


@pytest.mark.parametrize("args", [(0, 5, 3), (5, 0, 3), (4, 4, 8), (3, 3, 0)])
def test_hypergeometric_at_the_edges(args):
    assert sharding.hypergeometric(np.random.default_rng(1), *args) == {(0, 5, 3): 0, (5, 0, 3): 3, (4, 4, 8): 4, (3, 3, 0): 0}[args]


def test_hypergeometric_beyond_billions():
    x = sharding.hypergeometric(np.random.default_rng(1), 10**12, 10**12, 10**7)
    assert abs(x - 5 * 10**6) < 10**4


def test_matrix_margins():
    counts = [0, 10, 1, 57, 32]
    m = sharding.communication_matrix(counts, 7, 3)
    assert m.sum(axis=1).tolist() == counts and m.sum(axis=0).max() - m.sum(axis=0).min() <= 1 and m.sum() == 100


def checked(rows, shards):
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    sizes = [len(by.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())


def test_documents(spark, documents):
    rows = [(i, f"text é {i % 7}") for i in range(500)] + [(3, "again"), (3, "again"), (None, "x"), (900, None), (901, ""), (902, "y" * 200_000)]
    df = documents(rows)
    out = sharding.shard_documents(df, bucket_rows=20, min_buckets=8).collect()
    checked(out, 24)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert {(r["law"], r["grown_shard"]) for r in out} == {("rows", None)}
    again = sharding.shard_documents(df.repartition(3), bucket_rows=20, min_buckets=8).collect()
    key = lambda r: tuple(-1 if v is None else v for v in (r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]))
    assert sorted(map(key, out)) == sorted(map(key, again))


def test_shuffle_is_uniform(documents):
    df = documents([(i, "x") for i in range(96)])
    first = Counter()
    for seed in range(12):
        out = sharding.shard_documents(df, 4, seed=seed, min_buckets=4).collect()
        checked(out, 4)
        first.update((r["doc_id"] // 24, r["shard"]) for r in out)
    assert all(abs(first[g, s] - 72) < 40 for g in range(4) for s in range(4))


def test_empty(spark, documents, folder):
    d = folder(documents=documents([]))
    assert sharding.op10_hypergeometric_sharding(spark, d).count() == 0
