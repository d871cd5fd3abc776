import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from glintframe.llm import jaccard
from glintframe.llm.components import components
from glintframe.llm.shingles import MinHash, shingle_set


def shingles(text):
    """Runs of five words, or the words of a shorter text: sets of tuples, without hashes."""
    found = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").lower().encode())
    return {tuple(found[k:k + 5]) for k in range(max(1, len(found) - 4))} if found else set()


def brute(rows):
    """doc index -> (links, least id of its group) over rows (id, text)."""
    sets = [shingles(t) for _, t in rows]
    links, parent = [0] * len(rows), list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 5 * len(a & b) >= 4 * len(a | b):
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return [(links[i], least[root(i)]) for i in range(len(rows))]


def corpus(seed=0):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = []
    for g in range(12):
        base = rng.choices(vocabulary, k=rng.choice([8, 40, 150]))
        for _ in range(rng.choice([1, 2, 6, 25])):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append(" ".join(text))
    rows += ["one two", "one two", "One, two!", "one two three", "hey", "", "  ", None, None, "!!", "a b c d e", "A b c d e."]
    rng.shuffle(rows)
    return [(10 * k + 3, t) for k, t in enumerate(rows)]


@pytest.mark.parametrize("blocks", [{}, {"bucket_block": 3, "component_bytes": 400}])
def test_links_and_groups_against_brute_force(documents, blocks):
    rows = corpus()
    found = {r["doc_id"]: (r["n_links"], r["class_id"]) for r in jaccard.near_duplicates(documents(rows), **blocks).collect()}
    assert found == {d: w for (d, _), w in zip(rows, brute(rows))}


def test_repeated_rows_and_null_ids(documents):
    text = "the quick brown fox jumps over the lazy dog again"
    rows = [(5, text), (5, text), (None, text), (6, None), (None, None), (7, text.upper())]
    out = [(r["doc_id"], r["class_id"], r["n_links"], r["n_text_links"]) for r in jaccard.near_duplicates(documents(rows)).collect()]
    assert sorted(out, key=str) == sorted([(5, 5, 3, 0), (5, 5, 3, 0), (None, 5, 3, 0), (7, 5, 3, 0), (6, 6, 0, 0), (None, None, 0, 0)], key=str)


def test_many_rows_without_ids(documents):
    text = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    rows = [(None, text)] * 200 + [(1, text + " tail"), (2, None)]
    out = [(r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard.near_duplicates(documents(rows)).collect()]
    assert sorted(set(out), key=str) == sorted({(None, 1, 200), (1, 1, 200), (2, 2, 0)}, key=str) and len(out) == 202


def test_long_texts(documents):
    words = [f"t{k}" for k in range(30_000)]
    other = [*words]
    other[100] = "changed"
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(words[::-1]))]
    out = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.near_duplicates(documents(rows)).collect()}
    assert out == {1: (1, 1), 2: (1, 1), 3: (3, 0)}


def test_pruning_keeps_pairs_at_the_threshold():
    least = jaccard.least_agreements(0.8, jaccard.TOLERANCE)
    rng = np.random.default_rng(0)
    one = rng.integers(0, 2**32, jaccard.SIZE, dtype=np.uint64).astype("<u4")
    agree = rng.random((20_000, jaccard.SIZE)) < 0.8
    assert jaccard.stays(one, np.where(agree, one, one + 1), least).all()
    far = rng.random((20_000, jaccard.SIZE)) < 0.4
    assert jaccard.stays(one, np.where(far, one, one + 1), least).mean() < 0.01


def test_posterior_is_the_beta_tail():
    n, m, t = 16, 10, 0.8
    x = np.linspace(0, 1, 200_001)
    density = x**m * (1 - x) ** (n - m)
    tail = density[x >= t].sum() / density.sum()
    at = jaccard.least_agreements(t, tail - 1e-4, 16)[16]
    assert at == m and jaccard.least_agreements(t, tail + 1e-4, 16)[16] == m + 1


def test_minhash_estimates_similarity():
    x = np.random.default_rng(6).integers(0, 2**64, 1200, dtype=np.uint64)  # shingles are mixed hashes
    a, b = x[:1000], x[200:]
    h = MinHash(2000)
    assert abs((h(a) == h(b)).mean() - 800 / 1200) < 0.05


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(50)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["label"] for r in components(edges).collect()}
    assert got == {**{k: 0 for k in range(51)}, 100: 100, 101: 100}


def test_stage_keeps_one_of_each_group(spark, documents):
    rows = [*corpus(1), (3, None)]
    rows += [rows[0], rows[0]]
    df = documents(rows)
    out = jaccard.deduplicated(spark, df, "")
    assert out.columns == df.columns
    kept = sorted((r["doc_id"], r["text"]) for r in out.collect() if r["text"] is not None)
    want = brute(rows)
    alive = {d for (d, t), (_, g) in zip(rows, want) if d == g or not shingle_set(t).size}
    assert sorted({k for k in kept}) == sorted({(d, t) for d, t in rows if d in alive and t is not None})
    words = [k for k in kept if shingle_set(k[1]).size]
    assert len(words) == len(set(words))


def near_copies(n, words=60, seed=3):
    """n different texts, each of similarity 0.8 or more to all others: one word is exchanged at the end."""
    rng = random.Random(seed)
    base = [f"b{rng.randrange(10**6)}" for _ in range(words)]
    return [" ".join([*base, f"t{k}"]) for k in range(n)]


def test_near_copies_that_share_an_id_or_have_none(spark, documents):
    a, b, c = near_copies(3, seed=1), near_copies(3, seed=2), near_copies(4, seed=5)
    rows = [(5, t) for t in a] + [(None, t) for t in b] + [(None, c[0]), (9, c[1]), (8, c[2]), (8, c[3]), (8, c[3])] + [(1, None), (1, None), (2, ""), (None, "!")]
    extra = ["__hash", "__id", "__key", "__nth", "__salt", "row", "place", "text_hash", "worded", "label"]
    df = documents(rows).withColumnsRenamed({"lang": "__hash", "size": "__id", "key": "__key"})
    for name in extra[3:-1]:
        df = df.withColumn(name, F.lit(name))
    out = jaccard.deduplicated(spark, df, "")
    assert out.columns == df.columns
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert sum(t in a for _, t in got) == 1 and sum(t in b for _, t in got) == 1
    assert [i for i, t in got if t in c] == [8]
    assert len(got) == 3 + 4


def test_a_large_group_of_near_copies(spark, documents, tmp_path):
    """All links are counted, in blocks, and no row is copied for every other one."""
    n = 3000
    rows = [(k, t) for k, t in enumerate(near_copies(n))] + [(n + k, f"other text number {k} with words of its own {k * 7} {k * 11}") for k in range(500)]
    df = documents(rows)
    out = {r["doc_id"]: r for r in jaccard.near_duplicates(df, component_bytes=400_000).collect()}
    assert all(out[k]["class_id"] == 0 and out[k]["n_links"] == n - 1 for k in range(n))
    assert all(out[n + k]["class_id"] == n + k and out[n + k]["n_links"] == 0 for k in range(500))


def test_buckets_of_a_group_share_its_edges(documents, monkeypatch):
    """A group meets in a bucket of each band, in ten blocks; a node's edges are far fewer than its buckets and pairs of blocks."""
    edges = []
    monkeypatch.setattr(jaccard, "components", lambda df: edges.append(df.distinct().count()) or components(df))
    n = 600
    rows = [(k, f"x{k} y{k} {t}") for k, t in enumerate(near_copies(n))]
    out = jaccard.near_duplicates(documents(rows), bucket_block=60).collect()
    assert all(r["class_id"] == 0 and r["n_links"] == n - 1 for r in out) and len(out) == n
    assert n - 1 <= edges[0] <= 6 * n


def test_dropped_pairs_are_not_verified(monkeypatch):
    sets = [np.arange(k, k + 100, dtype=np.uint64) for k in (0, 5, 10)]
    h = MinHash(jaccard.SIZE)
    mixed = [x * np.uint64(0x9E3779B97F4A7C15) for x in sets]
    signatures = np.stack([h(x) for x in mixed])
    least = jaccard.least_agreements(0.8, jaccard.TOLERANCE)
    assert jaccard.links(mixed, signatures, least).sum() == 6
    signatures[2] += 1  # agrees with none: pruned before any set is looked at
    linked = jaccard.links(mixed, signatures, least)
    assert linked[0, 1] and not linked[:, 2].any() and not linked[2].any()
    assert not jaccard.links(mixed, signatures, least, np.array([0, 0, 1])).any()


def test_word_pattern_is_that_of_the_shingles(spark):
    texts = ["", " ", "!?", "a", "Z", "0", "é", "日", "\x7f", "\x80", "_-_", "\n", "İ", "\U0001f600"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in df.select("text", F.col("text").rlike(jaccard.WORD).alias("has")).collect():
        assert r["has"] == (len(shingle_set(r["text"])) > 0), r


def test_empty(spark, documents, folder):
    assert jaccard.op2_ngram_jaccard_join(spark, folder(documents=documents([]))).count() == 0
