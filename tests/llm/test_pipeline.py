import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from glintframe.llm import mixing, packing, quality, toxicity
from glintframe.llm.shingles import shingle_set

from .test_classifiers import SYLLABLES, prose


def make(n=260, seed=9):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        text = prose(rng.randrange(30, 200), rng)
        good, toxic = int(rng.random() < 0.8), int(rng.random() < 0.2)
        if not good:
            text = text.upper().replace(" ", "!! ")
        elif rows and rng.random() < 0.1:
            text = rows[rng.randrange(len(rows))][1] + " tail"
        if toxic:
            text += " " + " ".join("zork" + rng.choice(SYLLABLES) for _ in range(4))
        rows.append((i, text, f"s{i % 3}"))
        labels.append((i, good, toxic))
    return rows + [(n, None, "s0"), (n + 1, "", None), (n + 2, rows[0][1], "s1")], labels


@pytest.fixture
def data(spark, documents, folder):
    rows, labels = make()
    return rows, folder(documents=documents(rows), labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_stages_have_their_order():
    assert [f.__module__.rpartition(".")[2] for _, f in corpus_pipeline.STAGES] == ["toxicity", "quality", "jaccard", "mixing", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_run_equals_a_plain_version(spark, data):
    """Every stage's decisions once more by plain Python over its own input."""
    rows, d = data
    docs, texts = spark.read.parquet(f"{d}/documents.parquet"), {i: t for i, t, _ in rows}
    columns = docs.columns
    alive = [i for i, _, _ in rows]
    by_name = dict(corpus_pipeline.STAGES)

    model = toxicity.trained(docs, spark.read.parquet(f"{d}/labels.parquet"))
    want = [i for i in alive if model.scores([texts[i] or ""])[0] < toxicity.THRESHOLD]
    docs = by_name["toxicity"](spark, docs, d)
    assert docs.columns == columns and sorted(r["doc_id"] for r in docs.collect()) == want and len(want) < len(alive)

    model = quality.trained(docs, spark.read.parquet(f"{d}/labels.parquet"))
    alive, want = want, [i for i in want if model.scores([texts[i] or ""])[0] >= quality.THRESHOLD]
    docs = by_name["quality classifier"](spark, docs, d)
    assert docs.columns == columns and sorted(r["doc_id"] for r in docs.collect()) == want and len(want) < len(alive)

    sets = {i: set(shingle_set(texts[i]).tolist()) for i in want}
    alive, want, groups = want, [], {}
    for i in alive:
        near = [j for j in groups if sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and sets[j]]
        group = min([groups[j] for j in near], default=i)
        groups |= {k: group for k, g in groups.items() if g in {groups[j] for j in near}}
        groups[i] = group
    want = [i for i in alive if groups[i] == i]
    docs = by_name["n-gram Jaccard join"](spark, docs, d)
    assert docs.columns == columns and sorted(r["doc_id"] for r in docs.collect()) == want and len(want) < len(alive)

    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect()}
    mixed = by_name["mixing sources to target weights"](spark, docs, d)
    got = sorted(r["doc_id"] for r in mixed.collect())
    assert mixed.columns == columns and got == sorted(i for i, n in copies.items() for _ in range(n))

    packed = by_name["best-fit packing"](spark, mixed, d).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    total = sum(len(tokenizer.encode(texts[i] or "", add_special_tokens=False).ids) + 1 for i in got)
    assert sum(r["length"] for r in packed) == total and len({r["sequence_id"] for r in packed}) <= -(-total // packing.CAPACITY) + 1

    key = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, corpus_pipeline.run(spark, d).collect())) == sorted(map(key, packed))
    assert np.isfinite(total)
