import random
import zlib

import numpy as np
import pytest

from glintframe.llm import quality, toxicity
from glintframe.llm.shingles import words
from glintframe.llm.training import labelled_sample

RNG = random.Random(0)
SYLLABLES = ["ta", "ri", "mo", "ne", "lu", "sha", "ve", "ko"]


def prose(n, rng):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def toxic_documents(n=700, seed=1):
    rng = random.Random(seed)
    texts, y = [], []
    for _ in range(n):
        text = prose(rng.randrange(5, 300), rng).split()
        y.append(int(rng.random() < 0.3))
        if y[-1]:
            for _ in range(max(2, len(text) // 50)):
                text[rng.randrange(len(text))] = "zork" + rng.choice(SYLLABLES) if rng.random() < 0.7 else "grumfle"
        texts.append(" ".join(text))
    return texts, np.array(y)


@pytest.fixture(scope="module")
def toxic_model():
    texts, y = toxic_documents()
    return toxicity.fit(texts, y)


def test_toxicity_held_out(toxic_model):
    texts, y = toxic_documents(400, seed=2)
    score = toxic_model.scores(texts)
    assert ((score >= toxicity.THRESHOLD) == y).mean() >= 0.95 and score.min() >= 0 and score.max() <= 1


def test_one_toxic_window_in_a_long_text(toxic_model):
    rng = random.Random(3)
    text = prose(5000, rng).split()
    clean = toxic_model.scores([" ".join(text)])[0]
    text[3000:3040:10] = ["zorkta", "grumfle", "zorkmo", "grumfle"]
    assert toxic_model.scores([" ".join(text)])[0] > max(0.5, clean)


def test_scores_do_not_depend_on_the_batch(toxic_model):
    texts, _ = toxic_documents(40, seed=4)
    texts += ["", "  ", "!!!", "é" * 3000, "x " * 20_000]
    together = toxic_model.scores(texts)
    toxicity._met.clear()
    alone = np.array([toxic_model.scores([t])[0] for t in texts])
    assert np.allclose(together, alone, atol=1e-5)


def test_windows_cover_every_word():
    for n in (0, 1, 47, 48, 49, 80, 81, 1000):
        starts = toxicity.window_starts(n)
        covered = {i for s in starts for i in range(s, min(n, s + toxicity.WINDOW))}
        assert covered == set(range(n)) and all(b - a == toxicity.STRIDE for a, b in zip(starts, starts[1:]))


def test_n_grams_are_those_of_the_word():
    rows, begin = toxicity.gram_rows([b"a", b"ab", b"abc"])
    ends = [*begin[1:], len(rows)]
    by_word = [rows[a:b].tolist() for a, b in zip(begin, ends)]
    assert [len(x) for x in by_word] == [1, 3, 6]
    alone, _ = toxicity.gram_rows([b"abc"])
    assert sorted(alone.tolist()) == sorted(by_word[2])


def random_model(rng):
    k, d = toxicity.HIDDEN, toxicity.DIM
    m = toxicity.Model()
    m.p = {f"U{s}": rng.normal(size=(k, 3 * k)) for s in "fb"} | {"A": rng.normal(size=(2 * k, k)), "a": rng.normal(size=k), "w": rng.normal(size=k), "c": rng.normal(size=2 * k), "d": rng.normal(size=1), "E": rng.normal(size=(toxicity.WORD_ROWS, d)), "G": rng.normal(size=(toxicity.GRAM_ROWS, d))}
    m.p |= {f"W{s}": rng.normal(size=(3 * d, 3 * k)) for s in "fb"} | {f"b{s}": rng.normal(size=3 * k) for s in "fb"}
    return m


def plain_score(m, text):
    """The network word by word, as its formulas say."""
    p, k = m.p, toxicity.HIDDEN
    sig = lambda v: 1 / (1 + np.exp(-v))

    def vector(word):
        grams = [p["G"][g] for g in toxicity.gram_rows([word])[0]]
        return np.concatenate([p["E"][toxicity.word_rows([word])[0]], np.max(grams, axis=0), np.mean(grams, axis=0)])

    def states(xs, side):
        h, out = np.zeros(k), []
        for x in xs:
            a = x @ p[f"W{side}"] + p[f"b{side}"]
            z, r = sig(a[:k] + h @ p[f"U{side}"][:, :k]), sig(a[k:2 * k] + h @ p[f"U{side}"][:, k:2 * k])
            c = np.tanh(a[2 * k:] + (r * h) @ p[f"U{side}"][:, 2 * k:])
            h = (1 - z) * h + z * c
            out.append(h)
        return out

    found, best = words(text), -np.inf
    for start in toxicity.window_starts(len(found)):
        xs = [vector(w) for w in found[start:start + toxicity.WINDOW]]
        if xs:
            both = [np.concatenate(x) for x in zip(states(xs, "f"), states(xs[::-1], "b")[::-1])]
            e = np.exp([np.tanh(h @ p["A"] + p["a"]) @ p["w"] for h in both])
            pooled = sum(w * h for w, h in zip(e / e.sum(), both))
        else:
            pooled = np.zeros(2 * k)
        best = max(best, pooled @ p["c"] + p["d"][0])
    return sig(best)


def test_scores_against_a_plain_network():
    m = random_model(np.random.default_rng(5))
    rng = random.Random(8)
    texts = [prose(n, rng) for n in (1, 2, 47, 48, 49, 80, 81, 200)] + ["One, TWO three!"]
    toxicity._met.clear()
    assert np.allclose(m.scores(texts), [plain_score(m, t) for t in texts], atol=1e-4)


def test_toxicity_gradients():
    """The step's gradients of every weight against differences of the loss; the second document has two windows."""
    rng = np.random.default_rng(0)
    steps, lanes, sharpness = 5, 4, 1.7
    m = random_model(rng)
    every = [b"one", b"two", b"three", b"four"]
    ids = rng.integers(0, 4, (steps, lanes))
    mask = np.arange(steps)[:, None] < np.array([5, 3, 1, 4])
    of, y = np.array([0, 1, 1, 2]), np.array([1.0, 0.0, 1.0])

    def loss():
        s = m.windows(m.projected(m.vectors(every)["x"]), ids, mask)["logit"]
        s = np.array([np.log(np.exp(sharpness * s[of == i]).mean()) / sharpness for i in range(3)])
        return float((np.logaddexp(0, s) - y * s).mean())

    caught, dx, v = toxicity.gradients(m, every, ids, mask, of, y, sharpness)
    d = toxicity.DIM
    by_word = np.zeros_like(m.p["E"])
    np.add.at(by_word, v["rows"], dx[:, :d])
    for name, g in {**caught, "E": by_word}.items():
        flat = m.p[name].reshape(-1)
        places = v["rows"] * d + 1 if name == "E" else rng.integers(0, flat.size, 4)
        for at in places:
            old = flat[at]
            flat[at] = old + 1e-5
            up = loss()
            flat[at] = old - 1e-5
            down = loss()
            flat[at] = old
            assert (up - down) / 2e-5 == pytest.approx(g.reshape(-1)[at], abs=1e-6)


def test_tables_learn_from_random_starts(toxic_model):
    """Nothing about labels is in the tables before training, and rare rows stay zero."""
    texts, y = toxic_documents()
    found = sorted({w for t in texts for w in words(t)})
    rows = toxicity.word_rows(found)
    seen = np.zeros(toxicity.WORD_ROWS, dtype=int)
    for t in texts:
        seen[np.unique(toxicity.word_rows(words(t)))] += 1
    rare = seen[rows] < min(toxicity.LEAST_DOCUMENTS, max(2, len(texts) // 100))
    assert (toxic_model.p["E"][rows[rare]] == 0).all()
    alone = dict(zip(found, toxic_model.scores([w.decode() for w in found])))
    assert alone[b"grumfle"] > np.quantile(list(alone.values()), 0.9)


def test_sample_takes_runs_of_long_texts(spark, documents):
    text = "".join(chr(97 + i % 26) for i in range(1000))
    docs = documents([(1, text), (2, "short"), (3, None), (4, "x" * 64)])
    labels = spark.createDataFrame([(i, 1) for i in range(1, 5)], "doc_id long, toxic int")
    got = labelled_sample(docs, labels, "toxic", 1, 5, (9, 9), 64)
    assert got["doc_id"].tolist() == [1, 2, 4] and got["text"][1] == "short" and got["text"][2] == "x" * 64
    runs = got["text"][0].split(" ")
    assert [len(r) for r in runs] == [8] * 8 and runs[0] == text[:8] and runs[-1] == text[-8:] and all(r in text for r in runs)


def quality_documents(n=300, seed=5):
    rng = random.Random(seed)
    texts, y = [], []
    for _ in range(n):
        text = prose(rng.randrange(10, 200), rng)
        y.append(int(rng.random() < 0.8))
        if not y[-1]:
            text = rng.choice([lambda t: t.upper().replace(" ", "!! "), lambda t: t.replace(" ", " | "), lambda t: " ".join(w for w in t.split() for _ in range(5))])(text)
        texts.append(text)
    return texts, np.array(y)


def test_quality_held_out():
    model = quality.fit(*quality_documents())
    texts, y = quality_documents(200, seed=6)
    assert ((model.scores(texts) >= quality.THRESHOLD) == y).mean() >= 0.97
    odd = ["", " ", "é" * 5000, "word " * 60_000, "\x00", "\U0001f600 a"]
    assert np.allclose(model.scores(odd), [model.scores([t])[0] for t in odd])


def test_quality_gradients():
    rng = np.random.default_rng(1)
    model = quality.fit(["a b c", "A!! B!!"] * 4, np.array([1, 0] * 4))
    x, owner = rng.normal(size=(7, quality.INPUTS + quality.DIM)), np.array([0, 0, 0, 1, 1, 2, 2])
    y, weight = np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])

    def loss():
        s = model.forward(x, owner, 3)["s"]
        return float((-(y * np.log(s) + (1 - y) * np.log(1 - s)) * weight).sum() / weight.sum())

    for name, g in quality.gradients(model, x, owner, y, weight).items():
        flat = x.reshape(-1) if name == "x" else model.p[name].reshape(-1)
        for at in rng.integers(0, flat.size, 5):
            old = flat[at]
            flat[at] = old + 1e-5
            up = loss()
            flat[at] = old - 1e-5
            down = loss()
            flat[at] = old
            assert (up - down) / 2e-5 == pytest.approx(np.asarray(g).reshape(-1)[at], abs=1e-6)


def test_quality_against_a_plain_network():
    """Passage by passage, word by word."""
    model = quality.fit(*quality_documents(80))
    p = model.p
    sig = lambda v: 1 / (1 + np.exp(-v))
    texts, _ = quality_documents(12, seed=9)
    texts += ["", "one", "w " * 64, "w " * 65]
    for text, score in zip(texts, model.scores(texts)):
        found, hs = text.split(), []
        for at in range(0, max(1, len(found)), quality.PASSAGE):
            passage = " ".join(found[at:at + quality.PASSAGE])
            f = quality.passages([passage])
            own = np.mean([p["E"][r] for w in passage.split() for r in quality.passages([w]).rows], axis=0) if passage else np.zeros(quality.DIM)
            x = f.x[0].copy()
            if at and found[at - 1:at] and found[at] == found[at - 1]:  # repeats look across the border
                x[quality.CLASSES + 3] += 1 / len(passage.split())
            for k in range(2):
                if at >= 2 and at + k < len(found) and found[at + k] == found[at + k - 2]:
                    x[quality.CLASSES + 4] += 1 / len(passage.split())
            hs.append(np.tanh(np.concatenate([(x - model.mean) / model.scale, own]) @ p["W"] + p["b"]))
        e = np.exp([(np.tanh(h @ p["V"] + p["v"]) * sig(h @ p["U"] + p["u"])) @ p["w"] for h in hs])
        assert score == pytest.approx(sig(sum(w * h for w, h in zip(e / e.sum(), hs)) @ p["c"] + p["d"][0]), abs=1e-6)


def test_quality_learns_words():
    """Texts of one shape that only their words tell apart."""
    def some(n, seed):
        rng = random.Random(seed)
        y = [int(rng.random() < 0.5) for _ in range(n)]
        return [" ".join(rng.choice(("mota", "neri", "vesh") if v and rng.random() < 0.3 else ("luko", "sami", "dote")) for _ in range(rng.randrange(20, 150))) for v in y], np.array(y)
    model = quality.fit(*some(200, 1))
    texts, y = some(100, 2)
    assert ((model.scores(texts) >= 0.5) == y).mean() >= 0.95


def test_passages_cut_at_words():
    x, owner, rows, bag = quality.passages(["w " * 130, "", "one"])
    assert bag.tolist() == [0] * 64 + [1] * 64 + [2] * 2 + [4] and len(set(rows.tolist())) == 2
    assert owner.tolist() == [0, 0, 0, 1, 2] and x[:, -1].tolist() == [1.0, 1.0, 2 / 64, 0.0, 1 / 64]


@pytest.mark.parametrize("module, query, label, fold", [(quality, quality.op5_attention_quality, "quality", (5, 0)), (toxicity, toxicity.op1_toxicity_gru, "toxic", (4, 2))])
def test_queries(spark, documents, folder, module, query, label, fold):
    texts, y = (quality_documents if label == "quality" else toxic_documents)(160, seed=7)
    rows = [*enumerate(texts), (900, None), (901, ""), (3, texts[3]), (None, "a b"), (902, "long " * 30_000)]
    labels = [(i, int(v), int(v)) for i, v in enumerate(y)] + [(5, None, None), (None, 1, 1), (7, int(y[7]), int(y[7])), (100_000, 1, 1)]
    d = folder(documents=documents(rows), labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    out = query(spark, d).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % fold[0] == fold[1])
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    # The held-out fold's labels have no say: turning them around changes nothing.
    turned = [(i, None if a is None else 1 - a if i is not None and zlib.crc32(str(i).encode()) % fold[0] == fold[1] else a) for i, a, _ in labels]
    d = folder(documents=documents(rows), labels=spark.createDataFrame([(i, a, a) for i, a in turned], "doc_id long, quality int, toxic int"))
    key = lambda r: (str(r["doc_id"]), round(r["score"], 4))
    assert sorted(map(key, query(spark, d).collect())) == sorted(map(key, out))


@pytest.mark.parametrize("query", [quality.op5_attention_quality, toxicity.op1_toxicity_gru])
def test_without_rows_or_labels(spark, documents, folder, query):
    schema = "doc_id long, quality int, toxic int"
    none = spark.createDataFrame([], schema)
    assert query(spark, folder(documents=documents([]), labels=none)).count() == 0
    assert query(spark, folder(documents=documents([(1, "a")]), labels=none)).count() == 1
    one = spark.createDataFrame([(i, 1, 1) for i in range(9)], schema)
    assert {r["score"] for r in query(spark, folder(documents=documents([(i, "a") for i in range(9)]), labels=one)).collect()} == {1.0}


def test_words_fold_case():
    assert words("Ab, É-x_9") == [b"ab", "é".encode(), b"x", b"9"]
