import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from glintframe.llm import packing

PATH = public_tokenizers.path(packing.TOKENIZER)
LIBRARY = Tokenizer.from_file(PATH)


def ids_of(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aA'sSt rRéÉß²½ \u0085\x1c\t\n.,!?0123éΣ日​<|>endoftxs"), max_size=60), max_size=4))
def test_encoder_equals_library(texts):
    assert packing.encoder(PATH).encode(texts) == [np.array(ids_of(t), dtype="<u4").tobytes() for t in texts]


@pytest.mark.parametrize("text", ["it's don't I'LL 'S ''s", "<|endoftext|> a<|startoftext|>b", "ªºµÀ×÷ÿ", "x" * 3000, "\x00 a\x85b\xa0c", "İIı", ""])
def test_encoder_on_hard_texts(text):
    assert packing.encoder(PATH).encode([text]) == [np.array(ids_of(text), dtype="<u4").tobytes()]


def test_table_stays_bounded(monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 20)
    e = packing.CachedEncoder(PATH)
    for k in range(20):
        text = " ".join(f"word{k} other{j}" for j in range(5))
        assert e.encode([text]) == [np.array(ids_of(text), dtype="<u4").tobytes()]
        assert len(e.known) + len(e.older) <= 60


def test_knapsack_against_brute_force():
    lengths, value = np.array([5, 7, 11, 20]), np.array([5.0, 7.5, 10.0, 23.0])
    best = packing.knapsack(lengths, value, 32)
    for c in range(33):
        assert best[c] == max(a * 5 + b * 7.5 + d * 10 + e * 23 for a in range(7) for b in range(5) for d in range(3) for e in range(2) if 5 * a + 7 * b + 11 * d + 20 * e <= c)
    choice = packing.openings(best, lengths, value, np.ones(4), np.random.default_rng(0))
    worth = dict(zip(lengths.tolist(), value.tolist()))
    for c in range(33):
        total, room = 0.0, c
        while choice[room]:
            total, room = total + worth[choice[room]], room - choice[room]
        assert total == best[c]


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_every_piece_once(seed):
    rng = random.Random(seed)
    capacity = 256
    histogram = {}
    for _ in range(rng.choice([3, 50, 4000])):
        x = min(capacity, 1 + int(rng.expovariate(1 / 60)))
        histogram[x] = histogram.get(x, 0) + 1
    intervals, n = packing.packing_plan(histogram, capacity)
    free = [0] * n
    for length, times in histogram.items():
        own = sorted(i for i in intervals if i[0] == length)
        for r in range(times):
            _, low, each, first, offset = [i for i in own if i[1] <= r][-1]
            sequence, at = first + (r - low) // each, offset + length * ((r - low) % each)
            free[sequence] += length
            assert at + length <= capacity
    assert all(0 < f <= capacity for f in free)
    assert n <= -(-sum(k * v for k, v in histogram.items()) // capacity) + 1 + n // 50


def test_program_does_most_of_a_large_histogram():
    rng = np.random.default_rng(0)
    lengths, counts = np.unique(np.minimum(4096, 1 + rng.exponential(700, 100_000)).astype(int), return_counts=True)
    histogram = dict(zip(lengths.tolist(), (counts * 50).tolist()))
    plan, rest, program = packing.configurations(histogram, 4096)
    assert sum(rest.values()) < 0.1 * sum(histogram.values())
    assert program.value <= 1.002 * program.bound
    _, n = packing.packing_plan(histogram)
    assert n <= 1.002 * sum(k * v for k, v in histogram.items()) / 4096 + 1


def pieces_of(plan):
    return sum(times * sum(config.values()) for config, times in plan)


#: Histograms and the fewest sequences any packing needs.
KNOWN = {
    "thirds": ({1500: 900, 1200: 900, 1396: 900}, 900),
    "one length": ({1500: 10_000}, 5000),
    "two a sequence": ({900: 5000, 1700: 5000, 2500: 5000}, 7500),
    "halves": ({x: 100 for x in range(2100, 2201)}, 10_100),
    "pairs": ({x: 20 for x in range(1, 4097)}, 40_970),
}


@pytest.mark.parametrize("name", KNOWN)
def test_known_optima(name):
    histogram, fewest = KNOWN[name]
    plan, rest, program = packing.configurations(histogram, 4096)
    assert program.bound <= fewest + 1e-6
    assert pieces_of(plan) >= 0.95 * sum(histogram.values())
    _, n = packing.packing_plan(histogram)
    assert fewest <= n <= fewest + len(histogram)
    if len(histogram) <= 3:
        assert n == fewest


@pytest.mark.parametrize("seed", range(3))
def test_count_against_the_dual_bound(seed):
    rng = np.random.default_rng(seed)
    m = int(rng.choice([4, 12, 40]))
    histogram = {int(x): int(n) for x, n in zip(rng.integers(300, 2400, m), rng.integers(100, 5000, m))}
    plan, rest, program = packing.configurations(histogram, 4096)
    assert pieces_of(plan) + sum(rest.values()) == sum(histogram.values())
    assert pieces_of(plan) >= 0.9 * sum(histogram.values())
    _, n = packing.packing_plan(histogram)
    assert program.bound <= n + 1e-6
    assert n <= 1.04 * program.bound + len(histogram)  # the bound itself may lie below the optimum


def test_dual_bound_against_the_program_solved_by_enumeration():
    """Two lengths: the program over all configurations is small enough for a search on its dual's corners."""
    histogram, capacity = {3: 70, 5: 41}, 16
    configs = [(a, b) for a in range(6) for b in range(4) if 0 < 3 * a + 5 * b <= capacity]
    corners = []
    rows = [*configs, (1, 0), (0, 1)]
    rhs = [1.0] * len(configs) + [0.0, 0.0]
    for i in range(len(rows)):
        for j in range(i):
            m = np.array([rows[i], rows[j]], dtype=float)
            if abs(np.linalg.det(m)) > 1e-9:
                y = np.linalg.solve(m, [rhs[i], rhs[j]])
                if (y >= -1e-9).all() and all(np.dot(c, y) <= 1 + 1e-9 for c in configs):
                    corners.append(70 * y[0] + 41 * y[1])
    program = packing.Program(histogram, capacity)
    assert program.bound <= max(corners) + 1e-6
    assert max(corners) - 1e-6 <= program.value <= 1.02 * max(corners)


def test_documents(documents):
    rows = [(i, "some words here " * (i % 40)) for i in range(120)] + [(200, None), (201, ""), (202, "word " * 20_000), (5, "twice"), (5, "twice"), (None, "x"), (203, "日本 " * 10)]
    out = packing.pack(documents(rows), capacity=512).collect()
    by_doc = {}
    for i, t in rows:
        by_doc.setdefault(i, []).append(ids_of(t or "") + [1])
    want = sorted((str(i), s // 512, s, len(ids[s:s + 512]), zlib.crc32(np.array(ids[s:s + 512], dtype="<u4").tobytes())) for i, all_ids in by_doc.items() for ids in all_ids for s in range(0, len(ids), 512))
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    by_sequence = {}
    for r in out:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 512
    assert len(by_sequence) <= -(-sum(r["length"] for r in out) // 512) + 1


def test_empty(spark, documents, folder):
    assert packing.op4_configuration_packing(spark, folder(documents=documents([]))).count() == 0
