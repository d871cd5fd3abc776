import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from glintframe.llm import tokencount

PATH = public_tokenizers.path(tokencount.MODEL)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


def want(texts):
    return [len(LIBRARY.encode(t)) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abcdethinors ▁..<>/-0123é日\n\t=_\U0001f600\x00"), max_size=80), max_size=4))
def test_counts_equal_library(texts):
    assert tokencount.compiled(PATH).count(texts).tolist() == want(texts)


HARD = ["", " ", "  a", "a  b ", "\n", "<s>x</s><unk><0x0A>", "▁x ▁▁ y", "a" * 5000, "hello" * 999, "the cat " * 3000, "日本語" * 900, "\n\n\n a\n" * 500, "  " * 700]


def test_hard_texts():
    assert tokencount.compiled(PATH).count(HARD).tolist() == want(HARD)


@pytest.mark.parametrize("chunk", [1, 7, 100_000])
def test_chunks_do_not_matter(monkeypatch, chunk):
    monkeypatch.setattr(tokencount, "CHUNK", chunk)
    texts = [t[:400] for t in HARD] if chunk == 1 else HARD
    assert tokencount.compiled(PATH).count(texts).tolist() == want(texts)


@pytest.mark.parametrize("ahead", [1, 128])
def test_long_texts_without_resets(monkeypatch, ahead):
    """Chunks whose first state is wrong run again from the right one; periodic texts keep their phase."""
    monkeypatch.setattr(tokencount, "CHUNK", 64)
    monkeypatch.setattr(tokencount, "AHEAD", ahead)
    rng = random.Random(4)
    texts = ["".join(rng.choice("etaoinshrdlu") for _ in range(6000)), "a" * 3001, "ab" * 2000, "-" * 3000, "=" * 1000 + "x" + "=" * 1000, "ing" * 1500, "x" * 500 + " " + "y" * 900]
    assert tokencount.compiled(PATH).count(texts).tolist() == want(texts)


def test_composition_adds_up_along_paths():
    following = np.array([1, 2, -1, 4, -2, 1, 5])
    tokens = np.array([3, 5, 7, 11, 13, 17, 19])
    node, total = tokencount.Transducer.composed(following, tokens)
    assert node.tolist() == [2, 2, 2, 4, 4, 2, 2] and total.tolist() == [15, 12, 7, 24, 13, 29, 48]


def test_a_run_without_blanks_spreads_over_lanes():
    """Steps of the table, not characters, take the time: few more than a chunk's length each round."""
    rng = random.Random(5)
    text = "".join(rng.choice("etaoinshrdlu") for _ in range(200_000))
    t = tokencount.compiled(PATH)
    lanes = []
    run = t.run
    t.run = lambda symbols, first, length, state: (lanes.append((int(length.max()) if len(length) else 0)), run(symbols, first, length, state))[1]
    try:
        n = t.count([text])
    finally:
        del t.run
    assert n.tolist() == want([text]) and sum(lanes) <= 12 * tokencount.CHUNK


def test_table_overflow_halves_and_counts_sections():
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcdefghij ") for _ in range(400)) for _ in range(40)]
    t = tokencount.Transducer(PATH, table=1024 * 128)
    assert t.count(texts).tolist() == want(texts) and t.next.size <= 1024 * 128
    long = ["".join(rng.choice(alphabet) for _ in range(6000)) for alphabet in ("abcdefghij ", "abcdefghijklmnop")]
    assert t.count(long).tolist() == want(long) and t.next.size <= 1024 * 128


def test_pairs_decide_tokenization():
    t = tokencount.compiled(PATH)
    rng = random.Random(2)
    ids = [i for i in t.text if t.text[i].isalpha()]
    for _ in range(300):
        a, b = rng.choice(ids), rng.choice(ids)
        whole = LIBRARY.encode(t.text[a] + t.text[b], out_type=str)
        if whole[0] == "▁":  # the added mark stayed alone, so what follows is the pair's own tokenization
            assert t.stays(a, b) == (whole[1:] == [t.text[a], t.text[b]])


def test_documents(spark, documents, folder):
    rows = [(i, t) for i, t in enumerate(HARD)] + [(100, None), (7, "again"), (7, "again"), (None, "x")]
    out = tokencount.op3_transducer_token_counts(spark, folder(documents=documents(rows))).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in out) == sorted(
        (str(i), len((t or "").encode()), n, n > 4096) for (i, t), n in zip(rows, want([t or "" for _, t in rows])))


def test_empty(spark, documents, folder):
    assert tokencount.op3_transducer_token_counts(spark, folder(documents=documents([]))).count() == 0
    assert tokencount.compiled(PATH).count([]).tolist() == [] and np.array_equal(tokencount.compiled(PATH).count([""]), [0])
