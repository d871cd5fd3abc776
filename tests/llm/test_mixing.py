import re

import pytest

from glintframe.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets_by_rounds(sizes, weights=(1, 2, 3), most=3):
    """Share by weight, stop what is above its cap, share the rest again."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, out, free = float(sum(sizes.values())), {}, set(order)
    while free:
        rest = total - sum(out.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return out | share
        out |= {s: float(most * sizes[s]) for s in over}
        free -= over
    return out


@pytest.fixture
def rows():
    text = lambda i: " ".join(["w"] * (1 + i * 37 % 60)) + " x\x1cy \t\n"  # noqa: E731  no-break space and \x1c do not part words
    out = [(i, text(i), f"s{i % 5}") for i in range(400)]
    out += [(500, None, "s1"), (501, "", "s1"), (502, "  \t", None), (503, "a b c", None), (504, "a", ""), (505, None, "none"), (None, "a b", "s2"), (7, text(7), "s2"), (7, text(7), "s2"), (600, "long " * 30_000, "s3")]
    return out


def test_mix(documents, rows):
    df = documents(rows)
    out = mixing.mix(df, bucket_rows=40).collect()
    assert len(out) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    want = targets_by_rounds(sizes)
    taken, largest = {}, {}
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"] and r["taken"] >= 0
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        largest[r["source"]] = max(largest.get(r["source"], 0), r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(0.02 * want[s], 4, largest[s] if s == "s3" else 0)
    again = mixing.mix(df.repartition(5), bucket_rows=40).collect()
    key = lambda r: (str(r["doc_id"]), str(r["source"]), r["size"], r["copies"])
    assert sorted(map(key, out)) == sorted(map(key, again))


def test_rates_solve_the_dual(documents):
    out = mixing.mix(documents([(i, "w " * (1 + i % 50), "ab"[i % 3 > 0]) for i in range(600)])).collect()
    for s in "ab":
        own = [r for r in out if r["source"] == s]
        assert sum(r["rate"] * r["size"] for r in own) == pytest.approx(own[0]["target"], rel=1e-4)


def test_targets_stop_at_three_times(documents):
    rows = [(0, "w " * 10, "a"), (1, "w " * 1000, "b"), (2, "w " * 10, "c")]
    got = {r["source"]: r["target"] for r in mixing.mix(documents(rows)).collect()}
    assert got == pytest.approx(targets_by_rounds({"a": 10, "b": 1000, "c": 10})) and got["a"] == 30.0


def test_no_words_and_no_rows(spark, documents, folder):
    assert [r["taken"] for r in mixing.mix(documents([(1, None, None), (2, "", "a")])).collect()] == [0, 0]
    assert mixing.op9_entropy_balancing(spark, folder(documents=documents([]))).count() == 0


def test_stage_repeats_documents(spark, documents, rows):
    df = documents(rows)
    plan = mixing.mix(df)
    want = sum(r["copies"] for r in plan.collect())
    out = mixing.mixed_documents(spark, df, "")
    assert out.columns == df.columns and out.count() == want
    copies = {}
    for r in out.collect():
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    for r in plan.groupBy("doc_id").sum("copies").collect():
        assert copies.get(r["doc_id"], 0) == r["sum(copies)"]
