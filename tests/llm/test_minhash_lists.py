"""Operator 4: comparing the members of lists, in blocks of any size, against all pairs."""

import random

import numpy as np
import pytest

from quire.llm import minhash


def copies(rng, n_groups=6, each=9):
    rows = []
    for g in range(n_groups):
        base = ["g%dw%d" % (g, rng.randrange(500)) for _ in range(120)]
        for _ in range(each):
            base = list(base)  # a chain: ends may be linked only through the middle
            for _ in range(rng.randint(1, 6)):
                base[rng.randrange(len(base))] = "x%d" % rng.randrange(10 ** 6)
            rows.append(" ".join(base))
    rng.shuffle(rows)
    return list(enumerate(rows))


def plain_components(rows, size, percent):
    sets = [set(minhash.shingle_set(t, size).tolist()) for _, t in rows]
    low = list(range(len(rows)))
    links = [(i, j) for i in range(len(rows)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]) and sets[i]]
    for _ in rows:
        for i, j in links:
            low[i] = low[j] = min(low[i], low[j])
    return {rows[i][0]: rows[low[i]][0] for i in range(len(rows))}


def test_pairs_within_units():
    rng = np.random.default_rng(1)
    units = np.sort(rng.integers(0, 12, 60))
    tags, sizes = rng.integers(0, 3, (60, minhash.COORDS)).astype("uint8"), rng.integers(80, 110, 60)
    tags[10:20] = tags[10]
    i, j = minhash.agreeing_within(units, tags, sizes, 80)
    want = {(a, b) for a in range(60) for b in range(a + 1, 60) if units[a] == units[b]
            and 100 * min(sizes[a], sizes[b]) >= 80 * max(sizes[a], sizes[b]) and (tags[a] == tags[b]).sum() >= minhash.MATCHES}
    assert set(zip(i.tolist(), j.tolist())) == want and len(i) == len(want)


@pytest.mark.parametrize("block", [512, 3])
def test_components_equal_all_pairs_in_blocks_of_any_size(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = copies(random.Random(block))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=5, percent=80).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == plain_components(rows, 5, 80)


def test_lists_decide(spark, monkeypatch):
    """Without the lists' agreement nothing but equal sets is linked."""
    rows = copies(random.Random(9), 2, 4)
    monkeypatch.setattr(minhash, "postings", lambda reps: spark.createDataFrame([], "token long, doc_id long"))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=5).collect()
    assert all(r["component_id"] == r["doc_id"] for r in got)
