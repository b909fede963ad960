import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorelink.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, target string"


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(0, 4), min_size=1, max_size=7), st.integers(0, 120))
def test_knapsack_is_the_best(counts, budget):
    sizes, n = np.array(list(counts)), np.array(list(counts.values()))
    took = mixing.knapsack(sizes, n, budget)
    sums = {0}
    for s, c in counts.items():
        sums = {x + s * k for x in sums for k in range(c + 1) if x + s * k <= budget}
    assert (took <= n).all() and (took * sizes).sum() == max(sums)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(0, 300), st.integers(1, 50), min_size=1, max_size=30), st.floats(0, 1))
def test_budget_is_met(counts, share):
    sizes, n = np.array(list(counts)), np.array(list(counts.values()))
    budget = int((sizes * n).sum() * share)
    took = mixing.fit_budget(sizes, n, budget, window=256)
    assert (took >= 0).all() and (took <= n).all()
    assert 0 <= budget - (took * sizes).sum() <= sizes.max()


def test_few_very_long_texts():
    fit = lambda sizes, counts, budget: int((mixing.fit_budget(np.array(sizes), np.array(counts), budget) * sizes).sum())
    assert fit([90_000], [3], 100_000) == 90_000
    assert fit([70_000, 300_000], [1, 2], 350_000) == 300_000
    assert fit([200_000, 3_000_000], [1, 1], 3_100_000) == 3_000_000


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(17, 300), st.integers(1, 3), min_size=1, max_size=6), st.floats(0, 1))
def test_no_text_that_fits_is_left(counts, share):
    """Sizes above 4 * window: whatever is still there is longer than what is left of the budget."""
    sizes, n = np.array(list(counts)), np.array(list(counts.values()))
    budget = int((sizes * n).sum() * share)
    took = mixing.fit_budget(sizes, n, budget, window=4)
    rest = budget - int((took * sizes).sum())
    assert (took >= 0).all() and (took <= n).all() and rest >= 0
    assert not (sizes[took < n] <= rest).any()


def goals(size):
    names = sorted((s for s in size if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in size)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, free, out = 1.5 * sum(size.values()), set(names), {}
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > 2 * size[s]]
        if not over:
            out |= {s: left * weight[s] / total for s in free}
            break
        for s in over:
            out[s] = 2 * size[s]
            left -= out[s]
            free.discard(s)
    return out


def check(rows, got, keys=("doc_id",)):
    size = Counter()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    for _, t, s in rows:
        size[s] += words(t)
    want = goals(size)
    taken = Counter()
    for r in got:
        assert r.source_size == size[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, r.target)
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
    for s in size:
        assert abs(taken[s] - want[s]) <= 1 + max((words(t) for _, t, x in rows if x == s), default=0) / 2
    assert len(got) == len(rows)


def rows_of():
    rows = [(i, "w " * (i * 7 % 90 + 1), ("a", "b", "c", None, "", "é")[i % 6]) for i in range(600)]
    rows += [(1000 + i, "the same text", "hot") for i in range(700)]
    return rows + [(5000, None, "a"), (5001, "", "empty"), (5002, "v " * 5000, "b"), (None, "no id", "c"), (1, rows[1][1], rows[1][2])]


def test_against_plain_targets(spark):
    rows = rows_of()
    docs = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    sized = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("n"))
    first = mixing.mix(sized, ["doc_id"], size="n").collect()
    check(rows, first)
    again = mixing.mix(sized.repartition(7), ["doc_id"], size="n").collect()
    assert Counter(map(tuple, first)) == Counter(map(tuple, again))
    copies = mixing.mixed(docs)
    assert copies.columns == docs.columns
    took = Counter(r.doc_id for r in copies.collect())
    want = Counter()
    for r in first:
        if r.size:
            want[r.doc_id] += r.taken // r.size
    assert took == +want


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(docs.select("doc_id", "source", F.lit(1).alias("size")), ["doc_id"]).count() == 0
    assert mixing.mixed(docs).count() == 0
    nothing = spark.createDataFrame([(1, None, "a", None, None), (2, "", "b", None, None)], SCHEMA)
    assert [r.taken for r in mixing.mix(nothing.select("doc_id", "source", F.lit(0).alias("size")), ["doc_id"]).collect()] == [0, 0]
