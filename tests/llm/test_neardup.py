import random
import re

import numpy as np

from lorelink.llm import neardup

SCHEMA = "doc_id long, text string, th string, unit string"


def shingles(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def near(a, b):
    return a == b or 10 * len(a & b) >= 8 * len(a | b) > 0


def kept(rows):
    """The ids that stand for components of all near pairs."""
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    sets = [shingles(t) for _, t in rows]
    for i, a in enumerate(sets):
        for j in range(i):
            if near(a, sets[j]):
                up[find(i)] = find(j)
    groups = {}
    for i, (k, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(k)
    return sorted((min((k for k in g if k is not None), default=None) for g in groups.values()), key=str)


def edited(rng, words, times):
    words = list(words)
    for _ in range(times):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return words


def docs_of():
    rng = random.Random(6)
    passage = [f"common{i}" for i in range(40)]
    rows = []
    for i in range(60):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.choice((8, 60, 200)))] + passage * (i % 2)
        rows.append((i, " ".join(words)))
        # about 90, 80 and 60 % of the shingles
        rows += [(100 * k + i, " ".join(edited(rng, words, max(1, len(words) * k // 100)))) for k in (1, 2, 5) if i % k == 0]
    base = [f"b{i}" for i in range(100)]
    rows += [(1000 + i, " ".join(edited(rng, base, 1))) for i in range(80)]
    chain = [f"c{i}" for i in range(100)]
    for i in range(12):
        chain = chain[4:] + [f"d{i}{k}" for k in range(4)]
        rows.append((2000 + i, " ".join(chain)))
    return rows + [(3000, None), (3001, ""), (3002, " \n\t "), (3003, "one"), (3004, "One"), (3005, "x" * 100_000), (3006, "ab " * 50_000)]


def test_against_all_pairs(spark):
    rows = docs_of()
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA).repartition(5)
    got = neardup.one_of_each(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id for r in got.collect()), key=str) == kept(rows)


def test_bound_of_differences():
    """Parities never differ in more places than the sets do, whatever their sizes."""
    rng = random.Random(4)
    for _ in range(300):
        both = [rng.getrandbits(64) for _ in range(rng.choice((0, 3, 70, 900)))]
        x, y = (np.unique(np.array(both + [rng.getrandbits(64) for _ in range(rng.choice((0, 1, 9, 300)))], np.uint64)) for _ in "xy")
        d = neardup.least_difference(neardup.parities(x), neardup.parities(y))
        assert d <= len(np.setxor1d(x, y)) and d == neardup.least_difference(neardup.parities(y), neardup.parities(x))
        if len(np.intersect1d(x, y)) >= 0.8 * len(np.union1d(x, y)):
            assert d <= neardup.most_difference(len(x), len(y), 0.8)


def test_repeated_rows_and_null_ids(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (3, "A b c d e f"), (3, "A b c d e f"), (4, "other words that stand alone here"), (4, "other words that stand alone here"), (None, None), (None, "")]
    df = spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA).repartition(4)
    assert sorted(((r.doc_id, r.text) for r in neardup.one_of_each(df).collect()), key=str)[:2] == [(3, "A b c d e f"), (4, "other words that stand alone here")]
    assert neardup.one_of_each(df).count() == 3


def test_pipeline_stage(spark):
    """An edited copy that differs in many bits goes; a text that shares only two thirds stays."""
    import corpus_pipeline

    rng = random.Random(3)
    base = [[f"{i}x{k}" for k in range(100)] for i in range(40)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    rows += [(100 + i, " ".join([*w[:97], "other", *w[98:]])) for i, w in enumerate(base)]
    rows += [(200 + i, " ".join(w[:80] + [f"y{rng.random()}" for _ in range(20)])) for i, w in enumerate(base)]
    df = spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA)
    assert sorted((r.doc_id for r in corpus_pipeline.distinct_documents(spark, df, "").collect()), key=str) == kept(rows)


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert neardup.one_of_each(empty).count() == 0


def test_tables_written(spark, monkeypatch):
    """Tables that are read once aren't written: each file that a task writes costs processes that the executor starts."""
    names, settled = [], neardup.settled
    monkeypatch.setattr(neardup, "settled", lambda df, what: names.append(what) or settled(df, what))
    df = spark.createDataFrame([(i, f"one two three four five six {i // 2}", "", "") for i in range(20)], SCHEMA)
    assert neardup.one_of_each(df).count() == 10
    assert {n: names.count(n) for n in names} == {"shingle-prefixes": 1, "shingle-sets": 1, "marked-blocks": 1, "distinct-fingerprints": 1, "likely-pairs": 2, "needed-sets": 2, "whole-sets": 2}
