import math
import random
from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from lorelink.llm import nndescent as nn

SCHEMA = "vec_id long, embedding array<float>, pid string, score string"
SMALL = nn.Settings(neighbours=12, window=32, ef=48, step=16, ranked=24, entries=8)


def brute(rows, k, query):
    """query_id -> [(score, id)] in order, all candidates of distinct ids."""
    vectors = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            vectors.setdefault(i, []).append(np.array(v + [0.0] * (8 - len(v)), np.float32).astype(float))
    cos = lambda a, b: float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)))
    return {q: sorted((-round(max(cos(a, b) for a in vectors[q] for b in vectors[c]), 12), c) for c in vectors if c != q)[:k] for q in vectors if query(q)}


def run(spark, rows, k=5, settings=SMALL):
    df = spark.createDataFrame([(i, v, "clash", "clash") for i, v in rows], SCHEMA)
    out = {}
    for r in nn.nearest(df, F.col("vec_id") % 50 == 0, k, settings=settings).collect():
        out.setdefault(r.query_id, []).append((r["rank"], -round(r.score, 12), r.vec_id))
    for q in out:
        out[q].sort()
        assert [x[0] for x in out[q]] == list(range(1, len(out[q]) + 1))
    return {q: [x[1:] for x in v] for q, v in out.items()}


def test_recall_and_scores(spark):
    rng = random.Random(1)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    vec = lambda: [x + rng.gauss(0, 0.7) for x in rng.choice(centres)]
    rows = [(i, vec()) for i in range(1500)]
    rows += [(5000 + i, rows[100][1]) for i in range(200)]  # very many equal vectors, of a query
    rows += [(6000 + i, rows[7][1]) for i in range(60)]  # and of another, queries among them
    rows += [rows[3], (7, vec()), (50, vec()), (None, vec()), (8000, None), (8050, [0.1, None]), (8100, [float("nan")] * 8), (8150, [float("inf")] * 8), (8200, []), (8250, [0.0] * 8), (8300, [1.0, -0.5, 0.25])]
    got, want = run(spark, rows), brute(rows, 5, lambda i: i % 50 == 0)
    assert set(got) == set(want)
    assert all(len(v) == 5 and len({c for _, c in v}) == 5 for v in got.values())
    truth = brute(rows, 10_000, lambda i: i % 50 == 0)
    assert all(set(v) <= set(truth[q]) for q, v in got.items()), "scores are the measure itself"
    assert all(v == sorted(v) for v in got.values())
    hits = sum(len(set(got[q]) & set(want[q])) for q in want)
    assert hits >= 0.97 * sum(map(len, want.values()))
    assert got[100] == want[100] and got[6000] == want[6000]


def test_queries_outside_the_graph(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(800, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    points, width = nn.points_of(df, "embedding", "vec_id", 1)
    graph = nn.build_graph(points, width, SMALL)
    asked = rng.normal(size=(40, 8))
    queries = spark.createDataFrame([(i, bytearray(nn.codes(v[None, :])[0].tobytes()), None) for i, v in enumerate(asked)], "q long, code binary, start long")
    ids = {r.pid: r.ids[0] for r in points.select("pid", "ids").collect()}
    found = {r.q: [ids[p] for p in r.n] for r in nn.search(queries, points, graph, width, SMALL).collect()}
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    hits = sum(len(set(np.argsort(-(unit @ v))[:5].tolist()) & set(found[i])) for i, v in enumerate(asked))
    assert hits >= 0.95 * 200


def test_rounds_bring_neighbours(spark):
    """Joins of neighbours of neighbours find what the projections' windows don't."""
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(1200, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    points, width = nn.points_of(df, "embedding", "vec_id", 1)
    ids = {r.pid: r.ids[0] for r in points.select("pid", "ids").collect()}
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = np.argsort(-(unit @ unit.T), axis=1)[:, 1:6]

    def recall(settings):
        rows = nn.build_graph(points, width, settings).select("pid", "n").collect()
        return sum(len({ids[p] for p in r.n[:5]} & set(near[ids[r.pid]].tolist())) for r in rows) / (5 * len(rows))

    few = replace(SMALL, projections=2, neighbours=20)  # the windows of one would be islands
    before, after = recall(replace(few, rounds=0)), recall(few)
    assert before < 0.5 and after > 0.85


def test_small_tables(spark):
    assert run(spark, []) == {}
    assert run(spark, [(50, [1.0])]) == {}
    assert run(spark, [(50, None), (1, [0.0])]) == {}
    rows = [(50, [1.0, 2.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (100, [3e38, 3e38]), (3, [1e-40, 0.0])]
    assert run(spark, rows) == {q: v for q, v in brute(rows, 5, lambda i: i % 50 == 0).items()}
    same = [(i, [1.0, 1.0]) for i in range(0, 60, 10)]
    assert run(spark, same, 3) == {q: [(-1.0, c) for c in range(0, 60, 10) if c != q][:3] for q in (0, 50)}


def test_best_lists():
    owner, other = np.array([5, 5, 5, 2, 2, 5]), np.array([1, 2, 1, 2, 9, 3])
    score = np.array([0.5, 0.7, 0.5, 1.0, 0.1, 0.7])
    assert nn.best_lists(owner, other, score, 2).tolist() == [4, 1, 5]
