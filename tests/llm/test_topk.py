import math
import random

from pyspark.sql import functions as F

from lorelink.llm import topk

SCHEMA = "vec_id long, embedding array<float>, rank string, score string"


def brute(rows, k, query):
    vectors = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            vectors.setdefault(i, []).append([math.floor(256 * float(x)) for x in v])
    out = set()
    for q in vectors:
        if not query(q):
            continue
        best = sorted((-max(sum(a * b for a, b in zip(x, y)) for x in vectors[q] for y in vectors[c]), c) for c in vectors if c != q)[:k]
        out |= {(q, r + 1, c, -s) for r, (s, c) in enumerate(best)}
    return out


def run(spark, rows, k=5, **how):
    df = spark.createDataFrame([(i, v, "clash", "clash") for i, v in rows], SCHEMA).where(topk.finite(F.col("embedding")))
    got = topk.top_k(df.select("vec_id", topk.floor_weights(F.col("embedding")).alias("weights")), F.col("vec_id") % 50 == 0, k, **how)
    return {(r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()}


def test_against_brute_force(spark):
    rng = random.Random(1)
    vec = lambda n: [round(rng.uniform(-1, 1), 2) * (rng.random() < 0.7) for _ in range(n)]
    rows = [(i, vec(8)) for i in range(300)]
    rows += [(1000 + i, rows[50][1]) for i in range(150)]  # ties of very many equal vectors
    rows += [(7, vec(8)), (50, vec(8))]  # ids that repeat
    rows += [(None, vec(8)), (2000, None), (2050, [0.1, None]), (2100, [float("nan")]), (2150, [float("inf")] * 8), (2200, []), (2201, vec(3))]
    assert run(spark, rows, candidates_per_block=64, queries_per_block=4) == brute(rows, 5, lambda i: i % 50 == 0)
    assert run(spark, rows) == brute(rows, 5, lambda i: i % 50 == 0)


def test_small_tables(spark):
    assert run(spark, []) == set()
    assert run(spark, [(50, [1.0])]) == set()
    rows = [(50, [1.0, 2.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5])]
    assert run(spark, rows) == {(50, 1, 1, 98304), (50, 2, 2, 98304)}
    assert run(spark, [(1, [1.0]), (2, [1.0])]) == set()
