import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lorelink.llm import quality
from lorelink.llm.common import learning_rows, table, utf8

SCHEMA = "doc_id long, text string, score string, predicted string"


def test_lines_of_texts():
    texts = ["one line", "", "a\nb\n", "\n\n", "x\nthe the the\nx"]
    f, size, first = quality.line_features(*utf8(pa.array(texts)))
    assert np.diff(first).tolist() == [1, 1, 3, 3, 3] and size.tolist() == [8, 0, 1, 1, 0, 0, 0, 0, 1, 11, 1]
    repeats, twins = f[:, quality.KINDS + 1], f[:, quality.KINDS + 2]
    assert repeats[9] > 0.6 and twins[[8, 10]].tolist() == [1, 1] and twins[9] == 0
    w = np.random.default_rng(0).normal(0, 1, quality.FEATURES)
    assert np.allclose(quality.emission_scores(*utf8(pa.array(texts)), w)[0], f @ w, atol=1e-4)
    # a text's features don't depend on the texts beside it
    for k, t in enumerate(texts):
        assert np.allclose(quality.line_features(*utf8(pa.array([t])))[0], f[first[k] : first[k + 1]], atol=1e-6)


def test_marginals_are_sums_over_all_labellings():
    rng = np.random.default_rng(1)
    field = quality.LineField()
    field.w, field.t = rng.normal(0, 1, quality.FEATURES), rng.normal(0, 1, (2, 2))
    x = rng.normal(0, 0.3, (6, quality.FEATURES)).astype(np.float32)
    first = np.array([0, 4, 5, 6])
    z = (x @ field.w.astype(np.float32)).astype(float)
    p, pairs = field.marginals(z, first, parts=True)
    total = np.zeros((2, 2))
    for a, b in zip(first, first[1:]):
        weight, good, seen = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=b - a):
            s = np.exp(sum(z[a + i] * v for i, v in enumerate(y)) + sum(field.t[u, v] for u, v in zip(y, y[1:])))
            weight += s
            good += s * np.array(y)
            for u, v in zip(y, y[1:]):
                seen[u, v] += s
        assert np.allclose(p[a:b], good / weight, atol=1e-5)
        total += seen / weight
    assert np.allclose(pairs, total, atol=1e-5)


def test_held_out_accuracy(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    docs, labels = table(spark, sf, "documents", "doc_id", "text"), table(spark, sf, "labels", "doc_id", "quality")
    learn = learning_rows(F.col("doc_id"), 5, 0)
    field = quality.train(docs, labels.where(learn))
    got = quality.score_quality(docs, field, ["doc_id"]).join(labels.where(~learn), "doc_id").toPandas()
    assert (got.predicted == got.quality).mean() > 0.95
    assert got[got.quality == 1].score.mean() > got[got.quality == 0].score.mean() + 0.5


def rows():
    out = [(i, ("the cat sat on the mat and it was good.\n" * 3) if i % 2 else "BUY!! NOW!! $$$ ###\n" * 4, "clash", "clash") for i in range(80)]
    return [*out, (100, None, None, None), (101, "", None, None), (102, "good words here\n" * 30_000, None, None), (None, "CHEAP!! $$$", None, None), (1, out[1][1], "clash", "clash")]


def test_edges(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(3, 1), (None, 0), (61, None), (9999, 1)], "doc_id long, quality int")
    field = quality.train(docs, labels, quality.Settings(steps=60))
    got = quality.score_quality(docs, field, ["doc_id"]).collect()
    assert len(got) == len(rows()) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.predicted == r.doc_id % 2 for r in got if r.doc_id is not None and r.doc_id < 80)
    kept = quality.keep_good(docs, field)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} >= {i for i in range(80) if i % 2}
    assert kept.count() == sum(r.predicted for r in got)
    assert quality.score_quality(docs.limit(0), field, ["doc_id"]).count() == 0
    assert quality.keep_good(docs.limit(0), field).count() == 0


def test_without_labels(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.train(docs, none) is None
    assert {r.score for r in quality.score_quality(docs, None, ["doc_id"]).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (3, 1)], "doc_id long, quality int")
    assert all(r.predicted == 1 for r in quality.score_quality(docs, quality.train(docs, one, quality.Settings(steps=10)), ["doc_id"]).collect())
