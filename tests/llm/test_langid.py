import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lorelink.llm import langid
from lorelink.llm.common import learning_rows, table

SCHEMA = "doc_id long, text string, lang string, lang_pred string, score string"


def test_gradients():
    net = langid.ByteConvNet(["a", "b"], langid.Settings(window=16))
    rng = np.random.default_rng(0)
    x, y = rng.integers(32, 120, (4, 16 + net.reach - 1)).astype(np.uint8), np.array([0, 1, 1, 0])

    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}

    def loss():
        z = np.maximum(net._pooled(x)[1].max(axis=1) + net.p["b"], 0) @ net.p["o"] + net.p["c"]
        return -(z[np.arange(4), y] - np.log(np.exp(z).sum(1))).mean()

    g = net._gradients(x, y)
    for k in ("o", "w", "b"):
        i = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        old = net.p[k][i]
        net.p[k][i] = old + 1e-5
        up = loss()
        net.p[k][i] = old - 1e-5
        down = loss()
        net.p[k][i] = old
        assert abs((up - down) / 2e-5 - g[k][i]) < 1e-3


def test_windows_cover_texts():
    data, ends = langid._folded(pa.array(["a" * 600, "", "b" * 256]))
    rows, owner, size = langid.cut(data, ends, 256, 4)
    assert owner.tolist() == [0, 0, 0, 2] and size.tolist() == [256, 256, 88, 256]
    assert (rows[2][88:] == 0).all() and rows.shape[1] == 259


def test_held_out_accuracy(spark, sf):
    docs = table(spark, sf, "documents", "doc_id", "text", "lang")
    learn = learning_rows(F.col("doc_id"), 3, 1)
    net = langid.train(docs.where(learn))
    got = langid.predict(docs.where(~learn), net, ["doc_id", "lang"]).toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.95
    assert got.score.between(0, 1).all()


def test_edges(spark):
    text = {"x": "the and of is that was with are ", "y": "der die und nicht von zu das mit "}
    rows = [(i, text["xy"[i % 2]] * 5, "xy"[i % 2], "clash", "clash") for i in range(40)]
    rows += [(100, None, "x", None, None), (101, "", "y", None, None), (102, "123 !?", None, None, None), (None, text["x"], "x", None, None), (103, text["y"] * 20_000, None, None, None), (0, rows[0][1], "x", "clash", "clash")]
    docs = spark.createDataFrame(rows, SCHEMA)
    net = langid.train(docs)
    got = {(r.doc_id, r.lang_pred, r.score > 0.5) for r in langid.predict(docs, net, ["doc_id"]).collect()}
    assert {(100, "und", False), (101, "und", False), (102, "und", False), (None, "x", True), (103, "y", True), (0, "x", True)} <= got
    assert langid.predict(docs, net, ["doc_id"]).count() == len(rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert langid.train(docs) is None
    assert langid.predict(docs, None, ["doc_id"]).count() == 0
    other = spark.createDataFrame([(1, "abc", "x", None, None)], SCHEMA)
    assert langid.predict(other, None, ["doc_id"]).first().lang_pred == "und"
