import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lorelink.llm import pii


@pytest.fixture(scope="module")
def sf(sf):
    """Enough labels to learn from."""
    return sf.replace("sf0.001", "sf0.01")


@pytest.fixture(scope="module")
def kept(spark, sf):
    """Each stage's result by name, the tables first."""
    out = {"documents": spark.read.parquet(f"{sf}/documents.parquet")}
    docs = out["documents"]
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = stage(spark, docs, sf).cache()
        docs.count()
    return out


def test_stages(kept):
    names = [n for n, _ in corpus_pipeline.STAGES]
    columns = kept["documents"].columns
    assert all(kept[n].columns == columns for n in names[:-1])
    ids = lambda n: {r.doc_id for r in kept[n].select("doc_id").collect()}
    good, distinct, mixed, packed = (ids(names[i]) for i in (0, 1, 3, 4))
    assert distinct < good < ids("documents") and ids(names[2]) == distinct and mixed <= distinct and packed == mixed
    assert kept[names[1]].count() == len(distinct)


def test_rejected_documents_are_those_labelled_bad(kept, spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    left = kept[corpus_pipeline.STAGES[0][0]].join(labels, "doc_id")
    assert left.where("quality = 1").count() >= 0.98 * labels.where("quality = 1").count()
    assert left.where("quality = 0").count() <= 0.1 * labels.where("quality = 0").count()


def test_no_personal_data_is_left(kept):
    for r in kept[corpus_pipeline.STAGES[2][0]].collect():
        assert not pii.base_spans(r.text) and (r.n_chars == len(r.text) or "[" not in r.text)


def test_copies_follow_the_mix(kept):
    before, after = kept[corpus_pipeline.STAGES[2][0]], kept[corpus_pipeline.STAGES[3][0]]
    times = after.groupBy("doc_id", "text").count()
    assert times.agg(F.max("count")).first()[0] <= 2
    assert times.join(before.select("doc_id", "text"), ["doc_id", "text"], "left_anti").count() == 0
    words = lambda df: sum(len(re.findall(r"\S+", r.text)) for r in df.select("text").collect())
    assert abs(words(after) / words(before) - 1.5) < 0.05


def test_sequences(kept):
    pieces = kept[corpus_pipeline.STAGES[4][0]]
    full = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert full.where("n <> end OR n > 2048").count() == 0


def test_registered():
    assert {"pipeline", *(f"op{n}_" for n in range(1, 11))} <= {re.sub(r"^(op\d+_).*", r"\1", q) for q in __spark_entry__.queries()}
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_empty_tables(spark, sf, tmp_path):
    import shutil

    for name in ("documents", "labels"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    shutil.rmtree(tmp_path)
