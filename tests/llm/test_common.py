import pytest
from pyspark.sql import functions as F

from lorelink.llm import common


class Conf:
    def get(self, key, default=None):
        return default


class Session:
    """A session without spark.checkpoint.dir."""

    def __init__(self, master):
        self.conf = Conf()
        self.sparkContext = type("Context", (), {"master": master, "applicationId": f"app-{master}", "getConf": lambda self: Conf()})()


def test_own_folder_only_where_driver_and_executors_share_one():
    own = common.shared_dir(Session("local[2]"))
    assert own.startswith("file:///") and own == common.shared_dir(Session("local[2]"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session("yarn"))


def test_samples_are_bounded_and_the_same_again(spark):
    df = spark.range(20_000).select("id", F.when(F.col("id") % 10 == 0, "rare").otherwise("often").alias("k"))
    first = {r.id for r in common.spread_sample(df, "k", "id", 200, 1).collect()}
    assert first == {r.id for r in common.spread_sample(df.repartition(7), "k", "id", 200, 1).collect()}
    assert 120 < sum(i % 10 == 0 for i in first) < 280 and len(first) < 800
    same = spark.range(5000).select(F.lit(1).alias("id"), F.lit("x").alias("k"))
    assert common.spread_sample(same, "k", "id", 100, 1).count() <= 200
    assert common.spread_sample(df.limit(0), "k", "id", 100, 1).count() == 0
