"""Page views: sums over the days before a day, and trends between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days of each span.
SPANS = {"DAY": 1, "WEEK": 7, "4WEEK": 28, "YEAR": 365}


def daily(views_json: DataFrame) -> DataFrame:
    """lang, title, day, views of rows with a month's answer in JSON (daily_views: date to number)."""
    parsed = F.from_json("answer", "struct<daily_views:map<string,bigint>>")["daily_views"]
    return views_json.select("lang", "title", F.explode(parsed).alias("d", "views")).select("lang", "title", F.try_to_date("d").alias("day"), "views").where("day IS NOT NULL")


def _trend(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def trailing_views(views: DataFrame) -> DataFrame:
    """lang, title, day and the views of the 1, 7, 28 and 365 days before it, 0 without any: for each day with a row."""
    number = F.unix_date("day")
    line = Window.partitionBy("lang", "title").orderBy(number)
    return views.select("lang", "title", "day", *[F.coalesce(F.sum("views").over(line.rangeBetween(-d, -1)), F.lit(0)).alias(f"WIKISTATS{k}") for k, d in SPANS.items()])


def views_before(views: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (lang, title, day) with the sums before its day, whether that day has views or not."""
    past = views.select(F.col("lang").alias("_lang"), F.col("title").alias("_title"), F.col("day").alias("_day"), "views")
    ago = F.datediff("day", "_day")
    same = (F.col("lang") == F.col("_lang")) & (F.col("title") == F.col("_title")) & ago.between(1, max(SPANS.values()))
    near = asked.select("lang", "title", "day").distinct().join(past, same, "left")
    return near.groupBy("lang", "title", "day").agg(*[F.coalesce(F.sum(F.when((ago >= 1) & (ago <= d), F.col("views"))), F.lit(0)).alias(f"WIKISTATS{k}") for k, d in SPANS.items()])


def with_trends(sums: DataFrame) -> DataFrame:
    """The day's number gives way to trends: day by week, week by four weeks, four weeks by year."""
    day, week, four, year = (F.col(f"WIKISTATS{k}") for k in SPANS)
    return sums.withColumns({"WIKISTATSTRENDDAY": _trend(day, week), "WIKISTATSTRENDWEEK": _trend(week, four), "WIKISTATSTREND4WEEK": _trend(four, year)}).drop("WIKISTATSDAY")


def with_page_views(links: DataFrame, views: DataFrame, epoch: int | None = None) -> DataFrame:
    """links with view features as of the day of `epoch` seconds, or of today."""
    now = F.to_date(F.timestamp_seconds(F.lit(epoch))) if epoch is not None else F.current_date()
    asked = links.select("lang", "title").distinct().withColumn("day", now)
    return links.join(with_trends(views_before(views, asked)).drop("day"), ["lang", "title"], "left")
