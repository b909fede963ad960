"""What links know of their articles: links in and out with relatedness, labels, categories, definitions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import relatedness_of_counts
from ..kb import KB
from .build import grouped


def _ends(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """lang, page_id, target_id, na, nb, light, heavy: the two articles' numbers of links, and which has fewer; a pair of which one has none has no row."""
    both = pairs.join(sizes.withColumnRenamed("n", "na"), ["lang", "page_id"]).join(sizes.select("lang", F.col("page_id").alias("target_id"), F.col("n").alias("nb")), ["lang", "target_id"])
    less = F.col("na") <= F.col("nb")
    return both.select("lang", "page_id", "target_id", "na", "nb", F.when(less, F.col("page_id")).otherwise(F.col("target_id")).alias("light"), F.when(less, F.col("target_id")).otherwise(F.col("page_id")).alias("heavy"))


def wedges(pairs: DataFrame, edges: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """lang, page_id, target_id, na, nb, heavy, third: for each pair the links of whichever of the two has fewer, to be looked up at the other one.

    pairs: lang, page_id, target_id, edges the same, both distinct. na and nb are their numbers of links (sizes, if edges are
    but some of them); a pair of which one has none has no row. So a pair costs no more rows than its smaller set has.
    """
    sizes = sizes if sizes is not None else edges.groupBy("lang", "page_id").agg(F.count("*").alias("n"))
    return _ends(pairs, sizes).join(edges.select("lang", F.col("page_id").alias("light"), F.col("target_id").alias("third")), ["lang", "light"]).drop("light")


#: Links of an article that are one row, about: larger sets are dealt by hash over slices, whose number is a power of two.
SLICE = 1024


def _slices(n: Column) -> Column:
    return F.when(n <= SLICE, F.lit(1)).otherwise(F.pow(F.lit(2.0), F.ceil(F.log2(n / SLICE))).cast("int"))


def _slice(number: Column, n: Column) -> Column:
    return F.when(n <= SLICE, F.lit(0)).otherwise(F.pmod(F.hash(number), _slices(n)))


def shared_numbers(pairs: DataFrame, edges: DataFrame, sizes: DataFrame) -> DataFrame:
    """lang, page_id, target_id, na, nb, common: how many links (edges: lang, page_id, number) both of a pair have, in one row or more; none if they share none.

    The slices of the smaller set are sent to those of the larger one as arrays: 4 bytes a link instead of a row. A slice of the
    smaller set belongs to one or more of the larger one's, which has as many slices or more, and is cut up by these.
    """
    sized = edges.join(sizes, ["lang", "page_id"])
    sets = sized.groupBy("lang", "page_id", "n", _slice(F.col("number"), F.col("n")).alias("slice")).agg(F.collect_list("number").alias("numbers"))
    light = sets.select("lang", F.col("page_id").alias("light"), F.col("numbers").alias("_n"), F.col("slice").alias("_s"))
    sent = _ends(pairs, sizes).join(light, ["lang", "light"])
    most = F.greatest("na", "nb")
    place = lambda x: _slice(x, most)
    part = lambda s: F.struct(s.alias("slice"), F.filter("_n", lambda x: place(x) == s).alias("asked"))
    whole = F.array(F.struct(F.col("_s").alias("slice"), F.col("_n").alias("asked")))
    parts = F.when(_slices(F.least("na", "nb")) == _slices(most), whole).otherwise(F.transform(F.array_distinct(F.transform("_n", place)), part))
    asked = sent.select("lang", "page_id", "target_id", "na", "nb", "heavy", F.inline(parts))
    met = asked.join(sets.select("lang", F.col("page_id").alias("heavy"), "slice", "numbers"), ["lang", "heavy", "slice"])
    return met.select("lang", "page_id", "target_id", "na", "nb", F.size(F.array_intersect("asked", "numbers")).alias("common")).where("common > 0")


def relatedness_of_pairs(pairs: DataFrame, edges: DataFrame, kb: KB, settle: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """lang, page_id, target_id, relatedness (0 included) of distinct pairs of articles, by their sets of links in `edges`, which are distinct.

    Links that two articles share are counted by joins, from the side that has fewer: those to ids that are whole numbers as
    arrays of them (shared_numbers()), others, which a settled table may be seen to lack, a row each (wedges()).
    """
    sizes = edges.groupBy("lang", "page_id").agg(F.count("*").alias("n"))
    number = F.col("target_id").try_cast("int")
    plain = F.coalesce(number.cast("string") == F.col("target_id"), F.lit(False))
    shared = shared_numbers(pairs, edges.where(plain).select("lang", "page_id", number.alias("number")), sizes)
    others = edges.where(~plain)
    if settle is None or not others.isEmpty():
        rows = wedges(pairs, others, sizes).join(others.select("lang", F.col("page_id").alias("heavy"), F.col("target_id").alias("third")), ["lang", "heavy", "third"])
        shared = shared.unionByName(rows.select("lang", "page_id", "target_id", "na", "nb", F.lit(1).alias("common")))
    counted = shared.groupBy("lang", "page_id", "target_id").agg(F.sum("common").alias("_common"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    valued = counted.join(F.broadcast(kb.articles()), "lang").select("lang", "page_id", "target_id", relatedness_of_counts("_common", "na", "nb", F.col("articles")).alias("relatedness"))  # a row for each language
    return pairs.join(valued, ["lang", "page_id", "target_id"], "left").select("lang", "page_id", "target_id", F.coalesce("relatedness", F.lit(0.0)).alias("relatedness"))


def neighbours(pages: DataFrame, kb: KB, side: str, related: bool = True) -> DataFrame:
    """lang, page_id, links: array of id, title and relatedness, in the order of pos, for the given lang, page_id rows.

    side: "inlink" or "outlink". Relatedness compares the two articles' link sets of that side.
    """
    edges = getattr(kb, side).join(pages.select("lang", "page_id").distinct(), ["lang", "page_id"])
    titled = edges.join(kb.page.select("lang", F.col("page_id").alias("target_id"), F.col("title").alias("target_title")), ["lang", "target_id"], "left")
    if related:
        valued = relatedness_of_pairs(edges.select("lang", "page_id", "target_id").distinct(), getattr(kb, side).select("lang", "page_id", "target_id").distinct(), kb)
        titled = titled.join(valued, ["lang", "page_id", "target_id"], "left")
    else:
        titled = titled.withColumn("relatedness", F.lit(None).cast("double"))
    entry = F.struct(F.col("target_id").alias("id"), F.col("target_title").alias("title"), "relatedness")
    return grouped(titled.select("lang", "page_id", "pos", entry.alias("x")), ["lang", "page_id"], "x", "links")


def neighbour_counts(pages: DataFrame, kb: KB, side: str) -> DataFrame:
    """lang, page_id, links: how many neighbours() each of the pages has; no list of them is made."""
    counts = getattr(kb, side).groupBy("lang", "page_id").agg(F.count("*").alias("links"))  # counted before they meet pages: links are neither moved nor sorted
    return counts.join(pages.select("lang", "page_id"), ["lang", "page_id"], "left_semi")


def relatedness_pairs(kb: KB, side: str, settle: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """lang, page_id, target_id, relatedness of each link. `settle`, which writes a DataFrame and reads it, spares finding the links each time they are met."""
    edges = getattr(kb, side).select("lang", "page_id", "target_id").distinct()
    edges = settle(edges) if settle else edges
    return relatedness_of_pairs(edges, edges, kb, settle)


#: The parts that a request for features needs.
DEFAULT_PARTS = ("inlinks", "outlinks", "categories", "definition", "labels")


def with_articles(links: DataFrame, kb: KB, parts: list[str] | None = None) -> DataFrame:
    """links with the article parts asked for (all, if none is named). Every part is gathered by page first, so a link stays one row."""
    asked = {p.strip().lower() for p in parts or [] if p.strip()} or {*DEFAULT_PARTS, "relatedness"}
    pages = links.select("lang", F.col("id").alias("page_id")).distinct()
    out = links.withColumns({"article_id": F.col("id"), "article_title": F.col("title")})

    def add(df: DataFrame, name: str, kind: str | None = None) -> None:
        nonlocal out
        out = out.join(df.select("lang", F.col("page_id").alias("id"), name), ["lang", "id"], "left")
        if kind:
            out = out.withColumn(name, F.coalesce(name, F.array().cast(kind)))

    pairs = "array<struct<id:string,title:string,relatedness:double>>"
    for part, side, name in (("inlinks", "inlink", "InLinks"), ("outlinks", "outlink", "OutLinks")):
        if part in asked and getattr(kb, side) is not None:
            add(neighbours(pages, kb, side, "relatedness" in asked).withColumnRenamed("links", name), name, pairs)
    if "labels" in asked and kb.page_label is not None:
        entry = F.struct("title", F.col("occurrences").alias("occurances"), F.col("from_redirect").alias("fromRedirect"), F.col("from_title").alias("fromTitle"), F.col("is_primary").alias("isPrimary"), "proportion")
        labels = grouped(kb.page_label.select("lang", "page_id", "pos", entry.alias("x")), ["lang", "page_id"], "x", "Labels")
        add(labels, "Labels", "array<struct<title:string,occurances:bigint,fromRedirect:boolean,fromTitle:boolean,isPrimary:boolean,proportion:double>>")
    if "categories" in asked and kb.category is not None:
        titled = kb.category.join(kb.page.select("lang", F.col("page_id").alias("category_id"), "title"), ["lang", "category_id"], "left")
        entry = F.struct(F.col("category_id").alias("id"), "title")
        add(grouped(titled.select("lang", "page_id", "pos", entry.alias("x")), ["lang", "page_id"], "x", "ParentCategories"), "ParentCategories", "array<struct<id:string,title:string>>")
    if "definition" in asked and kb.definition is not None:
        add(kb.definition.withColumnRenamed("definition", "Definition"), "Definition")
    return out
