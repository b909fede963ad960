"""Knowledge bases made of the star-schema and web tables: labels, senses, pages and links by what occurs together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import W, normalize, plain_form
from ..kb import KB
from ..operators.build import page_label_proportion, title_ngram_counts

LANG = "en"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """df dealt out by key over all cores, for work that is long on each row: a file of one row group would be one task, however large it is."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, key)


def order_requests(spark: SparkSession, sf_dir: str, with_text: bool = True) -> DataFrame:
    """A request for each order: the names of its parts in the order of its lines; its customer is the context."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    names = lines.join(read(spark, sf_dir, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    texts = names.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "p_name"))), lambda x: x["p_name"]), " ").alias("text"))
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    texts = texts if with_text else texts.drop("text")
    return texts.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_orderkey").cast("string").alias("request_id"), F.lit(LANG).alias("lang"), *(["text"] if with_text else []), F.col("o_custkey").cast("string").alias("context"), F.col("l_orderkey").alias("seq"))


def document_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(read(spark, sf_dir, "documents").select("doc_id", "text", "source"), "doc_id")
    return docs.select(F.col("doc_id").cast("string").alias("request_id"), F.lit(LANG).alias("lang"), "text", F.col("source").alias("context"), F.col("doc_id").alias("seq"))


def star(spark: SparkSession, sf_dir: str) -> KB:
    """Labels are part names, senses parts, documents orders; a line that wasn't returned as 'N' is a link."""
    part, lines = read(spark, sf_dir, "part"), read(spark, sf_dir, "lineitem")
    named = lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag").join(part.select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    linked = F.col("l_returnflag") != "N"
    order = F.col("l_orderkey")
    of_order = named.groupBy("p_name", "l_orderkey").agg(F.sum(linked.cast("long")).alias("l"), F.count("*").alias("t"))  # two distinct counts at once would move every row three times
    label = of_order.groupBy("p_name").agg(F.sum("l").alias("link_occ"), F.count(F.when(F.col("l") > 0, order)).alias("link_doc"), F.sum("t").alias("text_occ"), F.count(order).alias("text_doc"))
    label = label.select(F.lit(LANG).alias("lang"), F.col("p_name").alias("label"), normalize("p_name", exact=True).alias("norm_label"), "link_occ", "link_doc", "text_occ", "text_doc")
    sense = named.where(linked).groupBy("p_name", "l_partkey").agg(F.count("*").alias("occ"), F.countDistinct("l_orderkey").alias("doc"))
    rank = F.row_number().over(Window.partitionBy("p_name").orderBy(F.desc("doc"), "l_partkey")) - 1
    even = F.col("l_partkey") % 2 == 0
    sense = sense.select(F.lit(LANG).alias("lang"), F.col("p_name").alias("label"), rank.cast("int").alias("sense_rank"), F.col("l_partkey").cast("string").alias("sense_id"), "occ", "doc", F.when(even, "T").otherwise("F").alias("from_title"), F.when(even, "F").otherwise("T").alias("from_redirect"))
    title = F.concat("p_brand", F.lit(" "), "p_name")
    page = part.select(F.lit(LANG).alias("lang"), F.col("p_partkey").cast("string").alias("page_id"), title.alias("title"))
    category = part.select(F.lit(LANG).alias("lang"), F.col("p_partkey").cast("string").alias("page_id"), F.lit(0).alias("pos"), F.col("p_type").alias("category_id"))
    translation = part.select(F.lit(LANG).alias("lang"), F.col("p_partkey").cast("string").alias("page_id"), F.explode(F.array(F.struct(F.lit("de").alias("t"), F.concat("p_name", F.lit(" "), "p_type").alias("x")), F.struct(F.lit("fr").alias("t"), F.when(F.col("p_partkey") % 2 == 0, F.concat("p_type", F.lit(" "), "p_name")).alias("x")))).alias("s")).where("s.x IS NOT NULL").select("lang", "page_id", F.col("s.t").alias("tlang"), F.col("s.x").alias("title"))
    definition = part.select(F.lit(LANG).alias("lang"), F.col("p_partkey").cast("string").alias("page_id"), F.concat(F.lit("<b>"), "p_name", F.lit("</b> of "), "p_brand", F.lit(". A "), "p_type", F.lit(" "), "p_name", F.lit(".")).alias("definition"))
    follows = named.select(F.col("l_partkey").alias("a"), F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")).alias("b")).where("b IS NOT NULL AND a <> b").distinct()

    def links(page_col: str, target: str) -> DataFrame:
        pos = F.row_number().over(Window.partitionBy(page_col).orderBy(target)) - 1
        return follows.select(F.lit(LANG).alias("lang"), F.col(page_col).cast("string").alias("page_id"), pos.cast("int").alias("pos"), F.col(target).cast("string").alias("target_id"))

    flag = F.col("l_returnflag")
    occ = lines.groupBy("l_partkey").agg(F.count("*").alias("n"), F.sum((flag == "R").cast("long")).alias("r"), F.sum((flag == "A").cast("long")).alias("a"))
    names = F.array(F.struct(F.lit(0).alias("pos"), F.col("p_name").alias("title"), F.col("n").alias("occurrences")), F.struct(F.lit(1).alias("pos"), F.col("p_brand").alias("title"), F.col("r").alias("occurrences")), F.struct(F.lit(2).alias("pos"), F.col("p_type").alias("title"), F.col("a").alias("occurrences")))
    page_label = part.join(occ, F.col("p_partkey") == F.col("l_partkey")).select(F.lit(LANG).alias("lang"), F.col("p_partkey").cast("string").alias("page_id"), F.inline(names))
    page_label = page_label.select("*", F.lit(False).alias("from_redirect"), (F.col("pos") == 0).alias("from_title"), (F.col("pos") == 0).alias("is_primary"))
    stats = part.agg(F.count("*").alias("value")).select(F.lit(LANG).alias("lang"), F.lit("articleCount").alias("name"), "value")
    meta = spark.range(1).select(F.lit(LANG).alias("lang"), F.lit(0).alias("version"), F.lit("English").alias("language_name"), F.lit(sf_dir).alias("path"))
    return KB(stats, label, sense, page, title_ngram_counts(page), page_label_proportion(page_label), links("b", "a"), links("a", "b"), category, translation, definition, meta)


#: The text of a link to a page of the same site; its target is the name after the slash.
ANCHOR = r"<a href=\"/([^\"]*)\">([^<]*)</a>"


#: Labels that are sent to all documents' words where they are counted to be no more.
FEW_LABELS = 100_000


def web(spark: SparkSession, sf_dir: str, plain: bool = False, settle: Callable[[DataFrame], DataFrame] | None = None) -> KB:
    """Labels are the texts of links in pages, senses their targets; words of documents are the texts' occurrences.

    `plain`: links without a text or a target count too, and labels have the forms of plain_form().
    `settle` writes a DataFrame and reads it: pages are read once, and where labels are few, only words that are labels are counted document by document.
    """
    html = spread(read(spark, sf_dir, "pages").select("page_id", "html"), "page_id")
    anchors = html.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(0))).alias("a")).select("page_id", F.regexp_extract("a", ANCHOR, 1).alias("target"), F.regexp_extract("a", ANCHOR, 2).alias("label"))
    anchors = anchors if plain else anchors.where("label <> '' AND target <> ''")
    anchors = settle(anchors) if settle else anchors
    linked = anchors.groupBy("label").agg(F.count("*").alias("link_occ"), F.countDistinct("page_id").alias("link_doc"))
    docs = spread(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")  # counts of a document stay where it is
    tokens = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(rf"[{W}]+"), F.lit(0))).alias("label"))
    if settle:
        linked = settle(linked)
        tokens = tokens.join(F.broadcast(linked.select("label")), "label", "left_semi") if linked.count() <= FEW_LABELS else tokens
    per_doc = tokens.groupBy("label", "doc_id").agg(F.count("*").alias("n"))
    seen = per_doc.groupBy("label").agg(F.sum("n").alias("text_occ"), F.count("doc_id").alias("text_doc"))
    label = linked.join(seen, "label", "left").select(F.lit(LANG).alias("lang"), "label", (plain_form("label") if plain else normalize("label", exact=True)).alias("norm_label"), "link_occ", "link_doc", F.coalesce("text_occ", F.lit(0)).alias("text_occ"), F.coalesce("text_doc", F.lit(0)).alias("text_doc"))
    sense = anchors.groupBy("label", "target").agg(F.count("*").alias("occ"), F.countDistinct("page_id").alias("doc"))
    label = settle(label) if settle else label
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("doc"), "target")) - 1
    sense = sense.select(F.lit(LANG).alias("lang"), "label", rank.cast("int").alias("sense_rank"), F.col("target").alias("sense_id"), "occ", "doc", F.lit("F").alias("from_title"), F.lit("F").alias("from_redirect"))
    page = sense.select("lang", F.col("sense_id").alias("page_id"), F.col("sense_id").alias("title")).distinct()
    stats = page.agg(F.count("*").alias("value")).select(F.lit(LANG).alias("lang"), F.lit("articleCount").alias("name"), "value")
    return KB(stats, label, sense, page)
