"""Features of links: of the anchor's counts, of label and title, of the definition, and of links of the same text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions.numbers import inverse_frequency, per_count
from ..functions.text import W, clean_definition, count_ngram, ngram_pattern, tokenize, word_ngrams, words
from ..kb import KB
from .candidates import FEW

ANCHOR = ("LEN", "IDF_title", "IDF_anchor", "IDF_content", "KEYPHRASENESS", "LINKPROB", "SNIL", "SNCL", "NORMALIZATION")
ARTICLE = ("INLINKS", "OUTLINKS", "REDIRECT", "TF_title", "TF_sentence", "TF_paragraph", "POS_first_in_paragraph", "NCT", "TCN", "TEN", "SUBSTRING_MATCH_1", "SUBSTRING_MATCH_2", "WORD_MATCH", "WORD_MISS", "EDIT_DISTANCE", "COMMONNESS")


def label_ngram_features(labels: DataFrame, kb: KB, head: bool = False) -> DataFrame:
    """lang, label, SNIL (its word n-grams that are titles), SNCL (their counts among titles), title_count, for distinct labels."""
    grams = labels.select("lang", "label", F.explode(word_ngrams(tokenize("label"), proper=head)).alias("ngram"))
    titles = kb.page.select("lang", F.col("title").alias("ngram"), F.lit(1).alias("_is")).distinct()
    scored = grams.join(titles, ["lang", "ngram"], "left").join(kb.title_ngram.select("lang", "ngram", "score"), ["lang", "ngram"], "left")
    sums = scored.groupBy("lang", "label").agg(F.count("_is").alias("SNIL"), F.coalesce(F.sum("score"), F.lit(0)).alias("SNCL"))
    whole = labels.withColumn("ngram", F.array_join(tokenize("label"), " ")).join(kb.title_ngram.select("lang", "ngram", F.col("score").alias("title_count")), ["lang", "ngram"], "left").drop("ngram")
    return whole.join(sums, ["lang", "label"], "left").select("lang", "label", F.coalesce("SNIL", F.lit(0)).alias("SNIL"), F.coalesce("SNCL", F.lit(0)).alias("SNCL"), "title_count")


def with_anchor_features(links: DataFrame, kb: KB, head: bool = False) -> DataFrame:
    """links with the columns of ANCHOR. N-grams of labels are looked up once for each distinct label."""
    per_label = label_ngram_features(links.select("lang", "label").distinct(), kb, head)
    x = links.join(per_label, ["lang", "label"], "left").join(F.broadcast(kb.articles()), "lang", "left")  # a row for each language
    n = F.col("articles")
    return x.withColumns(
        {
            "LEN": F.regexp_count("label", F.lit(rf"[{W}]{{2,}}")),
            "IDF_title": inverse_frequency(n, "title_count"),
            "IDF_anchor": inverse_frequency(n, "linkDocCount"),
            "IDF_content": inverse_frequency(n, "docCount"),
            "KEYPHRASENESS": per_count("linkDocCount", "docCount"),
            "LINKPROB": per_count("linkOccCount", "occCount"),
            "NORMALIZATION": F.levenshtein("label", "text") / F.length("text"),
        }
    ).drop("title_count", "articles")


def _first_place(label: Column, text: Column) -> Column:
    """0-based start of the first match, 1 if there is none."""
    at = F.regexp_instr(text, ngram_pattern(label))
    return F.when(at > 0, at - 1).otherwise(F.lit(1))


def with_article_features(links: DataFrame, head: bool = True) -> DataFrame:
    """links with the columns of ARTICLE; InLinks and OutLinks (lists, or their lengths) and Definition are used where they are.

    REDIRECT is 1 whenever counts are known, as it has always come out; in fixed mode (head=False) only for senses that
    titles lead to.
    """
    has = set(links.columns)
    size = lambda c: F.coalesce(F.size(c) if isinstance(links.schema[c].dataType, ArrayType) else F.col(c), F.lit(0)) if c in has else F.lit(0)
    label, title = F.col("label"), F.col("title")
    x = links.withColumns({"_def": clean_definition("Definition" if "Definition" in has else F.lit(None).cast("string")), "_lw": words("label"), "_tw": words("title")})
    shared = F.size(F.array_intersect("_lw", "_tw"))
    redirect = F.lit(1) if head else (F.col("fromTitle") == "T").cast("int")
    return x.withColumns(
        {
            "INLINKS": size("InLinks"),
            "OUTLINKS": size("OutLinks"),
            "REDIRECT": F.coalesce(redirect, F.lit(0)),
            "TF_title": count_ngram(label, title),
            "TF_sentence": count_ngram(label, F.split_part("_def", F.lit("."), F.lit(1))),
            "TF_paragraph": count_ngram(label, F.col("_def")),
            "POS_first_in_paragraph": _first_place(label, F.col("_def")),
            "NCT": (count_ngram(title, label) > 0).cast("int"),
            "TCN": (count_ngram(label, title) > 0).cast("int"),
            "TEN": (label == title).cast("int"),
            "SUBSTRING_MATCH_1": F.coalesce((F.get("_lw", F.lit(0)) == F.get("_tw", F.lit(0))).cast("int"), F.lit(0)),
            "SUBSTRING_MATCH_2": F.coalesce((F.try_element_at("_lw", F.lit(-1)) == F.try_element_at("_tw", F.lit(-1))).cast("int"), F.lit(0)),
            "WORD_MATCH": shared,
            "WORD_MISS": F.size("_lw") + F.size("_tw") - 2 * shared,
            "EDIT_DISTANCE": F.levenshtein("label", "title"),
            "COMMONNESS": F.col("priorProbability"),
        }
    ).drop("_def", "_lw", "_tw")


def as_map(links: DataFrame, columns: list[str]) -> DataFrame:
    """The columns as one map `features`, added to one that is there."""
    pairs = [y for c in columns for y in (F.lit(c), F.col(c).cast("double"))]
    made = F.create_map(*pairs)
    if "features" in links.columns:
        made = F.map_concat(F.map_filter("features", lambda k, v: ~k.isin(columns)), made)
    return links.withColumn("features", made).drop(*columns)


# --- links of the same text ---

OVERLAP = ("label_overlap", "label_unique", "entity_overlap", "entity_unique", "entity_proportion", "sense_prob_sum", "prior_prob_sum", "cmns_sum")


def _overlap(pairs: DataFrame, key: list[str], prefix: str, most: Column) -> DataFrame:
    """The features of OVERLAP for each key, of rows with other_label, other_id and its probabilities; each counts `_times`.

    Distinct labels and articles are sets, no larger than a text's links: countDistinct would move every row three times.
    """
    times = F.col("_times")
    out = pairs.groupBy(*key).agg(
        F.sum("_times").alias("label_overlap"),
        F.size(F.collect_set("other_label")).cast("long").alias("label_unique"),
        F.sum("_times").alias("entity_overlap"),
        F.size(F.collect_set("other_id")).cast("long").alias("entity_unique"),
        (F.size(F.collect_set("other_id")) / most).alias("entity_proportion"),
        F.sum(F.col("other_sense") * times).alias("sense_prob_sum"),
        F.sum(F.col("other_prior") * times).alias("prior_prob_sum"),
        F.sum(F.col("other_link") * times).alias("cmns_sum"),
    )
    return out.select(*key, *[F.col(c).alias(f"{prefix}_{c}") for c in OVERLAP])


def _others(links: DataFrame) -> DataFrame:
    return links.select("request_id", F.col("id").alias("other_id"), F.col("label").alias("other_label"), F.col("senseProbability").alias("other_sense"), F.col("priorProbability").alias("other_prior"), F.col("linkProbability").alias("other_link"))


def linked_edges(links: DataFrame, edges: DataFrame) -> DataFrame:
    """lang, page_id, target_id, _degree: the edges between articles that are linked in any text; _degree counts all edges of page_id.

    Others can't be neighbours within a text, so they never meet one.
    """
    known = links.select("lang", F.col("id").alias("page_id")).distinct()
    own = edges.select("lang", "page_id", "target_id").join(known, ["lang", "page_id"], "left_semi")
    degree = own.groupBy("lang", "page_id").agg(F.count("*").alias("_degree"))
    return own.join(known.withColumnRenamed("page_id", "target_id"), ["lang", "target_id"], "left_semi").join(degree, ["lang", "page_id"])


def neighbour_candidates(links: DataFrame, edges: DataFrame, how: str = "merge") -> tuple[DataFrame, DataFrame]:
    """What may be neighbours within one text, in two parts (both request_id, lang, id, other_id, _degree).

    Of articles with fewer neighbours than the text has articles, all neighbours, to be looked up in the text; of the
    others, hubs, all articles of the text, to be looked up among the edges. So an article costs a text no more rows than
    the smaller of the two numbers, however many neighbours a hub has. Joins of texts with themselves are by shuffle:
    a settled table's file, or a shuffle's, is far smaller than its rows, which the driver would have to hold to send them. `how`
    (merge or broadcast) edges are joined is for the caller to say.
    """
    ids = links.select("request_id", "lang", "id").repartition("request_id").distinct()
    degree = edges.groupBy("lang", F.col("page_id").alias("id")).agg(F.count("*").alias("_listed"), (F.max("_degree") if "_degree" in edges.columns else F.count("*")).alias("_degree"))
    known = ids.withColumn("_articles", F.count("*").over(Window.partitionBy("request_id"))).join(degree.hint(how), ["lang", "id"])
    few, hubs = known.where("_listed <= _articles"), known.where("_listed > _articles")
    listed = few.join(edges.select("lang", F.col("page_id").alias("id"), F.col("target_id").alias("other_id")).hint(how), ["lang", "id"])
    paired = hubs.hint("merge").join(ids.select("request_id", F.col("id").alias("other_id")).hint("merge"), "request_id")
    return tuple(x.select("request_id", "lang", "id", "other_id", "_degree") for x in (listed, paired))


def _settled_few(df: DataFrame, settle: Callable[[DataFrame], DataFrame] | None) -> tuple[DataFrame, str]:
    """df, as a table if it can be one, and how to join it: by broadcast only if it is known to have few rows."""
    if settle is None:
        return df, "merge"
    kept = settle(df)
    return kept, "broadcast" if kept.count() <= FEW else "merge"


def linked_overlap(links: DataFrame, edges: DataFrame, prefix: str, settle: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """request_id, label, id and features of how its article's neighbours (edges: lang, page_id, target_id) are themselves
    linked in the text by other labels. Links without any have no row.
    """
    edges, how = _settled_few(linked_edges(links, edges), settle)
    listed, paired = neighbour_candidates(links, edges, how)
    near = listed.unionByName(paired.join(edges.select("lang", F.col("page_id").alias("id"), F.col("target_id").alias("other_id")).hint(how), ["lang", "id", "other_id"]))
    pairs = near.join(_others(links).hint("merge"), ["request_id", "other_id"]).join(links.select("request_id", "label", "id").hint("merge"), ["request_id", "id"]).where("label <> other_label")
    return _overlap(pairs.withColumn("_times", F.lit(1)), ["request_id", "label", "id"], prefix, F.max("_degree"))


def tier_one_overlap(links: DataFrame, kb: KB, settle: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """request_id, label, id and features of how the labels of its own article are used in the text for it.

    An article's labels (its title included) and the labels linked in the text are multisets; each common one counts as
    often as it stands in both, and pairs with every link of the text that has that label and this article.

    Labels of articles that are linked nowhere are dropped first; links meet what is left before they are paired. How often a
    label is used is counted beside the links, so these move twice, by text and by text and article.
    """
    own = kb.page_label.select("lang", F.col("page_id").alias("id"), "title").unionAll(kb.page.select("lang", F.col("page_id").alias("id"), "title"))
    met = links.select("lang", "id", F.col("label").alias("title")).distinct()
    own = own.join(met, ["lang", "id", "title"], "left_semi").groupBy("lang", "id", F.col("title").alias("other_label")).agg(F.count("*").alias("_own"))
    own, how = _settled_few(own, settle)
    used = links.select("request_id", "lang", "label", "id", "senseProbability", "priorProbability", "linkProbability").repartition("request_id").withColumn("_used", F.count("*").over(Window.partitionBy("request_id", "label")))
    others = used.select("request_id", "lang", "id", "_used", *[F.col(a).alias(b) for a, b in (("label", "other_label"), ("senseProbability", "other_sense"), ("priorProbability", "other_prior"), ("linkProbability", "other_link"))])
    others = others.join(own.hint(how), ["lang", "id", "other_label"]).drop("lang")
    pairs = links.select("request_id", "label", "id").hint("merge").join(others.hint("merge"), ["request_id", "id"])
    pairs = pairs.withColumns({"_times": F.least("_own", "_used"), "other_id": F.col("id")})
    return _overlap(pairs, ["request_id", "label", "id"], "ME_T1", F.lit(1))


def with_multi_features(links: DataFrame, kb: KB, which: list[str], settle=None) -> DataFrame:
    """links with the overlap features of `which`: tier1, outlinks, inlinks; null where there is no overlap.

    Links meet one another several times here: `settle`, which writes a DataFrame and reads it, spares making them each time.
    """
    links = settle(links) if settle else links
    for name in which:
        if name == "tier1":
            more = tier_one_overlap(links, kb, settle)
        elif name in ("outlinks", "inlinks"):
            edges = kb.outlink if name == "outlinks" else kb.inlink
            more = linked_overlap(links, edges, "ME_OUT" if name == "outlinks" else "ME_IN", settle)
        else:
            raise ValueError(f"multi knows tier1, outlinks and inlinks, not {name!r}")
        links = links.join(more, ["request_id", "label", "id"], "left")
    return links
