"""From texts to links: n-grams, the join with labels and senses, probabilities, longest matches."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import link_probability, prior_probability, sense_probability
from ..functions.text import article_url, longest_ngram, ngram_of, norm_of, normal_ngrams, normalize
from ..kb import KB
from . import build
from .filters import condition
from .sentences import SentenceModel, split_sentences


def split_requests(requests: DataFrame, model: SentenceModel | None = None) -> DataFrame:
    """A row for each sentence of a request, with sentence_no; sentences as a model has learnt them, by fixed short forms without one."""
    return requests.select(*[c for c in requests.columns if c != "text"], F.posexplode(split_sentences("text", model)).alias("sentence_no", "text"))


#: Buckets of label bitmaps that are sent to all tasks, 4 KB each: 64 MB, eight languages of the largest size. Beyond, no n-gram is held against them.
MOST_BUCKETS = 1 << 14


@dataclass(frozen=True)
class LabelFilter:
    """What is known of a knowledge base's labels before n-grams move: the longest one's tokens, and bitmaps, if they are within bounds."""

    longest: int
    bits: dict[str, int]
    buckets: DataFrame | None

    def may_be_labels(self, grams: DataFrame) -> DataFrame:
        """The rows of grams (lang, norm_label) that the bitmaps don't rule out. Bitmaps are sent to the rows, which stay where they are."""
        if self.buckets is None:
            return grams
        sizes = set(self.bits.values())
        if not sizes:  # no labels at all
            return grams.where(F.lit(False))
        bits = max(sizes) if len(sizes) == 1 else F.create_map(*[F.lit(x) for pair in self.bits.items() for x in pair])[F.col("lang")]
        slot = build.label_slot("lang", "norm_label", bits)
        held = grams.withColumns({"bucket": F.bitmap_bucket_number(slot), "_p": F.bitmap_bit_position(slot)}).join(F.broadcast(self.buckets), ["lang", "bucket"])
        byte = F.ascii(F.decode(F.substring("bitmap", (F.col("_p") / 8).cast("int") + 1, F.lit(1)), "ISO-8859-1"))
        return held.where(F.getbit(byte, (F.col("_p") % 8).cast("int")) == 1).select(*grams.columns)


def label_filter(kb: KB) -> LabelFilter:
    """Read when a plan is made: published knowledge bases keep the bitmaps, for others one aggregate makes them."""
    made = kb.label_bitmap if kb.label_bitmap is not None else build.label_bitmap(kb.label)
    found = made.select("lang", "bits", "longest", "bucket", "bitmap").limit(MOST_BUCKETS + 1).toArrow()
    if found.num_rows > MOST_BUCKETS:
        return LabelFilter(int(made.agg(F.max("longest")).first()[0]), {}, None)
    longest = max((x for x in found.column("longest").to_pylist() if x), default=1)
    buckets = kb.label.sparkSession.createDataFrame(found.select(["lang", "bucket", "bitmap"]))
    return LabelFilter(longest, dict(zip(found.column("lang").to_pylist(), found.column("bits").to_pylist(), strict=True)), buckets)


def text_ngrams(requests: DataFrame, longest: int, exact: bool = True, plain: bool = False) -> DataFrame:
    """request_id, lang, sentence_no, ngram, norm_label: the distinct n-grams of each text and their normal forms, made within its row, so nothing moves."""
    made = requests.select("request_id", "lang", "sentence_no", F.explode(normal_ngrams("text", longest, exact=exact, plain=plain)).alias("_x"))
    return made.select("request_id", "lang", "sentence_no", ngram_of(F.col("_x")).alias("ngram"), norm_of(F.col("_x"), plain).alias("norm_label"))


def label_matches(requests: DataFrame, kb: KB, labels: DataFrame, dash: bool = True, accents: bool = True, lower: bool = False, max_ngram: int | None = None, head: bool = True, exact: bool = True, longest: int | None = None, plain: bool = False) -> DataFrame:
    """A row for each n-gram of a request and row of `labels` (lang, norm_label, label and what else is known of it) that it may be.

    N-grams that no label can equal are dropped where they are made; those that are left, few more than match, are
    shuffled to the labels. With `longest`, the tokens of the longest of `labels`, these are sent to the n-grams, which then need no bitmaps.
    `plain`: n-grams have the forms of plain_form(), as norm_label must have them too.
    """
    if "sentence_no" not in requests.columns:
        requests = requests.withColumn("sentence_no", F.lit(0))
    known = label_filter(kb) if longest is None else LabelFilter(longest, {}, None)
    cap = min(x for x in (known.longest, longest_ngram(max_ngram, head)) if x is not None)
    grams = known.may_be_labels(text_ngrams(requests.select("request_id", "lang", "sentence_no", "text"), max(1, cap), exact, plain))
    if plain or (dash and accents and lower):
        return grams.join(labels, ["lang", "norm_label"])
    same = lambda df, c: df.withColumn("_same", normalize(c, dash, accents, lower, exact))  # noqa: E731  once an n-gram and once a label, not once a pair
    return same(grams, "ngram").join(same(labels, "label"), ["lang", "norm_label", "_same"]).drop("_same")


#: Rows that are sent to all tasks where a settled table has no more; Spark's own measure, a file's size, says little of compressed rows.
FEW = 100_000


def counted(df: DataFrame, settle: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, int | None]:
    """df (labels) written as a table, joined by broadcast if it has few rows, by shuffle otherwise; and, if few, the tokens of its longest label."""
    kept = settle(df)
    rows, longest = kept.agg(F.count("*"), F.max(build.label_tokens("label"))).first()
    return kept.hint("broadcast" if rows <= FEW else "merge"), (longest or 1) if rows <= FEW else None


#: Numbers of links that label and sense alone decide.
SENSE_NUMBERS = frozenset(("linkProbability", "senseProbability", "priorProbability", "occCount", "docCount", "linkOccCount", "linkDocCount", "senseOccCount", "senseDocCount"))


def probable_senses(kb: KB, only_best: bool = False, least_sense: float = -1.0) -> DataFrame:
    """Labels by sense: the columns of candidates() that no text decides, and norm_label.

    They are made before texts come in, so what a filter on them drops never meets a text.
    """
    senses = kb.sense
    if only_best:
        order = F.struct(F.col("doc").isNull().alias("a"), (-F.col("doc")).alias("b"), F.col("sense_rank").alias("c"))
        columns = [c for c in senses.columns if c not in ("lang", "label")]
        senses = senses.groupBy("lang", "label").agg(F.min_by(F.struct(*columns), order).alias("_x")).select("lang", "label", "_x.*")
    senses = senses.withColumnsRenamed({"occ": "sense_occ", "doc": "sense_doc"}).join(kb.label, ["lang", "label"])
    probability = sense_probability("sense_doc", "text_doc", "text_occ")
    senses = senses.where(probability > least_sense) if least_sense >= 0 else senses
    titled = senses.join(kb.page.select("lang", F.col("page_id").alias("sense_id"), "title"), ["lang", "sense_id"], "left")
    title = F.coalesce("title", F.lit("None"))
    return titled.select(
        "lang",
        "norm_label",
        "label",
        F.col("sense_id").alias("id"),
        "sense_rank",
        title.alias("title"),
        article_url("lang", title).alias("url"),
        link_probability("link_doc", "text_doc", "text_occ").alias("linkProbability"),
        probability.alias("senseProbability"),
        prior_probability("sense_occ", "link_occ").alias("priorProbability"),
        F.col("text_occ").alias("occCount"),
        F.col("text_doc").alias("docCount"),
        F.col("link_occ").alias("linkOccCount"),
        F.col("link_doc").alias("linkDocCount"),
        F.col("sense_occ").alias("senseOccCount"),
        F.col("sense_doc").alias("senseDocCount"),
        F.col("from_title").alias("fromTitle"),
        F.col("from_redirect").alias("fromRedirect"),
    )


def candidates(requests: DataFrame, kb: KB, dash: bool = True, accents: bool = True, lower: bool = False, max_ngram: int | None = None, head: bool = True, least_sense: float = -1.0, only_best: bool = False, exact: bool = True, settle: Callable[[DataFrame], DataFrame] | None = None, thresholds: list[tuple[str, str, float]] | None = None, plain: bool = False, count_all: bool = False) -> DataFrame:
    """Links: a row for each n-gram of a request, label that it may be, and sense of that label.

    requests: request_id, lang, text and perhaps sentence_no. An n-gram finds labels by the full normal form and keeps
    those that equal it in the form that dash, accents and lower ask for. With only_best each label has its sense in most
    documents. Titles of senses without a page are "None". Probabilities are of label and sense alone: a filter on
    them is moved by Spark to the senses, before these meet texts.
    `settle`, which writes a DataFrame and reads it, tells how many senses are left: if few, no n-gram is shuffled. `thresholds`
    (of filters.parse_filter) on columns of senses drop these; others are left to filters.filtered(). `plain`: forms of n-grams as plain_form() has them, for a kb whose labels have such forms.
    `count_all`: senses are counted by `settle` though nothing drops any, for a kb that may have few.
    """
    senses = probable_senses(kb, only_best, least_sense)
    of_sense = [t for t in thresholds or [] if t[0] in SENSE_NUMBERS]
    senses = senses.where(condition(of_sense)) if of_sense else senses
    senses, longest = counted(senses, settle) if settle and (only_best or of_sense or count_all) else (senses, None)
    found = label_matches(requests, kb, senses, dash, accents, lower, max_ngram, head, exact, longest, plain)
    return found.select("request_id", "lang", "sentence_no", F.col("ngram").alias("text"), *[c for c in senses.columns if c not in ("lang", "norm_label")])


def candidate_totals(requests: DataFrame, kb: KB, least_sense: float = -1.0, settle: Callable[[DataFrame], DataFrame] | None = None, **matching) -> DataFrame:
    """request_id, label, links, link_probability, sense_sum, prior_sum: the links that candidates() has for a request and label, added up.

    A label's senses are added up before texts meet them, so the work grows with matches, not with matches times senses.
    """
    of_label = probable_senses(kb, least_sense=least_sense).groupBy("lang", "norm_label", "label").agg(F.count("*").alias("_links"), F.max("linkProbability").alias("_link"), F.sum("senseProbability").alias("_sense"), F.sum("priorProbability").alias("_prior"))
    of_label, longest = counted(of_label, settle) if settle else (of_label, None)
    found = label_matches(requests, kb, of_label, **matching, longest=longest)
    return found.groupBy("request_id", "label").agg(F.sum("_links").alias("links"), F.max("_link").alias("link_probability"), F.sum("_sense").alias("sense_sum"), F.sum("_prior").alias("prior_sum"))


def largest_matches(links: DataFrame, requests: DataFrame, dash: bool = True, accents: bool = True, lower: bool = False) -> DataFrame:
    """Of each text's links those of a greedy cover: long labels first, then likely ones; a label whose normal form is
    still in the text takes all its places, any other is dropped.

    The links of one text are folded in one row, which holds them whole, so they move once; ties end by label and id.
    Links of a kept label and sense all stay.
    """
    if "sentence_no" not in requests.columns:
        requests = requests.withColumn("sentence_no", F.lit(0))
    key = ["request_id", "lang", "sentence_no"]
    norm = normalize("label", dash, accents, lower, exact=True)
    link = F.struct(*[F.col(c) for c in links.columns if c not in key])
    entry = F.struct((-F.length("label")).alias("a"), (-F.col("priorProbability")).alias("b"), F.col("label").alias("label"), F.col("id").alias("id"), norm.alias("norm"), link.alias("link"))
    labels = links.groupBy(*key).agg(F.array_sort(F.collect_list(entry)).alias("_labels"))
    texts = requests.select(*key, normalize("text", dash, accents, lower, exact=True).alias("_text"))
    kind = links.select(link.alias("x")).schema["x"].dataType.simpleString()
    none = F.lit(None).cast("string")
    start = F.struct(F.col("_text").alias("left"), none.alias("label"), none.alias("id"), F.array().cast(f"array<{kind}>").alias("kept"))

    def step(acc, x):
        again = (acc["label"] == x["label"]) & (acc["id"] == x["id"])  # the same label and sense of another n-gram
        kept = F.array_append(acc["kept"], x["link"])
        taken = F.struct(F.replace(acc["left"], x["norm"], F.lit("")).alias("left"), x["label"].alias("label"), x["id"].alias("id"), kept.alias("kept"))
        more = F.struct(acc["left"].alias("left"), acc["label"].alias("label"), acc["id"].alias("id"), kept.alias("kept"))
        return F.when(again, more).when(F.contains(acc["left"], x["norm"]), taken).otherwise(acc)

    kept = labels.join(texts, key).select(*key, F.inline(F.aggregate("_labels", start, step)["kept"]))
    return kept.select(*links.columns)


def largest_links(requests: DataFrame, kb: KB, dash: bool = True, accents: bool = True, lower: bool = False, max_ngram: int | None = None, head: bool = True, settle: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """largest_matches() of the best senses' candidates().

    Where these senses are few, as `settle` tells, texts are dealt out once by their key and stay there: their n-grams meet the senses and are
    folded without another shuffle, and only links that are kept get what label and sense alone decide.
    """
    key = ["request_id", "lang", *(["sentence_no"] if "sentence_no" in requests.columns else [])]
    senses, longest = counted(probable_senses(kb, only_best=True), settle) if settle else (probable_senses(kb, only_best=True), None)
    columns = ["request_id", "lang", "sentence_no", F.col("ngram").alias("text"), *[c for c in senses.columns if c not in ("lang", "norm_label")]]
    if longest is None:
        found = label_matches(requests, kb, senses, dash, accents, lower, max_ngram, head).select(*columns)
        return largest_matches(found, requests, dash, accents, lower)
    texts = requests.select(*key, "text").repartition(*key)  # a sentence_no of 0 for all would be no key to Spark, which would deal the rows out again
    slim = senses.select("lang", "norm_label", "label", "id", "priorProbability").distinct().hint("broadcast")
    found = label_matches(texts, kb, slim, dash, accents, lower, max_ngram, head, longest=longest).drop("norm_label")
    kept = largest_matches(found, texts, dash, accents, lower).drop("priorProbability")
    return kept.join(senses, ["lang", "label", "id"]).select(*columns)


def with_translations(links: DataFrame, kb: KB) -> DataFrame:
    """translations: by language the article's title and url; its own language always, others where they are known."""
    if kb.translation is None:
        other = None
    else:
        entry = F.struct(F.col("tlang").alias("key"), F.struct("title", article_url("tlang", "title").alias("url")).alias("value"))
        other = kb.translation.groupBy("lang", F.col("page_id").alias("id")).agg(F.map_from_entries(F.array_sort(F.collect_set(entry))).alias("_other"))
    own = F.create_map("lang", F.struct("title", "url"))
    if other is None:
        return links.withColumn("translations", own)
    joined = links.join(other, ["lang", "id"], "left")
    rest = F.map_filter("_other", lambda k, v: k != F.col("lang"))
    return joined.withColumn("translations", F.when(F.col("_other").isNull(), own).otherwise(F.map_concat(own, rest))).drop("_other")
