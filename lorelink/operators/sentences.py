"""Sentence splitting that learns its abbreviations from the texts themselves, without marked sentences.

After Kiss and Strunk, "Unsupervised Multilingual Sentence Boundary Detection" (2006): a word type is an abbreviation if
it stands with a full stop far more often than chance has it (a log-likelihood ratio), weighed by its length, its inner full
stops and its occurrences without one. A word that stands after sentence ends far more often than elsewhere starts
sentences; two words around a full stop that stand together far more often than chance has it are a collocation, which is
not cut. All statistics come from one table of counts of word, full stop and next word; the model that the splitter reads
is a table of the types found.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col, let
from ..functions.text import sentences as plain_sentences

#: Fixed values of the paper: the chance of a full stop after an abbreviation, and the least scores of abbreviations, collocations and sentence starters.
SURE, ABBREVIATION, COLLOCATION, STARTER = 0.99, 0.3, 7.88, 30.0

#: Words as they are counted: letters with inner full stops, hyphens and apostrophes; marks around them don't count.
_AROUND = r"^[\"'(\[]+|[\"')\],;:]+$"
_WORD = r"^\p{L}[\p{L}.'-]*$"


def _token(x: Column) -> Column:
    return F.regexp_replace(x, _AROUND, "")


def word_pairs(docs: DataFrame, text: str = "text") -> DataFrame:
    """word, period, next, n: how often a word type stands with or without a full stop, and the type that follows ("" at a text's end or for what is no word).

    The one pass over the texts: pairs are made within their row and counted before they are shuffled.
    """
    tokens = F.transform(F.filter(F.split(col(text), r"[\x20\x09-\x0D]+"), lambda x: x != ""), _token)
    stop = lambda x: F.endswith(x, F.lit("."))
    form = lambda x: F.when(F.rlike(x, F.lit(_WORD)), F.regexp_replace(F.lower(x), r"\.$", "")).otherwise(F.lit(""))
    pair = lambda t: F.transform(t, lambda x, i: F.struct(form(x).alias("word"), stop(x).alias("period"), form(F.coalesce(F.get(t, i + 1), F.lit(""))).alias("next")))
    made = docs.where(F.col(text).isNotNull()).select(F.inline(let(tokens, pair)))
    return made.where("word <> ''").groupBy("word", "period", "next").agg(F.count("*").alias("n"))


def abbreviation_scores(pairs: DataFrame) -> DataFrame:
    """word, with_period, without, score of each type that stands with a full stop at all."""
    types = pairs.groupBy("word").agg(F.sum(F.when(F.col("period"), F.col("n")).otherwise(0)).alias("with_period"), F.sum(F.when(F.col("period"), 0).otherwise(F.col("n"))).alias("without"))
    total = types.agg((F.sum("with_period") / F.sum(F.col("with_period") + F.col("without"))).alias("_p"))  # one row
    x = types.crossJoin(F.broadcast(total)).where("with_period > 0 AND _p < 1")
    p, yes, no = F.col("_p"), F.col("with_period"), F.col("without")
    chance = yes * F.ln(p) + no * F.ln(1 - p)
    sure = yes * F.ln(F.lit(SURE)) + no * F.ln(F.lit(1 - SURE))
    letters = F.length(F.replace("word", F.lit("."), F.lit("")))
    weight = F.exp(-letters) * (F.length("word") - letters + 1) * F.pow(letters.cast("double"), -no)
    return x.select("word", "with_period", "without", (-2 * (chance - sure) * weight).alias("score"))


def log_likelihood(both: Column, a: Column, b: Column, n: Column) -> Column:
    """Dunning's ratio of two events that occur a and b times among n, both at once; 0 where that is no more than chance has it."""
    def part(k: Column, of: Column, p: Column) -> Column:
        term = lambda count, share: F.when(count == 0, F.lit(0.0)).otherwise(count * F.ln(share))
        return term(k, p) + term(of - k, 1 - p)

    p, p1, p2 = b / n, both / a, (b - both) / F.greatest(n - a, F.lit(1))
    ratio = -2 * (part(both, a, p) + part(b - both, n - a, p) - part(both, a, p1) - part(b - both, n - a, p2))
    return F.when((both * n > a * b) & (n > a), ratio).otherwise(F.lit(0.0))


def learn_sentences(docs: DataFrame, text: str = "text", settle=None) -> DataFrame:
    """kind (abbreviation, starter or collocation), word, score: the model, a table of the types found.

    A collocation's word is both words with a blank between. `settle` writes a DataFrame and reads it, so that the texts
    are read once.
    """
    pairs = settle(word_pairs(docs, text)) if settle else word_pairs(docs, text)
    short = abbreviation_scores(pairs).where(F.col("score") >= ABBREVIATION).select("word", "score")
    marked = pairs.join(short.select("word", F.lit(True).alias("_short")), "word", "left").withColumn("_short", F.coalesce("_short", F.lit(False)) | (F.length("word") == 1))
    n = pairs.agg(F.sum("n").alias("_n"))  # one row
    ends = marked.where("period AND NOT _short")
    words = pairs.groupBy("word").agg(F.sum("n").alias("_b"))
    starts = ends.where("next <> ''").groupBy(F.col("next").alias("word")).agg(F.sum("n").alias("_both")).join(words, "word").crossJoin(F.broadcast(ends.agg(F.sum("n").alias("_a")))).crossJoin(F.broadcast(n))
    starts = starts.select("word", log_likelihood(F.col("_both"), F.col("_a"), F.col("_b"), F.col("_n")).alias("score")).where(F.col("score") >= STARTER)
    stopped = marked.where("period AND _short AND next <> ''").groupBy("word", "next").agg(F.sum("n").alias("_both"))
    together = stopped.join(words.withColumnRenamed("_b", "_a"), "word").join(words.select(F.col("word").alias("next"), "_b"), "next").crossJoin(F.broadcast(n))
    together = together.where("_both > 1").select(F.concat_ws(" ", "word", "next").alias("word"), log_likelihood(F.col("_both"), F.col("_a"), F.col("_b"), F.col("_n")).alias("score")).where(F.col("score") >= COLLOCATION)
    kinds = (("abbreviation", short), ("starter", starts), ("collocation", together))
    whole = None
    for kind, df in kinds:
        part = df.select(F.lit(kind).alias("kind"), "word", "score")
        whole = part if whole is None else whole.unionAll(part)
    return whole


def _pieces(text: Column | str) -> Column:
    """A text's pieces up to . ! ? (and closing marks) and white space, behind each of which it may be cut."""
    return F.regexp_extract_all(col(text), F.lit(r"(?s)\S.*?(?:[.!?][\"')\]]*\s+|\z)"), F.lit(0))


def _word(x: Column) -> Column:
    return F.regexp_replace(F.lower(_token(x)), r"\.$", "")


def _around(piece: Column, following: Column) -> tuple[Column, Column, Column]:
    """The word before a place and the one behind it, and whether a full stop parts them."""
    last, first = F.regexp_extract(piece, r"(\S+)\s*\z", 1), F.regexp_extract(following, r"\A(\S+)", 1)
    return _word(last), _word(first), F.endswith(_token(last), F.lit("."))


def _may_end(following: Column) -> Column:
    return ~F.rlike(following, F.lit(r"\A[\"'(\[]*\p{Ll}"))


def _kept_together(last: Column, abbreviation: Column, starter: Column, collocation: Column) -> Column:
    """Whether a text isn't cut between two words with a full stop, by what the model has of them."""
    short = (F.length(last) == 1) | abbreviation
    return collocation | (short & ~((F.length(last) > 1) & starter))


def _joined(pieces: Column, ends: Callable[[Column, Column], Column]) -> Column:
    """Sentences of pieces, cut where ends(piece, the following one) holds."""
    def marked(p: Column) -> Column:
        return F.transform(p, lambda x, i: F.when(i + 1 < F.size(p), F.when(ends(x, F.get(p, i + 1)), F.concat(x, F.lit("\x01"))).otherwise(x)).otherwise(x))

    whole = F.split(F.array_join(let(pieces, marked), ""), "\x01")
    return F.filter(F.transform(whole, lambda s: F.regexp_replace(s, r"\A\s+|\s+\z", "")), lambda s: s != "")


@dataclass(frozen=True)
class SentenceModel:
    """All types of a model by kind, the best-scored first, as constants of a plan: for models that fit there; with_sentences() reads a table of any size."""

    abbreviations: tuple[str, ...] = ()
    starters: tuple[str, ...] = ()
    collocations: tuple[str, ...] = ()

    @classmethod
    def of(cls, table: DataFrame) -> SentenceModel:
        def best(kind: str) -> tuple[str, ...]:
            return tuple(r[0] for r in table.where(F.col("kind") == kind).orderBy(F.desc("score"), "word").select("word").collect())

        return cls(best("abbreviation"), best("starter"), best("collocation"))

    def sentences(self, text: Column | str) -> Column:
        """Sentences of a text, without the white space around them.

        A text may be cut behind . ! ? (and closing marks) and white space. It isn't before a small letter, nor within a
        collocation; behind a single letter never, and behind an abbreviation only before a word that starts sentences.
        """
        known = lambda words, x: F.array_contains(F.array(*[F.lit(w) for w in words]), x) if words else F.lit(False)

        def ends(piece: Column, following: Column) -> Column:
            last, first, stop = _around(piece, following)
            together = _kept_together(last, known(self.abbreviations, last), known(self.starters, first), known(self.collocations, F.concat_ws(" ", last, first)))
            return _may_end(following) & ~(stop & together)

        return _joined(_pieces(text), ends)


#: Pairs of words kept together that are sent to all tasks, where a settled table has no more.
FEW_PAIRS = 100_000


def with_sentences(docs: DataFrame, model: DataFrame, text: str = "text", settle: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """docs with their sentences as SentenceModel has them, by a model's whole table (learn_sentences()), however large it is.

    Of the pairs of words around texts' full stops the distinct ones meet the model; those it keeps together go back to their texts.
    Texts are told apart by a hash: those that share one share their pairs, which changes nothing, as pairs are judged by themselves.
    """
    key = F.xxhash64(*docs.columns)
    dealt = docs.withColumn("_key", key).repartition(4 * docs.sparkSession.sparkContext.defaultParallelism, "_key")

    def pair(piece: Column, following: Column) -> Column:
        last, first, stop = _around(piece, following)
        return F.when(stop & _may_end(following), F.concat_ws(" ", last, first))  # words have no blanks

    pairs = let(_pieces(text), lambda p: F.array_distinct(F.transform(p, lambda x, i: F.when(i + 1 < F.size(p), pair(x, F.get(p, i + 1))))))
    asked = dealt.select("_key", F.explode(pairs).alias("_pair")).where("_pair IS NOT NULL")
    asked = settle(asked) if settle else asked
    together = asked.select("_pair").distinct().select("_pair", F.substring_index("_pair", " ", 1).alias("_last"), F.substring_index("_pair", " ", -1).alias("_first"))
    for kind, word in (("abbreviation", "_last"), ("starter", "_first"), ("collocation", "_pair")):
        together = together.join(model.where(F.col("kind") == kind).select(F.col("word").alias(word), F.lit(True).alias(kind)).distinct(), word, "left")
    has = lambda kind: F.coalesce(kind, F.lit(False))
    together = together.where(_kept_together(F.col("_last"), has("abbreviation"), has("starter"), has("collocation"))).select("_pair")
    if settle:
        together = settle(together)
        together = together.hint("broadcast") if together.count() <= FEW_PAIRS else together
    kept = asked.join(together, "_pair").groupBy("_key").agg(F.collect_set("_pair").alias("_kept"))

    def ends(piece: Column, following: Column) -> Column:
        last, first, stop = _around(piece, following)
        return _may_end(following) & ~(stop & F.array_contains(F.col("_kept"), F.concat_ws(" ", last, first)))

    found = dealt.join(kept, "_key", "left").withColumn("_kept", F.coalesce("_kept", F.array().cast("array<string>")))
    return found.select(*docs.columns, _joined(_pieces(text), ends).alias("sentences"))


def split_sentences(text: Column | str, model: SentenceModel | None = None) -> Column:
    """Sentences by a model, or by the fixed short forms where there is none."""
    return model.sentences(text) if model else plain_sentences(text)
