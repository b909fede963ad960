"""Derived relations of a knowledge base."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import share
from ..functions.text import tokenize, word_ngrams


def title_ngram_counts(page: DataFrame, head: bool = False) -> DataFrame:
    """lang, n, ngram, score: in how many titles an n-gram stands, each place counted.

    head: only n-grams that a longer title begins with, as the service counted them.
    """
    grams = page.select("lang", F.explode(word_ngrams(tokenize("title"), proper=head)).alias("ngram"))
    counted = grams.groupBy("lang", "ngram").agg(F.count("*").alias("score"))
    return counted.select("lang", F.size(F.split("ngram", " ")).alias("n"), "ngram", "score")


def page_label_proportion(page_label: DataFrame) -> DataFrame:
    """Each label's share of its page's occurrences, 0 if there are none."""
    total = F.sum("occurrences").over(Window.partitionBy("lang", "page_id"))
    return page_label.withColumn("proportion", share("occurrences", total))


def last_by_line(df: DataFrame, keys: list[str], line: str = "line_no") -> DataFrame:
    """Of rows with the same keys the one of the last line."""
    values = [c for c in df.columns if c not in (*keys, line)]
    return df.groupBy(*keys).agg(*[F.max_by(c, line).alias(c) for c in values])


def norm_index(label: DataFrame) -> DataFrame:
    """lang, norm_label, labels (sorted): which labels share a normal form."""
    return label.groupBy("lang", "norm_label").agg(F.array_sort(F.collect_set("label")).alias("labels"))


def grouped(df: DataFrame, keys: list[str], value: str, name: str, order: str = "pos") -> DataFrame:
    """Values by key as an array in the order of `order`."""
    return df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias(name))


def missing_pages(sense: DataFrame, page: DataFrame) -> DataFrame:
    """Integrity: senses whose page doesn't exist."""
    return sense.join(page.select("lang", F.col("page_id").alias("sense_id")), ["lang", "sense_id"], "left_anti").select("lang", "label", "sense_id")


#: A bitmap of labels has at most 2 to this many bits (8 MB) for each language.
MOST_BITS = 26


def label_bits(labels: int) -> int:
    """Bits of a bitmap of so many labels, as a power of two: 16 for each, one bucket at least, MOST_BITS at most."""
    return min(MOST_BITS, max(15, (16 * labels).bit_length()))


def label_slot(lang: Column | str, norm_label: Column | str, bits: Column | int) -> Column:
    """The place of a normal form in its language's bitmap, from 1."""
    size = F.shiftleft(F.lit(1).cast("long"), bits) if isinstance(bits, int) else F.call_function("shiftleft", F.lit(1).cast("long"), bits)
    return F.pmod(F.xxhash64(lang, norm_label), size) + 1


def label_tokens(label: Column | str) -> Column:
    """How many tokens an n-gram may have that is this label."""
    return F.size(tokenize(F.replace(label, F.lit("-"), F.lit(" "))))


def label_bitmap(label: DataFrame, bits: int = 22) -> DataFrame:
    """lang, bits, longest, bucket, bitmap: which places labels' normal forms take, in buckets of 4 KB; and the tokens of the bucket's longest label.

    A normal form whose place is free is no label; one whose place is taken may be one. Built in one aggregate whose
    result is bounded by `bits`, whatever the number of labels.
    """
    slot = label_slot("lang", "norm_label", bits)
    tokens = label_tokens("label")
    rows = label.select("lang", F.bitmap_bucket_number(slot).alias("bucket"), F.bitmap_bit_position(slot).alias("_p"), tokens.alias("_t"))
    made = rows.groupBy("lang", "bucket").agg(F.bitmap_construct_agg("_p").alias("bitmap"), F.max("_t").alias("longest"))
    return made.select("lang", F.lit(bits).alias("bits"), "longest", "bucket", "bitmap")
