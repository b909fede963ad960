"""Document fingerprints: every shingle hash below a fixed fraction of the hash space.

The sketch grows with the text, so sketches of very unequal texts compare without bias: the share of one's hashes that
the other has estimates containment, hashes in common over all hashes estimate resemblance, and the sketch of a union of
texts is the union of their sketches. A text of few shingles keeps all of them and is marked as whole: two whole sketches
compare exactly; in all other cases only the hashes below the threshold count, on both sides, as those above it aren't
known of the larger text.

All of it is DataFrame functions: words, their hashes, shingle hashes of five of them, filter, sort. A value that is used
several times is bound as a lambda's variable, so it is evaluated once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE

#: A hash is kept if it is below 1 / 2**FRACTION_BITS of the 64-bit range.
FRACTION_BITS = 2
#: A text of up to so many distinct shingles keeps all their hashes. Of more, one is below the threshold but for one text in 10,000.
WHOLE = 32


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def _below(hashes: Column, fraction_bits: int) -> Column:
    return F.filter(hashes, lambda x: (x >= 0) & (x <= (1 << (64 - fraction_bits)) - 1))


def _sketch(whole: Column, hashes: Column) -> Column:
    return F.named_struct(F.lit("whole"), whole, F.lit("hashes"), F.array_sort(hashes))


def sketch(text: Column, width: int = 5, fraction_bits: int = FRACTION_BITS) -> Column:
    """whole, hashes (sorted, distinct longs) that the text's shingles leave; words in lower case, cut at ASCII white space.

    Fewer words than `width` are one shingle. Null and empty texts have a whole sketch without hashes. fraction_bits: 2 or more.
    """
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE, -1), lambda w: w != "")

    def shingles(h: Column) -> Column:
        return F.when(F.size(h) >= width, F.transform(F.sequence(F.lit(1), F.greatest(F.size(h) - width + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(h, i, width)))).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    def kept(all_: Column) -> Column:
        few = lambda low: let(F.array_distinct(all_), lambda d: F.when(F.size(d) <= WHOLE, _sketch(F.lit(True), d)).otherwise(_sketch(F.lit(False), low)))
        return let(F.array_distinct(_below(all_, fraction_bits)), lambda low: F.when(F.size(low) > WHOLE, _sketch(F.lit(False), low)).otherwise(few(low)))

    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(shingles(h), kept))


def merged(a: Column, b: Column, fraction_bits: int = FRACTION_BITS) -> Column:
    """The sketch of two texts taken together (shingles across their border aside)."""
    whole = lambda u: a["whole"] & b["whole"] & (F.size(u) <= WHOLE)
    return let(F.array_union(a["hashes"], b["hashes"]), lambda u: F.when(whole(u), _sketch(F.lit(True), u)).otherwise(_sketch(F.lit(False), _below(u, fraction_bits))))


def _comparable(a: Column, b: Column, fraction_bits: int, body: Callable[[Column, Column], Column]) -> Column:
    """body of the hashes that both texts' sketches know of."""
    both = a["whole"] & b["whole"]
    side = lambda x: F.when(both, x["hashes"]).otherwise(_below(x["hashes"], fraction_bits))
    return let(F.named_struct(F.lit("a"), side(a), F.lit("b"), side(b)), lambda s: body(s["a"], s["b"]))


def resemblance(a: Column, b: Column, fraction_bits: int = FRACTION_BITS) -> Column:
    """Hashes in common over all hashes, 0 to 1. Without any to compare, 1 for equal sketches, 0 for others."""

    def ratio(x: Column, y: Column) -> Column:
        return let(F.size(F.array_intersect(x, y)), lambda c: F.when(F.size(x) + F.size(y) == 0, (a["hashes"] == b["hashes"]).cast("double")).otherwise(c / (F.size(x) + F.size(y) - c)))

    return _comparable(a, b, fraction_bits, ratio)


def containment(a: Column, b: Column, fraction_bits: int = FRACTION_BITS) -> Column:
    """The share of a's hashes that b has; 1 if a has no words, null if a has words but no hash below the threshold and b is longer: then nothing is known."""
    nothing = F.when(F.size(a["hashes"]) == 0, F.lit(1.0))
    return _comparable(a, b, fraction_bits, lambda x, y: F.when(F.size(x) == 0, nothing).otherwise(F.size(F.array_intersect(x, y)) / F.size(x)))


def as_text(hashes: Column) -> Column:
    """The hashes of a sketch, 8 bytes each, in order, in base64."""
    digits = F.array_join(F.transform(hashes, lambda x: F.lpad(F.hex(x), 16, "0")), "")
    return F.translate(F.base64(F.unhex(digits)), "\r\n", "")


def _bucket(ids: DataFrame, column: str, rows_per_bucket: int, most: int) -> tuple[Column, int]:
    """An expression that rises with the id and cuts the ids into at most about `most` ranges, and their number.

    Quantiles cut first, into at most 1,024 ranges; each is cut evenly after that. Null ids have bucket -1.
    """
    n = ids.count()
    buckets = max(1, min(most, -(-n // rows_per_bucket)))
    coarse = min(1024, buckets)
    splits = sorted(set(ids.agg(F.percentile_approx(column, [i / coarse for i in range(coarse + 1)], 10_000)).first()[0] or [0]))
    fine = max(1, -(-buckets // coarse))
    edges, id_ = F.array(*[F.lit(x) for x in splits]).cast("array<bigint>"), F.col(column)
    place = F.size(F.filter(edges, lambda s: s <= id_))

    def inside(k: Column) -> Column:
        lo, hi = F.get(edges, k - 1).cast("double"), F.get(edges, k).cast("double")
        share = F.floor((id_.cast("double") - lo) / (hi - lo) * fine)
        return k.cast("long") * fine + F.coalesce(F.greatest(F.lit(0), F.least(F.lit(fine - 1), share)), F.lit(0))

    return F.when(id_.isNull(), F.lit(-1).cast("long")).otherwise(let(place, inside)), buckets


def with_next(docs: DataFrame, columns: list[str], id_column: str = "doc_id", made: dict[str, Column] | None = None, rows_per_bucket: int = 200, most: int = 1_000_000) -> DataFrame:
    """docs with next_<column> of the row that follows in descending order of ids, the first following the last.

    Rows are shuffled once, by ranges of ids; the first row of each range is also sent to the range before. There are at
    most about `most` ranges, whatever the size, and the table of their first ids (two numbers each) is what is broadcast.
    Columns that `made` has are made of a row once it is in its place, so they aren't shuffled; each has its next_, too.
    Null ids come last; rows with equal ids stand in the order of a hash of the columns.
    """
    bucket, _ = _bucket(docs.select(id_column), id_column, rows_per_bucket, most)
    heads = docs.select(F.col(id_column).alias("_head"), bucket.alias("_b")).groupBy("_b").agg(F.max("_head").alias("_head"))
    order = Window.orderBy(F.desc("_b"))
    heads = heads.select("_head", F.lag("_b").over(order).alias("_before"), F.last("_b").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_last"))
    heads = heads.select("_head", F.coalesce("_before", "_last").alias("_to"))
    both = docs.withColumn("_own", bucket).join(F.broadcast(heads), docs[id_column].eqNullSafe(heads["_head"]), "left")
    places = F.when(F.col("_to").isNull(), F.array(F.struct(F.col("_own").alias("_b"), F.lit(0).alias("_guest")))).otherwise(F.array(F.struct(F.col("_own").alias("_b"), F.lit(0).alias("_guest")), F.struct(F.col("_to").alias("_b"), F.lit(1).alias("_guest"))))
    both = both.select(*docs.columns, F.inline(places)).repartition("_b").withColumns(made or {})
    line = Window.partitionBy("_b").orderBy("_guest", F.desc_nulls_last(id_column), F.xxhash64(*columns))
    following = both.withColumns({f"next_{c}": F.lead(c).over(line) for c in [*columns, *(made or {})]})
    return following.where("_guest = 0").drop("_b", "_guest")


def edited_fingerprints(docs: DataFrame, width: int = 5) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness.

    docs: doc_id, text (null: empty). The edited text has its last third of code points (rounded down) replaced by as
    many of the start of the next document by descending doc_id, or by all of it if it is shorter. Returns doc_id,
    n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, contained_edited, contained_next (the
    share of the text's hashes that the other has; null where nothing can be compared), one row for each row of docs.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    both = with_next(base, ["text"], made={"sketch": sketch(F.col("text"), width)})
    n = F.char_length("text")
    both = both.withColumns({"n_chars": n.cast("long"), "edited": F.concat(F.substring(F.col("text"), F.lit(1), n - F.floor(n / 3).cast("int")), F.substring(F.col("next_text"), F.lit(1), F.floor(n / 3).cast("int")))})
    both = both.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "sketch", "next_sketch", sketch(F.col("edited"), width).alias("edited_sketch"))
    h, e, x = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return both.select("doc_id", "n_chars", "edited_sha256", as_text(h["hashes"]).alias("fingerprint"), as_text(e["hashes"]).alias("edited_fingerprint"), resemblance(h, e).alias("near_edited"), resemblance(h, x).alias("near_next"), containment(h, e).alias("contained_edited"), containment(h, x).alias("contained_next"))
