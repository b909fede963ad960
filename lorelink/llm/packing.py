"""Packing documents into sequences of a fixed length: best-two-fit over counts by length.

Only the numbers of pieces by length reach the driver, at most as many as a sequence has tokens. There bins are filled
greedily, the longest piece that fits first; then, if a gap is left, the bin's smallest piece gives way to two that fit
the expanded gap more tightly. Equal bins are made together, as a pattern with a multiplicity, so the work follows the
number of lengths, not of documents. A pattern's places are ranges of ranks within a length; a piece finds its place
by its rank. Ranks are taken in slices of a hash, as many as the most frequent length needs, so no length is ever together
in one task. A piece that fills a sequence alone needs no rank and isn't moved.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import kept_by_worker, map_arrow, settled
from .tokens import CachedTokenizer

#: About so many pieces of one length are ranked together.
SLICE_ROWS = 1 << 16
CACHE = "tokenizer"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

def _tokenizer(shared) -> CachedTokenizer:
    """The worker's tokenizer for a broadcast description; its cache lasts from one task to the next."""
    known = kept_by_worker(CACHE)
    if shared.value[0] not in known:
        known.clear()
        known[shared.value[0]] = CachedTokenizer(shared.value[1])
    return known[shared.value[0]]


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, separator: int = 0, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids (array of int) of each piece of every whole text.

    A document is its ids, then the separator; null texts are empty, so that every document has a piece. Only documents
    longer than capacity are cut. tokenizer: path of the file on the driver; its text (a few MB) is broadcast.
    """
    spark = docs.sparkSession
    description = open(tokenizer, encoding="utf-8").read()
    shared = spark.sparkContext.broadcast((zlib.crc32(description.encode()), description))

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = _tokenizer(shared).encode, int(separator).to_bytes(4, "little")
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids]
        for batch in batches:
            columns: list[list] = [[] for _ in names]
            held = 0

            def flush(columns: list[list] = columns) -> pa.RecordBatch:
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=False)], names)
                for c in columns:
                    c.clear()
                return out

            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                for k in range(0, len(ids), 4 * capacity):
                    part = ids[k : k + 4 * capacity]
                    row = (doc_id, k // (4 * capacity), k // 4, len(part) // 4, zlib.crc32(part))
                    for c, v in zip(columns, row + (np.frombuffer(part, "<i4"),) * with_ids, strict=True):
                        c.append(v)
                    held += len(part) * with_ids
                    if held > 8 << 20:
                        yield flush()
                        held = 0
            if columns[0]:
                yield flush()

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), tokenise, PIECES + ", ids array<int>" * with_ids, cache=CACHE)


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Patterns: the lengths in a bin, longest first, and how many such bins. counts: pieces of each length from 1 to capacity."""
    left = {n: c for n, c in counts.items() if c > 0}
    lengths = sorted(left)  # those that are left, ascending
    patterns: list[tuple[list[int], int]] = []

    def remaining(n: int, used: list[int]) -> int:
        return left.get(n, 0) - used.count(n)

    def longest(most: int, used: list[int]) -> int:
        k = bisect_left(lengths, most + 1) - 1
        while k >= 0 and remaining(lengths[k], used) <= 0:
            k -= 1
        return lengths[k] if k >= 0 else 0

    while lengths:
        bin_, gap = [], capacity
        while n := longest(gap, bin_):
            bin_.append(n)
            gap -= n
        if gap and len(bin_) > 1:
            smallest, rest = bin_[-1], bin_[:-1]
            best = _tightest_pair(lengths, rest, remaining, gap + smallest, smallest)
            if best:
                bin_ = sorted([*rest, *best], reverse=True)
        times = min(left[n] // bin_.count(n) for n in set(bin_))
        patterns.append((bin_, times))
        for n in bin_:
            left[n] -= times
        for n in set(bin_):
            if left[n] == 0:
                del left[n]
                del lengths[bisect_left(lengths, n)]
    return patterns


def _tightest_pair(lengths: list[int], used: list[int], remaining, most: int, least: int) -> tuple[int, int] | None:
    """Two pieces that are left whose sum is the largest up to most, and above least."""
    lo, hi = 0, bisect_left(lengths, most) - 1
    best, found = least, None
    while lo <= hi:
        a, b = lengths[lo], lengths[hi]
        if remaining(a, used) <= 0 or a == b and remaining(a, used) < 2 and lo == hi:
            lo += 1
        elif remaining(b, used) <= 0:
            hi -= 1
        elif a + b > most:
            hi -= 1
        elif lo == hi and remaining(a, used) < 2:
            break
        else:
            if a + b > best:
                best, found = a + b, (b, a)
                if best == most:
                    break
            lo += 1
    return found


def place_pieces(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """pieces with sequence_id and offset: bins by best-two-fit, each piece's place gapless after those before it.

    pieces: doc_id, piece, length (1 to capacity) and any more columns; it is read three times, so it should be a table.
    Rows that repeat are packed as often as they stand there.
    """
    spark = pieces.sparkSession
    names = pieces.columns
    totals = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    assert all(1 <= n <= capacity for n in totals), "a piece is longer than a sequence"
    totals.pop(capacity, None)
    slices = -(-max(totals.values(), default=1) // SLICE_ROWS)
    sliced = pieces.where(F.col("length") < capacity).withColumn("_slice", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(slices)).cast("int"))
    counts = sliced.groupBy("length", "_slice").agg(F.count("*").alias("_n"))
    ranges: list[tuple[int, int, int, int]] = []  # length, first rank, first sequence, offset
    ranks = dict.fromkeys(totals, 0)
    sequence = 0
    for bin_, times in best_two_fit(totals, capacity):
        at = 0
        for n in bin_:
            ranges.append((n, ranks[n], sequence, at))
            ranks[n] += times
            at += n
        sequence += times
    by_length: dict[int, list[tuple[int, int, int]]] = {}
    for n, *r in ranges:
        by_length.setdefault(n, []).append(tuple(r))
    places = [(n, [*zip(*sorted(r), strict=True)]) for n, r in by_length.items()]
    table = spark.createDataFrame([(n, *map(list, cols)) for n, cols in places], "length long, _ranks array<long>, _sequences array<long>, _offsets array<long>")

    first = counts.withColumn("_first", F.coalesce(F.sum("_n").over(Window.partitionBy("length").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    number = F.row_number().over(Window.partitionBy("length", "_slice").orderBy("doc_id", "piece", *[c for c in ("start", "ids_crc32") if c in names]))
    ranked = sliced.withColumn("_k", number - 1).join(first.select("length", "_slice", "_first"), ["length", "_slice"])
    ranked = ranked.select(*names, (F.col("_first") + F.col("_k")).alias("_rank"))
    # a few places for each pattern, whose number follows capacity: a table with a row for each length
    found = ranked.join(F.broadcast(table.withColumnRenamed("length", "_length")), F.col("length") == F.col("_length"))
    k = F.size(F.filter("_ranks", lambda r: r <= F.col("_rank")))
    found = found.withColumn("_place", k)
    sequence_id = F.element_at("_sequences", F.col("_place")) + F.col("_rank") - F.element_at("_ranks", F.col("_place"))
    placed = found.select(*names, sequence_id.alias("sequence_id"), F.element_at("_offsets", F.col("_place")).alias("offset"))
    alone = pieces.where(F.col("length") == capacity).select(*names, (F.monotonically_increasing_id() + sequence).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionAll(alone)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, separator: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces of all docs (doc_id, text) with their places in as few sequences of capacity tokens as best-two-fit finds.

    With ids, the pieces have their tokens too; sequence s is its pieces' ids in the order of offset.
    """
    return place_pieces(settled(cut_pieces(docs, tokenizer, capacity, separator, with_ids), "pieces"), capacity)
