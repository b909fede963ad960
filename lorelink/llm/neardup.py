"""Near duplicates by the shingles that texts share: SimHash links first, an exact self-join of sets by prefixes for the rest.

A text is the set of its five-word shingles' hashes; two texts are near copies if their sets' Jaccard similarity is at
least `share`. SimHash fingerprints joined by tries (simhash.py) give likely pairs; 64 bits miss most pairs near the limit
of 0.8, so an exact join completes them: all sets are put in one order, in which frequent shingles come last. Two near
copies have a shingle in common among the first n - ceil(share * n) + 1 of each, so those are dealt into blocks, one for
each shingle, and no pair is missed; which shingles count as frequent (learnt on a bounded sample) decides how large
blocks are, not what is found.

A candidate pair is first held against a bound: each set leaves the parities of its hashes by their last bits, and the
parities of two sets differ in no more places than the sets differ in hashes. Pairs within the bound are confirmed on the
whole sets, and only confirmed pairs make components. Whole sets are made for the texts of such pairs alone.

Large groups of near copies don't give all of their pairs: a block first gives a forest of pairs within the bound, and of
these and the SimHash pairs each set confirms the likeliest PARTNERS with earlier ones. What that joins needs no further pairs
among itself, so the second time blocks give only pairs between different components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, settled, shuffle_partitions, utf8
from .simhash import SEED, _join_labels, block_links, components, fingerprint, pieces_beyond, shingle_hashes

#: Documents that frequent shingles are learnt on, and how many of these are kept.
SAMPLE, FREQUENT = 10_000, 200_000
#: Bits of the map of texts whose whole sets are needed, at least and at most.
BITS = (1 << 16, 1 << 27)
#: Bits of parities that a set has in blocks.
MARK = 1024
#: Likely pairs with earlier sets that a set confirms at first.
PARTNERS = 8

Frequent = tuple[np.ndarray, np.ndarray]


def shingle_set(text: bytes, width: int = 5) -> np.ndarray:
    """Distinct shingle hashes, ascending; none without words."""
    parts = list(shingle_hashes(text, width))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def set_key(hashes: np.ndarray) -> int:
    """One 64-bit key for a set, as a signed number."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64))


def prefix(hashes: np.ndarray, share: float, frequent: Frequent) -> np.ndarray:
    """The first n - ceil(share * n) + 1 hashes: rare ones by value, then frequent ones by their count."""
    n = len(hashes)
    if not n:
        return hashes
    known, counts = frequent
    if len(known):
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        hot = known[at] == hashes
        last, c = hashes[hot], counts[at[hot]]
        hashes = np.concatenate([hashes[~hot], last[np.lexsort((last, c))]])
    return hashes[: n - int(np.ceil(share * n - 1e-9)) + 1]


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[bytes]:
    data, ends = utf8(batch.column(column))
    view = memoryview(data)
    return (bytes(view[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True))


def frequent_shingles(docs: DataFrame, id_column: str, text: str, width: int) -> Frequent:
    """Hashes that at least 3 documents of a sample have, ascending, and in how many; the most frequent if there are too many."""
    count = docs.count()
    place = F.xxhash64(F.lit(SEED), F.col(id_column), F.col(text)).bitwiseAND(F.lit((1 << 30) - 1)) / float(1 << 30)
    sample = docs.where(place < SAMPLE / max(1, count)).select(F.col(text).alias("text"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, width) for t in _texts(batch, 0)]
            if sets:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], ["h"])

    often = map_arrow(sample, hashed, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n >= 3").orderBy(F.desc("n"), "h").limit(FREQUENT).toArrow()
    known, counts = often.column("h").to_numpy().view(np.uint64), often.column("n").to_numpy()
    order = np.argsort(known)
    return known[order].copy(), counts[order].copy()


def parities(hashes: np.ndarray) -> bytes:
    """A bit for each value of the hashes' last bits (as many as the set has hashes, MARK at least): whether it occurs an odd number of times."""
    width = max(MARK, 1 << max(0, len(hashes) - 1).bit_length())
    odd = np.bincount((hashes & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def mark(odd: bytes) -> bytes:
    """Parities folded to MARK bits: the same bound, looser for large sets."""
    return np.bitwise_xor.reduce(np.frombuffer(odd, np.uint64).reshape(-1, MARK // 64), axis=0).tobytes()


def least_difference(x: bytes, y: bytes) -> int:
    """Places in which the parities of two sets differ: no more than the hashes that only one of the sets has."""
    p, q = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    p, q = (p, q) if len(p) >= len(q) else (q, p)
    return int(np.bitwise_count(np.bitwise_xor.reduce(p.reshape(-1, len(q)), axis=0) ^ q).sum())


def most_difference(n: int, m: int, share: float) -> int:
    """How many hashes only one of two near sets of these sizes can have."""
    return n + m - 2 * int(np.ceil(share / (1 + share) * (n + m) - 1e-9))


def set_rows(docs: DataFrame, id_column: str, text: str, width: int, share: float) -> DataFrame:
    """id, th (hash of the text), unit (key of its set), n (size of the set), fp (SimHash of the set), odd (parities), mark, prefix of each row of docs."""
    frequent = frequent_shingles(docs, id_column, text, width)
    kind = dict(docs.dtypes)[id_column]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "th", "unit", "n", "fp", "odd", "mark", "prefix"]
        for batch in batches:
            unit, n, fp, odd, first = [], [], [], [], []
            for t in _texts(batch, 2):
                s = shingle_set(t, width)
                unit.append(set_key(s))
                n.append(len(s))
                fp.append(fingerprint([s]))
                odd.append(parities(s))
                first.append(prefix(s, share, frequent).view(np.int64))
            ends = np.cumsum([0, *map(len, first)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(first) if first else np.zeros(0, np.int64)))
            keys = pa.array(np.array(fp, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(unit, pa.int64()), pa.array(n, pa.int32()), keys, pa.array(odd, pa.binary()), pa.array(map(mark, odd), pa.binary()), lists], names)

    rows = docs.select(F.col(id_column).alias("id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    return map_arrow(rows, keyed, f"id {kind}, th long, unit long, n int, fp long, odd binary, mark binary, prefix array<long>")


def dealt(rows: DataFrame) -> DataFrame:
    """tok, n, unit, pos of each shingle in the prefixes of rows; a set that a task sees again isn't dealt again."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            unit, n, lists = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            new = np.zeros(len(unit), bool)
            for i, u in enumerate(unit.tolist()):
                if u not in seen:
                    seen.add(u)
                    new[i] = True
            ends = lists.offsets.to_numpy()
            sizes = np.where(new, np.diff(ends), 0)
            values = lists.values.to_numpy()
            rows = np.repeat(np.arange(len(unit)), sizes)
            pos = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            for i in range(0, len(rows), 1 << 20):
                r, p = rows[i : i + (1 << 20)], pos[i : i + (1 << 20)]
                yield pa.RecordBatch.from_arrays([pa.array(values[ends[r] + p]), pa.array(n[r]), pa.array(unit[r]), pa.array(p.astype(np.int32))], ["tok", "n", "unit", "pos"])

    return map_arrow(rows.select("unit", "n", "prefix"), deal, "tok long, n int, unit long, pos int")


def _blocks(batches: Iterator[pa.RecordBatch], least: int = 100_000) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """Columns (marks as rows of words) in portions of whole blocks (runs of the first column), and the start and end of each row's block."""
    held: list[list[np.ndarray]] = []
    count = 0

    def cut(last: bool) -> tuple[list[np.ndarray], list[np.ndarray]]:
        cols = [np.concatenate(x) for x in zip(*held, strict=True)]
        at = len(cols[0]) if last else int(np.searchsorted(cols[0], cols[0][-1]))
        return [c[:at] for c in cols], [c[at:] for c in cols]

    def whole(cols: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        starts = np.flatnonzero(np.append(True, cols[0][1:] != cols[0][:-1]))
        sizes = np.diff(np.append(starts, len(cols[0])))
        return cols, np.repeat(starts, sizes), np.repeat(starts + sizes, sizes)

    for batch in batches:
        if batch.num_rows:
            held.append([_marks(c) if pa.types.is_binary(c.type) else c.to_numpy(zero_copy_only=False) for c in batch.columns])
            count += batch.num_rows
        if count >= least:
            done, rest = cut(False)
            held, count = [rest], len(rest[0])
            least = max(100_000, 2 * count)
            if len(done[0]):
                yield whole(done)
    if count:
        yield whole(cut(True)[0])


class _Block:
    """Sets in portions of whole blocks, by size within a block, and the tests of pairs i < j of places in them."""

    def __init__(self, n: np.ndarray, pos: np.ndarray, marks: np.ndarray, share: float) -> None:
        self.n, self.pos, self.marks, self.share = n.astype(np.int64), pos, marks, share

    def sizes(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return self.n[i] >= self.share * self.n[j] - 1e-9

    def near(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether so much of both sets is left from this shingle on that they can be near, if it is the first they share, and the marks allow it."""
        both = self.n[i] + self.n[j]
        need = np.ceil(self.share / (1 + self.share) * both - 1e-9)
        ok = np.minimum(self.n[i] - self.pos[i], self.n[j] - self.pos[j]) >= need
        at = np.flatnonzero(ok)
        ok[at] = np.bitwise_count(self.marks[i[at]] ^ self.marks[j[at]]).sum(axis=1, dtype=np.int64) <= both[at] - 2 * need[at]
        return ok


def _several(labels: np.ndarray, start: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Those places `at` whose block has several labels."""
    heads = np.unique(start)
    mixed = np.minimum.reduceat(labels, heads) < np.maximum.reduceat(labels, heads)
    return at[mixed[np.searchsorted(heads, start[at])]]


def _marks(batch: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(batch.to_pylist()), np.uint64).reshape(-1, MARK // 64)


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def forests(blocks: DataFrame, share: float) -> DataFrame:
    """a, b: for each block of rows (tok, n, unit, pos, mark) by n and unit, pairs that can be near and join all that such pairs join."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, n, unit, pos, marks), start, end in _blocks(batches):
            block, labels = _Block(n, pos, marks, share), np.arange(len(n))
            i, step = np.arange(len(n)), 1
            while len(i := i[i + step < end[i]]):
                i = i[block.sizes(i, i + step)]  # sizes only grow from here
                if step & (step - 1) == 0:
                    i = _several(labels, start, i)
                x = i[labels[i] != labels[i + step]]
                x = x[block.near(x, x + step)]
                if len(x):
                    _join_labels(labels, x, x + step)
                    yield _pairs(unit[x], unit[x + step])
                step += 1

    return map_arrow(blocks, grow, "a long, b long").distinct()


def crossing(blocks: DataFrame, share: float) -> DataFrame:
    """a, b: for each block of rows (tok, n, unit, pos, mark, root) by n and unit, all pairs with different roots that can be near."""

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, n, unit, pos, marks, root), start, end in _blocks(batches):
            block = _Block(n, pos, marks, share)
            i, step = _several(root, start, np.arange(len(n))), 1
            while len(i := i[i + step < end[i]]):
                i = i[block.sizes(i, i + step)]
                x = i[root[i] != root[i + step]]
                x = x[block.near(x, x + step)]
                if len(x):
                    yield _pairs(unit[x], unit[x + step])
                step += 1

    return map_arrow(blocks, cross, "a long, b long").distinct()


def fingerprint_pairs(units: DataFrame, errors: int = 4) -> DataFrame:
    """a, b: sets with equal fingerprints, each with the least, and those that the fingerprints' trie self-join links."""
    first = settled(units.groupBy("fp").agg(F.min("unit").alias("first")), "distinct-fingerprints")
    links = block_links(first.select("fp"), errors, pieces_beyond(first.count(), errors))
    far = links.join(first, "fp").select("root", F.col("first").alias("x")).join(first.select(F.col("fp").alias("root"), F.col("first").alias("y")), "root")
    same = units.join(first, "fp").where("unit <> first").select(F.col("first").alias("x"), F.col("unit").alias("y"))
    return same.unionAll(far.select("x", "y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def possible(pairs: DataFrame, units: DataFrame, share: float) -> DataFrame:
    """a, b, d: those pairs whose parities differ in at most as many places as near copies of their sizes can, and in how many.

    a is the set that comes first by size and key.
    """
    side = lambda s: units.select(F.col("unit").alias(s), F.col("n").alias(f"n{s}"), F.col("odd").alias(f"odd{s}"))
    x = pairs.join(side("a"), "a").join(side("b"), "b")
    first = F.struct("na", "a") < F.struct("nb", "b")
    x = x.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("b"), "na", "nb", "odda", "oddb")

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = np.array([least_difference(p.as_py(), q.as_py()) for p, q in zip(batch.column(4), batch.column(5), strict=True)], np.int32)
            most = [most_difference(n, m, share) for n, m in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            ok = d <= np.array(most, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), batch.column(1).filter(pa.array(ok)), pa.array(d[ok])], ["a", "b", "d"])

    return map_arrow(x, bound, "a long, b long, d int")


def whole_sets(docs: DataFrame, needed: DataFrame, id_column: str, text: str, width: int) -> DataFrame:
    """unit, hashes of the rows of docs that `needed` (unit, id, th: a row for each set) names.

    A map of the needed rows' hashes, 8 bits a row within BITS, keeps nearly all other texts from the shuffle; where
    there are too many rows for that, more texts are shuffled, and the join with `needed` leaves the same ones.
    """
    key = lambda i, th: F.xxhash64(i.isNull(), i, th)
    needed = settled(needed.select("unit", key(F.col("id"), F.col("th")).alias("key")), "needed-sets")
    bits = min(BITS[1], max(BITS[0], 1 << (8 * needed.count()).bit_length()))
    place = F.col("key").bitwiseAND(F.lit(bits - 1))
    words = needed.groupBy(F.shiftrightunsigned(place, 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(key & 31 AS INT))")).alias("bits")).toArrow()
    map_ = np.zeros(bits >> 5, np.int64)
    map_[words.column("w").to_numpy()] = words.column("bits").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(map_.astype(np.uint32))  # 16 MB at most

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            k = batch.column(0).to_numpy()
            at = np.flatnonzero((shared.value[(k & (bits - 1)) >> 5] >> (k & 31).astype(np.uint32)) & 1)
            new = []
            for i, x in zip(at.tolist(), k[at].tolist(), strict=True):
                if x not in seen:  # rows that repeat an id and its text
                    seen.add(x)
                    new.append(i)
            yield batch.take(pa.array(new, pa.int64()))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t, width).tobytes() for t in _texts(batch, 1)], pa.binary())], ["unit", "hashes"])

    texts = docs.select(key(F.col(id_column), F.xxhash64(text)).alias("key"), F.col(text).alias("text"))
    some = map_arrow(texts, marked, "key long, text string").join(needed, "key").dropDuplicates(["unit"])
    return map_arrow(some.select("unit", "text"), hashed, "unit long, hashes binary")


def confirmed(pairs: DataFrame, sets: DataFrame, share: float) -> DataFrame:
    """a, b: the pairs whose whole sets have a Jaccard similarity of at least `share`."""
    x = pairs.join(sets.select(F.col("unit").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("unit").alias("b"), F.col("hashes").alias("y")), "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                p, q = (p, q) if len(p) <= len(q) else (q, p)
                both = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())
                keep.append(both >= share * (len(p) + len(q) - both) - 1e-9)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return map_arrow(x.select("a", "b", "x", "y"), compare, "a long, b long")


def one_of_each(docs: DataFrame, share: float = 0.8, width: int = 5, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of docs, with all its columns, of each component that near copies make: the one with the least id.

    Ids that are null come last, and texts of one id go by their hash; so a component leaves exactly one row, and rows
    that repeat an id and its text are one. Texts without words, null ones among them, are copies of one another.
    """
    spark = docs.sparkSession
    rows = settled(set_rows(docs, id_column, text, width, share), "shingle-prefixes")
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("best")
    units = settled(rows.groupBy("unit").agg(best, F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("odd").alias("odd"), F.first("mark").alias("mark")), "shingle-sets")

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, _, _ in _blocks(batches):
            new = np.append(True, (cols[0][1:] != cols[0][:-1]) | (cols[2][1:] != cols[2][:-1]))  # a set that several tasks dealt
            cols = [c[new] for c in cols]
            starts = np.flatnonzero(np.append(True, cols[0][1:] != cols[0][:-1]))
            sizes = np.diff(np.append(starts, len(cols[0])))
            more = np.repeat(sizes > 1, sizes)
            yield pa.RecordBatch.from_arrays([pa.array(c[more]) for c in cols], ["tok", "n", "unit", "pos"])

    def sorted_(df: DataFrame) -> DataFrame:
        return df.repartition(shuffle_partitions(spark), "tok").sortWithinPartitions("tok", "n", "unit")

    blocks = map_arrow(sorted_(dealt(rows)), several, "tok long, n int, unit long, pos int")
    # what a block's sets need there is little, as most shingles of a prefix are in one set alone
    blocks = settled(blocks.join(units.select("unit", "mark"), "unit").select("tok", "n", "unit", "pos", "mark"), "marked-blocks")

    def checked(pairs: DataFrame) -> DataFrame:
        pairs = settled(pairs, "likely-pairs")
        ends = pairs.select(F.explode(F.array("a", "b")).alias("unit")).distinct()
        sets = whole_sets(docs, units.join(ends, "unit").select("unit", "best.id", "best.th"), id_column, text, width)
        return confirmed(pairs, settled(sets, "whole-sets"), share)  # components() writes them

    likely = possible(forests(sorted_(blocks), share).unionAll(fingerprint_pairs(units)).distinct(), units, share)
    rank = F.row_number().over(Window.partitionBy("b").orderBy("d", "a"))
    likeliest = likely.withColumn("_k", rank).where(F.col("_k") <= PARTNERS).select("a", "b")  # the others are met again below
    roots = components(checked(likeliest), "a", "b")
    rooted = blocks.join(roots.withColumnRenamed("node", "unit"), "unit", "left").select("tok", "n", "unit", "pos", "mark", F.coalesce("root", "unit").alias("root"))
    second = checked(possible(crossing(sorted_(rooted), share), units, share).select("a", "b"))
    # the first round's forest stands for its pairs
    roots = components(second.unionAll(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))), "a", "b")
    named = units.select("unit", "best").join(roots.withColumnRenamed("node", "unit"), "unit", "left")
    stay = named.groupBy(F.coalesce("root", "unit").alias("root")).agg(F.min("best").alias("best")).select("best.*")
    key = lambda c: F.xxhash64(F.col(c).isNull(), F.col(c))
    marks = stay.select(key("id").alias("__key"), F.col("th").alias("__text"))
    marked = docs.withColumn("__key", key(id_column)).withColumn("__text", F.xxhash64(text))
    return marked.join(marks, ["__key", "__text"], "left_semi").dropDuplicates(["__key", "__text"]).select(*docs.columns)
