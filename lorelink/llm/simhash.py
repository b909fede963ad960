"""SimHash near duplicates: fingerprints, an exact self-join by tries, and components.

Texts become 64-bit fingerprints. Of the distinct fingerprints, those that differ in at most `errors` bits are linked:
the bits are cut into errors + 1 pieces or more, two near fingerprints agree in at least one choice of pieces, so each
fingerprint is dealt to one block for every choice. Within each block a binary trie of the sorted fingerprints is joined
with itself: pairs of nodes go down together, add up the bits in which they differ, and are dropped beyond the budget; the
tries of all blocks that a task has at hand go down at the same time. A block gives a forest (each fingerprint and its root), never all pairs. Components of the forests' edges are found by
alternating stars on tables in the shared folder; nothing is collected.

Copies share a fingerprint and are one row in all of this, however many they are. The number of pieces follows the number
of fingerprints, so that blocks stay small; the result is the same for any number.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, settled, shuffle_partitions, utf8

SEED = 42
#: Parts into which the members of a component are dealt.
SLICES = 32
#: Rows that Spark may send to the driver for a broadcast; it goes by the size of files, which tells little of their rows'.
BROADCAST = 100_000


def shingle_hashes(text: bytes, width: int = 4, portion: int = 1 << 16) -> Iterator[np.ndarray]:
    """XXH64 of each shingle of `width` words in lower case (A-Z), in portions; of the whole sequence if it is shorter, none without words."""
    words = b" ".join(text.lower().split())
    if not words:
        return
    gaps = np.flatnonzero(np.frombuffer(words, np.uint8) == 32)
    n = len(gaps) + 2 - width
    digest = xxhash.xxh64_intdigest
    if n <= 1:
        yield np.array([digest(words, SEED)], np.uint64)
        return
    for lo in range(0, n, portion):
        hi = min(n, lo + portion)
        starts = (gaps[max(0, lo - 1) : hi - 1] + 1).tolist()
        ends = gaps[lo + width - 1 : hi + width - 1].tolist()
        if lo == 0:
            starts.insert(0, 0)
        if hi == n:
            ends.append(len(words))
        yield np.fromiter((digest(words[a:b], SEED) for a, b in zip(starts, ends, strict=True)), np.uint64, hi - lo)


def fingerprint(hashes: Iterable[np.ndarray]) -> int:
    """A bit is 1 if it is set in over half of the hashes, which come in portions."""
    counts, total = np.zeros(64, np.int64), 0
    for part in hashes:
        total += len(part)
        bits = np.unpackbits(np.ascontiguousarray(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for i in range(0, len(bits), 250):  # sums of up to 250 fit a byte, which adds faster
            counts += bits[i : i + 250].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(counts * 2 > total, bitorder="little").view("<u8")[0]) if total else 0


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text: str = "text", width: int = 4) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a long) of every whole text; null and empty texts have 0."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = utf8(batch.column(1))
            view = memoryview(data)
            out = np.fromiter((fingerprint(shingle_hashes(bytes(view[a:b]), width)) for a, b in zip(ends[:-1], ends[1:], strict=True)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], ["doc_id", "fp"])

    return map_arrow(docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text")), hashed, "doc_id long, fp long")


def choices(errors: int, more: int = 0) -> list[int]:
    """Masks of the bits that two fingerprints within `errors` must share in at least one case: more + 1 of errors + 1 + more pieces."""
    n = errors + 1 + more
    edges = [64 * i // n for i in range(n + 1)]
    pieces = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return [sum(c) for c in combinations(pieces, more + 1)]


def _join_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the classes of a[i] and b[i]; a label is the least place in its class, so far as edges were seen."""
    while len(a):
        x, y = labels[a], labels[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        np.minimum.at(labels, high, low)
        while not np.array_equal(up := labels[labels], labels):
            labels[:] = up
        open_ = labels[a] != labels[b]
        a, b = a[open_], b[open_]


def pieces_beyond(count: int, errors: int, most: int = 2048) -> int:
    """How many pieces more than errors + 1 leave blocks of `count` fingerprints a mean size of at most `most`; 3 at most."""
    more = 0
    while more < 3 and count >> (64 * (more + 1) // (errors + 1 + more)) > most:
        more += 1
    return more


def _middle(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.uint64) -> np.ndarray:
    """The first place in each range whose value has the bit; the range's values agree in all bits above it."""
    lo, hi = lo.copy(), hi.copy()
    while len(at := np.flatnonzero(lo < hi)):
        m = (lo[at] + hi[at]) >> 1
        one = (values[m] & bit) != 0
        hi[at[one]] = m[one]
        lo[at[~one]] = m[~one] + 1
    return lo


def trie_labels(values: np.ndarray, errors: int, starts: np.ndarray | None = None, limit: int = 1 << 20, visited: list[int] | None = None) -> np.ndarray:
    """Class of each of the fingerprints, which links of at most `errors` differing bits within a block make.

    Blocks begin at `starts` (one block, if not given); each has sorted distinct values. A trie's nodes are ranges of
    `values`; a node of one fingerprint is a leaf, where two meet their remaining bits are added at once. Pairs of nodes
    are kept on a stack in portions of at most `limit`, so memory is bounded. `visited` gets the number of pairs of each
    portion.
    """
    labels = np.arange(len(values))
    lo = np.zeros(1, np.int64) if starts is None else starts.astype(np.int64)
    hi = np.append(lo[1:], len(values))
    stack = [(0, lo, hi, lo, hi, np.zeros(len(lo), np.int64))]
    while stack:
        depth, alo, ahi, blo, bhi, err = stack.pop()
        if visited is not None:
            visited.append(len(alo))
        leaf = (ahi - alo == 1) & (bhi - blo == 1)
        if leaf.any():
            i, j = alo[leaf], blo[leaf]
            near = (labels[i] != labels[j]) & (np.bitwise_count(values[i] ^ values[j]) <= errors)
            _join_labels(labels, i[near], j[near])
            alo, ahi, blo, bhi, err = (x[~leaf] for x in (alo, ahi, blo, bhi, err))
        if not len(alo):
            continue
        bit = np.uint64(1 << (63 - depth))
        same = alo == blo
        am = _middle(values, alo, ahi, bit)
        bm = np.where(same, am, 0)
        bm[~same] = _middle(values, blo[~same], bhi[~same], bit)
        parts = [(alo, am, blo, bm, err), (am, ahi, bm, bhi, err), (alo, am, bm, bhi, err + 1), tuple(x[~same] for x in (am, ahi, blo, bm, err + 1))]
        nodes = [np.concatenate([p[i] for p in parts]) for i in range(5)]
        kept = (nodes[0] < nodes[1]) & (nodes[2] < nodes[3]) & (nodes[4] <= errors)
        kept &= (nodes[0] != nodes[2]) | (nodes[1] - nodes[0] > 1)  # a fingerprint with itself
        nodes = [x[kept] for x in nodes]
        for i in range(0, len(nodes[0]), limit):
            stack.append((depth + 1, *(x[i : i + limit] for x in nodes)))
    return labels


def block_links(fps: DataFrame, errors: int, more: int = 0) -> DataFrame:
    """fp, root: forests over the distinct fingerprints of `fps` (column fp), a forest for each block."""
    masks = [m - (1 << 64) if m >> 63 else m for m in choices(errors, more)]
    dealt = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("_c", "_v"))
    sorted_ = dealt.repartition(shuffle_partitions(fps.sparkSession), "_c", "_v").sortWithinPartitions("_c", "_v")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fp, change in _whole_blocks(batches):
            starts = np.flatnonzero(change)
            values = fp.view(np.uint64).copy()
            values = values[np.lexsort((values, np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(fp))))))]
            labels = trie_labels(values, errors, starts)
            linked = np.flatnonzero(labels != np.arange(len(labels)))
            if len(linked):
                yield pa.RecordBatch.from_arrays([pa.array(values[linked].view(np.int64)), pa.array(values[labels[linked]].view(np.int64))], ["fp", "root"])

    return map_arrow(sorted_.select("fp", "_c", "_v"), join, "fp long, root long")


def _whole_blocks(batches: Iterator[pa.RecordBatch], least: int = 50_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Fingerprints in portions of whole blocks, and where a block begins."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    count = 0

    def joined() -> tuple[np.ndarray, np.ndarray]:
        fp, c, v = (np.concatenate(x) for x in zip(*held, strict=True))
        change = np.ones(len(fp), bool)
        change[1:] = (c[1:] != c[:-1]) | (v[1:] != v[:-1])
        return fp, change, c, v

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)))
        count += batch.num_rows
        if count >= least:
            fp, change, c, v = joined()
            last = int(np.flatnonzero(change)[-1])
            held, count = [(fp[last:], c[last:], v[last:])], len(fp) - last
            if last:
                yield fp[:last], change[:last]
            least = max(50_000, 2 * count)
    if count:
        yield joined()[:2]


def met(df: DataFrame, rows: int) -> DataFrame:
    """df for a join, by shuffle if one of its sides has more than BROADCAST rows: `rows` is the greater count."""
    return df.hint("merge") if rows > BROADCAST else df


def class_ids(members: DataFrame, rows: int) -> DataFrame:
    """fp, component_id (the least `first` of those with the same root) of each of `rows` members (fp, first, root).

    A component may have very many members: they are dealt into slices, and its id is sent to those that it has, so never to more
    than there are members.
    """
    sliced = members.withColumn("_slice", F.pmod(F.xxhash64("fp"), F.lit(SLICES)))
    least = sliced.groupBy("root", "_slice").agg(F.min("first").alias("first"))
    least = least.groupBy("root").agg(F.min("first").alias("component_id"), F.collect_list("_slice").alias("_slices"))
    return sliced.join(met(least.select("root", "component_id", F.explode("_slices").alias("_slice")), rows), ["root", "_slice"]).select("fp", "component_id")


def components(edges: DataFrame, a: str = "fp", b: str = "root", rounds: int = 50) -> DataFrame:
    """node, root: the least node that each node of `edges` reaches. Large and small stars alternate until nothing changes.

    Each round's edges are written to the shared folder. Minima are combined before the shuffle; a node with very many
    edges meets one row in the join, which Spark can split.
    """
    now = settled(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    before = state(now)
    for _ in range(rounds):
        if not before[0]:
            break
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("m"))
        large = both.join(met(least, before[0]), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(met(least, before[0]), "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionAll(least.select("u", F.col("m").alias("v"))).distinct()
        now = settled(small, "edges")
        after = state(now)
        if after == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = after
    else:
        raise RuntimeError(f"components didn't settle within {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, errors: int = 4, width: int = 4, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the least doc_id that links reach, itself included), one row for each row of docs.

    Texts without words have fingerprint zero and are linked like any other. Rows with a null id are linked too; their
    component's id is the least that isn't null, null if there is none.
    """
    fps = settled(fingerprints(docs, id_column, text, width), "fingerprints")
    first = settled(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    count = first.count()
    roots = components(block_links(first.select("fp"), errors, pieces_beyond(count, errors)))
    members = first.join(met(roots.withColumnRenamed("node", "fp"), count), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    return fps.join(met(class_ids(members, count), fps.count()), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
