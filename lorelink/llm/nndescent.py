"""Approximate nearest neighbours by cosine: a neighbour graph by NN-descent, greedy search in it.

Equal vectors are one point of the graph, however many rows they are; a point remembers as many of its smallest ids as an
answer can hold. Points carry a code of a byte a component to all places where they are compared; answers are ranked by
the original vectors in double precision.

A first graph comes from ranges of random projections, whose windows are compared among themselves. Then each round joins
neighbours of neighbours: every point sends its code to the points that list it and those that it lists, where all that
arrive are compared with each other; a point that finds nearer neighbours so replaces the farthest of its list. What was
compared before isn't compared again, and rounds end when few entries change. Lists, windows and what arrives at one point
are bounded (a point that very many list hears a random part of them in each round), so no task holds an unbounded group.

A search holds a pool of the nearest points seen for each query. Each step takes the nearest that haven't been expanded,
joins them with the graph, scores the neighbours that aren't in the pool, and merges them into it; it ends when the best
`ef` of all pools are expanded. All queries step together, as joins; the state is a table. Pools begin with the neighbours
of the query's own point if it is in the graph, and with a few points chosen by hash if it isn't.

The graph is approximate by design; recall is measured against brute force in the tests and the README.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import map_arrow, settled, shuffle_partitions
from .topk import finite

GRAPH = "pid long, code binary, least float, n array<long>, s array<float>, f array<boolean>, fresh array<long>, known array<long>"
LISTS = "pid long, code binary, n array<long>, s array<float>, f array<boolean>"


@dataclass(frozen=True)
class Settings:
    """How the graph is built and searched."""

    neighbours: int = 32
    #: Random projections of the first graph, and rows of a window that are compared.
    projections: int = 4
    window: int = 256
    #: Entries of a list that a round sends on, of the new ones and of the known ones each; rows that one point hears at most.
    sample: int = 12
    hears: int = 64
    #: Candidates that one point's comparisons give each of the compared.
    gives: int = 8
    rounds: int = 10
    #: Rounds end when new entries are less than this share of all.
    settled_share: float = 0.02
    #: Points of a pool that are expanded before a search ends; points expanded in one step; points ranked by original vectors.
    ef: int = 256
    step: int = 64
    ranked: int = 48
    steps: int = 30
    #: Where queries that aren't in the graph begin.
    entries: int = 32
    seed: int = 20


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors of a batch as doubles, filled up with zeros, each scaled by a power of two so that squares don't overflow."""
    lengths = np.asarray(column.value_lengths()).astype(np.int64)
    flat = np.asarray(column.flatten()).astype(np.float64)
    out = np.zeros((len(lengths), width))
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    if len(out):
        _, exponent = np.frexp(np.abs(out).max(axis=1, initial=0))
        out = np.ldexp(out, -exponent[:, None])
    return out


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows, in double precision."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def codes(vectors: np.ndarray) -> np.ndarray:
    """A signed byte for each component; what is lost is small against the distances of neighbours."""
    largest = np.abs(vectors).max(axis=1, keepdims=True, initial=0)
    return np.rint(vectors * (127 / np.where(largest > 0, largest, 1))).astype(np.int8)


def unit(column: pa.Array, width: int) -> np.ndarray:
    """A batch's codes as unit vectors."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = np.frombuffer(b"".join(column.to_pylist()), np.int8).reshape(len(column), width).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def whole_groups(batches: Iterator[pa.RecordBatch], least: int = 1 << 15) -> Iterator[pa.Table]:
    """Tables of whole groups of the first column, in whose order the rows come."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= least:
            table = pa.Table.from_batches(held).combine_chunks()
            key = table.column(0).to_numpy()
            last = int(np.searchsorted(key, key[-1])) if key[0] <= key[-1] else int(np.flatnonzero(key[1:] != key[:-1])[-1]) + 1
            if last:
                yield table.slice(0, last)
                held, rows = table.slice(last).to_batches(), table.num_rows - last
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def bounds(key: np.ndarray) -> np.ndarray:
    """First places of the groups of a sorted key, and its length."""
    return np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key)) if len(key) else np.zeros(1, np.int64)


def best_lists(owner: np.ndarray, other: np.ndarray, score: np.ndarray, most: int, first: np.ndarray | None = None) -> np.ndarray:
    """Places of the `most` best distinct others of each owner, sorted by owner and score (ties: smaller others).

    Of repeated pairs that with the lower `first` is kept.
    """
    order = np.lexsort((first if first is not None else -score, other, owner))
    o, p = owner[order], other[order]
    once = np.append(True, (o[1:] != o[:-1]) | (p[1:] != p[:-1])) if len(o) else np.zeros(0, bool)
    order = order[once & (o != p)]
    order = order[np.lexsort((other[order], -score[order], owner[order]))]
    starts = bounds(owner[order])
    rank = np.arange(len(order)) - np.repeat(starts[:-1], np.diff(starts))
    return order[rank < most]


def _lists(values: np.ndarray, starts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(values, kind))


def _flat(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """A column of lists as values and lengths; null lists are empty."""
    column = table.column(name).combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False), np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)


# --- points ---


def points_of(df: DataFrame, vector: str, id_column: str, keep: int) -> tuple[DataFrame, int]:
    """pid, ids, v, code of each distinct vector that takes part, written as a table; and the longest length.

    ids are the `keep` smallest distinct ids of its rows. Where very many rows share a vector, each task keeps that many
    of them before they move.
    """
    rows = df.where(F.col(id_column).isNotNull() & finite(F.col(vector)) & F.exists(vector, lambda x: x != 0)).select(F.col(id_column).cast("long").alias("id"), F.col(vector).alias("v"))
    width = int(rows.agg(F.max(F.size("v"))).first()[0] or 1)
    place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    few = rows.distinct().withColumn("_k", place).where(F.col("_k") <= keep)
    grouped = few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = pa.array([c.tobytes() for c in codes(matrix(batch.column(2), width))], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, code], ["pid", "ids", "v", "code"])

    numbered = grouped.select(F.monotonically_increasing_id().alias("pid"), "ids", "v")
    schema = StructType([*numbered.schema.fields, StructField("code", BinaryType())])
    return settled(map_arrow(numbered, coded, schema), "points"), width


# --- the graph ---


def first_lists(points: DataFrame, width: int, s: Settings) -> DataFrame:
    """LISTS: neighbours within windows of points that random projections bring together."""
    rng = np.random.default_rng(s.seed)
    planes = rng.normal(size=(s.projections, 12, width)).astype(np.float32)

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unit(batch.column(1), width)
            for r in range(s.projections):
                y = x @ planes[r].T
                side = ((y[:, :-1] > 0) @ (1 << np.arange(y.shape[1] - 1))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), r, np.int32)), pa.array(side), pa.array(y[:, -1].astype(np.float64)), batch.column(0), batch.column(1)], ["r", "side", "y", "pid", "code"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def windows(table: pa.Table) -> Iterator[pa.RecordBatch]:
            pid, r = table.column("pid").to_numpy(), table.column("r").to_numpy()
            x = unit(table.column("code"), width)
            at = bounds(r)
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                count = max(1, -(-(b - a) // s.window))
                for part in np.array_split(np.arange(a, b), count):
                    near = x[part] @ x[part].T
                    np.fill_diagonal(near, -2)
                    most = min(s.gives, len(part) - 1)
                    if most < 1:
                        continue
                    top = np.argpartition(-near, most - 1, axis=1)[:, :most]
                    score = np.take_along_axis(near, top, 1)
                    starts = np.arange(len(part) + 1) * most
                    none = pa.nulls(len(part), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(pid[part]), none, _lists(pid[part][top].reshape(-1), starts, pa.int64()), _lists(score.reshape(-1), starts, pa.float32()), _lists(np.ones(top.size, bool), starts, pa.bool_())], ["pid", "code", "n", "s", "f"])

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= 64 * s.window:
                yield from windows(pa.Table.from_batches(held).combine_chunks())
                held, rows = [], 0
        if rows:
            yield from windows(pa.Table.from_batches(held).combine_chunks())

    n = shuffle_partitions(points.sparkSession)
    dealt = map_arrow(points.select("pid", "code"), projected, "r int, side int, y double, pid long, code binary")
    ranged = dealt.repartitionByRange(n, "r", "side", "y").sortWithinPartitions("r", "side", "y")
    return map_arrow(ranged, compared, LISTS)


def merged(lists: DataFrame, s: Settings, round_: int) -> DataFrame:
    """GRAPH: of all LISTS of a point, its own among them, the nearest distinct ones, and what the next round sends on."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            key = table.column("pid").to_numpy()
            other, lengths = _flat(table, "n")
            score, _ = _flat(table, "s")
            new, _ = _flat(table, "f")
            owner = np.repeat(key, lengths)
            kept = best_lists(owner, other, score, s.neighbours, np.where(new.astype(bool), 1, 0))
            at = bounds(key)
            pids = key[at[:-1]]
            code = [c for c in table.column("code").to_pylist() if c is not None]
            owner, other, score, new = owner[kept], other[kept], score[kept], new[kept].astype(bool)
            starts = np.searchsorted(owner, np.append(pids, pids[-1] + 1))
            # a random part of the new and of the known entries is sent on; new ones that are sent are known from then on
            mixed = (other * np.int64(-7046029254386353131) ^ (owner + np.int64(round_)) * np.int64(-4417276706812531889)) >> np.int64(20)
            sent = np.zeros(len(owner), bool)
            order = np.lexsort((mixed, ~new, owner))
            group = bounds_of_pairs(owner[order], new[order])
            rank = np.arange(len(order)) - np.repeat(group[:-1], np.diff(group))
            sent[order[rank < s.sample]] = True
            least = np.full(len(pids), -2, np.float32)
            sizes = np.diff(starts)
            full = sizes >= s.neighbours
            least[full] = score[starts[1:][full] - 1]

            def chosen(mask: np.ndarray, other=other, starts=starts) -> pa.ListArray:
                return _lists(other[mask], np.append(0, np.cumsum(mask))[starts], pa.int64())

            yield pa.RecordBatch.from_arrays(
                [pa.array(pids), pa.array(code, pa.binary()), pa.array(least), _lists(other, starts, pa.int64()), _lists(score, starts, pa.float32()), _lists(new & ~sent, starts, pa.bool_()), chosen(sent & new), chosen(sent & ~new)],
                ["pid", "code", "least", "n", "s", "f", "fresh", "known"],
            )

    n = shuffle_partitions(lists.sparkSession)
    return map_arrow(lists.repartition(n, "pid").sortWithinPartitions("pid"), merge, GRAPH)


def bounds_of_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """As bounds(), of a sorted key of two columns."""
    if not len(a):
        return np.zeros(1, np.int64)
    return np.append(np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))), len(a))


def neighbours_meet(graph: DataFrame, width: int, s: Settings, round_: int) -> DataFrame:
    """LISTS of what points find when all that a point lists and all that list it are compared with each other."""
    told = F.explode(F.concat(F.transform("fresh", lambda x: F.struct(x.alias("x"), F.lit(True).alias("new"))), F.transform("known", lambda x: F.struct(x.alias("x"), F.lit(False).alias("new"))))).alias("e")
    listed = graph.select(F.col("pid").alias("v"), told).select("v", F.col("e.x").alias("u"), "e.new")
    forward = listed.join(graph.select(F.col("pid").alias("u"), "code", "least"), "u").select("v", "u", "new", "code", "least")
    backward = graph.select("pid", "code", "least", told).select(F.col("e.x").alias("v"), F.col("pid").alias("u"), "e.new", "code", "least")
    heard = F.row_number().over(Window.partitionBy("v").orderBy(F.desc("new"), F.xxhash64(F.lit(round_), "u", "v")))
    meeting = forward.unionAll(backward).withColumn("_k", heard).where(F.col("_k") <= s.hears).select("v", "u", "new", "code", "least")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, ...]] = []
        held = 0

        def given() -> pa.RecordBatch:
            owner, other, score = (np.concatenate(x) for x in zip(*found, strict=True))
            kept = best_lists(owner, other, score, s.neighbours)
            owner, other, score = owner[kept], other[kept], score[kept]
            at = bounds(owner)
            pids = owner[at[:-1]]
            return pa.RecordBatch.from_arrays([pa.array(pids), pa.nulls(len(pids), pa.binary()), _lists(other, at, pa.int64()), _lists(score, at, pa.float32()), _lists(np.ones(len(other), bool), at, pa.bool_())], ["pid", "code", "n", "s", "f"])

        for table in whole_groups(batches, 1 << 14):
            v, u = table.column("v").to_numpy(), table.column("u").to_numpy()
            new, least = table.column("new").to_numpy(zero_copy_only=False), table.column("least").to_numpy()
            x = unit(table.column("code"), width)
            at = bounds(v)
            sizes = np.diff(at)
            for size in np.unique(sizes):
                if size < 2:
                    continue
                groups = at[:-1][sizes == size]
                for lo in range(0, len(groups), 512):
                    rows = groups[lo : lo + 512, None] + np.arange(size)[None, :]
                    near = x[rows] @ x[rows].transpose(0, 2, 1)
                    near[~(new[rows][:, :, None] | new[rows][:, None, :])] = -2
                    near[u[rows][:, :, None] == u[rows][:, None, :]] = -2
                    near[near <= least[rows][:, :, None]] = -2
                    most = min(s.gives, int(size) - 1)
                    top = np.argpartition(-near, most - 1, axis=2)[:, :, :most]
                    score = np.take_along_axis(near, top, 2)
                    g, i, k = np.nonzero(score > -2)
                    found.append((u[rows[g, i]], u[rows[g, top[g, i, k]]], score[g, i, k]))
                    held += len(g)
            if held >= 2_000_000:
                yield given()
                found, held = [], 0
        if held:
            yield given()

    return map_arrow(meeting, compare, LISTS)


def build_graph(points: DataFrame, width: int, s: Settings = Settings()) -> DataFrame:  # noqa: B008
    """GRAPH of `points` (pid, code), written as a table. Points by themselves have an empty list."""
    own = points.select("pid", "code", F.array().cast("array<long>").alias("n"), F.array().cast("array<float>").alias("s"), F.array().cast("array<boolean>").alias("f"))
    graph = settled(merged(first_lists(points, width, s).unionAll(own), s, 0), "graph")
    for k in range(1, s.rounds + 1):
        fresh, entries = graph.agg(F.sum(F.size("fresh")), F.sum(F.size("n"))).first()
        if not entries or fresh <= s.settled_share * entries:
            break
        lists = neighbours_meet(graph, width, s, k).unionAll(graph.select("pid", "code", "n", "s", "f"))
        graph = settled(merged(lists, s, k), "graph")
    return graph


def search_graph(graph: DataFrame, s: Settings) -> DataFrame:
    """pid, n: each point's neighbours and the nearest of the points that list it, as many again at most."""
    pairs = graph.select("pid", F.explode(F.arrays_zip("n", "s")).alias("e")).select(F.col("e.n").alias("to"), F.col("e.s").alias("s"), "pid")
    back = F.row_number().over(Window.partitionBy("to").orderBy(F.desc("s"), "pid"))
    listing = pairs.withColumn("_k", back).where(F.col("_k") <= s.neighbours).groupBy("to").agg(F.collect_list("pid").alias("m"))
    none = F.array().cast("array<long>")
    return settled(graph.select("pid", "n").join(listing.withColumnRenamed("to", "pid"), "pid", "left").select("pid", F.array_union("n", F.coalesce("m", none)).alias("n")), "search-graph")


# --- search ---


def _pools(found: DataFrame, s: Settings) -> DataFrame:
    """q, code, n, s, f: each query's pool, of rows with lists of what was found (f: not expanded yet); those that one step expands come out in `at`."""
    keep = max(s.ef, s.ranked)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, 1 << 12):
            key = table.column("q").to_numpy()
            other, lengths = _flat(table, "n")
            score, _ = _flat(table, "s")
            new, _ = _flat(table, "f")
            owner = np.repeat(np.cumsum(np.append(0, key[1:] != key[:-1])), lengths)
            # a query is no neighbour of itself in the graph, so owners can be numbered anew here: -1 - number is no point
            kept = best_lists(-1 - owner, other, score, keep, np.where(new.astype(bool), 1, 0))
            kept = kept[np.argsort(owner[kept], kind="stable")]
            owner, other, score, new = owner[kept], other[kept], score[kept], new[kept].astype(bool)
            at = bounds(key)
            starts = np.searchsorted(owner, np.arange(len(at)))
            rank = np.arange(len(owner)) - np.repeat(starts[:-1], np.diff(starts))
            open_ = new & (rank < s.ef)
            place = np.cumsum(open_) - open_
            go = open_ & (place - np.repeat(np.append(0, np.cumsum(open_))[starts[:-1]], np.diff(starts)) < s.step)
            codes_ = table.column("code").to_pylist()
            code = [next(c for c in codes_[a:b] if c is not None) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(key[at[:-1]]), pa.array(code, pa.binary()), _lists(other, starts, pa.int64()), _lists(score, starts, pa.float32()), _lists(new & ~go, starts, pa.bool_()), _lists(other[go], np.append(0, np.cumsum(go))[starts], pa.int64())], ["q", "code", "n", "s", "f", "at"])

    n = shuffle_partitions(found.sparkSession)
    return settled(map_arrow(found.repartition(n, "q").sortWithinPartitions("q"), pool, "q long, code binary, n array<long>, s array<float>, f array<boolean>, at array<long>"), "pools")


def _scored(asked: DataFrame, points: DataFrame, width: int) -> DataFrame:
    """q, code, n, s, f of asked (q, code, to): lists of one task's points and their likeness to the query."""
    rows = asked.join(points.select(F.col("pid").alias("to"), F.col("code").alias("c")), "to").select("q", "to", "code", "c")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            near = (unit(batch.column(2), width) * unit(batch.column(3), width)).sum(axis=1, dtype=np.float32)
            q = batch.column(0).to_numpy()
            order = np.argsort(q, kind="stable")
            at = bounds(q[order])
            none = pa.nulls(len(at) - 1, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(q[order][at[:-1]]), none, _lists(batch.column(1).to_numpy()[order], at, pa.int64()), _lists(near[order], at, pa.float32()), _lists(np.ones(len(q), bool), at, pa.bool_())], ["q", "code", "n", "s", "f"])

    return map_arrow(rows, score, "q long, code binary, n array<long>, s array<float>, f array<boolean>")


def search(queries: DataFrame, points: DataFrame, graph: DataFrame, width: int, s: Settings = Settings()) -> DataFrame:  # noqa: B008
    """q, n, s: the nearest points that greedy search finds for `queries` (q, code, start: a point of the graph or null), by their codes."""
    links = search_graph(graph, s)
    seeds = links.select("pid").orderBy(F.xxhash64(F.lit(s.seed), "pid")).limit(s.entries).agg(F.collect_list("pid").alias("seeds"))  # a bounded row
    begun = queries.join(links.select(F.col("pid").alias("start"), F.col("n").alias("_n")), "start", "left").crossJoin(F.broadcast(seeds))
    begun = begun.select("q", "code", F.explode(F.when(F.col("start").isNull() | (F.size("_n") == 0), F.col("seeds")).otherwise(F.col("_n"))).alias("to"))
    empty = queries.select("q", "code", F.array().cast("array<long>").alias("n"), F.array().cast("array<float>").alias("s"), F.array().cast("array<boolean>").alias("f"))
    pools = _pools(_scored(begun, points, width).unionAll(empty), s)
    for _ in range(s.steps):
        going = pools.where(F.size("at") > 0)
        if going.isEmpty():
            break
        hop = going.select("q", "code", F.col("n").alias("_seen"), F.explode("at").alias("pid")).join(links, "pid").select("q", "code", F.explode(F.array_except("n", "_seen")).alias("to")).distinct()
        pools = _pools(_scored(hop, points, width).unionAll(pools.select("q", "code", "n", "s", "f")), s)
    return pools.select("q", F.slice("n", 1, s.ranked).alias("n"), F.slice("s", 1, s.ranked).alias("s"))


def nearest(df: DataFrame, is_query: Column, k: int = 5, id_column: str = "vec_id", vector: str = "embedding", settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """query_id, rank, vec_id, score: the k nearest found for each row that `is_query` holds for; all, if the table has fewer.

    score is the cosine of the original vectors in double precision; ties go to the smaller id. Vectors that are null, zero
    or hold null or non-finite components take no part, nor do rows without an id; shorter vectors count as filled up with
    zeros. Rows with one id count as one: its score is the best of theirs, and none of them is found for its own query.
    Equal vectors are all found where one is.
    """
    asked = df.select(F.col(id_column).cast("long").alias("id"), F.col(vector).alias("v"), F.coalesce(is_query, F.lit(False)).alias("_q")).where("_q").select("id", "v").distinct()
    points, width = points_of(df, vector, id_column, k + 1)
    graph = build_graph(points, width, settings)
    owners = settled(asked.where(finite(F.col("v"))).join(points.select("pid", "v"), "v").select(F.col("id").alias("query_id"), F.col("pid").alias("q")), "queries")
    started = owners.select("q").distinct().join(points.select(F.col("pid").alias("q"), "code"), "q").withColumn("start", F.col("q"))
    found = search(started, points, graph, width, settings)
    pairs = found.select("q", F.explode(F.array_union(F.array("q"), "n")).alias("pid"))  # its own point: rows with the same vector
    both = pairs.join(points.select("pid", F.col("v").alias("b"), "ids"), "pid").join(points.select(F.col("pid").alias("q"), F.col("v").alias("a")), "q").select("q", "ids", "a", "b")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = cosine(matrix(batch.column(2), width), matrix(batch.column(3), width)) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64())], ["q", "ids", "score"])

    scored = map_arrow(both, exact, "q long, ids array<long>, score double").select("q", F.explode("ids").alias("vec_id"), "score")
    best = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    few = scored.groupBy("q", "vec_id").agg(F.max("score").alias("score")).withColumn("_k", best).where(F.col("_k") <= k + 1).drop("_k")
    answers = owners.join(settled(few, "found"), "q").where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return answers.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
