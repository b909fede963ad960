"""The graph of a context: chunks (requests in a row), labels in them, and titles; its expiry, degrees and ranks."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(requests: DataFrame, rows_per_slice: int = 100_000, most: int = 1000) -> DataFrame:
    """context, request_id, chunk: each request's place in its context, from 0, by seq (a number or a time; null first).

    Requests are dealt into slices of seq, at most `most` and of about `rows_per_slice`, with the same edges for all contexts.
    Places are counted within a context's slice and moved on by its earlier slices' counts, so a context of very many
    requests is many tasks.
    """
    slices = min(most, -(-requests.count() // rows_per_slice))
    edges = requests.agg(F.percentile_approx("seq", [k / slices for k in range(1, slices)], 10 * most)).first()[0] if slices > 1 else None
    upper = F.array(*[F.lit(x) for x in sorted(set(edges or []))])
    slice_ = F.size(F.filter(upper, lambda x: x < F.col("seq"))) if edges else F.lit(0)
    dealt = requests.select("context", "request_id", "seq", slice_.alias("_slice"))
    counts = dealt.groupBy("context", "_slice").agg(F.count("*").alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy("context").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    before = counts.select(F.col("context").alias("_c"), F.col("_slice").alias("_s"), F.coalesce(earlier, F.lit(0)).alias("_before"))
    line = Window.partitionBy("context", "_slice").orderBy("seq", "request_id")
    placed = dealt.withColumn("_place", F.row_number().over(line) - 1)
    joined = placed.join(before, placed["context"].eqNullSafe(before["_c"]) & (placed["_slice"] == before["_s"]))
    return joined.select("context", "request_id", (F.col("_before") + F.col("_place")).alias("chunk"))


def graph_edges(links: DataFrame, chunks: DataFrame, least: float = 0.2, by: str = "senseProbability") -> DataFrame:
    """context, src, dst, t: edges from label to title, from label to chunk and from chunk to the one before; src < dst.

    Only links whose `by` is at least `least` count. t is the last chunk that made the edge. Labels carry their chunk's
    number, so edges of one chunk are never those of another, except between chunks.
    """
    chunk = F.concat(F.lit("[Chunk"), F.col("chunk"), F.lit("]"))
    before = F.concat(F.lit("[Chunk"), F.col("chunk") - 1, F.lit("]"))
    row = chunks.where("chunk > 0").select("context", chunk.alias("a"), before.alias("b"), "chunk")
    kept = links.where(F.col(by) >= least).select("request_id", "label", "title").distinct().join(chunks, "request_id")
    label = F.concat(F.lit("["), F.col("chunk"), F.lit("-"), F.col("label"), F.lit("]"))
    pair = F.array(F.struct(label.alias("a"), F.col("title").alias("b")), F.struct(label.alias("a"), chunk.alias("b")))
    made = kept.select("context", "chunk", F.inline(pair)).select("context", "a", "b", "chunk")
    both = row.unionAll(made).select("context", F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), "chunk")
    return both.groupBy("context", "src", "dst").agg(F.max("chunk").cast("int").alias("t"))


def alive(edges: DataFrame, chunks: DataFrame, span: int = 100) -> DataFrame:
    """Edges that haven't expired at their context's last chunk: t isn't more than span chunks ago."""
    last = chunks.groupBy("context").agg(F.max("chunk").alias("_last"))
    return edges.join(last, "context").where(F.col("t") >= F.col("_last") - span).drop("_last")


def doubled(edges: DataFrame) -> DataFrame:
    return edges.select("context", F.inline(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("node"), F.col("src").alias("other")))))


def sized(nodes: DataFrame) -> DataFrame:
    """nodes with n, the nodes of their context; counts are combined before they move, so that no context is in one task."""
    return nodes.join(nodes.groupBy("context").agg(F.count("*").alias("n")), "context")


def degrees(edges: DataFrame) -> DataFrame:
    """context, node, degree, degree_centrality (degree over the other nodes; 1 for a single node)."""
    nodes = sized(doubled(edges).groupBy("context", "node").agg(F.count("*").alias("degree")))
    return nodes.withColumn("degree_centrality", F.when(F.col("n") > 1, F.col("degree") / (F.col("n") - 1)).otherwise(F.lit(1.0))).drop("n")


def _start(nodes: DataFrame, nstart: DataFrame | None) -> DataFrame:
    """context, node, n, rank: the weights of nstart (context, node, rank; 1 for nodes without one) as shares of their context, even ones if there are none."""
    if nstart is None:
        return nodes.select("context", "node", "n", (1.0 / F.col("n")).alias("rank"))
    given = nodes.select("context", "node", "n").join(nstart.select("context", "node", F.col("rank").alias("_given")), ["context", "node"], "left").withColumn("_given", F.coalesce("_given", F.lit(1.0)))
    whole = given.groupBy("context").agg(F.sum("_given").alias("_whole"))
    return given.join(whole, "context").select("context", "node", "n", F.when(F.col("_whole") > 0, F.col("_given") / F.col("_whole")).otherwise(1.0 / F.col("n")).alias("rank"))


#: Contexts of up to so many edges are ranked within a task, about as many edges of them at a time; larger ones by all tasks together.
WITHIN = 100_000


def _ranks_of(rows: pa.Table, rounds: int, damping: float, every: int, tolerance: float | None) -> pa.RecordBatch:
    """Ranks of the nodes of whole contexts; rows: context, src, dst, start (where dst is null, the start weight of src)."""
    rows = rows.combine_chunks()
    code = lambda x: x.dictionary_encode() if isinstance(x, pa.Array) else x.dictionary_encode().combine_chunks()
    is_edge = rows["dst"].is_valid().to_numpy().astype(bool)
    edges, starts = rows.filter(pa.array(is_edge)), rows.filter(pa.array(~is_edge))
    names = code(pa.chunked_array([*edges["src"].chunks, *edges["dst"].chunks, *starts["src"].chunks], rows.schema.field("src").type))
    contexts = code(pa.chunked_array([*edges["context"].chunks, *starts["context"].chunks], rows.schema.field("context").type))
    name, of = (x.indices.to_numpy(zero_copy_only=False).astype(np.int64) for x in (names, contexts))
    m, width = len(edges), len(names.dictionary) + 1
    keys, place = np.unique(np.concatenate([of[:m], of[:m]]) * width + name[: 2 * m], return_inverse=True)
    context = keys // width
    size = np.bincount(context, minlength=len(contexts.dictionary))
    n = size[context]
    a, b = place, np.concatenate([place[m:], place[:m]])  # edges lead both ways
    degree = np.bincount(a, minlength=len(keys))
    rank = 1.0 / n
    if len(starts):
        asked = of[m:] * width + name[2 * m :]
        at = np.minimum(np.searchsorted(keys, asked), max(0, len(keys) - 1))
        known = keys[at] == asked if len(keys) else np.zeros(len(asked), bool)
        given = np.ones(len(keys))
        given[at[known]] = np.nan_to_num(starts["start"].to_numpy()[known], nan=1.0)
        whole = np.bincount(context, given, minlength=len(size))[context]
        rank = np.where(whole > 0, given / np.where(whole > 0, whole, 1), rank)
    moving, result = np.ones(len(size), bool), rank.copy()
    k = 0
    while k < rounds and moving.any():
        k += 1
        before = rank
        rank = (1 - damping) / n + damping * np.bincount(b, rank[a] / degree[a], minlength=len(keys))
        if tolerance is None or (k % every and k < rounds):
            continue
        stands = moving & (np.bincount(context, np.abs(rank - before), minlength=len(size)) < tolerance * size)
        if stands.any():
            result = np.where(stands[context], rank, result)
            moving &= ~stands
            on = moving[context[a]]
            a, b = a[on], b[on]
    result = np.where(moving[context], rank, result)
    node = names.dictionary.take(pa.array(keys % width))
    return pa.RecordBatch.from_arrays([contexts.dictionary.take(pa.array(context)), node, pa.array(result), pa.array(result * n), pa.array(np.full(len(keys), tolerance is None) | ~moving[context])], ["context", "node", "pagerank", "pagerank_normalized", "_stands"])


def _ranked_within(edges: DataFrame, rounds: int, damping: float, every: int, tolerance: float | None, nstart: DataFrame | None) -> DataFrame:
    """context, node, pagerank, pagerank_normalized, _stands of contexts that are dealt out whole, many to a task: edges move once, for all rounds."""
    rows = edges.select("context", "src", "dst", F.lit(None).cast("double").alias("start")).where("context IS NOT NULL AND src IS NOT NULL AND dst IS NOT NULL")
    if nstart is not None:
        there = nstart.join(edges.select("context").distinct(), "context", "left_semi")
        rows = rows.unionByName(there.select("context", F.col("node").alias("src"), F.lit(None).cast("string").alias("dst"), F.col("rank").cast("double").alias("start")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        for batch in batches:
            held.append(batch)
            many += batch.num_rows
            if many < WITHIN:
                continue
            rows = pa.Table.from_batches(held)
            name = rows["context"].to_pandas()
            last = int(np.argmax((name == name.iloc[-1]).to_numpy()))  # rows are in order of context: the last one may go on
            if last:
                yield _ranks_of(rows.slice(0, last), rounds, damping, every, tolerance)
            held, many = rows.slice(last).to_batches(), len(rows) - last
        if many:
            yield _ranks_of(pa.Table.from_batches(held), rounds, damping, every, tolerance)

    kind = dict(edges.dtypes)["context"]
    return rows.repartition("context").sortWithinPartitions("context").mapInArrow(run, f"context {kind}, node string, pagerank double, pagerank_normalized double, _stands boolean")


def pagerank(edges: DataFrame, rounds: int = 20, damping: float = 0.85, settle=None, every: int = 5, tolerance: float | None = None, nstart: DataFrame | None = None, within: int = 0) -> DataFrame:
    """context, node, pagerank, pagerank_normalized (times the nodes).

    With a tolerance, a context's ranks stand when a round changes them by less than that a node, all its nodes together;
    every few rounds those that stand are set aside, and only the others go on. Should some not stand after `rounds`
    rounds, this raises RuntimeError. Without a tolerance all contexts have exactly `rounds` rounds. Ranks start even, or as nstart
    has them (context, node, rank), such as those of the context before its latest chunk.

    Each context is ranked by itself, edges being undirected, so no node is a dead end. Contexts of up to `within` edges are
    dealt out whole (none, if it is 0), so all their rounds cost one shuffle; larger ones have a join and an aggregate a round, in many tasks.
    `settle` writes a DataFrame and reads it (checkpoint by default).
    """
    settle = settle or (lambda df: df.checkpoint())
    if not within:
        return _ranked_in_rounds(edges, rounds, damping, settle, every, tolerance, nstart)
    edges = settle(edges)
    large = settle(edges.groupBy("context").agg(F.count("*").alias("_n")).where(F.col("_n") > within).select("context"))
    some = not large.isEmpty()
    small = edges.join(large, "context", "left_anti") if some else edges
    ranks = settle(_ranked_within(small, rounds, damping, every, tolerance, nstart))
    if not ranks.where("NOT _stands").isEmpty():
        raise RuntimeError(f"ranks didn't settle within {rounds} rounds")
    ranks = ranks.drop("_stands")
    return ranks.unionByName(_ranked_in_rounds(edges.join(large, "context", "left_semi"), rounds, damping, settle, every, tolerance, nstart)) if some else ranks


def _ranked_in_rounds(edges: DataFrame, rounds: int, damping: float, settle, every: int, tolerance: float | None, nstart: DataFrame | None) -> DataFrame:
    """pagerank() of all contexts in one plan. Every few rounds the ranks are cut from their lineage; edges of contexts that
    stand are left out once these are half of what was there.
    """
    both = doubled(settle(edges))
    nodes = sized(both.groupBy("context", "node").agg(F.count("*").alias("degree")))
    out = settle(both.join(nodes, ["context", "node"]).select("context", "node", "other", "degree"))
    ranks = settle(_start(nodes, nstart))
    left = held = ranks.count()
    done: list[DataFrame] = []
    k = 0
    while k < rounds and left:
        k += 1
        before = ranks
        sent = out.join(ranks, ["context", "node"]).groupBy("context", F.col("other").alias("node")).agg(F.sum(F.col("rank") / F.col("degree")).alias("got"), F.first("n").alias("n"))
        ranks = sent.select("context", "node", "n", ((1 - damping) / F.col("n") + damping * F.col("got")).alias("rank"))
        if k % every and k < rounds:
            continue
        if tolerance is None:
            ranks = settle(ranks)
            continue
        moved = settle(ranks.join(before.select("context", "node", F.col("rank").alias("_was")), ["context", "node"]).withColumn("_moved", F.abs(F.col("rank") - F.col("_was"))))
        stands = moved.groupBy("context").agg((F.sum("_moved") < tolerance * F.max("n")).alias("_stands")).where("_stands").select("context")
        ranks = settle(moved.drop("_was", "_moved").join(stands, "context", "left_anti"))
        now = ranks.count()
        if now < left:
            done.append(moved.drop("_was", "_moved").join(stands, "context", "left_semi"))
        left = now
        if left and 2 * left <= held:
            out, held = settle(out.join(ranks.select("context").distinct(), "context", "left_semi")), left
    if tolerance is not None and left:
        raise RuntimeError(f"ranks didn't settle within {rounds} rounds")
    for part in done:
        ranks = ranks.unionByName(part)
    return ranks.select("context", "node", F.col("rank").alias("pagerank"), (F.col("rank") * F.col("n")).alias("pagerank_normalized"))


def head_pagerank(edges: DataFrame, titles: DataFrame) -> DataFrame:
    """What the service has always given as rank: the start weight, 1 for titles and 0 for other nodes, and that times the nodes."""
    nodes = sized(doubled(edges).select("context", "node").distinct())
    known = titles.select("context", F.col("title").alias("node"), F.lit(1).alias("is_title")).distinct()
    weight = F.coalesce("is_title", F.lit(0)).cast("double")
    return nodes.join(known, ["context", "node"], "left").select("context", "node", weight.alias("pagerank"), (weight * F.col("n")).alias("pagerank_normalized"))


def adjacency(edges: DataFrame) -> DataFrame:
    """context, node, others: by neighbour the chunk of the edge."""
    both = edges.select("context", F.inline(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("other"), "t"), F.struct(F.col("dst").alias("node"), F.col("src").alias("other"), "t"))))
    return both.groupBy("context", "node").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("other", "t")))).alias("others"))


def with_context_features(links: DataFrame, requests: DataFrame, label: str = "chunk", span: int = 100, head: bool = False, settle=None, rounds: int = 1000, tolerance: float | None = 1e-6, nstart: DataFrame | None = None) -> DataFrame:
    """links with CONTEXT_<LABEL>_DEGREE, _DEGREE_CENTRALITY, _PAGERANK and _PAGERANK_NORMALIZED of their title; 0 outside the graph."""
    chunks = numbered(requests)
    edges = alive(graph_edges(links, chunks), chunks, span)
    edges = settle(edges) if settle else edges
    prefix = f"CONTEXT_{label.upper()}"
    ranks = head_pagerank(edges, links.join(chunks, "request_id").select("context", "title")) if head else pagerank(edges, rounds, settle=settle, tolerance=tolerance, nstart=nstart, within=WITHIN)
    both = degrees(edges).join(ranks, ["context", "node"], "left").withColumnRenamed("node", "title")
    named = chunks.select("request_id", F.col("context").alias("_context"))
    out = links.drop("context").join(named.withColumnRenamed("_context", "context"), "request_id").join(both, ["context", "title"], "left")
    names = {"degree": "DEGREE", "degree_centrality": "DEGREE_CENTRALITY", "pagerank": "PAGERANK", "pagerank_normalized": "PAGERANK_NORMALIZED"}
    return out.withColumns({f"{prefix}_{n}": F.coalesce(c, F.lit(0)).cast("double") for c, n in names.items()}).drop(*names)


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors needn't have this package
