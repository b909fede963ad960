"""Exact top-k by inner product: term at a time, in blocks.

Rows are turned to sparse integer vectors. Candidates are dealt into blocks of bounded size by a hash of their id, query
rows likewise; every query block meets every candidate block once. In such a meeting the candidates become postings
(term -> rows and weights); for each term of the query rows, the weighted postings are added into dense score arrays,
and a partition selection keeps k of them. The k best of each block are merged by query.

Memory of a task is bounded by the block sizes, whatever the number of rows; no side is broadcast or collected.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship


def floor_weights(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component as long."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def finite(vector: Column) -> Column:
    """Neither null nor holding null, NaN or infinite components."""
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


class Postings:
    """Rows and weights of each term (a component's place) of a block."""

    def __init__(self, lengths: np.ndarray, weights: np.ndarray) -> None:
        self.rows = len(lengths)
        owner = np.repeat(np.arange(self.rows), lengths)
        term = np.arange(len(weights)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        kept = np.flatnonzero(weights)
        order = kept[np.argsort(term[kept], kind="stable")]
        self.owner, self.weight = owner[order], weights[order]
        self.terms, starts = np.unique(term[order], return_index=True)
        self.bounds = np.append(starts, len(order))

    def of(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        return self.owner[self.bounds[k] : self.bounds[k + 1]], self.weight[self.bounds[k] : self.bounds[k + 1]]


def accumulate(queries: Postings, candidates: Postings, lo: int, hi: int) -> np.ndarray:
    """Scores of the query rows lo to hi against all candidates: each shared term scatters its weighted postings."""
    scores = np.zeros((hi - lo, candidates.rows), np.int64)
    place = {int(t): k for k, t in enumerate(candidates.terms)}
    for k, t in enumerate(queries.terms):
        if (c := place.get(int(t))) is None:
            continue
        rows, weights = queries.of(k)
        a, b = np.searchsorted(rows, (lo, hi))
        who, what = candidates.of(c)
        if len(who) == candidates.rows:  # every candidate has the term: no indices needed
            for q, w in zip(rows[a:b] - lo, weights[a:b], strict=True):
                scores[q] += w * what
        else:
            for q, w in zip(rows[a:b] - lo, weights[a:b], strict=True):
                scores[q, who] += w * what
    return scores


def best_of(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of one query among distinct ids, ties to smaller ids, without its own."""
    n = len(scores)
    if n > k + 1:  # one more, as its own row may be among them; then all that tie with the last
        cut = scores[np.argpartition(scores, n - k - 1)[n - k - 1 :]].min()
        found = np.flatnonzero(scores >= cut)
    else:
        found = np.arange(n)
    found = found[ids[found] != own]
    found = found[np.lexsort((ids[found], -scores[found]))][:k]
    return ids[found], scores[found]


def _arrays(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    t = t.combine_chunks()
    v = t.column("_w").combine_chunks() if t.num_rows else pa.array([], pa.list_(pa.int64()))
    return t.column("_id").to_numpy(), np.asarray(v.value_lengths().fill_null(0)).astype(np.int64), np.asarray(v.flatten()).astype(np.int64)


def top_k(df: DataFrame, is_query: Column, k: int = 5, id_column: str = "vec_id", weights: str = "weights", candidates_per_block: int = 8192, queries_per_block: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row that `is_query` holds for; all, if fewer.

    df: ids (not null; rows with null ids take no part) and arrays of longs, of any lengths; a component's place is its
    term, zeros count as absent, an empty array scores 0 with everything. Rows with one id count as one: its score is
    the best of theirs, and none of them is a candidate for its own query. Ties go to the smaller id.
    """
    rows = df.where(F.col(id_column).isNotNull() & F.col(weights).isNotNull()).select(F.col(id_column).cast("long").alias("_id"), F.col(weights).alias("_w"), F.coalesce(is_query, F.lit(False)).alias("_q"))
    n, asked = rows.select("_id", "_q").agg(F.count("*"), F.coalesce(F.sum(F.col("_q").cast("long")), F.lit(0))).first()
    across, down = max(1, math.ceil(n / candidates_per_block)), max(1, math.ceil(asked / queries_per_block))
    hashed = F.xxhash64(F.lit(7), F.col("_id"))
    c = rows.select("_id", "_w", F.pmod(hashed, F.lit(across)).cast("int").alias("_c"), F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("_r"))
    q = rows.where("_q").select("_id", "_w", F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("_c"), F.pmod(F.shiftright(hashed, 20), F.lit(down)).cast("int").alias("_r"))

    def meet(key, left: pa.Table, right: pa.Table) -> pa.Table:
        qid, qn, qw = _arrays(left)
        cid, cn, cw = _arrays(right)
        out: list[tuple[np.ndarray, ...]] = []
        if len(qid) and len(cid):
            queries, candidates = Postings(qn, qw), Postings(cn, cw)
            order = np.argsort(cid, kind="stable")
            ids, starts = np.unique(cid[order], return_index=True)
            step = max(1, 4_000_000 // len(cid))
            for lo in range(0, len(qid), step):
                scores = accumulate(queries, candidates, lo, min(len(qid), lo + step))
                for i in range(len(scores)):
                    found, got = best_of(np.maximum.reduceat(scores[i][order], starts), ids, qid[lo + i], k)
                    out.append((np.full(len(found), qid[lo + i]), found, got))
        columns = [np.concatenate(x) if out else np.zeros(0, np.int64) for x in (zip(*out, strict=True) if out else ((), (), ()))]
        return pa.table([pa.array(x, pa.int64()) for x in columns], ["query_id", "vec_id", "score"])

    ship(df.sparkSession)
    partial = q.groupBy("_c", "_r").cogroup(c.groupBy("_c", "_r")).applyInArrow(meet, "query_id long, vec_id long, score long")
    merged = partial.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return merged.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
