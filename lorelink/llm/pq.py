"""Vector compression: product codes, nearest entries found in annuli of norms.

Vectors of integers are cut into parts of equal width, each with a codebook of its own. An entry nearer to a part than
`best` has a norm within `best` of the part's own norm (triangle inequality), so of the entries sorted by norm only the
interval that two binary searches find can hold it: the annulus, ends included. The first bound is the best of the entries
next in norm; only the annulus is evaluated then, exactly.

Each round is one pass: tasks have the codebooks (a model of bounded size), assign their vectors' parts and add up the
parts of each entry; Spark adds up the tasks' sums, and the driver gets one row for each entry that is used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, settled
from .simhash import BROADCAST
from .topk import finite


def floored(vector: Column, scale: int, bound: int) -> Column:
    """floor(scale * x) of every component, within -bound to bound."""
    return F.transform(vector, lambda x: F.greatest(F.lit(float(-bound)), F.least(F.lit(float(bound)), F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))).cast("long"))


def component_bound(width: int) -> int:
    """The largest component for which squared distances of vectors of `width` components fit a long: 2^26 up to 256 components."""
    bound = 1 << 26
    while bound > 1 and 4 * bound * bound * max(1, width) > 1 << 62:
        bound >>= 1
    return bound


class Codebook:
    """Entries of one part, by norm."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        norms = np.sqrt((entries.astype(np.float64) ** 2).sum(axis=1))
        self.order = np.argsort(norms, kind="stable")
        self.norms = norms[self.order]
        self.sorted = entries[self.order]

    def _squares(self, x: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Squared distances to the entries lo to hi in the order of norms; exact. Floats do where they are exact."""
        c = self.sorted[lo:hi]
        if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) ** 2 * max(1, x.shape[1]) * 4 < 1 << 53:
            a, b = x.astype(np.float64), c.astype(np.float64)
            return (a**2).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b**2).sum(axis=1)[None, :]
        out = np.zeros((len(x), hi - lo), np.int64)
        for k in range(x.shape[1]):
            out += (x[:, k : k + 1] - c[None, :, k]) ** 2
        return out

    def nearest(self, parts: np.ndarray, block: int = 256, probe: int = 8, visited: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Index of each part's nearest entry (ties: the lowest) and its squared distance. `visited` gets the evaluated distances' number.

        Parts are taken in blocks of like norm, so that their annuli are nearly one and its entries are evaluated together.
        """
        n, m = len(parts), len(self.entries)
        index, square = np.zeros(n, np.int64), np.zeros(n, np.int64)
        norms = np.sqrt((parts.astype(np.float64) ** 2).sum(axis=1))
        by_norm = np.argsort(norms, kind="stable")
        for at in range(0, n, block):
            rows = by_norm[at : at + block]
            x, r = parts[rows], norms[rows]
            middle = int(np.searchsorted(self.norms, r[len(r) // 2]))
            lo = max(0, min(m - probe, middle - probe // 2))
            hi = min(m, lo + probe)
            bound = self._squares(x, lo, hi).min(axis=1)
            # a little wider than the bound, as norms are rounded; entries exactly as far as the best are within
            reach = np.sqrt(bound.astype(np.float64)) * (1 + 1e-9) + 1e-6 * (1 + r)
            lo = int(np.searchsorted(self.norms, (r - reach).min(), "left"))
            hi = int(np.searchsorted(self.norms, (r + reach).max(), "right"))
            far = self._squares(x, lo, hi)
            best = far.min(axis=1)
            # of the entries at the least distance that with the lowest index
            tied = np.where(far == best[:, None], self.order[lo:hi][None, :], m)
            index[rows], square[rows] = tied.min(axis=1), best.astype(np.int64)
            if visited is not None:
                visited.append(len(x) * (hi - lo))
        return index, square


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """A batch's vectors as a matrix, with zeros up to `width`."""
    lengths = np.asarray(column.value_lengths()).astype(np.int64)
    flat = np.asarray(column.flatten()).astype(np.int64)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width), np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def integer_vectors(df: DataFrame, vector: str, keep: list[str], scale: int = 1024) -> tuple[DataFrame, int]:
    """`keep`'s columns and `_v`, written as a table, of the rows whose vectors are neither null nor hold null or non-finite components; and the longest length."""
    rows = df.where(finite(F.col(vector)))
    width = int(rows.agg(F.max(F.size(vector))).first()[0] or 0)
    return settled(rows.select(*keep, floored(F.col(vector), scale, component_bound(width)).alias("_v")), "integer-vectors"), width


def first_vectors(vectors: DataFrame, id_column: str, most: int) -> pa.Array:
    """Vectors of the `most` smallest ids, ascending; equal ids by their vectors, null ids last. Their size is the codebooks'."""
    return vectors.orderBy(F.col(id_column).asc_nulls_last(), "_v").limit(most).select("_v").toArrow().column("_v").combine_chunks()


def codebooks(vectors: DataFrame, width: int, parts: int, entries: int, rounds: int, id_column: str) -> list[np.ndarray]:
    """Codebooks of `parts` parts after `rounds` rounds from the vectors of the smallest ids. `width` is a multiple of `parts`."""
    each = width // parts
    first = _matrix(first_vectors(vectors, id_column, entries), width)
    books = [first[:, p * each : (p + 1) * each].copy() for p in range(parts)]
    for _ in range(rounds if len(first) else 0):
        shared = vectors.sparkSession.sparkContext.broadcast([Codebook(b) for b in books])

        def sums(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total = np.zeros((parts, len(first), each), np.int64)
            count = np.zeros((parts, len(first)), np.int64)
            for batch in batches:
                x = _matrix(batch.column(0), width)
                for p, book in enumerate(shared.value):
                    index, _ = book.nearest(x[:, p * each : (p + 1) * each])
                    order = np.argsort(index, kind="stable")
                    used, starts = np.unique(index[order], return_index=True)
                    if len(used):
                        total[p, used] += np.add.reduceat(x[order, p * each : (p + 1) * each], starts, axis=0)
                    count[p] += np.bincount(index, minlength=len(first))
            p, e = np.nonzero(count)
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * each), pa.array(total[p, e].reshape(-1)))
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), values, pa.array(count[p, e])], ["part", "entry", "total", "n"])

        partial = map_arrow(vectors.select("_v"), sums, "part int, entry int, total array<long>, n long")
        added = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[k]).alias(f"t{k}") for k in range(each)])
        for row in added.collect():
            books[row["part"]][row["entry"]] = [row[f"t{k}"] // row["n"] for k in range(each)]
        shared.unpersist()
    return books


def codebooks_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components in decimal, comma-joined by part, entry and place."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.reshape(-1).tolist()).encode()).hexdigest()


def encode(vectors: DataFrame, books: list[np.ndarray], width: int, keep: list[str]) -> DataFrame:
    """`keep`'s columns, code (two hex digits a part) and error (squared distances summed over the parts)."""
    each = width // len(books)
    shared = vectors.sparkSession.sparkContext.broadcast([Codebook(b) for b in books])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(0), width)
            codes, error = np.zeros((len(x), len(shared.value)), np.uint8), np.zeros(len(x), np.int64)
            for p, book in enumerate(shared.value):
                index, square = book.nearest(x[:, p * each : (p + 1) * each])
                codes[:, p] = index
                error += square
            text = codes.tobytes().hex()
            step = 2 * codes.shape[1]
            code = pa.array([text[k : k + step] for k in range(0, len(text), step)], pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(1, batch.num_columns)], code, pa.array(error)], [*keep, "code", "error"])

    kept = vectors.select(*keep)
    schema = kept.schema.add("code", "string").add("error", "long")
    return map_arrow(vectors.select("_v", *keep), assign, schema)


def compress(df: DataFrame, vector: str = "embedding", id_column: str = "vec_id", label: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256: a row for each vector that takes part.

    df: id, vector, label; `entries` is 256 at most, as a code has a byte a part. Null vectors and those with null or
    non-finite components take no part. Components are floor(scale * x), held within component_bound() (2^26 for usual
    widths), so that sums fit a long. Vectors shorter than the longest, and lengths that `parts` doesn't divide, count as
    filled up with zeros. Rows that repeat are rows of their own; with fewer than `entries` rows there are as many entries.
    label_error is the error summed over equal labels, null being a label; sums are combined before they move.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries must be 1 to 256: a code has a byte a part")
    vectors, width = integer_vectors(df.select(F.col(id_column).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("_x")), "_x", ["vec_id", "label"], scale)
    width = -(-max(1, width) // parts) * parts
    books = codebooks(vectors, width, parts, entries, rounds, "vec_id")
    coded = settled(encode(vectors, books, width, ["vec_id", "label"]), "codes")
    sums = settled(coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), "label-errors")
    few = sums.count() <= BROADCAST  # otherwise by shuffle, where Spark splits a label of very many rows
    joined = coded.join(F.broadcast(sums) if few else sums.hint("merge"), F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))
