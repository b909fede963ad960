"""Document quality by a linear-chain conditional random field over lines.

Each line is good or bad. Its emission score is linear in features of the line and of its two neighbours (kinds of
characters, lengths, repetition of words and lines); transitions tie neighbours together. Parameters are fitted with numpy
to labelled documents, whose label counts for each of their lines. Forward and backward passes give every line's
probability of being good; their mean, weighted by the lines' lengths, is the document's raw score, which a logistic
function fitted to the labels' true shares turns into the probability of label 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, others, spread_sample, utf8

_KIND = np.full(256, 9, np.uint8)
_KIND[[32, 9, 11, 12, 13, 10]] = 0
_KIND[ord("a") : ord("z") + 1] = 1
_KIND[ord("A") : ord("Z") + 1] = 2
_KIND[ord("0") : ord("9") + 1] = 3
_KIND[128:] = 4
_KIND[[ord(c) for c in ".,;:'\"-()?"]] = 5
_KIND[ord("!")] = 6
_KIND[ord("|")] = 7
_KIND[[ord(c) for c in "#$%&*+/<=>@[]\\^_`{}~"]] = 8
KINDS = 10
#: Ratios are also seen through these steps.
_STEPS = np.array([0.02, 0.1, 0.3, 0.6])
_BASE = KINDS + 6
PER_LINE = _BASE * (1 + len(_STEPS)) + 3
FEATURES = 3 * PER_LINE + 3

_ODD = 0x9E3779B97F4A7C15
_TWIN = KINDS + 2  # whether the text has the line twice; 1 in all its steps too
_TWIN_COLUMNS = [_TWIN + k * _BASE for k in range(1 + len(_STEPS))]
#: About so many bytes of lines are looked at together.
PORTION = 1 << 20


@dataclass(frozen=True)
class Settings:
    each: int = 1500  # labelled documents to learn from, for each label
    longest: int = 10_000  # longer documents (in characters) aren't learnt from
    lines: int = 150_000  # lines to learn from, at most
    steps: int = 500
    batch: int = 48
    chunk: int = 120  # lines of a training sequence at most
    seed: int = 8


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each range of bytes (which don't overlap, and are in order)."""
    size = ends - starts
    out = np.zeros(len(starts), np.uint64)
    full = np.flatnonzero(size)
    if len(full):
        first = np.cumsum(size[full]) - size[full]
        within = np.arange(int(size.sum())) - np.repeat(first, size[full])
        values = data[within + np.repeat(starts[full], size[full])].astype(np.uint64) + np.uint64(1)
        with np.errstate(over="ignore"):
            powers = np.cumprod(np.full(int(size.max()), _ODD, np.uint64))
            out[full] = np.add.reduceat(values * powers[within], first)
    return out


def split_lines(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every line of some texts, and each text's first line (one more than texts).

    A text has one line more than line feeds, so an empty text has one, which is empty.
    """
    feeds = np.flatnonzero(data == 10)
    per_text = np.searchsorted(feeds, ends[1:]) - np.searchsorted(feeds, ends[:-1]) + 1
    first = np.concatenate([[0], np.cumsum(per_text)])
    lines = int(first[-1])
    is_first, is_last = np.zeros(lines, bool), np.zeros(lines, bool)
    is_first[first[:-1]] = True
    is_last[first[1:] - 1] = True
    lo, hi = np.empty(lines, np.int64), np.empty(lines, np.int64)
    lo[is_first], lo[~is_first] = ends[:-1], feeds + 1
    hi[is_last], hi[~is_last] = ends[1:], feeds
    return lo, hi, first


def _own_features(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """PER_LINE features of lines of `data` by themselves (not whether they are twins), and their hashes."""
    lines, size = len(lo), hi - lo
    kind = _KIND[data]
    counts = np.empty((lines, KINDS))
    for k in range(KINDS):
        sums = np.concatenate([[0], np.cumsum(kind == k, dtype=np.int32)])
        counts[:, k] = sums[hi] - sums[lo]
    # words: runs of bytes that aren't white space, which lines don't share
    inside = kind != 0
    border = np.zeros(len(data) + 1, bool)
    border[lo] = border[hi] = True
    starts = np.flatnonzero(inside & (~np.concatenate([[False], inside[:-1]]) | border[:-1])) if len(data) else np.zeros(0, np.int64)
    stops = np.flatnonzero(inside & (~np.concatenate([inside[1:], [False]]) | border[1:])) + 1 if len(data) else starts
    word_line = np.searchsorted(lo, starts, "right") - 1
    words = np.bincount(word_line, minlength=lines).astype(float)
    h = _hashes(data, starts, stops)
    same = np.zeros(len(h), bool)
    for back in (1, 2, 3):
        same[back:] |= (h[back:] == h[:-back]) & (word_line[back:] == word_line[:-back])
    repeats = np.bincount(word_line, same, minlength=lines)
    ratio = counts / np.maximum(size, 1)[:, None]
    letters = counts[:, 1] + counts[:, 2] + counts[:, 4]
    base = np.column_stack([ratio, counts[:, 2] / np.maximum(counts[:, 1] + counts[:, 2], 1), repeats / np.maximum(words, 1), np.zeros(lines), np.minimum(1, size / np.maximum(words, 1) / 20), counts[:, 7:9].sum(1) / np.maximum(words, 1), letters / np.maximum(size - counts[:, 0], 1)]).astype(np.float32)
    return np.column_stack([base, *[base > s for s in _STEPS], np.log1p(size) / 10, size == 0, words <= 3]).astype(np.float32), _hashes(data, lo, hi)


def _portions(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """_own_features of all lines, about PORTION bytes of them at a time, or one line."""
    at = 0
    while at < len(lo):
        to = max(at + 1, int(np.searchsorted(hi, lo[at] + PORTION, "right")))
        yield slice(at, to), *_own_features(data[lo[at] : hi[to - 1]], lo[at:to] - lo[at], hi[at:to] - lo[at])
        at = to


def _twins(hashes: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether a text has the line, if it isn't empty, more than once."""
    text_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((hashes, text_of))
    equal = (hashes[order][1:] == hashes[order][:-1]) & (text_of[order][1:] == text_of[order][:-1])
    twin = np.zeros(len(hashes), bool)
    twin[order[1:][equal]] = True
    twin[order[:-1][equal]] = True
    return twin & (size > 0)


def _neighbours(first: np.ndarray, lines: int) -> tuple[np.ndarray, np.ndarray]:
    """Which lines are a text's first, and last."""
    is_first, is_last = np.zeros(lines, bool), np.zeros(lines, bool)
    is_first[first[:-1]] = True
    is_last[first[1:] - 1] = True
    return is_first, is_last


def line_features(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line of some texts, the lines' lengths in bytes, and each text's first line (one more than texts)."""
    lo, hi, first = split_lines(data, ends)
    own, hashes = np.empty((len(lo), PER_LINE), np.float32), np.empty(len(lo), np.uint64)
    for part, f, h in _portions(data, lo, hi):
        own[part], hashes[part] = f, h
    own[:, _TWIN_COLUMNS] = _twins(hashes, hi - lo, first)[:, None]
    is_first, is_last = _neighbours(first, len(lo))
    out = np.zeros((len(lo), FEATURES), np.float32)
    out[:, :PER_LINE] = own
    out[1:, PER_LINE : 2 * PER_LINE] = own[:-1]
    out[:-1, 2 * PER_LINE : 3 * PER_LINE] = own[1:]
    out[is_first, PER_LINE : 2 * PER_LINE] = 0
    out[is_last, 2 * PER_LINE : 3 * PER_LINE] = 0
    out[:, -3], out[:, -2], out[:, -1] = 1, is_first, is_last
    return out, hi - lo, first


def emission_scores(data: np.ndarray, ends: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """line_features(...) @ w without the matrix of all lines: a few numbers a line are kept, so very long texts fit."""
    lo, hi, first = split_lines(data, ends)
    parts = w[: 3 * PER_LINE].reshape(3, PER_LINE).T.astype(np.float32)
    own, hashes = np.empty((len(lo), 3)), np.empty(len(lo), np.uint64)
    for part, f, h in _portions(data, lo, hi):
        own[part], hashes[part] = f @ parts, h
    own += _twins(hashes, hi - lo, first)[:, None] * parts[_TWIN_COLUMNS].sum(0)
    is_first, is_last = _neighbours(first, len(lo))
    z = own[:, 0] + w[-3] + is_first * w[-2] + is_last * w[-1]
    z[1:] += np.where(is_first[1:], 0, own[:-1, 1])
    z[:-1] += np.where(is_last[:-1], 0, own[1:, 2])
    return z, hi - lo, first


class LineField:
    """Emission weights (score of good over bad), transition scores and the logistic function of the raw score."""

    def __init__(self) -> None:
        self.w, self.t = np.zeros(FEATURES), np.zeros((2, 2))
        self.slope, self.shift = 1.0, 0.0

    def marginals(self, z: np.ndarray, first: np.ndarray, parts: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """P(good) of each line by its emission score; with `parts` also the expected transitions, summed over all texts.

        All texts step together, the longest first, so those that have ended drop off the end of the arrays.
        """
        z = np.clip(z, -30, 30)
        e = np.stack([np.exp(-np.maximum(z, 0)), np.exp(np.minimum(z, 0))], axis=1)  # bad, good; the larger one is 1
        a = np.exp(self.t - self.t.max())
        n = np.diff(first)
        order = np.argsort(-n, kind="stable")
        starts, steps = first[:-1][order], n[order]
        alive = np.searchsorted(-steps, -np.arange(steps[0] if len(steps) else 0), "left")
        alpha, beta = np.empty_like(e), np.ones_like(e)
        for t, k in enumerate(alive):
            row = starts[:k] + t
            x = e[row] if t == 0 else (alpha[row - 1] @ a) * e[row]
            alpha[row] = x / x.sum(1, keepdims=True)
        for t in range(len(alive) - 2, -1, -1):
            row = starts[: alive[t + 1]] + t
            x = (e[row + 1] * beta[row + 1]) @ a.T
            beta[row] = x / x.sum(1, keepdims=True)
        p = alpha * beta
        p /= p.sum(1, keepdims=True)
        if not parts:
            return p[:, 1], None
        inner = np.ones(len(e), bool)
        inner[first[:-1]] = False
        row = np.flatnonzero(inner)
        pairs = alpha[row - 1][:, :, None] * a * (e[row] * beta[row])[:, None, :]
        return p[:, 1], (pairs / pairs.sum((1, 2), keepdims=True)).sum(0)

    def raw(self, z: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Length-weighted mean of P(good) of each text."""
        p, _ = self.marginals(z, first)
        weight = size + 1.0
        return np.add.reduceat(p * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])

    def score(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.raw(*emission_scores(data, ends, self.w)) + self.shift)))

    def fit(self, features: np.ndarray, size: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray, s: Settings) -> None:
        """Adam on the conditional likelihood of lines, then the logistic function by Newton's method with documents' weights."""
        rng = np.random.default_rng(s.seed)
        kinds = [np.flatnonzero(y == k) for k in (0, 1) if (y == k).any()]
        m, v, theta = (np.zeros(FEATURES + 4) for _ in range(3))
        for step in range(1, s.steps + 1):
            pick = np.concatenate([rng.choice(k, s.batch // len(kinds)) for k in kinds])
            lo = first[pick] + np.array([rng.integers(0, max(1, n - s.chunk + 1)) for n in np.diff(first)[pick]])
            n = np.minimum(first[pick + 1] - lo, s.chunk)
            at = np.concatenate([[0], np.cumsum(n)])
            rows = np.repeat(lo - at[:-1], n) + np.arange(at[-1])
            x, label = features[rows], np.repeat(y[pick], n)
            share = np.repeat(1 / n, n)  # each text counts once, however many lines it has
            self.w, self.t = theta[:FEATURES], theta[FEATURES:].reshape(2, 2)
            p, pairs = self.marginals((x @ self.w.astype(np.float32)).astype(float), at, parts=True)
            seen = np.zeros((2, 2))
            seen[0, 0], seen[1, 1] = ((n - 1)[y[pick] == k].sum() for k in (0, 1))
            g = np.concatenate([x.T @ ((p - label) * share) / len(pick), ((pairs - seen) / max(1, at[-1])).ravel()]) + 1e-4 * theta
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta = theta - 0.05 * (1 - step / (s.steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        self.w, self.t = theta[:FEATURES], np.clip(theta[FEATURES:].reshape(2, 2), -3, 3)
        raw = self.raw((features @ self.w.astype(np.float32)).astype(float), size, first)
        x, b = np.column_stack([raw, np.ones(len(raw))]), np.zeros(2)
        for _ in range(50):
            q = 1 / (1 + np.exp(-(x @ b)))
            curve = (x * (weight * q * (1 - q))[:, None]).T @ x + 1e-3 * np.eye(2)
            b = b - np.linalg.solve(curve, x.T @ (weight * (q - y)) + 1e-3 * b)
        self.slope, self.shift = float(max(b[0], 0.0)), float(b[1])


def train(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> LineField | None:
    """Fit to docs (doc_id, text) with labels (doc_id, quality 0 or 1); None without labelled documents.

    About s.each labels of each kind are drawn by a hash of doc_id, and the documents they name are read: at most
    4 * s.each texts of up to s.longest characters come to the driver, of which as many are learnt from as s.lines lines
    hold (a fixed number of features for each line). Rows with a null id, text or label teach nothing; an id that has both
    labels counts as bad.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("quality"))
    shares = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    chosen = spread_sample(known, "quality", "doc_id", s.each, s.seed).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    found = docs.where(F.char_length("text") <= s.longest).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = found.orderBy(F.xxhash64(F.lit(s.seed), "doc_id"), "doc_id", "text").limit(4 * s.each).collect()
    lines = np.cumsum([r.text.count("\n") + 1 for r in rows])
    rows = rows[: max(1, int(np.searchsorted(lines, s.lines, "right")))]
    if not rows:
        return None
    y = np.array([r.quality for r in rows])
    data, ends = utf8(pa.array([r.text for r in rows], pa.string()))
    features, size, first = line_features(data, ends)
    weight = np.array([shares[k] / (y == k).sum() for k in y])
    field = LineField()
    field.fit(features, size, first, y, weight * len(y) / weight.sum(), s)
    return field


def _scores(field: LineField | None, texts: pa.Array) -> np.ndarray:
    """Scores of whole texts, about 2 MB of them at a time, or one."""
    n = len(texts)
    score = np.full(n, 0.5)
    if field is not None:
        data, ends = utf8(texts)
        first = 0
        while first < n:
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + (2 << 20), "right")) - 1)
            base = ends[first]
            score[first:last] = field.score(data[base : ends[last]], ends[first : last + 1] - base)
            first = last
    return score


def score_quality(docs: DataFrame, field: LineField | None, keep: list[str], text: str = "text", cut: float = 0.3) -> DataFrame:
    """`keep` columns, score (0 to 1, higher where label 1 is likelier) and predicted (1 if score >= cut) of every whole text.

    Null and empty texts are one empty line. Without a model every score is 0.5. Rows stay as they are; no row moves.
    Where a column of `keep` has the name of one that is made, the made one stands.
    """
    keep = others(keep, "score", "predicted")
    chosen = docs.select(*keep, F.col(text).alias("_text"))
    at = len(keep)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = _scores(field, batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(score), pa.array((score >= cut).astype(np.int32))], [*keep, "score", "predicted"])

    types = dict(chosen.dtypes)
    return map_arrow(chosen, apply, ", ".join([*(f"`{k}` {types[k]}" for k in keep), "score double", "predicted int"]))


def keep_good(docs: DataFrame, field: LineField | None, text: str = "text", cut: float = 0.3) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores at least cut."""
    at = docs.columns.index(text)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(field, batch.column(at)) >= cut))

    return map_arrow(docs, apply, docs.schema)
