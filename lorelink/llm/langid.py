"""Language identification by a convolutional network over bytes.

Bytes of the text in lower case (digits as one) are embedded; filters of several widths run over a window of fixed
length, each filter's maximum over the window is kept, and a softmax over these gives the languages. It is trained here
with numpy on labelled text. A text is cut into windows that cover all of it; its score for a language is the mean of
the windows' probabilities, weighted by their bytes. Windows of many texts are evaluated in one matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, others, spread_sample, utf8

UNKNOWN = "und"
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("0") : ord("9") + 1] = ord("0")
_FOLD[[9, 10, 13]] = 32


@dataclass(frozen=True)
class Settings:
    window: int = 256
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 8
    embedding: int = 8
    each: int = 400  # labelled texts to learn from, for each language
    windows_each: int = 6  # training windows of each text
    epochs: int = 8
    seed: int = 20


class ByteConvNet:
    """Weights; filters of all widths stand in one matrix, with zeros where a narrow one doesn't reach."""

    def __init__(self, languages: list[str], s: Settings) -> None:
        rng = np.random.default_rng(s.seed)
        self.languages, self.s, self.reach = languages, s, max(s.widths)
        f = s.filters * len(s.widths)
        self.p = {"e": rng.normal(0, 0.5, (256, s.embedding)), "w": rng.normal(0, 0.3, (self.reach * s.embedding, f)), "b": np.zeros(f), "o": rng.normal(0, 0.3, (f, len(languages))), "c": np.zeros(len(languages))}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.used = np.zeros_like(self.p["w"])
        for i, w in enumerate(s.widths):
            self.used[: w * s.embedding, i * s.filters : (i + 1) * s.filters] = 1
        self.p["w"] *= self.used

    def _patches(self, windows: np.ndarray) -> np.ndarray:
        """windows: rows of window + reach - 1 bytes, zeros after the text."""
        x = self.p["e"][windows].reshape(len(windows), -1)
        e = self.s.embedding
        return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(x, self.reach * e, axis=1)[:, ::e])

    def _pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        patches = self._patches(windows)
        n, t, k = patches.shape
        return patches, (patches.reshape(n * t, k) @ self.p["w"]).reshape(n, t, -1)

    def probabilities(self, windows: np.ndarray, step: int = 32) -> np.ndarray:
        out = np.empty((len(windows), len(self.languages)), np.float32)
        for i in range(0, len(windows), step):
            top = np.maximum(self._pooled(windows[i : i + step])[1].max(axis=1) + self.p["b"], 0)
            z = top @ self.p["o"] + self.p["c"]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            out[i : i + step] = z / z.sum(axis=1, keepdims=True)
        return out

    def _gradients(self, windows: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        patches, conv = self._pooled(windows)
        n = len(windows)
        at = conv.argmax(axis=1)
        raw = np.take_along_axis(conv, at[:, None], 1)[:, 0] + self.p["b"]
        top = np.maximum(raw, 0)
        z = top @ self.p["o"] + self.p["c"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        d = z / z.sum(axis=1, keepdims=True)
        d[np.arange(n), y] -= 1
        d /= n
        g = {"o": top.T @ d, "c": d.sum(0)}
        back = (d @ self.p["o"].T) * (raw > 0)
        g["b"] = back.sum(0)
        chosen = patches[np.arange(n)[:, None], at]  # window, filter, patch
        g["w"] = np.einsum("nf,nfk->kf", back, chosen) * self.used
        spread = np.einsum("nf,kf->nfk", back, self.p["w"]).reshape(n, at.shape[1], self.reach, -1)
        bytes_at = windows[np.arange(n)[:, None, None], at[:, :, None] + np.arange(self.reach)]
        g["e"] = np.zeros_like(self.p["e"])
        np.add.at(g["e"], bytes_at.ravel(), spread.reshape(-1, self.s.embedding))
        return g

    def fit(self, windows: np.ndarray, y: np.ndarray, batch: int = 64, rate: float = 0.01) -> None:
        """Adam; the rate falls to nothing. Rare languages weigh as much as frequent ones, as they are drawn as often."""
        rng = np.random.default_rng(self.s.seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        rows = [np.flatnonzero(y == k) for k in range(len(self.languages))]
        steps = max(1, self.s.epochs * len(y) // batch)
        for t in range(1, steps + 1):
            kinds = rng.integers(0, len(rows), batch)
            pick = np.array([rows[k][rng.integers(len(rows[k]))] for k in kinds])
            for k, g in self._gradients(windows[pick], y[pick]).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                self.p[k] -= (rate * (1 - t / (steps + 1)) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)


def _folded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, ends = utf8(pc.utf8_lower(texts))
    return _FOLD[data], ends


def cut(data: np.ndarray, ends: np.ndarray, window: int, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that cover each text from start to end, the text each belongs to, and its bytes. Bytes after a text count as zero."""
    sizes = np.diff(ends)
    count = -(-sizes // window)
    owner = np.repeat(np.arange(len(sizes)), count)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    start = ends[owner] + k * window
    size = np.minimum(window, ends[owner + 1] - start)
    place = start[:, None] + np.arange(window + reach - 1)
    rows = np.append(data, np.uint8(0))[np.minimum(place, len(data))]
    rows[place >= (start + size)[:, None]] = 0
    return rows, owner, size


def pieces(ends: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts cut at every `most` bytes: the pieces' ends, and the text of each. If windows divide `most`, their windows are the texts'."""
    count = np.maximum(1, -(-np.diff(ends) // most))
    text_of = np.repeat(np.arange(len(count)), count)
    k = np.arange(len(text_of)) - np.repeat(np.cumsum(count) - count, count)
    return np.append(ends[text_of] + k * most, ends[-1]), text_of


def train(docs: DataFrame, s: Settings = Settings()) -> ByteConvNet | None:
    """Learn from doc_id, text, lang of `docs`, of which about s.each rows for each language are read; None without any.

    Several windows of each sampled text, at places that a hash gives, come to the driver: at most
    2 * each * windows_each * window bytes (times 4, if all characters are long) for each language.
    """
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "text", "lang")
    chosen = spread_sample(known, "lang", "doc_id", s.each, s.seed)
    at = [F.substring(F.col("text"), (F.pmod(F.xxhash64(F.lit(s.seed + i), F.col("doc_id")), F.greatest(F.lit(1), F.char_length("text") - s.window // 2)) + 1).cast("int"), F.lit(s.window)) for i in range(s.windows_each)]
    rows = chosen.select("lang", F.array(*at).alias("parts")).collect()
    if not rows:
        return None
    net = ByteConvNet(sorted({r.lang for r in rows}), s)
    place = {x: k for k, x in enumerate(net.languages)}
    rng = np.random.default_rng(s.seed)
    texts, y = [], []
    for r in sorted(rows, key=lambda r: (r.lang, r.parts)):
        for i, part in enumerate(r.parts):
            texts.append(part if i % 3 else part[: int(rng.integers(8, s.window))])  # a third of them short
            y.append(place[r.lang])
    data, ends = _folded(pa.array(texts, pa.string()))
    windows, owner, size = cut(data, ends, s.window, net.reach)
    full = size >= 6
    net.fit(windows[full], np.array(y)[owner[full]])
    return net


def predict(docs: DataFrame, net: ByteConvNet | None, keep: list[str], text: str = "text") -> DataFrame:
    """`keep` columns, lang_pred and score (the mean probability of lang_pred) of every whole text.

    Texts that are null or have no letter are `und` with score 0, and so are all texts if there is no model. Rows stay
    as they are; no row moves. Where a column of `keep` has the name of one that is made, the made one stands.
    """
    keep = others(keep, "lang_pred", "score")
    chosen = docs.select(*keep, F.when(F.col(text).rlike(r"\p{L}"), F.col(text)).alias("_text"))
    at = len(keep)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            lang, score = np.full(n, UNKNOWN, object), np.zeros(n)
            if net is not None and n:
                data, ends = _folded(batch.column(at))
                total = np.zeros((n, len(net.languages)))
                edges, text_of = pieces(ends, net.s.window * 4096)
                first = 0
                while first < len(text_of):  # windows of about 1 MB of text at a time
                    last = max(first + 1, int(np.searchsorted(edges, edges[first] + (1 << 20), "right")) - 1)
                    base = edges[first]
                    windows, owner, size = cut(data[base : edges[last]], edges[first : last + 1] - base, net.s.window, net.reach)
                    if len(windows):
                        np.add.at(total, text_of[owner + first], net.probabilities(windows) * size[:, None])
                    first = last
                weight = total.sum(axis=1)
                seen = weight > 0
                best = total.argmax(axis=1)
                lang[seen] = np.array(net.languages, object)[best[seen]]
                score[seen] = np.clip(total[seen, best[seen]] / weight[seen], 0, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(lang, pa.string()), pa.array(score)], [*keep, "lang_pred", "score"])

    types = dict(chosen.dtypes)
    return map_arrow(chosen, apply, ", ".join([*(f"`{k}` {types[k]}" for k in keep), "lang_pred string", "score double"]))
