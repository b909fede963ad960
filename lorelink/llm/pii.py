"""Personal data: patterns with checks, and a character-level bidirectional LSTM with CRF transitions that adds to them.

Patterns find the base spans, each kind by itself. The network reads classes of characters in overlapping windows; where
windows overlap, their emission scores are averaged, weighted by the distance from a window's edge, and one pass of
Viterbi and forward-backward labels a text as a whole. A labelled span is added if its mean posterior is high, it holds up
to its kind's check, and it overlaps no base span but such of its kind as it extends.

Every kind needs a digit or an @. That is part of the model: a place farther than `reach` from all digits and @ of its
text is outside any span, whatever the network says. So windows that hold no other place needn't be evaluated, and
what is between such places is decoded by itself: `find` gives what evaluating all windows and decoding whole texts gives.

Taught are spans that stand in the texts and made-up ones in place of words of the texts, half of these in forms that the
patterns don't match: accented or spaced addresses, other separators, numbers without a plus.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import map_arrow, others, spread_sample, utf8

KINDS = ("email", "ip", "card", "phone")
SPANS = "array<struct<kind:string,start:long,end:long,base:boolean>>"

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    """Whether the last digit checks the others."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that pass its check, in the order of KINDS, then of places.

    An address is sought from its @, to the left as far as its letters reach or the last match ends. That gives what
    matching from the left would, without trying every place of a long run.
    """
    out: list[Span] = []
    end = 0
    for m in _DOMAIN.finditer(text) if "@" in text else ():
        start = m.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            out.append(("email", start, m.end()))
            end = m.end()
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 8 <= len(_digits(m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def plausible(kind: str, s: str) -> bool:
    """The check that a span of the network must pass."""
    d = _digits(s)
    if kind == "email":
        return re.fullmatch(r"[^\s@]+\s?@\s?[^\s@]+\.[^\s@]+", s) is not None
    if kind == "ip":
        parts = re.findall(r"[0-9]+", s)
        return len(parts) == 4 and len(s) <= 21 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 16 <= len(d) <= 19 and len(s) <= 2 * len(d) and luhn(d)
    return 9 <= len(d) <= 15 and len(s) <= 2 * len(d) and len(s) > len(d) and re.fullmatch(r"[0-9+() ./-]+", s) is not None


# --- the network ---

_CLASS = np.full(0x250, 6, np.uint8)  # other letters
_CLASS[:128] = [7 + c for c in range(128)]
_CLASS[ord("a") : ord("z") + 1], _CLASS[ord("A") : ord("Z") + 1], _CLASS[48:58] = 1, 2, 3
_CLASS[32], _CLASS[[9, 10, 11, 12, 13]] = 4, 5
CLASSES = 7 + 128
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind


def classes(text: str) -> np.ndarray:
    """A class for each code point: letters of each case, digits, white space, other letters, or the mark itself."""
    return _CLASS[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), 0x24F)]


def tags(n: int, spans: list[Span]) -> np.ndarray:
    out = np.zeros(n, np.int64)
    for kind, a, b in spans:
        k = KINDS.index(kind)
        out[a:b] = 2 + 2 * k
        out[a] = 1 + 2 * k
    return out


@dataclass(frozen=True)
class Settings:
    window: int = 64
    stride: int = 32
    reach: int = 48  # characters from a digit or @ to the farthest place that a span can have
    hidden: int = 16
    embedding: int = 8
    each: int = 400  # texts with a digit or @ to learn from
    longest: int = 4_000  # characters of a text that is learnt from
    made_up: int = 6_000
    steps: int = 500
    batch: int = 64
    least: float = 0.75  # mean posterior of a span that is added
    seed: int = 6


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Tagger:
    """Weights of the two LSTMs, of the emission layer and of the transitions."""

    def __init__(self, s: Settings) -> None:
        rng, h = np.random.default_rng(s.seed), s.hidden
        self.s = s
        self.p = {"e": rng.normal(0, 0.5, (CLASSES, s.embedding)), "o": rng.normal(0, 0.2, (2 * h, TAGS)), "c": np.zeros(TAGS), "t": np.zeros((TAGS, TAGS))}
        for d in "fb":
            self.p["x" + d] = rng.normal(0, 0.3, (s.embedding, 4 * h))
            self.p["h" + d] = rng.normal(0, 0.3, (h, 4 * h))
            self.p["b" + d] = np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)])  # input, forget, output, new
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        allowed = np.ones((TAGS, TAGS), bool)
        for k in range(len(KINDS)):
            inside = 2 + 2 * k
            allowed[:, inside] = False
            allowed[[inside - 1, inside], inside] = True
        self.forbidden = np.where(allowed, 0, -1e4).astype(np.float32)

    def _run(self, x: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """Hidden states of one direction for rows of classes, and what the backward pass needs."""
        n, steps, h = *x.shape, self.s.hidden
        table = self.p["e"] @ self.p["x" + d] + self.p["b" + d]
        state, cell, out, saved = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32), np.empty((n, steps, h), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = table[x[:, t]] + state @ self.p["h" + d]
            g = _sigmoid(z[:, : 3 * h])
            i, f, o = g[:, :h], g[:, h : 2 * h], g[:, 2 * h :]
            new = np.tanh(z[:, 3 * h :])
            before, old = cell, state
            cell = f * cell + i * new
            squashed = np.tanh(cell)
            state = o * squashed
            out[:, t] = state
            saved.append((t, i, f, o, new, before, old, squashed))
        return out, saved

    def emissions(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._run(x, "f")[0], self._run(x, "b")[0]], axis=2) @ self.p["o"] + self.p["c"]

    def _back(self, x: np.ndarray, d: str, saved: list, dout: np.ndarray, g: dict[str, np.ndarray]) -> None:
        h = self.s.hidden
        ds, dc = np.zeros_like(dout[:, 0]), np.zeros_like(dout[:, 0])
        every = np.empty((*x.shape, 4 * h), np.float32)
        for t, i, f, o, new, before, old, squashed in reversed(saved):
            ds = ds + dout[:, t]
            dc = dc + ds * o * (1 - squashed**2)
            dz = every[:, t]
            dz[:, :h], dz[:, h : 2 * h] = dc * new * i * (1 - i), dc * before * f * (1 - f)
            dz[:, 2 * h : 3 * h], dz[:, 3 * h :] = ds * squashed * o * (1 - o), dc * i * (1 - new**2)
            g["h" + d] += old.T @ dz
            ds, dc = dz @ self.p["h" + d].T, dc * f
        order = np.argsort(x, axis=None, kind="stable")
        found, first = np.unique(x.ravel()[order], return_index=True)
        gx = np.zeros((CLASSES, 4 * h), np.float32)
        gx[found] = np.add.reduceat(every.reshape(-1, 4 * h)[order], first)
        g["b" + d] += gx.sum(0)
        g["x" + d] += self.p["e"].T @ gx
        g["e"] += gx @ self.p["x" + d].T

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss (negative log likelihood of the tags, a window) and its gradients."""
        n, steps = x.shape
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        (hf, sf), (hb, sb) = self._run(x, "f"), self._run(x, "b")
        both = np.concatenate([hf, hb], axis=2)
        e = both @ self.p["o"] + self.p["c"]
        first = np.arange(n) * steps
        flat, trans = e.reshape(-1, TAGS).astype(np.float64), self.p["t"] + self.forbidden
        post, pairs, norm = posteriors(flat, np.append(first, n * steps), trans, True)
        rows = np.arange(n * steps)
        yy = y.ravel()
        gold = flat[rows, yy].sum() + trans[y[:, :-1], y[:, 1:]].sum()
        post[rows, yy] -= 1
        de = (post / n).reshape(n, steps, TAGS).astype(np.float32)
        seen = np.bincount((y[:, :-1] * TAGS + y[:, 1:]).ravel(), minlength=TAGS * TAGS).reshape(TAGS, TAGS)
        g["t"] = ((pairs - seen) / n).astype(np.float32)
        g["o"], g["c"] = both.reshape(-1, both.shape[2]).T @ de.reshape(-1, TAGS), de.sum((0, 1))
        dboth = de @ self.p["o"].T
        self._back(x, "f", sf, dboth[:, :, : self.s.hidden], g)
        self._back(x, "b", sb, dboth[:, :, self.s.hidden :], g)
        return float(norm - gold) / n, g

    def fit(self, x: np.ndarray, y: np.ndarray, rate: float = 0.04) -> float:
        rng = np.random.default_rng(self.s.seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(p) for k, p in self.p.items()}
        loss = 0.0
        for step in range(1, self.s.steps + 1):
            pick = rng.integers(0, len(x), self.s.batch)
            now, grads = self.gradients(x[pick], y[pick])
            loss = 0.95 * loss + 0.05 * now
            scale = min(1.0, 5 / (1e-9 + np.sqrt(sum(float((g**2).sum()) for g in grads.values()))))
            for k, g in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * scale * g
                v[k] = 0.999 * v[k] + 0.001 * (scale * g) ** 2
                self.p[k] -= (rate * (1 - step / (self.s.steps + 1)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return loss

    def reached(self, x: np.ndarray) -> np.ndarray:
        """Which places of a text's classes a span can have."""
        hot = np.flatnonzero((x == 3) | (x == 7 + ord("@")))
        edges = np.zeros(len(x) + 1, np.int32)
        np.add.at(edges, np.maximum(0, hot - self.s.reach), 1)
        np.add.at(edges, np.minimum(len(x), hot + self.s.reach + 1), -1)
        return np.cumsum(edges[:-1]) > 0

    def find(self, texts: list[str], everywhere: bool = False) -> list[list[Span]]:
        """Spans of each text. With `everywhere` all windows are evaluated and whole texts decoded, for the same result."""
        s = self.s
        back = s.window // s.stride
        xs = [classes(t) for t in texts]
        # the texts in one line of blocks of `stride` places, each with blocks behind it that its last windows may cover
        blocks = np.array([-(-len(x) // s.stride) + max(1, back - 1) for x in xs], np.int64)
        head = np.concatenate([[0], np.cumsum(blocks)])
        line, near, inside = np.zeros(head[-1] * s.stride, np.uint8), np.zeros(head[-1] * s.stride, bool), np.zeros(head[-1] * s.stride, bool)
        for x, b in zip(xs, head[:-1].tolist(), strict=True):
            at = slice(b * s.stride, b * s.stride + len(x))
            line[at], near[at], inside[at] = x, self.reached(x), True
        wanted = inside if everywhere else near
        place = np.flatnonzero(wanted)
        if not len(place):
            return [[] for _ in texts]
        # sequences: stretches of wanted places, with the place before and after as one that is outside
        cut = np.flatnonzero(np.diff(place) > 1) + 1
        lo, hi = place[np.append(0, cut)], place[np.append(cut - 1, len(place) - 1)] + 1
        lo, hi = lo - inside[lo - 1] * (lo > 0), hi + inside[np.minimum(hi, len(inside) - 1)]
        trans = (self.p["t"] + self.forbidden).astype(np.float64)
        out: list[list[Span]] = [[] for _ in texts]
        groups = np.cumsum(hi - lo) // 100_000  # so many places or one stretch at a time
        for group in np.split(np.arange(len(lo)), np.flatnonzero(np.diff(groups)) + 1):
            for a, z, kind in self._decoded(line, near, head, lo[group], hi[group], trans):
                k = int(np.searchsorted(head, a // s.stride, "right")) - 1
                out[k].append((kind, int(a - head[k] * s.stride), int(z - head[k] * s.stride)))
        return out

    def _decoded(self, line: np.ndarray, near: np.ndarray, head: np.ndarray, lo: np.ndarray, hi: np.ndarray, trans: np.ndarray) -> Iterator[tuple[int, int, str]]:
        """Start, end and kind of the spans in stretches of the line."""
        s, n = self.s, hi - lo
        first = np.concatenate([[0], np.cumsum(n)])
        place = np.repeat(lo - first[:-1], n) + np.arange(first[-1])
        flat = np.full((len(place), TAGS), -1e4)
        flat[:, 0] = 0
        live = near[place]
        b = np.unique(place[live] // s.stride)
        flat[live] = self._averaged(line, b, head)[np.searchsorted(b, place[live] // s.stride), place[live] % s.stride]
        post, _, _ = posteriors(flat, first, trans)
        best = viterbi(flat, first, trans)
        last = np.zeros(len(place) + 1, bool)
        last[first[1:]] = True
        for i in np.flatnonzero(best % 2 == 1).tolist():
            end = i + 1
            while not last[end] and best[end] == best[i] + 1:
                end += 1
            if post[np.arange(i, end), best[i:end]].mean() >= s.least:
                yield int(place[i]), int(place[i]) + end - i, KINDS[int(best[i]) // 2]

    def _averaged(self, line: np.ndarray, b: np.ndarray, head: np.ndarray) -> np.ndarray:
        """Emission scores of the places of blocks b, weighted means over all windows of their text that cover them."""
        s = self.s
        back = s.window // s.stride
        start = head[np.searchsorted(head, b, "right") - 1]  # the first block of each one's text
        which = np.unique(np.concatenate([(b - j)[b - j >= start] for j in range(back)]))
        half = (s.window + 1) / 2
        weight = 1 - np.abs(np.arange(s.window) + 0.5 - s.window / 2) / half
        total, mass = np.zeros((len(b), s.stride, TAGS)), np.zeros((len(b), s.stride, 1))
        for i in range(0, len(which), 512):
            some = which[i : i + 512]
            e = self.emissions(line[some[:, None] * s.stride + np.arange(s.window)])
            for j in range(back):
                part = slice(j * s.stride, (j + 1) * s.stride)
                at = np.minimum(np.searchsorted(b, some + j), len(b) - 1)
                ok = b[at] == some + j
                total[at[ok]] += e[ok, part] * weight[part, None]
                mass[at[ok]] += weight[part, None]
        return total / mass


def _alive(first: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Starts of the sequences, the longest first, and how many of them have more than t steps, for each t."""
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    return first[:-1][order], [int(k) for k in np.searchsorted(-n[order], -np.arange(n.max() if len(n) else 0), "left")]


def posteriors(e: np.ndarray, first: np.ndarray, trans: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray, float]:
    """Tag probabilities of each step of sequences that lie one after the other; with `pairs` the expected transitions; log norms' sum."""
    starts, alive = _alive(first)
    top = e.max(1, keepdims=True)
    x, a = np.exp(e - top), np.exp(trans)
    x[first[:-1]] *= np.where(np.arange(TAGS) % 2 == 0, np.where(np.arange(TAGS) > 0, 1e-6, 1.0), 1.0)  # a sequence doesn't start inside a span
    alpha, beta, norm = np.empty_like(x), np.ones_like(x), float(top.sum())
    for t, k in enumerate(alive):
        row = starts[:k] + t
        now = x[row] if t == 0 else (alpha[row - 1] @ a) * x[row]
        total = now.sum(1, keepdims=True)
        alpha[row] = now / total
        norm += float(np.log(total).sum())
    for t in range(len(alive) - 2, -1, -1):
        row = starts[: alive[t + 1]] + t
        now = (x[row + 1] * beta[row + 1]) @ a.T
        beta[row] = now / now.sum(1, keepdims=True)
    post = alpha * beta
    post /= post.sum(1, keepdims=True)
    if not pairs:
        return post, np.zeros(0), norm
    inner = np.ones(len(e), bool)
    inner[first[:-1]] = False
    row = np.flatnonzero(inner)
    left, right = alpha[row - 1], x[row] * beta[row]
    return post, a * ((left / ((left @ a) * right).sum(1, keepdims=True)).T @ right), norm


def viterbi(e: np.ndarray, first: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """The best tags of each sequence."""
    starts, alive = _alive(first)
    score, came = e.copy(), np.zeros(e.shape, np.int8)
    score[first[:-1], 2::2] -= 14
    for t in range(1, len(alive)):
        row = starts[: alive[t]] + t
        way = score[row - 1][:, :, None] + trans
        came[row] = way.argmax(1)
        score[row] = way.max(1) + e[row]
    out = np.zeros(len(e), np.int64)
    last = np.diff(first)
    out[first[1:] - 1] = score[first[1:] - 1].argmax(1)
    order = np.argsort(-last, kind="stable")
    ends = first[1:][order] - 1
    for t in range(1, len(alive)):
        row = ends[: alive[t]] - t
        out[row] = came[row + 1, out[row + 1]]
    return out


def made_up(rng: np.random.Generator, odd: bool) -> tuple[str, str]:
    """A made-up string and its kind; an odd one is in a form that the patterns don't match, at least not as a whole."""
    d = lambda n: "".join(str(x) for x in rng.integers(0, 10, n))
    w = lambda lo=2, hi=9: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), int(rng.integers(lo, hi))))
    pick = lambda *x: str(rng.choice(x))
    kind = pick(*KINDS, "phone")  # numbers have the most forms
    if kind == "email":
        left = w() + pick(".", "_", "", "-", ".") + w() + d(int(rng.integers(0, 3)))
        right = w() + pick("", "", "-" + w(), d(1), "." + w(3)) + "." + pick("com", "org", "net", "de", "info", w(2, 4))
        if not odd:
            return left + "@" + right, kind
        if rng.integers(0, 2):
            return left + pick(" @ ", "@ ", " @") + right, kind
        strange = pick("é", "è", "ü", "ö", "ß", "ñ", "ç", "à", "ø", "ł", "î")
        at = int(rng.integers(0, len(left)))
        return left[:at] + strange + left[at:] + "@" + right, kind
    if kind == "ip":
        return pick("[.]", " . ", "(.)").join(str(x) for x in rng.integers(0, 256, 4)) if odd else ".".join(str(x) for x in rng.integers(0, 256, 4)), kind
    if kind == "card":
        body = d(int(rng.integers(15, 19)))
        full = next(body + str(c) for c in range(10) if luhn(body + str(c)))
        return (pick(".", "_", "/", "  ") if odd else pick("", " ", "-")).join(full[i : i + 4] for i in range(0, len(full), 4)), kind
    if odd:
        return pick(f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"00{d(2)} {d(3)} {d(3)} {d(4)}", f"0{d(3)}/{d(7)}", f"{d(3)}.{d(3)}.{d(4)}"), kind
    return pick(f"+{d(int(rng.integers(1, 3)))} ({d(3)}) {d(3)}-{d(4)}", f"+{d(2)} {d(3)} {d(3)} {d(4)}", f"+{d(2)}{d(9)}"), kind


def harmless(rng: np.random.Generator) -> str:
    """A made-up string that only looks like personal data."""
    d = lambda n: "".join(str(x) for x in rng.integers(0, 10, n))
    w = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), int(rng.integers(2, 9))))
    hex_ = "".join(rng.choice(list("0123456789abcdef"), 40))
    forms = [d(int(rng.integers(1, 9))), f"{d(1)}.{d(1)}", f"{d(1)}.{d(2)}.{d(1)}", f"19{d(2)}-0{d(1)}-1{d(1)}", f"{d(2)}:{d(2)}:{d(2)}", f'"{hex_}"', f"@{w}", f"{d(3)},{d(3)}", f"${d(2)}.{d(2)}", f"{d(2)}%", f"{w}{d(3)}", d(20), f"v{d(1)}.{d(1)}.{d(1)}-{d(2)}"]
    forms += [f"{d(1)},{d(3)},{d(3)}.{d(2)}", f"{d(2)}/{d(2)}/20{d(2)} {d(2)}:{d(2)}", f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", f"{hex_[:8]}-{hex_[8:12]}-{hex_[12:16]}-{hex_[16:28]}", f"{d(4)}-{d(4)}", f"#{d(6)}", f"20{d(2)}-0{d(1)}-1{d(1)}T{d(2)}:{d(2)}:{d(2)}Z", f"{w} @{w}", f"3.{d(8)}"]
    return str(rng.choice(forms))


def examples(texts: list[str], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Windows of classes and tags: base spans where they stand in the texts, and s.made_up made-up strings put between their words."""
    rng = np.random.default_rng(s.seed)
    xs, ys = [], []

    def add(text: str, spans: list[Span], middle: int) -> None:
        lo = max(0, middle - int(rng.integers(0, s.window)))
        x, y = classes(text)[lo : lo + s.window], tags(len(text), spans)[lo : lo + s.window]
        if len(y) and y[0] and y[0] % 2 == 0:  # starts inside a span
            y = y.copy()
            y[0] -= 1
        xs.append(np.pad(x, (0, s.window - len(x))))
        ys.append(np.pad(y, (0, s.window - len(y))))

    for text in texts:
        spans = base_spans(text)
        clear = [x for i, x in enumerate(spans) if all(x[2] <= z[1] or z[2] <= x[1] for j, z in enumerate(spans) if j < i)]
        for _, a, _ in clear[:20]:
            add(text, clear, a)
    for i in range(s.made_up):
        text = texts[int(rng.integers(len(texts)))] if texts else ""
        at = int(rng.integers(0, max(1, len(text) - 120)))
        words = re.sub(r"[0-9@+]", "", text[at : at + 120]).split(" ")
        k = int(rng.integers(0, len(words) + 1))
        left, right = " ".join(words[:k]), " ".join(words[k:])
        what, kind = made_up(rng, bool(i % 2)) if i % 4 < 3 else (harmless(rng), None)
        left = left + str(rng.choice([" ", " ", "\n", ": ", " (", "|"])) if left or i % 3 else ""
        text = left + what + str(rng.choice([" ", " ", "\n", ", ", ". ", "!! ", "*** "])) + right
        add(text, [(kind, len(left), len(left) + len(what))] if kind else [], len(left))
    return np.array(xs), np.array(ys)


def train(docs: DataFrame, s: Settings = Settings()) -> Tagger:
    """Fit to base spans of about s.each of the texts (doc_id, text) with a digit or @, drawn by a hash of doc_id, and made-up ones.

    At most 2 * s.each texts of up to s.longest characters (a few MB) come to the driver; without any, the made-up spans alone teach.
    """
    known = docs.where(F.col("text").rlike("[0-9@]") & (F.char_length("text") <= s.longest)).select("doc_id", "text", F.lit(1).alias("_one"))
    rows = spread_sample(known, "_one", "doc_id", s.each, s.seed).collect()
    tagger = Tagger(s)
    tagger.fit(*examples([r.text for r in sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id, r.text))], s))
    return tagger


def all_spans(texts: list[str], tagger: Tagger | None) -> list[list[tuple[str, int, int, bool]]]:
    """Base spans and those that the network adds, by kind, then start; an added one may be a base span with more at its ends."""
    base = [base_spans(t) for t in texts]
    found = tagger.find(texts) if tagger is not None else [[] for _ in texts]
    out = []
    for text, b, extra in zip(texts, base, found, strict=True):
        spans = [(*x, True) for x in b]
        for kind, lo, hi in extra:
            while lo < hi and text[lo].isspace():
                lo += 1
            while lo < hi and (text[hi - 1].isspace() or kind != "email" and text[hi - 1] in ".,;:!"):
                hi -= 1
            meets = [x for x in b if x[1] < hi and lo < x[2]]
            wider = all(x[0] == kind and lo <= x[1] and x[2] <= hi and x[1:] != (lo, hi) for x in meets)
            if wider and plausible(kind, text[lo:hi]):
                spans.append((kind, lo, hi, False))
        out.append(sorted(spans, key=lambda x: (KINDS.index(x[0]), *x[1:3])))
    return out


def redacted(text: str, spans: list[tuple[str, int, int, bool]]) -> str:
    """Each span replaced by its kind in brackets; of spans that overlap the whole stretch, by the first one's kind."""
    parts, end = [], 0
    merged: list[list] = []
    for kind, a, b, _ in sorted(spans, key=lambda x: (x[1], -x[2])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([kind, a, b])
    for kind, a, b in merged:
        parts += [text[end:a], f"[{kind.upper()}]"]
        end = b
    return "".join([*parts, text[end:]])


_HOT = np.zeros(256, bool)
_HOT[48:58] = True
_HOT[ord("@")] = True


def _portions(column: pa.Array, most: int = 4 << 20) -> Iterator[tuple[list[int], list[str]]]:
    """Rows whose text has a digit or @, in portions of about `most` bytes of text."""
    data, ends = utf8(column)
    places = np.searchsorted(np.flatnonzero(_HOT[data]), ends)
    rows = np.flatnonzero(np.diff(places))
    place, texts, size = [], [], 0
    for i in rows.tolist():
        place.append(i)
        texts.append(column[i].as_py())
        size += int(ends[i + 1] - ends[i])
        if size > most:
            yield place, texts
            place, texts, size = [], [], 0
    if place:
        yield place, texts


def find_pii(docs: DataFrame, tagger: Tagger | None, keep: list[str], text: str = "text") -> DataFrame:
    """`keep` columns and spans (kind, start, end in code points, base) of every whole text; null texts have none. No row moves.

    Where a column of `keep` has the name of one that is made, the made one stands.
    """
    keep = others(keep, "spans")
    chosen = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    at = len(keep)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for place, texts in _portions(batch.column(at)):
                for i, spans in zip(place, all_spans(texts, tagger), strict=True):
                    out[i] = [{"kind": k, "start": a, "end": b, "base": c} for k, a, b, c in spans]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(out, kind)], [*keep, "spans"])

    types = dict(chosen.dtypes)
    return map_arrow(chosen, apply, ", ".join([*(f"`{k}` {types[k]}" for k in keep), f"spans {SPANS}"]))


def redact(docs: DataFrame, tagger: Tagger | None, text: str = "text", length: str = "n_chars") -> DataFrame:
    """docs with the spans in `text` replaced by their kinds, and `length`, if there is such a column, set to the new length where a text changed."""
    columns = docs.columns
    at = columns.index(text)
    size = columns.index(length) if length in columns else None

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = list(batch.columns)
            changed: dict[int, str] = {}
            for place, texts in _portions(batch.column(at)):
                for i, t, spans in zip(place, texts, all_spans(texts, tagger), strict=True):
                    if spans:
                        changed[i] = redacted(t, spans)
            if changed:
                mask = np.zeros(batch.num_rows, bool)
                mask[list(changed)] = True
                rows = sorted(changed)
                arrays[at] = pc.replace_with_mask(arrays[at], pa.array(mask), pa.array([changed[i] for i in rows], arrays[at].type))
                if size is not None:
                    arrays[size] = pc.replace_with_mask(arrays[size], pa.array(mask), pa.array([len(changed[i]) for i in rows], arrays[size].type))
            yield pa.RecordBatch.from_arrays(arrays, columns)

    return map_arrow(docs, apply, StructType([StructField(f.name, f.dataType, True) for f in docs.schema.fields]))


def span_digest(docs_with_spans: DataFrame, keep: list[str]) -> DataFrame:
    """`keep`, n_<kind> (base spans), base_sha256 and spans as a string, kind:start:end joined by commas."""
    word = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter("spans", lambda x: x["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == kind))).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    return docs_with_spans.select(*keep, *counts, F.sha2(F.array_join(F.transform(base, word), ","), 256).alias("base_sha256"), F.array_join(F.transform("spans", word), ",").alias("spans"))
