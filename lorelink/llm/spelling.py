"""Spelling variants: every word's full neighbourhood of one edit, joined with the vocabulary.

Words are counted in Arrow batches, where a batch's words are cut, hashed and counted as arrays; Spark adds up the counts.
For each word of the vocabulary all strings that one deletion, one replacement or one insertion over the vocabulary's own
alphabet makes are generated, each once: a run of one letter loses its first, and a letter isn't inserted behind its own
kind. They are generated as rolling hashes, thousands of words at a time; those that a bitmap of the vocabulary's hashes
(of bounded size) rules out go no further, the rest become strings and meet the vocabulary in a hash join. What the join
finds differs by one edit by its making, so no distance is ever computed. A fuller bitmap lets more strings through to the
join and never changes the result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, settled, utf8

#: Letters of runs: A-Z lower-cased, a-z, U+00C0 to U+00FF (as one byte each); the first byte of the latter's UTF-8 is dropped, all else parts runs.
_BYTES = np.full(256, 32, np.uint8)
_BYTES[97:123] = np.arange(97, 123)
_BYTES[65:91] = np.arange(97, 123)
_BYTES[0xC3] = 0

#: Factors of the rolling hash and of its two places in the bitmap (odd, otherwise arbitrary).
_BASE, _FIRST, _SECOND = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
#: The bitmap has this many bits for each word, and no more than 2 to MOST_BITS (32 MB) altogether.
BITS_PER_WORD, MOST_BITS = 32, 28
#: Runs of more bytes than this are hashed one by one.
SHORT = 64


# --- words and their counts ---


def _crc_shift() -> np.ndarray:
    """What one more byte makes of each of the 4 bytes of a CRC-32 register: 4 tables of 256."""
    table = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)
    values = np.arange(256, dtype=np.uint32)
    return np.stack([table] + [values << np.uint32(8 * (k - 1)) for k in (1, 2, 3)])


_SHIFT = _crc_shift()


def _shifted(crc: np.ndarray) -> np.ndarray:
    """CRC-32 registers, without their inversion, after one more zero byte."""
    out = _SHIFT[0][crc & np.uint32(255)]
    for k in (1, 2, 3):
        out = out ^ _SHIFT[k][(crc >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def runs_of(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased letters (a byte each; blanks for all else), first and past-the-last place of each run, and its text; texts begin at `starts` of the UTF-8 `data`."""
    lead = np.flatnonzero(data == 0xC3)
    letters = _BYTES[data]
    follow = lead[lead + 1 < len(data)] + 1
    letters[follow] = data[follow] | 0x40
    letters = np.delete(letters, lead)
    starts = starts - np.searchsorted(lead, starts, "left")
    inside = letters != 32
    cut = np.zeros(len(letters) + 1, bool)
    cut[starts] = True
    begins = inside & np.append(True, ~inside[:-1]) | inside & cut[:-1]
    ends = inside & np.append(~inside[1:], True) | inside & cut[1:]
    begin = np.flatnonzero(begins)
    return letters, begin, np.flatnonzero(ends) + 1, np.searchsorted(starts, begin, "right") - 1


def _windows(data: np.ndarray, ends: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of about `size` bytes that part no run: at a text's end or before a byte that is neither a letter nor part of one."""
    lo = 0
    while lo < len(data):
        hi = lo + size
        if hi >= len(data):
            yield lo, len(data)
            return
        k = int(np.searchsorted(ends, hi))
        if k and ends[k - 1] > lo:
            hi = int(ends[k - 1])
        else:
            stop = int(ends[k])
            while hi < stop:
                cut = np.flatnonzero((data[hi : hi + 4096] < 0x80) & (_BYTES[data[hi : hi + 4096]] == 32))
                if len(cut):
                    hi = min(stop, hi + int(cut[0]))
                    break
                hi = min(stop, hi + 4096)
        yield lo, hi
        lo = hi


def counted(data: np.ndarray, ends: np.ndarray, ids: list[str | None], least: int, drop: int, window: int = 1 << 23) -> Iterator[tuple[list[str], np.ndarray]]:
    """Words of at least `least` letters and their counts, in portions, of texts that end at `ends` (the first at 0).

    Where `drop` divides h, the CRC-32 of `<id>:<run>`, the run loses its letter h modulo its length; texts without an id
    keep all runs as they are.
    """
    known = np.array([i is not None for i in ids], bool)
    prefix = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
    for lo, hi in _windows(data, ends[1:], window):
        a, b = int(np.searchsorted(ends, lo, "right")) - 1, int(np.searchsorted(ends, hi, "left"))
        letters, begin, end, text = runs_of(data[lo:hi], np.maximum(ends[a:b] - lo, 0))
        if not len(begin):
            continue
        length = end - begin
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(np.append(0, np.cumsum(length))), pa.py_buffer(letters[letters != 32])])
        coded = words.dictionary_encode()
        code = coded.indices.to_numpy()
        distinct = [w.decode("latin-1") for w in coded.dictionary.to_pylist()]
        whole = [w.encode() for w in distinct]
        crc, size = np.array([zlib.crc32(w) for w in whole], np.uint32), np.array([len(w) for w in whole])
        # the CRC-32 of two texts joined is the first one's, moved on by the second one's bytes, xor the second one's
        most = int(min(size.max(), SHORT))
        moved = np.empty((most + 1, b - a), np.uint32)
        moved[0] = prefix[a:b]
        for k in range(most):
            moved[k + 1] = _shifted(moved[k])
        bytes_ = size[code]
        h = moved[np.minimum(bytes_, most), text] ^ crc[code]
        for i in np.flatnonzero(bytes_ > most):
            h[i] = zlib.crc32(whole[code[i]], int(prefix[a + text[i]]))
        hit = (h % np.uint32(drop) == 0) & known[a + text]
        n = np.bincount(code[~hit], minlength=len(distinct))
        wanted = np.flatnonzero((n > 0) & (np.array([len(w) for w in distinct]) >= least))
        yield [distinct[i] for i in wanted], n[wanted]
        cut = [distinct[c][: (p := x % m)] + distinct[c][p + 1 :] for c, x, m in zip(code[hit].tolist(), h[hit].tolist(), length[hit].tolist(), strict=True)]
        cut = [w for w in cut if len(w) >= least]
        yield cut, np.ones(len(cut), np.int64)


def word_counts(docs: DataFrame, id_column: str = "doc_id", text: str = "text", least: int = 5, drop: int = 97) -> DataFrame:
    """word, n: occurrences over all texts of each run of letters of at least `least` code points, as counted() has it; null texts have none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = utf8(batch.column(1))
            for words, n in counted(data, ends, batch.column(0).to_pylist(), least, drop):
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n, pa.int64())], ["word", "n"])

    rows = docs.where(F.col(text).isNotNull()).select(F.col(id_column).cast("string").alias("id"), F.col(text).alias("text"))
    return map_arrow(rows, count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


# --- neighbourhoods ---


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the words of each length, and their code points as a matrix."""
    sizes = np.array([len(w) for w in words])
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        if n:
            yield at, np.frombuffer("".join(words[i] for i in at).encode("utf-32-le"), np.uint32).reshape(len(at), n)


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.append(np.uint64(1), np.full(n, _BASE, np.uint64)), dtype=np.uint64)


def hashes(points: np.ndarray) -> np.ndarray:
    """Rolling hashes of words, a row of code points each: sums of code points times powers of the base, modulo 2 to 64."""
    return (points.astype(np.uint64) * _powers(points.shape[1])[:-1]).sum(axis=1, dtype=np.uint64)


def places(h: np.ndarray, bits: int, factor: int) -> np.ndarray:
    """A hash's place in a bitmap of 2 to `bits` bits."""
    return ((h ^ (h >> np.uint64(32))) * np.uint64(factor)) >> np.uint64(64 - bits)


def _found(bitmap: np.ndarray, bits: int, h: np.ndarray) -> np.ndarray:
    """Places of the hashes that the bitmap may hold."""
    p = places(h, bits, _FIRST)
    there = np.flatnonzero(bitmap[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8) & 1)
    p = places(h[there], bits, _SECOND)
    return there[(bitmap[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8) & 1).astype(bool)]


def neighbourhood(points: np.ndarray, alphabet: np.ndarray, bitmap: np.ndarray | None = None, bits: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All distinct strings one edit from each of the words (a row of code points each): which word, and code points.

    With a bitmap only those that it may hold. Memory is bounded by the caller's rows times their length times the alphabet.
    """
    n, size = points.shape
    power = _powers(size + 1)
    terms = points.astype(np.uint64) * power[:size]
    head = np.concatenate([np.zeros((n, 1), np.uint64), np.cumsum(terms, axis=1, dtype=np.uint64)], axis=1)
    whole, letters = head[:, -1:], alphabet.astype(np.uint64)
    tail = whole - head
    back = np.uint64(pow(_BASE, -1, 1 << 64))

    def chosen(h: np.ndarray, allowed: np.ndarray) -> np.ndarray:
        if bitmap is None:
            return np.flatnonzero(allowed)
        at = _found(bitmap, bits, h.reshape(-1))
        return at[allowed.reshape(-1)[at]]

    if size > 1:  # deletions: of a run of equal letters the first
        allowed = np.ones((n, size), bool)
        allowed[:, 1:] = points[:, 1:] != points[:, :-1]
        at = chosen(head[:, :-1] + tail[:, 1:] * back, allowed)
        who, i = at // size, at % size
        keep = np.arange(size - 1)[None, :]
        yield who, points[who[:, None], keep + (keep >= i[:, None])]
    for i in range(size):  # replacements
        h = whole + (letters[None, :] - points[:, i : i + 1].astype(np.uint64)) * power[i]
        at = chosen(h, alphabet[None, :] != points[:, i : i + 1])
        who, c = at // len(alphabet), at % len(alphabet)
        made = points[who].copy()
        made[:, i] = alphabet[c]
        yield who, made
    for i in range(size + 1):  # insertions: not behind a letter of the same kind, which is the insertion before it
        h = head[:, i : i + 1] + letters[None, :] * power[i] + tail[:, i : i + 1] * np.uint64(_BASE)
        allowed = np.ones(h.shape, bool) if i == 0 else alphabet[None, :] != points[:, i - 1 : i]
        at = chosen(h, allowed)
        who, c = at // len(alphabet), at % len(alphabet)
        yield who, np.concatenate([points[who, :i], alphabet[c][:, None], points[who, i:]], axis=1)


def strings(points: np.ndarray) -> list[str]:
    """Rows of code points as strings."""
    size = points.shape[1]
    joined = np.ascontiguousarray(points, "<u4").tobytes().decode("utf-32-le")
    return [joined[k : k + size] for k in range(0, len(joined), size)]


def vocabulary_bitmap(vocabulary: DataFrame, words: int) -> tuple[np.ndarray, int]:
    """The bitmap of the vocabulary's hashes, and how many bits' places it has as a power of two; bounded by MOST_BITS.

    Tasks give 64 bits at a time, Spark combines them before and after the shuffle; the driver gets at most the bitmap's size.
    """
    bits = min(MOST_BITS, max(10, int(words * BITS_PER_WORD).bit_length()))

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, points in _by_length(batch.column(0).to_pylist()):
                h = hashes(points)
                p = np.concatenate([places(h, bits, _FIRST), places(h, bits, _SECOND)])
                yield pa.RecordBatch.from_arrays([pa.array((p >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (p & np.uint64(63))).view(np.int64))], ["slot", "mask"])

    found = map_arrow(vocabulary.select("word"), marks, "slot long, mask long").groupBy("slot").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[found.column("slot").to_numpy()] = found.column("mask").to_numpy().view(np.uint64)
    return out.view(np.uint8), bits


def near_words(vocabulary: DataFrame) -> DataFrame:
    """word, n, near, near_n: each pair of words of `vocabulary` (word, n; distinct words) that differ by exactly one inserted,
    deleted or replaced code point, from both sides. Null and empty words have no near words.
    """
    spark = vocabulary.sparkSession
    vocabulary = vocabulary.where(F.length("word") > 0)

    def points_used(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            used = np.unique(np.frombuffer("".join(batch.column(0).to_pylist()).encode("utf-32-le"), np.uint32))
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int64))], ["point"])

    alphabet = np.array(sorted(r[0] for r in map_arrow(vocabulary.select("word"), points_used, "point long").distinct().collect()), np.uint32)
    words = vocabulary.count()
    shared = spark.sparkContext.broadcast(vocabulary_bitmap(vocabulary, words))

    def edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, bits = shared.value
        for batch in batches:
            all_words, n = batch.column(0).to_pylist(), batch.column(1)
            for at, points in _by_length(all_words):
                step = max(1, (1 << 19) // max(1, len(alphabet)))
                for lo in range(0, len(at), step):
                    for who, made in neighbourhood(points[lo : lo + step], alphabet, bitmap, bits):
                        if len(who):
                            source = pa.array(at[lo + who])
                            yield pa.RecordBatch.from_arrays([batch.column(0).take(source), n.take(source), pa.array(strings(made), pa.string())], ["word", "n", "near"])

    candidates = map_arrow(vocabulary.select("word", "n"), edits, "word string, n long, near string")
    return candidates.join(vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n")).hint("shuffle_hash"), "near").select("word", "n", "near", "near_n")


def forms(vocabulary: DataFrame) -> DataFrame:
    """word, n, form, form_n, n_near: form is the near word of largest n (ties: the smallest by code points) if that n is twice the word's or more."""
    pairs = near_words(vocabulary)
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w"))).alias("_best"))
    joined = vocabulary.join(best, "word", "left")
    led = -F.col("_best.m") >= 2 * F.col("n")
    return joined.select("word", "n", F.when(led, F.col("_best.w")).alias("form"), F.when(led, -F.col("_best.m")).alias("form_n"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))


def variant_groups(docs: DataFrame, id_column: str = "doc_id", text: str = "text", least: int = 5, occurrences: int = 3, drop: int = 97) -> DataFrame:
    """word, form, root, n, n_near, form_n: a row for each word of `least` code points and `occurrences` or more.

    root is the last word that forms lead to from the word, itself if it has none; counts at least double at each step, so
    there are no cycles and few steps, which pointer doubling halves. Repeated rows count as often as they stand; texts
    that are null, and tables without rows, have no words; texts without an id lose no letters.
    """
    vocabulary = settled(word_counts(docs, id_column, text, least, drop).where(F.col("n") >= occurrences), "vocabulary")
    found = settled(forms(vocabulary), "forms")
    links = found.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = settled(links.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        links = moved.select("word", "root")
        if moved.where("_moved").isEmpty():
            break
    return found.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
