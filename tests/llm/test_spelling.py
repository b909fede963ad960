import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from lorelink.llm import spelling
from lorelink.llm.common import utf8

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_counts(rows, least, drop):
    out = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            w = run.translate(LOWER)
            if i is not None and (h := zlib.crc32(f"{i}:{w}".encode())) % drop == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= least:
                out[w] += 1
    return out


def edits(word, alphabet):
    out = {word[:i] + word[i + 1 :] for i in range(len(word))}
    out |= {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in alphabet}
    out |= {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in alphabet}
    return out - {word}


def near(a, b):
    """Exactly one edit between the two, by cutting what they share."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def brute(rows, least=5, occurrences=3, drop=97):
    n = {w: c for w, c in brute_counts(rows, least, drop).items() if c >= occurrences}
    close = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(close[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(close[w]), n[form[w]] if form[w] else None))
    return out


def texts(seed, count):
    """Texts of a few stems and their misspellings, of letters with and without accents."""
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abcdeéßÿ") for _ in range(rng.randint(4, 9))) for _ in range(25)]

    def word():
        w = rng.choice(stems)
        for _ in range(rng.choice((0, 0, 1, 2))):
            w = rng.choice(sorted(edits(w, "abé")))
        return w.upper() if rng.random() < 0.1 else w

    marks = (" ", ", ", "\n", "1", " 中", "Ā", "_", "\U0001f600", "× ", " ÷")
    return [(i, "".join(word() + rng.choice(marks) for _ in range(rng.randint(0, 60)))) for i in range(count)]


def run(spark, rows, **how):
    df = spark.createDataFrame([(i, t, "clash", "clash", 1) for i, t in rows], "doc_id long, text string, word string, n string, root int")
    got = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variant_groups(df, **how).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_against_brute_force(spark):
    rows = texts(1, 150)
    rows += rows[:20]  # repeated rows count
    rows += [(None, rows[3][1]), (500, None), (501, ""), (502, "12 _ 中"), (503, "a" * 300_000), (504, " ".join(rows[7][1] for _ in range(300)))]
    got = run(spark, rows)
    assert got == brute(rows)
    assert any(r[2] != r[1] and r[1] for r in got), "forms in chains are part of the case"
    assert run(spark, rows, least=4, occurrences=1, drop=3) == brute(rows, 4, 1, 3)


def test_small_tables(spark):
    assert run(spark, []) == set()
    assert run(spark, [(1, None), (2, ""), (None, None)]) == set()
    assert run(spark, [(1, "house house house")], drop=1 << 31) == {("house", None, "house", 3, 0, None)}
    # ties end by code points; a form needs twice the count
    rows = [(1, "abcde " * 3 + "abcdf " * 6 + "abcdg " * 6 + "éabcdf " * 4)]
    assert run(spark, rows, drop=1 << 31) == brute(rows, drop=1 << 31)


def test_neighbourhoods_are_whole_and_distinct():
    alphabet = np.array(sorted(map(ord, "abcé\U0001f600")), np.uint32)
    for word in ("aabbb", "a", "cééc", "\U0001f600a\U0001f600"):
        points = np.frombuffer(word.encode("utf-32-le"), np.uint32)[None, :]
        made = [s for _, p in spelling.neighbourhood(points, alphabet) for s in (spelling.strings(p) if p.shape[1] else [])]
        assert len(made) == len(set(made))
        assert set(made) == edits(word, "abcé\U0001f600") - {""}


def test_the_bitmap_lets_all_words_through():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcd") for _ in range(6)) for _ in range(500)]
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(-1, 6)
    for bits in (10, 16):
        h = spelling.hashes(points)
        bitmap = np.zeros(1 << (bits - 3), np.uint8)
        for factor in (spelling._FIRST, spelling._SECOND):
            p = spelling.places(h, bits, factor)
            np.bitwise_or.at(bitmap, (p >> np.uint64(3)).astype(int), np.left_shift(1, (p & np.uint64(7)).astype(np.uint8), dtype=np.uint8))
        alphabet = np.array(sorted(map(ord, "abcd")), np.uint32)
        passed = {(int(w), s) for who, p in spelling.neighbourhood(points, alphabet, bitmap, bits) for w, s in zip(who, spelling.strings(p), strict=True)}
        assert {(i, v) for i, w in enumerate(words) for v in words if near(w, v)} <= passed


def test_counts_of_any_portions():
    rows = texts(3, 40) + [(99, ""), (100, "abécd" * 30), (101, "é" * 500 + " end")]
    data, ends = utf8(pa.array([t for _, t in rows]))
    for window in (1, 7, 64, 1 << 20):
        got = Counter()
        for words, n in spelling.counted(data, ends, [str(i) for i, _ in rows], 5, 7, window):
            for w, c in zip(words, n.tolist(), strict=True):
                got[w] += c
        assert got == brute_counts(rows, 5, 7)
