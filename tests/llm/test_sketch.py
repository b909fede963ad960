import hashlib
import random
import re

from pyspark.sql import functions as F

from lorelink.llm import sketch

SCHEMA = "doc_id long, text string, hashes string, n_chars string"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def rows_of():
    rng = random.Random(9)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnopqrst")
    rows = [(i * 3, " ".join(word() for _ in range(rng.randint(1, 900)))) for i in range(150)]
    rows += [(10_000 + i, "the very same text in a hot group of copies here") for i in range(120)]
    return rows + [(-5, None), (-4, ""), (-3, "é" * 10), (-2, "a b c d"), (-1, "w " * 60_000)]


def test_every_hash_below_the_threshold(spark):
    rows = rows_of()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    all_, some = (df.select("doc_id", sketch.sketch(F.col("text"), 5, bits).alias("h")).collect() for bits in (1, sketch.FRACTION_BITS))
    few = {r.doc_id: r.h for r in some}
    text = dict(rows)
    for r in all_:
        n = len(shingles(text[r.doc_id]))
        below = [h for h in r.h.hashes if 0 <= h < 1 << (64 - sketch.FRACTION_BITS)]
        h = few[r.doc_id]
        assert h.hashes == sorted(set(h.hashes)) and h.whole == r.h.whole == (n <= sketch.WHOLE)
        assert len(h.hashes) == n if h.whole else h.hashes == below


def test_containment_of_short_texts(spark):
    """Whole in a long text: 1, whatever hashes a short text has; and the mean over all texts that share a part is that part."""
    rng = random.Random(2)
    word = lambda: f"w{rng.randrange(10**6)}"
    long_ = [word() for _ in range(2000)]
    rows = []
    for k in (6, 30, 60, 400):
        for _ in range(100):
            at = rng.randrange(2000 - k)
            rows.append((k, 1.0, " ".join(long_[at : at + k])))
            rows.append((k, 0.5, " ".join(long_[at : at + k // 2 + 2] + [word() for _ in range(k // 2 - 2)])) if k > 50 else (k, 1.0, " ".join(long_[at : at + k])))
    df = spark.createDataFrame(rows, "k int, part double, text string").withColumn("long", F.lit(" ".join(long_)))
    a, b = sketch.sketch(F.col("text")), sketch.sketch(F.col("long"))
    got = df.select("k", "part", sketch.containment(a, b).alias("c"), sketch.resemblance(a, b).alias("r")).collect()
    assert all(r.c in (1.0, None) for r in got if r.part == 1.0)
    assert all(r.c == 1.0 for r in got if r.part == 1.0 and r.k >= 60)
    known = [r.c for r in got if r.k == 6]
    assert sum(c is None for c in known) < 0.75 * len(known), "two shingles: none below the threshold in 9 of 16"
    for k in (60, 400):
        some = [r.c for r in got if r.k == k and r.part == 0.5]
        assert abs(sum(some) / len(some) - 0.5) < 0.05
    assert all(abs(r.r - r.k * r.part / 2000) < 0.05 for r in got)


def test_unrelated_short_texts_are_never_contained(spark):
    rng = random.Random(3)
    long_ = " ".join(f"w{rng.randrange(10**6)}" for _ in range(2000))
    rows = [(k, " ".join(f"v{rng.randrange(10**6)}" for _ in range(k + 4))) for k in (1, 3, 8, 33) for _ in range(150)] + [(0, None), (0, "")]
    df = spark.createDataFrame(rows, "k int, text string").withColumn("long", F.lit(long_))
    a, b = sketch.sketch(F.col("text")), sketch.sketch(F.col("long"))
    got = df.select("k", sketch.containment(a, b).alias("c"), sketch.containment(b, a).alias("d"), sketch.resemblance(a, b).alias("r")).collect()
    assert {r.c for r in got if r.k} == {0.0, None} and {r.c for r in got if r.k > 30} == {0.0} and {r.c for r in got if not r.k} == {1.0}
    assert all(r.d == r.r == 0.0 for r in got)


def test_against_brute_force(spark):
    rows = rows_of()
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    got = {r.doc_id: r for r in sketch.edited_fingerprints(df).collect()}
    order = sorted(((i, t or "") for i, t in rows), reverse=True)
    error = []
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + following[:cut]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if len(shingles(t)) > 300:
            error.append(abs(near(shingles(t), shingles(edited)) - r.near_edited))
            assert r.near_next < 0.1
    assert sum(error) / len(error) < 0.08
    same = [got[10_000 + i] for i in range(1, 120)]
    assert len({r.fingerprint for r in same}) == 1 and all(r.near_next == 1 for r in same)
    assert got[-5].fingerprint == "" and got[-4].near_next == (1.0 if not shingles(order[[i for i, _ in order].index(-4) + 1][1]) else 0.0)


def test_next_over_many_ranges(spark):
    rows = rows_of()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    order = sorted((i for i, _ in rows), reverse=True)
    for size in (1, 3, 50, 10_000):
        got = {r.doc_id: r.next_doc for r in sketch.with_next(df.withColumn("doc", F.col("doc_id")), ["doc", "text"], rows_per_bucket=size).collect()}
        assert got == {i: order[(k + 1) % len(order)] for k, i in enumerate(order)}


def test_edges(spark):
    assert sketch.edited_fingerprints(spark.createDataFrame([], SCHEMA)).count() == 0
    one = sketch.edited_fingerprints(spark.createDataFrame([(1, "abcdef", "", "")], SCHEMA)).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and one.near_next == 1.0
    odd = spark.createDataFrame([(None, "x y z", "", ""), (None, "x y z", "", ""), (3, "p q r", "", ""), (3, "p q r", "", "")], SCHEMA)
    assert sketch.edited_fingerprints(odd).count() == 4


def test_sketches_merge(spark):
    df = spark.createDataFrame([(" ".join(f"w{i}" for i in range(400)), " ".join(f"v{i}" for i in range(5)))], "a string, b string")
    a, b = sketch.sketch(F.col("a")), sketch.sketch(F.col("b"))
    r = df.select(a.alias("x"), b.alias("y"), sketch.merged(a, b).alias("m"), sketch.containment(a, sketch.merged(a, b)).alias("c")).first()
    top = 1 << (64 - sketch.FRACTION_BITS)
    assert r.m.hashes == sorted({h for h in (*r.x.hashes, *r.y.hashes) if 0 <= h < top}) and not r.m.whole and r.c == 1.0
