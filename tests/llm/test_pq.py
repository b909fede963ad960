import hashlib
import math
import random

import numpy as np

from lorelink.llm import pq

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error string"


def brute(rows, parts=4, entries=256, rounds=4):
    kept = [(i, [math.floor(1024 * x) for x in v], b) for i, v, b in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max((len(v) for _, v, _ in kept), default=1) or 1
    width = -(-width // parts) * parts
    kept = [(i, v + [0] * (width - len(v)), b) for i, v, b in kept]
    each = width // parts
    cut = [[v[p * each : (p + 1) * each] for p in range(parts)] for _, v, _ in kept]
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:entries]
    books = [[cut[k][p] for k in first] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(books[p]))

    for _ in range(rounds):
        chosen = [[nearest(p, c[p])[1] for p in range(parts)] for c in cut]
        for p in range(parts):
            new = list(books[p])
            for j in range(len(new)):
                own = [c[p] for c, a in zip(cut, chosen) if a[p] == j]
                if own:
                    new[j] = [sum(x) // len(own) for x in zip(*own)]
            books[p] = new
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = [(i, b, [nearest(p, c[p]) for p in range(parts)]) for (i, _, b), c in zip(kept, cut)]
    sums = {}
    for _, b, f in found:
        sums[b] = sums.get(b, 0) + sum(x[0] for x in f)
    return sorted(((i, "".join(f"{x[1]:02x}" for x in f), sum(x[0] for x in f), sums[b], digest) for i, b, f in found), key=str)


def run(spark, rows, **how):
    df = spark.createDataFrame([(i, v, b, "clash", "clash") for i, v, b in rows], SCHEMA)
    return sorted((tuple(r[c] for c in ("vec_id", "code", "error", "label_error", "codebooks_sha256")) for r in pq.compress(df, **how).collect()), key=str)


def test_against_brute_force(spark):
    rng = random.Random(1)
    vec = lambda n: [round(rng.uniform(-1, 1), 2) for _ in range(n)]
    rows = [(i, vec(8), rng.choice((0, 1, None))) for i in range(120)]
    rows += [(1000 + i, rows[5][1], 1) for i in range(40)]  # ties and repeats
    rows += [rows[3], (None, vec(8), 0), (300, None, 0), (301, [float("nan")] * 8, 0), (302, [None, 1.0], 1), (303, [float("inf")], 1), (304, [], 2), (305, vec(6), 2), (306, [0.0] * 8, None)]
    assert run(spark, rows, entries=16) == brute(rows, entries=16)
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, parts=3, entries=5, rounds=1) == brute(rows, 3, 5, 1)


def test_small_tables(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None, 1)]) == []
    rows = [(1, [0.5, 0.25, 0.125, -0.7], None)]
    assert run(spark, rows) == brute(rows)


def test_very_large_components(spark):
    bound = pq.component_bound(4)
    got = run(spark, [(1, [3e38, 0.0, 0.0, 0.0], 1), (2, [-3e38, 0.0, 0.0, 0.0], 1)], entries=1, rounds=0)
    assert got[1][2] == (2 * bound) ** 2
    assert [pq.component_bound(w) for w in (0, 64, 256, 1024)] == [1 << 26, 1 << 26, 1 << 26, 1 << 25]
    for width in (1, 64, 4096, 1 << 20):
        assert 4 * pq.component_bound(width) ** 2 * width <= 1 << 62


def test_annulus_holds_the_nearest_and_spares_the_rest():
    rng = np.random.default_rng(1)
    for scale in (1000, 1 << 26):
        entries = (rng.normal(size=(256, 4)) * scale / 8 * np.exp(rng.normal(size=(256, 1)))).astype(np.int64).clip(-scale, scale)
        entries[200] = entries[17]  # equal entries: the lower index
        parts = np.concatenate([entries[::3] + 1, entries[200:201], np.zeros((2, 4), np.int64), (rng.normal(size=(400, 4)) * scale / 8).astype(np.int64)])
        visited = []
        index, square = pq.Codebook(entries).nearest(parts, block=16, visited=visited)
        for k, x in enumerate(parts.tolist()):
            far = [sum((a - b) ** 2 for a, b in zip(x, c)) for c in entries.tolist()]
            assert (int(index[k]), int(square[k])) == (far.index(min(far)), min(far))
        assert sum(visited) < 0.75 * len(parts) * len(entries)
