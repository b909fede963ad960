import random
import re

import numpy as np
import xxhash

from lorelink.llm import simhash

SCHEMA = "doc_id long, text string, fp string, root string, fingerprint string"


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(fps, errors=4):
    up = {i: i for i in fps}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= errors:
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: find(i) for i in ids}


def test_choices_cover_all_errors():
    rng = random.Random(2)
    for more in (0, 1, 2, 3):
        masks = simhash.choices(4, more)
        for _ in range(300):
            x = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(x & m == 0 for m in masks)


def near_values(rng, groups, each, lone):
    values = [rng.getrandbits(64) for _ in range(lone)]
    for _ in range(groups):
        base = rng.getrandbits(64)
        for _ in range(each):
            values.append(base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))))
    return np.unique(np.array(values, np.uint64))


def test_trie_against_all_pairs():
    values = near_values(random.Random(1), 8, 60, 500)
    got = simhash.trie_labels(values, 4, limit=64)
    want = classes(dict(enumerate(values.tolist())))
    assert got.tolist() == [want[i] for i in range(len(values))]


def test_tries_of_many_blocks():
    """Small blocks go down tries too; far pairs are dropped on the way, not at the leaves."""
    rng = random.Random(5)
    parts = [near_values(rng, 2, k, k) for k in range(1, 12)] + [np.array([7], np.uint64)]
    starts = np.cumsum([0, *map(len, parts[:-1])])
    visited = []
    got = simhash.trie_labels(np.concatenate(parts), 4, starts, visited=visited)
    for at, part in zip(starts, parts, strict=True):
        want = classes(dict(enumerate(part.tolist())))
        assert (got[at : at + len(part)] - at).tolist() == [want[i] for i in range(len(part))]
    assert len(visited) > 8 and visited[0] == len(parts)
    values = near_values(rng, 0, 0, 4000)
    visited.clear()
    simhash.trie_labels(values, 1, visited=visited)
    assert sum(visited) < 4000 * 4000 // 8  # of 8 million pairs


def test_links_and_components(spark):
    values = near_values(random.Random(3), 10, 40, 300)
    fps = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    want = classes(dict(enumerate(values.tolist())))
    groups = {frozenset(values[i] for i in want if want[i] == k) for k in set(want.values()) if sum(x == k for x in want.values()) > 1}
    for more in (0, 1):
        got = {}
        for r in simhash.components(simhash.block_links(fps, 4, more)).collect():
            got.setdefault(r.root, {r.root}).add(r.node)
        assert {frozenset(np.uint64(x & ((1 << 64) - 1)) for x in g) for g in got.values()} == groups


def test_long_chain(spark):
    n = 200
    order = list(range(n))
    random.Random(4).shuffle(order)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(500, 501), (501, 500), (7, 7)], "fp long, root long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, n)}, 501: 500}


def docs_of():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = []
    for i in range(60):
        words = [word() for _ in range(300)]
        rows.append((i, " ".join(words)))
        if i % 3 == 0:
            words[150] = "changed"
            rows.append((200 + i, " ".join(words)))
        if i % 4 == 0:
            rows.append((300 + i, " ".join(words).upper().replace(" ", "\n\t")))
    rows += [(400 + i, "exactly the same few words") for i in range(200)]
    rows += [(700, None), (701, ""), (702, " \n\t "), (703, "one"), (704, "One"), (705, "x" * 100_000), (706, "ab " * 50_000), (5, dict(rows)[5]), (5, dict(rows)[5])]
    return rows


def test_against_brute_force(spark):
    rows = docs_of()
    df = spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], SCHEMA)
    fps = {i: plain(t) for i, t in rows}
    want = classes(fps)
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.fingerprint, r.component_id) == (f"{fps[r.doc_id]:016x}", want[r.doc_id])


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(empty).count() == 0
    rows = [(None, "a b c", "", "", ""), (None, "d e f", "", "", ""), (3, "a b c", "", "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {(r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()} == {(None, 3), (None, None), (3, 3)}


def test_no_broadcast_of_many_rows(spark, monkeypatch):
    """Class ids go to the slices that a component has, by shuffle: sent to all slices they filled the driver at 440,000 fingerprints."""
    monkeypatch.setattr(simhash, "BROADCAST", 50, raising=False)
    values = near_values(random.Random(8), 20, 3, 300)
    fps = spark.createDataFrame([(i, int(v)) for i, v in enumerate(values.view(np.int64))], "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda *_: fps)
    df = simhash.near_duplicates(fps)
    assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString()
    plan = df._jdf.queryExecution()
    assert plan.toRdd().count() == len(values)
    final = plan.executedPlan().toString().split("== Initial Plan ==")[0]
    assert "BroadcastExchange" not in final and "Generate" in final
    want = classes(dict(enumerate(values.tolist())))
    assert {r.doc_id: r.component_id for r in df.collect()} == want
