import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lorelink.llm import packing
from lorelink.llm.tokens import CachedTokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, piece string, sequence_id string"


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(0, 9), max_size=12))
def test_every_piece_is_packed_once(counts):
    got = Counter()
    for bin_, times in packing.best_two_fit(counts, 40):
        assert sum(bin_) <= 40 and times > 0
        for n in bin_:
            got[n] += times
    assert got == Counter({n: c for n, c in counts.items() if c})


def test_two_pieces_replace_the_smallest():
    # greedy takes 6 + 3 and leaves a gap of 1; 2 + 2 fit the gap of 4 fully
    assert packing.best_two_fit({6: 1, 3: 1, 2: 2}, 10)[0] == ([6, 2, 2], 1)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(max_codepoint=0x2FF), st.sampled_from(list(" 'strvemld<|>_\n日ﬁ😀"))), max_size=60))
def test_cached_ids_are_the_tokenizers(text):
    assert np.frombuffer(CACHED.encode(text), "<u4").tolist() == PLAIN.encode(text, add_special_tokens=False).ids


CACHED, PLAIN = CachedTokenizer(open(PATH, encoding="utf-8").read(), most=50), Tokenizer.from_file(PATH)


def check(docs, rows, capacity):
    want = Counter()
    for doc_id, text in docs:
        ids = np.array([*PLAIN.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for k in range(0, len(ids), capacity):
            want[(doc_id, k // capacity, k, len(ids[k : k + capacity]), zlib.crc32(ids[k : k + capacity].tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(n[3] * c for n, c in want.items())
    assert len(bins) >= -(-total // capacity)
    return len(bins), -(-total // capacity)


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, "hello world " * 200), (None, "no id"), (4, "twice"), (4, "twice"), (5, "x " * 5000), *[(100 + i, "same text here") for i in range(300)]]
    df = spark.createDataFrame([(*d, "clash", "clash") for d in docs], SCHEMA)
    for capacity in (64, 2048):
        bins, bound = check(docs, packing.pack(df, PATH, capacity).collect(), capacity)
        assert bins <= bound * 1.1 + 1
    assert packing.pack(df.limit(0), PATH).count() == 0


def test_ids_round_trip(spark):
    docs = [(i, "some words of document number %d, and more " % i * (i % 4)) for i in range(50)]
    rows = packing.pack(spark.createDataFrame(docs, "doc_id long, text string"), PATH, 16, with_ids=True).collect()
    text = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        text.setdefault(r.doc_id, []).extend(r.ids)
    assert text == {i: [*PLAIN.encode(t, add_special_tokens=False).ids, 0] for i, t in docs}


def plain_best_two_fit(lengths, capacity):
    """Bins made one at a time, as the method is told: the longest that fits, then two in place of the smallest."""
    left, bins = sorted(lengths, reverse=True), []
    while left:
        bin_, rest = [], []
        for n in left:
            (bin_ if sum(bin_) + n <= capacity else rest).append(n)
        gap = capacity - sum(bin_)
        if gap and len(bin_) > 1:
            pairs = [(a + b, a, b) for i, a in enumerate(rest) for b in rest[i + 1 :] if bin_[-1] < a + b <= gap + bin_[-1]]
            if pairs:
                _, a, b = max(pairs)
                rest.append(bin_.pop())
                bin_ += [a, b]
                rest.remove(a)
                rest.remove(b)
        bins.append(sorted(bin_, reverse=True))
        left = sorted(rest, reverse=True)
    return bins


def test_against_plain_best_two_fit():
    """As many bins, each as full, as packing document by document gives, up to ties between equally tight pairs."""
    rng = np.random.default_rng(8)
    for _ in range(60):
        lengths = rng.integers(1, 30, int(rng.integers(1, 60))).tolist()
        got = [b for b, times in packing.best_two_fit(dict(Counter(lengths)), 40) for _ in range(times)]
        want = plain_best_two_fit(lengths, 40)
        assert sorted(n for b in got for n in b) == sorted(lengths)
        assert sum(b[0] for b in got[:1]) == sum(b[0] for b in want[:1]) and sum(got[0]) == sum(want[0])
        assert abs(len(got) - len(want)) <= 1
