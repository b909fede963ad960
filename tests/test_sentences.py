"""Statistics of sentence ends against plain counts, and sentences against ones marked by hand."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from lorelink.operators import candidates, sentences

AROUND = re.compile(r"^[\"'(\[]+|[\"')\],;:]+$")
WORD = re.compile(r"[^\W\d_](?:[^\W\d_]|[.'-])*")


def tokens(text):
    return [AROUND.sub("", t) for t in re.split(r"[\x20\x09-\x0D]+", text or "") if t]


def form(t):
    return re.sub(r"\.$", "", t.lower()) if WORD.fullmatch(t) else ""


def brute_pairs(texts):
    out = Counter()
    for text in texts:
        t = tokens(text)
        for i, x in enumerate(t):
            if form(x):
                out[form(x), x.endswith("."), form(t[i + 1]) if i + 1 < len(t) else ""] += 1
    return out


def brute_scores(pairs):
    yes, no = Counter(), Counter()
    for (w, stop, _), n in pairs.items():
        (yes if stop else no)[w] += n
    p = sum(yes.values()) / (sum(yes.values()) + sum(no.values()))
    out = {}
    for w in yes:
        letters = len(w.replace(".", ""))
        ratio = -2 * (yes[w] * math.log(p) + no[w] * math.log(1 - p) - yes[w] * math.log(0.99) - no[w] * math.log(0.01))
        out[w] = (yes[w], no[w], ratio * math.exp(-letters) * (len(w) - letters + 1) * letters ** -no[w])
    return out


def ratio(both, a, b, n):
    """Dunning's log-likelihood ratio from the four likelihoods."""
    def log(k, m, p):
        return (k * math.log(p) if k else 0) + ((m - k) * math.log(1 - p) if m - k else 0)

    if both * n <= a * b:
        return 0.0
    return 2 * (log(both, a, both / a) + log(b - both, n - a, (b - both) / (n - a)) - log(both, a, b / n) - log(b - both, n - a, b / n))


def corpus(seed=1, count=300):
    """Texts of marked sentences with short forms of an invented language, and a pair of words that a full stop never parts."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abdegiklmnoprstuz") for _ in range(rng.randint(4, 9))) for _ in range(150)]
    names = [w.capitalize() for w in words[:20]]
    texts = []
    for _ in range(count):
        marked = []
        for _ in range(rng.randint(2, 6)):
            body = [rng.choice(("Denn", "Also", "Nur")) if rng.random() < 0.5 else rng.choice(words).capitalize()]
            for _ in range(rng.randint(4, 12)):
                body.append(rng.choice(words) if rng.random() < 0.75 else rng.choice((f"hrn. {rng.choice(names)}", f"z.b. {rng.choice(words)}", f"J. {rng.choice(names)}", f"bzw. {rng.choice(names)}", "3.5", "st. Gallus")))
            marked.append(" ".join(body) + " " + rng.choice(words) + rng.choice((".", ".", ".", "!", "?", '."')))
        texts.append(marked)
    return texts


def test_counts_and_scores_are_the_plain_ones(spark):
    texts = [" ".join(t) for t in corpus(2, 40)] + [None, "", "Mr. (Smith) said: 'Yes.' J. R. R. went; A.B. c. 3.5 x-y. - ."]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    pairs = sentences.word_pairs(df)
    want = brute_pairs(texts)
    assert {(r.word, r.period, r.next): r.n for r in pairs.collect()} == dict(want)
    got = {r.word: (r.with_period, r.without, r.score) for r in sentences.abbreviation_scores(pairs).collect()}
    plain = brute_scores(want)
    assert set(got) == set(plain)
    assert all(got[w][:2] == plain[w][:2] and math.isclose(got[w][2], plain[w][2], rel_tol=1e-9, abs_tol=1e-12) for w in got)


def test_log_likelihood(spark):
    rng = random.Random(3)
    rows = [(min(a, b, rng.randint(0, 30)), a, b, 1000) for a, b in ((rng.randint(1, 60), rng.randint(1, 60)) for _ in range(100))] + [(5, 5, 5, 1000), (7, 7, 900, 1000), (0, 3, 4, 10), (3, 10, 3, 10)]
    df = spark.createDataFrame(rows, "k long, a long, b long, n long")
    for r in df.withColumn("x", sentences.log_likelihood(*map(F.col, "kabn"))).collect():
        assert math.isclose(r.x, ratio(r.k, r.a, r.b, r.n) if r.n > r.a else 0.0, rel_tol=1e-9, abs_tol=1e-9)


def test_learnt_sentences(spark):
    marked = corpus()
    df = spark.createDataFrame([(i, "  ".join(m)) for i, m in enumerate(marked)], "doc_id long, text string")
    table = sentences.learn_sentences(df, settle=lambda d: d.checkpoint())
    model = sentences.SentenceModel.of(table)
    assert {"hrn", "z.b", "bzw", "st"} <= set(model.abbreviations)
    assert {"denn", "also", "nur"} <= set(model.starters)
    assert "st gallus" in model.collocations

    def right(rows):
        """How many of the ends that were marked or given are both."""
        ends = lambda s: set(__import__("itertools").accumulate(len(x.replace(" ", "")) for x in s))
        both = union = 0
        for r in rows:
            a, b = ends(marked[r.doc_id]), ends(r.s)
            both, union = both + len(a & b), union + len(a | b)
        return both / union

    learnt = df.select("doc_id", model.sentences("text").alias("s")).collect()
    fixed = df.select("doc_id", sentences.split_sentences("text").alias("s")).collect()
    assert all("".join(r.s).replace(" ", "") == "".join(marked[r.doc_id]).replace(" ", "") for r in learnt), "nothing is lost"
    assert right(learnt) > 0.97 > 0.9 > right(fixed)


def test_edges(spark):
    model = sentences.SentenceModel(("dr", "etc"), ("then",), ("no five",))
    cases = {
        None: None,
        "": [],
        " \n ": [],
        "One. Two! Three? four.": ["One.", "Two!", "Three? four."],
        "Dr. Smith came. (Really.) \"Yes.\" He left": ["Dr. Smith came.", "(Really.)", "\"Yes.\"", "He left"],
        "Cats, dogs etc. Then it rained. No. Five is alive.": ["Cats, dogs etc.", "Then it rained.", "No. Five is alive."],
        "J. Then spoke.  He said 3.5 was v. much.\nEnd": ["J. Then spoke.", "He said 3.5 was v. much.", "End"],
        "...": ["..."],
        "a.b\tc": ["a.b\tc"],
    }
    df = spark.createDataFrame([(t,) for t in cases], "text string")
    for r in df.select("text", model.sentences("text").alias("s")).collect():
        assert r.s == cases[r.text], r.text
    empty = sentences.SentenceModel.of(sentences.learn_sentences(df.limit(0)))
    assert empty == sentences.SentenceModel()
    asked = spark.createDataFrame([("r", "en", "See dr. Smith. Now.")], "request_id string, lang string, text string")
    assert [r.text for r in candidates.split_requests(asked, model).orderBy("sentence_no").collect()] == ["See dr. Smith.", "Now."]


def test_whole_model_is_used(spark):
    """Types beyond any number of better ones count too, in constants and in tables."""
    name = lambda i: "".join(chr(97 + int(d)) for d in f"{i:05}")
    rows = [("abbreviation", "x" + name(i), float(i)) for i in range(2100)] + [("starter", "s" + name(i), float(i)) for i in range(2100)] + [("collocation", f"c{name(i)} d{name(i)}", float(i)) for i in range(2100)]
    table = spark.createDataFrame(rows, "kind string, word string, score double")
    low = name(0)
    cases = {
        1: (f"See x{low}. Then go. End", [f"See x{low}. Then go.", "End"]),
        2: (f"See x{low}. S{low} went. End", [f"See x{low}.", f"S{low} went.", "End"]),
        3: (f"See C{low}. D{low} went. End", [f"See C{low}. D{low} went.", "End"]),
        4: (None, None), 5: ("", []), 6: (f"(x{low}.) Then J. S{low} said \"no.\" Yes! x{low}. he", [f"(x{low}.) Then J. S{low} said \"no.\"", f"Yes! x{low}. he"]),
    }
    df = spark.createDataFrame([(i, t) for i, (t, _) in cases.items()] + [(None, cases[1][0]), (None, cases[2][0]), (1, cases[1][0])], "doc_id long, text string")
    want = {t: s for t, s in cases.values()}
    model = sentences.SentenceModel.of(table)
    assert len(model.abbreviations) == len(model.starters) == len(model.collocations) == 2100
    for settle in (None, lambda d: d.checkpoint()):
        got = sentences.with_sentences(df, table, settle=settle).collect()
        assert len(got) == 9 and all(r.sentences == want[r.text] for r in got)


def test_table_and_constants_give_the_same(spark):
    df = spark.createDataFrame([(i, " ".join(m)) for i, m in enumerate(corpus(4, 80))], "doc_id long, text string")
    table = sentences.learn_sentences(df, settle=lambda d: d.checkpoint()).checkpoint()
    want = df.select("doc_id", sentences.SentenceModel.of(table).sentences("text").alias("s")).collect()
    got = sentences.with_sentences(df, table, settle=lambda d: d.checkpoint()).select("doc_id", "sentences").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
