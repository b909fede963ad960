import math
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from lorelink.functions import markup, numbers, text


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()[0]


def test_tokens(spark):
    assert one(spark, text.tokenize("t"), t="Déjà-vu, U.S.A. l'été 3,5!") == ["Déjà", "-", "vu", ",", "U.S.A", ".", "l'été", "3,5", "!"]
    assert one(spark, text.tokenize("t"), t="") == []


def test_ngrams(spark):
    assert sorted(one(spark, text.ngrams("t", 2, all_variants=False), t="a b c")) == ["a", "a b", "b", "b c", "c"]
    assert set(one(spark, text.ngrams("t", 2), t="a-b")) == {"a", "-", "b", "a -", "- b", "a b"}
    assert one(spark, text.ngrams("t", 3), t="") == []
    assert text.longest_ngram(3) == 2 and text.longest_ngram(3, head=False) == 3 and text.longest_ngram(None) is None


def test_normal_forms(spark):
    assert one(spark, text.normalize("t"), t="Déjà-vu ") == "deja vu"
    assert one(spark, text.normalize("t"), t="-") == "-"
    assert one(spark, text.normalize("t", accents=False), t="É-É") == "é é"
    assert one(spark, text.normalize("t", exact=True), t="ﬁn² Å") == "fin2 a"


def test_accents_follow_the_decomposition(spark):
    chars = [chr(c) for c in range(0xA0, 0x3000) if len([x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x)]) == 1]
    got = one(spark, text.remove_accents("t"), t="|".join(chars))
    assert got == "|".join("".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)) for c in chars)


def test_sentences(spark):
    assert one(spark, text.sentences("t"), t="Mr. Smith came. He saw! 'Why?' Nobody e.g. J. Doe knew.") == ["Mr. Smith came.", "He saw!", "'Why?'", "Nobody e.g. J. Doe knew."]


def test_patterns(spark):
    assert one(spark, text.find_ngrams(F.array(F.lit("mies wim"), F.lit("noot")), "t"), t="aap noot Mies  Wim noot.") == [" noot", " Mies  Wim", " noot"]
    assert one(spark, text.count_ngram(F.lit("c++"), "t"), t="C++ and c++. xc++") == 2
    assert one(spark, text.find_ngrams(F.array().cast("array<string>"), "t"), t="x") == []


@pytest.mark.parametrize(("title", "want"), [("Uva (Vimioso)", "Uva%20%28Vimioso%29"), ("Université d'Amsterdam", "Universit%C3%A9%20d%27Amsterdam"), ("a/b*c~", "a/b%2Ac~")])
def test_quote(spark, title, want):
    assert one(spark, text.url_quote("t"), t=title) == want


def test_tweet(spark):
    assert one(spark, text.clean_tweet("t"), t="RT @user: hello http://x.y/z #tag a!") == "hello tag"


def test_definition_clean(spark):
    assert one(spark, text.clean_definition("t"), t="|- }..<b>War</b> is. hell") == "War is. hell"


def test_sql_functions(spark):
    text.register(spark)
    assert spark.sql("SELECT lorelink_normalize('Déjà-Vu') a, lorelink_tokenize('a, b') b").first() == ("deja vu", ["a", ",", "b"])


def test_known_values(spark):
    n = F.lit(970139)
    row = spark.range(1).select(
        numbers.link_probability(F.lit(71), F.lit(241), F.lit(326)).alias("link"),
        numbers.prior_probability(F.lit(916), F.lit(917)).alias("prior"),
        numbers.link_probability(F.lit(766), F.lit(910), F.lit(0)).alias("zero"),
        numbers.inverse_frequency(n, F.lit(75)).alias("anchor"),
        numbers.inverse_frequency(n, F.lit(326)).alias("content"),
        numbers.inverse_frequency(n, F.lit(1)).alias("title"),
        numbers.per_count(F.lit(75), F.lit(326)).alias("key"),
        numbers.per_count(F.lit(71), F.lit(241)).alias("linkprob"),
    ).first()
    assert row.link == 0.2946058091286307 and row.prior == 0.9989094874591058 and row.zero == 0
    for got, want in ((row.anchor, 9.467706392312687), (row.content, 7.9982972271407675), (row.title, 13.785184639232321), (row.key, 0.23006134263615516), (row.linkprob, 0.29460579690432376)):
        assert math.isclose(got, want, rel_tol=1e-14)


def test_relatedness(spark):
    rel = lambda a, b: spark.createDataFrame([(a, b)], "a array<int>, b array<int>").select(numbers.relatedness("a", "b", F.lit(1000)).alias("x")).first()[0]
    assert rel([], [1]) == 0 and rel([1, 2], [2, 1]) == 1 and rel([1], [2]) == 0
    assert math.isclose(rel([1, 2, 3], [2, 3, 4, 5]), 1 - (math.log(4) - math.log(2)) / (math.log(1000) - math.log(3)))


MARKUP = "{{Info|{{x}}}}\n'''War''' is an [[open]] state of ''[[Conflict|armed conflict]]''.<ref>a</ref> [[File:x.png]]<!-- c -->\n\nSecond [http://x y] part. {| t |}\n\n== H ==\nthird"


def test_markup(spark):
    assert markup.definition_text(MARKUP) == "<b>War</b> is an open state of <i>armed conflict</i>. Second part. third"
    assert markup.definition_text("short") == "short" and markup.definition_text("short", head=True) == ""
    assert markup.definition_text(None) is None
    got = spark.createDataFrame([(MARKUP,), (None,), ("",)], "t string").select(markup.definition("t").alias("x")).collect()
    assert [r.x for r in got] == ["<b>War</b> is an open state of <i>armed conflict</i>. Second part. third", None, ""]


def test_regions():
    assert markup.nested_regions("a{{b{{c}}d}}e}}", r"\{\{", r"\}\}") == [(4, 9), (1, 12)]
    assert markup.union([(1, 5)], [(4, 9), (20, 22)]) == [(1, 9), (20, 22)]
    assert markup.without("abcdefgh", [(1, 3), (2, 5)]) == "afgh"


def test_emphasis():
    assert markup.emphasis("'''War''' is ''x'' and '''''both'''''") == "<b>War</b> is <i>x</i> and <b><i>both</i></b>"
    assert markup.emphasis("it's ''open") == "it's <i>open</i>"
    assert markup.italic_line("''all of it''.") and not markup.italic_line("''some'' of it") and markup.italic_line("''some'' of it", head=True)
    assert markup.odd_start("\n: indented\n''note''\nText") == len("\n: indented\n''note''\n")


def test_normal_forms_of_all_characters(spark):
    """remove_accents() is NFKD without combining marks, and the SQL function is normalize(), for every character by itself and in runs."""
    points = [p for p in range(0x20, 0x110000) if not 0xD800 <= p <= 0xDFFF]
    runs = ["".join(map(chr, points[i : i + 97])) for i in range(0, len(points), 97)]
    alone = [chr(p) for p in points if p < 0x30000 and unicodedata.normalize("NFKD", chr(p)) != chr(p)][::7] + [chr(p) for p in range(0x20, 0x250)]
    df = spark.createDataFrame([(x,) for x in runs + alone], "t string")
    text.register(spark, ["normalize"])
    got = df.select("t", text.remove_accents("t", exact=True).alias("plain"), text.normalize("t", exact=True).alias("norm"), F.expr("lorelink_normalize(t)").alias("sql")).collect()
    assert len(got) == len(runs) + len(alone)
    for r in got:
        assert r.plain == "".join(c for c in unicodedata.normalize("NFKD", r.t) if not unicodedata.combining(c))
        assert r.sql == r.norm


def test_normal_ngrams_are_those_of_ngrams(spark):
    texts = ["Déjà-vu, 한국 oﬃce; A.B.C it's -- ½ - ", "", "-", "x", "\u0301 \u0301\u0301 e\u0301", "ΟΔΟΣ ΣΑΣ. a-ΣΣ", "a\nb\tc\r\nd", "\u00a0 \ufb01 \u00a0", "1.5 2,5 U.S.A. don't"]
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    whole = df.select("t", F.explode(text.ngrams("t", 3)).alias("g")).select("t", "g", text.normalize("g", exact=True).alias("n"))
    side = df.select("t", F.explode(text.normal_ngrams("t", 3)).alias("x")).select("t", text.ngram_of(F.col("x")), text.norm_of(F.col("x")))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, side.collect()))


def test_first_paragraphs():
    parts = ["a" * 100, "b" * 100, "c" * 100, "d"]
    whole = "\n\n".join(parts)
    assert markup.first_paragraphs(whole) == " ".join(parts[:2]) == markup.first_paragraphs(whole, head=True)
    assert markup.first_paragraphs("\n\n".join(parts[:2])) == " ".join(parts[:2])
    for text_, want in (("\n\n".join(parts[:2]), ""), ("\n\n".join(parts[:3]), parts[0]), ("x\n\ny\n\n\n\nz", "x y"), ("", ""), ("x\n\n", "")):
        assert markup.first_paragraphs(text_, head=True) == want


def test_texts_are_held_against_a_short_class_first(spark):
    """Of characters of which several may be left none is missed, and common letters aren't among them, so that their texts spare the long class."""
    import re

    inside = re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: rf"\U{int(m[1], 16):08x}", text._MAY_EXPAND))
    assert all(inside.match(c) for c in (*text._KEYS, *text._SYLLABLES))
    assert not any(inside.match(c) for c in "azAZ09 .-äöüßéèñçÅøőαωжя\u6f22\u5b57")


def test_distinct_tokens_are_those_of_all_variants(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["a", "B", "é", "7", ".", "-", ",", "'", "!", " ", "\n", "\t", "\x0b", "\u00a0", "한", "_"]) for _ in range(rng.randint(0, 60))) for _ in range(300)] + [None, "", "  ", " -", "e.t.c. x-y.z -.- "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    every = F.array_distinct(F.flatten(F.transform(text.variants("t"), text.tokenize)))
    for r in df.select("t", F.array_sort(text.distinct_tokens("t")).alias("got"), F.array_sort(every).alias("want")).collect():
        assert r.got == r.want, r.t
