"""Text functions as columns: normal forms, tokens, n-grams, patterns, names in URLs."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable, Iterable

from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A letter, digit or underscore of any script. Java's and RE2's \w know ASCII only, so classes are spelt out.
W = r"\p{L}\p{N}_"
TOKEN = rf"[{W}]++(?:[.,'][{W}]++)*+|[^{W}\s]++"  # possessive: a token never gives back what it took


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- normal forms ---


#: Korean syllables are made of these by arithmetic: the first one, and the first of the leading, middle and closing letters.
HANGUL, LEADS, MIDDLES, CLOSINGS = 0xAC00, 0x1100, 0x1161, 0x11A7


def _accent_table() -> tuple[str, str, str, dict[str, str]]:
    """Characters that decompose to one base character, these, characters of which nothing is left, and those of which several
    characters are left; Korean syllables aside. Beyond U+2FFFF nothing decomposes.
    """
    source, target, marks, several = [], [], [], {}
    for point in (*range(0x80, HANGUL), *range(HANGUL + 11172, 0xD800), *range(0xE000, 0x30000)):
        c = chr(point)
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if not base:
            marks.append(c)
        elif base != c and len(base) == 1:
            source.append(c)
            target.append(base)
        elif base != c:
            several[c] = base
    return "".join(source), "".join(target), "".join(marks), several


def _ranges(chars: str) -> str:
    """The characters as the inside of a pattern's class."""
    points, out = sorted(map(ord, chars)), []
    for p in points:
        if out and p == out[-1][1] + 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in out)


_SOURCE, _TARGET, _MARKS, _SEVERAL = _accent_table()
_KEYS = "".join(_SEVERAL)
_SYLLABLES = chr(HANGUL), chr(HANGUL + 11171)
#: A character of which several are left.
_EXPANDS = rf"[{_ranges(_KEYS)}{_SYLLABLES[0]}-{_SYLLABLES[1]}]"


def _commons() -> str:
    """The inside of a class of characters of which none becomes several: wide ranges between those that do.

    A class of many ranges is tried range by range, so texts are first held against this short one.
    """
    borders = [-1, *sorted(ord(c) for c in _KEYS if ord(c) < HANGUL), HANGUL]
    return "".join(rf"\x{{{a + 1:x}}}-\x{{{b - 1:x}}}" for a, b in zip(borders, borders[1:], strict=False) if b - a > 100)


#: A character of which several may be left.
_MAY_EXPAND = rf"[^{_commons()}]"


def _letters(first: int, count: int) -> str:
    return "".join(chr(first + k) for k in range(count))


def _expanded(c: Column) -> Column:
    """All that is left of a character."""
    place = F.ascii(c) - HANGUL
    letter = lambda first, count, at: F.substr(F.lit(_letters(first, count)), at + 1, F.lit(1))
    closing = place % 28
    syllable = F.concat(letter(LEADS, 19, F.floor(place / 588).cast("int")), letter(MIDDLES, 21, F.floor(place % 588 / 28).cast("int")), F.when(closing > 0, letter(CLOSINGS, 28, closing)).otherwise(F.lit("")))
    other = F.get(F.array(*[F.lit(x) for x in _SEVERAL.values()]), F.instr(F.lit(_KEYS), c) - 1)
    return F.when(c.between(*_SYLLABLES), syllable).otherwise(F.coalesce(other, c))


def remove_accents(text: Column | str, exact: bool = False) -> Column:
    """Without accents, as NFKD decomposition leaves the text once combining marks are dropped.

    The plain form is one translate(), which covers every character that decomposes to one base character. Some (Korean
    syllables, ligatures, fractions) decompose to several; `exact` handles these too, where a text has any.
    """
    raw = col(text)
    whole = raw
    if exact:
        single = F.filter(F.split(raw, ""), lambda c: c != "")
        whole = F.when(F.rlike(raw, F.lit(_MAY_EXPAND)) & F.rlike(raw, F.lit(_EXPANDS)), F.array_join(F.transform(single, _expanded), "")).otherwise(raw)
    return F.when(F.octet_length(raw) == F.length(raw), raw).otherwise(F.translate(whole, _SOURCE + _MARKS, _TARGET))  # ASCII stays as it is


def _mark_table() -> tuple[str, str, str]:
    """Characters that are a letter with marks in canonical decomposition alone, these letters, and the marks."""
    source, target, marks = [], [], []
    for point in (*range(0x80, 0xD800), *range(0xE000, 0x30000)):
        c = chr(point)
        base = unicodedata.normalize("NFC", "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x)[0] != "M"))
        if not base:
            marks.append(c)
        elif base != c and len(base) == 1:
            source.append(c)
            target.append(base)
    return "".join(source), "".join(target), "".join(marks)


_MARKED, _BARE, _ALL_MARKS = _mark_table()


def plain_form(text: Column | str) -> Column:
    """Dashes as blanks, no marks, lower case, as SQL's replace, strip_accents and lower have it: ligatures, fractions and blanks at the ends stay."""
    x = F.replace(col(text), F.lit("-"), F.lit(" "))
    return F.lower(F.when(F.octet_length(x) == F.length(x), x).otherwise(F.translate(x, _MARKED + _ALL_MARKS, _BARE)))


def folded(text: Column | str, dash: bool = True, accents: bool = True, lower: bool = True, exact: bool = False) -> Column:
    """Dashes as blanks, no accents, lower case, as asked for: what normalize() does to each character by itself."""
    x = F.replace(col(text), F.lit("-"), F.lit(" ")) if dash else col(text)
    x = remove_accents(x, exact) if accents else x
    return F.lower(x) if lower else x


#: What is trimmed off the ends of a normal form.
BLANKS = " \t\n\r\f\v"


def normalize(text: Column | str, dash: bool = True, accents: bool = True, lower: bool = True, exact: bool = False) -> Column:
    """Dashes as blanks, no accents, lower case, no blanks at the ends, as asked for; the text itself if nothing would be left."""
    x = F.btrim(folded(text, dash, accents, lower, exact), F.lit(BLANKS))
    return F.when(F.length(x) == 0, col(text)).otherwise(x)


# --- tokens and n-grams ---


def tokenize(text: Column | str) -> Column:
    """Words (with . , ' inside) and runs of other marks."""
    return F.regexp_extract_all(col(text), F.lit(TOKEN), F.lit(0))


def variants(text: Column | str) -> Column:
    """The text; with dashes as blanks; with full stops as blanks; without full stops."""
    t = col(text)
    return F.array(t, F.replace(t, F.lit("-"), F.lit(" ")), F.replace(t, F.lit("."), F.lit(" ")), F.replace(t, F.lit("."), F.lit("")))


def ngrams_of(tokens: Column | str, n: int) -> Column:
    """All runs of n tokens, joined by a blank."""
    t = col(tokens)
    if n == 1:
        return t
    count = F.size(t) - n + 1
    shifted = [F.slice(t, k, F.greatest(count, F.lit(0))) for k in range(1, n + 1)]
    runs = shifted[0]
    for more in shifted[1:]:
        runs = F.zip_with(runs, more, lambda x, y: F.concat(x, F.lit(" "), y))
    return runs


def ngrams(text: Column | str, longest: int, all_variants: bool = True) -> Column:
    """Distinct n-grams of 1 to `longest` tokens of the text's variants."""
    forms = F.array_distinct(variants(text)) if all_variants else F.array(col(text))
    grams = F.flatten(F.transform(forms, lambda v: let(tokenize(v), lambda t: F.flatten(F.array(*[ngrams_of(t, n) for n in range(1, longest + 1)])))))
    return F.array_distinct(grams)


def distinct_tokens(text: Column | str) -> Column:
    """Distinct tokens of the text's variants. Each piece between blanks is met once, and only pieces with a dash or a full stop differ in variants; tokens have no blanks."""

    def of_pieces(pieces: Column) -> Column:
        marked = let(F.array_join(F.filter(pieces, lambda x: F.contains(x, F.lit("-")) | F.contains(x, F.lit("."))), " "), lambda t: F.array_join(F.slice(variants(t), 2, 3), " "))
        return F.array_distinct(tokenize(F.concat(F.array_join(pieces, " "), F.lit(" "), marked)))

    return let(F.array_distinct(F.split(col(text), r"\s+")), of_pieces)


def normal_ngrams(text: Column | str, longest: int, exact: bool = True, plain: bool = False) -> Column:
    """Distinct n-grams of 1 to `longest` tokens of the text's variants, each behind its normal form and a line end.

    Tokens have no line ends, so a variant's tokens are brought to their normal form in one go, and n-grams of both are
    made side by side. An n-gram of which nothing is left has an empty form here: it is its own. `plain`: forms as plain_form() has them.
    """

    def runs(t: Column, u: Column, n: int) -> Column:
        return F.zip_with(ngrams_of(u, n), ngrams_of(t, n), lambda x, y: F.concat(x, F.lit("\n"), y))

    def of_variant(v: Column) -> Column:
        form = plain_form if plain else lambda x: folded(x, dash=False, exact=exact)
        forms = lambda t: let(F.replace(F.array_join(t, "\n"), F.lit("-"), F.lit(" ")), lambda x: F.split(form(x), "\n"))
        return let(distinct_tokens(v) if longest == 1 else tokenize(v), lambda t: F.when(F.size(t) > 0, let(forms(t), lambda u: F.flatten(F.array(*[runs(t, u, n) for n in range(1, longest + 1)])))).otherwise(F.array().cast("array<string>")))

    if longest == 1:
        return of_variant(col(text))
    return F.array_distinct(F.flatten(F.transform(F.array_distinct(variants(text)), of_variant)))


def ngram_of(pair: Column) -> Column:
    """The n-gram of one of normal_ngrams()."""
    return F.substring_index(pair, "\n", -1)


def norm_of(pair: Column, plain: bool = False) -> Column:
    """Its normal form."""
    if plain:
        return F.substring_index(pair, "\n", 1)
    form = F.btrim(F.substring_index(pair, "\n", 1), F.lit(BLANKS))
    return F.when(F.length(form) == 0, ngram_of(pair)).otherwise(form)


def longest_ngram(cap: int | None, head: bool = True) -> int | None:
    """The longest n-gram that a cap of M tokens allows: M - 1 as the service has always counted, M in fixed mode."""
    return None if cap is None else cap - 1 if head else cap


def word_ngrams(words: Column, proper: bool = False) -> Column:
    """All word n-grams of an array of words; with `proper` only proper prefixes of the array."""

    def runs(w: Column) -> Column:
        n = F.size(w)
        if proper:
            return F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda k: F.array_join(F.slice(w, 1, k), " "))).otherwise(F.array().cast("array<string>"))
        every = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, k), " ")))
        return F.when(n > 0, F.flatten(every)).otherwise(F.array().cast("array<string>"))

    return let(words, runs)


def sentences(text: Column | str) -> Column:
    """Sentences: cut after . ! ? (and closing quotes) before white space and a letter that isn't small, but not after initials and common short forms.

    It stands in for an untrained statistical splitter, with which it agrees on plain prose but not on every abbreviation.
    """
    cut = r"(?<=[.!?][\"')\]]?)(?<!\b\p{L}\.)(?<!\b(?:Mr|Ms|Dr|St|Jr|vs)\.)(?<!\b(?:Mrs|Prof|e\.g|i\.e|etc)\.)\s+(?=[^\p{Ll}])"
    return F.filter(F.split(col(text), cut), lambda s: F.length(F.trim(s)) > 0)


# --- patterns ---


def escaped(ngram: Column | str) -> Column:
    """The n-gram as a pattern: marks escaped, blanks matching any white space."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(col(ngram), r"\s+", " "), rf"([^{W} ])", r"\\$1"), " ", r"\\s+")


def ngram_pattern(ngram: Column | str) -> Column:
    """A pattern for the n-gram between other than word characters, in any case; the character before belongs to the match."""
    return F.concat(F.lit(rf"(?iu)(?:\A|[^{W}])(?:"), escaped(ngram), F.lit(rf")(?=[^{W}]|\z)"))


def ngrams_pattern(ngrams: Column | str) -> Column:
    """As ngram_pattern(), for any of an array of n-grams; null for an empty array."""
    joined = F.array_join(F.transform(col(ngrams), escaped), "|")
    return F.when(F.size(col(ngrams)) > 0, F.concat(F.lit(rf"(?iu)(?:\A|[^{W}])(?:"), joined, F.lit(rf")(?=[^{W}]|\z)")))


def count_ngram(ngram: Column | str, text: Column | str) -> Column:
    return F.regexp_count(col(text), ngram_pattern(ngram))


def find_ngrams(ngrams: Column | str, text: Column | str) -> Column:
    """Matches of any of the n-grams in the text, in order; none for an empty array."""
    return F.coalesce(F.regexp_extract_all(col(text), ngrams_pattern(ngrams), F.lit(0)), F.array().cast("array<string>"))


# --- names and short texts ---


def url_quote(text: Column | str) -> Column:
    """Percent-encoded as in a path: slashes stay, blanks are %20."""
    x = F.url_encode(col(text))
    for a, b in (("+", "%20"), ("%2F", "/"), ("*", "%2A"), ("%7E", "~")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def article_url(lang: Column | str, title: Column | str) -> Column:
    return F.concat(F.lit("http://"), col(lang), F.lit(".wikipedia.org/wiki/"), url_quote(title))


#: What a short message loses, in this order.
_TWEET = (r"@[\p{L}\p{N}_]+", r"http://[^\s]+", r"[!-/:-@\[-`{-~]", r"\bRT\b")


def clean_tweet(text: Column | str) -> Column:
    """Without names, links, punctuation and RT; words of more than one character."""
    x = col(text)
    for pattern in _TWEET:
        x = F.regexp_replace(x, pattern, " ")
    return F.array_join(F.filter(F.split(F.trim(F.regexp_replace(x, r"\s+", " ")), " "), lambda w: F.length(w) > 1), " ")


def clean_definition(text: Column | str) -> Column:
    """Without tags, without marks and full stops at its start; a blank for null."""
    x = F.regexp_replace(F.coalesce(col(text), F.lit(" ")), r"(?s)<.*?>", "")
    x = F.regexp_replace(x, r"\A[|\- }]*", "")
    return F.trim(F.regexp_replace(x, r"\A\.+", ""))


def words(text: Column | str) -> Column:
    """Words cut at everything else; one empty word at the end is left out."""
    return let(F.split(col(text), rf"[^{W}]+", -1), lambda w: F.when((F.size(w) > 0) & (F.element_at(w, -1) == ""), F.slice(w, 1, F.size(w) - 1)).otherwise(w))


def register(spark, names: Iterable[str] = ("normalize", "tokenize")) -> None:
    """Make SQL functions of the central ones, so that plans in SQL can use them: lorelink_normalize(text), lorelink_tokenize(text)."""
    def quoted(x: str) -> str:
        return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def letter(first: int, count: int, at: str) -> str:
        return f"substr({quoted(_letters(first, count))}, {at} + 1, 1)"

    place = f"(ascii(c) - {HANGUL})"
    syllable = f"concat({letter(LEADS, 19, f'{place} div 588')}, {letter(MIDDLES, 21, f'({place} % 588) div 28')}, if({place} % 28 > 0, {letter(CLOSINGS, 28, f'{place} % 28')}, ''))"
    one = f"if(c BETWEEN {quoted(_SYLLABLES[0])} AND {quoted(_SYLLABLES[1])}, {syllable}, coalesce(get(array({', '.join(map(quoted, _SEVERAL.values()))}), instr({quoted(_KEYS)}, c) - 1), c))"
    blank = "replace(t, '-', ' ')"
    whole = f"if(rlike(t, {quoted(_EXPANDS)}), array_join(transform(filter(split({blank}, ''), c -> c <> ''), c -> {one}), ''), {blank})"
    plain = f"if(octet_length(t) = length(t), {blank}, translate({whole}, {quoted(_SOURCE + _MARKS)}, {quoted(_TARGET)}))"
    form = f"btrim(lower({plain}), {quoted(BLANKS)})"
    table = {"normalize": ("STRING", f"coalesce(nullif({form}, ''), t)"), "tokenize": ("ARRAY<STRING>", f"regexp_extract_all(t, {quoted(TOKEN)}, 0)")}
    for name in names:
        if name in table:
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION lorelink_{name}(t STRING) RETURNS {table[name][0]} RETURN {table[name][1]}")


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors needn't have this package
