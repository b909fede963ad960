"""Reading a knowledge base from its dump files: bracketed records in lines of text, and articles in XML.

Lines are read as text and taken apart by patterns; a line that a pattern doesn't fit is counted as bad and left out. Files
are split by Spark, and nested records are exploded in place, so a scan shuffles only where lines must be told apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.markup import definition
from ..functions.numbers import share
from ..functions.text import let, normalize
from ..kb import KB, SCHEMAS
from ..operators.build import label_bitmap, label_bits, last_by_line, title_ngram_counts

#: The names of the files.
FILES = {
    "translation": "translations.csv",
    "stats": "stats.csv",
    "label": "label.csv",
    "page": "page.csv",
    "page_label": "pageLabel.csv",
    "category": "articleParents.csv",
    "inlink": "pageLinkIn.csv",
    "outlink": "pageLinkOut.csv",
}
#: One file, numbered parts, or a dump of many streams, the first kind that there is.
ARTICLES = ("*-pages-articles.xml{,.gz,.bz2}", "*-pages-articles[0-9]*.xml*", "*-pages-articles-multistream*.xml*")
#: A file by itself, compressed, or in numbered parts.
PARTS = "{,.gz,.bz2,-*}"

#: What a line of each file looks like.
STATS = r"^'?([^,]*),(-?\d+)\s*$"
LABEL = r"^'(.*),(\d+),(\d+),(\d+),(\d+),v\{(.*)\}\s*$"
SENSE = r"s\{(\d+),(\d+),(\d+),([TF]),([TF])\}"
LINKS = r"^(\d+),v\{\s*(s\{.*)\}\s*$"
LINK = r"s\{(\d+),v"
PAGE = r"^(\d+),'(.*),(\d+),(\d+)\s*$"
PAGE_HEAD = r"^(\d+),'([^,]*),"
PAGE_LABELS = r"^(\d+),v\{(.*)\}\s*$"
PAGE_LABEL = r"s\{'(.*?),(\d+),(\d+),([TF]),([TF]),([TF])\}"
PARENTS = r"^(\d+),v\{([0-9,]*)\}\s*$"
TRANSLATIONS = r"^(\d+),m\{'?(.*)\}\s*$"
#: What a line of each relation's file looks like.
PATTERNS = {"translation": TRANSLATIONS, "stats": STATS, "label": LABEL, "page": PAGE, "page_label": PAGE_LABELS, "category": PARENTS, "inlink": LINKS, "outlink": LINKS}


def _listed(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match, in order, on whatever file system they are."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(f.getPath().toString() for f in found or [])


def check_path(spark: SparkSession, path: str, files: dict[str, str] | None = None) -> dict[str, list[str]]:
    """Places of the files below path, those of the articles among them if there are any; FileNotFoundError names what is missing.

    path: of any file system that Spark reads. A file may be compressed, and in parts: label.csv, label.csv.bz2, label.csv-1,
    label.csv-2.gz or a folder label.csv; of articles, every part of the dump, compressed ones of many streams too.
    """
    base = path.rstrip("/")
    found = {k: _listed(spark, f"{base}/{v}{PARTS}") for k, v in (files or FILES).items()}
    if missing := [f"{base}/{(files or FILES)[k]}" for k, v in found.items() if not v]:
        raise FileNotFoundError(f"missing: {', '.join(missing)}")
    if xml := next((x for kind in ARTICLES if (x := _listed(spark, f"{base}/{kind}"))), None):
        found["articles"] = xml
    return found


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """value, line_no: lines and what rises along each of the files, which are in the order of their names."""
    return spark.read.text(path).withColumn("line_no", F.struct(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("place")))


def bad_lines(raw: DataFrame, pattern: str) -> DataFrame:
    """The lines that don't fit, for a count or a look; empty ones don't count."""
    return raw.where(~F.col("value").rlike(pattern) & (F.trim("value") != ""))


def line_report(spark: SparkSession, path: str, head: bool = False) -> DataFrame:
    """relation, lines, bad: of each file of a dump how many lines there are and how many no relation has taken, in one pass over each.

    Empty lines are neither; head: pages' lines as the service reads them.
    """
    place, parts = check_path(spark, path), []
    for name, pattern in PATTERNS.items():
        fits = F.col("value").rlike(PAGE_HEAD if head and name == "page" else pattern)
        counted = lines(spark, place[name]).where(F.trim("value") != "").agg(F.count("*").alias("lines"), F.count(F.when(~fits, 1)).alias("bad"))
        parts.append(counted.select(F.lit(name).alias("relation"), "lines", "bad"))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionAll(part)
    return whole


def _good(raw: DataFrame, pattern: str, lang: str) -> DataFrame:
    return raw.where(F.col("value").rlike(pattern)).withColumn("lang", F.lit(lang))


def _part(pattern: str, k: int, of: str = "value"):
    return F.regexp_extract(of, pattern, k)


def stats(raw: DataFrame, lang: str) -> DataFrame:
    rows = _good(raw, STATS, lang).select("lang", _part(STATS, 1).alias("name"), _part(STATS, 2).cast("long").alias("value"), "line_no")
    return last_by_line(rows, ["lang", "name"])


def labels(raw: DataFrame, lang: str) -> DataFrame:
    """label with its counts; a comma in a label stays, as the counts are the last four numbers before the senses."""
    counts = [_part(LABEL, k).cast("long").alias(n) for k, n in ((2, "link_occ"), (3, "link_doc"), (4, "text_occ"), (5, "text_doc"))]
    return _good(raw, LABEL, lang).select("lang", _part(LABEL, 1).alias("label"), normalize(_part(LABEL, 1), exact=True).alias("norm_label"), *counts)


def senses(raw: DataFrame, lang: str) -> DataFrame:
    """A line that doesn't fit has no senses, so it isn't looked for beforehand; what fits SENSE is cut at its commas."""
    rows = raw.select(F.lit(lang).alias("lang"), _part(LABEL, 1).alias("label"), F.posexplode(F.regexp_extract_all(_part(LABEL, 6), F.lit(SENSE), F.lit(0))).alias("sense_rank", "s"))
    cut = rows.select("lang", "label", "sense_rank", F.split(F.btrim("s", F.lit("s{}")), ",").alias("p"))
    p = F.col("p")
    return cut.select("lang", "label", "sense_rank", p[0].alias("sense_id"), p[1].cast("long").alias("occ"), p[2].cast("long").alias("doc"), p[3].alias("from_title"), p[4].alias("from_redirect"))


def links(raw: DataFrame, lang: str) -> DataFrame:
    rows = _good(raw, LINKS, lang).select("lang", _part(LINKS, 1).alias("page_id"), F.posexplode(F.regexp_extract_all(_part(LINKS, 2), F.lit(LINK), F.lit(1))).alias("pos", "target_id"))
    return rows


def pages(raw: DataFrame, lang: str, head: bool = False) -> DataFrame:
    """page_id, title of the last line of each page; head: titles end at their first comma, as the service reads them."""
    pattern = PAGE_HEAD if head else PAGE
    rows = _good(raw, pattern, lang).select("lang", _part(pattern, 1).alias("page_id"), _part(pattern, 2).alias("title"), "line_no")
    return last_by_line(rows, ["lang", "page_id"])


def page_labels(raw: DataFrame, lang: str) -> DataFrame:
    """Labels with their shares of the page's occurrences, which are added up by line before labels become rows.

    A line that doesn't fit has no labels. What fits PAGE_LABEL ends with five parts without commas; the title is what stands before them.
    """

    def one(s: Column) -> Column:
        tail = F.substring_index(s, ",", -5)
        title = F.substr(s, F.lit(4), F.length(s) - F.length(tail) - 4)
        return let(F.split(tail, ","), lambda p: F.struct(title.alias("title"), p[0].cast("long").alias("occurrences"), *[(F.substr(p[k], F.lit(1), F.lit(1)) == "T").alias(n) for k, n in ((2, "from_redirect"), (3, "from_title"), (4, "is_primary"))]))

    rows = raw.select(F.lit(lang).alias("lang"), _part(PAGE_LABELS, 1).alias("page_id"), F.transform(F.regexp_extract_all(_part(PAGE_LABELS, 2), F.lit(PAGE_LABEL), F.lit(0)), one).alias("x"))
    summed = rows.withColumn("_n", F.aggregate("x", F.lit(0).cast("long"), lambda n, x: n + x["occurrences"]))
    whole = summed.withColumn("_n", F.sum("_n").over(Window.partitionBy("lang", "page_id")))
    return whole.select("lang", "page_id", "_n", F.posexplode("x").alias("pos", "x")).select("lang", "page_id", "pos", "x.*", share("x.occurrences", "_n").alias("proportion"))


def categories(raw: DataFrame, lang: str) -> DataFrame:
    rows = _good(raw, PARENTS, lang).select("lang", _part(PARENTS, 1).alias("page_id"), F.posexplode(F.split(_part(PARENTS, 2), ",")).alias("pos", "category_id"))
    return rows.where("category_id <> ''")


def translations(raw: DataFrame, lang: str, keep: list[str] | None = None) -> DataFrame:
    """page_id, tlang, title; only languages of `keep`, all if it is empty. A title may have commas, as each item begins with a quote."""
    rows = _good(raw, TRANSLATIONS, lang).select("lang", _part(TRANSLATIONS, 1).alias("page_id"), F.split(_part(TRANSLATIONS, 2), ",'").alias("x"))
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("x") / 2).cast("int") - 1), lambda i: F.struct(F.get("x", 2 * i).alias("tlang"), F.get("x", 2 * i + 1).alias("title")))
    rows = rows.where(F.size("x") > 1).select("lang", "page_id", F.inline(pairs))
    return rows.where(F.col("tlang").isin(keep)) if keep else rows


ARTICLE_SCHEMA = "id long, title string, revision struct<text:struct<_VALUE:string>>"


def articles(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """page_id, title, text of each page element that has text."""
    rows = spark.read.format("xml").option("rowTag", "page").schema(ARTICLE_SCHEMA).load(path)
    return rows.where("revision.text._VALUE IS NOT NULL").select(F.col("id").alias("page_id"), "title", F.col("revision.text._VALUE").alias("text"))


def definitions(texts: DataFrame, lang: str, head: bool = False) -> DataFrame:
    return texts.select(F.lit(lang).alias("lang"), F.col("page_id").cast("string").alias("page_id"), definition("text", head).alias("definition"))


def load_dumps(spark: SparkSession, path: str, lang: str, language_name: str = "", translation_langs: list[str] | None = None, head: bool = False) -> KB:
    """The knowledge base of a folder of dump files, as plans that read them."""
    place = check_path(spark, path)
    raw = {k: lines(spark, v) for k, v in place.items() if k != "articles"}
    page = pages(raw["page"], lang, head)
    meta = spark.createDataFrame([(lang, 0, language_name, path)], SCHEMAS["meta"])
    text = definitions(articles(spark, place["articles"]), lang, head) if "articles" in place else None
    return KB(stats(raw["stats"], lang), labels(raw["label"], lang), senses(raw["label"], lang), page, title_ngram_counts(page, head), page_labels(raw["page_label"], lang), links(raw["inlink"], lang), links(raw["outlink"], lang), categories(raw["category"], lang), translations(raw["translation"], lang, translation_langs), text, meta)


# --- tables in versions ---


def _versions(spark: SparkSession, root: str) -> DataFrame | None:
    meta = f"{root}/meta"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(meta)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    return spark.read.schema(SCHEMAS["meta"]).parquet(meta)


def current_version(spark: SparkSession, root: str, lang: str) -> int | None:
    found = _versions(spark, root)
    return None if found is None else found.where(F.col("lang") == lang).agg(F.max("version")).first()[0]


def publish(kb: KB, root: str, lang: str, language_name: str = "", path: str = "", keep_old: bool = False) -> int:
    """Write the relations as the language's next version, then a row of `meta`: readers see the new version only when it is whole.

    The old version's folders go after that, by their exact name. Returns the version.
    """
    spark = kb.label.sparkSession
    old = current_version(spark, root, lang)
    version = 0 if old is None else old + 1
    for name, df in kb.of(lang).relations().items():
        if name not in ("meta", "label_bitmap"):
            df.drop("lang").write.mode("overwrite").parquet(f"{root}/{name}/lang={lang}/version={version}")
    label = spark.read.parquet(f"{root}/label/lang={lang}/version={version}").withColumn("lang", F.lit(lang))
    label_bitmap(label, label_bits(label.count())).drop("lang").write.mode("overwrite").parquet(f"{root}/label_bitmap/lang={lang}/version={version}")
    spark.createDataFrame([(lang, version, language_name, path)], SCHEMAS["meta"]).coalesce(1).write.mode("append").parquet(f"{root}/meta")
    if old is not None and not keep_old:
        jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
        for name in {*kb.relations(), "label_bitmap"}:
            gone = jvm.Path(f"{root}/{name}/lang={lang}/version={old}")
            gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)
    return version


def open_published(spark: SparkSession, root: str, lang: str) -> KB:
    """The current version of a language; LookupError if none was published."""
    version = current_version(spark, root, lang)
    if version is None:
        raise LookupError(f"no knowledge base for {lang} below {root}")
    jvm, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()

    def read(name: str) -> DataFrame | None:
        place = f"{root}/{name}/lang={lang}/version={version}"
        if not jvm.Path(place).getFileSystem(conf).exists(jvm.Path(place)):
            return None
        rows = spark.read.parquet(place).withColumn("lang", F.lit(lang))
        return rows.select("lang", *[c for c in rows.columns if c != "lang"])

    parts = {name: read(name) for name in SCHEMAS if name != "meta"}
    return KB(**parts, meta=_versions(spark, root).where((F.col("lang") == lang) & (F.col("version") == version)))


def batch_requests(spark: SparkSession, files: str, lang: str, context: str = r"([^/]+?)(?:\.[^./]*)?$") -> DataFrame:
    """A request for each line of text files; its context is taken from the file's name."""
    raw = spark.read.text(files).withColumns({"context": F.regexp_extract(F.input_file_name(), context, 1), "seq": F.monotonically_increasing_id()})
    return raw.select(F.concat("context", F.lit("/"), F.col("seq")).alias("request_id"), F.lit(lang).alias("lang"), F.col("value").alias("text"), "context", "seq")
