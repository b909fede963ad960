"""A representative image of a page's html."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col, let

#: Images that stand on very many pages, and the least larger side.
COMMON = (
    "http://upload.wikimedia.org/wikipedia/en/f/f4/Ambox_content.png",
    "http://upload.wikimedia.org/wikipedia/en/thumb/9/99/Question_book-new.svg/50px-Question_book-new.svg.png",
    "http://upload.wikimedia.org/wikipedia/en/thumb/f/f2/Edit-clear.svg/40px-Edit-clear.svg.png",
    "http://upload.wikimedia.org/wikipedia/commons/thumb/f/f8/Wiktionary-logo-en.svg/37px-Wiktionary-logo-en.svg.png",
    "http://upload.wikimedia.org/wikipedia/commons/thumb/a/a4/Text_document_with_red_question_mark.svg/40px-Text_document_with_red_question_mark.svg.png",
)
LEAST = 36
_TAG = r"<img\b[^>]*>"
_SIZE = r"width=\"(\d+)\" height=\"(\d+)\""
_SRC = r"src=\"([^\"]*)\""


def absolute(src: Column, host: Column) -> Column:
    """// takes http:, / the page's host."""
    return F.when(src.startswith("//"), F.concat(F.lit("http:"), src)).when(src.startswith("/"), F.concat(F.lit("http://"), host, src)).otherwise(src)


def representative_image(html: Column | str, host: Column | str = "", excluded: tuple[str, ...] = COMMON, least: int = LEAST) -> Column:
    """The address of the first image without id or title whose larger side is at least `least`; null without one."""
    place = F.lit("") if host == "" else col(host)
    tags = F.filter(F.regexp_extract_all(col(html), F.lit(_TAG), F.lit(0)), lambda t: ~F.contains(t, F.lit(" id=")) & ~F.contains(t, F.lit(" title=")) & (F.regexp_extract(t, _SIZE, 1) != ""))

    def good(x: Column) -> Column:
        larger = F.greatest(F.regexp_extract(x, _SIZE, 1).try_cast("int"), F.regexp_extract(x, _SIZE, 2).try_cast("int"))
        return (larger >= least) & ~absolute(F.regexp_extract(x, _SRC, 1), place).isin(list(excluded))

    return let(F.filter(tags, good), lambda t: F.when(F.size(t) > 0, absolute(F.regexp_extract(F.try_element_at(t, F.lit(1)), _SRC, 1), place)))


def with_images(links: DataFrame, pages: DataFrame) -> DataFrame:
    """links with image_url, by url; pages: url, html. A page is looked at once, however many links lead to it."""
    asked = links.select("url").distinct()
    found = pages.join(asked, "url", "left_semi").select("url", representative_image("html").alias("image_url")).dropDuplicates(["url"])
    return links.join(found, "url", "left")
