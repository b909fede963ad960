"""The knowledge base: relations that plans are built on."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The columns of each relation.
SCHEMAS = {
    "stats": "lang string, name string, value long",
    "label": "lang string, label string, norm_label string, link_occ long, link_doc long, text_occ long, text_doc long",
    "sense": "lang string, label string, sense_rank int, sense_id string, occ long, doc long, from_title string, from_redirect string",
    "page": "lang string, page_id string, title string",
    "title_ngram": "lang string, n int, ngram string, score long",
    "page_label": "lang string, page_id string, pos int, title string, occurrences long, from_redirect boolean, from_title boolean, is_primary boolean, proportion double",
    "inlink": "lang string, page_id string, pos int, target_id string",
    "outlink": "lang string, page_id string, pos int, target_id string",
    "category": "lang string, page_id string, pos int, category_id string",
    "translation": "lang string, page_id string, tlang string, title string",
    "definition": "lang string, page_id string, definition string",
    "label_bitmap": "lang string, bits int, longest int, bucket long, bitmap binary",
    "meta": "lang string, version int, language_name string, path string",
}


@dataclass(frozen=True)
class KB:
    """DataFrames by relation; None where a knowledge base lacks one."""

    stats: DataFrame
    label: DataFrame
    sense: DataFrame
    page: DataFrame
    title_ngram: DataFrame | None = None
    page_label: DataFrame | None = None
    inlink: DataFrame | None = None
    outlink: DataFrame | None = None
    category: DataFrame | None = None
    translation: DataFrame | None = None
    definition: DataFrame | None = None
    meta: DataFrame | None = None
    label_bitmap: DataFrame | None = None

    def of(self, lang: str) -> KB:
        """The part for one language; a filter on the partition column."""
        return replace(self, **{f.name: d.where(F.col("lang") == lang) for f in fields(self) if (d := getattr(self, f.name)) is not None})

    def relations(self) -> dict[str, DataFrame]:
        return {f.name: d for f in fields(self) if (d := getattr(self, f.name)) is not None}

    def articles(self) -> DataFrame:
        """lang, articles: the number of articles of each language, a row for each."""
        return self.stats.where("name = 'articleCount'").groupBy("lang").agg(F.max("value").alias("articles"))

    def languages(self) -> DataFrame:
        return (self.meta if self.meta is not None else self.stats).select("lang").distinct()
