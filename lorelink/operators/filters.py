"""Filters on links, uniqueness within a context, and which columns leave the plan."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_TERM = re.compile(r"^\s*(\w+)\s*(>=|>)\s*([-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?)\s*$")


def parse_filter(text: str) -> tuple[list[tuple[str, str, float]], bool]:
    """Conditions key>=n (first) and key>n of a comma list, and whether `unique` stands in it. Other terms are ignored."""
    found = [m.groups() for t in text.split(",") if (m := _TERM.match(t))]
    conditions = [(k, op, float(n)) for k, op, n in found]
    return sorted(conditions, key=lambda c: c[1] != ">="), any(t.strip() == "unique" for t in text.split(","))


def condition(conditions: list[tuple[str, str, float]]) -> Column:
    """All conditions together."""
    out = F.lit(True)
    for key, op, n in conditions:
        out = out & (F.col(key) >= n if op == ">=" else F.col(key) > n)
    return out


def unique(links: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Of the links of a context with one title the first: by seq, then likeliest sense, label and id."""
    order = order or ["seq"]
    line = Window.partitionBy("context", "title").orderBy(*order, F.desc("senseProbability"), "label", "id")
    return links.withColumn("_first", F.row_number().over(line)).where("_first = 1").drop("_first")


def filtered(links: DataFrame, text: str | None) -> DataFrame:
    """The links that a filter keeps: thresholds, then uniqueness, so a link below a threshold leaves no trace in its context.

    A key that isn't a column raises KeyError when the plan is made.
    """
    if not text:
        return links
    conditions, once = parse_filter(text)
    if unknown := [k for k, _, _ in conditions if k not in links.columns]:  # Spark would look it up below a projection that dropped it
        raise KeyError(f"links have no {', '.join(unknown)} here")
    links = links.where(condition(conditions)) if conditions else links
    return unique(links) if once else links


def without_counts(links: DataFrame, counts: bool) -> DataFrame:
    return links if counts else links.drop(*[c for c in links.columns if c.endswith("Count")])


#: The columns that each part of an article has.
ARTICLE_COLUMNS = {"inlinks": "InLinks", "outlinks": "OutLinks", "labels": "Labels", "categories": "ParentCategories", "definition": "Definition", "images": "Images", "fromtitle": "fromTitle", "fromredirect": "fromRedirect", "id": "article_id", "title": "article_title"}


def article_columns(links: DataFrame, parts: list[str] | None) -> DataFrame:
    """Article columns that weren't asked for leave; an empty list keeps all, None none. Names match in any case."""
    if parts is not None and not [p for p in parts if p]:
        return links
    asked = {p.strip().lower() for p in parts or []}
    keep = {ARTICLE_COLUMNS[p] for p in asked if p in ARTICLE_COLUMNS}
    return links.drop(*[c for c in ARTICLE_COLUMNS.values() if c in links.columns and c not in keep])
