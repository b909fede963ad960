"""link(): requests to links. Options decide which operators are in the plan; what isn't asked for isn't there."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any, Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kb import KB
from ..operators import articles, candidates, context, features, filters, images, learning, pageviews
from ..operators.sentences import SentenceModel


class LinkOperator(Protocol):
    """A plug-in: any of the three phases may change the links; `inspect` may tell about it."""

    def preprocess(self, links: DataFrame, options: Options) -> DataFrame: ...
    def process(self, links: DataFrame, options: Options) -> DataFrame: ...
    def postprocess(self, links: DataFrame, options: Options) -> DataFrame: ...


#: Other spellings of settings that configurations use.
SPELLINGS = {"pre_filter": "prefilter", "includefeatures": "features"}
FLAGS = ("split_sentences", "largestMatching", "translations", "counts", "features", "save", "image", "missing", "skip_context_features", "wikistats")


@dataclass
class Options:
    """Settings of requests, typed. A flag is on if its setting is there, whatever its value."""

    lang: str = "en"
    dash: bool = True
    accents: bool = True
    lower: bool = False
    split_sentences: bool = False
    largest_matching: bool = False
    translations: bool = False
    counts: bool = False
    prefilter: str | None = None
    filter: str | None = None
    article: list[str] | None = None
    features: bool = False
    multi: list[str] = field(default_factory=list)
    skip_context_features: bool = False
    wikistats: int | None = None
    use_wikistats: bool = False
    learning: str | None = None
    missing: bool = False
    save: bool = False
    image: bool = False
    max_ngram: int | None = None
    head: bool = False
    pagerank_rounds: int = 1000
    pagerank_tolerance: float | None = 1e-6

    @classmethod
    def of(cls, settings: dict[str, str], presets: dict[str, dict[str, str]] | None = None, lang: str = "en", **more: Any) -> Options:
        """Settings as a request has them. A preset that `settings` names fills in what isn't there."""
        given = {SPELLINGS.get(k, k): v for k, v in settings.items()}
        if "settings" in given:
            chosen = (presets or {}).get(given.pop("settings"), {})
            given = {**{SPELLINGS.get(k, k): v for k, v in chosen.items()}, **given}
        o = cls(lang=given.get("langcode", lang), **more)
        if "normalize" in given:
            o.dash, o.accents, o.lower = (x in given["normalize"] for x in ("dash", "accents", "lower"))
        for flag in FLAGS:
            if flag in given and flag not in ("largestMatching", "wikistats"):
                setattr(o, flag, True)
        o.largest_matching = "largestMatching" in given
        o.prefilter, o.filter = given.get("prefilter"), given.get("filter")
        if "article" in given:
            o.article = [p.strip() for p in given["article"].split(",") if p.strip()]
        if "multi" in given:
            o.multi = [x for x in ("tier1", "outlinks", "inlinks") if x in given["multi"]]
        if "wikistats" in given:
            o.use_wikistats = True
            o.wikistats = int(given["wikistats"]) if given["wikistats"].isdigit() else None
        o.learning = given.get("learning")
        return o


def _early(o: Options, plugins: list[LinkOperator]) -> list[tuple[str, str, float]]:
    """Thresholds that may hold before texts are linked, as nothing that comes before them looks at other links or changes these."""
    if o.largest_matching or plugins:
        return []
    first, once = filters.parse_filter(o.prefilter or "")
    last, _ = filters.parse_filter(o.filter or "")
    between = once or o.multi or o.features or o.learning is not None
    return first if between else first + last


def link(requests: DataFrame, kb: KB, options: Options | None = None, model: learning.Model | None = None, views: DataFrame | None = None, pages: DataFrame | None = None, plugins: list[LinkOperator] | None = None, settle=None, nstart: DataFrame | None = None, splitter: SentenceModel | None = None) -> DataFrame:
    """Links of all requests (request_id, lang, text; context and seq for what depends on order), one row each.

    Order of operators: candidates, prefilter, context; anchor features, articles, page views, article features, features
    of links among themselves, graph of the context, model; counts leave, filter, article columns leave, images. Counts are
    gone before the filter unless asked for, so a filter on them needs `counts`. Languages without a knowledge base have
    no links. `settle` writes a DataFrame and reads it, where best senses are counted, links meet themselves and in the rounds of ranks; ranks of
    contexts run until they stand (o.pagerank_tolerance), from `nstart` (context, node, rank) if it is given. `splitter` is a
    model of sentences for split_sentences.
    """
    o = options or Options()
    plugins = plugins or []
    kb = kb.of(o.lang)
    base = requests.where(F.col("lang") == o.lang)
    texts = candidates.split_requests(base, splitter) if o.split_sentences else base
    if o.largest_matching:
        links = candidates.largest_links(texts, kb, o.dash, o.accents, o.lower, o.max_ngram, o.head, settle=settle)
    else:
        links = candidates.candidates(texts, kb, o.dash, o.accents, o.lower, o.max_ngram, o.head, settle=settle, thresholds=_early(o, plugins))
    if o.translations:
        links = candidates.with_translations(links, kb)
    if "context" in base.columns:
        links = links.join(base.select("request_id", *[c for c in ("context", "seq") if c in base.columns]), "request_id")
    for p in plugins:
        links = getattr(p, "preprocess", lambda x, _: x)(links, o)
    links = filters.filtered(links, o.prefilter)
    wants = o.features or o.learning is not None
    if wants:
        links = features.with_anchor_features(links, kb, o.head)
    parts = o.article
    if parts is not None or wants or o.multi:
        links = articles.with_articles(links, kb, parts if parts is not None else list(articles.DEFAULT_PARTS))
    made = list(features.ANCHOR) if wants else []
    if wants and o.use_wikistats and views is not None:
        before = set(links.columns)
        links = pageviews.with_page_views(links, views, o.wikistats)
        made += [c for c in links.columns if c not in before]
    if wants:
        links = features.with_article_features(links, o.head)
        made += list(features.ARTICLE)
    if o.multi:
        before = set(links.columns)
        links = features.with_multi_features(links, kb, o.multi, settle)
        made += [c for c in links.columns if c not in before]
    if wants and not o.skip_context_features and "context" in links.columns and "seq" in base.columns:
        links = context.with_context_features(links, base, "context", head=o.head, settle=settle, rounds=o.pagerank_rounds, tolerance=o.pagerank_tolerance, nstart=nstart)
        made += [c for c in links.columns if c.startswith("CONTEXT_")]
    for p in plugins:
        links = getattr(p, "process", lambda x, _: x)(links, o)
    if model is not None and o.learning is not None:
        links = learning.score(links, model, o.missing)
    links = filters.without_counts(links, o.counts)
    links = filters.filtered(links, o.filter)
    links = filters.article_columns(links, parts)
    if made:
        links = features.as_map(links, made) if o.features else links.drop(*made)
    if o.image and pages is not None:
        links = images.with_images(links, pages)
    for p in plugins:
        links = getattr(p, "postprocess", lambda x, _: x)(links, o)
    return links.drop("sense_rank", "seq")


def collect_json(links: DataFrame, requests: DataFrame, pretty: bool = False) -> DataFrame:
    """request_id, json: a request's links, text and id as one JSON text; requests without links have an empty list."""
    columns = [c for c in links.columns if c not in ("request_id", "lang", "sentence_no")]
    listed = links.groupBy("request_id").agg(F.collect_list(F.struct(*columns)).alias("links"))
    kind = listed.schema["links"].dataType.simpleString()
    whole = requests.select("request_id", "text").join(listed, "request_id", "left")
    return whole.select("request_id", F.to_json(F.struct(F.coalesce("links", F.array().cast(kind)).alias("links"), "text", "request_id"), {"pretty": str(pretty).lower()}).alias("json"))


def inspect(kb: KB, plugins: list[LinkOperator] | None = None) -> dict[str, Any]:
    """What is loaded: relations with their columns, languages, and what plug-ins tell."""
    told = {type(p).__name__: p.inspect() for p in plugins or [] if hasattr(p, "inspect")}
    return {"languages": sorted(r[0] for r in kb.languages().collect()), "relations": {k: v.columns for k, v in kb.relations().items()}, **told}
