import pytest

from lorelink.sources import dumps

LINES = {
    "stats.csv": "'articleCount,1978981\nbroken\n",
    "label.csv": "'Activiteitscoefficient,0,0,0,0,v{s{248591,0,0,F,T}}\n'Cambridge, Massachusetts,5,4,10,8,v{s{2,3,2,T,F},s{7,2,2,F,F}}\nnonsense\n",
    "pageLinkIn.csv": "1,v{s{83,v{402,557}},s{755,v{45}},s{756,v{1017}}}\n9,v{}\n",
    "pageLinkOut.csv": "83,v{s{1,v{4}}}\n",
    "translations.csv": "1311,m{'de,'Protokoll,'en,'Transcript (law),'it,'Registro, di protocollo,'pt,'Registro de protocolo}\n",
    "page.csv": "1,'Albert Speer,0,5\n2,'Cambridge, Massachusetts,0,5\n1,'Speer,0,5\n",
    "pageLabel.csv": "1,v{s{'Albert Speer,118,111,F,T,T},s{'Speer,5,5,F,F,T}}\n",
    "articleParents.csv": "1,v{71598,128543,835917,1041431,1809466}\n",
    "xx-pages-articles.xml": '<mediawiki xmlns="http://www.mediawiki.org/xml/export-0.8/"><page><title>A</title><id>1</id><revision><text>\'\'\'A\'\'\' is [[b]].</text></revision></page><page><title>B</title><id>2</id><revision><text></text></revision></page></mediawiki>',
}


@pytest.fixture
def folder(tmp_path):
    for name, content in LINES.items():
        (tmp_path / name).write_text(content)
    return tmp_path


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_scans(spark, folder):
    kb = dumps.load_dumps(spark, str(folder), "xx")
    assert rows(kb.stats, "name", "value") == [("articleCount", 1978981)]
    assert rows(kb.label, "label", "link_occ", "text_doc") == [("Activiteitscoefficient", 0, 0), ("Cambridge, Massachusetts", 5, 8)]
    assert rows(kb.sense, "label", "sense_rank", "sense_id", "occ", "from_redirect") == [("Activiteitscoefficient", 0, "248591", 0, "T"), ("Cambridge, Massachusetts", 0, "2", 3, "F"), ("Cambridge, Massachusetts", 1, "7", 2, "F")]
    assert rows(kb.inlink, "page_id", "pos", "target_id") == [("1", 0, "83"), ("1", 1, "755"), ("1", 2, "756")] and rows(kb.outlink, "page_id", "target_id") == [("83", "1")]
    assert rows(kb.page, "page_id", "title") == [("1", "Speer"), ("2", "Cambridge, Massachusetts")]
    assert rows(kb.page_label, "title", "occurrences", "from_title", "is_primary", "proportion") == [("Albert Speer", 118, True, True, 118 / 123), ("Speer", 5, False, True, 5 / 123)]
    assert kb.category.count() == 5 and rows(kb.category.where("pos = 4"), "category_id") == [("1809466",)]
    assert rows(kb.translation, "tlang", "title")[2] == ("it", "Registro, di protocollo") and kb.translation.count() == 4
    assert rows(dumps.load_dumps(spark, str(folder), "xx", translation_langs=["de"]).translation, "title") == [("Protokoll",)]
    assert rows(kb.definition, "page_id", "definition") == [("1", "<b>A</b> is b.")]
    assert rows(dumps.pages(dumps.lines(spark, str(folder / "page.csv")), "xx", head=True), "title") == [("Cambridge",), ("Speer",)]


def test_bad_lines(spark, folder):
    assert dumps.bad_lines(dumps.lines(spark, str(folder / "stats.csv")), dumps.STATS).count() == 1
    assert dumps.bad_lines(dumps.lines(spark, str(folder / "label.csv")), dumps.LABEL).count() == 1
    (folder / "page.csv").unlink()
    with pytest.raises(FileNotFoundError, match="page.csv"):
        dumps.load_dumps(spark, str(folder), "xx")


def test_dumps_in_parts(spark, folder, tmp_path):
    """Compressed parts, folders, numbered articles, by a path that only Spark's file systems know; bad lines are counted by relation."""
    import bz2
    import gzip

    whole = dumps.load_dumps(spark, f"file://{folder}/", "xx")
    want = {k: sorted(map(str, v.collect())) for k, v in whole.relations().items() if k != "meta"}
    first, rest = LINES["label.csv"].split("\n", 1)
    (folder / "label.csv").unlink()
    (folder / "label.csv-1.gz").write_bytes(gzip.compress(f"{first}\n".encode()))
    (folder / "label.csv-2.bz2").write_bytes(bz2.compress(rest.encode()))
    (folder / "label.csv.bak").write_text("'Other,0,0,0,0,v{s{1,0,0,F,T}}\n")
    (folder / "page.csv").rename(folder / "page.old")
    (folder / "page.csv").mkdir()
    for i, line in enumerate(LINES["page.csv"].splitlines()):
        (folder / "page.csv" / f"part-{i}").write_text(f"{line}\n")
    text = LINES["xx-pages-articles.xml"]
    (folder / "xx-pages-articles.xml").unlink()
    begin, end = "<mediawiki>", "</mediawiki>"
    for i in (1, 2, 3):
        page = f"<page><title>T{i}</title><id>{i}</id><revision><text>Text {i}.</text></revision></page>"
        streams = [bz2.compress(x.encode()) for x in (begin, page, end)] if i == 3 else [bz2.compress(f"{begin}{page}{end}".encode())]
        (folder / f"xx-pages-articles{i}.xml-p{i}p{i}.bz2").write_bytes(b"".join(streams))
    kb = dumps.load_dumps(spark, f"file://{folder}", "xx")
    assert rows(kb.definition, "page_id", "definition") == [(str(i), f"Text {i}.") for i in (1, 2, 3)] and text
    got = {k: sorted(map(str, v.collect())) for k, v in kb.relations().items() if k not in ("meta", "definition")}
    assert got == {k: v for k, v in want.items() if k != "definition"}
    report = {r.relation: (r.lines, r.bad) for r in dumps.line_report(spark, f"file://{folder}").collect()}
    assert report["label"] == (3, 1) and report["stats"] == (2, 1) and report["page"] == (3, 0) and set(report) == set(dumps.FILES)


def test_versions(spark, folder, tmp_path):
    root = str(tmp_path / "kb")
    with pytest.raises(LookupError):
        dumps.open_published(spark, root, "xx")
    kb = dumps.load_dumps(spark, str(folder), "xx")
    assert [dumps.publish(kb, root, "xx") for _ in range(3)] == [0, 1, 2]
    got = dumps.open_published(spark, root, "xx")
    assert rows(got.page, "lang", "page_id") == [("xx", "1"), ("xx", "2")] and got.label.count() == 2
    import os

    assert sorted(os.listdir(f"{root}/page/lang=xx")) == ["version=2"]


def test_batch_files(spark, tmp_path):
    (tmp_path / "news.txt").write_text("one\ntwo\n")
    got = dumps.batch_requests(spark, str(tmp_path / "*.txt"), "en")
    assert rows(got, "context", "text") == [("news", "one"), ("news", "two")]


def test_link_over_a_dump_with_characters_of_several_parts(spark, folder):
    from lorelink.plans import Options, link

    names = ("\ud55c\uad6d", "\ufb01n", "3\u00bd", "\U0001d400lpha")
    (folder / "label.csv").write_text("".join(f"'{n},5,4,10,8,v{{s{{2,3,2,T,F}}}}\n" for n in names))
    kb = dumps.load_dumps(spark, str(folder), "xx")
    assert kb.label.count() == len(names)
    requests = spark.createDataFrame([(str(i), "xx", f"see {n} here") for i, n in enumerate(names)], "request_id string, lang string, text string")
    for more in ({}, {"largestMatching": ""}):
        found = link(requests, kb, Options.of(more, lang="xx"))
        assert {(r.request_id, r.label) for r in found.collect()} == {(str(i), n) for i, n in enumerate(names)}


@pytest.mark.parametrize("name, key", [("ngrams_docs", "doc_id"), ("sentence_abbreviations", "doc_id"), ("link_candidates_unicode", "p_partkey"), ("markup_definitions", "p_partkey")])
def test_long_work_is_dealt_out_by_key(spark, name, key):
    """A file of one row group is one task, so rows are dealt out before work that is long on each."""
    import __spark_entry__

    plan = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
    assert f"RepartitionByExpression [{key}#" in plan


def test_requests_without_text(spark):
    from lorelink.sources.tables import order_requests

    with_text, without = order_requests(spark, "/root/testdata/sf0.001"), order_requests(spark, "/root/testdata/sf0.001", False)
    assert without.columns == [c for c in with_text.columns if c != "text"]
    assert sorted(without.collect()) == sorted(with_text.drop("text").collect())


def test_nested_records_are_cut_once(spark):
    """Odd lines of labels and page labels: bad ones have no rows, commas and braces stay in titles, a page's two lines are one whole; no line is matched beforehand."""
    raw = spark.createDataFrame([("'a, b,1,2,3,4,v{x,5,6,7,8,v{s{1,2,3,T,F},s{x},s{4,5,6,F,T}}", 0), ("'none,1,2,3,4,v{}", 0), ("bad s{1,2,3,T,F}", 0), (None, 0)], "value string, line_no long")
    found = dumps.senses(raw, "en")
    assert sorted(map(tuple, found.collect())) == [("en", "a, b,1,2,3,4,v{x", 0, "1", 2, 3, "T", "F"), ("en", "a, b,1,2,3,4,v{x", 1, "4", 5, 6, "F", "T")]
    raw = spark.createDataFrame([("1,v{s{'a, b},c',3,0,T,F,T},s{'x,1,2,T,F',1,9,F,T,F}}", 0), ("1,v{s{'',4,0,F,F,F}}", 0), ("2,v{s{'z',0,0,F,F,F}}", 0), ("3,v{}", 0), ("bad,v{s{'z',1,0,F,F,F}}", 0), (None, 0)], "value string, line_no long")
    labels = dumps.page_labels(raw, "en")
    assert sorted(map(tuple, labels.collect())) == [("en", "1", 0, "'", 4, False, False, False, 0.5), ("en", "1", 0, "a, b},c'", 3, True, False, True, 0.375), ("en", "1", 1, "x,1,2,T,F'", 1, False, True, False, 0.125), ("en", "2", 0, "z'", 0, False, False, False, 0.0)]
    assert [f.name for f in labels.schema] == ["lang", "page_id", "pos", "title", "occurrences", "from_redirect", "from_title", "is_primary", "proportion"]
    for df in (found, labels):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "RLIKE" not in plan.upper() and plan.find("Generate") < (plan.find("Window") if "Window" in plan else len(plan))
