import os

import pytest

import __spark_entry__
from lorelink.plans import more_queries, oracle, queries

QUERIES = {**queries.QUERIES, **more_queries.QUERIES}
SQL = {**oracle.ORACLE_SQL, **more_queries.ORACLE_SQL}


def test_contract(spark):
    got = __spark_entry__.entry(spark)
    assert got.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    want = con.sql(SQL[name])
    assert sorted(want.columns) == columns

    def plain(v):
        return round(v, 8) if isinstance(v, float) else v

    got = sorted((tuple(plain(x) for x in r) for r in df.select(*columns).collect()), key=str)
    names = want.columns
    rows = sorted((tuple(plain(dict(zip(names, r))[c]) for c in columns) for r in want.fetchall()), key=str)
    assert got == rows


def test_web_links_of_odd_texts(spark, tmp_path):
    """Dashes and blanks at the ends, runs of tokens, ligatures, links without a text or a target: as SQL has them."""
    import duckdb

    texts = ["by - the -( and", "BY -", "by-- -by - -- By ( x", "nº no No n° oﬃce office ½ 1⁄2", "Été ete, ÉTÉ. e.t.e A-B a b", "page 7 page7 한국", None, "", " \n\t", "́ bý éte"]
    anchors = ["By", " by", "(", "-", " ", "", "no", "nº", "office", "été", "a b", "page 7", "한국", "by ", "--"]
    html = "".join(f'<p><a href="/t{i}">{x}</a>' for i, x in enumerate(anchors)) + '<a href="/">by</a><a href="/t0">By</a>'
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'s' AS source").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, html), (2, '<a href="/t0">By</a>'), (3, None)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    for name in ("documents", "pages"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = con.sql(SQL["link_candidates_web"])
    got = QUERIES["link_candidates_web"](spark, str(tmp_path)).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall()) != []


def test_web_links_meet_pages_and_words_once(spark, sf):
    """Few labels: pages are read before, n-grams meet the labels where they are made, without bitmaps."""
    plan = QUERIES["link_candidates_web"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "bitmap" not in plan and "<a href" not in plan and plan.count("regexp_extract_all") == 1
