"""Golden values on six documents, and properties that any index has."""

import pytest
from pyspark.sql import functions as F

from inkwell.operators import index as ix
from inkwell.operators import paging, search, sets
from inkwell.plans.profile import MG_INT, SPARCK_JONES
from inkwell.plans.request import SearchRequest, free_text, parse_block, parse_boolean, parse_query_string

TEXTS = ["Pease porridge hot, pease porridge cold,", "Pease porridge pot,", "Nine days old.", "pot cold, pot hot,", "Pease porridge, pease porridge,", "Eat lot."]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "docnum long, text string")


@pytest.fixture(scope="module")
def index(docs):
    i = ix.build(docs)
    return ix.Index(i.docs, i.postings.cache())


def nums(df):
    return [r["docnum"] for r in df.collect()]


@pytest.mark.parametrize("profile,expected", [(SPARCK_JONES, [1.380378, 1.341825, 2.401132, 1.335712, 0.980258, 1.960516]), (MG_INT, [3.280802, 2.082237, 3.370415, 3.058263, 2.630596, 2.751933])])
def test_weights(index, profile, expected):
    rows = index.with_profile(profile).doc_stats.orderBy("docnum").collect()
    assert [r["dwt"] for r in rows] == pytest.approx(expected, abs=1e-6)
    assert [r["maxdtf"] for r in rows] == [2, 1, 1, 2, 2, 1]


RANKED = {
    ("nine days old porridge", "sparck_jones"): [(2, 4.730976, 3), (4, 1.231256, 1), (1, 0.899483, 1), (0, 0.874361, 1)],
    ("pot pot cold", "sparck_jones"): [(3, 2.248113, 2), (1, 1.432237, 1), (0, 0.783133, 1)],
    ("pease", "sparck_jones"): [(4, 1.231256, 1), (1, 0.899483, 1), (0, 0.874361, 1)],
    ("nine days old porridge", "mg_int"): [(2, 3.370415, 3), (4, 0.776836, 1), (0, 0.622879, 1), (1, 0.579641, 1)],
    ("pot pot cold", "mg_int"): [(3, 1.535273, 2), (1, 0.922956, 1), (0, 0.439331, 1)],
    ("pease", "mg_int"): [(4, 0.776836, 1), (0, 0.622879, 1), (1, 0.579641, 1)],
}


@pytest.mark.parametrize("query,profile", RANKED)
def test_ranked(index, query, profile):
    i = index.with_profile({"sparck_jones": SPARCK_JONES, "mg_int": MG_INT}[profile])
    got = [(r["docnum"], r["score"], r["hits"]) for r in search.ranked(i, query).collect()]
    assert [(a, c) for a, _, c in got] == [(a, c) for a, _, c in RANKED[query, profile]]
    assert [b for _, b, _ in got] == pytest.approx([b for _, b, _ in RANKED[query, profile]], abs=1e-6)


BOOLEAN = {
    "pease and pot": [1], "(hot and cold) or old": [0, 2, 3], "not pease": [2, 3, 5], "pease and not hot": [1, 4], "pot or cold and hot": [0, 1, 3], "not not pease": [0, 1, 4],
    "not zzz": [0, 1, 2, 3, 4, 5], "Pease": [], "pease AND pot": [], "pease pot": [], "pease)": [], "pease and": [], "": [], "(pease pot)": [0, 1, 4], "(pease": [0, 1, 4],
}


@pytest.mark.parametrize("query", BOOLEAN)
def test_boolean(index, query):
    assert nums(search.boolean(index, query)) == BOOLEAN[query]


def test_other_searches(index):
    assert nums(search.all_terms(index, "pease pot")) == [1]
    assert nums(search.all_terms(index, "pease zzz")) == []
    assert nums(search.boolean(index, "po", exact=False)) == [0, 1, 3, 4]
    assert [r["term"] for r in search.prefix_terms(index, "po").collect()] == ["porridge", "pot"]
    assert nums(search.boolean(index, "pease & !(hot | pot)", 1)) == [4]
    assert [(r["term"], r["tf"]) for r in search.query_term_hits(index, "pease zzz").orderBy("pos").collect()] == [("pease", 3), ("zzz", 0)]
    assert index.most_popular().first()["term"] == "pease"
    assert tuple(index.info.first()) == (6, 6, 3, 2, False)
    assert nums(search.search(index, SearchRequest(expression="pease and pot", method="boolean"))) == [1]
    assert search.ranked(index, "and or not").count() == 0


def test_laws(index):
    b = lambda q: set(nums(search.boolean(index, q)))
    assert b("not (hot or pease)") == b("not hot and not pease")
    assert set(nums(search.ranked(index, "hot pease"))) == b("hot or pease")
    assert set(nums(search.all_terms(index, "hot pease"))) == b("hot and pease")


def test_merge_verify_write(spark, docs, index, tmp_path):
    a, b = ix.build(docs.where("docnum < 3")), ix.build(docs.where("docnum >= 3"))
    key = lambda df: sorted(map(tuple, df.select("term", "docnum", "dtf").collect()))
    assert key(ix.merge(a, b).postings) == key(index.postings)
    assert ix.verify(index.terms, index.postings).count() == 0
    assert ix.verify(index.terms.where("term <> 'pot'"), index.postings).collect()[0]["term"] == "pot"
    index.write(str(tmp_path), 2)
    again = ix.Index.read(spark, str(tmp_path))
    assert nums(search.ranked(again, "pot pot cold")) == [3, 1, 0]
    gaps = ix.dgaps(index.postings).where("term = 'pease'").orderBy("docnum").collect()
    assert [(r["gap"], r["dtf"]) for r in gaps] == [(0, 2), (1, 1), (3, 2)]
    front = {r["term"]: (r["prefix_len"], r["suffix"]) for r in ix.front_coded(index.terms).collect()}
    assert front["pot"] == (2, "t") and front["pease"] == (0, "pease")


def test_last_word_and_empty(spark):
    one = spark.createDataFrame([(0, "a b_c d"), (1, None), (2, "")], "docnum long, text string")
    from dataclasses import replace

    old = replace(MG_INT, word="[A-Za-z0-9_]", lower=False, keeps_last_word=False)
    assert sorted(r["term"] for r in ix.postings_of(one, old).collect()) == ["a", "b_c"]
    i = ix.build(one)
    assert i.info.first()["n"] == 3
    assert nums(search.boolean(i, "not a")) == [1, 2]
    assert ix.build(one.limit(0)).info.first()["n"] == 0


def test_sets(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "docnum long") for xs in ((0, 32, 40000), (10, 32, 99)))
    n = lambda df: sets.cardinality(df).first()["n"]
    assert n(sets.bitmap_or(sets.bitmap(a), sets.bitmap(b))) == 5
    assert n(sets.bitmap_and(sets.bitmap(a), sets.bitmap(b))) == 1
    assert sorted(nums(sets.minus(a, b))) == [0, 40000]
    assert sorted(nums(sets.contains(a, b))) == [32]


def test_pages():
    show = lambda *a: (lambda p: (p.pages, p.page, p.start, p.stop))(paging.page_of(*a))
    assert show(13, 5, 1) == (3, 1, 1, 5)
    assert show(13, 5, 3) == show(13, 5, 9) == (3, 3, 11, 13)
    assert paging.page_of(0, 5, 1).message.startswith("Page 0 displayed, out of 0 pages")
    assert SearchRequest(page_size=3, page=-2).checked().page_size == 5
    page = paging.page_of(13, 5, 2)
    template = paging.load_template("##ys_page_head##\n<html>\n##ys_nav_next##\n[%l]\n##ys_page_foot##\n</html>\n")
    out = paging.result_page(["<li>1</li>"], page, template, "?q=a")
    assert out.startswith("<html>") and "[?q=a&page=3]" in out and page.message in out


def test_requests():
    r = parse_query_string("q=pease+porridge%21&sm=bool&ps=3&cp=2&db=x&y=1")
    assert (r.expression, r.method, r.page_size, r.page, r.collection, r.extra) == ("pease porridge!", "boolean", 5, 2, "x", {"y": "1"})
    assert parse_block(":ps=20\npease\nporridge\n").expression == "pease porridge"
    terms = free_text("The the and pot " + " ".join(f"w{i}" for i in range(80)))
    assert (terms[0].term, terms[0].qtf, len(terms)) == ("the", 2, 50)
    assert parse_boolean("a b")[1] and parse_boolean("a and b")[1] is None


def test_html_glue(spark):
    from inkwell.sources.readers import Filters, html_text, paragraphs, parse_filter_config, sections

    html = "<title>T</title><script>no()</script>foo<b>bar</b><!-- c --><p>x &amp; y"
    df = spark.createDataFrame([(0, html)], "page_id long, html string")
    row = df.select(html_text(F.col("html")).alias("s"), html_text(F.col("html"), "drop_prefix").alias("d")).first()
    assert row["s"].split() == ["T", "foo", "bar", "x", "&", "y"] and row["d"].split() == ["T", "bar", "x", "&", "y"]
    parts = sections(spark.createDataFrame([(0, "<p>a</p><h1>T</h1>b<h2 class=x>U</h2>c")], "page_id long, html string")).orderBy("section").collect()
    assert [(r["section"], r["title"]) for r in parts] == [(0, ""), (1, "T"), (2, "U")]
    ps = paragraphs(spark.createDataFrame([(0, "one two\n\n\nthree\nfour\n\n")], "docnum long, text string")).orderBy("paragraph").collect()
    assert [(r["line"], r["title"]) for r in ps] == [(1, "Paragraph 1 at Line 1, beginning with [ one two ...]"), (4, "Paragraph 2 at Line 4, beginning with [ three four ...]")]
    assert len(Filters({"doc": lambda c: c}).chain("a.doc.gz")) == 2
    assert parse_filter_config("gz.filter=pipe;gzip -dc\n#x\npdf.filter=xml;conv")["pdf"] == ("xml", "conv")


def test_read_xml_and_files(spark, tmp_path):
    from inkwell.sources.readers import Catalog, read_files, read_xml

    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.txt").write_text("hello world")
    (tmp_path / "a" / "tmp.1").write_text("no")
    (tmp_path / "f.xml").write_text('<FILE title="F"><DOC title="A">one two</DOC><DOC title="B">three</DOC></FILE>')
    assert [r["name"] for r in read_files(spark, str(tmp_path / "a")).collect()] == ["x.txt"]
    files, docs = read_xml(spark, str(tmp_path / "f.xml"))
    assert files.first()["title"] == "F" and sorted((r["title"], r["text"]) for r in docs.collect()) == [("A", "one two"), ("B", "three")]
    assert Catalog("news.path=/x\n").path("news") == "/x"
